"""Order statistics and running sums over data of any size, without one task seeing all rows.

A global ``ORDER BY`` window runs in one task. Here the ordered column is first cut into ranges of
about equal size; each range adds up on its own and starts from the total of the ranges before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.functions.numeric import all_of, edges_passed
from cardwatch.session import materialize

ROWS_PER_RANGE = 500_000
MAX_RANGES = 4096
_STEP = 64


def _range_number(edges: Column, value: Column) -> Column:
    """Number of edges <= value, found in two steps of at most 64 comparisons each."""
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(edges)), F.lit(_STEP)), lambda i: F.get(edges, i - 1))
    skipped = F.greatest(F.lit(0), edges_passed(heads, value) - 1) * _STEP
    return skipped + edges_passed(F.slice(edges, skipped + 1, F.lit(_STEP)), value)


def running_sums(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Adds ``cum_<s>`` (sum up to and including the row) and ``total_<s>`` for each column in ``sums``.

    ``df`` holds one row per value of ``order`` within ``by``; ``by`` has few distinct values (such
    as features), ``order`` is numeric. ``df`` should be materialized: it is read twice.
    """
    by = list(by)
    sizes = df.groupBy(*by).agg(F.count("*").alias("n_rows"))
    largest = sizes.agg(F.max("n_rows")).first()[0] or 0
    ranges = min(MAX_RANGES, math.ceil(largest / rows_per_range))
    direction = F.col(order).desc() if descending else F.col(order).asc()
    if ranges <= 1:
        keys = [F.col(name) for name in by] or [F.lit(0)]
        running = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*keys)
        added = {f"cum_{s}": F.sum(s).over(running) for s in sums} | {f"total_{s}": F.sum(s).over(whole) for s in sums}
        return df.withColumns(added)

    # Approximate limits of the ranges, at most 4095 per group: they steer the partitioning, never a result.
    points = [i / ranges for i in range(1, ranges)]
    sketch = F.percentile_approx(F.col(order).cast("double"), points, MAX_RANGES * 4)
    rows = df.groupBy(*by).agg(sketch.alias("edges")).collect()
    edges = {tuple(row[name] for name in by): sorted(set(row["edges"] or [])) for row in rows}
    chosen = None
    for key, values in edges.items():
        literal = F.array(*[F.lit(float(v)) for v in values])
        if not by:
            chosen = literal
            continue
        match = F.lit(True)
        for name, part in zip(by, key, strict=True):
            match = match & F.col(name).eqNullSafe(F.lit(part))
        chosen = F.when(match, literal) if chosen is None else chosen.when(match, literal)
    ranged = df.withColumn("_range", _range_number(chosen, F.col(order).cast("double")))

    # At most groups x 4096 rows from here to the join, so this side may be broadcast.
    keys = [F.col(name) for name in by] or [F.lit(0)]
    range_order = F.col("_range").desc() if descending else F.col("_range").asc()
    before = Window.partitionBy(*keys).orderBy(range_order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    offsets = ranged.groupBy(*by, "_range").agg(*[F.sum(s).alias(f"_in_{s}") for s in sums])
    offsets = offsets.select(
        *[F.col(name).alias(f"_of_{name}") for name in [*by, "_range"]],
        *[F.coalesce(F.sum(f"_in_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_in_{s}").over(everything).alias(f"total_{s}") for s in sums],
    )
    inside = Window.partitionBy(*by, "_range").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"_local_{s}": F.sum(s).over(inside) for s in sums})
    # Null-safe, so that rows without a group or a value stay.
    same = all_of([F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in [*by, "_range"]])
    joined = local.join(F.broadcast(offsets), same)
    return joined.select(
        *df.columns,
        *[(F.col(f"_local_{s}") + F.col(f"_before_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"total_{s}") for s in sums],
    )


def present_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value), one row per column and row; nulls and NaN are dropped."""
    doubles = df.select(*[F.col(name).cast("double").alias(name) for name in columns])
    long = doubles.unpivot([], list(columns), "feature", "value")
    # -0.0 and 0.0 are one value.
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("value", F.col("value") + F.lit(0.0))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, n) over several numeric columns in one pass; nulls and NaN are dropped."""
    return present_values(df, columns).groupBy("feature", "value").agg(F.count("*").alias("n"))


def quantiles_of_counts(counts: DataFrame, probabilities: Sequence[float], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Exact quantiles with linear interpolation, (feature, quantiles) with the array in order of ``probabilities``.

    ``counts`` is a materialized ``value_counts``. Only the few values at the wanted ranks are kept
    per feature.
    """
    spots = F.array(*[(F.col("total_n") - 1) * F.lit(float(p)) for p in probabilities])
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total_n"))
    ranks = F.array_distinct(F.flatten(F.transform(spots, lambda s: F.array(F.floor(s), F.ceil(s)))))
    wanted = totals.select(F.col("feature").alias("of"), F.explode(ranks).alias("rank"))

    placed = running_sums(counts, "value", ["n"], by=["feature"], rows_per_range=rows_per_range)
    holds = (F.col("feature") == F.col("of")) & (F.col("rank") >= F.col("cum_n") - F.col("n")) & (F.col("rank") < F.col("cum_n"))
    # At most two ranks per feature and probability.
    picked = placed.join(F.broadcast(wanted), holds)
    gathered = picked.groupBy("feature").agg(
        F.max("total_n").alias("total_n"),
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"),
    )
    at = F.col("at")

    def interpolate(spot: Column) -> Column:
        low, high = at[F.floor(spot)], at[F.ceil(spot)]
        return low + (high - low) * (spot - F.floor(spot))

    return gathered.select("feature", F.transform(spots, interpolate).alias("quantiles"))


@dataclass(frozen=True)
class Cut:
    """Rows up to and including (number, text) in that order come before the cut."""

    number: int | None
    text: str | None = None


def find_cut(
    df: DataFrame,
    number: Column,
    text: Column,
    rank: int,
    interval: Callable[[int, int], Column] | None = None,
    small: int = 10_000,
    bins: int = 4096,
) -> Cut:
    """The cut after the first ``rank`` rows in the order of (number, text), by narrowing histograms.

    Each pass counts the rows of the current interval in at most ``bins`` bins and keeps the bin
    with the wanted rank; no pass sorts or shuffles rows. ``interval`` gives the filter for a range
    of ``number`` in terms of a stored column, so that it can be pushed into the scan.
    """
    if rank <= 0:
        return Cut(None)

    def rows_between(low: int, high: int) -> DataFrame:
        rows = df if interval is None else df.filter(interval(low, high))
        keyed = rows.select(number.cast("long").alias("k"), text.cast("string").alias("t"))
        return keyed.filter(F.col("k").between(low, high))

    low, high, total = df.select(number.cast("long").alias("k")).agg(F.min("k"), F.max("k"), F.count("k")).first()
    if not total:
        return Cut(None)
    rank = min(rank, total)
    while low < high and total > small:
        width = (high - low) // bins + 1
        binned = rows_between(low, high).groupBy(F.floor((F.col("k") - low) / width).alias("bin"))
        counted = binned.agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
        for row in sorted(counted.collect(), key=lambda r: r["low"]):
            if rank <= row["n"]:
                low, high, total = row["low"], row["high"], row["n"]
                break
            rank -= row["n"]
    span = rows_between(low, high)
    if total <= small:
        row = span.orderBy("k", "t").limit(rank).agg(F.max(F.struct("k", "t")).alias("last")).first()["last"]
        return Cut(row["k"], row["t"])
    return Cut(low, find_text(span.select("t"), rank, small))


def find_text(df: DataFrame, rank: int, small: int = 10_000) -> str:
    """The text at ``rank`` in the column ``t`` in binary order, one more character of the common prefix per pass."""
    low, high, total = df.agg(F.min("t"), F.max("t"), F.count("*")).first()
    while low < high and total > small:
        shared = 0
        while shared < min(len(low), len(high)) and low[shared] == high[shared]:
            shared += 1
        span = df.filter(F.col("t").between(low, high))
        counted = span.groupBy(F.substring("t", shared + 1, 1).alias("next")).agg(
            F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high")
        )
        for row in sorted(counted.collect(), key=lambda r: r["low"].encode()):
            if rank <= row["n"]:
                low, high, total = row["low"], row["high"], row["n"]
                break
            rank -= row["n"]
    if low == high:
        return low
    span = df.filter(F.col("t").between(low, high))
    return span.orderBy("t").limit(rank).agg(F.max("t").alias("t")).first()["t"]
