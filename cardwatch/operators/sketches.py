"""Quantiles from sketches that are kept per feature and day, made exact by counting.

A sketch says about where a rank lies. A counting pass cuts that bracket into PARTS equal parts of the order of all
numbers and says in which part the rank is, exactly, also if it is in none of the bracket's. A part's least and greatest value
end the search where all rows of the part are equal, as they are for flags and counts. After one or two passes few
rows are left elsewhere, and their values are counted. Tasks hand on counts and sketches: nothing is shuffled that
grows with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.functions.numeric import as_null_if_nan

#: Size of a sketch, the share of rows by which its ranks may be off, ranks that a sketch is asked for, parts per
#: counting pass, and rows that a bracket may hold when its values are counted.
SIZE = 800
OFF_BY = 0.01
GRID = 200
PARTS = 256
FEW_ROWS = 2_000
_TOP = (1 << 64) - 1
_SIGN = np.uint64(1 << 63)


def daily_sketches(df: DataFrame, features: Sequence[str], timestamp: str = "timestamp", size: int = SIZE) -> DataFrame:
    """(day, feature, n, sketch), with the day in UTC as days since 1970; to be stored and merged for any span of days."""
    day = F.floor(F.unix_micros(F.col(timestamp).cast("timestamp")) / 86_400_000_000).alias("day")
    # -0.0 and 0.0 are one value.
    values = [(as_null_if_nan(F.col(name).cast("double")) + F.lit(0.0)).alias(name) for name in features]
    cells = [F.struct(F.lit(n).alias("feature"), F.count(n).alias("n"), F.kll_sketch_agg_double(n, size).alias("sketch")) for n in features]
    wide = df.select(day, *values).groupBy("day").agg(F.array(*cells).alias("cells"))
    return wide.select("day", F.explode("cells").alias("cell")).select("day", "cell.*").filter("n > 0")


def merged(sketches: DataFrame) -> DataFrame:
    """(feature, n, sketch) over all given days."""
    return sketches.groupBy("feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def _bracket(sketch: Column, n: Column, rank: Column, off_by: float) -> list[Column]:
    """Values around a rank (from 0) among n; the ends are open where the rank may be outermost."""
    # A sketch is asked for fixed ranks only, so for a grid of them.
    values = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    low, high = F.floor((rank / n - off_by) * GRID).cast("int"), F.ceil(((rank + 2) / n + off_by) * GRID).cast("int")
    ends = F.when(low > 0, F.get(values, low)).otherwise(F.lit(-math.inf)), F.when(high < GRID, F.get(values, high)).otherwise(F.lit(math.inf))
    return [ends[0].alias("low"), ends[1].alias("high")]


def _ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the values, equal for equal values only; -0.0 is 0.0."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | _SIGN)


def _value(number: int) -> float:
    bits = number ^ int(_SIGN) if number >> 63 else number ^ _TOP
    return float(np.array([bits], np.uint64).view(float)[0])


def _sorted(column: pa.Array) -> np.ndarray:
    values = column.drop_null().to_numpy(zero_copy_only=False)
    return np.sort(_ordered(values[~np.isnan(values)]))


def _columns(df: DataFrame, features: Sequence[str], places: Sequence[int]) -> DataFrame:
    return df.select(*[F.col(features[i]).cast("double").alias(str(i)) for i in places])


def _counted(df: DataFrame, features: Sequence[str], cuts: dict[int, np.ndarray]) -> dict[int, list[tuple[int, int, int]]]:
    """Per place of a feature the (n, least, greatest) of all parts with rows, in order; a part reaches from one cut to before the next.

    A task adds up all of its rows before it hands on anything.
    """
    places = sorted(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {f: np.zeros(len(cuts[f]), np.int64) for f in places}
        low = {f: np.full(len(cuts[f]), _TOP, np.uint64) for f in places}
        high = {f: np.zeros(len(cuts[f]), np.uint64) for f in places}
        for batch in batches:
            for f, column in zip(places, batch.columns, strict=True):
                numbers = _sorted(column)
                starts = np.searchsorted(numbers, cuts[f], side="left")
                ends = np.append(starts[1:], len(numbers))
                own = np.flatnonzero(ends > starts)
                n[f][own] += ends[own] - starts[own]
                low[f][own] = np.minimum(low[f][own], numbers[starts[own]])
                high[f][own] = np.maximum(high[f][own], numbers[ends[own] - 1])
        for f in places:
            own = np.flatnonzero(n[f])
            ends = {name: pa.array((x[f][own] ^ _SIGN).view(np.int64)) for name, x in (("low", low), ("high", high))}
            yield pa.RecordBatch.from_pydict({"f": pa.array([f] * len(own), pa.int32()), "part": pa.array(own, pa.int64()), "n": pa.array(n[f][own]), **ends})

    lines = _columns(df, features, places).mapInArrow(run, "f int, part long, n long, low long, high long")
    whole = lines.groupBy("f", "part").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found: dict[int, list[tuple]] = {f: [] for f in places}
    for r in whole.toLocalIterator():
        found[r["f"]].append((r["part"], r["n"], r["low"] + int(_SIGN), r["high"] + int(_SIGN)))
    return {f: [x[1:] for x in sorted(own)] for f, own in found.items()}


def _listed(df: DataFrame, features: Sequence[str], brackets: dict[int, list[tuple[int, int]]]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(place of a feature, number of its bracket) -> (value as an ordered number, n) of all values in the bracket."""
    places = sorted(brackets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, column in zip(places, batch.columns, strict=True):
                numbers = _sorted(column)
                for i, (low, high) in enumerate(brackets[f]):
                    inside = numbers[np.searchsorted(numbers, np.uint64(low)) : np.searchsorted(numbers, np.uint64(high), side="right")]
                    if len(inside):
                        values, n = np.unique(inside, return_counts=True)
                        keys = {"f": pa.array([f] * len(n), pa.int32()), "b": pa.array([i] * len(n), pa.int32())}
                        yield pa.RecordBatch.from_pydict({**keys, "number": pa.array(values.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    lines = _columns(df, features, places).mapInArrow(run, "f int, b int, number long, n long")
    kept: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in lines.groupBy("f", "b", "number").agg(F.sum("n").alias("n")).toLocalIterator():
        kept.setdefault((r["f"], r["b"]), []).append((r["number"] & _TOP, r["n"]))
    return kept


def exact_quantiles(
    df: DataFrame, features: Sequence[str], probabilities: Sequence[float], sketches: DataFrame | None = None, off_by: float = OFF_BY, few: int = FEW_ROWS
) -> DataFrame:
    """(feature, quantiles): exact, linear between neighbours, in the order of ``probabilities``.

    ``sketches`` (feature, n, sketch) must be of the rows of ``df``; without them one more pass makes them. Nulls
    and NaN are left out; a feature without values has no row. Per pass the driver gets PARTS counts for each feature
    and rank at most, in the end ``few`` values.
    """
    features = list(features)
    if sketches is None:
        whole = df.select(*[(as_null_if_nan(F.col(n).cast("double")) + F.lit(0.0)).alias(n) for n in features])
        cells = [F.struct(F.lit(n).alias("feature"), F.count(n).alias("n"), F.kll_sketch_agg_double(n, SIZE).alias("sketch")) for n in features]
        sketches = whole.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("cell")).select("cell.*").filter("n > 0")
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    asked = sketches.select("feature", "n", "sketch", F.explode(wanted).alias("p"))
    rank = F.floor(F.col("p") * (F.col("n") - 1)).cast("long")
    rows = asked.select("feature", "n", rank.alias("rank"), *_bracket(F.col("sketch"), F.col("n"), rank, off_by)).collect()
    place = {name: i for i, name in enumerate(features)}
    sizes = {place[r["feature"]]: r["n"] for r in rows}
    # (feature, rank) -> the bracket that holds it, in ordered numbers, both ends included.
    open_: dict[tuple[int, int], tuple[int, int]] = {}
    for r in rows:
        ends = tuple(int(x) for x in _ordered(np.array([r["low"], r["high"]])))
        for one in {r["rank"], min(r["rank"] + 1, r["n"] - 1)}:
            open_[place[r["feature"]], one] = ends
    found: dict[tuple[int, int], float] = {}
    last: dict[tuple[int, int], tuple[int, int, int]] = {}  # brackets with few rows, and the rows below

    while open_:
        cuts: dict[int, set] = {}
        for (f, _), (low, high) in open_.items():
            width = (high - low) // PARTS + 1
            cuts.setdefault(f, {0}).update(range(low, high + 1, width), [min(high + 1, _TOP)])
        counts = _counted(df, features, {f: np.array(sorted(own), np.uint64) for f, own in cuts.items()})
        still = {}
        for f, one in open_:
            below = 0
            for n, low, high in counts[f]:
                if one < below + n:
                    break
                below += n
            else:
                raise ValueError(f"the sketch of {features[f]} is not of these rows")
            if low == high:
                found[f, one] = _value(low)
            elif n <= few:
                last[f, one] = (low, high, below)
            else:
                still[f, one] = (low, high)
        open_ = still
    if last:
        brackets: dict[int, list] = {f: sorted({ends[:2] for (g, _), ends in last.items() if g == f}) for f, _ in last}
        kept = _listed(df, features, brackets)
        for (f, one), (low, high, below) in last.items():
            for number, n in sorted(kept[f, brackets[f].index((low, high))]):
                below += n
                if one < below:
                    found[f, one] = _value(number)
                    break
    lines = []
    for f, n in sizes.items():
        out = []
        for p in probabilities:
            spot = p * (n - 1)
            one = math.floor(spot)
            at, after = found[f, one], found[f, min(one + 1, n - 1)]
            out.append(at + (after - at) * (spot - one) if spot > one else at)
        lines.append((features[f], out))
    return df.sparkSession.createDataFrame(lines, "feature string, quantiles array<double>")
