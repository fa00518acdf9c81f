"""Population stability of features and scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.operators.sketches import exact_quantiles
from cardwatch.session import materialize

EPS = 1e-6
_BINS = pa.schema([("feature", pa.string()), ("bin", pa.int32()), ("n", pa.int64())])


def inner_edges(df: DataFrame, features: Sequence[str], n_bins: int = 10, sketches: DataFrame | None = None) -> DataFrame:
    """(feature, edges): distinct quantiles of the reference without the outer two.

    Fewer than three distinct quantiles leave no usable bins; such a feature has null edges. ``sketches`` are stored
    ones of the same rows, if there are any.
    """
    # Multiples of the step, not i / n_bins: the two differ in the last bit, and a value that lies
    # exactly on an edge then falls into another bin.
    points = [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]
    ends = exact_quantiles(df, features, points, sketches)
    distinct = F.array_sort(F.array_distinct("quantiles"))
    size = F.size("distinct")
    return ends.select("feature", distinct.alias("distinct")).select(
        "feature", F.when(size > 2, F.slice("distinct", 2, size - 2)).alias("edges")
    )


def bins_of_rows(df: DataFrame, edges: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, bin, n) from rows. Values find their bin before they are counted, so a task hands on one
    row per feature and bin whatever the values. Null and NaN are in no bin."""
    # One short row per feature.
    known = {row["feature"]: np.array(row["edges"], float) for row in edges.filter(F.col("edges").isNotNull()).collect()}
    names = [name for name in features if name in known]
    if not names:
        return df.sparkSession.createDataFrame([], "feature string, bin int, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(known[name]) + 1, np.int64) for name in names]
        for batch in batches:
            for total, name, column in zip(totals, names, batch.columns, strict=True):
                values = column.drop_null().to_numpy(zero_copy_only=False)
                total += np.bincount(np.searchsorted(known[name], values[~np.isnan(values)], side="right"), minlength=len(total))
        for total, name in zip(totals, names, strict=True):
            bins = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"feature": [name] * len(bins), "bin": pa.array(bins, pa.int32()), "n": pa.array(total[bins], pa.int64())}, schema=_BINS)

    wide = df.select(*[F.col(name).cast("double").alias(str(i)) for i, name in enumerate(names)])
    return wide.mapInArrow(count, "feature string, bin int, n long").groupBy("feature", "bin").agg(F.sum("n").alias("n"))


def psi_from_bins(expected: DataFrame, actual: DataFrame, edges: DataFrame, eps: float = EPS) -> DataFrame:
    """(feature, psi) from bin counts of both samples and stored edges of the reference."""
    usable = edges.filter(F.col("edges").isNotNull())
    bins = usable.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    # At most one row per feature and bin on every side from here on.
    table = (
        bins.join(F.broadcast(expected.withColumnRenamed("n", "e")), ["feature", "bin"], "left")
        .join(F.broadcast(actual.withColumnRenamed("n", "a")), ["feature", "bin"], "left")
        .fillna(0, ["e", "a"])
    )
    cells = table.groupBy("feature").agg(
        F.sum("e").alias("n_e"), F.sum("a").alias("n_a"), F.array_sort(F.collect_list(F.struct("bin", "e", "a"))).alias("cells")
    )

    def term(cell: Column) -> Column:
        e = cell["e"] / F.col("n_e") + F.lit(eps)
        a = cell["a"] / F.col("n_a") + F.lit(eps)
        return (a - e) * F.ln(a / e)

    total = F.aggregate("cells", F.lit(0.0), lambda done, cell: done + term(cell))
    scored = cells.select("feature", F.when((F.col("n_e") > 0) & (F.col("n_a") > 0), total).otherwise(F.lit(0.0)).alias("psi"))
    return edges.select("feature").join(F.broadcast(scored), "feature", "left").fillna(0.0, ["psi"])


def psi(
    expected: DataFrame, actual: DataFrame, features: Sequence[str], n_bins: int = 10, eps: float = EPS, sketches: DataFrame | None = None
) -> DataFrame:
    """Population stability index of each feature, all features in one job.

    A feature without values on one side, or with too few distinct quantiles (constant, or a flag),
    has index 0.
    """
    edges = materialize(inner_edges(expected, features, n_bins, sketches))
    found = psi_from_bins(bins_of_rows(expected, edges, features), bins_of_rows(actual, edges, features), edges, eps)
    names = expected.sparkSession.createDataFrame([(name,) for name in features], "feature string")
    return names.join(F.broadcast(found), "feature", "left").fillna(0.0, ["psi"])


def with_level(scored: DataFrame) -> DataFrame:
    level = (
        F.when(F.col("psi") > 0.25, F.lit("major")).when(F.col("psi") >= 0.10, F.lit("moderate")).otherwise(F.lit("stable"))
    )
    return scored.withColumn("level", level)


def against_training(df: DataFrame, stats: DataFrame, features: Sequence[str]) -> DataFrame:
    """Live mean per feature in training deviations, and the share of rows outside the training p01..p99."""
    doubles = df.select(*[F.col(name).cast("double").alias(name) for name in features])
    long = doubles.unpivot([], list(features), "feature", "value")
    outside = ~F.col("value").between(F.col("p01"), F.col("p99"))
    live = (
        long.join(F.broadcast(stats), "feature")  # one row per feature
        .groupBy("feature", "mean", "std")
        .agg(F.avg("value").alias("live_mean"), F.avg(outside.cast("int")).alias("share_outside"))
    )
    return live.select(
        "feature", "live_mean", ((F.col("live_mean") - F.col("mean")) / F.col("std")).alias("z"), "share_outside"
    )
