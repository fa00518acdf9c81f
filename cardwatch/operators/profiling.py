"""Profiles of a labelled transaction table."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.functions.numeric import as_null_if_nan

# The features that profiles look at.
PROFILE_FEATURES = [
    "amount_log",
    "amount_zscore_30d",
    "amount_ratio_avg_30d",
    "velocity_score",
    "is_burst_1h",
    "is_geo_mismatch",
    "is_cnp",
    "is_ecom",
    "is_atm",
    "is_high_risk_mcc",
    "is_night",
    "is_weekend",
    "distinct_countries_last_24h",
    "n_tx_last_1h",
    "n_tx_last_24h",
]


def tag_attack_pattern(df: DataFrame, column: str = "attack_pattern") -> DataFrame:
    """Known attack patterns by their typical ranges; the first that matches wins, null if none."""
    ecom, atm = F.col("channel") == "ECOM", F.col("channel") == "ATM"
    amount, hour, countries = F.col("amount"), F.col("n_tx_last_1h"), F.col("distinct_countries_last_24h")
    times = amount / F.nullif(F.col("amount_avg_30d"), F.lit(0.0))
    abroad = F.upper("merchant_country") != F.upper("card_country")
    pattern = (
        F.when(ecom & amount.between(0.5, 5.0) & (hour >= 6) & (countries >= 2), F.lit("card_testing"))
        .when(atm & amount.between(400.0, 950.0) & (F.col("merchant_mcc") == "6011") & hour.between(2, 5), F.lit("cashout"))
        .when(ecom & F.col("merchant_mcc").isin("7995", "5967") & amount.between(100.0, 800.0), F.lit("high_risk_mcc"))
        .when(
            F.col("channel").isin("ECOM", "POS") & F.col("merchant_mcc").isin("5732", "5999") & times.between(6.0, 15.0),
            F.lit("account_takeover"),
        )
        .when(ecom & amount.between(80.0, 600.0) & abroad & (countries >= 2), F.lit("geo_anomaly"))
    )
    return df.withColumn(column, pattern)


def pattern_shares(df: DataFrame, column: str = "attack_pattern", label: str = "is_fraud") -> DataFrame:
    """Share of each pattern among the frauds that carry one."""
    frauds = df.filter((F.col(label) == 1) & F.col(column).isNotNull())
    counts = frauds.groupBy(column).agg(F.count("*").alias("n_rows"))
    whole = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row per pattern
    return counts.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(whole)).orderBy(F.desc("share"), column)


def amount_histogram(df: DataFrame, n_bins: int = 60, label: str = "is_fraud") -> DataFrame:
    """Density of log(1 + amount) per class in equal bins from its least to its greatest value, empty bins too.

    Two passes: the ends per class, then the counts. The greatest value belongs to the last bin; rows
    without an amount belong to none.
    """
    logs = df.select(F.col(label).alias("label"), F.log1p("amount").alias("x"))
    ends = logs.groupBy("label").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n"))
    placed = logs.filter(F.col("x").isNotNull()).join(F.broadcast(ends), "label")  # one row per class
    width = (F.col("high") - F.col("low")) / float(n_bins)
    raw = F.floor((F.col("x") - F.col("low")) / F.nullif(width, F.lit(0.0)))
    bins = F.least(F.lit(n_bins - 1), F.coalesce(raw, F.lit(0)))
    found = placed.groupBy("label", bins.alias("bin")).agg(F.count("*").alias("n_found"))
    all_bins = ends.select("label", "n", "low", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    counts = all_bins.join(found, ["label", "bin"], "left").withColumn("n_rows", F.coalesce("n_found", F.lit(0)))
    return counts.select(
        F.col("label").alias(label),
        F.col("bin").cast("int").alias("bin"),
        (F.col("low") + F.col("width") * F.col("bin")).alias("bin_start"),
        "n_rows",
        (F.col("n_rows") / F.nullif(F.col("n") * F.col("width"), F.lit(0.0))).alias("density"),
    )


def _means(df: DataFrame, features: Sequence[str], group: Column, values: dict[str, Column]) -> DataFrame:
    """(feature, mean per group) from one aggregate; the long form is made of its single row."""
    cells = [
        F.avg(F.when(group == value, F.col(name).cast("double"))).alias(f"{key}|{name}")
        for name in features
        for key, value in values.items()
    ]
    wide = df.agg(*cells)
    rows = F.array(
        *[F.struct(F.lit(name).alias("feature"), *[F.col(f"{key}|{name}").alias(key) for key in values]) for name in features]
    )
    return wide.select(F.explode(rows).alias("row")).select("row.*")


def class_means(df: DataFrame, features: Sequence[str] = PROFILE_FEATURES, label: str = "is_fraud") -> DataFrame:
    """Feature means by class and their ratio to two digits, greatest first."""
    means = _means(df, features, F.col(label), {"legit": F.lit(0), "fraud": F.lit(1)})
    lift = F.round(F.col("fraud") / F.nullif(F.col("legit"), F.lit(0.0)), 2)
    return means.withColumn("lift", lift).orderBy(F.desc_nulls_last("lift"), "feature")


def split_means(df: DataFrame, features: Sequence[str] = PROFILE_FEATURES) -> DataFrame:
    """Feature means of the train and test split, and the difference in percent of the former."""
    means = _means(df, features, F.col("split"), {"train_mean": F.lit("train"), "test_mean": F.lit("test")})
    train = F.nullif(F.col("train_mean"), F.lit(0.0))
    return means.withColumn("rel_diff_pct", F.round((F.col("test_mean") - F.col("train_mean")) / train * 100.0, 2))


def hour_profile(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Rows and share of class per hour, zero where a class has none."""
    counts = df.groupBy("hour").agg(F.count_if(F.col(label) == 0).alias("n_legit"), F.count_if(F.col(label) == 1).alias("n_fraud"))
    whole = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # 24 rows

    def of_class(name: str) -> Column:
        return F.coalesce(F.col(name) / F.nullif(F.sum(name).over(whole), F.lit(0)), F.lit(0.0))

    return counts.withColumns({"legit_share": of_class("n_legit"), "fraud_share": of_class("n_fraud")})


def geo_fraud_rate(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    counts = df.groupBy("is_geo_mismatch").agg(
        F.count_if(F.col(label) == 0).alias("n_legit"), F.count_if(F.col(label) == 1).alias("n_fraud")
    )
    return counts.withColumn("fraud_rate", F.round(F.col("n_fraud") / (F.col("n_legit") + F.col("n_fraud")), 4))


def cross_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, n, x, y, xx, yy, xy) for each pair of places i < j in ``columns``, over the rows that have both values.

    Sums are taken of the distances from each column's least value, so that they stay near the spread in size. A
    task keeps one matrix of sums for all pairs, whatever its rows, and hands on that. NaN counts as null.
    """
    p = len(columns)
    values = [as_null_if_nan(F.col(name).cast("double")) for name in columns]
    low = df.agg(*[F.min(v).alias(str(i)) for i, v in enumerate(values)]).first()
    origin = np.array([0.0 if x is None else x for x in low])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, x, xx, xy = (np.zeros((p, p)) for _ in range(4))
        for batch in batches:
            data = np.column_stack([c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in batch.columns]) - origin
            known = ~np.isnan(data)
            data = np.where(known, data, 0.0)
            here = known.astype(float)
            n += here.T @ here
            x += data.T @ here  # row i, column j: sum of i where j is known
            xx += (data * data).T @ here
            xy += data.T @ data
        i, j = np.triu_indices(p, 1)
        sums = {"n": n[i, j], "x": x[i, j], "y": x[j, i], "xx": xx[i, j], "yy": xx[j, i], "xy": xy[i, j]}
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32)} | sums)

    named = df.select(*[v.alias(str(i)) for i, v in enumerate(values)])
    fields = ["n", "x", "y", "xx", "yy", "xy"]
    parts = named.mapInArrow(count, "i int, j int, " + ", ".join(f"{f} double" for f in fields))
    return parts.groupBy("i", "j").agg(*[F.sum(f).alias(f) for f in fields])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns (a before b in the list) over the rows that have both.

    Null if one of them is constant or there are no such rows; an empty table gives nulls. NaN counts as null.
    """
    def spread(total: str, squares: str) -> Column:
        """Row count squared times the variance; what is lost in rounding is no spread."""
        value, scale = F.col("n") * F.col(squares) - F.col(total) * F.col(total), F.col("n") * F.col(squares)
        return F.when(value > 1e-12 * scale, value)

    moments = cross_moments(df, columns)
    product = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    found = moments.withColumn("correlation", product / (F.sqrt(spread("x", "xx")) * F.sqrt(spread("y", "yy"))))
    names = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b")) for i, j in itertools.combinations(range(len(columns)), 2)]
    pairs = df.sparkSession.range(1).select(F.explode(F.array(*names)).alias("pair")).select("pair.*")
    return pairs.join(F.broadcast(found), ["i", "j"], "left").select("a", "b", "correlation")  # one row per pair on both sides
