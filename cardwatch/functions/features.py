"""The one definition of the model features, used by training, batch scoring and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.functions.numeric import clip, ratio_or, utc_hour, utc_stamp, utc_weekday

# The model's columns, in the order the model expects them.
FEATURE_COLUMNS = [
    "amount",
    "amount_log",
    "customer_age_days",
    "card_age_days",
    "n_tx_last_1h",
    "n_tx_last_24h",
    "amount_avg_30d",
    "amount_std_30d",
    "distinct_countries_last_24h",
    "amount_ratio_avg_30d",
    "amount_zscore_30d",
    "velocity_score",
    "is_burst_1h",
    "hour",
    "is_night",
    "is_weekend",
    "is_geo_mismatch",
    "is_cnp",
    "is_ecom",
    "is_atm",
    "is_high_risk_mcc",
]

# Gambling and adult content.
HIGH_RISK_MCC = ["7995", "5967"]


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def feature_expressions(timestamp: Column) -> dict[str, Column]:
    """Derived columns by name, over the columns of a transaction."""
    amount, average, deviation = F.col("amount"), F.col("amount_avg_30d"), F.col("amount_std_30d")
    last_hour, last_day = F.col("n_tx_last_1h"), F.col("n_tx_last_24h")
    hour = utc_hour(timestamp)
    same_country = F.upper("merchant_country").eqNullSafe(F.upper("card_country"))
    return {
        "amount_log": F.log1p(amount.cast("double")),
        "amount_ratio_avg_30d": clip(ratio_or(amount, average, 1.0), 0, 100),
        "amount_zscore_30d": clip(ratio_or(amount - average, deviation, 0.0), -20, 20),
        "velocity_score": (last_hour.cast("double") * 3.0 + last_day.cast("double")) / 10.0,
        "is_burst_1h": _flag(last_hour >= 5),
        "hour": hour,
        "is_night": _flag(hour.between(0, 5)),
        "is_weekend": _flag(utc_weekday(timestamp) >= 5),
        "is_geo_mismatch": (~same_country).cast("int"),
        "is_cnp": F.col("is_cnp").cast("int"),
        "is_ecom": _flag(F.col("channel") == "ECOM"),
        "is_atm": _flag(F.col("channel") == "ATM"),
        "is_high_risk_mcc": _flag(F.col("merchant_mcc").cast("string").isin(HIGH_RISK_MCC)),
    }


def build_features(df: DataFrame) -> DataFrame:
    """Input columns plus the derived ones, as one projection without a shuffle.

    Clock features are in UTC: in any session zone; text without an offset is UTC.
    """
    timestamp = F.col("timestamp")
    if isinstance(df.schema["timestamp"].dataType, T.StringType):
        df = df.withColumn("timestamp", utc_stamp(timestamp))
    return df.withColumns(feature_expressions(timestamp))


def require_columns(df: DataFrame, columns: list[str]) -> None:
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise ValueError(f"not in the table: {', '.join(absent)}")


def select_feature_matrix(df: DataFrame, columns: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The model's columns in order, as doubles; ``keep`` names other columns to carry along."""
    columns = columns or FEATURE_COLUMNS
    require_columns(df, columns)
    carried = [F.col(name) for name in keep or []]
    return df.select(*carried, *[F.col(name).cast("double").alias(name) for name in columns])
