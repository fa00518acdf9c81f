"""The given event table seen as card transactions: clean, and with planted contract violations.

The expressions are plain SQL on purpose, so that the checking engine can evaluate the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.sources.schemas import EVENTS

_HOME = (
    "CASE user_id % 6 WHEN 0 THEN 'FR' WHEN 1 THEN 'DE' WHEN 2 THEN 'ES' WHEN 3 THEN 'IT' WHEN 4 THEN 'BE' ELSE 'NL' END"
)
_BURST = "CASE WHEN event_id % 53 = 0 THEN 9 WHEN event_id % 17 = 0 THEN 5 ELSE event_id % 3 END"

# How an event becomes a transaction.
TRANSACTION_SQL = {
    "transaction_id": "concat('T', lpad(cast(event_id AS varchar(20)), 9, '0'))",
    "timestamp": "ts",
    "customer_id": "concat('C', lpad(cast(user_id AS varchar(20)), 7, '0'))",
    "card_id": "concat('K', lpad(cast(user_id AS varchar(20)), 7, '0'))",
    "amount": "round(value * cast(25 AS double), 2)",
    "currency": "'EUR'",
    "merchant_id": "concat('M', lpad(cast((event_id * 7919) % 20000 AS varchar(20)), 6, '0'))",
    "merchant_country": (
        "CASE WHEN event_id % 11 = 0 THEN CASE event_id % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' "
        f"WHEN 2 THEN 'RO' ELSE 'NG' END ELSE {_HOME} END"
    ),
    "merchant_mcc": (
        "CASE event_id % 10 WHEN 0 THEN '5411' WHEN 1 THEN '5812' WHEN 2 THEN '5541' WHEN 3 THEN '5732' "
        "WHEN 4 THEN '5912' WHEN 5 THEN '4111' WHEN 6 THEN '5999' WHEN 7 THEN '6011' "
        "WHEN 8 THEN CASE WHEN event_id % 30 = 8 THEN '7995' ELSE '5411' END "
        "ELSE CASE WHEN event_id % 30 = 9 THEN '5967' ELSE '5812' END END"
    ),
    "card_country": _HOME,
    "channel": "CASE event_type WHEN 'purchase' THEN 'ECOM' WHEN 'error' THEN 'ATM' WHEN 'signup' THEN 'MOTO' ELSE 'POS' END",
    "is_cnp": "event_type IN ('purchase', 'signup')",
    "customer_age_days": "cast(30 + user_id * 13 % 2890 AS int)",
    "card_age_days": "cast(1 + user_id * 7 % 1459 AS int)",
    "n_tx_last_1h": f"cast({_BURST} AS int)",
    "n_tx_last_24h": f"cast({_BURST} + event_id % 5 AS int)",
    "amount_avg_30d": "CASE WHEN user_id % 20 = 0 THEN cast(0 AS double) ELSE cast(400 + user_id % 50 * 20 AS double) END",
    "amount_std_30d": "CASE WHEN user_id % 15 = 0 THEN cast(0 AS double) ELSE cast(100 + user_id % 40 * 10 AS double) END",
    "distinct_countries_last_24h": "cast(CASE WHEN event_id % 41 = 0 THEN 3 ELSE 1 + event_id % 2 END AS int)",
    "is_fraud": (
        "cast(CASE WHEN value * cast(25 AS double) >= 4000 OR event_id % 53 = 0 "
        "OR (event_type = 'purchase' AND event_id % 11 = 0 AND user_id % 3 = 0) THEN 1 ELSE 0 END AS int)"
    ),
}

# The planted violations.
DIRTY_SQL = {
    "transaction_id": "CASE WHEN event_id % 79 = 0 THEN NULL ELSE transaction_id END",
    "timestamp": "timestamp",
    "customer_id": "CASE WHEN event_id % 59 = 0 THEN concat('  ', customer_id, ' ') ELSE customer_id END",
    "card_id": "card_id",
    "amount": "CASE WHEN event_id % 97 = 0 THEN -amount WHEN event_id % 101 = 0 THEN cast(1000000 AS double) ELSE amount END",
    "currency": "CASE WHEN event_id % 71 = 0 THEN 'XXX' WHEN event_id % 43 = 0 THEN NULL ELSE currency END",
    "merchant_id": "merchant_id",
    "merchant_country": (
        "CASE WHEN event_id % 83 = 0 THEN 'FRA' WHEN event_id % 73 = 0 THEN lower(merchant_country) ELSE merchant_country END"
    ),
    "merchant_mcc": "CASE WHEN event_id % 67 = 0 THEN '123' ELSE merchant_mcc END",
    "card_country": "card_country",
    "channel": "CASE WHEN event_id % 89 = 0 THEN 'WEB' ELSE channel END",
    "is_cnp": "is_cnp",
    "customer_age_days": "customer_age_days",
    "card_age_days": "card_age_days",
    "n_tx_last_1h": "CASE WHEN event_id % 61 = 0 THEN -1 ELSE n_tx_last_1h END",
    "n_tx_last_24h": "n_tx_last_24h",
    "amount_avg_30d": "amount_avg_30d",
    "amount_std_30d": "CASE WHEN event_id % 103 = 0 THEN cast('NaN' AS double) ELSE amount_std_30d END",
    "distinct_countries_last_24h": "distinct_countries_last_24h",
}


def _project(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(sql).alias(name) for name, sql in expressions.items()])


def transactions_from_events(events: DataFrame) -> DataFrame:
    return _project(events, TRANSACTION_SQL)


def _numbered(transactions: DataFrame) -> DataFrame:
    return transactions.withColumn("event_id", F.expr("cast(substr(transaction_id, 2) AS bigint)"))


def dirty_from_transactions(transactions: DataFrame) -> DataFrame:
    return _project(_numbered(transactions), DIRTY_SQL)


def payloads_from_transactions(transactions: DataFrame) -> DataFrame:
    """The dirty rows as JSON text: numbers of customer_age_days as text, one unknown key in some."""
    extra = {"event_id": "event_id", "note": "CASE WHEN event_id % 107 = 0 THEN 'x' END"}
    rows = _project(_numbered(transactions), DIRTY_SQL | extra)
    stamp = F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    special = {"timestamp": stamp, "customer_age_days": F.col("customer_age_days").cast("string")}
    fields = [special.get(name, F.col(name)).alias(name) for name in (*DIRTY_SQL, "note")]
    return rows.select("event_id", F.to_json(F.struct(*fields)).alias("value"))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_events(read_events(spark, sf_dir))


def dirty_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_from_transactions(transactions(spark, sf_dir))
