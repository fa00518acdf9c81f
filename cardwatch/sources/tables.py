"""Readers and writers. Every reader takes a schema, so a scan never infers one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.sources.schemas import LABELLED, TRANSACTION_FIELDS

# Columns that may leave the system: tokens and codes, no free text about a person.
OUTPUT_COLUMNS = [
    "transaction_id",
    "timestamp",
    "card_id",
    "merchant_id",
    "action",
    "fraud_probability",
    "adjusted_probability",
    "risk_score",
    "reasons",
    "rule_hits",
    "model_version",
]


def read_transactions(spark: SparkSession, path: str, schema: T.StructType = LABELLED) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as raw text in the column ``value``; the contract checks parse them."""
    return spark.read.text(path)


def stream_payloads(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON lines as they arrive in new text files."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def explode_batches(payloads: DataFrame, column: str = "value") -> DataFrame:
    """One row per item of ``{"transactions": [...]}``, with its place in the request.

    Items stay JSON text, so that the contract sees unknown fields and wrongly typed values. A request
    that is no such object, or has no items, gives one row without place and value, which the contract refuses.
    """
    body = T.StructType([T.StructField("transactions", T.ArrayType(T.StringType()))])
    items = F.from_json(F.col(column), body)["transactions"]
    others = [name for name in payloads.columns if name != column]
    return payloads.select(*others, F.posexplode_outer(items).alias("pos", "value"))


def write_split(df: DataFrame, path: str) -> None:
    """One folder per value of ``split``; readers of one split never open the other."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def safe_output(df: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Only the columns allowed on a sink, in the allowed order."""
    allowed = allowed or OUTPUT_COLUMNS
    return df.select(*[name for name in allowed if name in df.columns])


def to_payload(df: DataFrame) -> DataFrame:
    """Transactions as JSON text, timestamps in ISO form with a zone."""
    columns = [name for name in TRANSACTION_FIELDS if name in df.columns]
    stamp = F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    fields = [stamp.alias(name) if name == "timestamp" else F.col(name) for name in columns]
    return df.select("transaction_id", F.to_json(F.struct(*fields)).alias("value"))
