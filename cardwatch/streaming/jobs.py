"""Scoring, quarantine, duplicates, windowed counts, bursts, velocity and drift on a stream.

Sinks written from ``foreachBatch`` use one folder per micro-batch and overwrite it, so a batch
that runs twice after a failure leaves one copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from cardwatch.functions.numeric import micros
from cardwatch.operators.contract import check_json, quarantined_rows, valid_rows
from cardwatch.operators.drift import bins_of_rows, psi_from_bins
from cardwatch.plans.scoring import Scorer, score_transactions
from cardwatch.session import materialize
from cardwatch.sources.tables import safe_output


#: What a session should have while a query of ``card_sessions`` runs.
SESSION_SETTINGS = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


def run_available(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Work off all input that is there now, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def latest_per_key(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest state of each key from an update-mode sink with one folder per batch."""
    values = [name for name in batches.columns if name not in (*keys, "batch_id")]
    newest = batches.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return newest.select(*keys, "_v.*")


def score_stream(transactions: DataFrame, scorer: Scorer | None = None, rules=None, policy=None) -> DataFrame:
    """Score typed transactions; the same projection as in batch, so no state and no shuffle."""
    return safe_output(score_transactions(transactions, scorer, rules, policy))


def payload_writer(payloads: DataFrame, scored_path: str, quarantine_path: str, scorer: Scorer | None = None, rules=None, policy=None):
    """Writer that checks JSON payloads, scores the good ones and sets the bad ones aside, from one parse per batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        checked = check_json(batch).persist()
        try:
            good = safe_output(score_transactions(valid_rows(checked), scorer, rules, policy))
            write_batch(good, scored_path, batch_id)
            write_batch(quarantined_rows(checked), quarantine_path, batch_id)
        finally:
            checked.unpersist()

    return payloads.writeStream.foreachBatch(handle)


def update_writer(df: DataFrame, path: str) -> DataStreamWriter:
    """Keeps each update of an aggregate; read back with ``latest_per_key``."""
    return df.writeStream.outputMode("update").foreachBatch(lambda batch, batch_id: write_batch(batch, path, batch_id))


def with_event_time(df: DataFrame, delay: str, timestamp: str = "timestamp") -> DataFrame:
    """Zone-less stamps count as UTC; rows later than ``delay`` behind the newest may be dropped, and are counted."""
    return df.withColumn(timestamp, F.col(timestamp).cast("timestamp")).withWatermark(timestamp, delay)


def first_of_each(df: DataFrame, delay: str = "1 hour", key: str = "transaction_id") -> DataFrame:
    """Drops repeated ids that come within ``delay`` of the first."""
    return with_event_time(df, delay).dropDuplicatesWithinWatermark([key])


def windowed_decisions(scored: DataFrame, delay: str = "1 hour", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Rows per window and action."""
    window = F.window("timestamp", width, slide or width)
    counts = with_event_time(scored, delay).groupBy(window.alias("w"), "action").agg(F.count("*").alias("n_rows"))
    return counts.select(micros(F.col("w.start")).alias("window_micros"), "action", "n_rows")


def windowed_rule_hits(scored: DataFrame, delay: str = "1 hour", width: str = "5 minutes") -> DataFrame:
    timed = with_event_time(scored, delay).select("timestamp", F.explode("rule_hits").alias("hit"))
    counts = timed.groupBy(F.window("timestamp", width).alias("w"), "hit.code", "hit.severity").agg(F.count("*").alias("n_hits"))
    return counts.select(micros(F.col("w.start")).alias("window_micros"), "code", "severity", "n_hits")


def card_sessions(df: DataFrame, delay: str = "1 hour", gap: str = "10 minutes", card: str = "card_id") -> DataFrame:
    """Bursts per card: runs of transactions with pauses below ``gap``.

    With SESSION_SETTINGS sessions are merged inside each task before the shuffle, so a busy card sends few rows.
    """
    timed = with_event_time(df, delay)
    found = timed.groupBy(F.session_window("timestamp", gap).alias("s"), card).agg(
        F.count("*").alias("n_tx"), F.sum(F.col("amount").try_cast("decimal(18,6)")).cast("double").alias("total_amount")
    )
    return found.select(card, micros(F.col("s.start")).alias("started_micros"), "n_tx", "total_amount")


def with_confirmation(scores: DataFrame, chargebacks: DataFrame, days: int, delay: str = "1 hour") -> DataFrame:
    """Scores with ``confirmed``: whether a chargeback of the transaction came within ``days`` after it.

    Both sides are streams. A confirmed row comes out when its chargeback does, any other once the watermark of both
    streams has passed its time limit, so a label is final when it is written. State is kept for that limit.
    """
    left = with_event_time(scores, delay)
    right = chargebacks.select(F.col("transaction_id").alias("_id"), F.col("confirmed_at").cast("timestamp").alias("_at")).withWatermark("_at", delay)
    limit = F.expr(f"interval {int(days)} days")
    same = (F.col("transaction_id") == F.col("_id")) & (F.col("_at") >= F.col("timestamp")) & (F.col("_at") <= F.col("timestamp") + limit)
    joined = left.join(right, same, "leftOuter")
    return joined.select(*scores.columns, F.col("_id").isNotNull().alias("confirmed"))


def drift_writer(features: DataFrame, reference: DataFrame, edges: DataFrame, names: Sequence[str], path: str) -> DataStreamWriter:
    """Stability index of each micro-batch against stored edges and rows of the reference.

    The reference is put into bins once; a micro-batch reads only those.
    """
    expected = materialize(bins_of_rows(reference, edges, names))

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(psi_from_bins(expected, bins_of_rows(batch, edges, names), edges), path, batch_id)

    return features.writeStream.foreachBatch(handle)
