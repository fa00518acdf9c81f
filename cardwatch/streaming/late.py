"""Late rows: set aside before they are lost, and counted where the engine turns them away."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from cardwatch.functions.numeric import micros
from cardwatch.streaming.jobs import write_batch

MARK = "newest_micros long, watermark_micros long, n_rows long, n_late long"
DROPPED = "query string, batch_id long, n_dropped long"


def late_writer(df: DataFrame, path: str, delay: timedelta, timestamp: str = "timestamp") -> DataStreamWriter:
    """Splits a stream into ``path``/on_time and ``path``/late, one folder per micro-batch.

    A row is late if it is more than ``delay`` older than the newest row of the batches before its own. Each batch leaves one
    line in ``path``/marks: the newest time so far, the watermark it was judged by, its rows and its late rows. A batch
    reads the line of the batch before it only, and a batch that is run again replaces its own. Rows without a time
    are on time.
    """
    late_by = delay // timedelta(microseconds=1)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = None
        if batch_id:
            before = spark.read.schema(MARK).parquet(f"{path}/marks/batch_id={batch_id - 1}").first()["newest_micros"]
        watermark = None if before is None else before - late_by
        known = F.lit(watermark).cast("long")
        late = F.coalesce(micros(F.col(timestamp)) < known, F.lit(False))
        rows = batch.persist()
        try:
            write_batch(rows.filter(~late), f"{path}/on_time", batch_id)
            write_batch(rows.filter(late), f"{path}/late", batch_id)
            newest = F.greatest(F.max(micros(F.col(timestamp))), F.lit(before).cast("long"))
            mark = rows.agg(newest.alias("newest_micros"), known.alias("watermark_micros"), F.count("*").alias("n_rows"), F.count_if(late).alias("n_late"))
            write_batch(mark, f"{path}/marks", batch_id)
        finally:
            rows.unpersist()

    return df.writeStream.foreachBatch(handle)


def marks(spark: SparkSession, path: str) -> DataFrame:
    """One line per micro-batch of ``late_writer``."""
    return spark.read.schema(MARK + ", batch_id long").option("basePath", f"{path}/marks").parquet(f"{path}/marks")


class DroppedRows(StreamingQueryListener):
    """Appends to a table how many rows of each micro-batch the watermark turned away, as progress is reported.

    Reports that a query keeps are few; the table has all. Stateful operators count what reaches them, which
    for aggregates is partial groups, so the number tells that rows were lost, not always how many.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.ended = spark, path, threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.ended.clear()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        dropped = sum(int(op.numRowsDroppedByWatermark) for op in progress.stateOperators)
        if dropped:
            line = self.spark.createDataFrame([(str(progress.id), progress.batchId, dropped)], DROPPED)
            line.coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()


@contextmanager
def counting_dropped(spark: SparkSession, path: str, wait: float = 60.0) -> Iterator[None]:
    """Counts the dropped rows of the one query that runs and ends inside the block."""
    listener = DroppedRows(spark, path)
    spark.streams.addListener(listener)
    try:
        yield
        listener.ended.wait(wait)
    finally:
        spark.streams.removeListener(listener)


def dropped_rows(spark: SparkSession, path: str) -> DataFrame:
    """(query, batch_id, n_dropped); a batch that was run again counts once."""
    lines = spark.read.schema(DROPPED).parquet(path)
    return lines.groupBy("query", "batch_id").agg(F.max("n_dropped").alias("n_dropped"))
