"""Splits by time that are exact to the row and cost no sort."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.functions.numeric import micros
from cardwatch.operators.ordering import Cut, find_cut


def _at(number: int, kind: T.DataType) -> Column:
    """A literal of the column's own type, so that comparisons with the column reach the scan."""
    return F.timestamp_micros(F.lit(number)).cast(kind)


def stamps_between(kind: T.DataType, timestamp: str = "timestamp") -> Callable[[int, int], Column]:
    return lambda low, high: F.col(timestamp).between(_at(low, kind), _at(high, kind))


def time_cut(df: DataFrame, rank: int, timestamp: str = "timestamp", tie: str = "transaction_id") -> Cut:
    """Cut after the oldest ``rank`` rows; equal times are ordered by ``tie``."""
    interval = stamps_between(df.schema[timestamp].dataType, timestamp)
    return find_cut(df, micros(F.col(timestamp)), F.col(tie), rank, interval)


@dataclass(frozen=True)
class TimeSplit:
    """Oldest rows fit, then validation, newest test. Rows without a time count as newest."""

    kind: T.DataType
    test: Cut
    validation: Cut | None = None
    timestamp: str = "timestamp"
    tie: str = "transaction_id"

    def _before(self, cut: Cut) -> Column:
        if cut.number is None:
            return F.lit(False)
        stamp, edge = F.col(self.timestamp), _at(cut.number, self.kind)
        return (stamp < edge) | ((stamp == edge) & (F.col(self.tie) <= cut.text))

    def is_test(self) -> Column:
        """Filter for the test part in a form that a parquet scan understands."""
        if self.test.number is None:
            return F.lit(True)
        stamp, edge = F.col(self.timestamp), _at(self.test.number, self.kind)
        tied = (stamp == edge) & (F.col(self.tie).isNull() | (F.col(self.tie) > self.test.text))
        return stamp.isNull() | (stamp > edge) | tied

    def is_train(self) -> Column:
        return self._before(self.test)

    def column(self) -> Column:
        in_train = self._before(self.test)
        if self.validation is None:
            return F.when(in_train, F.lit("train")).otherwise(F.lit("test"))
        return F.when(self._before(self.validation), F.lit("fit")).when(in_train, F.lit("val")).otherwise(F.lit("test"))


def plan_split(df: DataFrame, test_share: float = 0.2, validation_share: float | None = None) -> TimeSplit:
    """``validation_share`` is taken from the end of the training part."""
    n_train = int(df.count() * (1 - test_share))
    kind, test = df.schema["timestamp"].dataType, time_cut(df, n_train)
    if validation_share is None:
        return TimeSplit(kind, test)
    return TimeSplit(kind, test, time_cut(df, int(n_train * (1 - validation_share))))


def add_split(df: DataFrame, test_share: float = 0.2, validation_share: float | None = None) -> DataFrame:
    return df.withColumn("split", plan_split(df, test_share, validation_share).column())


def split_summary(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Rows, frauds and fraud rate per split, with a line for all."""
    grouped = df.rollup("split").agg(
        F.count("*").alias("n_rows"), F.sum(F.col(label).cast("long")).alias("n_fraud"), F.avg(label).alias("fraud_rate")
    )
    return grouped.withColumn("split", F.coalesce("split", F.lit("all")))
