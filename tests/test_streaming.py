"""Streams in several micro-batches against the same work in batch."""

from __future__ import annotations

from datetime import timedelta

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from cardwatch.operators import drift, velocity
from cardwatch.operators.monitoring import bursts
from cardwatch.plans.scoring import score_transactions
from cardwatch.session import materialize, scratch_path, settings
from cardwatch.sources import events_view
from cardwatch.sources.tables import safe_output
from cardwatch.streaming import jobs, late, velocity_state


@pytest.fixture(scope="module")
def txn(spark):
    return events_view.transactions(spark, SMALL).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


@pytest.fixture(scope="module")
def folder(spark, txn):
    """The table as four files in order of time."""
    path = scratch_path(spark, "in-order")
    for i in range(4):
        txn.filter(F.floor(F.substring("transaction_id", 2, 9).cast("int") / 250) == i).coalesce(1).write.mode("append").parquet(path)
    return path


def _stream(spark, txn, folder):
    return spark.readStream.schema(txn.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_scores_equal_batch(spark, txn, folder):
    path = scratch_path(spark, "stream")
    scored = jobs.score_stream(_stream(spark, txn, folder))
    writer = scored.writeStream.format("parquet").option("path", f"{path}/out")
    jobs.run_available(writer, f"{path}/check")
    jobs.run_available(writer, f"{path}/check")  # nothing new: nothing twice
    assert _rows(spark.read.schema(scored.schema).parquet(f"{path}/out")) == _rows(safe_output(score_transactions(txn)))


@pytest.fixture(scope="module")
def busy(spark, txn):
    """One card with a third of the rows, some rows without a card, ten files in order of time."""
    number = F.substring("transaction_id", 2, 9).cast("int")
    card = F.when(number % 3 == 0, F.lit("HEAVY")).when(number % 50 == 1, F.lit(None)).otherwise(F.col("card_id"))
    rows = materialize(txn.withColumn("card_id", card))
    path = scratch_path(spark, "busy")
    for i in range(10):
        rows.filter(F.floor(number / 100) == i).coalesce(1).write.mode("append").parquet(path)
    return rows, path


def test_velocity_from_state_equals_batch(spark, busy):
    rows, folder = busy
    path = scratch_path(spark, "stream")
    stream = _stream(spark, rows, folder)
    with settings(spark, velocity_state.STATE_SETTINGS):
        query = jobs.run_available(velocity_state.velocity_writer(stream, f"{path}/out"), f"{path}/check")
    assert len({p["batchId"] for p in query.recentProgress}) >= 10
    expected = velocity.add_velocity(rows)
    found = jobs.read_batches(spark, f"{path}/out", expected.schema)
    names = ["transaction_id", "amount", "timestamp", "card_id", *velocity.VELOCITY_COLUMNS]
    assert _rows(found.select(names)) == _rows(expected.select(names))


def test_velocity_state_is_dropped_when_no_window_reaches_it(spark, txn):
    """Two rows far apart: the state of the first is gone when the third comes, that of the second is not."""
    path = scratch_path(spark, "old")
    base = materialize(txn.limit(1).withColumn("card_id", F.lit("K")))
    for day in (0, 100, 101, 102):
        base.withColumn("timestamp", F.col("timestamp") + F.expr(f"interval {day} days")).coalesce(1).write.mode("append").parquet(path)
    with settings(spark, velocity_state.STATE_SETTINGS):
        stream = _stream(spark, base, path)
        query = jobs.run_available(velocity_state.velocity_writer(stream, f"{path}-out"), f"{path}-check")
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) > rows[-1] or rows[-1] <= 2 * 2 * 3
    schema = velocity.add_velocity(base).schema
    found = jobs.read_batches(spark, f"{path}-out", schema).orderBy("timestamp").collect()
    assert [r["n_tx_last_24h"] for r in found] == [0, 0, 1, 1]
    assert [r["amount_avg_30d"] > 0 for r in found] == [False, False, True, True]


@pytest.mark.parametrize("width", velocity_state.WINDOWS)
def test_pieces_make_up_the_window(spark, width):
    times = [1_700_000_000_000_000 + i * 77_777_777_777_7 for i in range(200)] + [1_699_920_000_000_000, 1_699_920_000_000_001]
    df = spark.createDataFrame([(t,) for t in times], "t long")
    found = df.select("t", F.array_compact(F.array(*velocity_state.pieces(F.col("t") - width, F.col("t")))).alias("pieces")).collect()
    for row in found:
        pieces = sorted((p["low"], p["high"], p["level"], p["bucket"]) for p in row["pieces"])
        assert pieces[0][0] == row["t"] - width and pieces[-1][1] == row["t"] and len(pieces) <= 4
        assert all(a[1] == b[0] for a, b in zip(pieces, pieces[1:], strict=False))
        for low, high, level, bucket in pieces:
            length, child = velocity_state.LEVELS[level]
            assert low // length == (high - 1) // length == bucket
            assert level == 0 or (low % child == 0 and high % child == 0)


def test_payloads_split_into_scored_and_quarantine(spark, txn, folder):
    path = scratch_path(spark, "stream")
    payloads = events_view.payloads_from_transactions(_stream(spark, txn, folder))
    jobs.run_available(jobs.payload_writer(payloads, f"{path}/good", f"{path}/bad"), f"{path}/check")
    good = jobs.read_batches(spark, f"{path}/good", "transaction_id string, batch_id long")
    bad = jobs.read_batches(spark, f"{path}/bad", "event_id long, value string, batch_id long")
    assert good.count() + bad.count() == 1000 and bad.count() == 117
    assert good.select("batch_id").distinct().count() == 4


def test_duplicates_across_batches(spark, txn, folder):
    path = scratch_path(spark, "stream")
    twice = _stream(spark, txn, folder).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    writer = jobs.first_of_each(twice).select("transaction_id").writeStream.format("parquet").option("path", f"{path}/out")
    jobs.run_available(writer, f"{path}/check")
    found = spark.read.parquet(f"{path}/out")
    assert found.count() == found.distinct().count() == 1000


def test_windows_update_across_batches(spark, txn, folder):
    path = scratch_path(spark, "stream")
    counts = jobs.windowed_decisions(score_transactions(_stream(spark, txn, folder)), "40 days", "7 days")
    jobs.run_available(jobs.update_writer(counts, f"{path}/out"), f"{path}/check")
    found = jobs.latest_per_key(jobs.read_batches(spark, f"{path}/out", counts.schema.add("batch_id", "long")), ["window_micros", "action"])
    batch = score_transactions(txn).groupBy(F.window("timestamp", "7 days").alias("w"), "action").agg(F.count("*").alias("n"))
    assert _rows(found) == _rows(batch.select(F.unix_micros("w.start"), "action", "n"))


def test_closed_sessions_equal_bursts(spark, txn, folder):
    path = scratch_path(spark, "stream")
    sessions = jobs.card_sessions(_stream(spark, txn, folder), delay="1 hour", gap="3 hours")
    jobs.run_available(sessions.writeStream.format("parquet").option("path", f"{path}/out"), f"{path}/check")
    found = set(_rows(spark.read.schema(sessions.schema).parquet(f"{path}/out")))
    batch = bursts(txn, gap_minutes=180).select("card_id", "started_micros", "n_tx", "total_amount")
    expected = set(_rows(batch))
    assert found <= expected and len(expected - found) <= txn.select("card_id").distinct().count()


def test_late_rows_are_counted(spark, txn):
    path = scratch_path(spark, "late")
    # Lateness is judged by the watermark that the batch before the last one left behind.
    bounds = [("T000000750", "T999999999"), ("T000000500", "T000000750"), ("T000000000", "T000000005")]
    for low, high in bounds:
        part = txn.filter(F.col("transaction_id").between(low, high))
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(txn.schema).option("maxFilesPerTrigger", 1).parquet(path)
    counts = jobs.windowed_decisions(score_transactions(stream), "1 hour", "1 hour")
    with late.counting_dropped(spark, f"{path}-dropped"):
        jobs.run_available(jobs.update_writer(counts, f"{path}-out"), f"{path}-check")
    found = late.dropped_rows(spark, f"{path}-dropped").collect()
    assert found and all(r["n_dropped"] > 0 and r["batch_id"] >= 2 for r in found)


def test_late_rows_are_set_aside(spark):
    path = scratch_path(spark, "late")
    schema = "transaction_id string, timestamp timestamp"
    hour = 3_600_000_000
    batches = [[("a", 100 * hour), ("b", 90 * hour)], [("c", 99 * hour), ("d", 99 * hour - 1), ("n", None)], [], [("e", 98 * hour), ("f", 200 * hour)], [("g", 101 * hour)]]
    for rows in batches:
        df = spark.createDataFrame(rows or [("x", 0)], "transaction_id string, k long").filter("transaction_id <> 'x'")
        df.select("transaction_id", F.timestamp_micros("k").alias("timestamp")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    for _ in range(2):  # the second run finds nothing new
        jobs.run_available(late.late_writer(stream, f"{path}-out", timedelta(hours=1)), f"{path}-check")
    sides = [jobs.read_batches(spark, f"{path}-out/{side}", schema) for side in ("on_time", "late")]
    assert [sorted(r["transaction_id"] for r in side.collect()) for side in sides] == [["a", "b", "c", "f", "n"], ["d", "e", "g"]]
    found = [(r["n_rows"], r["n_late"], r["watermark_micros"]) for r in late.marks(spark, f"{path}-out").orderBy("batch_id").collect() if r["n_rows"]]
    assert found == [(2, 0, None), (3, 1, 99 * hour), (2, 1, 99 * hour), (1, 1, 199 * hour)]


def test_session_settings_are_put_back(spark):
    name = next(iter(jobs.SESSION_SETTINGS))
    before = spark.conf.get(name)
    with pytest.raises(RuntimeError), settings(spark, jobs.SESSION_SETTINGS | {"spark.own": "1"}):
        assert spark.conf.get(name) == "true" and spark.conf.get("spark.own") == "1"
        raise RuntimeError
    assert spark.conf.get(name) == before and spark.conf.get("spark.own", None) is None


def test_drift_per_batch(spark, txn, folder):
    from cardwatch.functions.features import build_features

    path = scratch_path(spark, "stream")
    names = ["amount", "velocity_score"]
    features = build_features(txn)
    edges = materialize(drift.inner_edges(features, names))
    live = build_features(_stream(spark, txn, folder))
    jobs.run_available(jobs.drift_writer(live, features, edges, names, f"{path}/out"), f"{path}/check")
    found = jobs.read_batches(spark, f"{path}/out", "feature string, psi double, batch_id long")
    first = {r["feature"]: r["psi"] for r in found.filter("batch_id = 0").collect()}
    part = features.filter("transaction_id < 'T000000250'")
    assert first == {r["feature"]: pytest.approx(r["psi"]) for r in drift.psi(features, part, names).collect()}


def test_few_calls_to_the_state_answer_many_cards(spark, txn, folder):
    """Ten minutes of many cards are one interval of state, whatever the shards; a card without rows there costs no call."""
    assert velocity_state.shards_for(0, 0) == 1 and velocity_state.shards_for(10**9, 600_000_000) == 10**9 // 32
    expected = _rows(velocity.add_velocity(txn).select("transaction_id", *velocity.VELOCITY_COLUMNS))
    lines = velocity_state.requests(txn, shards=2)
    assert lines.filter("level = 0").select("part").distinct().count() == 2
    assert lines.groupBy("row").count().agg(F.max("count")).first()[0] <= 6
    path = scratch_path(spark, "stream")
    with settings(spark, velocity_state.STATE_SETTINGS):
        writer = velocity_state.velocity_writer(_stream(spark, txn, folder), f"{path}/out", shards=2)
        jobs.run_available(writer, f"{path}/check")
    found = jobs.read_batches(spark, f"{path}/out", velocity.add_velocity(txn).schema)
    assert _rows(found.select("transaction_id", *velocity.VELOCITY_COLUMNS)) == expected
