"""History windows against brute force, with one card that holds a third of all rows."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cardwatch.functions.numeric import micros
from cardwatch.operators import velocity
from cardwatch.operators.monitoring import bursts

HOUR, DAY = velocity.HOUR, velocity.DAY
START = 1_700_000_000_000_000


def _rows(n=420, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        card = "HOT" if i % 3 == 0 else f"K{rng.randrange(12)}"
        k = START + rng.choice([rng.randrange(40 * DAY), rng.randrange(3 * HOUR), 5 * HOUR, 6 * HOUR, 5 * HOUR + DAY, 5 * HOUR + 30 * DAY])
        rows.append((f"T{i:04d}", card, k, rng.randrange(1, 50000) / 100, rng.choice(["FR", "DE", "US", None])))
    return rows


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "transaction_id string, card_id string, k long, amount double, merchant_country string")
    return df.withColumn("timestamp", F.timestamp_micros("k")).drop("k")


def _expected(rows):
    out = {}
    for tid, card, k, _, _ in rows:
        past = [r for r in rows if r[1] is not None and r[1] == card and r[2] < k]
        month = [r[3] for r in past if r[2] >= k - 30 * DAY]
        out[tid] = (
            sum(r[2] >= k - HOUR for r in past),
            sum(r[2] >= k - DAY for r in past),
            statistics.fmean(month) if month else 0.0,
            statistics.stdev(month) if len(month) > 1 else 0.0,
            len({r[4] for r in past if r[2] >= k - DAY and r[4] is not None}),
        )
    return out


def test_windows_equal_brute_force(spark):
    rows = [*_rows(), ("NOCARD", None, START, 5.0, "FR"), ("NOCARD2", None, START + 1, 5.0, "FR")]
    df = _frame(spark, rows).repartition(6)
    found = velocity.add_velocity(df).collect()
    expected = _expected(rows)
    assert len(found) == len(rows)
    for row in found:
        n1, n24, mean, std, countries = expected[row["transaction_id"]]
        assert (row["n_tx_last_1h"], row["n_tx_last_24h"], row["distinct_countries_last_24h"]) == (n1, n24, countries)
        assert row["amount_avg_30d"] == pytest.approx(mean, abs=1e-9)
        assert row["amount_std_30d"] == pytest.approx(std, abs=1e-7)


def test_results_do_not_depend_on_order_or_partitions(spark):
    df = _frame(spark, _rows(seed=2))
    one = sorted(map(tuple, velocity.add_velocity(df.coalesce(1)).collect()))
    assert sorted(map(tuple, velocity.add_velocity(df.orderBy(F.desc("amount")).repartition(5)).collect())) == one


def test_amounts_that_cannot_be_kept_end_the_job(spark):
    rows = [("T1", "K", START, float("nan"), "FR"), ("T2", "K", START + HOUR, None, "FR"), ("T3", "K", START + 2 * HOUR, 7.5, None)]
    found = {r["transaction_id"]: r for r in velocity.add_velocity(_frame(spark, rows)).collect()}
    assert found["T3"]["n_tx_last_24h"] == 2 and found["T3"]["amount_avg_30d"] == 0.0
    for amount in (2e12, float("inf"), -1e12):
        with pytest.raises(Exception, match="amount out of range"):
            velocity.add_velocity(_frame(spark, [("T1", "K", START, amount, "FR")])).collect()


def test_rows_without_a_time_and_empty_tables(spark):
    rows = [("T1", "K", None, 5.0, "FR"), ("T2", "K", START, 5.0, "FR"), ("T2", "K", START, 5.0, "FR"), ("T3", "K", START + 1, 5.0, "FR")]
    found = sorted((r["transaction_id"], r["n_tx_last_1h"]) for r in velocity.add_velocity(_frame(spark, rows)).collect())
    assert found == [("T1", 0), ("T2", 0), ("T2", 0), ("T3", 2)]
    assert velocity.add_velocity(_frame(spark, rows).limit(0)).collect() == []


def test_equal_amounts_have_no_deviation(spark):
    rows = [(f"T{i}", "K", START + i * HOUR, 19.99, "FR") for i in range(20)]
    found = velocity.add_velocity(_frame(spark, rows)).collect()
    assert {r["amount_std_30d"] for r in found} == {0.0}


def test_asof_equals_brute_force(spark):
    rng = random.Random(6)
    left = [(f"T{i}", "HOT" if i % 3 == 0 else f"K{i % 5}", START + rng.randrange(20) * HOUR // 4) for i in range(300)]
    right = [("HOT" if i % 2 else f"K{i % 4}", START + i * HOUR // 7, i) for i in range(60)]
    lf = spark.createDataFrame(left, "transaction_id string, card_id string, k long")
    rf = spark.createDataFrame(right, "card_id string, valid_from long, v int")
    found = velocity.asof(lf, rf, "card_id", F.col("k"), "valid_from", ["v"]).collect()
    assert len(found) == len(left)
    for row in found:
        past = [r for r in right if r[0] == row["card_id"] and r[1] <= row["k"]]
        assert row["v"] == (max(past, key=lambda r: r[1])[2] if past else None)


def test_bursts(spark):
    minutes = [0, 1, 3, 13, 22.5, 40]
    rows = [(f"T{i}", "K", START + int(m * 60_000_000), 10.0, "FR") for i, m in enumerate(minutes)]
    found = bursts(_frame(spark, rows)).orderBy("started_micros").collect()
    assert [(r["n_tx"], r["total_amount"]) for r in found] == [(3, 30.0), (2, 20.0), (1, 10.0)]


def test_ages_of_unknown_and_later_keys_are_zero(spark):
    rows = [("T1", "A", START, 1.0, "FR"), ("T2", "A", START + 3 * DAY, 1.0, "FR"), ("T3", "NEW", START, 1.0, "FR")]
    df = _frame(spark, rows)
    dimension = velocity.first_seen(df.filter("card_id = 'A'"), "card_id")
    aged = velocity.add_age(df, dimension, "card_id", "card_age_days").collect()
    assert {r["transaction_id"]: r["card_age_days"] for r in aged} == {"T1": 0, "T2": 3, "T3": 0}


def test_micros_of_zone_less_stamps(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00.000001' AS t")
    assert df.select(micros(F.col("t"))).first()[0] == 1_704_067_200_000_001


def test_deviation_is_exact_for_many_large_amounts(spark):
    rows = spark.range(100_000).selectExpr("id % 2 AS parity", "decimal(999990) + (id % 2) * 0.01 AS amount")
    sums = rows.selectExpr("cast(amount AS decimal(18,6)) AS a").agg(
        F.count("a").alias("n"), F.sum("a").alias("s"), F.sum((F.col("a") * F.col("a")).cast("decimal(38,12)")).alias("q")
    )
    got = sums.select(velocity._deviation(F.col("n"), F.col("s"), F.col("q"))).first()[0]
    assert abs(got - 0.005 * (100_000 / 99_999) ** 0.5) < 1e-12


def test_clock_features_do_not_follow_the_session_zone(spark):
    from cardwatch.functions.numeric import micros, utc_hour, utc_stamp, utc_weekday

    df = spark.sql("SELECT TIMESTAMP_NTZ'2025-06-15 15:06:00' AS wall, '2025-06-15 15:06:00' AS bare, '2025-06-15 17:06:00+02:00' AS zoned")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            stamps = [F.col("wall"), utc_stamp(F.col("bare")), utc_stamp(F.col("zoned"))]
            row = df.select(*[f(x) for x in stamps for f in (utc_hour, utc_weekday, micros)]).first()
            assert set(row[::3]) == {15} and set(row[1::3]) == {6} and len(set(row[2::3])) == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_rows_without_a_time_are_in_the_newest_part(spark):
    from cardwatch.operators.splits import plan_split

    rows = [(f"t{i}", None if i < 2 else i) for i in range(10)]
    df = spark.createDataFrame(rows, "transaction_id string, s int").selectExpr("transaction_id", "timestamp_seconds(s) AS timestamp")
    split = plan_split(df, 0.2)
    assert df.filter(split.is_train()).count() == 8 and df.filter(split.is_test()).count() == 2
