"""Profiles, alerts and rule reports on small constructed tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import at_edges, plain
from pyspark.sql import functions as F

from cardwatch.functions.features import build_features
from cardwatch.operators import monitoring, profiling
from cardwatch.operators.decision import output_violations
from cardwatch.operators.evaluation import compare_decisions, matured, recall_by_week
from cardwatch.operators.rules import Rule, apply_rules
from cardwatch.plans.scoring import fixed_score, score_transactions

DAY0 = datetime(2024, 1, 1)

PLAIN = plain()
LARGE, LARGER = (PLAIN | {"transaction_id": f"of {a}", "amount": float(a), "channel": c} for a, c in ((1500, "ECOM"), (2500, "POS")))


@pytest.fixture(scope="module")
def actions(spark):
    """Decline rates 1/10, 2/10, 4/10, 0/10 on four days."""
    rows = []
    for day, declined in enumerate([1, 2, 4, 0]):
        for i in range(10):
            rows.append((DAY0 + timedelta(days=day, hours=i), "DECLINE" if i < declined else "APPROVE", "FR" if i % 2 else "DE"))
    return spark.createDataFrame(rows, "timestamp timestamp, action string, card_country string")


def test_decline_rate_alerts(actions):
    rows = monitoring.decline_rate(actions, low=0.1, high=0.2).orderBy("period").collect()
    assert [r["decline_rate"] for r in rows] == [0.1, 0.2, 0.4, 0.0]
    assert [r["in_target"] for r in rows] == [True, True, False, False]
    assert [r["jumped"] for r in rows] == [False, True, True, False]


def test_country_outliers(actions):
    found = {r["card_country"]: r for r in monitoring.decline_by_country(actions, outlier_z=0.5).collect()}
    assert found["DE"]["z"] == pytest.approx(-found["FR"]["z"]) and found["DE"]["is_outlier"]


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([(0.01,), (0.011,), (0.99,), (1.0,)], "fraud_probability double")
    found = {r["le"]: r["n_rows"] for r in monitoring.probability_histogram(df).collect()}
    assert (found["0.01"], found["0.05"], found["0.9"], found["0.99"], found["+Inf"]) == (1, 2, 2, 3, 4)


def test_rule_reports(table):
    rules = [Rule("BIG", "INFO", "big", {"amount_gte": 1000}), Rule("NEVER", "INFO", "never", {"amount_gte": 10**6})]
    df = build_features(table(PLAIN, LARGE, LARGER))
    hit = apply_rules(df, rules)
    summary = {r["code"]: (r["n_hits"], r["is_silent"]) for r in monitoring.rule_summary(hit, rules).collect()}
    assert summary == {"BIG": (2, False), "NEVER": (0, True)}
    newer = [Rule("BIG", "INFO", "big", {"amount_gte": 2000}), Rule("POS", "INFO", "pos", {"channel_in": ["POS"]})]
    moved = {r["code"]: tuple(r)[1:] for r in monitoring.backtest_rules(df, rules, newer).collect()}
    assert moved == {"BIG": (2, 1, 0, 1), "POS": (0, 2, 2, 0)}


def test_output_violations(table):
    scored = score_transactions(table(PLAIN, at_edges("R008_MULTI_COUNTRY_24H")[0]))
    assert {r["n_violations"] for r in output_violations(scored).collect()} == {0}
    broken = scored.withColumns({"fraud_probability": F.lit(float("nan")), "action": F.lit("MAYBE"), "risk_score": F.lit(1001)})
    found = {r["check"]: r["n_violations"] for r in output_violations(broken).collect()}
    assert (found["probability_in_0_1"], found["known_action"], found["score_in_0_1000"], found["has_id"]) == (2, 2, 2, 0)


def test_attack_patterns(table):
    rows = [
        PLAIN | {"transaction_id": "testing", "channel": "ECOM", "amount": 2.0, "n_tx_last_1h": 6, "distinct_countries_last_24h": 2},
        PLAIN | {"transaction_id": "cash", "channel": "ATM", "amount": 500.0, "merchant_mcc": "6011", "n_tx_last_1h": 3},
        PLAIN | {"transaction_id": "casino", "channel": "ECOM", "amount": 150.0, "merchant_mcc": "7995"},
        PLAIN | {"transaction_id": "taken", "amount": 700.0, "merchant_mcc": "5732", "customer_age_days": 900, "amount_avg_30d": 70.0, "amount_std_30d": 20.0},
        PLAIN | {"transaction_id": "abroad", "channel": "ECOM", "amount": 90.0, "merchant_country": "US", "distinct_countries_last_24h": 2},
        PLAIN,
    ]
    tagged = profiling.tag_attack_pattern(table(*rows).withColumn("is_fraud", F.lit(1)))
    found = {r["transaction_id"]: r["attack_pattern"] for r in tagged.collect()}
    assert found == {
        "testing": "card_testing",
        "cash": "cashout",
        "casino": "high_risk_mcc",
        "taken": "account_takeover",
        "abroad": "geo_anomaly",
        PLAIN["transaction_id"]: None,
    }
    assert {r["share"] for r in profiling.pattern_shares(tagged).collect()} == {0.2}


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.5, 5.0)], "x double, y double, k double")
    found = {(r["a"], r["b"]): r["correlation"] for r in profiling.correlations(df, ["x", "y", "k"]).collect()}
    assert found[("x", "k")] is None and found[("x", "y")] == pytest.approx(0.9979487157886735)


def test_correlations_are_pairwise_complete(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 5)) * [1, 1e-3, 1e4, 1, 1] + [0, 1e6, -3e5, 0, 7]
    base[:, 3] += base[:, 0]
    base[rng.random(base.shape) < 0.2] = np.nan
    base[:, 4] = 2.5
    names = list("abcde")
    rows = [tuple(None if np.isnan(v) and i % 2 else float(v) for v in row) for i, row in enumerate(base)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    found = {(r["a"], r["b"]): r["correlation"] for r in profiling.correlations(df, names).collect()}
    assert list(found) != [] and len(found) == 10
    for i, a in enumerate(names):
        for j in range(i + 1, 5):
            both = ~np.isnan(base[:, i]) & ~np.isnan(base[:, j])
            expected = None if j == 4 else np.corrcoef(base[both, i], base[both, j])[0, 1]
            assert found[a, names[j]] == (None if expected is None else pytest.approx(expected, abs=1e-8))
    assert {r["correlation"] for r in profiling.correlations(df.limit(0), names).collect()} == {None}


def test_recall_drop_and_maturity(spark):
    rows = [(DAY0 + timedelta(days=7 * w, hours=i), 0.9 if i < caught else 0.1, 1) for w, caught in enumerate([10, 9, 9]) for i in range(10)]
    df = spark.createDataFrame(rows, "timestamp timestamp, fraud_probability double, is_fraud int")
    weeks = recall_by_week(df).orderBy("week").collect()
    assert [(r["recall"], r["dropped"]) for r in weeks] == [(1.0, False), (0.9, True), (0.9, False)]
    assert matured(df, F.lit("2024-01-10 00:00:00").cast("timestamp"), 2).count() == 11


def test_compare_decisions(table):
    df = table(PLAIN, LARGE, LARGER)
    other = score_transactions(df, fixed_score(intercept=3.0))
    found = compare_decisions(score_transactions(df), other).collect()
    assert sum(r["n_rows"] for r in found) == 3
    assert ("APPROVE", "DECLINE") in {(r["live_action"], r["shadow_action"]) for r in found}
