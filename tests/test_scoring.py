"""Features, rules and decisions on single rows."""

from __future__ import annotations

import random

import pytest
from conftest import SHIPPED, at_edges, plain
from pyspark.sql import functions as F

from cardwatch.functions.features import FEATURE_COLUMNS, build_features, select_feature_matrix
from cardwatch.functions.numeric import round_exact, score_points, three_decimals
from cardwatch.operators.decision import Policy, decide
from cardwatch.operators.rules import (
    Rule,
    apply_rules,
    at_least,
    check_rules,
    has_hard_block,
    register_predicate,
)
from cardwatch.plans.scoring import fixed_score, score_skipping_blocked, score_transactions
from cardwatch.sources.config import load_policy, load_rules, rules_from_dicts
from cardwatch.sources.schemas import RULE_HIT

PLAIN = plain()
BLOCKED = [code for code, rule in SHIPPED.items() if rule.severity == "HARD_BLOCK"]


def _by_id(df):
    return {row["transaction_id"]: row for row in df.collect()}


def test_feature_columns_are_unique_and_ordered(table):
    assert len(FEATURE_COLUMNS) == len(set(FEATURE_COLUMNS)) == 21
    matrix = select_feature_matrix(build_features(table(PLAIN)))
    assert matrix.columns == FEATURE_COLUMNS
    assert {kind for _, kind in matrix.dtypes} == {"double"}


def test_missing_feature_is_an_error(table):
    with pytest.raises(ValueError, match="hour"):
        select_feature_matrix(build_features(table(PLAIN)).drop("hour"))


@pytest.mark.parametrize("hour", range(0, 24, 3))
@pytest.mark.parametrize("day", [6, 8, 11, 12])
def test_clock_flags_are_those_of_the_calendar(table, hour, day):
    stamp = PLAIN["timestamp"].replace(day=day, hour=hour, minute=59)
    row = build_features(table(PLAIN | {"timestamp": stamp})).first()
    assert (row["hour"], row["is_night"], row["is_weekend"]) == (hour, int(hour < 6), int(stamp.isoweekday() > 5))


def test_features_follow_their_definitions(table):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        rows.append(
            PLAIN
            | {
                "transaction_id": f"row {i}",
                "amount": rng.choice([0.5, 7.0, 4000.0, rng.random() * 900]),
                "amount_avg_30d": rng.choice([0.0, 1.0, 80.0]),
                "amount_std_30d": rng.choice([0.0, 0.25, 40.0]),
                "n_tx_last_1h": rng.randrange(9),
                "n_tx_last_24h": rng.randrange(30),
                "merchant_country": rng.choice(["AA", "aa", "BB"]),
                "merchant_mcc": rng.choice(["0000", "7995", "5967"]),
                "channel": rng.choice(["POS", "ECOM", "ATM", "MOTO"]),
            }
        )
    found = _by_id(build_features(table(*rows)))
    for given in rows:
        row, mean, spread = found[given["transaction_id"]], given["amount_avg_30d"], given["amount_std_30d"]
        assert row["amount_ratio_avg_30d"] == (min(given["amount"] / mean, 100) if mean else 1)
        assert row["amount_zscore_30d"] == (max(-20, min(20, (given["amount"] - mean) / spread)) if spread else 0)
        assert row["velocity_score"] == (given["n_tx_last_1h"] * 3 + given["n_tx_last_24h"]) / 10
        flags = ("is_burst_1h", "is_geo_mismatch", "is_high_risk_mcc", "is_ecom", "is_atm")
        tests = (given["n_tx_last_1h"] > 4, given["merchant_country"] == "BB", given["merchant_mcc"] != "0000")
        assert [row[f] for f in flags] == [int(t) for t in (*tests, given["channel"] == "ECOM", given["channel"] == "ATM")]


def test_nan_history_gives_neutral_values(table):
    row = build_features(table(PLAIN | {"amount_avg_30d": float("nan"), "amount_std_30d": float("nan")})).first()
    assert row["amount_ratio_avg_30d"] == 1.0
    assert row["amount_zscore_30d"] == 0.0


def test_text_timestamps_move_to_utc(table):
    df = table(PLAIN).withColumn("timestamp", F.lit("2025-06-15T01:30:00+02:00"))
    row = build_features(df).first()
    assert (row["hour"], row["is_night"], row["is_weekend"]) == (23, 0, 1)


def _codes(df):
    hit = apply_rules(build_features(df), load_rules())
    return {row["transaction_id"]: [h["code"][:4] for h in row["rule_hits"]] for row in hit.collect()}


@pytest.mark.parametrize("code", SHIPPED)
def test_each_rule_holds_at_its_bounds_and_not_beyond_one_of_them(table, code):
    met, missed = at_edges(code)
    codes = _codes(table(met, *missed, PLAIN))
    assert code[:4] in codes[code] and codes[PLAIN["transaction_id"]] == []
    assert all(code[:4] not in codes[row["transaction_id"]] for row in missed)


def test_hour_ranges_include_both_ends_and_do_not_pass_midnight(table):
    rules = [Rule("IN", "INFO", "", {"hour_between": [7, 9]}), Rule("OVER", "INFO", "", {"hour_between": [20, 3]})]
    rows = [PLAIN | {"transaction_id": str(h), "timestamp": PLAIN["timestamp"].replace(hour=h)} for h in range(24)]
    found = _by_id(apply_rules(build_features(table(*rows)), rules))
    assert {h: [x["code"] for x in found[str(h)]["rule_hits"]] for h in range(24)} == {h: ["IN"] if 7 <= h <= 9 else [] for h in range(24)}


def test_rule_edges(spark, table):
    rules = rules_from_dicts(
        [
            {"code": "ALWAYS", "severity": "INFO", "description": "no condition"},
            {"code": "SAME", "severity": "SUSPECT", "description": "same country", "when": {"geo_mismatch": False}},
            {"code": "MCC", "severity": "SUSPECT", "description": "number in a list", "when": {"mcc_in": ["0000", 12]}},
            {"code": "NAN", "severity": "SUSPECT", "description": "amount", "when": {"amount_gte": 5}},
        ]
    )
    nan = PLAIN | {"amount": float("nan")}
    row = apply_rules(build_features(table(nan)), rules).first()
    assert [h["code"] for h in row["rule_hits"]] == ["ALWAYS", "SAME", "MCC"]
    # A column the table lacks reads as zero, a null never fires.
    bare = spark.createDataFrame([("x", None)], "transaction_id string, amount double")
    young = Rule("YOUNG", "INFO", "age", {"card_age_days_lt": 7})
    row = apply_rules(bare, [young, rules[3]]).first()
    assert [h["code"] for h in row["rule_hits"]] == ["YOUNG"]
    assert apply_rules(bare, []).first()["rule_hits"] == []


def test_bad_rules_fail_when_loaded():
    with pytest.raises(ValueError, match="unknown predicates"):
        check_rules([Rule("X", "INFO", "", {"amout_gte": 1})])
    with pytest.raises(ValueError, match="severity"):
        check_rules([Rule("X", "LOUD", "", {})])


def test_own_predicate(table):
    register_predicate("customer_age_gte", at_least("customer_age_days"))
    row = apply_rules(table(PLAIN), [Rule("OLD", "INFO", "old customer", {"customer_age_gte": 100})]).first()
    assert [h["code"] for h in row["rule_hits"]] == ["OLD"]


def _plain_decision(p, severities, policy):
    """Action, score, adjusted probability and how many reasons, by the words of the policy."""
    if "HARD_BLOCK" in severities:
        return "DECLINE", 1000, 1.0, severities.count("HARD_BLOCK")
    suspects = severities.count("SUSPECT")
    lifted = min(1.0, p + min(policy.max_uplift, policy.uplift_per_suspect * suspects))
    action = "APPROVE"
    if lifted >= policy.threshold_decline:
        action = "DECLINE"
    elif lifted >= policy.threshold_review:
        action = "REVIEW"
    return action, round(lifted * 1000), lifted, suspects + 1


def test_decisions_over_a_grid(spark):
    rng = random.Random(9)
    policies = [Policy(), Policy(0.2, 0.9, 0.3, 0.45), Policy(0.5, 0.5, 0.0, 0.0), Policy(0.0, 1.0, 1.0, 1.0)]
    for policy in policies:
        edges = [policy.threshold_review, policy.threshold_decline, 1 - policy.max_uplift]
        values = sorted({min(1.0, max(0.0, e + d)) for e in edges for d in (-1e-9, 0.0, 1e-9)} | {i / 37 for i in range(38)})
        rows = []
        for i, p in enumerate(values * 3):
            hits = [(f"C{k}", rng.choice(["SUSPECT", "SUSPECT", "INFO", "HARD_BLOCK" if i % 5 == 0 else "INFO"]), "") for k in range(rng.randrange(6))]
            rows.append((i, p, hits))
        df = spark.createDataFrame(rows, f"i int, fraud_probability double, rule_hits array<{RULE_HIT.simpleString()}>")
        found = {r["i"]: r for r in decide(df, policy).collect()}
        for i, p, hits in rows:
            action, score, lifted, n_reasons = _plain_decision(p, [h[1] for h in hits], policy)
            row = found[i]
            assert (row["action"], row["risk_score"], row["adjusted_probability"], len(row["reasons"])) == (action, score, lifted, n_reasons)
            wanted = "HARD_BLOCK" if score == 1000 and any(h[1] == "HARD_BLOCK" for h in hits) else "SUSPECT"
            named = [f"rule:{c}" for c, severity, _ in hits if severity == wanted]
            assert row["reasons"][: len(named)] == named


def test_rounding_is_that_of_the_exact_value(spark):
    rng = random.Random(1)
    values = [0.0, 1.0, 0.4125, 0.0625, 0.4625, 0.0005, 0.0015, 0.9995, 0.99949999, 0.012345]
    values += [rng.random() for _ in range(3000)] + [rng.randrange(10001) / 10000 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    p = F.col("p")
    rows = df.select(
        "p",
        three_decimals(p).alias("text"),
        round_exact(p, 4).alias("four"),
        round_exact(p, 6).alias("six"),
        score_points(p).alias("points"),
    ).collect()
    for row in rows:
        assert row["text"] == f"{row['p']:.3f}"
        assert row["four"] == round(row["p"], 4)
        assert row["six"] == round(row["p"], 6)
        assert row["points"] == round(row["p"] * 1000)


def test_policy_from_config():
    assert load_policy() == Policy(0.30, 0.70, 0.05, 0.20)


def _mixed_rows():
    return [PLAIN, *[at_edges(code)[0] for code in SHIPPED]]


def test_blocked_rows_are_declined_whatever_their_score(table):
    rows = _by_id(score_transactions(table(*_mixed_rows())))
    for code in BLOCKED:
        row = rows[code]
        assert (row["action"], row["risk_score"], row["fraud_probability"]) == ("DECLINE", 1000, 1.0)
        assert f"rule:{code}" in row["reasons"] and all(r[5:] in BLOCKED for r in row["reasons"])
    assert rows[PLAIN["transaction_id"]]["action"] == "APPROVE"


def test_skipping_blocked_rows_changes_nothing(table):
    df = table(*_mixed_rows())
    one, two = _by_id(score_transactions(df)), _by_id(score_skipping_blocked(df, fixed_score()))
    assert {k: (r["action"], r["risk_score"], r["reasons"]) for k, r in one.items()} == {
        k: (r["action"], r["risk_score"], r["reasons"]) for k, r in two.items()
    }
    seen = []

    def watch(df):
        seen.append(df.filter(has_hard_block()).count())
        return fixed_score()(df)

    score_skipping_blocked(df, watch)
    assert seen == [0]


def test_scoring_needs_no_shuffle(table):
    plan = score_transactions(table(PLAIN))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
