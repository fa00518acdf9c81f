"""Transactions to decisions: features, rules, probability, policy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.functions.features import build_features
from cardwatch.operators.decision import Policy, decide
from cardwatch.operators.rules import Rule, apply_rules, has_hard_block
from cardwatch.sources.config import load_policy, load_rules

Scorer = Callable[[DataFrame], DataFrame]

# Weights of the fixed score that stands in for a trained model where a result must be reproducible in SQL.
FIXED_INTERCEPT = -4.0
FIXED_WEIGHTS = {
    "amount_zscore_30d": 0.15,
    "is_geo_mismatch": 0.8,
    "is_cnp": 0.5,
    "is_high_risk_mcc": 0.9,
    "is_night": 0.6,
    "velocity_score": 0.5,
}


def fixed_score(weights: dict[str, float] | None = None, intercept: float = FIXED_INTERCEPT) -> Scorer:
    """A logistic score with given weights, rounded to six digits before anything is decided on it."""

    def score(df: DataFrame) -> DataFrame:
        total = F.lit(float(intercept))
        for name, weight in (weights or FIXED_WEIGHTS).items():
            total = total + F.lit(float(weight)) * F.col(name)
        probability = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-total)), 6)
        return df.withColumn("fraud_probability", probability)

    return score


def score_features(
    features: DataFrame,
    scorer: Scorer | None = None,
    rules: Sequence[Rule] | None = None,
    policy: Policy | None = None,
) -> DataFrame:
    """Adds rule hits, probability and decision to rows that have their features.

    Rows with a hard block get probability 1.0. The condition wraps the score in one projection, so
    the table is scanned once; a second scan to spare the few blocked rows would cost more.
    """
    hit = apply_rules(features, load_rules() if rules is None else rules)
    scored = (scorer or fixed_score())(hit)
    probability = F.when(has_hard_block(), F.lit(1.0)).otherwise(F.col("fraud_probability"))
    return decide(scored.withColumn("fraud_probability", probability), policy or load_policy())


def score_transactions(df: DataFrame, scorer: Scorer | None = None, rules=None, policy=None) -> DataFrame:
    return score_features(build_features(df), scorer, rules, policy)


def score_skipping_blocked(df: DataFrame, scorer: Scorer, rules=None, policy=None) -> DataFrame:
    """As ``score_transactions`` for a scorer that is dear and not lazy (a Python function): blocked rows
    never reach it, at the price of reading the input twice."""
    hit = apply_rules(build_features(df), load_rules() if rules is None else rules)
    blocked = hit.filter(has_hard_block()).withColumn("fraud_probability", F.lit(1.0))
    rest = scorer(hit.filter(~has_hard_block()))
    both = blocked.unionByName(rest.select(*blocked.columns))
    return decide(both, policy or load_policy())
