"""Rules and score combined into a decision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.functions.numeric import round_exact, score_points, three_decimals
from cardwatch.sources.schemas import ACTIONS, SEVERITIES


@dataclass(frozen=True)
class Policy:
    threshold_review: float = 0.30
    threshold_decline: float = 0.70
    uplift_per_suspect: float = 0.05
    max_uplift: float = 0.20


def _hits_of(severity: str, hits: str) -> Column:
    return F.filter(hits, lambda hit: hit["severity"] == severity)


def _reason_codes(hits: Column) -> Column:
    return F.transform(hits, lambda hit: F.concat(F.lit("rule:"), hit["code"]))


def decide(df: DataFrame, policy: Policy | None = None, probability: str = "fraud_probability", hits: str = "rule_hits") -> DataFrame:
    """Adds adjusted_probability, action, risk_score and reasons.

    A hard block declines at 1000 points and names only the blocking rules. Otherwise each suspect
    hit lifts the probability up to a cap, and two thresholds choose the action.
    """
    policy = policy or Policy()
    df = df.withColumns({"_hard": _hits_of("HARD_BLOCK", hits), "_suspects": _hits_of("SUSPECT", hits)})
    blocked, suspects = F.size("_hard") > 0, F.col("_suspects")
    uplift = F.least(F.lit(float(policy.max_uplift)), F.lit(float(policy.uplift_per_suspect)) * F.size(suspects))
    lifted = F.least(F.lit(1.0), F.col(probability) + uplift)
    df = df.withColumn("adjusted_probability", F.when(blocked, F.lit(1.0)).otherwise(lifted))

    adjusted = F.col("adjusted_probability")
    declined = adjusted >= float(policy.threshold_decline)
    reviewed = adjusted >= float(policy.threshold_review)
    comparison = (
        F.when(declined, F.lit(">=decline_threshold"))
        .when(reviewed, F.lit(">=review_threshold"))
        .otherwise(F.lit("<review_threshold"))
    )
    model_reason = F.concat(F.lit("ml:p="), three_decimals(adjusted), comparison)
    decided = df.withColumns(
        {
            "action": F.when(blocked | declined, F.lit("DECLINE"))
            .when(reviewed, F.lit("REVIEW"))
            .otherwise(F.lit("APPROVE")),
            "risk_score": score_points(adjusted),
            "reasons": F.when(blocked, _reason_codes(F.col("_hard"))).otherwise(
                F.concat(_reason_codes(suspects), F.array(model_reason))
            ),
        }
    )
    return decided.drop("_hard", "_suspects")


def response(df: DataFrame, model_version: str = "unknown") -> DataFrame:
    """The published result: probability to six digits, all hits including the informative ones."""
    return df.select(
        "transaction_id",
        "action",
        round_exact(F.col("fraud_probability"), 6).alias("fraud_probability"),
        "risk_score",
        "reasons",
        "rule_hits",
        F.lit(model_version).alias("model_version"),
    )


def output_violations(df: DataFrame) -> DataFrame:
    """Counts of rows that break the published contract, one row per check."""
    def bad(ok: Column) -> Column:
        return F.count_if(~F.coalesce(ok, F.lit(False)))

    checks = {
        "probability_in_0_1": F.col("fraud_probability").between(0.0, 1.0) & ~F.isnan("fraud_probability"),
        "score_in_0_1000": F.col("risk_score").between(0, 1000),
        "known_action": F.col("action").isin(ACTIONS),
        "known_severity": F.forall("rule_hits", lambda hit: hit["severity"].isin(SEVERITIES)),
        "has_id": F.col("transaction_id").isNotNull(),
    }
    counted = df.agg(*[bad(ok).alias(name) for name, ok in checks.items()])
    return counted.unpivot([], list(checks), "check", "n_violations")
