"""Operational counts over scored transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.functions.numeric import micros, round_exact, share
from cardwatch.operators.rules import Rule, hit_facts, rule_hits, rules_table

# Upper bounds of the probability histogram.
PROBABILITY_BOUNDS = [0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 0.99]


def decision_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("action").agg(F.count("*").alias("n_rows"))


def probability_histogram(df: DataFrame, score: str = "fraud_probability", bounds: Sequence[float] | None = None) -> DataFrame:
    """Cumulative rows at or below each bound and in all (bound ``+Inf``), with the sum of scores."""
    bounds = list(bounds or PROBABILITY_BOUNDS)
    counted = df.agg(
        *[F.count_if(F.col(score) <= bound).alias(f"at_{i}") for i, bound in enumerate(bounds)],
        F.count(score).alias("at_all"),
        F.sum(score).alias("score_sum"),
    )
    lines = [F.struct(F.lit(str(bound)).alias("le"), F.col(f"at_{i}").alias("n_rows")) for i, bound in enumerate(bounds)]
    lines.append(F.struct(F.lit("+Inf").alias("le"), F.col("at_all").alias("n_rows")))
    return counted.select(F.explode(F.array(*lines)).alias("line"), "score_sum").select("line.*", "score_sum")


def _declined() -> Column:
    return F.count_if(F.col("action") == "DECLINE")


def decline_rate(df: DataFrame, unit: str = "day", low: float = 0.005, high: float = 0.03, factor: float = 2.0) -> DataFrame:
    """Decline rate per period, whether it lies in its target band, and whether it reached ``factor`` times the period before."""
    periods = df.groupBy(F.date_trunc(unit, "timestamp").alias("_period")).agg(
        F.count("*").alias("n_rows"), _declined().alias("n_declined")
    )
    periods = periods.withColumn("decline_rate", share(F.col("n_declined"), F.col("n_rows")))
    rate, before = F.col("decline_rate"), F.col("rate_before")
    in_order = Window.orderBy("_period")  # one row per period
    return periods.withColumn("rate_before", F.lag("decline_rate").over(in_order)).select(
        F.date_format("_period", "yyyy-MM-dd HH:mm").alias("period"),
        "n_rows",
        "n_declined",
        "decline_rate",
        "rate_before",
        rate.between(low, high).alias("in_target"),
        F.coalesce((before > 0) & (rate >= before * factor), F.lit(False)).alias("jumped"),
    )


def decline_by_country(df: DataFrame, outlier_z: float = 2.0) -> DataFrame:
    """Decline rate per card country and its distance from the mean over countries in deviations."""
    countries = df.groupBy("card_country").agg(F.count("*").alias("n_rows"), _declined().alias("n_declined"))
    countries = countries.withColumn("decline_rate", share(F.col("n_declined"), F.col("n_rows")))
    # One row per country code, so one window over all of them is small.
    everywhere = Window.orderBy("card_country").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rate = F.col("decline_rate")
    spread = F.nullif(F.stddev_samp(rate).over(everywhere), F.lit(0.0))
    scored = countries.withColumn("z", F.coalesce((rate - F.avg(rate).over(everywhere)) / spread, F.lit(0.0)))
    return scored.withColumn("is_outlier", F.abs("z") > outlier_z)


def audit_log(df: DataFrame) -> DataFrame:
    """One narrow row per scoring."""
    return df.select(
        "transaction_id",
        "action",
        round_exact(F.col("fraud_probability"), 4).alias("fraud_probability"),
        "risk_score",
        F.transform("rule_hits", lambda hit: hit["code"]).alias("rule_codes"),
    )


def review_queue(df: DataFrame, limit: int) -> DataFrame:
    """The analysts' next cases: highest score first, equal scores by id."""
    cases = df.filter(F.col("action") == "REVIEW").select("transaction_id", "risk_score", "adjusted_probability")
    return cases.orderBy(F.col("risk_score").desc(), "transaction_id").limit(limit)


def rule_activity(df: DataFrame, rules: Sequence[Rule], unit: str = "week", noisy_factor: float = 2.0) -> DataFrame:
    """Hits per rule and period, silent ones included, set against the period before.

    A rule is noisy when its hits per transaction grew by ``noisy_factor``, silent when it has none.
    """
    dated = df.withColumn("_period", F.date_trunc(unit, "timestamp"))
    hits = hit_facts(dated, keep=["_period"]).groupBy("_period", "code").agg(F.count("*").alias("n_hits"))
    totals = dated.groupBy("_period").agg(F.count("*").alias("n_rows"))
    codes = F.array(*[F.lit(rule.code) for rule in rules])
    spine = totals.select("_period", "n_rows", F.explode(codes).alias("code"))
    filled = spine.join(hits, ["_period", "code"], "left").fillna(0, ["n_hits"])
    rate = share(F.col("n_hits"), F.col("n_rows"))
    before = F.lag("hit_rate").over(Window.partitionBy("code").orderBy("_period"))
    rated = filled.withColumn("hit_rate", rate).withColumn("rate_before", before)
    return rated.select(
        F.date_format("_period", "yyyy-MM-dd").alias("period"),
        "code",
        "n_hits",
        "hit_rate",
        "rate_before",
        (F.col("n_hits") == 0).alias("is_silent"),
        F.coalesce((F.col("rate_before") > 0) & (F.col("hit_rate") >= F.col("rate_before") * noisy_factor), F.lit(False)).alias(
            "is_noisy"
        ),
    )


def rule_summary(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Every rule of the set with its number of hits; rules that never fired show 0."""
    hits = hit_facts(df, keep=()).groupBy("code").agg(F.count("*").alias("n_hits"))
    known = rules_table(df.sparkSession, rules).select("code", "severity")
    filled = known.join(hits, "code", "left").fillna(0, ["n_hits"])
    return filled.withColumn("is_silent", F.col("n_hits") == 0)


def backtest_rules(df: DataFrame, old: Sequence[Rule], new: Sequence[Rule]) -> DataFrame:
    """Both rule sets over the same rows in one projection: rows per code by which set hits them."""

    def codes(rules: Sequence[Rule]) -> Column:
        return F.transform(rule_hits(rules, df.columns), lambda hit: hit["code"])

    both = df.select(codes(old).alias("old"), codes(new).alias("new"))
    marked = F.transform(
        F.array_union("old", "new"),
        lambda code: F.struct(
            code.alias("code"),
            F.array_contains("old", code).alias("in_old"),
            F.array_contains("new", code).alias("in_new"),
        ),
    )
    flat = both.select(F.explode(marked).alias("mark")).select("mark.*")
    return flat.groupBy("code").agg(
        F.count_if(F.col("in_old")).alias("n_old"),
        F.count_if(F.col("in_new")).alias("n_new"),
        F.count_if(~F.col("in_old")).alias("n_gained"),
        F.count_if(~F.col("in_new")).alias("n_lost"),
    )


def bursts(df: DataFrame, gap_minutes: int = 10, card: str = "card_id") -> DataFrame:
    """Runs of transactions of a card with no pause of ``gap_minutes`` or more between neighbours.

    Rows collapse to card and minute first: rows of one minute never part, so only the pauses
    between minutes matter, and a busy card has at most one line per minute.
    """
    minute = 60_000_000
    k = micros(F.col("timestamp"))
    minutes = df.groupBy(card, F.floor(k / minute).alias("_minute")).agg(
        F.min(k).alias("first"),
        F.max(k).alias("last"),
        F.count("*").alias("n"),
        F.sum(F.col("amount").try_cast("decimal(18,6)")).alias("money"),
    )
    visits = Window.partitionBy(card).orderBy("_minute")
    pause = F.col("first") - F.lag("last").over(visits)
    starts = F.coalesce((pause >= gap_minutes * minute).cast("int"), F.lit(1))
    running = visits.rowsBetween(Window.unboundedPreceding, 0)
    numbered = minutes.withColumn("_starts", starts).withColumn("_run", F.sum("_starts").over(running))
    return numbered.groupBy(card, "_run").agg(
        F.min("first").alias("started_micros"),
        F.max("last").alias("ended_micros"),
        F.sum("n").alias("n_tx"),
        F.sum("money").cast("double").alias("total_amount"),
    ).drop("_run")
