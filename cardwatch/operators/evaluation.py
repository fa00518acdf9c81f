"""Quality of scores against labels.

Rows collapse to one line per distinct score before anything is ordered, so equal scores share a
rank and every metric is the same whatever the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.functions.numeric import limits_passed, micros, share
from cardwatch.operators.ordering import find_text, present_values, running_sums
from cardwatch.operators.sketches import exact_quantiles
from cardwatch.session import materialize

SCORE, LABEL = "fraud_probability", "is_fraud"


def ranked_scores(df: DataFrame, score: str = SCORE, label: str = LABEL, rows_per_range: int | None = None) -> DataFrame:
    """One row per distinct score from the top: n, pos, and running and total sums of both."""
    labels = F.col(label).cast("long")
    # -0.0 and 0.0 are one score.
    counts = df.select((F.col(score) + F.lit(0.0)).alias("score"), labels.alias("label")).groupBy("score")
    grouped = materialize(counts.agg(F.count("*").alias("n"), F.sum("label").alias("pos")))
    options = {} if rows_per_range is None else {"rows_per_range": rows_per_range}
    return running_sums(grouped, "score", ["n", "pos"], descending=True, **options)


def _curve(ranked: DataFrame) -> tuple[Column, Column, Column, Column]:
    """True and false positives at each cut, all positives, all negatives; as doubles."""
    hits, seen = F.col("cum_pos").cast("double"), F.col("cum_n").cast("double")
    positives = F.col("total_pos").cast("double")
    return hits, seen - hits, positives, F.col("total_n").cast("double") - positives


def ranking_metrics(ranked: DataFrame, target_fpr: float = 0.01) -> DataFrame:
    """One row: roc_auc, pr_auc (average precision, a step sum), recall at a false positive rate.

    The recall takes cuts between distinct scores only, so the rate never exceeds its target. A
    missing class gives recall 0 and null areas.
    """
    hits, alarms, positives, negatives = _curve(ranked)
    pos = F.col("pos").cast("double")
    neg = F.col("n").cast("double") - pos
    pairs = F.sum(neg * (hits - pos / 2.0))
    steps = F.sum(pos * hits / (hits + alarms))
    within = F.max(F.when(alarms / F.nullif(negatives, F.lit(0.0)) <= target_fpr, hits))
    p, n = F.max(positives), F.max(negatives)
    recall = F.coalesce(within / F.nullif(p, F.lit(0.0)), F.lit(0.0))
    return ranked.agg(
        (pairs / F.nullif(p * n, F.lit(0.0))).alias("roc_auc"),
        (steps / F.nullif(p, F.lit(0.0))).alias("pr_auc"),
        F.when(n > 0, recall).otherwise(F.lit(0.0)).alias("recall_at_fpr"),
        F.max("total_n").alias("n_rows"),
        F.max("total_pos").alias("n_pos"),
    )


def precision_at_top(
    df: DataFrame,
    top_share: float = 0.01,
    score: str = SCORE,
    label: str = LABEL,
    tie: str = "transaction_id",
    ranked: DataFrame | None = None,
) -> DataFrame:
    """One row (k, precision): share of positives among the k = max(1, int(n * share)) highest scores.

    Equal scores are ordered by ``tie``. Only the score group that the k-th row falls into is looked
    into; the rows above it are known from the running sums.
    """
    ranked = ranked_scores(df, score, label) if ranked is None else ranked
    k = F.greatest(F.lit(1), F.floor(F.col("total_n") * F.lit(float(top_share))))
    placed = ranked.withColumn("k", k).filter((F.col("cum_n") >= F.col("k")) & (F.col("cum_n") - F.col("n") < F.col("k")))
    edge = placed.first()
    if edge is None:
        return ranked.agg(F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("precision"))
    above = edge["cum_pos"] - edge["pos"]
    needed = edge["k"] - (edge["cum_n"] - edge["n"])
    if needed == edge["n"]:
        return ranked.agg(F.lit(edge["k"]).cast("long").alias("k"), F.lit(edge["cum_pos"] / edge["k"]).alias("precision"))
    group = df.filter(F.col(score) == edge["score"])
    last = find_text(group.select(F.col(tie).cast("string").alias("t")), needed)
    group = group.filter(F.col(tie).cast("string") <= last)
    found = F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)) + F.lit(above)
    return group.agg(F.lit(edge["k"]).cast("long").alias("k"), (found.cast("double") / float(edge["k"])).alias("precision"))


def _with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(tp * 2, tp * 2 + fp + fn)}
    )


def threshold_metrics(df: DataFrame, threshold: float = 0.5, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Confusion matrix, precision, recall and F1 at one threshold; 0 where a denominator is 0."""
    flagged, positive = F.col(score) >= threshold, F.col(label) == 1
    counts = df.agg(
        F.count_if(~flagged & ~positive).alias("tn"),
        F.count_if(flagged & ~positive).alias("fp"),
        F.count_if(~flagged & positive).alias("fn"),
        F.count_if(flagged & positive).alias("tp"),
    )
    return _with_rates(counts)


def threshold_metrics_of_ranked(ranked: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The same from ``ranked_scores``, without another scan."""
    flagged, pos, neg = F.col("score") >= threshold, F.col("pos"), F.col("n") - F.col("pos")

    def total(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))

    cells = {"tn": (~flagged, neg), "fp": (flagged, neg), "fn": (~flagged, pos), "tp": (flagged, pos)}
    return _with_rates(ranked.agg(*[total(*cell).alias(name) for name, cell in cells.items()]))


def metrics_report(df: DataFrame, score: str = SCORE, label: str = LABEL, tie: str = "transaction_id") -> DataFrame:
    """(metric, value) for the headline metrics."""
    ranked = ranked_scores(df, score, label)

    def long(row: DataFrame, names: dict[str, str]) -> DataFrame:
        renamed = row.select(*[F.col(old).cast("double").alias(new) for old, new in names.items()])
        return renamed.unpivot([], list(names.values()), "metric", "value")

    ranking = {
        "roc_auc": "roc_auc",
        "pr_auc": "pr_auc",
        "recall_at_fpr": "recall_at_1pct_fpr",
        "n_rows": "n_rows",
        "n_pos": "n_fraud",
    }
    fixed = {"precision": "precision_default", "recall": "recall_default", "f1": "f1_at_default_threshold"}
    fixed |= {name: name for name in ("tn", "fp", "fn", "tp")}
    return (
        long(ranking_metrics(ranked), ranking)
        .unionByName(long(precision_at_top(df, 0.01, score, label, tie, ranked), {"precision": "precision_at_top_1pct"}))
        .unionByName(long(threshold_metrics_of_ranked(ranked), fixed))
    )


def training_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, sample deviation (plus 1e-9) and linear 1st and 99th percentile per feature; no value is shuffled."""
    # Merged moments leave a trace of rounding where all values are equal.
    spread = F.when(F.min("value") < F.max("value"), F.stddev_samp("value")).when(F.count("*") > 1, F.lit(0.0))
    moments = present_values(df, features).groupBy("feature").agg(F.avg("value").alias("mean"), spread.alias("std"))
    ends = exact_quantiles(df, features, [0.01, 0.99])
    # One row per feature on both sides.
    return moments.join(F.broadcast(ends), "feature").select(
        "feature",
        "mean",
        (F.col("std") + F.lit(1e-9)).alias("std"),
        F.col("quantiles")[0].alias("p01"),
        F.col("quantiles")[1].alias("p99"),
    )


def threshold_sweep(
    df: DataFrame,
    thresholds: Sequence[float],
    review_cost: float = 5.0,
    score: str = SCORE,
    label: str = LABEL,
    amount: str = "amount",
) -> DataFrame:
    """Per threshold: flagged rows, caught frauds, precision, recall, and cost (reviews plus missed money).

    Rows are counted between neighbouring thresholds in one pass; the cut-off sums run over that short table.
    """
    thresholds = sorted(set(float(t) for t in thresholds))
    money = F.when(F.col(label) == 1, F.col(amount).try_cast("decimal(18,6)"))
    binned = df.groupBy(limits_passed(thresholds, F.col(score)).alias("step")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"), F.sum(money).alias("money")
    )
    spark = df.sparkSession
    steps = spark.createDataFrame([(i, t) for i, t in enumerate([None, *thresholds])], "step int, threshold double")
    filled = steps.join(binned, "step", "left").fillna(0, ["n", "pos", "money"])
    up = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = filled.withColumns(
        {
            "flagged": F.sum("n").over(up),
            "caught": F.sum("pos").over(up),
            "all_pos": F.sum("pos").over(whole),
            "missed": F.sum("money").over(whole) - F.sum("money").over(up),
        }
    ).filter(F.col("threshold").isNotNull())
    alarms = F.col("flagged") - F.col("caught")
    return summed.select(
        "threshold",
        "flagged",
        "caught",
        share(F.col("caught"), F.col("flagged")).alias("precision"),
        share(F.col("caught"), F.col("all_pos")).alias("recall"),
        (alarms * F.lit(float(review_cost)) + F.col("missed").cast("double")).alias("cost"),
    )


def compare_decisions(live: DataFrame, shadow: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Rows per pair of actions of two scorings of the same transactions."""
    left = live.select(key, F.col("action").alias("live_action"), F.col("risk_score").alias("live_score"))
    right = shadow.select(key, F.col("action").alias("shadow_action"), F.col("risk_score").alias("shadow_score"))
    joined = left.join(right, key)
    return joined.groupBy("live_action", "shadow_action").agg(
        F.count("*").alias("n_rows"), F.sum((F.col("shadow_score") - F.col("live_score")).cast("long")).alias("score_shift")
    )


def recall_by_week(
    df: DataFrame, threshold: float = 0.5, max_drop: float = 0.05, score: str = SCORE, label: str = LABEL
) -> DataFrame:
    """Recall per week, the week before, and whether it fell by more than ``max_drop`` (relative)."""
    caught = F.count_if((F.col(label) == 1) & (F.col(score) >= threshold))
    weekly = df.groupBy(F.date_trunc("week", "timestamp").alias("_week")).agg(
        F.count_if(F.col(label) == 1).alias("n_fraud"), caught.alias("n_caught")
    )
    weekly = weekly.withColumn("recall", share(F.col("n_caught"), F.col("n_fraud")))
    before = F.lag("recall").over(Window.orderBy("_week"))  # one row per week
    return weekly.withColumn("recall_before", before).select(
        F.date_format("_week", "yyyy-MM-dd").alias("week"),
        "n_fraud",
        "n_caught",
        "recall",
        "recall_before",
        F.coalesce(F.col("recall") < F.col("recall_before") * (1.0 - max_drop), F.lit(False)).alias("dropped"),
    )


def matured(df: DataFrame, as_of: Column, days: int, timestamp: str = "timestamp") -> DataFrame:
    """Rows old enough for their label to be final."""
    return df.filter(micros(F.col(timestamp)) <= micros(as_of) - F.lit(days * 86_400_000_000))
