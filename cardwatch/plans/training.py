"""Training, calibration, evaluation and persistence of the classifier, all on executors."""

from __future__ import annotations

import json
import math
import platform
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.functions.features import FEATURE_COLUMNS, build_features, require_columns, select_feature_matrix
from cardwatch.operators.boosting import (
    TREE_TABLE,
    Ensemble,
    Scorer,
    Settings,
    best_round,
    bin_edges,
    blocks,
    boost,
    ensemble_from,
    starting_margin,
    tree_table,
)
from cardwatch.operators.calibration import isotonic_blocks, knots, sigmoid, sigmoid_fit, weighted_scores
from cardwatch.operators.evaluation import metrics_report, training_stats
from cardwatch.operators.splits import plan_split, split_summary
from cardwatch.session import materialize
from cardwatch.sources.config import load_model_settings
from cardwatch.sources.tables import write_table

METADATA = "model_version string, trained_at string, python_version string, code_version string, best_round int, rounds_tried int, " \
    "start double, calibration string, feature_columns array<string>, params string, report map<string,double>, importance map<string,double>"
MANIFEST = "version string, published_micros long"
#: Knots of a monotone calibration at most; they are part of the model and go to every task.
MAX_KNOTS = 1_000_000


def class_weights(df: DataFrame, label: str = "is_fraud") -> tuple[float, DataFrame]:
    """Weight of a positive row (negatives per positive), and the counts it comes from."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    counts = counts.withColumn("positive_weight", F.coalesce(F.col("n_neg") / F.nullif(F.col("n_pos"), F.lit(0)), F.lit(1.0)))
    return counts.first()["positive_weight"], counts


def boosting_settings(settings: dict[str, Any]) -> Settings:
    learner, training = settings["learner"], settings["training"]
    return Settings(
        rounds=int(learner["rounds"]),
        learning_rate=float(learner["learning_rate"]),
        leaves=int(learner["leaves"]),
        max_depth=int(learner["max_depth"]),
        min_rows=int(learner["min_rows_per_leaf"]),
        l2=float(learner["l2"]),
        feature_share=float(learner["feature_share"]),
        row_share=float(learner["row_share"]),
        row_rounds=int(learner["row_rounds"]),
        patience=int(training["patience"]),
        seed=int(learner["seed"]),
    )


def fit_trees(weighted: DataFrame, settings: Settings, features: Sequence[str] = FEATURE_COLUMNS) -> tuple[Ensemble, list[float]]:
    """Trees up to the round of least loss on the validation part, and the losses of all rounds tried.

    ``weighted`` has the features, is_fraud, weight, transaction_id and split ("fit" or "val").
    """
    held = weighted.withColumn("held", F.col("split") == "val")
    edges = bin_edges(held.filter(~F.col("held")), features)
    matrix = blocks(held, features, edges, "is_fraud", "weight", "transaction_id", "held").persist(StorageLevel.MEMORY_AND_DISK)
    trees, losses = boost(matrix, Ensemble(list(features), edges, starting_margin(matrix)), settings)
    matrix.unpersist()
    return trees.first(best_round(losses, settings.patience)[0]), losses


def raw_score(trees: Ensemble) -> Callable[..., Column]:
    """The trees' probability as a function of the feature columns, which are all that leaves the engine."""

    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        scorer = Scorer(trees)
        for columns in batches:
            margins = scorer.margins([c.fill_null(math.nan).to_numpy(zero_copy_only=False) for c in columns])
            yield pa.array(1.0 / (1.0 + np.exp(-margins)))

    return F.arrow_udf(score, "double")


def calibrate(scored: DataFrame, method: str) -> list[tuple[float, float]]:
    """Knots (x, y) of the isotonic map, or one pair (slope, intercept), from (score, is_fraud)."""
    points = weighted_scores(scored)
    if method == "sigmoid":
        return [sigmoid_fit(points)]
    if method != "isotonic":
        raise ValueError(f"no calibration is called {method}")
    found = materialize(knots(isotonic_blocks(points)))
    if (size := found.count()) > MAX_KNOTS:
        raise ValueError(f"the calibration has {size} knots; a model may have {MAX_KNOTS}")
    return [(row["x"], row["y"]) for row in found.orderBy("x").collect()]


@dataclass
class TrainedModel:
    """Trees and calibration, with what is needed to know them again."""

    trees: Ensemble
    calibration: list[tuple[float, float]]
    metadata: dict[str, Any] = field(default_factory=dict)

    @property
    def feature_columns(self) -> list[str]:
        return self.trees.features

    @property
    def version(self) -> str:
        return str(self.metadata.get("model_version", "unknown"))

    def probability(self, raw: Column) -> Column:
        if self.metadata["calibration"] == "sigmoid":
            return sigmoid(raw, *self.calibration[0])
        if not self.calibration:
            return raw
        # As many literals as knots would swell the plan, so the map runs beside it in batches.
        x, y = np.array(self.calibration).T

        def interpolate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in batches:
                yield pa.array(np.interp(column.to_numpy(zero_copy_only=False), x, y))

        return F.arrow_udf(interpolate, "double")(raw)

    def raw(self, features: DataFrame) -> Column:
        require_columns(features, self.feature_columns)
        return raw_score(self.trees)(*[F.col(name).cast("double") for name in self.feature_columns])

    def score(self, features: DataFrame) -> DataFrame:
        """Adds fraud_probability; features are taken in the order saved with the model."""
        return features.withColumn("fraud_probability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), self.probability(self.raw(features)))))

    __call__ = score

    def importance(self, spark: SparkSession) -> DataFrame:
        """Share of the total gain per feature, to four digits, greatest first."""
        table = spark.createDataFrame(list(self.metadata["importance"].items()), "feature string, importance double")
        return table.orderBy(F.desc("importance"), "feature")


@dataclass
class TrainingRun:
    model: TrainedModel
    scored: DataFrame  # all rows with split, label and probability
    report: DataFrame  # (metric, value)
    summary: DataFrame  # sizes and fraud rates per split
    stats: DataFrame  # per feature, over the fit part


def part_metrics(summary: DataFrame) -> DataFrame:
    """(metric, value) with the size and fraud rate of each part of a split summary."""
    parts = summary.filter("split <> 'all'")
    sizes = parts.select(F.concat(F.lit("n_"), "split").alias("metric"), F.col("n_rows").cast("double").alias("value"))
    rates = parts.select(F.concat(F.lit("fraud_rate_"), "split").alias("metric"), F.col("fraud_rate").alias("value"))
    return sizes.unionByName(rates)


def train(df: DataFrame, settings: dict[str, Any] | None = None, code_version: str = "unknown") -> TrainingRun:
    """Fit on the oldest rows, calibrate on the next, test on the newest."""
    settings = settings or load_model_settings()
    learner, training = settings["learner"], settings["training"]
    split = plan_split(df, float(training["test_share"]), float(training["validation_share"]))
    labelled = build_features(df).withColumn("split", split.column())
    keep = ["transaction_id", "split", "is_fraud"]
    # Boosting reads its input once per round, so the narrow matrix is written out first.
    matrix = materialize(select_feature_matrix(labelled, keep=keep))
    fit = matrix.filter(F.col("split") == "fit")

    weight = class_weights(fit)[0] if learner.get("balance_classes", True) else 1.0
    weighted = matrix.withColumn("weight", F.when(F.col("is_fraud") == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))
    trees, losses = fit_trees(weighted.filter(F.col("split") != "test"), boosting_settings(settings))
    held = matrix.filter(F.col("split") == "val").select("is_fraud", *FEATURE_COLUMNS)
    method = training["calibration"]
    raw = raw_score(trees)(*[F.col(name) for name in FEATURE_COLUMNS])
    mapped = calibrate(materialize(held.select("is_fraud", raw.alias("score"))), method)

    gains = trees.gains()
    total = float(gains.sum()) or 1.0
    model = TrainedModel(
        trees,
        mapped,
        {
            "model_version": datetime.now(UTC).strftime("%Y%m%d-%H%M%S"),
            "trained_at": datetime.now(UTC).isoformat(),
            "python_version": platform.python_version(),
            "code_version": code_version,
            "best_round": len(trees.trees),
            "rounds_tried": len(losses),
            "start": trees.start,
            "calibration": method,
            "params": json.dumps(settings, sort_keys=True),
            "importance": {n: round(float(g) / total, 4) for n, g in zip(FEATURE_COLUMNS, gains, strict=True)},
        },
    )
    scored = model.score(matrix)
    test = materialize(scored.filter(F.col("split") == "test").select("transaction_id", "is_fraud", "fraud_probability"))
    summary = split_summary(matrix)
    report = metrics_report(test).unionByName(part_metrics(summary))
    return TrainingRun(model, scored, report, summary, training_stats(fit, FEATURE_COLUMNS))


def _metadata_row(spark: SparkSession, model: TrainedModel) -> DataFrame:
    meta = {"report": {}, **model.metadata, "feature_columns": model.feature_columns}
    names = [part.strip().split(" ")[0] for part in METADATA.replace("map<string,double>", "map").split(",")]
    return spark.createDataFrame([tuple(meta.get(name) for name in names)], METADATA)


def save_run(run: TrainingRun, path: str, runs_table: str | None = None) -> str:
    """Publishes trees, calibration, metadata and training statistics below ``path``, and returns the version's name.

    All parts go to a folder of their own first; one line in the manifest, written last, makes them the current model.
    A run that stops before that leaves the model before it in place, and no reader sees parts of two models.
    One line per metric is appended to ``runs_table``.
    """
    spark = run.scored.sparkSession
    run.model.metadata["report"] = {row["metric"]: float(row["value"]) for row in run.report.collect() if row["value"] is not None}
    version = f"{run.model.version}-{uuid.uuid4().hex[:8]}"
    folder = f"{path}/versions/{version}"
    write_table(tree_table(spark, run.model.trees), f"{folder}/trees")
    write_table(spark.createDataFrame(run.model.calibration, "x double, y double"), f"{folder}/calibration")
    write_table(run.stats, f"{folder}/training_stats")
    write_table(_metadata_row(spark, run.model), f"{folder}/metadata")
    if runs_table:
        meta = run.model.metadata
        lines = [(meta["model_version"], meta["trained_at"], meta["params"], k, v) for k, v in meta["report"].items()]
        table = spark.createDataFrame(lines, "model_version string, trained_at string, params string, metric string, value double")
        write_table(table, runs_table, "append")
    line = spark.createDataFrame([(version, time.time_ns() // 1000)], MANIFEST).coalesce(1)
    write_table(line, f"{path}/manifest", "append")
    return version


def current_version(spark: SparkSession, path: str) -> str:
    """Folder of the model that was published last."""
    lines = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    version = lines.agg(F.max_by("version", F.struct("published_micros", "version"))).first()[0]
    if version is None:
        raise ValueError(f"no model was published below {path}")
    return f"{path}/versions/{version}"


def model_info(spark: SparkSession, path: str) -> DataFrame:
    """The metadata of the current model as a one-row table."""
    return spark.read.schema(METADATA).parquet(f"{current_version(spark, path)}/metadata")


def saved_stats(spark: SparkSession, path: str) -> DataFrame:
    """The training statistics of the current model, for checks of live data against them."""
    return spark.read.parquet(f"{current_version(spark, path)}/training_stats")


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    folder = current_version(spark, path)
    row = spark.read.schema(METADATA).parquet(f"{folder}/metadata").first().asDict(recursive=True)
    columns = row.pop("feature_columns")
    unknown = [name for name in columns if name not in FEATURE_COLUMNS]
    if unknown:
        raise ValueError(f"the model wants features that are not built here: {unknown}")
    trees = ensemble_from(spark.read.schema(TREE_TABLE).parquet(f"{folder}/trees"), columns, row["start"])
    pairs = spark.read.schema("x double, y double").parquet(f"{folder}/calibration").orderBy("x").collect()
    return TrainedModel(trees, [(p["x"], p["y"]) for p in pairs], row)


def model_age(runs: DataFrame, as_of: Column, max_days: int = 35) -> DataFrame:
    """Days since the latest training and whether that is too long."""
    latest = runs.agg(F.max(F.to_timestamp("trained_at")).alias("trained_at"))
    return latest.withColumn("age_days", F.datediff(as_of, F.col("trained_at"))).withColumn(
        "is_stale", F.col("age_days") >= max_days
    )


def score_table(df: DataFrame, model: TrainedModel) -> DataFrame:
    """The input columns, unchanged, plus fraud_probability; no rules and no decision."""
    raw = F.struct(*df.columns)
    scored = model.score(build_features(df.withColumn("_raw", raw)))
    return scored.select("_raw.*", "fraud_probability")


def calibration_curve(df: DataFrame, n_bins: int = 10, label: str = "is_fraud") -> DataFrame:
    """Mean score against observed rate per bin of the score."""
    bins = F.least(F.floor(F.col("fraud_probability") * n_bins), F.lit(n_bins - 1))
    return df.groupBy(bins.cast("int").alias("bin")).agg(
        F.count("*").alias("n_rows"), F.avg("fraud_probability").alias("mean_score"), F.avg(label).alias("fraud_rate")
    )
