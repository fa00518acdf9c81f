"""Registered queries: name -> function of (session, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.functions.features import FEATURE_COLUMNS, build_features, select_feature_matrix
from cardwatch.functions.numeric import micros
from cardwatch.operators import calibration, contract, decision, drift, evaluation, monitoring, profiling, rule_index, rules, sketches, splits, velocity
from cardwatch.operators.rules import Rule
from cardwatch.plans import scoring, training
from cardwatch.session import materialize, scratch_path, settings, use_utc
from cardwatch.sources import events_view, tables
from cardwatch.sources.config import load_model_settings, load_rules
from cardwatch.streaming import jobs, late, velocity_state

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2024-02-01 00:00:00"
# Weights of a second fixed score, for comparisons of two models.
SHADOW_INTERCEPT = -3.5
SWEEP_THRESHOLDS = [i / 20 for i in range(1, 20)]
DRIFT_FEATURES = FEATURE_COLUMNS
# Rules kept as rows: (code, severity, field, op, bound).
RULE_ROWS = [
    ("T01_LARGE", "SUSPECT", "amount", "ge", 1000.0),
    ("T02_LARGE_NIGHT", "SUSPECT", "amount", "ge", 300.0),
    ("T02_LARGE_NIGHT", "SUSPECT", "is_night", "ge", 1.0),
    ("T03_NEW_CARD", "INFO", "card_age_days", "lt", 7.0),
    ("T04_BURST_ABROAD", "HARD_BLOCK", "n_tx_last_1h", "ge", 5.0),
    ("T04_BURST_ABROAD", "HARD_BLOCK", "is_geo_mismatch", "ge", 1.0),
    ("T05_OUTLIER", "SUSPECT", "amount_zscore_30d", "ge", 6.0),
]


def changed_rules() -> list[Rule]:
    """A later version of the rule set: one bound lowered, one rule dropped, one added."""
    kept = [rule for rule in load_rules() if rule.code not in ("R002_VERY_HIGH_AMOUNT", "R006_NIGHT_ATM")]
    return [
        *kept,
        Rule("R002_VERY_HIGH_AMOUNT", "HARD_BLOCK", "Amount of 500 or more", {"amount_gte": 500}),
        Rule("R010_NOTE_LARGE", "INFO", "Amount of 2000 or more", {"amount_gte": 2000}),
    ]


def _text(array: str | Column) -> Column:
    return F.concat_ws("|", array)


def _codes(hits: str = "rule_hits") -> Column:
    return F.concat_ws("|", F.transform(hits, lambda hit: hit["code"]))


def _r(name: str, digits: int = 9) -> Column:
    return F.round(name, digits).alias(name)


def _txn(spark: SparkSession, sf: str) -> DataFrame:
    return events_view.transactions(use_utc(spark), sf)


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return build_features(_txn(spark, sf))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_transactions(_txn(spark, sf))


def _split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.add_split(_txn(spark, sf))


def _model_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed probability for every row, without the override for blocked rows."""
    return scoring.fixed_score()(_features(spark, sf))


# Features, rules, decision


def features_matrix(spark, sf):
    matrix = select_feature_matrix(_features(spark, sf), keep=["transaction_id"])
    return matrix.withColumn("amount_log", F.round("amount_log", 9))


def rule_hits(spark, sf):
    hit = rules.apply_rules(_features(spark, sf), load_rules())
    return rules.hit_facts(hit).select("transaction_id", "code", "severity")


def rule_hit_counts(spark, sf):
    return rules.hit_counts(rules.apply_rules(_features(spark, sf), load_rules()))


def rules_as_table(spark, sf):
    table = spark.createDataFrame(RULE_ROWS, "code string, severity string, field string, op string, bound double")
    features = _features(spark, sf)
    codes = rule_index.index_hits(spark, rule_index.index_from_table(table, features.columns))
    return features.select("transaction_id", _text(codes).alias("codes")).filter("codes <> ''")


def rule_index_hits(spark, sf):
    """One rule per transaction: amounts from its own to one more, on cards up to a month older than its card."""
    features = _features(spark, sf)
    bounds = (("amount", "ge", F.col("amount")), ("amount", "lt", F.col("amount") + 1.0), ("card_age_days", "lt", F.col("card_age_days") + 30))
    conditions = [F.struct(F.lit(f).alias("field"), F.lit(op).alias("op"), b.cast("double").alias("bound")) for f, op, b in bounds]
    table = features.select(F.col("transaction_id").alias("code"), F.explode(F.array(*conditions)).alias("c")).select("code", "c.*")
    return rule_index.hit_summary(features, table).select("transaction_id", "n_hits", "last_code")


def decisions(spark, sf):
    return _scored(spark, sf).select(
        "transaction_id",
        "fraud_probability",
        "adjusted_probability",
        "action",
        "risk_score",
        _text("reasons").alias("reasons"),
        _codes().alias("rule_codes"),
    )


def decision_counts(spark, sf):
    return monitoring.decision_counts(_scored(spark, sf))


def decisions_skip_blocked(spark, sf):
    scored = scoring.score_skipping_blocked(_txn(spark, sf), scoring.fixed_score())
    return scored.select("transaction_id", "fraud_probability", "adjusted_probability", "action", "risk_score")


def decision_response(spark, sf):
    answer = decision.response(_scored(spark, sf), "fixed-1")
    return answer.withColumns({"reasons": _text("reasons"), "rule_hits": F.size("rule_hits").cast("bigint")})


def output_violations(spark, sf):
    return decision.output_violations(_scored(spark, sf))


def safe_output(spark, sf):
    kept = tables.safe_output(_scored(spark, sf))
    return kept.withColumns(
        {"timestamp": micros(F.col("timestamp")), "reasons": _text("reasons"), "rule_hits": _codes("rule_hits")}
    )


def audit_log(spark, sf):
    return monitoring.audit_log(_scored(spark, sf)).withColumn("rule_codes", _text("rule_codes"))


def review_queue_topk(spark, sf):
    return monitoring.review_queue(_scored(spark, sf), 25)


# Contract


def _checked(spark, sf):
    return contract.check_table(events_view.dirty_transactions(use_utc(spark), sf))


def _checked_json(spark, sf):
    return contract.check_json(events_view.payloads_from_transactions(_txn(spark, sf)))


def _valid_view(rows: DataFrame) -> DataFrame:
    return rows.withColumn("timestamp", micros(F.col("timestamp")))


def _error_text() -> Column:
    return F.concat_ws(",", F.transform("errors", lambda e: F.concat_ws(":", e["field"], e["code"])))


def contract_valid(spark, sf):
    return _valid_view(contract.valid_rows(_checked(spark, sf)))


def contract_quarantine(spark, sf):
    return contract.quarantined_rows(_checked(spark, sf)).select(
        "transaction_id",
        micros(F.col("timestamp")).alias("timestamp"),
        "merchant_id",
        F.size("errors").cast("bigint").alias("n_errors"),
        _error_text().alias("errors"),
    )


def contract_error_counts(spark, sf):
    return contract.error_counts(_checked(spark, sf))


def contract_json_valid(spark, sf):
    return _valid_view(contract.valid_rows(_checked_json(spark, sf)))


def contract_json_quarantine(spark, sf):
    return contract.quarantined_rows(_checked_json(spark, sf)).select("event_id", _error_text().alias("errors"))


def json_batch_explode(spark, sf):
    payloads = events_view.payloads_from_transactions(_txn(spark, sf))
    # Requests of exactly fifty items.
    request = F.floor(F.col("event_id") / 50).alias("request")
    items = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    listed = payloads.groupBy(request).agg(items.alias("items"))
    body = F.concat(F.lit('{"transactions":['), F.concat_ws(",", F.transform("items", lambda i: i["value"])), F.lit("]}"))
    exploded = tables.explode_batches(listed.select("request", body.alias("value")))
    checked = contract.check_json(exploded)
    return checked.select("request", F.col("pos").cast("bigint").alias("pos"), F.col("clean.merchant_id"), _error_text().alias("errors"))


# History windows


def _velocity_view(df: DataFrame) -> DataFrame:
    return df.select(
        "transaction_id",
        "n_tx_last_1h",
        "n_tx_last_24h",
        "amount_avg_30d",
        _r("amount_std_30d", 6),
        "distinct_countries_last_24h",
    )


def _one_heavy_card(txn: DataFrame) -> DataFrame:
    """Every third transaction on one card."""
    number = F.substring("transaction_id", 2, 18).cast("long")
    return txn.withColumn("card_id", F.when(number % 3 == 0, F.lit("HEAVY")).otherwise(F.col("card_id")))


def velocity_windows(spark, sf):
    return _velocity_view(velocity.add_velocity(_txn(spark, sf)))


def velocity_sweep(spark, sf):
    """The windows of a table of which one card holds a third."""
    return _velocity_view(velocity.add_velocity(_one_heavy_card(_txn(spark, sf))))


def customer_baseline(spark, sf):
    return velocity.customer_baseline(_txn(spark, sf)).withColumn("std_amount", F.round("std_amount", 6))


def first_seen_ages(spark, sf):
    txn = _txn(spark, sf)
    aged = velocity.add_age(txn, velocity.first_seen(txn, "customer_id"), "customer_id", "customer_age_days")
    aged = velocity.add_age(aged, velocity.first_seen(txn, "card_id"), "card_id", "card_age_days")
    return aged.select("transaction_id", "customer_age_days", "card_age_days")


def asof_profile(spark, sf):
    txn = _txn(spark, sf).select("transaction_id", "card_id", "timestamp")
    profiles = velocity.card_profiles(_txn(spark, sf))
    found = velocity.asof(txn, profiles, "card_id", micros(F.col("timestamp")), "valid_from", ["n_before", "avg_before"])
    return found.select("transaction_id", "n_before", "avg_before")


def freshness(spark, sf):
    found = velocity.freshness(_txn(spark, sf), F.lit(AS_OF).cast("timestamp_ntz"), 24.5)
    return found.withColumn("latest", micros(F.col("latest")))


def card_bursts(spark, sf):
    return monitoring.bursts(_txn(spark, sf))


# Splits and profiles


def time_split(spark, sf):
    return splits.add_split(_txn(spark, sf), 0.2, 0.15).select("transaction_id", "split")


def split_summary(spark, sf):
    return splits.split_summary(_split(spark, sf))


def saved_split(spark, sf):
    path = scratch_path(spark, "split")
    df = _split(spark, sf)
    tables.write_split(df, path)
    return spark.read.schema(df.schema).parquet(path).filter("split = 'test'").select("transaction_id", "amount", "is_fraud", "split")


def amount_histogram(spark, sf):
    found = profiling.amount_histogram(_txn(spark, sf))
    return found.select("is_fraud", "bin", _r("bin_start", 6), "n_rows", _r("density", 6))


def attack_patterns(spark, sf):
    return profiling.tag_attack_pattern(_txn(spark, sf)).select("transaction_id", "attack_pattern").filter("attack_pattern IS NOT NULL")


def pattern_share(spark, sf):
    return profiling.pattern_shares(profiling.tag_attack_pattern(_txn(spark, sf)))


def class_means_lift(spark, sf):
    means = profiling.class_means(_features(spark, sf))
    return means.select("feature", _r("legit"), _r("fraud"), "lift")


def split_drift_means(spark, sf):
    means = profiling.split_means(build_features(_split(spark, sf)))
    return means.select("feature", _r("train_mean"), _r("test_mean"), "rel_diff_pct")


def hour_profile(spark, sf):
    return profiling.hour_profile(_features(spark, sf))


def geo_fraud_rate(spark, sf):
    return profiling.geo_fraud_rate(_features(spark, sf))


def correlation(spark, sf):
    found = profiling.correlations(_features(spark, sf), [*profiling.PROFILE_FEATURES, "is_fraud"])
    return found.withColumn("correlation", F.round("correlation", 9))


# Evaluation


def auc_report(spark, sf):
    found = evaluation.ranking_metrics(evaluation.ranked_scores(_model_scored(spark, sf)), 0.01)
    return found.select(_r("roc_auc"), _r("pr_auc"), _r("recall_at_fpr"), "n_rows", "n_pos")


def auc_report_ranged(spark, sf):
    """The same report through many score ranges, the path of scores with very many distinct values."""
    ranked = evaluation.ranked_scores(_model_scored(spark, sf), rows_per_range=100)
    found = evaluation.ranking_metrics(ranked, 0.01)
    return found.select(_r("roc_auc"), _r("pr_auc"), _r("recall_at_fpr"), "n_rows", "n_pos")


def precision_at_top(spark, sf):
    return evaluation.precision_at_top(_model_scored(spark, sf), 0.01)


def confusion(spark, sf):
    return evaluation.threshold_metrics(_model_scored(spark, sf), 0.5)


def metrics_report(spark, sf):
    return evaluation.metrics_report(_model_scored(spark, sf)).select("metric", _r("value"))


def training_stats(spark, sf):
    train = splits.plan_split(_txn(spark, sf)).is_train()
    found = evaluation.training_stats(_features(spark, sf).filter(train), FEATURE_COLUMNS)
    return found.select("feature", *[_r(name) for name in ("mean", "std", "p01", "p99")])


def threshold_sweep(spark, sf):
    return evaluation.threshold_sweep(_model_scored(spark, sf), SWEEP_THRESHOLDS).withColumn("cost", F.round("cost", 4))


def shadow_compare(spark, sf):
    shadow = scoring.score_transactions(_txn(spark, sf), scoring.fixed_score(intercept=SHADOW_INTERCEPT))
    return evaluation.compare_decisions(_scored(spark, sf), shadow)


def weekly_recall(spark, sf):
    return evaluation.recall_by_week(_model_scored(spark, sf))


def matured_metrics(spark, sf):
    ready = evaluation.matured(_model_scored(spark, sf), F.lit(AS_OF).cast("timestamp_ntz"), 14)
    return evaluation.threshold_metrics(ready, 0.5)


def class_weights(spark, sf):
    return training.class_weights(_txn(spark, sf))[1]


# Drift and monitoring


def _psi(spark, sf, names):
    split = splits.plan_split(_txn(spark, sf))
    scored = _model_scored(spark, sf)
    return drift.psi(scored.filter(split.is_train()), scored.filter(split.is_test()), names)


def psi_features(spark, sf):
    return _psi(spark, sf, DRIFT_FEATURES).select("feature", _r("psi"))


def psi_levels(spark, sf):
    """Legitimate rows against fraudulent ones, which differ enough to reach every level."""
    features = _features(spark, sf)
    found = drift.psi(features.filter("is_fraud = 0"), features.filter("is_fraud = 1"), DRIFT_FEATURES)
    return drift.with_level(found).select("feature", _r("psi"), "level")


def psi_span(spark, sf):
    """Days 10 to 19 as reference, by sketches that are stored per day, against all later days."""
    features = _features(spark, sf)
    path = scratch_path(spark, "sketches")
    tables.write_table(sketches.daily_sketches(features, DRIFT_FEATURES), path)
    first = features.agg(F.min(F.floor(micros(F.col("timestamp")) / velocity.DAY))).first()[0] or 0
    days = F.col("day").between(first + 9, first + 18)
    stored = sketches.merged(spark.read.parquet(path).filter(days))
    dated = features.withColumn("day", F.floor(micros(F.col("timestamp")) / velocity.DAY))
    found = drift.psi(dated.filter(days), dated.filter(F.col("day") > first + 18), DRIFT_FEATURES, sketches=stored)
    return found.select("feature", _r("psi"))


def psi_score(spark, sf):
    return _psi(spark, sf, ["fraud_probability"]).select("feature", _r("psi"))


def drift_against_training(spark, sf):
    features, split = _features(spark, sf), splits.plan_split(_txn(spark, sf))
    stats = materialize(evaluation.training_stats(features.filter(split.is_train()), FEATURE_COLUMNS))
    found = drift.against_training(features.filter(split.is_test()), stats, FEATURE_COLUMNS)
    return found.select("feature", _r("live_mean", 6), _r("z", 6), _r("share_outside", 6))


def probability_histogram(spark, sf):
    found = monitoring.probability_histogram(_scored(spark, sf))
    return found.select("le", "n_rows", _r("score_sum", 4))


def decline_rate_daily(spark, sf):
    return monitoring.decline_rate(_scored(spark, sf))


def decline_rate_hourly(spark, sf):
    return monitoring.decline_rate(_scored(spark, sf), "hour")


def decline_by_country(spark, sf):
    return monitoring.decline_by_country(_scored(spark, sf)).withColumn("z", F.round("z", 6))


def silent_rules(spark, sf):
    return monitoring.rule_summary(_scored(spark, sf), [*load_rules(), Rule("R099_NEVER", "INFO", "Never seen", {"amount_gte": 10**9})])


def rule_activity(spark, sf):
    return monitoring.rule_activity(_scored(spark, sf), load_rules(), "day", 1.5)


def rule_backtest(spark, sf):
    return monitoring.backtest_rules(_features(spark, sf), load_rules(), changed_rules())


# Training; one run per application and content of the table

_RUNS: dict[tuple, training.TrainingRun] = {}


def _run(spark: SparkSession, sf: str) -> training.TrainingRun:
    txn = _txn(spark, sf)
    key = (spark.sparkContext.applicationId, sf, *txn.agg(F.count("*"), F.bit_xor(F.xxhash64(*txn.columns))).first())
    if key not in _RUNS:
        _RUNS[key] = training.train(txn, load_model_settings())
    return _RUNS[key]


def model_scores(spark, sf):
    return _run(spark, sf).scored.select("transaction_id", "split", "fraud_probability")


def model_decisions(spark, sf):
    scored = scoring.score_transactions(_txn(spark, sf), _run(spark, sf).model)
    return scored.select("transaction_id", "fraud_probability", "adjusted_probability", "action", "risk_score")


def model_checks(spark, sf):
    """Rows per part, and rows whose probability or action breaks its definition."""
    run = _run(spark, sf)
    scored = scoring.score_transactions(_txn(spark, sf), run.model)
    own = run.scored.select("transaction_id", "split", F.col("fraud_probability").alias("kept"))
    lifted = F.col("adjusted_probability")
    action = F.when(lifted >= 0.70, "DECLINE").when(lifted >= 0.30, "REVIEW").otherwise("APPROVE")
    blocked = F.exists("rule_hits", lambda hit: hit["severity"] == "HARD_BLOCK")
    return (
        scored.join(own, "transaction_id")
        .groupBy("split")
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if(~F.coalesce(F.col("kept").between(0.0, 1.0), F.lit(False))).alias("n_outside"),
            F.count_if(~F.col("action").eqNullSafe(action)).alias("n_other_action"),
            F.count_if(~blocked & ~F.col("fraud_probability").eqNullSafe(F.col("kept"))).alias("n_other_probability"),
        )
    )


def feature_importance(spark, sf):
    return _run(spark, sf).model.importance(spark).limit(10)


def calibration_curve(spark, sf):
    return training.calibration_curve(_run(spark, sf).scored.filter("split = 'test'"))


def _coarse_points(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed scores cut to three digits, with their labels."""
    score = F.floor(F.col("fraud_probability") * 1000.0) / 1000.0
    return calibration.weighted_scores(_model_scored(spark, sf).select("is_fraud", score.alias("score")))


def isotonic_fit(spark, sf):
    blocks = calibration.isotonic_blocks(_coarse_points(spark, sf))
    return blocks.select("low", "high", _r("fitted"), F.col("weight").cast("long").alias("n_rows"))


def sigmoid_fit(spark, sf):
    points = materialize(_coarse_points(spark, sf))
    slope, intercept = calibration.sigmoid_fit(points)
    at = calibration.sigmoid(F.col("score"), slope, intercept)
    return points.select("score", F.round(at, 6).alias("fitted"))


def model_top_drift(spark, sf):
    """Stability of the five features that matter most to the model, newest rows against older ones."""
    top = _run(spark, sf).model.importance(spark).limit(5)
    drifts = drift.with_level(_psi(spark, sf, DRIFT_FEATURES))
    return top.join(drifts, "feature").select("feature", "importance", _r("psi"), "level")


def drift_against_saved(spark, sf):
    """Newest rows against the statistics that were saved with the model."""
    stats = training.saved_stats(spark, _saved(spark, sf))
    newest = _features(spark, sf).filter(splits.plan_split(_txn(spark, sf)).is_test())
    found = drift.against_training(newest, stats, FEATURE_COLUMNS)
    return found.select("feature", _r("live_mean", 6), _r("z", 6), _r("share_outside", 6))


def training_report(spark, sf):
    return _run(spark, sf).report


def training_summary(spark, sf):
    return _run(spark, sf).summary


def _saved(spark, sf):
    path = scratch_path(spark, "model")
    training.save_run(_run(spark, sf), path, f"{path}/runs")
    return path


def model_info(spark, sf):
    return training.model_info(spark, _saved(spark, sf)).select("model_version", "best_round", F.size("feature_columns").alias("n_features"))


def training_runs(spark, sf):
    return spark.read.parquet(f"{_saved(spark, sf)}/runs").select("metric", "value")


def model_freshness(spark, sf):
    runs = spark.read.parquet(f"{_saved(spark, sf)}/runs")
    return training.model_age(runs, F.current_timestamp()).select("age_days", "is_stale")


def scored_file(spark, sf):
    """Saved model, loaded again, over the raw table, written and read back."""
    model = training.load_model(spark, _saved(spark, sf))
    path = scratch_path(spark, "scored")
    scored = training.score_table(_txn(spark, sf), model)
    tables.write_table(scored, path)
    return spark.read.schema(scored.schema).parquet(path).select("transaction_id", "amount", "is_cnp", "fraud_probability")


# Streams: work off the table as it is now, then read the sink


def _txn_stream(spark: SparkSession, sf: str) -> DataFrame:
    return events_view.transactions_from_events(events_view.stream_events(use_utc(spark), sf))


def _in_order(spark: SparkSession, df: DataFrame, path: str, n_batches: int, rows_per_file: int = 5_000_000) -> DataFrame:
    """The rows as a stream of about ``n_batches`` micro-batches, by time: one write after another, as many files each."""
    at = micros(F.col("timestamp"))
    low, high, n = df.agg(F.min(at), F.max(at), F.count("*")).first()
    files = 1 + n // (n_batches * rows_per_file)
    width = max(1, -(-((high or 0) + 1 - (low or 0)) // n_batches))
    for i in range(n_batches):
        part = df.filter(((at - (low or 0)) / width).cast("long") == i)
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _run_update(spark: SparkSession, df: DataFrame, keys: list[str]) -> DataFrame:
    path = scratch_path(spark, "stream")
    jobs.run_available(jobs.update_writer(df, f"{path}/out"), f"{path}/checkpoint")
    return jobs.latest_per_key(jobs.read_batches(spark, f"{path}/out", df.schema.add("batch_id", "long")), keys)


def _run_append(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = scratch_path(spark, "stream")
    writer = df.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")
    jobs.run_available(writer, f"{path}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def stream_scores(spark, sf):
    scored = _run_append(spark, jobs.score_stream(_txn_stream(spark, sf)))
    return scored.select("transaction_id", "fraud_probability", "adjusted_probability", "action", "risk_score", _text("reasons").alias("reasons"))


def _payload_files(spark: SparkSession, sf: str, path: str, n_files: int) -> str:
    payloads = events_view.payloads_from_transactions(_txn(spark, sf))
    payloads.select("value").repartition(n_files).write.text(path)
    return path


def json_text_errors(spark, sf):
    """Field errors of payloads that lie as lines in text files."""
    files = _payload_files(spark, sf, scratch_path(spark, "payloads"), 8)
    return contract.error_counts(contract.check_json(tables.read_payloads(spark, files)))


def stream_payload_scores(spark, sf):
    """Payloads from text files, a few files per micro-batch."""
    path = scratch_path(spark, "stream")
    payloads = tables.stream_payloads(spark, _payload_files(spark, sf, f"{path}/in", 6), files_per_batch=2)
    writer = jobs.payload_writer(payloads, f"{path}/scored", f"{path}/quarantine")
    jobs.run_available(writer, f"{path}/checkpoint")
    scored = jobs.read_batches(spark, f"{path}/scored", "transaction_id string, action string, risk_score int")
    bad = jobs.read_batches(spark, f"{path}/quarantine", "value string, errors array<struct<field:string,code:string>>")
    good = scored.groupBy("action").agg(F.count("*").alias("n_rows")).withColumnRenamed("action", "outcome")
    refused = bad.groupBy(F.lit("QUARANTINE").alias("outcome")).agg(F.count("*").alias("n_rows"))
    return good.unionByName(refused)


def _number() -> Column:
    return F.substring("transaction_id", 2, 18).cast("long")


def stream_late_rows(spark, sf):
    """Three micro-batches, each with rows from the whole month: most rows of the later ones come too late."""
    path = scratch_path(spark, "stream")
    txn = _txn(spark, sf)
    for i in range(3):
        txn.filter(_number() % 3 == i).repartition(2).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(txn.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    jobs.run_available(late.late_writer(stream, f"{path}/out", timedelta(hours=1)), f"{path}/checkpoint")
    sides = [jobs.read_batches(spark, f"{path}/out/{s}", txn.schema.add("batch_id", "long")).withColumn("side", F.lit(s)) for s in ("on_time", "late")]
    rows = sides[0].unionByName(sides[1]).groupBy("batch_id", "side").agg(F.count("*").alias("n_rows"), F.max("transaction_id").alias("last_id"))
    return rows.join(late.marks(spark, f"{path}/out").select("batch_id", "watermark_micros", "n_late"), "batch_id")


def stream_confirmed(spark, sf):
    """Scores and late labels as two streams: frauds are charged back after two days or, too late, after five."""
    path = scratch_path(spark, "stream")
    txn = _txn(spark, sf)
    days = F.when(_number() % 2 == 0, F.expr("interval 2 days")).otherwise(F.expr("interval 5 days"))
    charged = txn.filter("is_fraud = 1").select("transaction_id", (F.col("timestamp") + days).alias("timestamp"))
    scores = _in_order(spark, txn.select("transaction_id", "timestamp"), f"{path}/scores", 6)
    backs = _in_order(spark, charged, f"{path}/backs", 6).withColumnRenamed("timestamp", "confirmed_at")
    found = _run_append(spark, jobs.with_confirmation(scores, backs, 3))
    newest = txn.agg(F.max("timestamp").alias("newest")).first()["newest"]
    return evaluation.matured(found, F.lit(newest), 14).select("transaction_id", "confirmed")


def stream_dedup(spark, sf):
    copies = F.when(F.substring("transaction_id", -1, 1) == "7", F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    doubled = _txn_stream(spark, sf).withColumn("copy", F.explode(copies)).drop("copy")
    return _run_append(spark, jobs.first_of_each(doubled).select("transaction_id", "amount"))


def stream_decision_windows(spark, sf):
    counts = jobs.windowed_decisions(scoring.score_transactions(_txn_stream(spark, sf)), delay="60 days", width="1 hour")
    return _run_update(spark, counts, ["window_micros", "action"])


def stream_sliding_windows(spark, sf):
    scored = scoring.score_transactions(_txn_stream(spark, sf))
    counts = jobs.windowed_decisions(scored, delay="60 days", width="2 hours", slide="1 hour")
    return _run_update(spark, counts, ["window_micros", "action"])


def stream_rule_hits(spark, sf):
    counts = jobs.windowed_rule_hits(scoring.score_transactions(_txn_stream(spark, sf)), delay="60 days", width="1 day")
    return _run_update(spark, counts, ["window_micros", "code", "severity"])


def stream_sessions(spark, sf):
    """Closed sessions: those whose end the watermark has passed."""
    with settings(spark, jobs.SESSION_SETTINGS):
        return _run_append(spark, jobs.card_sessions(_txn_stream(spark, sf), delay="0 seconds"))


def stream_velocity(spark, sf):
    path = scratch_path(spark, "stream")
    txn = _txn(spark, sf)
    stream = _in_order(spark, txn, f"{path}/in", 10)
    at = micros(F.col("timestamp"))
    n_rows, spanned = txn.agg(F.count("*"), F.coalesce(F.max(at) - F.min(at), F.lit(0))).first()
    shards = velocity_state.shards_for(n_rows, spanned)
    with settings(spark, velocity_state.STATE_SETTINGS):
        jobs.run_available(velocity_state.velocity_writer(stream, f"{path}/out", shards=shards), f"{path}/checkpoint")
    return _velocity_view(jobs.read_batches(spark, f"{path}/out", velocity.add_velocity(txn).schema))


def stream_drift(spark, sf):
    path = scratch_path(spark, "stream")
    names = ["amount", "amount_log", "amount_zscore_30d", "velocity_score", "hour"]
    reference = _features(spark, sf).filter("is_fraud = 0")
    edges = materialize(drift.inner_edges(reference, names))
    live = build_features(_txn_stream(spark, sf))
    jobs.run_available(jobs.drift_writer(live, reference, edges, names, f"{path}/out"), f"{path}/checkpoint")
    return jobs.read_batches(spark, f"{path}/out", "feature string, psi double").select("feature", _r("psi"))


QUERIES: dict[str, Query] = {
    function.__name__: function
    for function in (
        features_matrix,
        rule_hits,
        rule_hit_counts,
        rules_as_table,
        rule_index_hits,
        decisions,
        decision_counts,
        decisions_skip_blocked,
        decision_response,
        output_violations,
        safe_output,
        audit_log,
        review_queue_topk,
        contract_valid,
        contract_quarantine,
        contract_error_counts,
        contract_json_valid,
        contract_json_quarantine,
        json_batch_explode,
        velocity_windows,
        velocity_sweep,
        customer_baseline,
        first_seen_ages,
        asof_profile,
        freshness,
        card_bursts,
        time_split,
        split_summary,
        saved_split,
        amount_histogram,
        attack_patterns,
        pattern_share,
        class_means_lift,
        split_drift_means,
        hour_profile,
        geo_fraud_rate,
        correlation,
        auc_report,
        auc_report_ranged,
        precision_at_top,
        confusion,
        metrics_report,
        training_stats,
        threshold_sweep,
        shadow_compare,
        weekly_recall,
        matured_metrics,
        class_weights,
        psi_features,
        psi_levels,
        psi_span,
        psi_score,
        drift_against_training,
        probability_histogram,
        decline_rate_daily,
        decline_rate_hourly,
        decline_by_country,
        silent_rules,
        rule_activity,
        rule_backtest,
        model_scores,
        model_decisions,
        model_checks,
        feature_importance,
        calibration_curve,
        isotonic_fit,
        sigmoid_fit,
        model_top_drift,
        drift_against_saved,
        training_report,
        training_summary,
        model_info,
        training_runs,
        model_freshness,
        scored_file,
        stream_scores,
        stream_payload_scores,
        json_text_errors,
        stream_late_rows,
        stream_confirmed,
        stream_dedup,
        stream_decision_windows,
        stream_sliding_windows,
        stream_rule_hits,
        stream_sessions,
        stream_velocity,
        stream_drift,
    )
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions by action and rule."""
    scored = _scored(spark, sf).select("action", F.explode_outer("rule_hits").alias("hit"))
    return scored.groupBy("action", F.coalesce("hit.code", F.lit("none")).alias("rule")).agg(F.count("*").alias("n_rows"))
