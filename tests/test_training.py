from __future__ import annotations

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from cardwatch.functions.features import FEATURE_COLUMNS, build_features
from cardwatch.plans import training
from cardwatch.session import scratch_path
from cardwatch.sources import events_view
from cardwatch.sources.config import load_model_settings


def _settings(calibration):
    settings = load_model_settings()
    settings["learner"] |= {"rounds": 5, "learning_rate": 0.3, "max_depth": 4, "min_rows_per_leaf": 5}
    settings["training"] |= {"calibration": calibration, "patience": 3}
    return settings


@pytest.mark.parametrize("calibration", ["isotonic", "sigmoid"])
def test_train_save_load_score(spark, calibration):
    txn = events_view.transactions(spark, SMALL)
    run = training.train(txn, _settings(calibration), code_version="abc")
    sizes = {r["split"]: r["n_rows"] for r in run.summary.collect()}
    assert sizes == {"fit": 680, "val": 120, "test": 200, "all": 1000}
    report = {r["metric"]: r["value"] for r in run.report.collect()}
    assert 0.5 < report["roc_auc"] <= 1.0 and report["n_rows"] == 200
    assert {p: report[f"n_{p}"] for p in ("fit", "val", "test")} == {"fit": 680, "val": 120, "test": 200}
    rates = {r["split"]: r["fraud_rate"] for r in run.summary.collect()}
    assert all(report[f"fraud_rate_{p}"] == rates[p] for p in ("fit", "val", "test"))
    importance = [r["importance"] for r in run.model.importance(spark).collect()]
    assert importance == sorted(importance, reverse=True) and sum(importance) == pytest.approx(1, abs=0.01)

    path = scratch_path(spark, "test-model")
    training.save_run(run, path, f"{path}/runs")
    training.save_run(run, path, f"{path}/runs")
    info = training.model_info(spark, path).first()
    assert (info["model_version"], info["code_version"], info["feature_columns"]) == (run.model.version, "abc", FEATURE_COLUMNS)
    assert spark.read.parquet(f"{path}/runs").filter("metric = 'roc_auc'").count() == 2
    assert training.saved_stats(spark, path).count() == 21

    loaded = training.load_model(spark, path)
    one = {r[0]: r[1] for r in run.scored.select("transaction_id", "fraud_probability").collect()}
    again = training.score_table(txn, loaded)
    assert again.columns == [*txn.columns, "fraud_probability"]
    two = {r[0]: r[1] for r in again.repartition(3).select("transaction_id", "fraud_probability").collect()}
    assert one == two and all(0.0 <= p <= 1.0 for p in two.values())
    with pytest.raises(ValueError, match="not in the table"):
        loaded.score(build_features(txn).drop("hour"))

    runs = spark.read.parquet(f"{path}/runs")
    fresh = training.model_age(runs, F.current_date()).first()
    assert fresh["age_days"] in (0, 1) and not fresh["is_stale"]
    assert training.model_age(runs, F.date_add(F.current_date(), 40)).first()["is_stale"]


def test_best_round_waits_for_its_patience():
    losses = [5.0, 4.0, 4.2, 4.1, 3.0, 3.5, 3.4, 3.3, 1.0]
    assert training.best_round(losses, 3) == (5, True)
    assert training.best_round(losses, 2) == (2, True)
    assert training.best_round(losses, 9) == (9, False)
    assert training.best_round([float("nan")] * 4, 2) == (4, False)


def test_a_shorter_fit_is_the_start_of_a_longer_one(spark):
    settings = load_model_settings(profile="short")
    assert settings["learner"]["rounds"] == 80 and "profiles" not in settings
    assert load_model_settings()["training"]["patience"] == 40
    settings["learner"] |= {"rounds": 12, "max_depth": 3, "min_rows_per_leaf": 5}
    settings["training"] |= {"patience": 2}
    run = training.train(events_view.transactions(spark, SMALL), settings)
    trees = run.model.trees.trees
    assert run.model.metadata["best_round"] == len(trees) <= run.model.metadata["rounds_tried"] <= 12
    assert all((tree.left < 0).sum() <= 8 for tree in trees)  # three levels


def test_a_run_that_stops_half_way_leaves_the_model_before_it(spark, monkeypatch):
    txn = events_view.transactions(spark, SMALL)
    run = training.train(txn, _settings("isotonic"))
    path = scratch_path(spark, "published")
    first = training.save_run(run, path)
    before = {r[0]: r[1] for r in training.score_table(txn, training.load_model(spark, path)).select("transaction_id", "fraud_probability").collect()}
    written = []

    def stops(df, target, mode="overwrite"):
        if len(written) == 3:
            raise RuntimeError("executor lost")
        written.append(target)
        df.write.mode(mode).parquet(target)

    run.model.trees = run.model.trees.first(1)
    monkeypatch.setattr(training, "write_table", stops)
    with pytest.raises(RuntimeError):
        training.save_run(run, path)
    assert len(written) == 3 and training.current_version(spark, path).endswith(first)
    after = {r[0]: r[1] for r in training.score_table(txn, training.load_model(spark, path)).select("transaction_id", "fraud_probability").collect()}
    assert before == after
    monkeypatch.undo()
    second = training.save_run(run, path)
    assert training.current_version(spark, path).endswith(second) != training.current_version(spark, path).endswith(first)
    assert len(training.load_model(spark, path).trees.trees) == 1


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "is_fraud int")
    assert training.class_weights(df)[0] == 3.0
    assert training.class_weights(df.filter("is_fraud = 0"))[0] == 1.0


def test_registered_queries_train_with_the_full_settings(spark, monkeypatch):
    from cardwatch.plans import registry

    seen = []
    monkeypatch.setattr(registry, "_RUNS", {})
    monkeypatch.setattr(registry.training, "train", lambda df, settings=None: seen.append(settings))
    registry._run(spark, SMALL)
    registry._run(spark, SMALL)
    assert seen == [load_model_settings()]
    table = events_view.transactions(spark, SMALL)
    monkeypatch.setattr(registry.events_view, "transactions", lambda *_: table.limit(900))
    registry._run(spark, SMALL)
    assert len(seen) == 2  # the table has changed
