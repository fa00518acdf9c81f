"""Order statistics, splits and metrics against direct computation."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch.operators import ordering
from cardwatch.operators.evaluation import (
    metrics_report,
    precision_at_top,
    ranked_scores,
    ranking_metrics,
    threshold_metrics,
    threshold_sweep,
    training_stats,
)
from cardwatch.operators.splits import add_split, plan_split, stamps_between


@pytest.fixture(scope="module")
def scored(spark):
    """A third of the rows share one score."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        label = int(rng.random() < 0.1)
        score = 0.25 if i % 3 == 0 else round(min(1.0, max(0.0, rng.gauss(0.3 + 0.3 * label, 0.2))), 3)
        rows.append((f"T{i:05d}", score, label, float(rng.randrange(1, 1000))))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "transaction_id string, fraud_probability double, is_fraud int, amount double")


def _reference(rows):
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    y = np.array([r[2] for r in order])
    s = np.array([r[1] for r in order])
    last = np.append(s[1:] != s[:-1], True)
    tp, fp = np.cumsum(y)[last], np.cumsum(1 - y)[last]
    p, n = y.sum(), (1 - y).sum()
    tpr, fpr = np.append(0, tp / p), np.append(0, fp / n)
    roc = float(np.sum(np.diff(fpr) * (tpr[1:] + tpr[:-1]) / 2))
    ap = float(np.sum(np.diff(tpr) * (tp / (tp + fp))))
    recall = float(tpr[fpr <= 0.01].max())
    k = max(1, int(len(y) * 0.01))
    return roc, ap, recall, float(y[:k].mean())


@pytest.mark.parametrize("rows_per_range", [None, 20])
def test_ranking_metrics(scored, rows_per_range):
    rows, df = scored
    roc, ap, recall, _ = _reference(rows)
    found = ranking_metrics(ranked_scores(df, rows_per_range=rows_per_range)).first()
    assert found["roc_auc"] == pytest.approx(roc, abs=1e-12)
    assert found["pr_auc"] == pytest.approx(ap, abs=1e-12)
    assert found["recall_at_fpr"] == pytest.approx(recall, abs=1e-12)
    assert (found["n_rows"], found["n_pos"]) == (3000, sum(r[2] for r in rows))


@pytest.mark.parametrize("top", [0.0001, 0.01, 0.3, 0.5, 0.9, 1.0])
def test_precision_at_top_cuts_inside_a_group_of_equal_scores(scored, top):
    rows, df = scored
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    k = max(1, int(len(order) * top))
    found = precision_at_top(df.repartition(7), top).first()
    assert found["k"] == k
    assert found["precision"] == pytest.approx(sum(r[2] for r in order[:k]) / k, abs=1e-12)


def test_one_class_only(spark):
    df = spark.createDataFrame([("a", 0.2, 0, 1.0), ("b", 0.7, 0, 1.0)], "transaction_id string, fraud_probability double, is_fraud int, amount double")
    found = ranking_metrics(ranked_scores(df)).first()
    assert (found["roc_auc"], found["pr_auc"], found["recall_at_fpr"]) == (None, None, 0.0)
    cells = threshold_metrics(df).first()
    assert (cells["tn"], cells["fp"], cells["precision"], cells["recall"], cells["f1"]) == (1, 1, 0.0, 0.0, 0.0)


def test_report_names(scored):
    _, df = scored
    names = {r["metric"] for r in metrics_report(df).collect()}
    assert {"roc_auc", "pr_auc", "recall_at_1pct_fpr", "precision_at_top_1pct", "f1_at_default_threshold", "tp"} <= names


def test_sweep(scored):
    rows, df = scored
    for row in threshold_sweep(df, [0.9, 0.25, 0.5], review_cost=2.0).collect():
        flagged = [r for r in rows if r[1] >= row["threshold"]]
        missed = sum(r[3] for r in rows if r[2] and r[1] < row["threshold"])
        assert row["flagged"] == len(flagged) and row["caught"] == sum(r[2] for r in flagged)
        assert row["cost"] == pytest.approx(2.0 * (len(flagged) - row["caught"]) + missed)


@pytest.mark.parametrize("per_range", [ordering.ROWS_PER_RANGE, 37])
def test_quantiles_equal_linear_interpolation(spark, per_range):
    rng = np.random.default_rng(5)
    n = 2000
    data = {
        "a": rng.normal(0, 1, n),
        "b": np.where(np.arange(n) % 3 == 0, 7.0, rng.exponential(2, n)),
        "c": rng.integers(0, 2, n).astype(float),
        "d": np.full(n, 4.0),
    }
    rows = [tuple(float(data[k][i]) for k in data) for i in range(n)]
    df = spark.createDataFrame([*rows, (float("nan"), None, 1.0, 4.0)], "a double, b double, c double, d double")
    probabilities = [0.0, 0.01, 0.1, 0.35, 0.5, 0.99, 1.0]
    counts = ordering.materialize(ordering.value_counts(df, list(data)))
    found = {r["feature"]: r["quantiles"] for r in ordering.quantiles_of_counts(counts, probabilities, per_range).collect()}
    data["c"], data["d"] = np.append(data["c"], 1.0), np.append(data["d"], 4.0)
    for name, values in data.items():
        np.testing.assert_allclose(found[name], np.quantile(values, probabilities), rtol=0, atol=1e-12)


def test_running_sums_with_groups_and_both_directions(spark):
    rng = random.Random(9)
    rows = [(g, float(v), rng.randrange(5)) for g in ("x", "y", None) for v in rng.sample(range(-500, 500), 300)]
    df = ordering.materialize(spark.createDataFrame(rows, "g string, v double, n long"))
    for descending in (False, True):
        found = ordering.running_sums(df, "v", ["n"], by=["g"], descending=descending, rows_per_range=11).collect()
        assert len(found) == len(rows)
        for row in found:
            same = [r for r in rows if r[0] == row["g"]]
            upto = [r[2] for r in same if (r[1] >= row["v"] if descending else r[1] <= row["v"])]
            assert row["cum_n"] == sum(upto) and row["total_n"] == sum(r[2] for r in same)


def test_training_stats(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(100, 15, 1500), 2)
    df = spark.createDataFrame([(float(v), 3.0) for v in values], "x double, k double")
    found = {r["feature"]: r for r in training_stats(df, ["x", "k"]).collect()}
    assert found["x"]["mean"] == pytest.approx(values.mean())
    assert found["x"]["std"] == pytest.approx(values.std(ddof=1) + 1e-9)
    assert found["x"]["p01"] == pytest.approx(np.quantile(values, 0.01))
    assert found["x"]["p99"] == pytest.approx(np.quantile(values, 0.99))
    assert (found["k"]["std"], found["k"]["p01"]) == (1e-9, 3.0)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("small", [1, 50, 10_000])
def test_cut_is_exact_with_a_third_of_rows_at_one_instant(spark, kind, small):
    rng = random.Random(4)
    base = 1_700_000_000_000_000
    rows = [(base if i % 3 == 0 else base + rng.randrange(-(10**9), 10**9), f"T{rng.randrange(10**7):x}") for i in range(900)]
    df = spark.createDataFrame(rows, "k long, transaction_id string")
    df = df.select(F.timestamp_micros("k").cast(kind).alias("timestamp"), "k", "transaction_id").repartition(5)
    order = sorted(rows)
    for rank in (1, 290, 450, 600, 899, 900):
        cut = ordering.find_cut(df, F.col("k"), F.col("transaction_id"), rank, stamps_between(df.schema["timestamp"].dataType), small=small, bins=8)
        assert (cut.number, cut.text) == order[rank - 1]


def test_split_filter_reaches_the_scan(spark):
    from cardwatch.session import scratch_path

    path = scratch_path(spark, "stamped")
    spark.range(100).selectExpr("timestamp_seconds(id) AS timestamp", "lpad(id, 4, '0') AS transaction_id").write.parquet(path)
    df = spark.read.schema("timestamp timestamp, transaction_id string").parquet(path)
    split = plan_split(df)
    for part, size in ((split.is_train(), 80), (split.is_test(), 20)):
        rows = df.filter(part)
        assert rows.count() == size
        assert "PushedFilters: [Or(" in rows._jdf.queryExecution().executedPlan().toString()


def test_split_sizes_do_not_depend_on_order(spark):
    rows = [(i // 4, f"T{i:04d}", i % 5 == 0) for i in range(1003)]
    random.Random(8).shuffle(rows)
    df = spark.createDataFrame(rows, "s long, transaction_id string, is_fraud boolean")
    df = df.withColumn("timestamp", F.timestamp_seconds("s"))
    expected = {f"T{i:04d}": "fit" if i < int(802 * 0.85) else "val" if i < 802 else "test" for i in range(1003)}
    for parts in (1, 6):
        found = add_split(df.repartition(parts), 0.2, 0.15).select("transaction_id", "split").collect()
        assert {r[0]: r[1] for r in found} == expected
