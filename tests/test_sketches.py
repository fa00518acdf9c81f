"""Quantiles from sketches against sorting."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch.operators import sketches

NAMES = ["smooth", "heavy", "two", "flag", "none", "one"]
PROBABILITIES = [0.0, 0.01, 0.1, 0.25, 0.5, 0.777, 0.99, 1.0]


def _rows(n=6000):
    rng = np.random.default_rng(4)
    smooth = rng.normal(size=n) ** 3
    heavy = np.where(rng.random(n) < 0.4, 3.25, rng.random(n) * 10)
    two = np.where(np.arange(n) < n // 2, 0.0, 1.0)
    smooth[rng.random(n) < 0.1] = np.nan
    return [(float(s), float(h), float(t), int(i % 50 == 0), None, 7.0 if i == 5 else None, i) for i, (s, h, t) in enumerate(zip(smooth, heavy, two, strict=True))]


@pytest.fixture(scope="module")
def frame(spark):
    schema = "smooth double, heavy double, two double, flag int, none double, one double, i long"
    df = spark.createDataFrame(_rows(), schema).repartition(5)
    return df.withColumn("timestamp", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("i") * 60))


def _expected(rows):
    out = {}
    for place, name in enumerate(NAMES):
        values = [r[place] for r in rows if r[place] is not None and not math.isnan(r[place])]
        if values:
            out[name] = np.quantile(np.array(values, float), PROBABILITIES).tolist()
    return out


@pytest.mark.parametrize("few,off_by", [(2000, 0.01), (5, 0.01), (5, 0.0)])
def test_quantiles_are_those_of_the_sorted_values(frame, few, off_by):
    found = {r["feature"]: r["quantiles"] for r in sketches.exact_quantiles(frame, NAMES, PROBABILITIES, few=few, off_by=off_by).collect()}
    expected = _expected(_rows())
    assert set(found) == set(expected)
    for name, values in expected.items():
        assert found[name] == pytest.approx(values, abs=1e-12), name


def test_stored_days_merge_to_any_span(frame):
    stored = sketches.daily_sketches(frame, NAMES)
    assert {r["feature"] for r in stored.collect()} == set(NAMES) - {"none"}
    first = 1_700_000_000 // 86_400
    span = sketches.merged(stored.filter(F.col("day").between(first + 1, first + 2)))
    rows = frame.filter(F.floor(F.unix_seconds("timestamp") / 86_400).between(first + 1, first + 2))
    kept = [tuple(r)[:6] for r in rows.select(*NAMES).collect()]
    assert {r["feature"]: r["n"] for r in span.collect()}["two"] == len(kept) == 2880
    found = {r["feature"]: r["quantiles"] for r in sketches.exact_quantiles(rows, NAMES, PROBABILITIES, span).collect()}
    for name, values in _expected(kept).items():
        assert found[name] == pytest.approx(values, abs=1e-12), name


def test_tables_without_rows(frame):
    assert sketches.exact_quantiles(frame.limit(0), NAMES, PROBABILITIES).collect() == []
    assert sketches.daily_sketches(frame.limit(0), NAMES).collect() == []


def test_flags_and_counts_take_one_pass(frame, monkeypatch):
    """Parts whose rows are all equal need not be cut on; numbers of no limit to their digits take a second pass and a list."""
    passes = []
    counted = sketches._counted
    monkeypatch.setattr(sketches, "_counted", lambda df, features, cuts: passes.append(sorted(cuts)) or counted(df, features, cuts))
    found = {r["feature"]: r["quantiles"] for r in sketches.exact_quantiles(frame, NAMES, PROBABILITIES, few=50).collect()}
    expected = _expected(_rows())
    assert {name: found[name] for name in ("two", "flag", "one")} == {name: expected[name] for name in ("two", "flag", "one")}
    assert len(passes) <= 2 and all(NAMES[f] in ("smooth", "heavy") for later in passes[1:] for f in later)
