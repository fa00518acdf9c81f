from __future__ import annotations

import numpy as np
import pytest

from cardwatch.operators import drift


def _psi(expected, actual, bins=10, eps=1e-6):
    expected, actual = expected[~np.isnan(expected)], actual[~np.isnan(actual)]
    edges = np.unique(np.quantile(expected, np.linspace(0, 1, bins + 1)))
    if len(edges) <= 2:
        return 0.0
    inner = edges[1:-1]
    size = len(inner) + 1
    e = np.bincount(np.searchsorted(inner, expected, side="right"), minlength=size) / len(expected) + eps
    a = np.bincount(np.searchsorted(inner, actual, side="right"), minlength=size) / len(actual) + eps
    return float(((a - e) * np.log(a / e)).sum())


def test_psi_of_many_shapes(spark):
    rng = np.random.default_rng(0)
    n = 3000
    old = {
        "same": rng.normal(0, 1, n),
        "shift": rng.normal(0, 1, n),
        "counts": rng.poisson(3, n).astype(float),
        "third": np.where(np.arange(n) % 3 == 0, 5.0, rng.exponential(4, n)),
        "flag": rng.integers(0, 2, n).astype(float),
        "constant": np.full(n, 2.0),
        "holes": np.where(np.arange(n) % 7 == 0, np.nan, rng.normal(3, 1, n)),
    }
    new = {
        **old,
        "shift": rng.normal(2, 1, n),
        "counts": rng.poisson(4, n).astype(float),
        "third": rng.exponential(4, n),
        "holes": rng.normal(3.2, 1, n),
    }
    names = list(old)
    schema = ", ".join(f"{name} double" for name in names)

    def frame(data):
        return spark.createDataFrame([tuple(float(data[c][i]) for c in names) for i in range(n)], schema).repartition(4)

    found = {r["feature"]: r for r in drift.with_level(drift.psi(frame(old), frame(new), names)).collect()}
    for name in names:
        assert found[name]["psi"] == pytest.approx(_psi(old[name], new[name]), abs=1e-9), name
    assert found["same"]["psi"] < 1e-6
    assert found["shift"]["psi"] > 0.25 and found["shift"]["level"] == "major"
    assert found["flag"]["psi"] == 0.0 and found["constant"]["psi"] == 0.0


def test_empty_side_is_zero(spark):
    schema = "x double"
    empty = spark.createDataFrame([], schema)
    some = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], schema)
    assert drift.psi(empty, some, ["x"]).collect() == [("x", 0.0)]
    assert drift.psi(some, empty, ["x"]).collect() == [("x", 0.0)]


def test_levels_at_their_limits(spark):
    df = spark.createDataFrame([(0.0999,), (0.10,), (0.25,), (0.2501,)], "psi double")
    assert [r["level"] for r in drift.with_level(df).collect()] == ["stable", "moderate", "moderate", "major"]
