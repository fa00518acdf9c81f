"""The index of threshold rules against testing each rule on each row."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch.operators import rule_index
from cardwatch.operators.rule_index import RuleIndex, index_from_table, index_hits

FIELDS = ["a", "b", "c"]
TABLE = "code string, field string, op string, bound double"


def _conditions(rng, n):
    out = {}
    for i in range(n):
        for field, op in rng.sample([(f, op) for f in FIELDS for op in ("ge", "lt")], rng.randrange(1, 4)):
            out[f"R{i:06d}", field, op] = rng.choice([rng.randrange(20), rng.random() * 20, math.inf, -math.inf])
    return [(*key, float(bound)) for key, bound in out.items()]


def _fires(conditions, row):
    codes = {c[0] for c in conditions}
    for code, field, op, bound in conditions:
        value = row[field]
        ok = value is not None and not math.isnan(value) and (value >= bound if op == "ge" else value < bound)
        if not ok:
            codes.discard(code)
    return sorted(codes)


@pytest.mark.parametrize("step", [1, 7, 1024])
def test_index_equals_testing_every_rule(spark, monkeypatch, step):
    monkeypatch.setattr(rule_index, "STEP", step)
    monkeypatch.setattr(rule_index, "CHUNK_BYTES", 300)
    rng = random.Random(step)
    conditions = _conditions(rng, 150)
    rows = [{f: rng.choice([None, math.nan, float(rng.randrange(20)), rng.random() * 20]) for f in FIELDS} for _ in range(200)]
    index = RuleIndex(conditions)
    columns = {f: np.array([math.nan if r[f] is None else r[f] for r in rows], float) for f in FIELDS}
    at, rules = index.hits(columns)
    found = [[] for _ in rows]
    for i, rule in zip(at.tolist(), rules.tolist(), strict=True):
        found[i].append(index.codes[rule])
    assert found == [_fires(conditions, r) for r in rows]


def test_hundred_thousand_rules_leave_no_literal_in_the_plan(spark):
    n = 100_000
    table = spark.range(n).select(F.format_string("R%06d", "id").alias("code"), F.lit("a").alias("field"), F.lit("ge").alias("op"), F.col("id").cast("double").alias("bound"))
    more = table.withColumns({"op": F.lit("lt"), "bound": F.col("bound") + 3.0})
    index = index_from_table(table.unionByName(more), ["a"])
    df = spark.createDataFrame([(0.0,), (500.5,), (99_999.0,), (-1.0,), (None,)], "a double").select("a", index_hits(spark, index).alias("codes"))
    assert {r["a"]: r["codes"] for r in df.collect()} == {
        0.0: ["R000000"],
        500.5: ["R000498", "R000499", "R000500"],
        99_999.0: ["R099997", "R099998", "R099999"],
        -1.0: [],
        None: [],
    }
    plan = df._jdf.queryExecution().toString()
    assert len(plan) < 5_000 and "R000498" not in plan


def test_strictest_bound_counts_and_bad_tables_are_refused(spark):
    table = spark.createDataFrame([("X", "a", "ge", 1.0), ("X", "a", "ge", 5.0), ("X", "a", "lt", 9.0), ("X", "a", "lt", 7.0)], TABLE)
    index = index_from_table(table, FIELDS)
    rows = spark.createDataFrame([(float(v),) for v in range(10)], "a double").select("a", F.size(index_hits(spark, index)).alias("n"))
    assert [r["a"] for r in rows.orderBy("a").collect() if r["n"]] == [5.0, 6.0]
    for bad in [("X", "d", "ge", 1.0), ("X", "a", "eq", 1.0), ("X", "a", "ge", math.nan), ("X", "a", "ge", None), (None, "a", "ge", 1.0)]:
        with pytest.raises(ValueError, match="not a condition"):
            index_from_table(spark.createDataFrame([bad], TABLE), FIELDS)
    with pytest.raises(ValueError, match="an index holds"):
        index_from_table(table, FIELDS, max_conditions=1)
    empty = index_from_table(table.limit(0), FIELDS)
    assert rows.select(index_hits(spark, empty).alias("h")).first()["h"] == []


@pytest.mark.parametrize(("cell", "group"), [(8192, 65_536), (4, 5), (16, 1000)])
def test_summary_of_a_rule_table_of_any_size_equals_testing_every_rule(spark, monkeypatch, cell, group):
    monkeypatch.setattr(rule_index, "MAX_CONDITIONS", 1)
    monkeypatch.setattr(rule_index, "CELL_ROWS", cell)
    monkeypatch.setattr(rule_index, "GROUP_ROWS", group)
    rng = random.Random(cell)
    conditions = _conditions(rng, 150)
    rows = [(i, *[rng.choice([None, math.nan, -0.0, float(rng.randrange(20)), rng.random() * 20]) for _ in FIELDS]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    found = rule_index.hit_summary(df, spark.createDataFrame(conditions, TABLE)).collect()
    fires = {r[0]: _fires(conditions, dict(zip(FIELDS, r[1:], strict=True))) for r in rows}
    assert {r["id"]: (r["n_hits"], r["last_code"]) for r in found} == {i: (len(f), f[-1] if f else None) for i, f in fires.items()}
    assert len(found) == len(rows)
    none = rule_index.hit_summary(df, spark.createDataFrame(conditions, TABLE).limit(0)).collect()
    assert {(r["n_hits"], r["last_code"]) for r in none} == {(0, None)}
