"""Declarative rules compiled to column expressions.

A predicate is a function ``(fields, value) -> Column`` under a name; a rule joins predicates with
AND. All rules of a set are evaluated in one projection, and Catalyst shares what they have in
common. A condition that comes out null does not fire.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.functions.numeric import all_of
from cardwatch.sources.schemas import RULE_HIT, SEVERITIES


class Fields:
    """Columns of the row under test; a column that the table lacks reads as the given default."""

    def __init__(self, names: Sequence[str]):
        self.names = set(names)

    def get(self, name: str, default: Any = 0) -> Column:
        return F.col(name) if name in self.names else F.lit(default)

    def number(self, name: str) -> Column:
        return self.get(name).cast("double")


Predicate = Callable[[Fields, Any], Column]


def at_least(name: str) -> Predicate:
    # NaN sorts above every number in Spark, but is at least nothing.
    return lambda fields, bound: (fields.number(name) >= float(bound)) & ~F.isnan(fields.number(name))


def below(name: str) -> Predicate:
    return lambda fields, bound: fields.number(name) < float(bound)


def is_true(name: str) -> Predicate:
    return lambda fields, wanted: F.coalesce(fields.get(name, False).cast("boolean"), F.lit(False)) == bool(wanted)


def one_of(name: str) -> Predicate:
    return lambda fields, values: fields.get(name, "").cast("string").isin([str(value) for value in values])


def within(name: str) -> Predicate:
    """Both ends included; a low end above the high end matches nothing."""

    def build(fields: Fields, bounds: Any) -> Column:
        low, high = bounds
        return fields.number(name).between(float(low), float(high))

    return build


def countries_differ(fields: Fields, wanted: Any) -> Column:
    merchant = F.upper(fields.get("merchant_country", "").cast("string"))
    card = F.upper(fields.get("card_country", "").cast("string"))
    return (~merchant.eqNullSafe(card)) == bool(wanted)


PREDICATES: dict[str, Predicate] = {
    "amount_gte": at_least("amount"),
    "amount_zscore_30d_gte": at_least("amount_zscore_30d"),
    "n_tx_last_1h_gte": at_least("n_tx_last_1h"),
    "distinct_countries_last_24h_gte": at_least("distinct_countries_last_24h"),
    "card_age_days_lt": below("card_age_days"),
    "is_cnp": is_true("is_cnp"),
    "channel_in": one_of("channel"),
    "mcc_in": one_of("merchant_mcc"),
    "hour_between": within("hour"),
    "geo_mismatch": countries_differ,
}


def register_predicate(name: str, predicate: Predicate) -> None:
    PREDICATES[name] = predicate


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str
    description: str
    when: dict[str, Any] = field(default_factory=dict)


def check_rules(rules: Sequence[Rule]) -> list[Rule]:
    """A misspelt predicate or severity is an error here, not a rule that never fires."""
    for rule in rules:
        if rule.severity not in SEVERITIES:
            raise ValueError(f"rule {rule.code}: unknown severity {rule.severity!r}")
        unknown = [name for name in rule.when if name not in PREDICATES]
        if unknown:
            raise ValueError(f"rule {rule.code}: unknown predicates {unknown}")
    return list(rules)


def rule_condition(rule: Rule, fields: Fields) -> Column:
    tests = [PREDICATES[name](fields, value) for name, value in rule.when.items()]
    return F.coalesce(all_of(tests), F.lit(False))


def rule_hits(rules: Sequence[Rule], columns: Sequence[str]) -> Column:
    """Array of (code, severity, description) of the rules that fire, in the order of the set."""
    fields = Fields(columns)
    hits = [
        F.when(
            rule_condition(rule, fields),
            F.struct(
                F.lit(rule.code).alias("code"),
                F.lit(rule.severity).alias("severity"),
                F.lit(rule.description).alias("description"),
            ),
        )
        for rule in check_rules(rules)
    ]
    if not hits:
        return F.from_json(F.lit("[]"), f"array<{RULE_HIT.simpleString()}>")
    return F.array_compact(F.array(*hits))


def apply_rules(df: DataFrame, rules: Sequence[Rule], column: str = "rule_hits") -> DataFrame:
    return df.withColumn(column, rule_hits(rules, df.columns))


def has_hard_block(hits: str | Column = "rule_hits") -> Column:
    return F.exists(hits, lambda hit: hit["severity"] == "HARD_BLOCK")


def hit_facts(df: DataFrame, keep: Sequence[str] = ("transaction_id",), column: str = "rule_hits") -> DataFrame:
    """One row per hit."""
    exploded = df.select(*keep, F.explode(column).alias("hit"))
    return exploded.select(*keep, "hit.code", "hit.severity", "hit.description")


def hit_counts(df: DataFrame, column: str = "rule_hits") -> DataFrame:
    return hit_facts(df, keep=(), column=column).groupBy("code", "severity").agg(F.count("*").alias("n_hits"))


def rules_table(spark, rules: Sequence[Rule]) -> DataFrame:
    """The rule set itself as a small table."""
    return spark.createDataFrame([(r.code, r.severity, r.description) for r in rules], RULE_HIT)
