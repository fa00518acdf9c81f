"""The transaction contract: normalise, check, and set bad rows aside.

Both entrances, typed tables and JSON text, share the same field rules. Every row comes out once:
either clean, or in quarantine with its raw content and the list of (field, code) errors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.sources.schemas import CHANNELS, CURRENCIES, TRANSACTION

ERROR = "array<struct<field:string,code:string>>"


@dataclass(frozen=True)
class FieldRule:
    name: str
    kind: str  # text, number, whole, flag or time
    default: Any = None  # a field without default is required
    length: tuple[int, int] | None = None
    above: float | None = None
    at_least: float | None = None
    below: float | None = None
    allowed: Sequence[str] | None = None
    upper: bool = False


# Bounds and defaults of the contract.
FIELD_RULES = [
    FieldRule("transaction_id", "text", length=(4, 64)),
    FieldRule("timestamp", "time"),
    FieldRule("customer_id", "text", length=(1, 64)),
    FieldRule("card_id", "text", length=(1, 64)),
    FieldRule("amount", "number", above=0, below=1_000_000),
    FieldRule("currency", "text", default="EUR", allowed=CURRENCIES),
    FieldRule("merchant_id", "text", length=(1, 64)),
    FieldRule("merchant_country", "text", length=(2, 2), upper=True),
    FieldRule("merchant_mcc", "text", length=(4, 4)),
    FieldRule("card_country", "text", length=(2, 2), upper=True),
    FieldRule("channel", "text", default="POS", allowed=CHANNELS),
    FieldRule("is_cnp", "flag", default=False),
    FieldRule("customer_age_days", "whole", at_least=0),
    FieldRule("card_age_days", "whole", at_least=0),
    FieldRule("n_tx_last_1h", "whole", default=0, at_least=0),
    FieldRule("n_tx_last_24h", "whole", default=0, at_least=0),
    FieldRule("amount_avg_30d", "number", default=0.0, at_least=0),
    FieldRule("amount_std_30d", "number", default=0.0, at_least=0),
    FieldRule("distinct_countries_last_24h", "whole", default=0, at_least=0),
]


# The white space characters of Unicode.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)$"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends; plain ``trim`` knows blanks only."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def _time(raw: Column, source: T.DataType) -> Column:
    if not isinstance(source, T.StringType):
        return raw.cast("timestamp")
    text = strip(raw)
    seconds = text.try_cast("double")
    # Bare numbers are seconds since the epoch, or milliseconds when too large for seconds.
    epoch = F.when(F.abs(seconds) > 2e10, seconds / 1000.0).otherwise(seconds)
    is_number = text.rlike(r"^[+-]?\d+(\.\d+)?$")
    # A time of day alone would be read as one of today, a month alone as its first day.
    dated = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("timestamp"))
    return F.when(is_number, F.timestamp_micros((epoch * 1e6).cast("long"))).otherwise(dated)


def _flag(raw: Column, source: T.DataType) -> Column:
    if not isinstance(source, T.StringType):
        return raw.cast("boolean")
    text = F.lower(strip(raw))
    return F.when(text == "on", F.lit(True)).when(text == "off", F.lit(False)).otherwise(text.try_cast("boolean"))


def _convert(rule: FieldRule, raw: Column, source: T.DataType) -> Column:
    """The value in the contract's type, null if it cannot be read as one."""
    is_text = isinstance(source, T.StringType)
    if rule.kind == "text":
        return strip(raw.cast("string"))
    if rule.kind == "time":
        return _time(raw, source)
    if rule.kind == "flag":
        return _flag(raw, source)
    # Text such as "1f" is a number to the cast, but not to the contract.
    text = strip(raw) if is_text else raw
    number = F.when(text.rlike(NUMBER), text.try_cast("double")) if is_text else raw.try_cast("double")
    if rule.kind == "number":
        return number
    return F.when(number == F.floor(number), number.try_cast("int"))


def _broken(rule: FieldRule, value: Column) -> Column | None:
    """Name of the violated bound, null if none is."""
    tests: list[tuple[Column, str]] = []
    if rule.length:
        tests.append((~F.length(value).between(*rule.length), "length"))
    if rule.allowed:
        tests.append((~value.isin(list(rule.allowed)), "not_allowed"))
    if rule.kind == "number":
        # NaN passes "greater than" in Spark; it must not.
        tests.append((F.isnan(value), "range"))
    if rule.above is not None:
        tests.append((value <= rule.above, "range"))
    if rule.at_least is not None:
        tests.append((value < rule.at_least, "range"))
    if rule.below is not None:
        tests.append((value >= rule.below, "range"))
    if not tests:
        return None
    chain = F
    for condition, code in tests:
        chain = chain.when(condition, F.lit(code))
    return chain


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once per row.

    A filter on what is derived from them would otherwise be pushed below them, together with a
    copy of their expressions, and parse every row many times. The generator over the finished
    columns stops that.
    """
    kept = df.columns
    made = df.select("*", *[value.alias(f"{name}_") for name, value in columns.items()])
    row = F.struct(*[F.col(f"{name}_").alias(name) for name in columns])
    return made.select(*kept, F.inline(F.array(row)))


@dataclass(frozen=True)
class _Input:
    """Where a field comes from: its raw column, the type of that, and whether the row has it."""

    raw: Column
    source: T.DataType
    present: Column


def _checked(df: DataFrame, inputs: dict[str, _Input], extra: Column | None) -> DataFrame:
    """Adds ``clean`` (a struct in contract order) and ``errors``."""
    read = {f"_v_{rule.name}": _convert(rule, inputs[rule.name].raw, inputs[rule.name].source) for rule in FIELD_RULES}
    read |= {f"_p_{rule.name}": inputs[rule.name].present for rule in FIELD_RULES}
    df = _once(df, read)
    clean, errors = [], []
    for rule in FIELD_RULES:
        given, present = F.col(f"_v_{rule.name}"), F.col(f"_p_{rule.name}")
        value = given if rule.default is None else F.when(present, given).otherwise(F.lit(rule.default))
        value = F.upper(value) if rule.upper else value
        clean.append(value.cast(TRANSACTION[rule.name].dataType).alias(rule.name))
        absent = F.lit("missing") if rule.default is None else F.lit(None).cast("string")
        code = F.when(~present, absent).when(given.isNull(), F.lit("type_error"))
        broken = _broken(rule, given)
        code = code if broken is None else code.otherwise(broken)
        errors.append(F.when(code.isNotNull(), F.struct(F.lit(rule.name).alias("field"), code.alias("code"))))
    found = F.array_compact(F.array(*errors)).cast(ERROR)
    if extra is not None:
        found = F.concat(found, extra)
    return df.withColumns({"clean": F.struct(*clean), "errors": found}).drop(*read)


def check_table(df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Check typed columns; a null counts as absent. ``carry`` names other columns to keep."""
    known = {rule.name for rule in FIELD_RULES}
    unknown = [name for name in df.columns if name not in known and name not in carry]
    if unknown:
        raise ValueError(f"columns outside the contract: {unknown}")
    inputs = {}
    for rule in FIELD_RULES:
        if rule.name in df.columns:
            column = F.col(rule.name)
            inputs[rule.name] = _Input(column, df.schema[rule.name].dataType, column.isNotNull())
        else:
            inputs[rule.name] = _Input(F.lit(None).cast("string"), T.StringType(), F.lit(False))
    return _checked(df, inputs, None)


def check_json(df: DataFrame, column: str = "value") -> DataFrame:
    """Check JSON objects. Text may stand for any wanted type, but only text for text; an explicit null is an error."""
    names = [rule.name for rule in FIELD_RULES]
    # One parse gives the values with their JSON types and the keys that are there.
    parsed = _once(df, {"_fields": F.from_json(column, T.MapType(T.StringType(), T.VariantType()))})
    parsed = parsed.withColumn("_keys", F.map_keys("_fields"))
    inputs, given = {}, {}
    for rule in FIELD_RULES:
        value = F.col("_fields")[rule.name]
        raw = F.try_variant_get(value, "$", "string")
        if rule.kind == "text":
            raw = F.when(F.schema_of_variant(value) == "STRING", raw)
        given |= {f"_r_{rule.name}": raw, f"_h_{rule.name}": value.isNotNull()}
        inputs[rule.name] = _Input(F.col(f"_r_{rule.name}"), T.StringType(), F.col(f"_h_{rule.name}"))
    # A field is looked up once; its conversion mentions the text up to ten times.
    parsed = _once(parsed, given)
    unknown = F.array_except("_keys", F.array(*[F.lit(name) for name in names]))
    extra = F.transform(unknown, lambda name: F.struct(name.alias("field"), F.lit("unknown_field").alias("code")))
    broken = F.array(F.struct(F.lit("").alias("field"), F.lit("not_an_object").alias("code")))
    none = F.array().cast(ERROR)
    n_known = sum((F.col(f"_p_{name}").cast("int") for name in names), F.lit(0))
    checked = _checked(parsed, inputs, F.when(F.size("_keys") > n_known, extra).otherwise(none))
    errors = F.when(F.col("_keys").isNotNull(), F.col("errors")).otherwise(broken)
    return checked.withColumn("errors", errors).drop("_fields", "_keys", *given)


def valid_rows(checked: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    return checked.filter(F.size("errors") == 0).select(*carry, "clean.*")


def quarantined_rows(checked: DataFrame) -> DataFrame:
    """Raw content and errors of the refused rows."""
    return checked.filter(F.size("errors") > 0).drop("clean")


def error_counts(checked: DataFrame) -> DataFrame:
    errors = checked.select(F.explode("errors").alias("error")).select("error.field", "error.code")
    return errors.groupBy("field", "code").agg(F.count("*").alias("n_rows"))
