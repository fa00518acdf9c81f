from __future__ import annotations

import json

import pytest
from conftest import plain
from pyspark.sql import functions as F

from cardwatch.operators.contract import FIELD_RULES, check_json, check_table, error_counts, quarantined_rows, valid_rows
from cardwatch.session import settings
from cardwatch.sources.tables import explode_batches, to_payload

PLAIN = plain()
BODY = {k: v for k, v in PLAIN.items() if k != "timestamp"} | {"timestamp": "2025-06-15T14:30:00Z"}


def _check(spark, *bodies):
    texts = [body if isinstance(body, str) else json.dumps(body) for body in bodies]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, value string")
    return check_json(df)


def _errors(spark, *bodies):
    rows = _check(spark, *bodies).orderBy("i").collect()
    return [[(e["field"], e["code"]) for e in row["errors"]] for row in rows]


def test_good_payload_with_defaults_and_offset(spark):
    optional = ("currency", "channel", "is_cnp", "n_tx_last_1h", "amount_avg_30d")
    short = {k: v for k, v in BODY.items() if k not in optional} | {"timestamp": "2025-06-15T16:30:00+02:00"}
    row = valid_rows(_check(spark, short)).first()
    assert (row["currency"], row["channel"], row["is_cnp"], row["n_tx_last_1h"], row["amount_avg_30d"]) == ("EUR", "POS", False, 0, 0.0)
    assert row["timestamp"].hour == 14 or row["timestamp"].astimezone().utctimetuple().tm_hour == 14


CASES = [
    ({"amount": -5}, [("amount", "range")]),
    ({"amount": 0}, [("amount", "range")]),
    ({"amount": 1_000_000}, [("amount", "range")]),
    ({"amount": 999_999.99}, []),
    ({"amount": "87.5"}, []),
    ({"amount": "abc"}, [("amount", "type_error")]),
    ({"amount": "NaN"}, [("amount", "range")]),
    ({"amount": None}, [("amount", "type_error")]),
    ({"currency": None}, [("currency", "type_error")]),
    ({"currency": "XXX"}, [("currency", "not_allowed")]),
    ({"channel": "pos"}, [("channel", "not_allowed")]),
    ({"transaction_id": "abc"}, [("transaction_id", "length")]),
    ({"transaction_id": "  abcd\t"}, []),
    ({"transaction_id": "  abc 　"}, [("transaction_id", "length")]),
    ({"transaction_id": "x" * 65}, [("transaction_id", "length")]),
    ({"card_id": "   "}, [("card_id", "length")]),
    ({"merchant_country": "FRA"}, [("merchant_country", "length")]),
    ({"merchant_mcc": "0000"}, []),
    ({"customer_age_days": "7"}, []),
    ({"customer_age_days": 7.0}, []),
    ({"customer_age_days": 7.5}, [("customer_age_days", "type_error")]),
    ({"customer_age_days": 2**40}, [("customer_age_days", "type_error")]),
    ({"n_tx_last_1h": -1}, [("n_tx_last_1h", "range")]),
    ({"is_cnp": "yes"}, []),
    ({"is_cnp": "off"}, []),
    ({"is_cnp": "perhaps"}, [("is_cnp", "type_error")]),
    ({"timestamp": 1_750_000_000}, []),
    ({"timestamp": "soon"}, [("timestamp", "type_error")]),
    ({"amount_std_30d": "NaN"}, [("amount_std_30d", "range")]),
    ({"colour": "red"}, [("colour", "unknown_field")]),
]


def test_field_checks(spark):
    found = _errors(spark, *[BODY | change for change, _ in CASES])
    for (change, expected), errors in zip(CASES, found, strict=True):
        assert errors == expected, change


def test_broken_payloads(spark):
    found = _errors(spark, "[1]", "{bad", "null", {"amount": -5, "transaction_id": "x"})
    assert found[:3] == [[("", "not_an_object")]] * 3
    assert ("amount", "range") in found[3] and ("transaction_id", "length") in found[3]
    assert ("card_id", "missing") in found[3] and ("currency", "missing") not in found[3]


def test_epoch_in_seconds_and_milliseconds(spark):
    rows = valid_rows(_check(spark, BODY | {"timestamp": 1_750_000_000}, BODY | {"timestamp": 1_750_000_000_000}))
    assert {r[0] for r in rows.select(F.unix_micros("timestamp")).collect()} == {1_750_000_000_000_000}


def test_every_row_comes_out_once(spark):
    checked = _check(spark, BODY, BODY | {"amount": -1}, "{", BODY | {"channel": "WEB"})
    good, bad = valid_rows(checked), quarantined_rows(checked)
    assert (good.count(), bad.count()) == (1, 3)
    assert "value" in bad.columns and "clean" not in bad.columns
    counts = {(r["field"], r["code"]): r["n_rows"] for r in error_counts(checked).collect()}
    assert counts == {("amount", "range"): 1, ("", "not_an_object"): 1, ("channel", "not_allowed"): 1}


def test_table_path(table):
    df = table(PLAIN, PLAIN | {"merchant_country": "fr", "currency": None, "customer_id": " C1 "}, PLAIN | {"amount": None})
    checked = check_table(df)
    rows = valid_rows(checked).collect()
    assert len(rows) == 2
    assert [r["merchant_country"] for r in rows] == ["AA", "FR"]
    assert {r["currency"] for r in rows} == {"CHF", "EUR"} and "C1" in {r["customer_id"] for r in rows}
    assert [(e["field"], e["code"]) for e in quarantined_rows(checked).first()["errors"]] == [("amount", "missing")]
    with pytest.raises(ValueError, match="outside the contract"):
        check_table(df.withColumn("colour", F.lit("red")))
    assert check_table(df.withColumn("is_fraud", F.lit(0)), carry=["is_fraud"]).count() == 3


def test_round_trip_and_batch_order(spark, table):
    rows = [PLAIN | {"transaction_id": f"TX_BATCH_{i}"} for i in range(5)]
    texts = [r["value"] for r in to_payload(table(*rows)).orderBy("transaction_id").collect()]
    body = '{"transactions":[' + ",".join(texts) + "]}"
    items = explode_batches(spark.createDataFrame([(1, body)], "request int, value string"))
    good = check_json(items).filter(F.size("errors") == 0).orderBy("pos").select("pos", "clean.transaction_id", "clean.amount").collect()
    assert [(r["pos"], r["transaction_id"], r["amount"]) for r in good] == [(i, f"TX_BATCH_{i}", 32.0) for i in range(5)]


def test_types_of_json_values(spark):
    changes = [
        {"timestamp": "14:30"}, {"timestamp": "2025-06"}, {"merchant_mcc": 5411}, {"card_id": True}, {"customer_id": {"a": 1}}, {"amount": "87.5f"},
    ]
    for change, errors in zip(changes, _errors(spark, *[BODY | c for c in changes]), strict=True):
        assert errors == [(next(iter(change)), "type_error")], change


def test_broken_requests_are_refused_not_lost(spark):
    bodies = ["{bad", '{"transactions": null}', '{"transactions": {}}', '{"transactions": []}', json.dumps({"transactions": [BODY]})]
    items = explode_batches(spark.createDataFrame(list(enumerate(bodies)), "request int, value string"))
    found = {r["request"]: len(r["errors"]) for r in check_json(items).select("request", "errors").collect()}
    assert found == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}


def test_each_json_field_is_looked_up_once(spark):
    with settings(spark, {"spark.sql.debug.maxToStringFields": "1000"}):
        plan = check_json(spark.createDataFrame([("{}",)], "value string"))._jdf.queryExecution().optimizedPlan().toString()
    # The value, whether it is there, and the type of texts.
    assert len(FIELD_RULES) <= plan.count("_fields#") - 1 <= 3 * len(FIELD_RULES)
