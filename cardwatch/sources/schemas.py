"""Table schemas and the fixed vocabularies of the transaction contract."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the contract.
CURRENCIES = ["EUR", "USD", "GBP", "CHF", "JPY"]
CHANNELS = ["POS", "ECOM", "ATM", "MOTO"]
ACTIONS = ["APPROVE", "REVIEW", "DECLINE"]
SEVERITIES = ["HARD_BLOCK", "SUSPECT", "INFO"]

TRANSACTION = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("card_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("merchant_country", T.StringType()),
        T.StructField("merchant_mcc", T.StringType()),
        T.StructField("card_country", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("is_cnp", T.BooleanType()),
        T.StructField("customer_age_days", T.IntegerType()),
        T.StructField("card_age_days", T.IntegerType()),
        T.StructField("n_tx_last_1h", T.IntegerType()),
        T.StructField("n_tx_last_24h", T.IntegerType()),
        T.StructField("amount_avg_30d", T.DoubleType()),
        T.StructField("amount_std_30d", T.DoubleType()),
        T.StructField("distinct_countries_last_24h", T.IntegerType()),
    ]
)
TRANSACTION_FIELDS = TRANSACTION.fieldNames()

LABELLED = T.StructType(
    TRANSACTION.fields + [T.StructField("is_fraud", T.IntegerType()), T.StructField("fraud_pattern", T.StringType())]
)

RULE_HIT = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
