from __future__ import annotations

import sys
from datetime import UTC, datetime
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from cardwatch.session import local_session  # noqa: E402
from cardwatch.sources.config import load_rules  # noqa: E402
from cardwatch.sources.schemas import TRANSACTION  # noqa: E402

SMALL = "/root/testdata/sf0.001"

_BY_TYPE = {"string": "x-{}", "int": 100, "double": 32.0, "boolean": False, "timestamp": datetime(2023, 11, 8, 12, tzinfo=UTC)}


def plain() -> dict:
    """A row that no shipped rule mentions: one value per type, and the shortest allowed where the contract wants a code."""
    kinds = {f.name: f.dataType.simpleString() for f in TRANSACTION.fields}
    row = {name: _BY_TYPE[kind].format(name[:20]) if kind == "string" else _BY_TYPE[kind] for name, kind in kinds.items()}
    counts = {name: 0 for name in row if name.startswith(("n_tx", "distinct"))}
    return row | counts | {"currency": "CHF", "channel": "POS", "merchant_mcc": "0000", "merchant_country": "AA", "card_country": "AA"}


def _hour(hour: int) -> dict:
    return {"timestamp": plain()["timestamp"].replace(hour=hour)}


# Per condition: the changes that just meet it, and those that just miss it, given the rule's value.
EDGES = {
    "amount_gte": lambda v: ({"amount": float(v)}, {"amount": v - 0.01}),
    # With a deviation of 2 and a mean of 0 the score is half the amount.
    "amount_zscore_30d_gte": lambda v: (
        {"amount": 2.0 * v, "amount_avg_30d": 0.0, "amount_std_30d": 2.0},
        {"amount": 2.0 * v - 0.01, "amount_avg_30d": 0.0, "amount_std_30d": 2.0},
    ),
    "n_tx_last_1h_gte": lambda v: ({"n_tx_last_1h": v}, {"n_tx_last_1h": v - 1}),
    "distinct_countries_last_24h_gte": lambda v: ({"distinct_countries_last_24h": v}, {"distinct_countries_last_24h": v - 1}),
    "card_age_days_lt": lambda v: ({"card_age_days": v - 1}, {"card_age_days": v}),
    "is_cnp": lambda v: ({"is_cnp": v}, {"is_cnp": not v}),
    "channel_in": lambda v: ({"channel": v[0]}, {"channel": "MOTO"}),
    "mcc_in": lambda v: ({"merchant_mcc": str(v[0])}, {"merchant_mcc": "0001"}),
    "hour_between": lambda v: (_hour(v[0]), _hour(v[1] + 1)),
    "geo_mismatch": lambda v: ({"merchant_country": "BB" if v else "AA"}, {"merchant_country": "AA" if v else "BB"}),
}
SHIPPED = {rule.code: rule for rule in load_rules()}


def at_edges(code: str) -> tuple[dict, list[dict]]:
    """The row that just meets all conditions of a shipped rule, and one row per condition that misses just that one."""
    changes = [EDGES[name](value) for name, value in SHIPPED[code].when.items()]
    met = plain() | {"transaction_id": code}
    for hit, _ in changes:
        met |= hit
    return met, [met | miss | {"transaction_id": f"{code} without {i}"} for i, (_, miss) in enumerate(changes)]


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Rows given as dicts of a transaction's fields."""

    def make(*rows: dict):
        names = TRANSACTION.fieldNames()
        return spark.createDataFrame([tuple(row[name] for name in names) for row in rows], TRANSACTION)

    return make
