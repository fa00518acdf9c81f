"""Velocity of a stream from keyed state: no history table, no scan of the past.

State is kept per card and interval of time, at two levels: ten minutes keep their instants, 32 days keep the sums of
their ten minutes. A transaction adds itself once per level. A window [t - w, t) is made of the pieces that fit
it: instants up to the next full ten minutes at either end, and ten minutes between. A piece is one question to one
interval, and a window takes at most four. So a card with a large share of the stream is spread over its
intervals, none of which holds more than its own instants or 4,608 sums.

A call to the state costs far more than a line of an interval, and most cards have nothing in most ten minutes. So
ten minutes of all cards of a shard are one interval of state; cards are dealt to shards by hash.

An interval is dropped by a timer of event time once no window can reach it. Answers of one micro-batch are put
together per row. For data in order of time the result is that of ``add_velocity`` over everything seen so far.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from cardwatch.functions.numeric import micros
from cardwatch.operators.velocity import DAY, HOUR, MINUTE, MONTH, VELOCITY_COLUMNS, window_money, window_results
from cardwatch.streaming.jobs import with_event_time, write_batch

#: Length of an interval and of its children, by level, in microseconds.
LEVELS = ((10 * MINUTE, 1), (32 * DAY, 10 * MINUTE))
WINDOWS = (HOUR, DAY, MONTH)
#: Rows without a card or a time meet no state; they are spread over so many keys.
SPREAD = 64
#: Shards of cards unless given, and instants in ten minutes of a shard that are worth a call to its state.
SHARDS = 1024
INSTANTS = 32
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a session needs while such a query runs.
STATE_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKS}

_OUT = "row string, payload string, width int, n long, m long, s string, q string, countries array<string>"


def _down(x: Column, width: int) -> Column:
    return x - F.pmod(x, F.lit(width))


def _up(x: Column, width: int) -> Column:
    return x + F.pmod(-x, F.lit(width))


def pieces(low: Column, high: Column) -> list[Column]:
    """Structs (level, bucket, low, high), null where a piece is empty, that make up [low, high) without overlap.

    Both ends are instants up to a full ten minutes; what lies between touches two intervals of 32 days at most.
    """
    def piece(when: Column, level: int, start: Column, stop: Column) -> Column:
        width = LEVELS[level][0]
        bucket = (_down(start, width) / width).cast("long")
        fields = (F.lit(level).alias("level"), bucket.alias("bucket"), start.alias("low"), stop.alias("high"))
        return F.when(when & (start < stop), F.struct(*fields))

    up, down = _up(low, LEVELS[0][0]), _down(high, LEVELS[0][0])
    inside = up > down
    ends = [piece(inside, 0, low, high), piece(~inside, 0, low, up), piece(~inside, 0, down, high)]
    border = _down(up, LEVELS[1][0]) + LEVELS[1][0]
    return [*ends, piece(~inside, 1, up, F.least(down, border)), piece(~inside, 1, border, down)]


def shards_for(n_rows: int, micros_spanned: int) -> int:
    """Shards that hold about INSTANTS instants in ten minutes of a stream with so many rows in so much time."""
    return max(1, n_rows * LEVELS[0][0] // (INSTANTS * max(LEVELS[0][0], micros_spanned)))


def requests(df: DataFrame, card: str = "card_id", timestamp: str = "timestamp", shards: int = SHARDS) -> DataFrame:
    """Everything the state has to know of each row and to answer for it, one line each.

    ``part`` is the shard of ten minutes, the card itself of longer intervals.
    """
    k = micros(F.col(timestamp))
    placed = F.col(card).isNotNull() & k.isNotNull()
    rows = df.select(
        timestamp,
        F.col(card).cast("string").alias("card"),
        F.uuid().alias("row"),
        k.alias("k"),
        placed.alias("placed"),
        (window_money(F.col("amount")) * 1_000_000).cast("decimal(38,0)").cast("string").alias("money"),
        F.col("merchant_country").alias("country"),
        F.to_json(F.struct(*df.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("payload"),
    )
    k, none = F.col("k"), F.lit(None).cast("string")

    def line(level: Column, bucket: Column, child: Column | None, lows: list[Column | None], high: Column | None, payload: Column) -> Column:
        longs = {"bucket": bucket, "child": child, "high": high} | {f"low{i}": low for i, low in enumerate(lows)}
        fields = [(F.lit(None) if x is None else x).cast("long").alias(name) for name, x in longs.items()]
        return F.struct(level.cast("int").alias("level"), *fields, payload.alias("payload"))

    # A window is made of the end of an old ten minutes, long intervals, and what precedes the row in its own ten minutes.
    parts = [pieces(k - width, k) for width in WINDOWS]
    nothing: list[Column | None] = [None] * len(WINDOWS)
    short, long = ((_down(k, width) / width).cast("long") for width, _ in LEVELS)
    here = [F.when(near["bucket"] == long, near["low"]).otherwise(far["low"]) for *_, near, far in parts]
    before = [F.when(near["bucket"] < long, near["low"]) for *_, near, _ in parts]
    lines = [
        F.when(F.col("placed"), line(F.lit(0), short, k, nothing, None, F.col("payload"))),
        F.when(F.col("placed"), line(F.lit(1), long, _down(k, LEVELS[1][1]), here, _down(k, LEVELS[1][1]), none)),
        F.when(F.col("placed") & F.coalesce(*before).isNotNull(), line(F.lit(1), long - 1, None, before, long * LEVELS[1][0], none)),
    ]
    for number, (_, old, *_) in enumerate(parts):
        lows = [old["low"] if i == number else None for i in range(len(WINDOWS))]
        lines.append(F.when(F.col("placed") & old.isNotNull(), line(F.lit(0), old["bucket"], None, lows, old["high"], none)))
    spread = F.pmod(F.xxhash64("row"), F.lit(SPREAD))
    lines.append(F.when(~F.col("placed"), line(F.lit(-1), spread, None, nothing, None, F.col("payload"))))
    flat = rows.withColumn("line", F.explode(F.array_compact(F.array(*lines))))
    shard = F.pmod(F.xxhash64("card"), F.lit(shards)).cast("string")
    part = F.when(F.col("line.level") == 0, shard).when(F.col("line.level") > 0, F.col("card"))
    return flat.select(timestamp, part.alias("part"), "card", "row", "money", "country", "line.*")


class Intervals(StatefulProcessor):
    """An interval: per card sums per child, kept as text. Money is counted in millionths, as whole numbers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.children = handle.getValueState("children", "value string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        _, level, bucket = key
        given = list(rows)
        if level < 0:
            for row in given:
                yield _line(row["row"], row["payload"])
            return
        old = self.children.get()
        cards: dict[str, dict[int, list]] = {c: {int(k): v for k, v in own.items()} for c, own in json.loads(old[0]).items()} if old else {}
        changed = False
        for row in given:
            if row["child"] is None:
                continue
            changed = True
            child = cards.setdefault(row["card"], {}).setdefault(row["child"], [0, 0, 0, 0, []])
            child[0] += 1
            if row["money"] is not None:
                amount = int(row["money"])
                child[1], child[2], child[3] = child[1] + 1, child[2] + amount, child[3] + amount * amount
            if row["country"] is not None and row["country"] not in child[4]:
                child[4].append(row["country"])
        sums: dict[str, tuple[list, list]] = {}

        def total(card: str, low: int, high: int, countries: bool) -> tuple | None:
            own = cards[card]
            if card not in sums:
                order, running = sorted(own), [(0, 0, 0, 0)]
                for k in order:
                    running.append(tuple(a + b for a, b in zip(running[-1], own[k], strict=False)))
                sums[card] = order, running
            order, running = sums[card]
            a, b = bisect_left(order, low), bisect_left(order, high)
            if a >= b:
                return None
            n, m, s, q = (y - x for x, y in zip(running[a], running[b], strict=True))
            return n, m, _decimal(s, 6), _decimal(q, 12), sorted({c for k in order[a:b] for c in own[k][4]}) if countries else None

        for row in given:
            card = row["card"]
            if level == 0 and row["child"] is not None:
                yield _line(row["row"], row["payload"], total(card, bucket * LEVELS[0][0], row["child"], True))
            elif card in cards:
                for number, width in enumerate(WINDOWS):
                    low = row[f"low{number}"]
                    found = None if low is None else total(card, low, row["high"], width == DAY)
                    if found:
                        yield _line(row["row"], None, found, number)
        if changed:
            if old is None:
                # No window reaches back further than a month after the interval's end.
                self.handle.registerTimer((bucket + 1) * (LEVELS[level][0] // 1000) + MONTH // 1000 + 1)
            self.children.update((json.dumps(cards),))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.children.clear()
        return iter(())

    def close(self) -> None:
        pass


def _line(row: str, payload: str | None, found: tuple | None = None, width: int = -1) -> Row:
    """An answer for one window, or for all of them along with the row itself (width -1)."""
    n, m, s, q, countries = found or (0, 0, None, None, None)
    return Row(row=row, payload=payload, width=width, n=n, m=m, s=s, q=q, countries=countries)


def _decimal(value: int, digits: int) -> str:
    sign, value = ("-", -value) if value < 0 else ("", value)
    return f"{sign}{value // 10**digits}.{value % 10**digits:0{digits}d}"


def answers(df: DataFrame, delay: str, card: str = "card_id", timestamp: str = "timestamp", shards: int = SHARDS) -> DataFrame:
    """The stream of answers: one line per row and piece that has something to say, and one with the row itself."""
    timed = with_event_time(df.drop(*VELOCITY_COLUMNS), delay, timestamp)
    grouped = requests(timed, card, timestamp, shards).groupBy("part", "level", "bucket")
    return grouped.transformWithState(Intervals(), _OUT, "Append", "EventTime")


def put_together(lines: DataFrame, row_schema: Any) -> DataFrame:
    """Rows of one micro-batch with their velocity columns, from all their answers."""
    def total(name: str, number: int, kind: str) -> Column:
        return F.sum(F.when(F.col("width").isin(number, -1), F.col(name).cast(kind)))

    found = lines.groupBy("row").agg(
        F.max("payload").alias("payload"),
        total("n", 0, "long").alias("n_1h"),
        total("n", 1, "long").alias("n_24h"),
        total("m", 2, "long").alias("m_30d"),
        total("s", 2, "decimal(38,6)").alias("s_30d"),
        total("q", 2, "decimal(38,12)").alias("q_30d"),
        F.size(F.array_distinct(F.flatten(F.collect_list("countries")))).alias("c_24h"),
    )
    results = window_results({name: F.col(name) for name in ("n_1h", "n_24h", "m_30d", "s_30d", "q_30d", "c_24h")})
    rows = F.from_json("payload", row_schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return found.withColumn("_row", rows).select("_row.*", *[value.alias(name) for name, value in results.items()])


def velocity_writer(
    transactions: DataFrame, out_path: str, delay: str = "1 hour", card: str = "card_id", shards: int = SHARDS
) -> DataStreamWriter:
    """Velocity columns for each micro-batch, one folder per batch.

    Needs STATE_SETTINGS while it runs. Rows later than ``delay`` behind the newest are turned away; state is kept for a
    month and that delay. The stream must carry no amount that ``add_velocity`` refuses. ``shards`` (``shards_for``
    the expected rate) changes the time only; a checkpoint must be gone on with as many.
    """
    rows = with_event_time(transactions.drop(*VELOCITY_COLUMNS), delay)
    lines, schema = answers(transactions, delay, card, shards=shards), rows.schema

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(put_together(batch, schema), out_path, batch_id)

    return lines.writeStream.outputMode("append").foreachBatch(handle)
