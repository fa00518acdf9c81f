"""A large set of threshold rules as an index: breakpoints per field, and which rules hold between two of them.

A rule is a conjunction of conditions ``field >= bound`` and ``field < bound``. Per field and comparison the bounds are
sorted, so the rules that a value satisfies are a head or a tail of that order, found by binary search. Bitmaps of
every STEP-th head are kept and completed by the few rules in between. A row ANDs one bitmap per field and
comparison; what is left are its rules. The work per row follows the number of fields and bits, not of conditions.

An index goes to every task, so its size is bounded. ``hit_summary`` takes rule tables of any size: rules and rows meet in
cells of the field that parts them best, and each cell's rules are an index of their own, made where the rows are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.session import materialize

#: Rules between two kept bitmaps, bitmap bytes that a task holds at once, and conditions and bytes of an index at most.
STEP = 1024
CHUNK_BYTES = 32 << 20
MAX_CONDITIONS = 2_000_000
MAX_BYTES = 512 << 20
#: Of tables without that bound: points or rules per cell aimed at, cells, and the most points and rules of one group.
CELL_ROWS = 8192
MAX_CELLS = 1 << 14
GROUP_ROWS = 1 << 16


class Order:
    """One field and comparison: bounds in order, and the rules that have them."""

    def __init__(self, field: str, op: str, bounds: np.ndarray, rules: np.ndarray, n_rules: int) -> None:
        self.field, self.op = field, op
        by = np.argsort(bounds, kind="stable")
        self.bounds, self.rules = bounds[by], rules[by]
        free = np.ones(n_rules, bool)
        free[rules] = False  # rules without such a condition hold whatever the value
        self.free = _packed(free)
        heads = []
        for at in range(0, len(self.rules) + 1, STEP):
            holds = free.copy()
            holds[self.rules[:at] if op == "ge" else self.rules[at:]] = True
            heads.append(_packed(holds))
        self.heads = np.stack(heads)

    @property
    def size(self) -> int:
        return self.bounds.nbytes + self.rules.nbytes + self.heads.nbytes

    def bitmaps(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of the values' different places in the order, and which of them each value has; NaN holds no condition."""
        missing = np.isnan(values)
        places = np.where(missing, -1, np.searchsorted(self.bounds, values, side="right"))
        different, which = np.unique(places, return_inverse=True)
        out = np.empty((len(different), self.heads.shape[1]), np.uint64)
        for i, place in enumerate(different.tolist()):
            if place < 0:
                out[i] = self.free
                continue
            head = place // STEP
            out[i] = self.heads[head]
            between = self.rules[head * STEP : place]
            bits = np.uint64(1) << (between & 63).astype(np.uint64)
            if self.op == "ge":
                np.bitwise_or.at(out[i], between >> 6, bits)
            else:
                np.bitwise_and.at(out[i], between >> 6, ~bits)
        return out, which


def _packed(flags: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(flags) // 64) * 64, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


class RuleIndex:
    """Conditions as (code, field, op, bound), one per code, field and op."""

    def __init__(self, conditions: Sequence[tuple[str, str, str, float]]) -> None:
        self.codes = sorted({c[0] for c in conditions})
        number = {code: i for i, code in enumerate(self.codes)}
        grouped: dict[tuple[str, str], list[tuple[int, float]]] = {}
        for code, field, op, bound in conditions:
            grouped.setdefault((field, op), []).append((number[code], bound))
        self.orders = []
        for (field, op), items in sorted(grouped.items()):
            rules, bounds = (np.array(x) for x in zip(*items, strict=True))
            self.orders.append(Order(field, op, bounds.astype(float), rules.astype(np.int64), len(self.codes)))
            if self.size > MAX_BYTES:
                raise ValueError(f"the rule index passes {MAX_BYTES} bytes")

    @classmethod
    def from_columns(cls, codes: pa.Array, bounds: dict[tuple[str, str], np.ndarray]) -> RuleIndex:
        """The index of one rule per place: its code, and per field and op its bound, NaN where it has none."""
        by = pc.sort_indices(codes)
        place = np.empty(len(codes), np.int64)
        place[by.to_numpy()] = np.arange(len(codes))
        index = cls(())
        index.codes = codes.take(by)
        for (field, op), values in sorted(bounds.items()):
            known = ~np.isnan(values)
            if known.any():
                index.orders.append(Order(field, op, values[known], place[known], len(codes)))
        return index

    @property
    def size(self) -> int:
        return sum(order.size for order in self.orders) + sum(map(len, self.codes))

    @property
    def fields(self) -> list[str]:
        return sorted({order.field for order in self.orders})

    def hits(self, columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(row, rule) of every rule that fires, by row, then by code."""
        rows, rules = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for low, left in self._left(columns):
            row, word = np.nonzero(left)
            bits = np.unpackbits(left[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, bit = np.nonzero(bits)
            rows.append(row[at] + low)
            rules.append(word[at] * 64 + bit)
        return np.concatenate(rows), np.concatenate(rules)

    def summary(self, columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Per row the number of rules that fire, and the last of them by code, -1 where there is none."""
        counts, last = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for _, left in self._left(columns):
            counts.append(np.bitwise_count(left).sum(axis=1, dtype=np.int64))
            word = left.shape[1] - 1 - (left[:, ::-1] != 0).argmax(axis=1)
            highest = np.unpackbits(left[np.arange(len(left)), word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            last.append(np.where(counts[-1] > 0, word * 64 + 63 - highest[:, ::-1].argmax(axis=1), -1))
        return np.concatenate(counts), np.concatenate(last)

    def _left(self, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, bitmaps of the rules that fire) per chunk of rows."""
        n = len(next(iter(columns.values())))
        step = max(1, CHUNK_BYTES // (8 * -(-len(self.codes) // 64)))
        for low in range(0, n, step):
            left: np.ndarray | None = None
            for order in self.orders:
                maps, which = order.bitmaps(columns[order.field][low : low + step])
                left = maps[which] if left is None else np.bitwise_and(left, maps[which], out=left)
            yield low, left


def strictest(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The conditions (code, field, op, bound) of a table: of several bounds of one code, field and comparison the strictest.

    Unknown fields, other comparisons and bounds that are no numbers are refused.
    """
    bound = F.col("bound").cast("double")
    wrong = ~F.coalesce(F.col("field").isin(list(columns)) & F.col("op").isin("ge", "lt") & ~F.isnan(bound) & F.col("code").isNotNull(), F.lit(False))
    bad = table.filter(wrong | bound.isNull()).select("code", "field", "op", "bound").head(1)
    if bad:
        raise ValueError(f"not a condition on these columns: {bad[0]}")
    least = F.when(F.col("op") == "ge", F.max(bound)).otherwise(F.min(bound))
    return table.groupBy("code", "field", "op").agg(least.alias("bound"))


def index_from_table(table: DataFrame, columns: Sequence[str], max_conditions: int = MAX_CONDITIONS) -> RuleIndex:
    """The index of the ``strictest`` conditions of a table.

    A table beyond ``max_conditions`` (counted before anything is read) is refused: an index goes to every task.
    ``hit_summary`` has no such limit.
    """
    conditions = strictest(table, columns)
    if (size := conditions.count()) > max_conditions:
        raise ValueError(f"{size} conditions; an index holds {max_conditions}")
    return RuleIndex([tuple(row) for row in conditions.toLocalIterator()])


def index_hits(spark: SparkSession, index: RuleIndex) -> Column:
    """Codes, in order, of the rules that fire on a row of the index's fields. Null and NaN fail every condition."""
    if not index.codes:
        return F.array().cast("array<string>")
    shared = spark.sparkContext.broadcast(index)
    fields = index.fields

    def find(batches: Iterator[tuple[pa.Array, ...]] | Iterator[pa.Array]) -> Iterator[pa.Array]:
        codes = pa.array(shared.value.codes)
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            values = [c.fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in columns]
            rows, rules = shared.value.hits(dict(zip(fields, values, strict=True)))
            bounds = np.searchsorted(rows, np.arange(len(values[0]) + 1)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(bounds), codes.take(pa.array(rules)))

    if len(fields) == 1:
        def find_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return find(batches)

        return F.arrow_udf(find_one, "array<string>")(F.col(fields[0]).cast("double"))

    def find_all(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return find(batches)

    return F.arrow_udf(find_all, "array<string>")(*[F.col(name).cast("double") for name in fields])


class Cells:
    """Cells of one field's values as the leaves of a binary tree. Node 1 is the root, leaf i is ``n + i``, 0 takes missing values.

    A rule lies at the fewest nodes that make up its cells, two per level at most; a value asks its leaf and the nodes above.
    """

    def __init__(self, edges: np.ndarray, n: int) -> None:
        self.edges, self.n = edges, n

    def leaves(self, values: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(values), 0, self.n + np.searchsorted(self.edges, values, side="right"))

    def span(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last cell with values from ``low`` to below ``high``; NaN is no bound."""
        first = np.where(np.isnan(low), 0, np.searchsorted(self.edges, low, side="right"))
        return first, np.where(np.isnan(high), self.n - 1, np.searchsorted(self.edges, high, side="left"))

    def nodes(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rule, node) of all rules; those without a bound hold for missing values too."""
        first, last = self.span(low, high)
        a, b = first + self.n, last + self.n + 1
        free = np.flatnonzero(np.isnan(low) & np.isnan(high))
        rules, nodes = [free], [np.zeros(len(free), np.int64)]
        while (live := a < b).any():
            for at, node in ((live & (a % 2 == 1), a), (live & (b % 2 == 1), b - 1)):
                rules.append(np.flatnonzero(at))
                nodes.append(node[at])
            a, b = (a + 1) // 2, b // 2
        return np.concatenate(rules), np.concatenate(nodes)

    def above(self, leaves: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, node) for each leaf and the nodes above it that have rules."""
        values, nodes = [], []
        node = leaves
        for _ in range(self.n.bit_length()):
            at = used[node] & ((node > 0) | (leaves == 0))
            values.append(np.flatnonzero(at))
            nodes.append(node[at])
            leaves, node = np.where(leaves == 0, -1, leaves), node // 2
        return np.concatenate(values), np.concatenate(nodes)


def _doubles(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(float) if isinstance(batch, pa.RecordBatch) else batch.column(name).to_numpy().astype(float)


def _copies(batch: pa.RecordBatch, at: np.ndarray, node: np.ndarray, own: np.ndarray, others: np.ndarray, own_name: str, other_name: str) -> pa.RecordBatch:
    """The lines ``at`` with their nodes: each in one of ``own`` shares of its kind, once per share of the other kind."""
    share = batch.column("h").to_numpy()[at] % own[node]
    times = others[node]
    start = np.repeat(np.cumsum(times) - times, times)
    lines = batch.take(pa.array(np.repeat(at, times))).drop_columns(["h"])
    extra = {"node": np.repeat(node, times), own_name: np.repeat(share, times), other_name: np.arange(len(start)) - start}
    return pa.RecordBatch.from_pydict({n: lines.column(n) for n in lines.schema.names} | {n: pa.array(v, pa.int64()) for n, v in extra.items()})


def hit_summary(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Adds n_hits and last_code: how many rules of a table (code, field, op, bound) fire on a row, and the last of them by code.

    Neither rules nor rows are bounded. Rows with the same values of all fields are one point. Rules and points are dealt by
    cells of the field on which rules cover the fewest cells, groups of at most about GROUP_ROWS of each meet in one
    task, and the answers of a point are put together. The driver sees cuts and counts per cell. Null and NaN fail every condition.
    """
    conditions = strictest(table, rows.columns)
    fields = [row["field"] for row in conditions.select("field").distinct().orderBy("field").collect()]
    if not fields:
        return rows.withColumns({"n_hits": F.lit(0).cast("long"), "last_code": F.lit(None).cast("string")})
    sides = [(i, op) for i in range(len(fields)) for op in ("ge", "lt")]
    bounds = [F.max(F.when((F.col("field") == fields[i]) & (F.col("op") == op), F.col("bound"))).alias(f"{op}{i}") for i, op in sides]
    rules = materialize(conditions.groupBy("code").agg(*bounds).withColumn("h", F.pmod(F.xxhash64("code"), F.lit(1 << 40))))
    names = [f"_p{i}" for i in range(len(fields))]
    # Zeros of both signs are one point, as are missing values of both kinds.
    at = {p: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double") + 0.0) for p, f in zip(names, fields, strict=True)}
    points = rows.select(*[value.alias(p) for p, value in at.items()]).distinct()
    points = materialize(points.withColumn("h", F.pmod(F.xxhash64(*names), F.lit(1 << 40))))

    n_points, n_rules = points.count(), rules.count()
    n = 1 << min(MAX_CELLS.bit_length() - 1, (max(n_points, n_rules) // CELL_ROWS).bit_length())
    shares = [i / n for i in range(1, n)] or [0.5]
    cuts = points.agg(*[F.percentile_approx(p, shares, max(10_000, 10 * n)).alias(p) for p in names]).first()
    cells = [Cells(np.unique(np.array(cuts[p] or [], float))[: n - 1], n) for p in names]

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [c.span(_doubles(batch, f"ge{i}"), _doubles(batch, f"lt{i}")) for i, c in enumerate(cells)]
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(cells)), "n": [int(np.maximum(0, b - a + 1).sum()) for a, b in spans]})

    best = rules.mapInArrow(covered, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).orderBy("n", "i").first()["i"]
    tree = cells[best]

    def lie(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            yield batch, *tree.nodes(_doubles(batch, f"ge{best}"), _doubles(batch, f"lt{best}"))

    def counted(nodes: np.ndarray) -> pa.RecordBatch:
        node, n = np.unique(nodes, return_counts=True)
        return pa.RecordBatch.from_pydict({"node": node.astype(np.int64), "n": n.astype(np.int64)})

    def count_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, nodes in lie(batches):
            yield counted(nodes)

    def count_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield counted(tree.leaves(_doubles(batch, names[best])))

    def per_node(found: DataFrame) -> np.ndarray:
        out = np.zeros(2 * n, np.int64)
        for row in found.groupBy("node").agg(F.sum("n").alias("n")).collect():
            out[row["node"]] = row["n"]
        return out

    rules_at = per_node(rules.mapInArrow(count_rules, "node long, n long"))
    points_at = per_node(points.mapInArrow(count_points, "node long, n long"))
    for node in range(n - 1, 0, -1):
        points_at[node] = points_at[2 * node] + points_at[2 * node + 1]
    used = (rules_at > 0) & (points_at > 0)
    parts, blocks = (np.where(used, -(-x // GROUP_ROWS), 0) for x in (points_at, rules_at))

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rule, node in lie(batches):
            kept = used[node]
            yield _copies(batch, rule[kept], node[kept], blocks, parts, "block", "part")

    def deal_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            point, node = tree.above(tree.leaves(_doubles(batch, names[best])), used)
            yield _copies(batch, point, node, parts, blocks, "part", "block")

    bound_names = [f"{op}{i}" for i, op in sides]
    dealt_rules = rules.mapInArrow(deal_rules, f"code string, {', '.join(f'{b} double' for b in bound_names)}, node long, block long, part long")
    dealt_points = points.mapInArrow(deal_points, f"{', '.join(f'{p} double' for p in names)}, node long, part long, block long")

    def meet(rules: pa.Table, points: pa.Table) -> pa.Table:
        own = points.select(names)
        if not len(rules) or not len(points):
            return own.slice(0, 0).append_column("n_hits", pa.array([], pa.int64())).append_column("last_code", pa.array([], pa.string()))
        index = RuleIndex.from_columns(rules.column("code").combine_chunks(), {(names[i], op): _doubles(rules, f"{op}{i}") for i, op in sides})
        counts, last = index.summary({p: _doubles(points, p) for p in names})
        codes = index.codes.take(pa.array(last, mask=last < 0))
        return own.append_column("n_hits", pa.array(counts)).append_column("last_code", codes)

    key = ("node", "part", "block")
    answers = dealt_rules.groupBy(*key).cogroup(dealt_points.groupBy(*key)).applyInArrow(meet, f"{', '.join(f'{p} double' for p in names)}, n_hits long, last_code string")
    found = answers.groupBy(*names).agg(F.sum("n_hits").alias("n_hits"), F.max("last_code").alias("last_code"))
    here, there = rows.withColumns(at).alias("here"), found.alias("there")
    same = [F.col(f"here.{p}").eqNullSafe(F.col(f"there.{p}")) for p in names]
    joined = here.join(there, same, "left").select(*[F.col(f"here.{c}") for c in rows.columns], "there.n_hits", "there.last_code")
    return joined.withColumn("n_hits", F.coalesce("n_hits", F.lit(0).cast("long")))
