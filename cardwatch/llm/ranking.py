"""Ranked lexical search: the best documents of each item by an integer sum over shared terms.

A document is a vector of impacts over the terms of the items; an item is a vector of weights. The search is exact:

1. One pass counts, per document, its terms and those that any item has. It gives N, L and df, and the impacts.
2. Documents are dealt by range of their vector's length and cut into buckets of like length.
3. An item skips a bucket where its own length times the bucket's longest vector stays below the item's k-th best score
   so far (Cauchy-Schwarz). In other buckets the item's heaviest coordinates are looked at first: each
   leaves a range that a document's share of that coordinate must lie in, and together they bound the whole
   product by what is summed so far plus the lengths of the two rests.
4. Only survivors are summed over all terms, in 64-bit integers. Bounds only save work: they are taken with slack,
   and a document that could tie with the k-th is never skipped.

First each task looks at one bucket; the k-th best of those scores is every item's first bound. Items are taken in
blocks of bounded text, and each block's vocabulary goes to the tasks; documents are read once per block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from cardwatch.llm.common import written
from cardwatch.llm.tokens import NO_LETTERS, chunks, split_words

TOP = 10
#: Text of items, in characters, that goes into one block; a longer item makes a block alone.
BLOCK_CHARS = 4_000_000
#: Documents and impacts that a bucket may hold.
BUCKET_ROWS, BUCKET_IMPACTS = 4096, 2_000_000
#: Share of an item's squared length that its focus coordinates hold at least.
FOCUS = 0.5
_SLACK = 1e-9


@dataclass
class Item:
    """One item of a block: its terms as numbers of the block's vocabulary, its weights, greatest first."""

    item_id: object
    terms: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @property
    def length(self) -> float:
        return float(np.sqrt((self.weights.astype(float) ** 2).sum()))


def blocks(items: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[list[Row]]:
    """Items in blocks of ``limit`` characters; the driver holds one block and one partition of items at a time."""
    held, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        length = len(row["text"] or "")
        if held and size + length > limit:
            yield held
            held, size = [], 0
        held.append(row)
        size += length
    if held:
        yield held


def read_items(rows: list[Row]) -> tuple[pa.Array, list[Item]]:
    """The block's vocabulary and its items; a null text has no terms."""
    words = split_words(pa.array([r["text"] for r in rows], pa.string()), NO_LETTERS, lower=True)
    ends = np.cumsum(words.counts)
    return words.values, [Item(r["item_id"], np.unique(words.codes[e - n : e])) for r, e, n in zip(rows, ends, words.counts, strict=True)]


def term_counts(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(at, doc_id, n, terms, times) of every row with a term at all: n counts all terms, the arrays the vocabulary's. No shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = split_words(batch.column("text"), NO_LETTERS, lower=True)
            known = pc.fill_null(pc.index_in(words.values, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            term = known[words.codes] if len(known) else np.empty(0, np.int64)
            width = len(vocabulary) + 1
            keys, times = np.unique((words.owners * width + term)[term >= 0], return_counts=True)
            bounds = np.searchsorted(keys // width, np.arange(len(batch) + 1)).astype(np.int32)
            arrays = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (keys % width, times)]
            columns = [batch.column("at"), batch.column("doc_id"), pa.array(words.counts, pa.int64()), *arrays]
            out = pa.RecordBatch.from_arrays(columns, names=["at", "doc_id", "n", "terms", "times"])
            yield out.filter(pa.array(words.counts > 0))

    rows = docs.select(F.monotonically_increasing_id().alias("at"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "at long, doc_id long, n long, terms array<int>, times array<int>")


def impact_vectors(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(at, doc_id, terms, impacts, length) of the documents that have a term of the block."""
    m = F.lit(10).cast("long") + F.expr(f"(90L * n * {n_docs}L) div {n_terms}L")
    impacts = F.expr("transform(times, x -> (1000000000L * x) div (1000L * x + 8L * m))")
    length = F.expr("sqrt(aggregate(impacts, 0D, (a, x) -> a + cast(x as double) * x))")
    hits = counted.filter(F.size("terms") > 0).withColumn("m", m).withColumn("impacts", impacts)
    return hits.withColumn("length", length).select("at", "doc_id", "terms", "impacts", "length")


class Bucket:
    """Vectors of like length, by row and by term."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.at, self.doc_ids = (batch.column(n) for n in ("at", "doc_id"))
        self.none = self.doc_ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = self.doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.lengths = batch.column("length").to_numpy(zero_copy_only=False)
        terms, impacts = batch.column("terms"), batch.column("impacts")
        sizes = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        self.terms = terms.flatten().to_numpy(zero_copy_only=False)
        self.impacts = impacts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        by = np.argsort(self.terms, kind="stable")
        self.by_term, self.rows, self.values = self.terms[by], rows[by], self.impacts[by].astype(float)

    def coordinate(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.searchsorted(self.by_term, [term, term + 1])
        return self.rows[low:high], self.values[low:high]

    def candidates(self, item: Item, bound: float) -> np.ndarray:
        """Rows whose score may reach ``bound``."""
        n, length = len(self.lengths), item.length
        most = length * float(self.lengths.max(initial=0.0))
        if not most or most * (1 + _SLACK) < bound:
            return np.empty(0, np.int64)
        need = min(1.0, bound / most * (1 - _SLACK))
        squares = self.lengths**2
        summed, seen, held = np.zeros(n), np.zeros(n), 0.0
        open_rows = np.ones(n, bool)
        for term, weight in zip(item.terms, item.weights.astype(float), strict=True):
            if held >= FOCUS * length**2:
                break
            held += weight**2
            rows, values = self.coordinate(term)
            summed[rows] += weight * values
            seen[rows] += values**2
            # The angle between both vectors is at most acos(need), so their shares of a coordinate cannot lie further apart.
            share, spread = weight / length, math.sqrt(max(0.0, (1 - need**2) * (1 - (weight / length) ** 2)))
            part = np.zeros(n)
            part[rows] = values / self.lengths[rows]
            open_rows &= part >= share * need - spread - _SLACK
            if share < need:
                open_rows &= part <= share * need + spread + _SLACK
        rest = math.sqrt(max(0.0, length**2 - held) + _SLACK * length**2)
        reach = summed + rest * np.sqrt(np.maximum(0.0, squares - seen) + _SLACK * squares)
        return np.flatnonzero(open_rows & (reach * (1 + _SLACK) >= bound))

    def scores(self, item: Item, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores; ``dense`` is a zero per term of the vocabulary, and is left so."""
        dense[item.terms] = item.weights
        sizes = self.starts[rows + 1] - self.starts[rows]
        offsets = np.cumsum(sizes) - sizes
        place = np.repeat(self.starts[rows] - offsets, sizes) + np.arange(sizes.sum())
        out = np.add.reduceat(dense[self.terms[place]] * self.impacts[place], offsets) if len(rows) else np.empty(0, np.int64)
        dense[item.terms] = 0
        return out


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    for batch in batches:
        sizes = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.maximum(np.arange(len(batch)) // BUCKET_ROWS, (np.cumsum(sizes) - sizes) // BUCKET_IMPACTS)
        cuts = np.flatnonzero(np.diff(number, prepend=-1))
        for low, high in zip(cuts, np.append(cuts[1:], len(batch)), strict=True):
            yield Bucket(batch.slice(low, high - low))


class Best:
    """The best rows of one item so far, by score, then by id, rows without an id last."""

    def __init__(self, bound: int, top: int) -> None:
        self.top, self.start = top, bound
        self.rows = np.empty((0, 4), np.int64)  # negated score, no id, id, row number

    @property
    def bound(self) -> int:
        return max(self.start, -int(self.rows[-1, 0])) if len(self.rows) == self.top else self.start

    def add(self, bucket: Bucket, chosen: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= max(1, self.bound)
        chosen, scores = chosen[good], scores[good]
        at = bucket.at.to_numpy(zero_copy_only=False)[chosen]
        new = np.stack([-scores, bucket.none[chosen].astype(np.int64), bucket.ids[chosen], at], axis=1)
        rows = np.concatenate((self.rows, new))
        self.rows = rows[np.lexsort(rows.T[::-1])[: self.top]]


def search(vectors: DataFrame, items: list[Item], n_vocabulary: int, bounds: dict[int, int], top: int, first_only: bool) -> DataFrame:
    """(item, doc_id, at, score): of each partition the ``top`` rows of each item that reach the item's bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(bounds.get(i, 0), top) for i in range(len(items))]
        dense = np.zeros(n_vocabulary, np.int64)
        for bucket in _buckets(batches):
            for item, kept in zip(items, best, strict=True):
                rows = bucket.candidates(item, kept.bound)
                if len(rows):
                    kept.add(bucket, rows, bucket.scores(item, rows, dense))
            if first_only:
                break
        found = np.concatenate([np.column_stack((np.full(len(b.rows), i), b.rows)) for i, b in enumerate(best)])
        doc_ids = pa.array(found[:, 3], pa.int64(), mask=found[:, 2] == 1)
        columns = [pa.array(found[:, 0], pa.int64()), doc_ids, pa.array(found[:, 4], pa.int64()), pa.array(-found[:, 1], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "at", "score"])

    return vectors.mapInArrow(run, "item long, doc_id long, at long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "at")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def ranked_block(docs: DataFrame, rows: list[Row], top: int = TOP) -> DataFrame:
    """(item, rank, doc_id, score) for one block of items; item is the place in ``rows``."""
    vocabulary, items = read_items(rows)
    spark = docs.sparkSession
    counted = written(term_counts(docs, vocabulary), "term-counts")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs or not len(vocabulary):
        return spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    # One row per term of the block at most.
    frequency = np.zeros(len(vocabulary), np.int64)
    for row in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        frequency[row["term"]] = row["count"]
    for item in items:
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in frequency[item.terms]], np.int64)
        by = np.argsort(-weights, kind="stable")
        item.terms, item.weights = item.terms[by], weights[by]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = impact_vectors(counted, n_docs, n_terms)
    # The row number cuts runs of equal length, such as copies, over several tasks.
    vectors = vectors.repartitionByRange(partitions, F.desc("length"), "at").sortWithinPartitions(F.desc("length"))
    vectors = written(vectors, "vectors")
    first = _ranked(search(vectors, items, len(vocabulary), {}, top, first_only=True), top)
    first = first.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") == top)
    bounds = {row["item"]: row["score"] for row in first.collect()}  # one row per item of the block
    return _ranked(search(vectors, items, len(vocabulary), bounds, top, first_only=False), top).select("item", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank int, doc_id long, score long): per row of ``items`` its ``top`` rows of ``docs`` with a score above 0.

    Equal scores rank by doc_id, rows without one last. Null and empty texts have no terms: such documents are not
    counted and never found, such items find nothing. Repeated documents and repeated items count and are
    ranked each for itself. Empty tables give an empty result. Further columns are not read.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for rows in blocks(items, block_chars):
        found = written(ranked_block(docs, rows, top), "ranked")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {kind}")
        # One row per item of the block.
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = out.unionByName(found)
    return out


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CASES = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = f"""
WITH wanted AS (
  SELECT DISTINCT q, item_id, term FROM (
    SELECT q, item_id, unnest(regexp_extract_all(translate(text, {_CASES}), '{_TERM}')) AS term
    FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark))),
words AS (
  SELECT d, doc_id, unnest(regexp_extract_all(translate(text, {_CASES}), '{_TERM}')) AS term
  FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)),
counted AS (SELECT d, doc_id, term, count(*) AS tf FROM words GROUP BY d, doc_id, term),
sizes AS (SELECT d, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY d),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), totals),
scored AS (
  SELECT q, item_id, d, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM wanted JOIN counted USING (term) JOIN weights USING (term) JOIN sizes USING (d), totals
  GROUP BY q, item_id, d, doc_id),
placed AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, d) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= {TOP}
"""
