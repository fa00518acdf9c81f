"""Scores of texts by an n-gram model whose counts live in a log-frequency Bloom filter.

A gram with count c has level 1 + floor(log_b c), and the filter holds the pairs (gram, 1) ... (gram, level). A
count is read by probing (gram, 1), (gram, 2) and so on to the first miss; the mean of the counts of the level reached
stands for it. A probe never misses what was put in; it may hit by chance (below one in a hundred).

Probabilities are smoothed by a Dirichlet prior at each order: P(w | h) = (c(hw) + m P(w | shorter h)) / (c(h) + m), and
(c(w) + 0.5) / (N + 0.5 (V + 1)) for single words, all counts read from the filter. A text is its words and one end;
its first word follows a start.

The filter is made in shards of about equal size, one per range of gram keys, so no task and no group grows with the
corpus. If all shards together stay within ``max_broadcast`` bytes they are sent to all workers. Beyond that the
grams of each chunk of texts are sent to the shards instead, each once per chunk, and the answers back to the chunk;
both ways read the same bits.

The base score uses exact counts. Words that are frequent in all texts, as many as fit into FREQUENT_BYTES, are
looked up in the task; the others, each of them rare by that rule, are joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import written
from cardwatch.llm.tokens import Words, chunks, split_words

ORDER = 2
#: Weight of the shorter history, in counts.
PRIOR = 100.0
#: Ratio between the counts of successive levels.
LEVEL_BASE = 1.5
#: Bits of the filter per pair, and bits of one 64-bit word that a pair sets.
PAIR_BITS, PROBES = 11, 4
#: Bytes of the filter that may be sent to every worker, grams per shard on average at most, bytes of frequent words.
MAX_BROADCAST = 128 << 20
SHARD_GRAMS = 2_000_000
FREQUENT_BYTES = 16 << 20
#: Bytes of text that are scored at once.
SCORE_BYTES = 3 << 20
_SEED = 11
_MIX1, _MIX2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
# No word holds a blank, so these are no words.
_START, _END = (np.uint64(xxhash.xxh64_intdigest(mark, _SEED)) for mark in (b" start", b" end"))
_FLOORS = LEVEL_BASE ** np.arange(100)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_b c) of counts from 1 on."""
    return np.searchsorted(_FLOORS, counts, side="right")


def _level_means() -> np.ndarray:
    """The mean of the counts that have a level; 0 for level 0."""
    low, high = np.ceil(_FLOORS[:-1]), np.ceil(_FLOORS[1:]) - 1
    return np.concatenate(([0.0], (low + high) / 2))


def gram_keys(words: Words, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Owner and place of every token, start and end included, and for each order the key of the gram that ends there.

    A gram of n tokens ends at place n - 1 at the earliest; keys before that mean nothing. The key of a gram without
    its last token is the key of the order below, one place earlier.
    """
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, _SEED) for w in words.bytes_of()), np.uint64, len(words.values))
    sizes = words.counts + 2
    ends = np.cumsum(sizes)
    tokens = np.empty(int(sizes.sum()), np.uint64)
    owners = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(tokens)) - np.repeat(ends - sizes, sizes)
    tokens[places == 0] = _START
    tokens[ends - 1] = _END
    tokens[(places > 0) & (places < np.repeat(sizes - 1, sizes))] = hashes[words.codes]
    keys = [_mixed(tokens + _STEP)]
    for _ in range(1, order):
        longer = keys[-1].copy()
        longer[1:] = _mixed(keys[-1][:-1] * _MIX2 + tokens[1:])
        keys.append(longer)
    return owners, places, keys


@dataclass
class Filter:
    """All shards, one after another: shard s has the words from ``offsets[s]`` to ``offsets[s + 1]``."""

    bits: int  # leading bits of a key that name its shard
    offsets: np.ndarray
    words: np.ndarray

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each gram, by probing upwards to the first miss."""
        found = np.zeros(len(keys), np.uint8)
        shard = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        low = self.offsets[shard]
        size = (self.offsets[shard + 1] - low).astype(np.uint64)
        active = np.flatnonzero(size > 0)
        level = 0
        while len(active) and level < len(_FLOORS):
            level += 1
            place, mask = _pair(keys[active], level, size[active])
            hit = (self.words[low[active] + place] & mask) == mask
            active = active[hit]
            found[active] = level
        return found


def _pair(keys: np.ndarray, level: int | np.ndarray, size: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Word within the shard and the bits in it that the pair (gram, level) sets."""
    step = level.astype(np.uint64) * _STEP if isinstance(level, np.ndarray) else np.uint64(level * int(_STEP) & (1 << 64) - 1)
    hashed = _mixed(keys ^ step)
    place = ((hashed >> np.uint64(32)) * size) >> np.uint64(32)
    mask = np.zeros(len(keys), np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << ((hashed >> np.uint64(6 * i)) & np.uint64(63))
    return place.astype(np.int64), mask


def shard_words(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits of one shard, from its grams and their counts."""
    levels = level_of(counts)
    total = int(levels.sum())
    words = np.zeros(total * PAIR_BITS // 64 + 1, np.uint64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        place, mask = _pair(keys[levels >= level], level, np.uint64(len(words)))
        np.bitwise_or.at(words, place, mask)
    return words


def _held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))


def _rows(docs: DataFrame) -> DataFrame:
    """(at, doc_id, held_out, text) of every row; at tells rows apart within one run of a job."""
    return docs.select(
        F.monotonically_increasing_id().alias("at"), F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), "text"
    )


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n_train, n_all) of every different word, counted over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = split_words(batch.column("text"), lower=True)
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            n_all = np.bincount(words.codes, minlength=len(words.values))
            n_train = np.bincount(words.codes[train[words.owners]], minlength=len(words.values))
            columns = [words.values.cast(pa.binary()), pa.array(n_train, pa.int64()), pa.array(n_all, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n_train", "n_all"])

    counted = rows.select("held_out", "text").mapInArrow(count, "word binary, n_train long, n_all long")
    return counted.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """(key, n) of the grams of all orders in training texts; a gram has one row per chunk of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            _, places, keys = gram_keys(split_words(batch.column("text"), lower=True), order)
            for n, own in enumerate(keys):
                different, counts = np.unique(own[places >= n], return_counts=True)
                columns = [pa.array(different.view(np.int64)), pa.array(counts.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n"])

    return rows.filter(~F.col("held_out")).select("text").mapInArrow(count, "key long, n int")


def filter_shards(counted: DataFrame, bits: int) -> DataFrame:
    """(shard, words) with the filter's bits of each shard; shards without a gram have no row."""
    partitions = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard = F.shiftrightunsigned("key", 64 - bits).cast("int")
    dealt = counted.withColumn("shard", shard).repartition(partitions, "shard")
    summed = dealt.groupBy("shard", "key").agg(F.sum("n").alias("n")).sortWithinPartitions("shard")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def done() -> pa.RecordBatch:
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "words": [shard_words(keys, counts).tobytes()]})

        for batch in batches:
            shards, keys, counts = (batch.column(n).to_numpy() for n in ("shard", "key", "n"))
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for low, high in zip(np.append(0, cuts), np.append(cuts, len(shards)), strict=True):
                if low == high:
                    continue
                if held and shards[low] != now:
                    yield done()
                    held = []
                now = int(shards[low])
                held.append((keys[low:high].view(np.uint64), counts[low:high]))
        if held:
            yield done()

    return summed.mapInArrow(build, "shard int, words binary")


@dataclass
class Model:
    """What training leaves: totals, the filter as a written table of shards, and the exact counts."""

    order: int
    prior: float
    tokens: int
    distinct: int
    train_docs: int
    bits: int
    shards: DataFrame
    filter_bytes: int
    counts: DataFrame
    frequent_from: int  # words with n_all from here on are looked up in the task

    @property
    def divisor(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


def train(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, shard_grams: int = SHARD_GRAMS, frequent_bytes: int = FREQUENT_BYTES) -> Model:
    """Counts over the texts that are not held out; rows without an id are trained on."""
    rows = _rows(docs)
    counts = written(word_counts(rows), "word-counts")
    n_train, n_words = counts.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0)).first()
    train_docs = rows.filter(~F.col("held_out")).count()
    # One row per power of two.
    power = F.floor(F.log2("n_all")).cast("int")
    sizes = counts.groupBy(power.alias("power")).agg(F.sum(F.length("word") + 16).alias("bytes")).orderBy(F.desc("power")).collect()
    frequent_from, room = 1 << 62, frequent_bytes
    for row in sizes:
        room -= row["bytes"]
        if room < 0:
            break
        frequent_from = 1 << row["power"]
    tokens = n_train + train_docs
    # Two shards at least: the optimizer would take a constant shard out of the grouping.
    bits = max(1, math.ceil(math.log2(max(1, (tokens + train_docs) * order / shard_grams))))
    shards = written(filter_shards(gram_counts(rows, order), bits), "filter")
    size = shards.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0]
    return Model(order, prior, tokens, n_words + (train_docs > 0), train_docs, bits, shards, size, counts, frequent_from)


def _assembled(model: Model) -> Filter:
    """The whole filter in the driver; its size was checked. Shards come a partition at a time."""
    parts = {row["shard"]: np.frombuffer(bytes(row["words"]), np.uint64) for row in model.shards.toLocalIterator()}
    sizes = [len(parts.get(s, ())) for s in range(1 << model.bits)]
    words = np.concatenate([parts[s] for s in sorted(parts)]) if parts else np.empty(0, np.uint64)
    return Filter(model.bits, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), words)


def _frequent(model: Model) -> tuple[pa.Array, np.ndarray]:
    """The frequent words, FREQUENT_BYTES at most by choice of ``frequent_from``."""
    rows = model.counts.filter(F.col("n_all") >= model.frequent_from).select("word", "n_train").toArrow()
    return rows.column("word").combine_chunks().cast(pa.large_binary()), rows.column("n_train").to_numpy()


def text_scores(owners: np.ndarray, places: np.ndarray, keys: list[np.ndarray], levels: Callable, n_docs: int, model: tuple) -> np.ndarray:
    """Log10 probability of each text; ``levels`` reads the levels of different grams."""
    order, prior, tokens, divisor = model
    means = _level_means()
    counts = []
    for own in keys:
        different, which = np.unique(own, return_inverse=True)
        counts.append(means[levels(different)][which])
    p = (counts[0] + 0.5) / divisor
    for n in range(1, order):
        history = np.concatenate(([0.0], counts[n - 1][:-1]))
        longer = (np.minimum(counts[n], history) + prior * p) / (history + prior)
        p = np.where(places >= n, longer, p)
    tokens_of = places > 0
    # Counts stand for their levels, so an estimate may pass the total by a little.
    return np.bincount(owners[tokens_of], np.log10(np.minimum(p[tokens_of], 1.0)), minlength=n_docs)


_SCORED = "at long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word: binary, times: long>>"


def _score_batch(batch: pa.RecordBatch, levels_for: Callable, frequent: tuple[pa.Array, np.ndarray], model: tuple) -> pa.RecordBatch:
    order, _, tokens, divisor = model[:4]
    train_docs = model[4]
    words = split_words(batch.column("text"), lower=True)
    owners, places, keys = gram_keys(words, order)
    score = text_scores(owners, places, keys, levels_for(keys), len(batch), model[:4])
    at = pc.fill_null(pc.index_in(words.values, value_set=frequent[0]), -1).to_numpy(zero_copy_only=False)
    counts = np.where(at >= 0, frequent[1][at], -1) if len(frequent[1]) else np.full(len(at), -1)
    count, owner = counts[words.codes], words.owners
    here = count >= 0
    n_docs = len(batch)
    known = np.bincount(owner[count > 0], minlength=n_docs) + (train_docs > 0)
    base = np.bincount(owner[here], np.log10((count[here] + 0.5) / divisor), minlength=n_docs) + math.log10((train_docs + 0.5) / divisor)
    width = max(1, len(words.values))
    pairs, times = np.unique(owner[~here] * width + words.codes[~here], return_counts=True)
    bounds = np.searchsorted(pairs // width, np.arange(n_docs + 1)).astype(np.int32)
    rare = pa.StructArray.from_arrays([words.values.take(pa.array(pairs % width)).cast(pa.binary()), pa.array(times, pa.int64())], names=["word", "times"])
    columns = [batch.column(n) for n in ("at", "doc_id", "held_out")]
    columns += [pa.array(words.counts + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
    names = ["at", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(bounds), rare)], names=names)


def _by_broadcast(rows: DataFrame, model: Model, frequent: tuple, totals: tuple) -> DataFrame:
    context = rows.sparkSession.sparkContext
    whole, words = context.broadcast(_assembled(model)), context.broadcast(frequent)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=SCORE_BYTES):
            yield _score_batch(batch, lambda _: whole.value.levels, words.value, totals)

    return rows.mapInArrow(score, _SCORED)


def _by_shard(rows: DataFrame, model: Model, frequent: tuple, totals: tuple) -> DataFrame:
    """Grams go to the shards and levels come back. A chunk of texts is one row, as Arrow bytes, named by its first row.

    A chunk asks with its different grams in order, so the levels alone come back: put in order of shards they are in that of the grams.
    """
    words = rows.sparkSession.sparkContext.broadcast(frequent)
    order, bits = model.order, model.bits

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=SCORE_BYTES):
            if len(batch):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch)
                yield pa.RecordBatch.from_pydict({"chunk": batch.column("at").slice(0, 1), "rows": [sink.getvalue().to_pybytes()]})

    def read(blob: pa.Buffer) -> pa.RecordBatch:
        return pa.ipc.open_stream(blob).read_next_batch()

    def different(keys: list[np.ndarray]) -> np.ndarray:
        return np.unique(np.concatenate(keys))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(*(batch.column(n) for n in ("chunk", "rows")), strict=True):
                keys = different(gram_keys(split_words(read(blob.as_buffer()).column("text"), lower=True), order)[2])
                shards = keys >> np.uint64(64 - bits)
                cuts = np.flatnonzero(np.diff(shards)) + 1
                parts = np.split(keys, cuts)
                columns = {"chunk": [chunk.as_py()] * len(parts), "shard": pa.array(shards[np.append(0, cuts)].astype(np.int32)), "keys": [p.tobytes() for p in parts]}
                yield pa.RecordBatch.from_pydict(columns)

    def answer(asked: pa.Table, shard: pa.Table) -> pa.Table:
        words = np.frombuffer(shard.column("words")[0].as_py(), np.uint64) if len(shard) else np.empty(0, np.uint64)
        own = Filter(0, np.array([0, len(words)]), words)
        levels = [own.levels(np.frombuffer(k.as_buffer(), np.uint64)).tobytes() for k in asked.column("keys")]
        return pa.table({"chunk": asked.column("chunk"), "shard": asked.column("shard"), "levels": pa.array(levels, pa.binary())})

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        parts = answers.sort_by("shard").column("levels")
        levels = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in parts])

        def levels_for(keys: list[np.ndarray]) -> Callable:
            every = different(keys)
            return lambda k: levels[np.searchsorted(every, k)]

        return pa.Table.from_batches([_score_batch(read(x.as_buffer()), levels_for, words.value, totals) for x in texts.column("rows")])

    texts = written(rows.mapInArrow(cut, "chunk long, rows binary"), "chunks")
    asked = texts.mapInArrow(ask, "chunk long, shard int, keys binary")
    answers = asked.groupBy("shard").cogroup(model.shards.groupBy("shard")).applyInArrow(answer, "chunk long, shard int, levels binary")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, _SCORED)


def scored(docs: DataFrame, model: Model, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A null text is empty and has one token, its end. Repeated rows are scored each; rows without an id count as
    trained on. Without any training text all counts are 0 and the base score is 0 per token. An empty table gives
    an empty one; further columns are not read.
    """
    totals = (model.order, model.prior, model.tokens, model.divisor, model.train_docs)
    way = _by_broadcast if model.filter_bytes <= max_broadcast else _by_shard
    # Written once: row numbers, parts of sums and rare words must come from the same run.
    found = written(way(_rows(docs), model, _frequent(model), totals), "scored")
    rare = model.counts.filter(F.col("n_all") < model.frequent_from).select(F.col("word").alias("_word"), "n_train")
    uses = found.select("at", F.explode("rare").alias("use")).select("at", "use.word", "use.times")
    joined = uses.join(rare.hint("merge"), F.col("word") == F.col("_word"))
    logs = F.log10((F.col("n_train") + 0.5) / F.lit(model.divisor))
    sums = joined.groupBy(F.col("at").alias("_at")).agg(
        F.sum(F.when(F.col("n_train") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * logs).alias("rest")
    )
    whole = found.drop("rare").join(sums.hint("merge"), F.col("at") == F.col("_at"), "left")
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
    )
