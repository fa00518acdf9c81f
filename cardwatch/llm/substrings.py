"""Removal of byte strings of LENGTH that occur more than once in the whole corpus, by suffix arrays.

1. Anchors. In every run of WINDOW successive grams (GRAM bytes each, WINDOW + GRAM - 1 = LENGTH) the gram of
   least hash is an anchor. A string of LENGTH bytes has the same anchors wherever it occurs, so two equal
   strings share a gram key. About one byte in a hundred is an anchor.
2. An anchor's context holds every string of LENGTH bytes around it. Contexts that are equal as a whole are
   repeated as a whole. Of each different context whose gram occurs in another context, one copy goes on.
3. Contexts are shuffled by gram key and each task makes suffix arrays over batches of whole keys. Equal
   strings are neighbours in them. A key with more than MANY contexts is not put in one task: its strings
   are counted by two hashes in a shuffle of their own instead.

The suffix array is made in two stages: only suffixes smaller than their successor are sorted directly,
the others are placed by one scan over the buckets of first bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import text_or_empty, written
from cardwatch.session import materialize

LENGTH = 400
GRAM = 200
WINDOW = LENGTH - GRAM + 1
#: Contexts of one gram key beyond which it is counted by hashes, and bytes of contexts in one suffix array.
MANY = 4_000
BATCH_BYTES = 2_000_000
_RNG = np.random.default_rng(8)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9FB21C651E98DF25
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_BLOCK = 64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(2 * n, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hash of any byte range of one text in constant time."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(len(data) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:-1])))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[high] - self.sums[low]) * self.down[low])

    def all_of(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def sliding(x: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """Least or largest of each ``width`` neighbours, in three passes."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, fill, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    left = pick.accumulate(blocks, axis=1).ravel()
    right = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(right[:n], left[width - 1 : width - 1 + n])


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, gram key and context hash of each anchor of one text."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    rolling = Rolling(data)
    keys = rolling.all_of(GRAM)
    least = sliding(keys, WINDOW, np.minimum, (1 << 64) - 1)
    padded = np.concatenate((np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)))
    places = np.flatnonzero(sliding(padded, WINDOW, np.maximum, 0) == keys)
    low, high = np.maximum(places - (WINDOW - 1), 0), np.minimum(places + LENGTH, len(data))
    around = rolling.of(low, high) ^ _mixed((places - low).astype(np.uint64))
    return places, keys[places], around


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, own = [], []
        for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            rows = anchors(text.encode("utf-8", "surrogatepass"))
            if len(rows[0]):
                found.append(rows)
                own.append(np.full(len(rows[0]), key, np.int64))
        if found:
            places, keys, around = (np.concatenate(c) for c in zip(*found, strict=True))
            columns = [np.concatenate(own), places.astype(np.int32), keys.view(np.int64), around.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["text_key", "place", "gram", "around"])


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the one that starts a byte later; the last is not."""
    rises = np.zeros(len(text), bool)
    if len(text) > 1:
        step = np.flatnonzero(text[:-1] != text[1:])
        nxt = np.searchsorted(step, np.arange(len(text)))
        inside = nxt < len(step)
        at = step[nxt[inside]]
        rises[inside] = text[at] < text[at + 1]
    return rises


def sort_directly(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of their suffixes' first ``depth`` bytes at least.

    Ties are refined by eight bytes a round; groups that agree in a whole block skip it by its hash.
    """
    padded = np.concatenate((text, np.zeros(depth + _BLOCK + 16, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    weights = np.uint64(1) << np.arange(56, -1, -8, dtype=np.uint64)
    keys = np.zeros(len(words), np.uint64)
    for i in range(8):
        keys |= words[:, i].astype(np.uint64) * weights[i]
    blocks = Rolling(padded).all_of(_BLOCK)
    order = places[np.argsort(keys[places], kind="stable")]
    first = keys[order]
    fresh = np.concatenate(([True], first[1:] != first[:-1])) if len(order) else np.empty(0, bool)
    group = np.cumsum(fresh) - 1
    at = np.full(len(order), 8)
    slot = np.arange(len(order))
    while True:
        # slot: where in ``order`` the active elements are; group: which tie they belong to.
        size = np.bincount(group) if len(group) else np.empty(0, int)
        active = (size[group] > 1) & (at < depth)
        slot, group, at = slot[active], group[active], at[active]
        if not len(slot):
            return order
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        group = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(group)]))))
        block = blocks[order[slot] + at]
        agree = (np.maximum.reduceat(block, starts) == np.minimum.reduceat(block, starts))[group]
        at = at + np.where(agree, _BLOCK, 0)
        split = np.flatnonzero(~agree)
        if len(split):
            own = order[slot[split]]
            key = keys[own + at[split]]
            by = np.lexsort((key, group[split]))
            order[slot[split]] = own[by]
            key, of = key[by], group[split]
            cut = np.concatenate(([True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])))
            at[split] += 8
            # New groups get numbers of their own, in order, and all are numbered anew in the next round.
            fresh = np.concatenate(([True], group[1:] != group[:-1]))
            fresh[split] |= cut
            group = np.cumsum(fresh) - 1


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes in the order of their first ``depth`` bytes."""
    n = len(text)
    rises = smaller_than_next(text)
    direct = sort_directly(text, np.flatnonzero(rises), depth)
    cut = np.searchsorted(text[direct], np.arange(257)) if n else np.zeros(257, int)
    placed: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        placed[text[n - 1]].append(np.array([n - 1]))  # nothing comes before its successor, the end
    out = []
    for byte in range(256):
        # First the bucket's suffixes larger than their successors: scanning them may add more to this bucket.
        i = 0
        while i < len(placed[byte]):
            out.append(placed[byte][i])
            _induce(text, rises, placed[byte][i], placed)
            i += 1
        own = direct[cut[byte] : cut[byte + 1]]
        out.append(own)
        _induce(text, rises, own, placed)
    return np.concatenate(out) if out else np.empty(0, int)


def _induce(text: np.ndarray, rises: np.ndarray, scanned: np.ndarray, placed: list[list[np.ndarray]]) -> None:
    """Put the predecessors that are larger than the scanned suffixes at the next free places of their buckets."""
    before = scanned[scanned > 0] - 1
    before = before[~rises[before]]
    if len(before):
        first = text[before]
        by = np.argsort(first, kind="stable")
        first, before = first[by], before[by]
        cuts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        for part in np.split(before, cuts[1:]):
            placed[text[part[0]]].append(part)


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Length, at most ``depth``, of the common prefix of suffixes a[i] and b[i]; both have ``depth`` bytes."""
    out = np.empty(len(a), int)
    view = np.lib.stride_tricks.sliding_window_view(text, depth)
    for i in range(0, len(a), 4096):
        differ = view[a[i : i + 4096]] != view[b[i : i + 4096]]
        out[i : i + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    return out


def repeated_starts(contexts: list[bytes], firsts: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context number, place in its text) of every string of LENGTH that two different places have.

    ``firsts`` and ``texts`` say where each context starts and in which text; overlapping contexts of one text
    hold the same places, which are not repeats of each other.
    """
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"".join(contexts), np.uint8)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = suffix_array(text)
    order = order[inner[order] + LENGTH <= sizes[owner[order]]]
    if len(order) < 2:
        return np.empty(0, int), np.empty(0, int)
    equal = common_prefixes(text, order[1:], order[:-1]) == LENGTH
    run = np.concatenate(([0], np.cumsum(~equal)))
    doc, place = texts[owner[order]], firsts[owner[order]] + inner[order]
    starts = np.flatnonzero(np.concatenate(([True], ~equal)))
    several = (np.maximum.reduceat(doc, starts) != np.minimum.reduceat(doc, starts)) | (
        np.maximum.reduceat(place, starts) != np.minimum.reduceat(place, starts)
    )
    hit = several[run]
    return owner[order[hit]], place[hit]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes around each wanted anchor; copies of a text that follow each other give theirs once."""
    last = None
    for batch in batches:
        rows = []
        for key, text, wanted in zip(*(batch.column(n).to_pylist() for n in ("text_key", "text", "wanted")), strict=True):
            if key == last:
                continue
            last, raw = key, text.encode("utf-8", "surrogatepass")
            for w in wanted:
                low = max(0, w["place"] - WINDOW + 1)
                rows.append((w["gram"], w["many"], key, low, w["place"], raw[low : w["place"] + LENGTH]))
        if rows:
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "many", "text_key", "low", "place", "bytes"])


def _marks(keys: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Starts of repeated strings as ranges of successive ones: (text_key, low, high), high exclusive, in bytes."""
    order = np.lexsort((starts, keys))
    keys, starts = keys[order], starts[order]
    cut = np.concatenate(([True], (keys[1:] != keys[:-1]) | (starts[1:] > starts[:-1] + 1))) if len(keys) else np.empty(0, bool)
    at = np.flatnonzero(cut)
    ends = np.concatenate((at[1:] - 1, [len(keys) - 1])) if len(at) else at
    columns = [keys[at], starts[at].astype(np.int32), (starts[ends] + LENGTH).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["text_key", "low", "high"])


def _by_suffix_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by gram; a batch ends between two grams."""
    held: list[tuple] = []
    size = 0

    def done() -> pa.RecordBatch:
        firsts, texts = np.array([r[2] for r in held]), np.array([r[1] for r in held])
        owner, places = repeated_starts([r[3] for r in held], firsts, texts)
        return _marks(texts[owner], places)

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("gram", "text_key", "low", "bytes")), strict=True):
            if size >= BATCH_BYTES and row[0] != held[-1][0]:
                yield done()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield done()


def _string_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of each string of LENGTH in a context."""
    for batch in batches:
        out = []
        for key, low, raw in zip(*(batch.column(n).to_pylist() for n in ("text_key", "low", "bytes")), strict=True):
            if len(raw) < LENGTH:
                continue
            hashed = Rolling(np.frombuffer(raw, np.uint8)).all_of(LENGTH)
            again = Rolling(np.frombuffer(raw, np.uint8)[::-1]).all_of(LENGTH)[::-1]
            out.append((np.full(len(hashed), key), low + np.arange(len(hashed), dtype=np.int32), hashed.view(np.int64), again.view(np.int64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["text_key", "low", "h1", "h2"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, copied, marks in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "copied", "marks")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            spans = [(0, len(raw))] if copied and len(raw) >= LENGTH else merged([(m["low"], min(m["high"], len(raw))) for m in marks or []])
            kept, at = [], 0
            for low, high in spans:
                kept.append(raw[at:low])
                at = high
            kept.append(raw[at:])
            rest = b"".join(kept)
            rows.append((doc_id, len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace")))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans; spans that touch make one run."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of every row; null texts count as empty.

    kept_text puts a replacement character where a cut splits a character; the hash is of the bytes.
    """
    keyed = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_key", F.xxhash64("text"))
    rows = keyed.select("text_key", "text").mapInArrow(_anchor_rows, "text_key long, place int, gram long, around long")
    found = written(rows, "anchors")
    alike = found.groupBy("gram", "around").agg(
        F.count("*").alias("n"), F.min("text_key").alias("text_key"), F.min_by("place", "text_key").alias("place")
    )
    grams = alike.groupBy("gram").agg(F.count("*").alias("contexts"), F.sum("n").alias("uses")).filter("uses > 1")
    repeated = materialize(alike.join(grams.hint("merge"), "gram").drop("uses"))

    whole = repeated.filter("n > 1").select("gram", "around")
    whole = found.join(whole.hint("merge"), ["gram", "around"], "left_semi").distinct()
    low = F.greatest(F.col("place") - (WINDOW - 1), F.lit(0)).cast("int")
    # A context cut short by the text's end is as long as the text allows; the span is cut when it is used.
    whole = whole.select("text_key", low.alias("low"), (F.col("place") + LENGTH).alias("high"))

    wanted = repeated.filter("contexts > 1").select("text_key", "place", "gram", (F.col("contexts") > MANY).alias("many"))
    wanted = wanted.groupBy("text_key").agg(F.collect_list(F.struct("place", "gram", "many")).alias("wanted"))
    around = keyed.join(wanted.hint("merge"), "text_key").select("doc_id", "text_key", "text", "wanted")
    schema = "gram long, many boolean, text_key long, low int, place int, bytes binary"
    around = written(around.mapInArrow(_contexts, schema), "contexts")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = around.filter("not many").select("gram", "text_key", "low", "bytes")
    few = few.repartition(partitions, "gram").sortWithinPartitions("gram", "text_key", "low")
    marks = few.mapInArrow(_by_suffix_array, "text_key long, low int, high int")

    hashed = around.filter("many").select("text_key", "low", "bytes").mapInArrow(_string_hashes, "text_key long, low int, h1 long, h2 long")
    bounds = [f(c).alias(f"{n}_{c}") for c in ("text_key", "low") for n, f in (("min", F.min), ("max", F.max))]
    twice = hashed.groupBy("h1", "h2").agg(*bounds).filter("min_text_key < max_text_key or min_low < max_low")
    counted = hashed.join(twice.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_semi")
    counted = counted.select("text_key", "low", (F.col("low") + LENGTH).alias("high"))

    spans = whole.unionByName(marks).unionByName(counted).distinct()
    spans = spans.groupBy("text_key").agg(F.collect_list(F.struct("low", "high")).alias("marks"))
    copies = keyed.groupBy("text_key").agg(F.count("*").alias("copies")).filter("copies > 1").select("text_key", F.lit(True).alias("copied"))
    known = spans.join(copies.hint("merge"), "text_key", "full").withColumn("copied", F.coalesce("copied", F.lit(False)))
    joined = keyed.join(known.hint("merge"), "text_key", "left").select("doc_id", "text", "copied", "marks")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return joined.mapInArrow(_cut, schema)
