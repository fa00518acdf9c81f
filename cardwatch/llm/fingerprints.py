"""Document fingerprints by MinHash, and near-duplicate pairs from their bands.

A text's word shingles are hashed to 32 mixed bits; PERMUTATIONS universal hash functions
h(x) = a x + b mod 2**32 with odd a, each a permutation of all values, are applied and the minimum under
each is kept. Words are runs of anything but ASCII white space. A text of fewer than SHINGLE words is one
shingle; a text without words has the largest value in every lane.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import components, text_or_empty, written
from cardwatch.llm.lines import rest_pairs
from cardwatch.session import materialize

SHINGLE = 5
PERMUTATIONS = 128
#: 21 bands of 6 lanes find a pair at 0.8 with 99.8 %.
BANDS = 21
BAND_ROWS = 6
SIMILARITY = 0.8
MAX_PARTS = 1000
#: Rows of numbers (16 bytes each) that may be broadcast.
FEW_ROWS = 2_000_000
_RNG = np.random.default_rng(1)
_A = _RNG.integers(0, 1 << 31, PERMUTATIONS, np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, PERMUTATIONS, np.uint32)[:, None]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 2048


_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0xD1342543DE82EF95
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse modulo 2**64."""
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(2 * n, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit polynomial hash of each word, all words of a text at once."""
    data = np.frombuffer(raw, np.uint8)
    space = _IS_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:-1])))
    return (sums[ends] - sums[starts]) * down[starts]


def shingles(text: str) -> np.ndarray:
    """Hashed word shingles of a text, as often as they occur."""
    known = word_hashes(text.encode("utf-8", "surrogatepass"))
    if not len(known):
        return np.empty(0, np.uint32)
    n = max(1, len(known) - SHINGLE + 1)
    mixed = np.full(n, min(len(known), SHINGLE), np.uint64)
    for i in range(min(SHINGLE, len(known))):
        mixed = (mixed ^ known[i : i + n]) * _STEP
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(32)).astype(np.uint32)


def minima(hashed: np.ndarray) -> np.ndarray:
    """The least value of each permutation over hashed shingles."""
    lowest = np.full(PERMUTATIONS, np.iinfo(np.uint32).max)
    for at in range(0, len(hashed), _BLOCK):
        values = _A * hashed[None, at : at + _BLOCK]
        values += _B
        np.minimum(lowest, values.min(axis=1), out=lowest)
    return lowest.astype(np.uint32)


def signature(text: str) -> np.ndarray:
    """PERMUTATIONS minima of 32 bits."""
    return minima(shingles(text))


def with_edit(own: np.ndarray, edited: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a text and of its edited form from their shingles; the start they share is hashed once."""
    n = min(len(own), len(edited))
    differ = np.flatnonzero(own[:n] != edited[:n])
    same = int(differ[0]) if len(differ) else n
    shared = minima(own[:same])
    return np.minimum(shared, minima(own[same:])), np.minimum(shared, minima(edited[same:]))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal lanes of two fingerprints as ``digest`` gives them, an estimate of the Jaccard similarity of the shingle sets."""
    return float((a.astype(np.uint16) == b.astype(np.uint16)).mean())


def digest(sig: np.ndarray) -> str:
    """The lower 16 bits of each lane in hexadecimal; lanes differ in them as good as always if they differ."""
    return sig.astype(">u2").tobytes().hex()


def _band_keys(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band, from whole lanes of 32 bits."""
    keys = np.empty((len(sigs), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sigs), band + 1, np.uint64)
        for lane in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
            key = (key ^ sigs[:, lane].astype(np.uint64)) * _STEP
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = np.array([signature(x or "") for x in batch.column("text").to_pylist()], np.uint32).reshape(-1, PERMUTATIONS)
        lines = np.repeat(batch.column("text_key").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(lines), pa.array(_band_keys(sigs).ravel().view(np.int64))], names=["line_key", "band"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each text, once for copies in one batch."""
    for batch in batches:
        keys, first = np.unique(batch.column("line_key").to_numpy(), return_index=True)
        texts = batch.column("text").take(pa.array(first)).to_pylist()
        sets = pa.array([np.unique(shingles(x or "")).view(np.int32) for x in texts], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(keys), sets], names=["line_key", "set"])


def _small(df: DataFrame) -> DataFrame:
    """A table of one or two numbers per row, hinted to be broadcast if its counted rows stay within FEW_ROWS."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df.hint("merge")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    a, b = (sets.select(F.col("line_key").alias(n), F.col("set").alias(f"s{n}")).hint("merge") for n in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
    jaccard = F.col("n") / F.nullif(F.size("sa") + F.size("sb") - F.col("n"), F.lit(0))
    return both.select("a", "b", jaccard.alias("jaccard")).filter(F.col("jaccard") >= similarity)


def near_pairs(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(links, members): near-duplicate links (a, b, jaccard) of distinct texts, and (doc_id, text_key) of all rows.

    Each text is compared by exact Jaccard similarity with the first text of every band value it has, then all
    pairs of a band that this leaves in different components and that can be similar enough (``rest_pairs``).
    So the components of the links are those of all similar pairs with a common band, while a group of many
    like texts stays near linear. Equal texts are one text; copies are in ``members``. Texts without words
    pair with nothing, since they are all equal.
    """
    keyed = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_key"), text_or_empty().alias("text"))
    members = keyed.select("doc_id", "text_key")
    # Signatures are made where the rows lie; copies give the same bands and are not told apart before they have met.
    banded = written(keyed.select("text_key", "text").mapInArrow(_banded, "line_key long, band long"), "bands")
    ends = banded.groupBy("band").agg(F.min("line_key").alias("a"), F.max("line_key").alias("z"))
    ends = written(ends.filter("a < z").drop("z"), "mixed-bands")
    shared = written(banded.join(_small(ends), "band").select("band", "line_key", "a").distinct(), "shared")
    asked = written(shared.select("line_key").distinct(), "asked")
    texts = keyed.select(F.col("text_key").alias("line_key"), "text").join(_small(asked), "line_key", "left_semi")
    sets = texts.mapInArrow(_sets, "line_key long, set array<int>")
    sets = written(sets.groupBy("line_key").agg(F.first("set").alias("set")), "sets")
    tried = shared.filter("line_key > a").select("a", F.col("line_key").alias("b")).distinct()
    links = materialize(_similar(tried, sets, similarity))
    rest = rest_pairs(shared, components(links.select("a", "b")), sets, similarity, F.col("set"))
    rest = rest.join(tried.hint("merge"), ["a", "b"], "left_anti")
    return links.unionByName(materialize(_similar(rest, sets, similarity))), members


def with_near_links(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``compared_with_edits`` plus near_links, the verified links of a row's text, and near_component.

    near_component is the smallest text key that links lead to; a text without links is alone in its own.
    """
    links, _ = near_pairs(docs, similarity)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("near_links"))
    found = components(links.select("a", "b")).join(ends.hint("merge"), "node").withColumnRenamed("node", "text_key")
    rows = compared_with_edits(docs, keyed=True).join(found.hint("merge"), "text_key", "left")
    return rows.select(*NAMES, F.coalesce("near_links", F.lit(0)).cast("long").alias("near_links"), F.coalesce("component", "text_key").alias("near_component"))


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        bodies = [packer.compress(x.encode("utf-8", "surrogatepass")) for x in batch.column("text").to_pylist()]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "body", pa.array(bodies, pa.binary()))


def with_next(docs: DataFrame) -> DataFrame:
    """(part, is_tail, doc_id, body, text_key), sorted within partitions so that each row's next document follows it.

    body is the text, compressed for the way.

    Next means next by descending doc_id (then text key), nulls last, and the first after the last.
    Rows are cut by doc_id into parts, which are streamed, never held; the first row of each part is sent
    to the part before it as well, as that one's tail. Texts are shuffled once.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(MAX_PARTS, 4 * partitions)
    keyed = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_key", F.xxhash64("text"))
    cuts = keyed.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    cuts = F.array(*[F.lit(x) for x in sorted(set(cuts or []))]).cast("array<long>")
    part = F.coalesce(F.size(F.filter(cuts, lambda x: x < F.col("doc_id"))), F.lit(0))
    keyed = keyed.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(part))
    # One row per part, so MAX_PARTS at most.
    tops = keyed.groupBy("part").agg(F.max(F.struct("doc_id", "text_key")).alias("top")).orderBy(F.desc("part")).collect()
    sent = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("is_tail")))
    for i, row in enumerate(tops):
        top = F.col("doc_id").eqNullSafe(F.lit(row["top"]["doc_id"])) & (F.col("text_key") == row["top"]["text_key"])
        tail = F.struct(F.lit(tops[i - 1]["part"]).alias("part"), F.lit(True).alias("is_tail"))
        is_top = (F.col("part") == row["part"]) & top
        tails = F.when(is_top, F.array(tail)) if not i else tails.when(is_top, F.array(tail))  # noqa: F821
    if tops:
        sent = F.concat(sent, F.coalesce(tails, F.array().cast("array<struct<part:int,is_tail:boolean>>")))
    spread = keyed.withColumn("sent", F.explode(sent)).select("sent.part", "sent.is_tail", "doc_id", "text", "text_key")
    spread = spread.mapInArrow(_compressed, "part int, is_tail boolean, doc_id long, body binary, text_key long")
    order = ["part", "is_tail", F.desc_nulls_last("doc_id"), F.desc("text_key")]
    return spread.repartition(partitions, "part").sortWithinPartitions(*order)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    pending: tuple | None = None  # the row before, whose edit needs this one
    ready: list | None = None  # the row before that, whose near_next needs pending's signature
    for batch in batches:
        out: list[list[Any]] = []
        for part, tail, doc_id, body, key in zip(*(batch.column(n).to_pylist() for n in ("part", "is_tail", "doc_id", "body", "text_key")), strict=True):
            if tail and (pending is None or pending[0] != part):
                continue  # the part has had its tail
            text = unpacker.decompress(body).decode("utf-8", "surrogatepass")
            hashed = shingles(text)
            if pending is not None:
                _, id_, own, own_hashed, own_key = pending
                cut = len(own) // 3
                edited = own[: len(own) - cut] + text[:cut]
                own_sig, edited_sig = with_edit(own_hashed, shingles(edited))
                sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                if ready:
                    out.append([*ready[:-1], likeness(ready[-1], own_sig)])
                ready = [own_key, id_, len(own), sha, digest(own_sig), digest(edited_sig), likeness(own_sig, edited_sig), own_sig]
            if tail:
                out.append([*ready[:-1], likeness(ready[-1], minima(hashed))])
                pending = ready = None
            else:
                pending = part, doc_id, text, hashed, key
        columns = list(zip(*out, strict=True)) if out else [()] * 8
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["text_key", *NAMES])


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compared_with_edits(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """NAMES of every row: each text against itself with its last third replaced, and against the next text.

    Null texts count as empty. Rows with one doc_id follow each other by text key; a row equal in both
    to the next one is compared with it. In a table of one row that row is its own next one. ``keyed`` adds text_key.
    """
    schema = "text_key long, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = with_next(docs).select("part", "is_tail", "doc_id", "body", "text_key").mapInArrow(_compared, schema)
    return rows if keyed else rows.drop("text_key")
