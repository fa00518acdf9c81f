"""Near-duplicate documents by SimHash and ball hashing.

Two fingerprints within radius r have a common point within r/2 of both. Every distinct fingerprint
therefore emits all its variants within r/2, equal variants meet, and all that meet are links.

64 bits and r = 4 give 2,081 variants each, too many rows to shuffle one by one. The space of variants is
cut into slices by parity checks (a linear code). Parity is additive, so the slice of a variant is that of
the fingerprint xor that of the flipped bits: a fingerprint is sent once to each slice that any of its
variants falls into, and the slice's task makes just those variants. Each variant of each fingerprint is
made exactly once in the whole job, and equal variants are always in one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import components, packed, text_or_empty
from cardwatch.session import materialize

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Slices at least, and variants that one slice may hold on average before there are more slices.
MIN_SLICES = 64
SLICE_VARIANTS = 32_000_000
#: Variants that a task holds at once.
PART_VARIANTS = 1 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the text's word shingles, repeats included; 0 without a word."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(prints)], names=["doc_id", "text_key", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key long, print long) of every row; null texts count as empty. No shuffle."""
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_key"), text_or_empty().alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(_fingerprints, f"doc_id {kind}, text_key long, print long")


def ball(radius: int, bits: int = 64) -> np.ndarray:
    """Masks of all ways to flip at most ``radius`` of ``bits`` bits."""
    flips = [sum(1 << b for b in chosen) for n in range(radius + 1) for chosen in combinations(range(bits), n)]
    return np.array(flips, np.uint64)


def parity_checks(count: int) -> np.ndarray:
    """``count`` bit masks whose parities name a slice; the same in every run."""
    return np.random.default_rng(64).integers(1, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)


def slice_of(values: np.ndarray, checks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for i, check in enumerate(checks):
        out |= (np.bitwise_count(values & check).astype(np.int64) & 1) << i
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components that the links a-b make, roots left out."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links_in_slice(prints: np.ndarray, number: int, masks: np.ndarray, checks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of which some variant of this slice is shared, as a forest.

    Further checks cut the slice into parts of about PART_VARIANTS, one of which is made at a time.
    """
    prints = np.unique(prints)
    here = np.bincount(slice_of(prints, checks) ^ number, minlength=1 << len(checks))
    variants = int(here @ np.bincount(slice_of(masks, checks), minlength=1 << len(checks)))
    more = (-(-variants // PART_VARIANTS) - 1).bit_length() if variants else 0
    finer = np.concatenate((checks, np.random.default_rng(65).integers(1, 1 << 63, more, np.uint64) * np.uint64(2) + np.uint64(1)))
    mask_part, print_part = slice_of(masks, finer), slice_of(prints, finer)
    masks, prints = masks[np.argsort(mask_part, kind="stable")], prints[np.argsort(print_part, kind="stable")]
    mask_part, print_part = np.sort(mask_part), np.sort(print_part)
    wanted, first = np.unique(mask_part, return_index=True)
    flips = np.split(masks, first[1:])
    found = []
    for part in range(1 << more):
        own = wanted ^ (number | part << len(checks))
        low, high = np.searchsorted(print_part, own, "left"), np.searchsorted(print_part, own, "right")
        found.append(_links_in_part(prints, [(a, b, flips[i]) for i, (a, b) in enumerate(zip(low, high, strict=True)) if b > a], radius))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return forest(a, b) if more and len(a) else (a, b)


def _links_in_part(prints: np.ndarray, groups: list[tuple[int, int, np.ndarray]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between ``prints`` that share a variant; each group is a range of them with the flips that make its variants."""
    if not groups:
        return prints[:0], prints[:0]
    values = np.concatenate([(prints[low:high, None] ^ own).ravel() for low, high, own in groups])
    ordered = np.sort(values)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return prints[:0], prints[:0]
    owners = np.concatenate([np.repeat(np.arange(low, high), len(own)) for low, high, own in groups])
    at = np.searchsorted(shared, values)
    met = shared[np.minimum(at, len(shared) - 1)] == values
    at, owner = at[met], owners[met]
    order = np.lexsort((owner, at))
    at, owner = at[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    least = np.repeat(owner[first], np.diff(np.concatenate((first, [len(at)]))))
    a, b = prints[owner], prints[least]
    near = (a != b) & (np.bitwise_count(a ^ b) <= radius)
    return forest(a[near], b[near]) if near.any() else (prints[:0], prints[:0])


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all of ``print`` (distinct) within ``radius`` bits of each other.

    Only fingerprints are shuffled, once per slice they touch. The number of slices grows with the number
    of fingerprints, so that a slice stays within SLICE_VARIANTS.
    """
    masks = ball(radius // 2)
    if radius % 2:
        raise ValueError("the radius must be even, so that half of it is whole")
    count = prints.count()
    bits = (max(MIN_SLICES, count * len(masks) // SLICE_VARIANTS) - 1).bit_length()
    checks = parity_checks(bits)
    reached = [int(x) for x in np.unique(slice_of(masks, checks))]
    own = F.lit(0).cast("long")
    for i, check in enumerate(checks.view(np.int64).tolist()):
        own = own.bitwiseOR(F.shiftleft((F.bit_count(F.col("print").bitwiseAND(F.lit(check))) % 2).cast("long"), i))
    spread = prints.withColumn("own", own).select("print", "own", F.explode(F.array(*[F.lit(x) for x in reached])).alias("flip"))
    spread = spread.select("print", F.col("own").bitwiseXOR(F.col("flip")).alias("slice"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        values = table.column("print").to_numpy().view(np.uint64)
        a, b = links_in_slice(values, key[0].as_py(), masks, checks, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return spread.groupBy("slice").applyInArrow(run, "a long, b long")


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_key, print, component_id) of every row.

    component_id is the smallest doc_id reachable over links; rows without an id take part and get the
    smallest id of their component, null if it has none. Exact copies are one fingerprint from the start.
    """
    prints = materialize(fingerprints(docs))
    distinct = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    found = components(near_links(distinct.select("print"), radius))
    roots = distinct.join(found.hint("merge"), distinct["print"] == found["node"], "left")
    roots = roots.select("print", "least", F.coalesce("component", "print").alias("root"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    known = roots.join(ids.hint("merge"), "root").select(F.col("print").alias("_print"), "component_id")
    joined = prints.join(known.hint("merge"), F.col("print") == F.col("_print"))
    return joined.select("doc_id", "text_key", "print", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, the one of smallest id (then of smallest text key), all columns as they are."""
    grouped = classes(docs, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    # Without an id in the whole component its rows are told apart by fingerprint.
    by = F.coalesce(F.col("component_id"), F.col("print"))
    kept = grouped.groupBy(F.col("component_id").isNull().alias("_none"), by.alias("_class")).agg(first.alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"))
    same = F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_key"))
    chosen = packed(docs).join(kept.hint("merge"), same)
    # Rows equal in id and text are one.
    return chosen.dropDuplicates(["_id", "_key"]).select("row.*")
