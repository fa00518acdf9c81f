"""Periodic runs of words, from the Lyndon arrays that the first phase of a grouping suffix sorter leaves behind.

A run is a maximal stretch whose smallest period fits into it ``exponent`` times. Every run holds a Lyndon word of
its period's length that is the longest Lyndon word at its place, in the order of the words or in the reverse order.
So one walk over both Lyndon arrays names every run, and common extensions to both sides give its ends.

Lyndon arrays: suffixes are grouped by first word, and groups are taken from the last to the first. Each
member points to the nearest place to its left in a smaller group; places move to a new group right after their own,
by how many members point to them. When a group is taken, its common prefix is the longest Lyndon word there.
No suffix array is finished for this: the second phase is left out.

Common extensions use names of all blocks of 2^k words, given by sorting; a descent over k is exact.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cardwatch.llm.tokens import chunks, split_words

EXPONENT = 4
MIN_LENGTH = 6


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, in the order of the numbers; linear but for one sort."""
    n = len(ranks)
    label, prefix = [0] * n, [0] * n  # group of a place; common prefix of a group, by the group's label
    members: list[list[int]] = [[] for _ in range(n)]
    size = [0] * n
    start = None
    for at, i in enumerate(sorted(range(n), key=ranks.__getitem__)):
        if start is None or ranks[i] != ranks[members[start][0]]:
            start = at
            prefix[start] = 1
        members[start].append(i)
        size[start] += 1
        label[i] = start
    # A label is the first slot of its group among all suffixes, so labels compare as groups do.
    before, found = [-1] * n, [0] * n
    for group in range(n - 1, -1, -1):
        if not size[group]:
            continue
        length = prefix[group]
        pointed: dict[int, int] = {}
        for i in members[group]:
            if label[i] != group:
                continue  # moved on since
            found[i] = length
            j = i - 1
            while j >= 0 and label[j] >= group:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, count in pointed.items():
            moves.setdefault((-count, label[j]), []).append(j)
        for count, old in sorted(moves):
            moved = moves[count, old]
            grown = prefix[old] - count * length
            size[old] -= len(moved)
            new = old + size[old]
            size[new], members[new], prefix[new] = len(moved), moved, grown
            for j in moved:
                label[j] = new
    return found


class Blocks:
    """Names of all blocks of 2^k words: equal names mean equal blocks."""

    def __init__(self, codes: np.ndarray, longest: int) -> None:
        self.n = len(codes)
        self.names = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
        while (2 << len(self.names) - 1) <= longest:
            last, half = self.names[-1], 1 << (len(self.names) - 1)
            pair = last[: self.n - 2 * half + 1] * (int(last.max()) + 1) + last[half : half + self.n - 2 * half + 1]
            self.names.append(np.unique(pair, return_inverse=True)[1])

    def common(self, a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Words that the places a < b have in common to the right, b staying below ``stop``."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            step, names = 1 << k, self.names[k]
            fits = np.flatnonzero(b + length + step <= stop)
            x, y = a[fits] + length[fits], b[fits] + length[fits]
            # A block of a size can agree more than once only at the top of the descent.
            while len(fits):
                equal = names[x] == names[y]
                fits = fits[equal]
                length[fits] += step
                fits = fits[b[fits] + length[fits] + step <= stop[fits]] if k == len(self.names) - 1 else fits[:0]
                x, y = a[fits] + length[fits], b[fits] + length[fits]
        return length

    def common_left(self, a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Words before a and before b that agree, a staying at or above ``stop``."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            step, names = 1 << k, self.names[k]
            fits = np.flatnonzero(a - length - step >= stop)
            while len(fits):
                equal = names[a[fits] - length[fits] - step] == names[b[fits] - length[fits] - step]
                fits = fits[equal]
                length[fits] += step
                fits = fits[a[fits] - length[fits] - step >= stop[fits]] if k == len(self.names) - 1 else fits[:0]
        return length


@dataclass
class Runs:
    owners: np.ndarray  # number of the text
    starts: np.ndarray  # first word within the text
    lengths: np.ndarray
    periods: np.ndarray


def stretches(codes: np.ndarray, owners: np.ndarray, exponent: int, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) place of all stretches that may hold a run.

    In a run each three words in a row occur at least min(exponent - 1, min_length - 2) times, so words between
    rarer triples need no look. This only leaves out places that are in no run.
    """
    none = np.empty(0, np.int64)
    if len(codes) < max(min_length, 3):
        return none, none
    top = int(codes.max()) + 1
    # Numbers of pairs, then of triples, so that no product overflows; a triple across two texts is no triple.
    pairs = np.unique(codes[:-1].astype(np.int64) * top + codes[1:], return_inverse=True)[1]
    triples = np.unique(pairs[:-1] * top + codes[2:], return_inverse=True)[1]
    whole = owners[2:] == owners[:-2]
    keys = triples * (int(owners.max()) + 1) + owners[2:]
    _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    often = whole & (times[which] >= min(exponent - 1, min_length - 2))
    marked = np.zeros(len(codes) + 1, bool)
    for shift in range(3):
        marked[shift : shift + len(often)] |= often
    edge = np.concatenate(([True], owners[1:] != owners[:-1], [True]))
    begins = np.flatnonzero(marked & (edge | np.concatenate(([True], ~marked[:-1]))))
    ends = np.flatnonzero(marked[:-1] & (edge[1:] | ~marked[1:])) + 1
    long = ends - begins >= min_length
    return begins[long], ends[long]


def find_runs(codes: np.ndarray, counts: np.ndarray, exponent: int = EXPONENT, min_length: int = MIN_LENGTH) -> Runs:
    """All runs of length at least max(min_length, exponent * period), by text, start and period.

    ``codes`` numbers the words of all texts, ``counts`` says how many each text has. ``exponent`` is 2 at least.
    """
    if exponent < 2 or min_length < 3:
        raise ValueError("an exponent below 2 makes no run; lengths below 3 are not looked for")
    owners = np.repeat(np.arange(len(counts)), counts)
    begins, ends = stretches(codes, owners, exponent, min_length)
    if not len(begins):
        return Runs(*(np.empty(0, np.int64) for _ in range(4)))
    sizes = ends - begins
    offsets = np.cumsum(sizes) - sizes
    place = np.repeat(begins - offsets, sizes) + np.arange(sizes.sum())
    packed = codes[place].astype(np.int64)
    low, high = np.repeat(offsets, sizes), np.repeat(offsets + sizes, sizes)
    left, right, period = [], [], []
    listed = packed.tolist()
    for sign in (1, -1):
        lengths: list[int] = []
        for at, n in zip(offsets.tolist(), sizes.tolist(), strict=True):
            part = listed[at : at + n]
            lengths += lyndon_lengths(part if sign == 1 else [-x for x in part])
        found = np.array(lengths)
        # The root may not be longer than the stretch has room for.
        roots = np.flatnonzero(found * exponent <= high - low)
        left.append(roots)
        right.append(roots + found[roots])
        period.append(found[roots])
    a, b, q = (np.concatenate(x) for x in (left, right, period))
    blocks = Blocks(packed, int(sizes.max()))
    after = blocks.common(a, b, high[a])
    before = blocks.common_left(a, b, low[a])
    length = q + after + before
    good = length >= np.maximum(min_length, exponent * q)
    first = place[a[good] - before[good]]
    runs = np.unique(np.stack([owners[first], first, length[good], q[good]]), axis=1)
    by = np.lexsort((runs[3], runs[1]))  # places ascend with the texts
    owner, first, length, q = runs[:, by]
    return Runs(owner, first - (np.cumsum(counts) - counts)[owner], length, q)


def rewritten(codes: np.ndarray, counts: np.ndarray, doc_ids: list[int | None]) -> np.ndarray:
    """The words of the query's documents: one in ten has its words repeated from a place on, with a period.

    Both are drawn by the checksum of the decimal id. A row without an id stays as it is.
    """
    out = codes.copy()
    for at, n, doc in zip((np.cumsum(counts) - counts).tolist(), counts.tolist(), doc_ids, strict=True):
        h = 1 if doc is None else zlib.crc32(str(doc).encode())
        if n and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[at + a : at + n] = codes[at + a + np.arange(n - a) % p]
    return out


def _reported(batches: Iterator[pa.RecordBatch], exponent: int, min_length: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        words = split_words(batch.column("text"))
        doc_ids = batch.column("doc_id").to_pylist()
        codes = rewritten(words.codes, words.counts, doc_ids)
        runs = find_runs(codes, words.counts, exponent, min_length)
        cuts = np.searchsorted(runs.owners, np.arange(len(doc_ids) + 1))
        values, rows = words.bytes_of(), []
        offsets = np.concatenate(([0], np.cumsum(words.counts)))
        listed = codes.tolist()
        for i in range(len(doc_ids)):
            s, n, q = (x[cuts[i] : cuts[i + 1]] for x in (runs.starts, runs.lengths, runs.periods))
            own = listed[offsets[i] : offsets[i + 1]]
            best: tuple = (None, None, None, None)
            spans: list[dict[str, int]] = []
            if len(s):
                top = np.lexsort((q, s, -n))[0]
                best = (int(s[top]), int(n[top]), int(q[top]), 1000 * int(n[top]) // int(q[top]))
                step = np.zeros(len(own) + 1, np.int64)
                np.add.at(step, s + q, 1)
                np.add.at(step, s + n, -1)
                keep = np.cumsum(step[:-1]) == 0
                own = np.array(own)[keep].tolist()
                spans = [{"start": x, "length": y, "period": z} for x, y, z in zip(s.tolist(), n.tolist(), q.tolist(), strict=True)]
            lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in spans)
            kept = b" ".join([values[c] for c in own])
            digests = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()
            rows.append((doc_ids[i], len(spans), *best, *digests, spans, kept.decode("utf-8", "replace")))
        yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, row, strict=True)) for row in rows], schema=SCHEMA)


SCHEMA = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
    + [(n, pa.string()) for n in ("runs_sha256", "collapsed_sha256")]
    + [("runs", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), ("collapsed", pa.string())]
)
FIELDS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed string"
)


def repetitions(docs: DataFrame, exponent: int = EXPONENT, min_length: int = MIN_LENGTH) -> DataFrame:
    """Per row: its runs, the longest one, their digests and the text without repetitions (FIELDS). No shuffle.

    A word goes if any run holds it after that run's first period. Null and blank texts have no words, no runs, and
    the digests of nothing; rows equal in all columns get a row each; an empty table gives an empty one.
    Further columns of ``docs`` are not read. Memory follows the longest text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _reported(batches, exponent, min_length)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, FIELDS)
