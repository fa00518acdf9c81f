"""Words of many texts at once: one numpy pass over the bytes of a batch instead of one loop per text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Bytes that end a word: space, tab, line feed, vertical tab, form feed, return.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: ASCII that is neither digit nor letter; every byte of a character beyond ASCII belongs to a word.
NO_LETTERS = bytes(b for b in range(0x80) if not chr(b).isalnum())
#: Text bytes that are taken apart at once; a longer text is taken alone, whole.
CHUNK_BYTES = 8 << 20


@dataclass
class Words:
    """The words of several texts, one after another."""

    counts: np.ndarray  # words per text
    values: pa.Array  # distinct words, binary
    codes: np.ndarray  # one number per word, an index into ``values``

    @property
    def owners(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def bytes_of(self) -> list[bytes]:
        return self.values.to_pylist()


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the places where each starts, the end included; null is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data and len(texts) else np.empty(0, np.uint8)
    return raw, places - places[0]


def split_words(texts: pa.Array, separators: bytes = BLANKS, lower: bool = False) -> Words:
    """Maximal runs of bytes that are no separators; ``lower`` changes A-Z only."""
    raw, places = _flat(texts)
    inside = np.ones(256, bool)
    inside[np.frombuffer(separators, np.uint8)] = False
    inside = inside[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[places[:-1]] = True
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | first[:-1])) if len(raw) else np.empty(0, np.int64)
    last = np.zeros(len(raw) + 1, bool)
    last[places[1:]] = True
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | last[1:])) + 1 if len(raw) else np.empty(0, np.int64)
    kept = raw[inside]
    if lower:
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        kept = table[kept]
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts)))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    coded = words.dictionary_encode()
    counts = np.diff(np.searchsorted(starts, places))
    return Words(counts, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text; a longer text comes alone.

    Small batches are put together and large ones cut, so memory follows ``size`` and the longest text.
    """
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        low = 0
        for at, length in enumerate(lengths.tolist()):
            if total and total + length > size:
                held.append(batch.slice(low, at - low))
                yield joined(held)
                held, total, low = [], 0, at
            total += length
        held.append(batch.slice(low))
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0] if sum(map(len, parts)) else parts[0]
