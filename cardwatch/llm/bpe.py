"""Byte-pair encoding and decoding with a given tokenizer file.

Merges come from a segment tree over the ranks of adjacent pairs: its root is the lowest rank, the
leftmost among equals; a merge changes at most three leaves, each in logarithmic time.

The reading of the file covers what word-end vocabularies use: NFC, white space to one space, lower case;
pieces cut by a pattern; bytes as printable characters; a suffix on the last symbol of a piece. Any other
setting in the file is refused, never guessed.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cardwatch.llm.common import text_or_empty

NONE = 1 << 60
CACHED_PIECES = 250_000
#: Characters of text after which a batch of codes is handed on; one longer text is a batch of its own.
BATCH_CHARS = 1_000_000
CONTRACT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where printable, else the next free one above 255."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class PairTree:
    """Minimum tree over pair ranks, leaf i being the pair that starts at symbol i."""

    def __init__(self, ranks: list[int]) -> None:
        self.size = size = 1 << max(len(ranks) - 1, 0).bit_length()
        self.nodes = nodes = [NONE] * size + ranks + [NONE] * (size - len(ranks))
        for i in range(size - 1, 0, -1):
            left, right = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = left if left <= right else right

    def first_lowest(self) -> int:
        """Leaf of the leftmost lowest rank, -1 if there is no pair left."""
        nodes, i = self.nodes, 1
        if nodes[1] == NONE:
            return -1
        while i < self.size:
            i *= 2
            if nodes[i] > nodes[i + 1]:
                i += 1
        return i - self.size

    def set(self, leaf: int, rank: int) -> None:
        nodes, i = self.nodes, leaf + self.size
        if nodes[i] == rank:
            return
        nodes[i] = rank
        while i > 1:
            i //= 2
            left, right = nodes[2 * i], nodes[2 * i + 1]
            low = left if left <= right else right
            if nodes[i] == low:
                return
            nodes[i] = low


class Codec:
    """Encoder and decoder of one tokenizer file.

    ``pieces`` holds codes of up to CACHED_PIECES pieces; when full it becomes ``older``, from which pieces
    that are met again come back, so that frequent ones are never forgotten.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        plain = not (model["dropout"] or model["unk_token"] or model["byte_fallback"] or model["ignore_merges"])
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in before] != ["Split", "ByteLevel"] or not plain:
            raise ValueError("this tokenizer file has settings that are not covered")
        if spec["decoder"] or not before[0]["invert"] or before[0]["behavior"] != "Removed" or before[1]["add_prefix_space"]:
            raise ValueError("this tokenizer file has settings that are not covered")
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.suffix: str = model["end_of_word_suffix"]
        self.ranks = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.symbols = byte_symbols()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        cuts = "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))
        self.cut = regex.compile(f"({cuts})") if cuts else None
        self.piece = regex.compile(before[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.pieces: dict[str, tuple[int, str, str]] = {}  # number of ids, ids as text, tokens as text
        self.older: dict[str, tuple[int, str, str]] = {}

    def merge(self, piece: str) -> list[int]:
        """Token ids of one piece."""
        parts = [self.symbols[b] for b in piece.encode("utf-8", "surrogatepass")]
        parts[-1] += self.suffix
        count, ranks = len(parts), self.ranks
        after = [*range(1, count), -1]
        ahead = list(range(-1, count - 1))
        tree = PairTree([ranks.get((parts[i], parts[i + 1]), NONE) for i in range(count - 1)] + [NONE])
        while (i := tree.first_lowest()) >= 0:
            j = after[i]
            parts[i] += parts[j]
            parts[j] = ""
            k = after[i] = after[j]
            tree.set(j, NONE)
            if k >= 0:
                ahead[k] = i
                tree.set(i, ranks.get((parts[i], parts[k]), NONE))
            else:
                tree.set(i, NONE)
            if (h := ahead[i]) >= 0:
                tree.set(h, ranks.get((parts[h], parts[i]), NONE))
        return [self.ids[p] for p in parts if p and p in self.ids]

    def _code(self, piece: str) -> tuple[int, str, str]:
        if len(self.pieces) >= CACHED_PIECES:
            self.pieces, self.older = {}, self.pieces
        if (code := self.older.get(piece)) is None:
            ids = self.merge(piece)
            code = (len(ids), " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids]))
        self.pieces[piece] = code
        return code

    def _codes(self, text: str) -> list[tuple[int, str, str]]:
        codes = []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                codes.append((1, str(self.special[part]), part))
                continue
            # Lower case is taken character by character, so a capital sigma never takes its final form.
            clean = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            codes += [self.pieces.get(piece) or self._code(piece) for piece in self.piece.findall(clean)]
        return codes

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self._codes(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens, special ones too, joined by a space; ids outside the vocabulary give nothing."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def coded(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids and the decoded text, each joined by a space."""
        codes = [c for c in self._codes(text) if c[0]]
        return sum([c[0] for c in codes]), " ".join([c[1] for c in codes]), " ".join([c[2] for c in codes])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and hashes of the ids and of the decoded text."""
        count, *parts = self.coded(text)
        return count, *(hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in parts)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def short_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows with about BATCH_CHARS characters, and their texts; nulls are empty."""
    for batch in batches:
        texts, start, held = [], 0, 0
        column = batch.column("text")
        for i in range(batch.num_rows):
            texts.append(column[i].as_py() or "")
            held += len(texts[-1])
            if held >= BATCH_CHARS or i + 1 == batch.num_rows:
                yield batch.slice(start, i + 1 - start), texts
                texts, start, held = [], i + 1, 0


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` plus ids array<int> and decoded string; null texts count as empty. No shuffle.

    Columns of these names in ``docs`` are replaced.
    """
    base = docs.drop("ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch, texts in short_batches(batches):
            counts, ids, back = zip(*map(coder.coded, texts), strict=True)
            ends = np.cumsum((0, *counts), dtype=np.int32)
            values = np.fromstring(" ".join(filter(None, ids)), np.int32, sep=" ")
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            columns = [*batch.columns, listed, pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "ids", "decoded"])

    schema = T.StructType([*base.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return base.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """CONTRACT for every row; hashes are made beside the encoder, so ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch, texts in short_batches(batches):
            n, ids, back = zip(*map(coder.digest, texts), strict=True)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, CONTRACT)
