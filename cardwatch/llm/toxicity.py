"""Toxicity categories by a classifier chain of linear models.

Categories, in chain order:
  insult   a word of the learned lexicon occurs (weak label, made from the labelled rows)
  toxic    the label ``toxic``
  severe   toxic, with at least SEVERE_WORDS different lexicon words (weak label)
The model of a category sees the words of a text and the probabilities of the categories before it. In
training these are out-of-fold predictions, so a later model does not trust an earlier one more than
it deserves. All is fitted in one task on a bounded sample of labelled rows (``max_rows``).
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import text_or_empty

CATEGORIES = ["insult", "toxic", "severe"]
MAX_ROWS = 6000
FOLDS = 4
FEATURES = 600
MIN_ROWS_OF_WORD = 4
#: A word is in the lexicon if this share of the labelled rows that have it is toxic.
LEXICON_SHARE = 0.8
SEVERE_WORDS = 4
PENALTY = 0.5
STEM = 6
CUT = 0.3
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def words(text: str) -> set[bytes]:
    """Different words (runs of letters, ASCII lower-cased), and the STEM first bytes of longer ones."""
    found = set(_WORD.findall(text.encode("utf-8", "surrogatepass").lower()))
    return found | {w[:STEM] + b"*" for w in found if len(w) > STEM}


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 25) -> np.ndarray:
    """Weights, the intercept last, by Newton's method with a ridge penalty on all but the intercept."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge * w
        curvature = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(curvature, gradient)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit(texts: list[str], toxic: np.ndarray) -> dict[str, Any]:
    """The chain: chosen words, lexicon, and weights per category. Without a toxic row all scores are near 0."""
    found = [words(t) for t in texts]
    rows, bad = Counter(w for f in found for w in f), Counter(w for f, y in zip(found, toxic, strict=True) if y for w in f)
    frequent = [w for w, n in rows.items() if n >= MIN_ROWS_OF_WORD]
    n, n_bad = max(len(texts), 1), float(toxic.sum())
    spread = n_bad / n * (1 - n_bad / n) + 1e-12
    # Words whose number of toxic rows is furthest from what chance would give.
    strength = {w: abs(bad[w] - rows[w] * n_bad / n) / np.sqrt(rows[w] * spread) for w in frequent}
    chosen = sorted(frequent, key=lambda w: (-strength[w], w))[:FEATURES]
    lexicon = sorted(w for w in chosen if bad[w] >= LEXICON_SHARE * rows[w] and strength[w] > 6)
    place = {w: i for i, w in enumerate(chosen)}
    x = np.zeros((len(texts), len(chosen)))
    for i, f in enumerate(found):
        x[i, [place[w] for w in f if w in place]] = 1
    hits = np.array([len(f & set(lexicon)) for f in found])
    labels = {"insult": (hits > 0) * 1.0, "toxic": toxic * 1.0, "severe": ((toxic > 0) & (hits >= SEVERE_WORDS)) * 1.0}
    fold = np.arange(len(texts)) % FOLDS
    models: dict[str, list[float]] = {}
    for name in CATEGORIES:
        y = labels[name]
        out = np.zeros(len(texts))
        for k in range(FOLDS):
            if (fold == k).any() and (fold != k).any():
                out[fold == k] = _probability(x[fold == k], _logistic(x[fold != k], y[fold != k]))
        models[name] = _logistic(x, y).tolist() if len(texts) else [0.0] * x.shape[1] + [-30.0]
        x = np.column_stack((x, out))
    return {"words": [w.decode("latin-1") for w in chosen], "lexicon": [w.decode("latin-1") for w in lexicon], "models": models}


class Chain:
    def __init__(self, model: str) -> None:
        spec = json.loads(model)
        self.place = {w.encode("latin-1"): i for i, w in enumerate(spec["words"])}
        self.models = [np.array(spec["models"][c]) for c in CATEGORIES]

    def score(self, texts: list[str]) -> np.ndarray:
        """(texts, CATEGORIES) probabilities."""
        x = np.zeros((len(texts), len(self.place)))
        for i, text in enumerate(texts):
            x[i, [self.place[w] for w in words(text) & self.place.keys()]] = 1
        for w in self.models:
            x = np.column_stack((x, _probability(x, w)))
        return x[:, len(self.place) :]


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "y")), strict=True)]
    rows.sort(key=lambda r: r[:2])
    model = fit([r[1] for r in rows], np.array([r[2] for r in rows]))
    yield pa.RecordBatch.from_arrays([pa.array([json.dumps(model)])], names=["model"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> str:
    """The chain fitted on at most ``max_rows`` labelled rows, those of lowest hashed id; null labels are left out."""
    known = labels.filter(F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows rows, by the limit.
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    found = texts.limit(2 * max_rows).repartition(1).mapInArrow(_fitted, "model string").collect()
    return found[0]["model"] if found else json.dumps(fit([], np.zeros(0)))


def scored(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, CATEGORIES, is_toxic) of every row, is_toxic where toxic reaches CUT; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            values = [chain.score(texts[i : i + 500]) for i in range(0, len(texts), 500)]
            values = np.concatenate(values) if values else np.zeros((0, len(CATEGORIES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in values.T.copy())], names=["doc_id", *CATEGORIES])

    fields = ", ".join(f"{c} double" for c in CATEGORIES)
    out = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id long, {fields}")
    return out.withColumn("is_toxic", F.col("toxic") >= CUT)
