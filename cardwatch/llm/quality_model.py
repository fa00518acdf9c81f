"""Text quality by a small byte-level convolutional network in numpy.

The bytes of a whole text are cut into overlapping chunks. FILTERS learned filters of WIDTH bytes slide over
each chunk; each filter's largest response in a chunk is kept; the largest and the mean over all chunks
go through one hidden layer into one probability. A filter over one-hot bytes is a table of WIDTH x 256
weights, so a response is a sum of WIDTH looked-up values.

The network is fitted in one task on a bounded sample of labelled rows (``max_rows``); weights, a few
hundred kB, go to all tasks; every text is scored where it lies.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import text_or_empty

CHUNK = 512
OVERLAP = 64
WIDTH = 8
STRIDE = 4
FILTERS = 24
HIDDEN = 16
MAX_ROWS = 4000
EPOCHS = 20
BATCH = 32
LEARNING_RATE = 0.004
DECAY = 1e-4
CUT = 0.3
_SPOTS = (CHUNK - WIDTH) // STRIDE + 1
#: Chunks scored at once, which bounds memory for texts of any length.
_TOGETHER = 256


def chunks(text: str) -> np.ndarray:
    """(n, CHUNK) bytes; the last chunk is filled up with zero bytes, an empty text is one chunk of them."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    padded = np.zeros(n * step + OVERLAP, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def responses(table: np.ndarray, part: np.ndarray) -> np.ndarray:
    """(n, _SPOTS, FILTERS) of a block of chunks."""
    out = table[0][part[:, 0 : 1 + (_SPOTS - 1) * STRIDE : STRIDE]]
    for k in range(1, WIDTH):
        out += table[k][part[:, k : k + 1 + (_SPOTS - 1) * STRIDE : STRIDE]]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def pooled(weights: dict[str, np.ndarray], text: str) -> np.ndarray:
    """Largest response per filter and chunk, (n, FILTERS), before the bias."""
    cut = chunks(text)
    tops = [responses(weights["table"], cut[i : i + _TOGETHER]).max(axis=1) for i in range(0, len(cut), _TOGETHER)]
    return np.concatenate(tops)


def score(weights: dict[str, np.ndarray], texts: list[str]) -> np.ndarray:
    rows = []
    for text in texts:
        tops = np.maximum(pooled(weights, text) + weights["bias"], 0)
        rows.append(np.concatenate((tops.max(axis=0), tops.mean(axis=0))))
    hidden = np.tanh(np.array(rows, np.float32).reshape(len(rows), 2 * FILTERS) @ weights["w1"] + weights["b1"])
    return _sigmoid(hidden @ weights["w2"] + weights["b2"]).astype(np.float64)


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights after ``epochs`` passes of Adam; without both labels the prior alone is learned."""
    rng = np.random.default_rng(seed)
    w = {
        "table": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)),
        "bias": np.zeros(FILTERS),
        "w1": rng.normal(0, 0.2, (2 * FILTERS, HIDDEN)),
        "b1": np.zeros(HIDDEN),
        "w2": rng.normal(0, 0.2, HIDDEN),
        "b2": np.zeros(1),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    w["b2"] += np.float32(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        w["w2"] *= 0
        return w
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    # Both labels weigh the same in sum up to a factor, so the rare one is learned too.
    balance = np.where(labels > 0, 1.0, np.sqrt(share / (1 - share))).astype(np.float32)
    cuts = [chunks(x) for x in texts]
    step = 0
    for epoch in range(epochs):
        rate = LEARNING_RATE * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            part = np.concatenate([cuts[i] for i in rows])
            of = np.repeat(np.arange(len(rows)), [len(cuts[i]) for i in rows])
            spots, tops = [], []
            for i in range(0, len(part), _TOGETHER):
                r = responses(w["table"], part[i : i + _TOGETHER])
                spot = r.argmax(axis=1)
                spots.append(spot)
                tops.append(np.take_along_axis(r, spot[:, None], 1)[:, 0])
            spots, raw = np.concatenate(spots), np.concatenate(tops) + w["bias"]
            act = np.maximum(raw, 0)
            starts = np.searchsorted(of, np.arange(len(rows)))
            sizes = np.bincount(of)[:, None].astype(np.float32)
            best = np.maximum.reduceat(act, starts)
            x = np.concatenate((best, np.add.reduceat(act, starts) / sizes), axis=1)
            h = np.tanh(x @ w["w1"] + w["b1"])
            p = _sigmoid(h @ w["w2"] + w["b2"])
            d = ((p - labels[rows]) * balance[rows] / len(rows)).astype(np.float32)
            dh = d[:, None] * w["w2"] * (1 - h * h)
            dx = dh @ w["w1"].T
            is_best = (act == best[of]) & (raw > 0)
            da = np.where(is_best, dx[of, :FILTERS], 0) + np.where(raw > 0, (dx[:, FILTERS:] / sizes)[of], 0)
            g = {"w1": x.T @ dh, "b1": dh.sum(0), "w2": h.T @ d, "b2": np.array([d.sum()]), "bias": da.sum(0)}
            table = np.zeros_like(w["table"])
            filters = np.broadcast_to(np.arange(FILTERS), spots.shape)
            for k in range(WIDTH):
                seen = np.take_along_axis(part, spots * STRIDE + k, 1)
                np.add.at(table[k], (seen, filters), da)
            g["table"] = table
            step += 1
            for k in w:
                grad = g[k].astype(np.float32) + DECAY * w[k]
                m[k] += 0.1 * (grad - m[k])
                s[k] += 0.001 * (grad * grad - s[k])
                w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return w


def pack(weights: dict[str, np.ndarray]) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **weights)
    return buffer.getvalue()


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as file:
        return dict(file)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(i, t, y) for b in batches for i, t, y in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "y")), strict=True)]
    rows.sort(key=lambda r: (r[0], r[1]))
    weights = fit([r[1] for r in rows], np.array([r[2] for r in rows], np.float32))
    yield pa.RecordBatch.from_arrays([pa.array([pack(weights)], pa.binary())], names=["weights"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> bytes:
    """Weights fitted on at most ``max_rows`` labelled rows that are not held out.

    The rows are those of lowest hashed id, so a larger bound adds to a smaller one. Rows without a
    label are left out; without any labelled row the score is one half.
    """
    known = labels.filter(~held_out() & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("float").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows rows, by the limit.
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    found = texts.limit(2 * max_rows).repartition(1).mapInArrow(_fitted, "weights binary").collect()
    return bytes(found[0]["weights"]) if found else pack(fit([], np.array([], np.float32)))


def scored(docs: DataFrame, weights: bytes) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null texts count as empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unpack(weights)
        for batch in batches:
            values = score(own, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
