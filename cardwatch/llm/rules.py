"""Quality rules per document, and host-level rules built on them.

Host verdict: failures are counted per host, the hosts' rates give a beta prior by the method of moments,
and each host's rate is shrunk towards the prior's mean. A host whose shrunk rate is above ``max_rate``
takes all its documents with it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import packed
from cardwatch.session import materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.6
SALTS = 64
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(text: str) -> tuple[int, int, int, int, int]:
    """The values of MEASURES for one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]  # strip() removes the bytes that end words
    repeats = 0
    if len(words) > 2:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            again = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
            covered = np.zeros(len(words), bool)
            for shift in range(3):
                covered[shift : shift + len(windows)] |= again
            repeats = int(covered.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(x or "") for x in batch.column("text").to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
        kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*names, *MEASURES])


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, source, MEASURES, base_failed) of every row; a null text counts as empty. No shuffle."""
    narrow = docs.select("doc_id", "source", "text")
    fields = ", ".join(f"{n} long" for n in MEASURES)
    kinds = ", ".join(f"{n} {t}" for n, t in narrow.dtypes if n != "text")
    return narrow.mapInArrow(_measured, f"{kinds}, {fields}").withColumn("base_failed", base_failed())


def base_failed() -> Column:
    too_short = F.col("n_words") < MIN_WORDS
    return too_short | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: (host, n_docs, n_failed, shrunk_rate); documents without a host form one host.

    With m and v the mean and variance of the hosts' rates, the prior is Beta(m k, (1 - m) k) where
    k = m (1 - m) / v - 1, at least 0.001; if all hosts have one rate, k is infinite and the shrunk rate is m.
    """
    hosts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    weight = F.greatest(F.col("m") * (1 - F.col("m")) / F.nullif(F.col("v"), F.lit(0.0)) - 1, F.lit(0.001))
    shrunk = (F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k"))
    # The prior is one row by construction.
    joined = hosts.join(F.broadcast(prior.withColumn("k", weight)))
    return joined.select("host", "n_docs", "n_failed", F.coalesce(shrunk, F.col("m")).alias("shrunk_rate"))


def with_verdicts(docs: DataFrame, hosts: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``docs`` plus host_rejected, from the rates of ``host_rates``.

    Each host's verdict is copied ``SALTS`` times and documents spread over the copies, so that a host with
    a third of all rows is not one task.
    """
    verdicts = hosts.select(
        F.col("host").alias("_host"),
        (F.col("shrunk_rate") > max_rate).alias("host_rejected"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
    )
    salted = docs.withColumn("_at", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    same = F.col("_at").eqNullSafe(F.col("_salt")) & F.col(host).eqNullSafe(F.col("_host"))
    joined = salted.join(verdicts.hint("merge"), same, "left")
    return joined.select(*docs.columns, F.coalesce("host_rejected", F.lit(False)).alias("host_rejected"))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, MEASURES, base_failed, kept) of every row. An empty table gives an empty one."""
    measured = materialize(measures(docs))
    judged = with_verdicts(measured, host_rates(measured))
    kept = ~(F.col("base_failed") | F.col("host_rejected"))
    return judged.select("doc_id", *MEASURES, "base_failed", kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass, all columns as they are. Rows equal in id and text share a verdict."""
    narrow = docs.select("doc_id", "source", "text")
    key = F.xxhash64("text")
    fields = ", ".join(f"{n} long" for n in MEASURES)
    kinds = ", ".join(f"{n} {t}" for n, t in narrow.dtypes if n != "text")
    measured = narrow.withColumn("_key", key).mapInArrow(_measured, f"{kinds}, _key long, {fields}")
    measured = materialize(measured.withColumn("base_failed", base_failed()))
    judged = with_verdicts(measured, host_rates(measured))
    out = judged.filter(F.col("base_failed") | F.col("host_rejected"))
    out = out.select(F.col("doc_id").alias("_id"), F.col("_key"), F.col("source").alias("_source")).distinct()
    same = F.col("row.doc_id").eqNullSafe(F.col("_id")) & F.xxhash64("row.text").eqNullSafe(F.col("_key"))
    same = same & F.col("row.source").eqNullSafe(F.col("_source"))
    return packed(docs).join(out.hint("merge"), same, "left_anti").select("row.*")


SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT row_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
spread AS (SELECT row_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM words),
windows AS (
  SELECT row_id, place, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c
  FROM spread WINDOW o AS (PARTITION BY row_id ORDER BY place)),
found AS (
  SELECT row_id, place, count(*) OVER (PARTITION BY row_id, a, b, c) > 1 AS again FROM windows
  WHERE c IS NOT NULL),
covered AS (
  SELECT row_id, count(DISTINCT place + s) AS n FROM (
    SELECT row_id, place, unnest([0, 1, 2]) AS s FROM found WHERE again) GROUP BY row_id),
lines AS (
  SELECT row_id, count(*) - count(DISTINCT line) AS n FROM (
    SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_id),
measured AS (
  SELECT t.row_id, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM texts t JOIN words USING (row_id) LEFT JOIN lines l USING (row_id) LEFT JOIN covered c USING (row_id)),
failed AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM measured),
hosts AS (
  SELECT source, count(*) AS n_docs, count(*) FILTER (WHERE base_failed) AS n_failed FROM failed GROUP BY source),
prior AS (SELECT avg(n_failed / n_docs) AS m, var_pop(n_failed / n_docs) AS v FROM hosts),
strength AS (SELECT m, greatest(m * (1 - m) / nullif(v, 0) - 1, 0.001) AS k, v FROM prior),
verdicts AS (
  SELECT source, CASE WHEN v = 0 THEN m ELSE (n_failed + m * k) / (n_docs + k) END > {MAX_HOST_RATE} AS rejected
  FROM hosts, strength)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR rejected) AS kept
FROM failed f JOIN verdicts v ON f.source IS NOT DISTINCT FROM v.source
"""
