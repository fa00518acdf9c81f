"""Registered queries of this folder, each over a whole table with production settings, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.llm import (
    bpe,
    fingerprints,
    lines,
    lm,
    mixing,
    periods,
    pii,
    quality_model,
    ranking,
    rules,
    simhash,
    substrings,
    toxicity,
)
from cardwatch.llm.common import documents

#: Place of the vocabulary file; a parameter of the operator.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_near_links(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_model.scored(docs, quality_model.train(docs, _labels(spark, sf_dir)))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(documents(spark, sf_dir)).drop("kept_text")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), TOKENIZER)


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return lm.scored(docs, lm.train(docs))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.repetitions(documents(spark, sf_dir)).drop("runs", "collapsed")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_pii": op6_pii,
    "op7_quality_rules": op7_quality_rules,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_bpe": op10_bpe,
    "op11_lm_scores": op11_lm_scores,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {"op2_mixing": mixing.SQL, "op7_quality_rules": rules.SQL, "op13_ranked_search": ranking.SQL}
