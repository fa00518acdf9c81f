"""What several text operators share: reading, a scratch table, connected components."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.session import materialize, scratch_path

#: Bytes that end a word everywhere in this folder: space, tab, line feed, vertical tab, form feed, return.
#: ``bytes.split()`` splits on exactly these, so words of a text are ``text.encode().split()``.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet to the shared folder: compressed, and columns can be read alone."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Has the driver drop what nobody refers to any more: only then Spark deletes the shuffle files behind it.

    Left alone, that waits for the driver's own collections, while a job of many steps fills the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def packed(docs: DataFrame) -> DataFrame:
    """One column ``row`` that holds all columns, so that joins may bring columns of any name."""
    return docs.select(F.struct(*docs.columns).alias("row"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (a long, b long): (node, component), component being the smallest node.

    Alternates two joins per round (every node hands its larger neighbours, then its smaller ones, to its
    smallest neighbour), which ends after about log(n) rounds whatever the shape. Neighbours are reduced
    to a minimum before they are shuffled, so a node with very many links costs no more than others.
    Each round is checkpointed; only two numbers per round reach the driver. Joins are merge joins by hint:
    a checkpointed table's size is guessed from its plan, which is no ground to broadcast it.
    """
    edges = (
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges, state = materialize(edges), None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
