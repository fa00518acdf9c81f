"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, document after document, are cut into blocks of BLOCK_WORDS. Targets say how many
blocks (slots) each source fills. All slots together are dealt into output shards by one pseudorandom
permutation: each shard's counts by source are multinomial draws without replacement, so they vary from
shard to shard while every source's total is met. A source's slots run through permutations of its block
numbers, a new one for each pass over the source, and meet the blocks in a join on (source, block).
A block is used at most MAX_EPOCHS times, hence so is each word of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.llm.common import WORD, packed
from cardwatch.session import materialize

BLOCK_WORDS = 64
SHARD_BLOCKS = 1024
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Documents of a source are numbered within this many parts of it, so a hot source is not one task.
PARTS = 1024
#: Slots are made in runs of this many.
RUN = 4_096
ROUNDS = 10
PRIME = 2_147_483_647


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(x: str, n: str, key: str) -> str:
    """SQL for a permutation of 0..n-1 applied to x; ``key`` (a long below 2**31) picks the permutation.

    Swap-or-not shuffle (Hoang, Morris, Rogaway 2012): in each round x and k - x mod n are partners, and a
    bit that depends on the pair alone says whether they swap. Right for every n, with no retries.
    """
    k = f"((({key}) * 48271 + r * 69621 + 12345) % {PRIME} * 16807 % {PRIME} % ({n}))"
    y = f"(({k} - x + ({n})) % ({n}))"
    mix = f"((greatest(x, {y}) % {PRIME} * 48271 + ({key}) + r * 40503) % {PRIME})"
    swap = f"({mix} + 1) * {mix} % {PRIME} div 256 % 2 = 1"
    return f"aggregate(sequence(1L, {ROUNDS}L), {x}, (x, r) -> if({swap}, {y}, x))"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_key, size) of every row, kept."""
    size = word_count()
    return materialize(docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), size.alias("size")))


def plan_sources(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: number, weight, source_size, target, blocks, slots, first_slot, all_slots.

    Targets share the total size by weight; a source stops at MAX_EPOCHS times its size and the rest is
    shared again. Sorted by (size / weight), sources stop one after the other, so whether a source
    stops follows from sums over those before it. The windows see one row per source, not rows of the data.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("number") - 1) % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("number", F.row_number().over(order).cast("long")).withColumn("weight", weights.cast("long"))
    per = per.withColumn("most", F.col("source_size") * MAX_EPOCHS)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rising = Window.orderBy(F.col("most") / F.col("weight"), "number")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))
    shares = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", rest / shares).withColumn("stops", F.col("most") < F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(whole)
    target = F.when(F.col("stops"), F.col("most").cast("double")).otherwise(level * F.col("weight"))
    per = per.withColumn("target", target).withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    slots = F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)
    slots = F.when(F.col("source_size") > 0, F.least(slots, F.col("blocks") * MAX_EPOCHS)).otherwise(F.lit(0))
    per = per.withColumn("slots", slots.cast("long"))
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("first_slot", F.coalesce(F.sum("slots").over(upto), F.lit(0)))
    columns = ["source", "number", "weight", "source_size", "target", "blocks", "slots", "first_slot"]
    return materialize(per.select(*columns, F.sum("slots").over(whole).alias("all_slots")))


def deal(sources: DataFrame, seed: int = 7) -> DataFrame:
    """One row per output slot: (number, block, slot, shard)."""
    runs = sources.filter("slots > 0").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {RUN}"))))
    # A number of partitions is given, since runs are tiny rows that would be merged back into one task.
    runs = runs.repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "number", "run")
    j = F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("slots"), (F.col("run") + 1) * RUN) - 1))
    dealt = runs.withColumn("j", j)
    dealt = dealt.withColumn("key", F.expr(f"(number * 9973 + j div blocks * 31337 + {seed}) % {PRIME}"))
    block = permuted("j % blocks", "blocks", "key")
    slot = permuted("first_slot + j", "all_slots", f"{seed}L")
    dealt = dealt.select("number", F.expr(block).alias("block"), F.expr(slot).alias("slot"))
    return dealt.withColumn("shard", F.expr(f"slot div {SHARD_BLOCKS}"))


def shard_counts(dealt: DataFrame) -> DataFrame:
    """Blocks per output shard and source."""
    return dealt.groupBy("shard", "number").agg(F.count("*").alias("n_blocks"))


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` plus its source's plan and ``start``, the place of its first word in its source."""
    part = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(PARTS))
    sizes = sizes.withColumn("part", part)
    totals = sizes.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("part_start", F.coalesce(F.sum("part_size").over(upto), F.lit(0)))
    plan = sources.withColumnRenamed("source", "_source")
    totals = totals.join(plan.hint("merge"), totals["source"].eqNullSafe(plan["_source"])).drop("source", "part_size")
    totals = totals.withColumnRenamed("part", "_part")
    joined = sizes.join(totals.hint("merge"), sizes["source"].eqNullSafe(totals["_source"]) & (sizes["part"] == totals["_part"]))
    within = Window.partitionBy("source", "part").orderBy("doc_id", "size", "text_key")
    before = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return joined.withColumn("start", F.col("part_start") + before).drop("_source", "_part", "part", "part_start")


def pieces(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and block it reaches into: ``from_word`` and ``n_words`` of the document lie in ``block``.

    A document without words gives one row without a block.
    """
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    blocks = F.when(F.col("size") > 0, F.sequence(first, last))
    cut = rows.withColumn("block", F.explode_outer(blocks))
    low = F.greatest("start", F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return cut.withColumn("from_word", low - F.col("start")).withColumn("n_words", high - low)


def used_pieces(docs: DataFrame) -> DataFrame:
    """``pieces`` of all rows plus ``uses``, how often the mix takes them."""
    sizes = sized(docs)
    sources = plan_sources(sizes)
    uses = deal(sources).groupBy("number", "block").agg(F.count("*").alias("uses"))
    return pieces(placed(sizes, sources)).join(uses.hint("merge"), ["number", "block"], "left").fillna(0, ["uses"])


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row; null and empty texts have size 0."""
    words = F.coalesce(F.sum(F.col("n_words") * F.col("uses")), F.lit(0)).alias("taken")
    by = ["doc_id", "size", "source_size", "target", "number", "start", "text_key"]
    # Rows without words share a place; they are counted apart so that repeated rows stay.
    cut = used_pieces(docs)
    full = cut.filter("size > 0").groupBy(*by).agg(words)
    none = cut.filter("size = 0").select(*by, F.lit(0).cast("long").alias("taken"))
    return full.unionByName(none).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of ``docs``.

    A row is a maximal run of a document's blocks that the mix takes for the k-th time (k = 1 to
    MAX_EPOCHS), so a document taken twice as a whole is there twice, and one taken in part has the text of
    those parts. A whole document's text is unchanged; n_chars follows the text. Documents without words are
    not in the mix.
    """
    again = used_pieces(docs).filter("uses > 0").withColumn("k", F.explode(F.expr("sequence(1, int(uses))")))
    key = ["doc_id", "source", "text_key"]
    order = Window.partitionBy(*key, "start", "k").orderBy("block")
    again = again.withColumn("run", F.col("block") - F.row_number().over(order))
    runs = again.groupBy(*key, "start", "k", "run").agg(F.min("from_word").alias("low"), F.sum("n_words").alias("n"))
    lists = runs.groupBy(*key).agg(F.collect_list(F.struct("low", "n")).alias("_runs"))
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("text_key").alias("_tk"), "_runs")
    same = F.col("row.doc_id").eqNullSafe(F.col("_id")) & F.col("row.source").eqNullSafe(F.col("_src"))
    same = same & (F.xxhash64("row.text") == F.col("_tk"))
    # Rows equal in these have their runs in one list.
    joined = packed(docs).join(lists.hint("merge"), same).dropDuplicates(["_id", "_src", "_tk"])
    parts = F.expr(r"regexp_extract_all(row.text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0)")
    out = joined.withColumn("_words", parts).withColumn("_run", F.explode("_runs"))
    whole = F.col("_run.n") == F.size("_words")
    cut = F.array_join(F.slice("_words", (F.col("_run.low") + 1).cast("int"), F.col("_run.n").cast("int")), "")
    text = F.when(whole, F.col("row.text")).otherwise(cut)
    row = F.col("row").withField("text", text).withField("n_chars", F.length(text).cast("long"))
    return out.select(row.alias("row")).select("row.*")


def _sql_permuted(table: str, x: str, n: str, key: str, out: str) -> str:
    """DuckDB SQL: ``table`` plus column ``out``, the same permutation as ``permuted``."""
    inner = f"SELECT *, CAST({x} AS BIGINT) AS x, CAST({n} AS BIGINT) AS n_, CAST({key} AS BIGINT) AS key_ FROM {table}"
    for r in range(1, ROUNDS + 1):
        k = f"((key_ * 48271 + {r} * 69621 + 12345) % {PRIME} * 16807 % {PRIME} % n_)"
        with_y = f"SELECT *, ({k} - x + n_) % n_ AS y FROM ({inner})"
        with_m = f"SELECT *, (greatest(x, y) % {PRIME} * 48271 + key_ + {r} * 40503) % {PRIME} AS m FROM ({with_y})"
        inner = f"SELECT * EXCLUDE (x, y, m), CASE WHEN (m * m + m) % {PRIME} // 256 % 2 = 1 THEN y ELSE x END AS x FROM ({with_m})"
    return f"SELECT * EXCLUDE (x, n_, key_), x AS {out} FROM ({inner})"


_CASES = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS number, source_size * {MAX_EPOCHS} AS most FROM per),
weighted AS (SELECT *, CASE (number - 1) % {len(WEIGHTS)} {_CASES} END AS weight FROM numbered),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER before, 0) AS BIGINT)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS level
  FROM weighted WINDOW before AS (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stopped AS (SELECT *, most < level * weight AS stops FROM levels),
targets AS (
  SELECT *, CASE WHEN stops THEN CAST(most AS DOUBLE)
    ELSE max(CASE WHEN NOT stops THEN level END) OVER () * weight END AS target,
    CAST(ceil(source_size / {BLOCK_WORDS}) AS BIGINT) AS blocks FROM stopped),
slotted AS (
  SELECT *, CASE WHEN source_size > 0
    THEN least(CAST(floor(target * blocks / source_size + 0.5) AS BIGINT), blocks * {MAX_EPOCHS}) ELSE 0 END AS slots
  FROM targets),
slots AS (SELECT number, blocks, unnest(range(slots)) AS j FROM slotted WHERE slots > 0),
dealt AS ({_sql_permuted("slots", "j % blocks", "blocks", f"(number * 9973 + j // blocks * 31337 + 7) % {PRIME}", "block")}),
uses AS (SELECT number, block, count(*) AS uses FROM dealt GROUP BY ALL),
placed AS (
  SELECT s.*, p.number, p.source_size, p.target, row_number() OVER () AS row_id,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY p.number
      ORDER BY ((s.doc_id % {PARTS}) + {PARTS}) % {PARTS}, s.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sizes s JOIN slotted p ON s.source IS NOT DISTINCT FROM p.source),
cut AS (
  SELECT *, unnest(range(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS} + 1)) AS block
  FROM placed WHERE size > 0),
got AS (
  SELECT row_id, CAST(sum(uses * (least(start + size, (block + 1) * {BLOCK_WORDS}) - greatest(start, block * {BLOCK_WORDS}))) AS BIGINT) AS taken
  FROM cut JOIN uses USING (number, block) GROUP BY row_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN got USING (row_id)
"""
