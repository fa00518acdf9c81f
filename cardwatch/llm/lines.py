"""Fuzzy line deduplication, in DataFrame operations only.

A line's signature is the minimum of its hashed character shingles under several xor masks of the hash, 16
bits of each. Signatures are cut into bands, each minimum being in two or three of them. Lines with an equal
band whose signatures are alike enough are held against the smallest line of that band by exact Jaccard
similarity of their shingle sets; the verified links are united. Where a band then still holds lines of
several components, all its pairs of different components that can reach the limit are verified. Of each
component only the first line (by doc_id, then place) stays.

Equal lines are one line from the start, so a line that many documents share is one row in all of this.
Holding a band's lines against a few of them first keeps large groups of like lines near linear.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.llm.common import components, packed, released, text_or_empty, written
from cardwatch.session import materialize

SHINGLE = 5
#: Minima of a signature, four of 16 bits to a word.
WORDS = 7
LANES = 4 * WORDS
#: 20 bands of 4 minima, two of which share one minimum at most, find a pair at 0.8 with 99.8 %.
BANDS = 20
SIMILARITY = 0.8
#: Bits of their sketches (8 of each minimum) in which lines may differ to be verified; one pair in 10,000 at 0.8 differs in more.
DIFFERING = 60
#: Words of an odd sketch, which lines of bands that stay mixed have as well.
ODD_WORDS = 8
_ODD = ["size", *[f"o{w}" for w in range(ODD_WORDS)]]
ANCHORS = 4
ROUNDS = 1
#: A band of up to so many lines is verified by all its pairs.
PAIRED = 32
#: A band of up to so many lines has the signatures of all its pairs compared, which costs less than to shuffle its shingles.
COMPARED = 4096
#: Lines of one key that meet all others of it in one task.
MEETING = 256
MAX_BROADCAST_ROWS = 1_000_000
_MASKS = [bits - (1 << 31) for bits in random.Random(9).sample(range(1 << 32), LANES)]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, place, line, line_key) of every line with a word; lines end at a line feed."""
    cut = docs.select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split(text_or_empty(), "\n")).alias("place", "line")
    )
    return cut.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("line_key", F.xxhash64("line"))


def _wide(line: str) -> Column:
    """Four bytes for each character, so that a shingle is cut out in constant time."""
    return F.encode(line, "UTF-32")


def shingle_hashes(line: str) -> Column:
    """Distinct hashed shingles of a line; a line shorter than a shingle is one shingle."""
    steps = f"sequence(0, greatest(length({line}) - {SHINGLE}, 0))"
    one = F.array(_wide(line))  # in a lambda of its own, or it would be encoded again for each shingle
    return F.transform(
        one,
        lambda wide: F.array_distinct(
            F.transform(F.expr(steps), lambda i: F.xxhash64(F.substring(wide, i * 4 + 1, F.lit(4 * SHINGLE))))
        ),
    )[0]


def _beside(df: DataFrame) -> DataFrame:
    """``df`` as the smaller side of a join: broadcast if it has at most MAX_BROADCAST_ROWS rows, else shuffled."""
    df = materialize(df)
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df.hint("merge")


def signatures(lines: DataFrame) -> DataFrame:
    """(line_key, s0, s1, ...) for each distinct line, s being four minima of 16 bits."""
    wide = lines.select("line_key", _wide("line").alias("wide"))
    last = F.greatest(F.expr(f"octet_length(wide) div 4 - {SHINGLE}"), F.lit(0).cast("long")).cast("int")
    cut = wide.select("line_key", "wide", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    hashed = cut.select("line_key", F.hash(F.substring("wide", F.col("i") * 4 + 1, F.lit(4 * SHINGLE))).alias("h"))
    mins = [F.min(F.col("h").bitwiseXOR(F.lit(mask))).alias(f"m{k}") for k, mask in enumerate(_MASKS)]
    low = [F.col(f"m{k}").bitwiseAND(F.lit(0xFFFF)).cast("long") for k in range(LANES)]
    words = [reduce(Column.bitwiseOR, [F.shiftleft(low[4 * w + k], 16 * k) for k in range(4)]) for w in range(WORDS)]
    return hashed.groupBy("line_key").agg(*mins).select("line_key", *[x.alias(f"s{w}") for w, x in enumerate(words)])


def _bands() -> list[Column]:
    """One number per band: the words themselves, then words mixed of four by steps of 1 and 2."""
    masks = [F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in (0xFFFF << 16 * k for k in range(4))]
    out = [F.col(f"s{w}") for w in range(WORDS)]
    for step in (1, 2):
        for w in range(WORDS):
            lanes = [F.col(f"s{(w + step * k) % WORDS}").bitwiseAND(mask) for k, mask in enumerate(masks)]
            out.append(reduce(Column.bitwiseOR, lanes))
    return [F.xxhash64(F.lit(n), value) for n, value in enumerate(out[:BANDS])]


def banded(signed: DataFrame) -> DataFrame:
    """(band, line_key, a): the lines of each band value that two or more share, and the smallest of them."""
    partitions = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt once by band, for the minimum and for the join with it.
    dealt = signed.select("line_key", F.explode(F.array(*_bands())).alias("band")).repartition(partitions, "band")
    ends = dealt.groupBy("band").agg(F.min("line_key").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return dealt.join(ends.hint("merge"), "band").select("band", "line_key", "a")


def sketched(signed: DataFrame) -> DataFrame:
    """(line_key, t0, t1, ...): the lower 8 bits of each minimum of a signature."""
    low = [F.col(f"s{w}").bitwiseAND(F.lit(0x00FF_00FF_00FF_00FF)) for w in range(WORDS)]
    pairs = [low[w].bitwiseOR(F.shiftleft(low[w + 1], 8)) if w + 1 < WORDS else low[w] for w in range(0, WORDS, 2)]
    return signed.select("line_key", *[t.alias(f"t{k}") for k, t in enumerate(pairs)])


def odd_sketches(texts: DataFrame) -> DataFrame:
    """(line_key, size, o0, o1, ...): distinct shingles of a line, and of each bit whether an odd number of them fall on it."""
    bit = F.pmod("token", F.lit(64 * ODD_WORDS)).cast("int")
    tokens = texts.select("line_key", F.explode(shingle_hashes("line")).alias("token")).withColumn("bit", bit)
    words = [F.expr(f"bit_xor(if(bit div 64 = {w}, shiftleft(1L, bit & 63), 0L))").alias(f"o{w}") for w in range(ODD_WORDS)]
    return tokens.groupBy("line_key").agg(F.count("*").alias("size"), *words)


def _near(odd: bool = False) -> Column:
    """Whether the sketches of a and of b differ in few bits. An unequal minimum differs in 4 on average.

    Odd sketches cannot differ in more bits than the lines do in shingles, so they pass over no pair that is similar enough.
    """
    def differing(names: list[str]) -> Column:
        return reduce(Column.__add__, [F.bit_count(F.col(f"a{n}").bitwiseXOR(F.col(f"b{n}"))) for n in names])

    near = differing([str(k) for k in range(-(-WORDS // 2))]) <= DIFFERING
    if not odd:
        return near
    percent, sizes = round(SIMILARITY * 100), F.col("a_size") + F.col("b_size")
    return near & (differing([f"_o{w}" for w in range(ODD_WORDS)]) * (100 + percent) <= sizes * (100 - percent))


def _named(rows: DataFrame, name: str, *others: str | Column) -> DataFrame:
    """Rows of (line_key, t0, t1, ...) as (``name``, ``name``0, ``name``1, ...), beside ``others``; size and o0, o1, ... likewise."""
    words = [F.col(f"t{k}").alias(f"{name}{k}") for k in range(-(-WORDS // 2)) if f"t{k}" in rows.columns]
    words += [F.col(n).alias(f"{name}_{n}") for n in _ODD if n in rows.columns]
    return rows.select(*others, F.col("line_key").alias(name), *words)


def alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches differ in few bits."""
    a, b = (_named(sketches, name).hint("merge") for name in "ab")
    return pairs.join(a, "a").join(b, "b").filter(_near("size" in sketches.columns)).select("a", "b")


def _met(lines: DataFrame, heads: DataFrame, sketches: DataFrame | None, distinct: str) -> DataFrame:
    """Distinct pairs (a, b), a < b, of a line and a head (band, line_key, group) of one band that ``distinct`` lets pass.

    With sketches only pairs that are alike in them. Both lines bring theirs, so pairs that are not are never shuffled.
    """
    if sketches is not None:
        lines, heads = (rows.join(sketches.hint("merge"), "line_key") for rows in (lines, heads))
    line, head = (_named(rows, name, "band", F.col("group").alias(f"group_{name}")) for rows, name in ((lines, "a"), (heads, "b")))
    met = line.join(head.hint("merge"), "band").filter(distinct)
    met = met if sketches is None else met.filter(_near("size" in sketches.columns))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def first_pairs(shared: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of each line and the smallest of its band."""
    rows = shared.select("band", "line_key", F.col("line_key").alias("group"), "a")
    return _met(rows.drop("a"), rows.filter("line_key = a").drop("a"), sketches, "b < a")


def mixed_bands(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(band, line_key, group, n) of the bands of n > 2 lines that are not in one component (node, component) yet.

    Both lines of a band of two have met as its smallest and the other.
    """
    sizes = shared.groupBy("band").agg(F.count("*").alias("n")).filter("n > 2")
    rows = shared.select("band", "line_key").join(sizes.hint("merge"), "band")
    known = found.select(F.col("node").alias("line_key"), F.col("component").alias("group"))
    labelled = rows.join(known.hint("merge"), "line_key", "left").withColumn("group", F.coalesce("group", "line_key"))
    ends = labelled.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    return labelled.join(ends.filter("low <> high").hint("merge"), "band", "left_semi")


def pairs_between(shared: DataFrame, found: DataFrame, salt: int, sketches: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of a band's lines that are not in one component (node, component) yet.

    Each line meets ANCHORS lines of its band, drawn anew for each band and salt; bands of up to
    ANCHORS + 1 lines so give all pairs that are left.
    """
    return drawn_pairs(mixed_bands(shared, found), salt, sketches)


def drawn_pairs(mixed: DataFrame, salt: int, sketches: DataFrame | None = None) -> DataFrame:
    """``pairs_between`` of ``mixed_bands``."""
    drawn = Window.partitionBy("band").orderBy(F.xxhash64("band", "line_key", F.lit(salt)), "line_key")
    heads = mixed.withColumn("rank", F.row_number().over(drawn)).filter(F.col("rank") <= ANCHORS)
    return _met(mixed.drop("n"), heads.drop("n", "rank"), sketches, "group_a <> group_b")


def _texts(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(line_key, line) of the lines of the pairs (a, b), one row a line."""
    asked = pairs.select("a").union(pairs.select("b")).toDF("line_key").distinct()
    return lines.select("line_key", "line").join(_beside(asked), "line_key", "left_semi").dropDuplicates(["line_key"])


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose shingle sets have at least this Jaccard similarity; ``texts`` is (line_key, line), one row a line."""
    a, b = (texts.select(F.col("line_key").alias(n), F.col("line").alias(f"line_{n}")).hint("merge") for n in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", shingle_hashes("line_a").alias("sa"), shingle_hashes("line_b").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    # In whole numbers, so that a similarity of exactly the limit is in.
    percent = round(similarity * 100)
    return both.withColumn("n", shared).filter(f"n * 100 >= {percent} * (size(sa) + size(sb) - n)").select("a", "b")


def _salted_pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """Distinct pairs (a, b), a < b, of rows (*by, line_key, group) equal in ``by`` and not in ``group``.

    A key with many rows is dealt over one salt for each MEETING of them.
    """
    counts = rows.groupBy(*by).agg(F.expr(f"count(*) div {MEETING}").alias("top"), F.min("group").alias("low"), F.max("group").alias("high"))
    dealt = rows.join(counts.filter("low <> high").drop("low", "high").hint("merge"), by)
    left = dealt.select(*by, F.col("line_key").alias("a"), F.col("group").alias("group_a"), F.expr("pmod(xxhash64(line_key), top + 1)").alias("salt"))
    right = dealt.select(*by, F.col("line_key").alias("b"), F.col("group").alias("group_b"), F.explode(F.expr("sequence(0L, top)")).alias("salt"))
    met = left.join(right.hint("merge"), [*by, "salt"]).filter("a < b AND group_a <> group_b")
    return met.select("a", "b").distinct()


def compared_pairs(mixed: DataFrame, sketches: DataFrame) -> DataFrame:
    """Distinct alike pairs (a, b), a < b: all of a band's lines (band, line_key, group) of different components."""
    return _met(mixed, mixed, sketches, "a < b AND group_a <> group_b")


def rest_pairs(
    shared: DataFrame, found: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, hashes: Column | None = None
) -> DataFrame:
    """Distinct pairs (a, b), a < b: all of a band's lines that are in different components and can be similar enough.

    Bands of up to PAIRED lines give all pairs. In larger ones a line's shingles are sorted by how many lines
    of the band have them; of n shingles, the first n - ceil(similarity n) + 1 are kept. Two lines without a
    common shingle among these are below the limit for sure, so no pair is lost. ``hashes`` is the set of distinct
    shingles of a row of ``texts``, by default that of its line.
    """
    known = found.select(F.col("node").alias("line_key"), F.col("component").alias("group"))
    labelled = shared.select("band", "line_key").join(known.hint("merge"), "line_key", "left")
    labelled = labelled.withColumn("group", F.coalesce("group", "line_key"))
    sizes = labelled.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("n"))
    mixed = materialize(labelled.join(sizes.filter("low <> high").select("band", "n").hint("merge"), "band"))
    few = _salted_pairs(mixed.filter(f"n <= {PAIRED}"), ["band"])

    many = mixed.filter(f"n > {PAIRED}").drop("n")
    sets = shingle_hashes("line") if hashes is None else hashes
    cut = many.select("line_key").distinct().join(texts.hint("merge"), "line_key").select("line_key", sets.alias("set"))
    tokens = many.join(cut.hint("merge"), "line_key").select("band", "line_key", "group", F.explode("set").alias("token"))
    held = tokens.groupBy("band", "token").agg(F.count("*").alias("n"))
    ordered = tokens.join(held.hint("merge"), ["band", "token"]).groupBy("band", "line_key", "group")
    ordered = ordered.agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("set"))
    percent = round(similarity * 100)
    length = F.expr(f"size(set) - int(({percent} * size(set) + 99) div 100) + 1")
    first = ordered.select("band", "line_key", "group", F.explode(F.slice("set", F.lit(1), length)).alias("held"))
    first = first.filter("held.n > 1").select("band", F.col("held.token").alias("token"), "line_key", "group")
    return few.unionByName(_salted_pairs(materialize(first), ["band", "token"])).distinct()


def united(shared: DataFrame, lines: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """(node, component) of all lines with a verified link; ``lines`` is (line_key, line), ``sketches`` is ``sketched`` of them.

    First every line is held against the smallest of its band, then up to ROUNDS times against ANCHORS drawn
    ones, which settles groups of like lines at a linear cost and decides nothing else. Then all pairs of a
    band that are still in different components are verified, so the result does not depend on the draws.
    With ``sketches`` pairs that differ in more than DIFFERING bits of them are passed over, and of the last ones those whose
    odd sketches tell that they cannot be similar enough.
    """
    tried = written(first_pairs(shared, sketches), "tried")
    released(tried.sparkSession)
    found = components(verified(tried, _texts(lines, tried)))
    for salt in range(1, ROUNDS + 2):
        # Bands that are in one component stay so; what is left has fewer rows each time.
        mixed = mixed_bands(shared, found)
        # Of a band of up to ANCHORS + 1 lines every pair was drawn before.
        mixed = written(mixed.filter(f"n > {ANCHORS + 1}") if salt > ROUNDS > 0 else mixed, "mixed")
        shared = mixed.select("band", "line_key")
        released(mixed.sparkSession)
        if salt > ROUNDS and sketches is not None:
            # All pairs of a band grow with its square, nearly all of them not similar enough: these end in the join.
            asked = mixed.select(F.col("line_key").alias("a"), F.col("line_key").alias("b"))
            sketches = written(sketches.join(odd_sketches(_texts(lines, asked)).hint("merge"), "line_key"), "sketches")
            released(sketches.sparkSession)
        if salt <= ROUNDS:
            pairs = drawn_pairs(mixed, salt, sketches)
        elif sketches is None:
            pairs = rest_pairs(shared, found, lines)
        else:
            pairs = compared_pairs(mixed.filter(f"n <= {COMPARED}").drop("n"), sketches)
            wide = mixed.filter(f"n > {COMPARED}").select("band", "line_key")
            if not wide.isEmpty():
                texts = _texts(lines, wide.select(F.col("line_key").alias("a"), F.col("line_key").alias("b")))
                pairs = pairs.unionByName(alike(rest_pairs(wide, found, texts), sketches)).distinct()
        pairs = written(pairs.join(tried.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        before = found.select(F.col("component").alias("a"), F.col("node").alias("b"))
        found = components(verified(pairs, _texts(lines, pairs)).unionByName(before))
        tried = tried.unionByName(pairs)
        released(tried.sparkSession)
    return found


def removed_places(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, removed array<int>): places of the lines that repeat an earlier one, exactly or nearly."""
    lines = _lines(docs)
    signed = written(signatures(lines), "signatures")
    released(signed.sparkSession)
    shared = written(banded(signed), "shared")
    released(shared.sparkSession)
    found = united(shared, lines, sketched(signed))
    known = found.select(F.col("node").alias("line_key"), F.col("component").alias("group"))
    placed = lines.select("doc_id", "text_key", "place", "line_key").join(known.hint("merge"), "line_key", "left")
    placed = placed.withColumn("group", F.coalesce("group", "line_key")).select("doc_id", "text_key", "place", "group")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "place")).alias("first")
    heads = placed.groupBy("group").agg(first, F.count("*").alias("n")).filter("n > 1").select("group", "first")
    later = placed.join(heads.hint("merge"), "group").filter(
        ~(
            F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
            & F.col("text_key").eqNullSafe(F.col("first.text_key"))
            & (F.col("place") == F.col("first.place"))
        )
    )
    return later.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("place")).alias("removed"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """(row, removed, kept_text) of every row: its columns, places of lines to go, the text without them.

    Rows equal in id and text are one document. A null text gives a null kept_text; lines without a word
    always stay.
    """
    gone = removed_places(docs).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "removed")
    same = F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_key"))
    joined = packed(docs).join(_beside(gone), same, "left")
    kept = F.filter(F.split("row.text", "\n"), lambda _, i: ~F.array_contains("removed", i))
    kept = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select("row", "removed", kept.alias("kept_text"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed, kept_sha256) of every row; null texts count as empty."""
    n_lines = F.size(F.split(text_or_empty("row.text"), "\n")).cast("long")
    places = F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit(""))
    n_removed = F.when(F.col("removed").isNull(), F.lit(0)).otherwise(F.size("removed")).cast("long")
    digest = F.sha2(text_or_empty("kept_text").cast("binary"), 256)
    return deduplicated(docs.select("doc_id", "text")).select(
        "row.doc_id", n_lines.alias("n_lines"), n_removed.alias("n_removed"), places.alias("removed"), digest.alias("kept_sha256")
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines, n_chars following; documents left without a word are dropped."""
    out = deduplicated(docs).filter(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    row = F.col("row").withField("text", F.col("kept_text")).withField("n_chars", F.length("kept_text").cast("long"))
    return out.select(row.alias("row")).select("row.*")
