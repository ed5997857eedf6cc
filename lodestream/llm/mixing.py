"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every source gets a target of words; a document's expected number of copies is its source's target
over its source's size. Within a source the documents stand in order of size; the prefix sums of the
expected copies plus one random offset decide: a document is emitted once per whole number that its
own stretch crosses. With sizes in order, the words taken miss the target by about one document.

No source is ever sorted in one task: a source falls into size classes (1/32 octave) and, as the
table grows, into sub-groups of each class. Counts of these groups are summed first; each group then
starts from its own prefix (rows in the source's classes before, and in the class's sub-groups before), so
only one small group is sorted at a time. The expected copies are
whole multiples of 2**-40, so prefix sums are exact and reruns agree.

Defined results: a null text or one without words has size 0 and takes 0 words; a null source is a
source of its own, last in order; repeated rows are separate documents; rows that tie in size and
doc_id are interchangeable; an empty table gives an empty table; all input columns are kept, and
working columns carry a prefix so that clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import textvec as tv

ONE = 1 << 40
ROWS_PER_GROUP = 200_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words, stored: for mixes that need no texts, so that words are counted once."""
    return stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("_m_size")))


def _grouped(docs: DataFrame, subs: int) -> DataFrame:
    if "_m_size" not in docs.columns:
        docs = docs.withColumn("_m_size", word_count(F.col("text")))
    bits = F.length(F.bin(F.col("_m_size")))
    # by a hash, since ids may stand at regular distances; rows without an id by their size
    own = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("_m_size").cast("string")).cast("binary"))
    return (
        docs.withColumn("_m_src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~null")))
        .withColumn("_m_class", bits * 64 + F.expr("_m_size >> greatest(length(bin(_m_size)) - 6, 0)"))
        .withColumn("_m_sub", F.conv(F.substring(own, 1, 8), 16, 10).cast("long") % F.lit(subs))
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(_m_src, source_size) -> also weight and target; one row for each source, so one window over them.

    Targets fill up like water: sources in order of size over weight reach their cap first, and what
    they cannot take is shared among the rest by weight.
    """
    # "~" sorts after "s", so the null source stands last
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy("_m_src"))).withColumn("weight", w.cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "_m_src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = (
        ranked.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_left", F.col("_total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_share", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_free", F.col("_left") * F.col("weight") <= cap * F.col("source_size") * F.col("_share"))
        .withColumn("_open", F.max(F.col("_free").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1)
    )
    first_left = F.max(F.when(F.col("_open"), F.col("_left"))).over(everything)
    first_share = F.max(F.when(F.col("_open"), F.col("_share"))).over(everything)
    return level.withColumn("_l", first_left).withColumn("_s", first_share).select(
        "_m_src",
        "source_size",
        "weight",
        F.when(F.col("source_size") == 0, 0.0)
        .when(F.col("_open"), (F.col("weight") * F.col("_l")).cast("double") / F.col("_s").cast("double"))
        .otherwise((cap * F.col("source_size")).cast("double"))
        .alias("target"),
    )


def _mixed(docs: DataFrame, weights: tuple[int, ...], cap: int, seed: str, rows_per_group: int) -> DataFrame:
    """The columns of docs and _m_size, _m_source_size, _m_target, _m_copies."""
    subs = 1 + docs.count() // rows_per_group
    keys = ["_m_src", "_m_class", "_m_sub"]
    slim = docs.select(*(c for c in docs.columns if c in ("doc_id", "source", "text", "_m_size")))
    groups = stored(_grouped(slim, subs).groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("_m_size").alias("_words")))
    classes = groups.groupBy("_m_src", "_m_class").agg(F.sum("_n").alias("_n"), F.sum("_words").alias("_words"))
    goal = targets(classes.groupBy("_m_src").agg(F.sum("_words").alias("source_size")), weights, cap)
    rate = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.lit(float(ONE)))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col("_m_src"))), 1, 10), 16, 10).cast("long")
    goal = goal.withColumn("_m_rate", rate).withColumn("_m_offset", offset)
    # rows before a source's class, of a few hundred classes; then before a sub-group in its class
    upto = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = classes.select("_m_src", "_m_class", upto(Window.partitionBy("_m_src").orderBy("_m_class")).alias("_first"))
    within = groups.select(*keys, upto(Window.partitionBy("_m_src", "_m_class").orderBy("_m_sub")).alias("_within"))
    start = F.pmod((F.col("_first") + F.col("_within")).cast("decimal(20,0)") * F.col("_m_rate") + F.col("_m_offset"), F.lit(ONE)).cast("long")
    starts = within.join(first, ["_m_src", "_m_class"]).join(goal, "_m_src").select(*keys, "_m_rate", start.alias("_m_start"), F.col("source_size").alias("_m_source_size"), F.col("target").alias("_m_target"))
    own = Window.partitionBy(*keys).orderBy("_m_size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = _grouped(docs, subs).join(starts, keys)
    return joined.withColumn("_m_upto", F.sum("_m_rate").over(own) + F.col("_m_start")).withColumn("_m_copies", F.expr(f"(_m_upto div {ONE}) - ((_m_upto - _m_rate) div {ONE})"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix-1", rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """All columns of docs, and size, source_size, target, copies, taken (longs, target a double), which replace columns of their names."""
    added = ["size", "source_size", "target", "copies"]
    keep = [F.col(c) for c in docs.columns if c not in (*added, "taken", "_m_size")]
    return _mixed(docs, weights, cap, seed, rows_per_group).select(*keep, *(F.col(f"_m_{c}").alias(c) for c in added), (F.col("_m_copies") * F.col("_m_size")).alias("taken"))


def emit(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix-1", rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs as they are."""
    safe, back = tv.guarded(docs, ("doc_id", "source", "text"))
    return _mixed(safe, weights, cap, seed, rows_per_group).withColumn("_m_copy", F.explode(F.expr("array_repeat(0, cast(_m_copies as int))"))).select(*back)


SQL = f"""
WITH n AS (SELECT 1 + count(*) // {ROWS_PER_GROUP} AS subs FROM documents),
d AS (
  SELECT doc_id, coalesce('s' || source, '~null') AS src, subs,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents, n),
c AS (SELECT *, length(bin(size)) * 64 + (size >> greatest(length(bin(size)) - 6, 0)) AS cls, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, size::VARCHAR)), 1, 8))::BIGINT % subs AS sub FROM d),
s AS (SELECT src, sum(size)::HUGEINT AS source_size, row_number() OVER (ORDER BY src) AS rk FROM c GROUP BY src),
w AS (SELECT *, [5, 2, 1][1 + (rk - 1) % 3]::HUGEINT AS weight FROM s),
l AS (SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0) AS lft, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS shr
  FROM w WINDOW o AS (ORDER BY source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, max((lft * weight <= 3 * source_size * shr)::INT) OVER (ORDER BY source_size / weight, src ROWS UNBOUNDED PRECEDING) = 1 AS open FROM l),
t AS (SELECT src, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN open
    THEN (weight * max(lft) FILTER (open) OVER ())::DOUBLE / (max(shr) FILTER (open) OVER ())::DOUBLE ELSE (3 * source_size)::DOUBLE END AS target FROM f),
g AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END * {ONE}.0::DOUBLE)::HUGEINT AS rate,
    ('0x' || substr(md5('mix-1:' || src), 1, 10))::BIGINT AS off FROM t),
p AS (SELECT c.doc_id, c.size, g.source_size, g.target, g.rate,
    (row_number() OVER (PARTITION BY c.src ORDER BY c.cls, c.sub, c.size, c.doc_id))::HUGEINT * g.rate + g.off AS upto
  FROM c JOIN g USING (src))
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (upto // {ONE} - (upto - rate) // {ONE})::BIGINT * size AS taken FROM p
"""
