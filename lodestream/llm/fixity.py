"""WARC records and a Merkle fixity audit of replicas (DataFrame functions only).

Every page becomes a WARC record; records are laid out in shards in order of page_id, and a record's
leaf is the hash of its bytes. A node covers a range of keys, not of positions: level 1 holds one node
for each page_id, with the sum of its records' hashes, and each level above joins ``FANOUT`` adjacent
ranges of the one below and hashes their lengths and hashes, as far as one node covers a shard's keys.
So a record that is lacking, added or longer changes the nodes above it and no others. Two replicas
are compared from the roots down: only below nodes that differ are children looked at, so an intact
shard costs one comparison, and damage is found in as many steps as the tree is high.

Only hashes and lengths are shuffled, never records. Shards hold about ``ROWS_PER_SHARD`` records, so
the prefix sums of lengths run over bounded groups.

Defined results: a null url or html is an empty one; records with the same page_id stand in order of
their hash; a null page_id belongs to shard 0, first in order; a record that one replica lacks is
reported with a null hash on that side; of records with the same page_id those with equal hashes are
paired first, the others in order of hash; place and offsets are those in the first replica, or in the
second if only that has the record; an empty table has no roots and no damage; other columns of
the pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

BITS, ROWS_PER_SHARD = 4, 20_000
FANOUT = 1 << BITS


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC/1.0 resource record, as text."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, shards: int) -> DataFrame:
    """shard, at (the key within the shard), idx, page_id, start, end, hash: one row for each record, in its place in the shard's file."""
    bare = pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("r"))
    bare = bare.select("page_id", F.sha2(F.col("r").cast("binary"), 256).alias("hash"), F.octet_length("r").cast("long").alias("size"), F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(shards)).cast("int").alias("shard"))
    order = Window.partitionBy("shard").orderBy("page_id", "hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("size").over(order)
    at = F.expr(f"(coalesce(page_id, 0) - shard) div {shards}").alias("at")
    return bare.select("shard", at, (F.count("*").over(order) - 1).alias("idx"), "page_id", (end - F.col("size")).alias("start"), end.alias("end"), "hash")


def shard_count(pages: DataFrame) -> int:
    return 1 + pages.count() // ROWS_PER_SHARD


def tree(pages: DataFrame, shards: int) -> DataFrame:
    """All nodes: level (0: records, 1: pages, then ranges), shard, at, idx, page_id, start, end, size, hash. Stored, as a replica's manifest."""
    records = stored(leaves(pages, shards))
    no = lambda c: F.lit(None).cast("long").alias(c)
    node = lambda k, d: d.select(F.lit(k).alias("level"), "shard", "at", "idx", "page_id", "start", "end", "size", "hash")
    # a page_id may stand any number of times: hashes are added up in four parts of 60 bits, so the state stays small
    parts = [F.sum(F.conv(F.substring("hash", 1 + 16 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    one = records.groupBy("shard", "at", "page_id").agg(F.sum(F.col("end") - F.col("start")).alias("size"), F.concat_ws("+", F.count("*").cast("string"), *parts).alias("p"))
    level = stored(one.select("shard", "at", no("idx"), "page_id", no("start"), no("end"), "size", F.sha2(F.col("p").cast("binary"), 256).alias("hash")))
    nodes = node(0, records.withColumn("size", F.col("end") - F.col("start"))).unionByName(node(1, level))
    lo, hi = records.agg(F.min("at"), F.max("at")).first()
    k = 1
    # keys on both sides of 0 end in two ranges
    while lo is not None and lo != hi and (lo, hi) != (-1, 0):
        k, lo, hi = k + 1, lo >> BITS, hi >> BITS
        # at most FANOUT children in each group, and one for null page_ids
        up = level.groupBy("shard", F.shiftright("at", BITS).alias("at")).agg(F.sum("size").alias("size"), F.array_sort(F.collect_list(F.struct("at", "page_id", "size", "hash"))).alias("c"))
        text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["at"].cast("string"), F.coalesce(x["page_id"].cast("string"), F.lit("")), x["size"].cast("string"), x["hash"])), "|")
        level = stored(up.select("shard", "at", no("idx"), no("page_id"), no("start"), no("end"), "size", F.sha2(text.cast("binary"), 256).alias("hash")))
        nodes = nodes.unionByName(node(k, level))
    return stored(nodes)


NODE = ["shard", "at", "_null"]


def _level(nodes: DataFrame, k: int, differ: DataFrame | None) -> DataFrame:
    """Nodes of a level, below those that differ. _null tells null page_ids from page_id 0."""
    n = nodes.where(F.col("level") == k).withColumn("_null", F.col("page_id").isNull())
    if differ is None:
        return n
    if k == 0:
        return n.join(differ, NODE, "left_semi")
    above = differ.select("shard", F.col("at").alias("_up"))
    return n.withColumn("_up", F.shiftright("at", BITS)).join(above, ["shard", "_up"], "left_semi").drop("_up")


def _unpaired(x: DataFrame, y: DataFrame) -> DataFrame:
    """x without the records that y has with equal hashes, as often as y has them; the others numbered in each page."""
    rest = x.join(y.select(*NODE, "hash", "_n"), [*NODE, "hash", "_n"], "left_anti")
    return rest.withColumn("_r", F.row_number().over(Window.partitionBy(*NODE).orderBy("hash", "_n")))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """The records that differ between two trees: page_id, shard, idx, start_offset, end_offset, hash_a, hash_b."""
    tops = [t.agg(F.max("level")).first()[0] for t in (a, b)]
    differ = None
    for k in range(min((t for t in tops if t is not None), default=1), 0, -1):
        x, y = (_level(t, k, differ).select(*NODE, F.col("hash").alias(f"hash_{side}")) for t, side in ((a, "a"), (b, "b")))
        differ = x.join(y, NODE, "full_outer").where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select(*NODE)
        if k % 4 == 1:
            differ = stored(differ)
    nth = F.row_number().over(Window.partitionBy(*NODE, "hash").orderBy("idx"))
    x, y = (stored(_level(t, 0, differ).withColumn("_n", nth).drop("level", "size")) for t in (a, b))
    sides = [d.select(*NODE, "_r", *(F.col(c).alias(f"{c}_{side}") for c in ("idx", "page_id", "start", "end", "hash"))) for d, side in ((_unpaired(x, y), "a"), (_unpaired(y, x), "b"))]
    one = lambda c: F.coalesce(f"{c}_a", f"{c}_b")
    return sides[0].join(sides[1], [*NODE, "_r"], "full_outer").select(one("page_id").alias("page_id"), "shard", one("idx").alias("idx"), one("start").alias("start_offset"), one("end").alias("end_offset"), "hash_a", "hash_b")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica in which one byte of every 97th page's body is wrong, for drills and tests."""
    bad = (F.col("page_id") % 97 == 13) & (F.length("html") > 0)
    return pages.withColumn("html", F.when(bad, F.concat(F.when(F.substring("html", 1, 1) == "#", "%").otherwise("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))


def drill(pages: DataFrame) -> DataFrame:
    """Audit the pages against a replica that is damaged in known places."""
    pages = pages.select("page_id", "url", "html")
    shards = shard_count(pages)
    return audit(tree(pages, shards), tree(damaged(pages), shards))



def moved(pages: DataFrame) -> DataFrame:
    """A damaged replica that also lacks every 101st page and holds every 103rd with a longer body."""
    longer = F.col("page_id") % 103 == 11
    bad = damaged(pages).withColumnRenamed("html", "_bad")
    return bad.withColumn("html", F.when(longer, F.lit("longer")).otherwise(F.lit(""))).select("page_id", "url", F.concat("_bad", "html").alias("html")).where("coalesce(page_id % 101 <> 7, true)")


def drill_moved(pages: DataFrame) -> DataFrame:
    """Audit a replica that lacks every 109th page against one with removed, longer and damaged records."""
    pages = pages.select("page_id", "url", "html")
    shards = shard_count(pages)
    return audit(tree(pages.where("coalesce(page_id % 109 <> 3, true)"), shards), tree(moved(pages), shards))


SQL = f"""
WITH n AS (SELECT 1 + count(*) // {ROWS_PER_SHARD} AS shards FROM pages),
p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
    CASE WHEN page_id % 97 = 13 AND length(html) > 0 THEN (CASE WHEN html[1] = '#' THEN '%' ELSE '#' END) || html[2:] ELSE coalesce(html, '') END AS bad FROM pages),
h AS (SELECT page_id, coalesce(page_id, 0) % shards AS shard, html, bad, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '')
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head FROM p, n),
r AS (SELECT page_id, shard, head || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS a,
    head || strlen(bad) || chr(13) || chr(10) || chr(13) || chr(10) || bad || chr(13) || chr(10) || chr(13) || chr(10) AS b FROM h),
s AS (SELECT page_id, shard, sha256(a) AS hash_a, sha256(b) AS hash_b, strlen(a) AS size FROM r),
o AS (SELECT *, row_number() OVER w - 1 AS idx, (sum(size) OVER w)::BIGINT AS end_offset FROM s WINDOW w AS (PARTITION BY shard ORDER BY page_id ROWS UNBOUNDED PRECEDING))
SELECT page_id, shard::INT AS shard, idx::BIGINT AS idx, end_offset - size AS start_offset, end_offset, hash_a, hash_b FROM o WHERE hash_a <> hash_b
"""

_CRLF = "chr(13) || chr(10)"
SQL_MOVED = f"""
WITH n AS (SELECT 1 + count(*) // {ROWS_PER_SHARD} AS shards FROM pages),
d AS (SELECT page_id, url, CASE WHEN page_id % 97 = 13 AND length(html) > 0 THEN (CASE WHEN html[1] = '#' THEN '%' ELSE '#' END) || html[2:] ELSE html END AS bad FROM pages),
v AS (SELECT 'a' AS side, page_id, url, html FROM pages WHERE coalesce(page_id % 109 <> 3, true)
    UNION ALL SELECT 'b', page_id, url, bad || (CASE WHEN page_id % 103 = 11 THEN 'longer' ELSE '' END) FROM d WHERE coalesce(page_id % 101 <> 7, true)),
c AS (SELECT side, page_id, coalesce(page_id, 0) % shards AS shard, coalesce(url, '') AS url, coalesce(html, '') AS html FROM v, n),
r AS (SELECT side, page_id, shard, 'WARC/1.0' || {_CRLF} || 'WARC-Type: resource' || {_CRLF} || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || {_CRLF} || 'WARC-Target-URI: ' || url
    || {_CRLF} || 'Content-Type: text/html' || {_CRLF} || 'Content-Length: ' || strlen(html) || {_CRLF} || {_CRLF} || html || {_CRLF} || {_CRLF} AS r FROM c),
o AS (SELECT side, page_id, shard, sha256(r) AS hash, strlen(r) AS size, row_number() OVER w - 1 AS idx, (sum(strlen(r)) OVER w)::BIGINT AS end_offset FROM r WINDOW w AS (PARTITION BY side, shard ORDER BY page_id ROWS UNBOUNDED PRECEDING)),
a AS (SELECT * FROM o WHERE side = 'a'), b AS (SELECT * FROM o WHERE side = 'b')
SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.shard, b.shard)::INT AS shard, coalesce(a.idx, b.idx)::BIGINT AS idx, coalesce(a.end_offset - a.size, b.end_offset - b.size) AS start_offset,
    coalesce(a.end_offset, b.end_offset) AS end_offset, a.hash AS hash_a, b.hash AS hash_b FROM a FULL JOIN b ON a.page_id = b.page_id WHERE a.hash IS DISTINCT FROM b.hash
"""
