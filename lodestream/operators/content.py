"""Content: chunks, fingerprints, duplicates, orphan references, placement and integrity joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import chunk_split
from .rows import range_of


def chunks(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, chunk_no, chunk, len, hash."""
    parts = docs.where(F.length(text) > 0).select(key, F.posexplode(chunk_split(F.col(text), size)).alias("chunk_no", "chunk"))
    return parts.select(key, "chunk_no", "chunk", F.length("chunk").alias("len"), F.sha2(F.col("chunk").cast("binary"), 256).alias("hash"))


def read_range(c: DataFrame, key: str, number: str, data: str, size: str, at: int, count: int) -> DataFrame:
    """``count`` characters (or bytes) from ``at`` on of each object, from its chunks in order; null if the object ends before.

    Only chunks that meet the range are put together, so a row holds at most the range and two chunks.
    """
    w = Window.partitionBy(key).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    placed = c.select(key, number, data, size).withColumn("_at", F.coalesce(F.sum(size).over(w), F.lit(0)))
    met = placed.where((F.col("_at") < at + count) & (F.col("_at") + F.col(size) > at))
    begin = F.greatest(F.lit(at) - F.col("_at"), F.lit(0))
    piece = F.substring(data, (begin + 1).cast("int"), (F.least(F.col(size), at + count - F.col("_at")) - begin).cast("int"))
    parts = met.select(key, F.struct(F.col(number), piece.alias("piece")).alias("_p")).groupBy(key).agg(F.array_sort(F.collect_list("_p")).alias("_ps"))
    return parts.select(key, F.array_join(F.transform("_ps", lambda p: p["piece"]), "").alias("data"))


def dedup_stats(c: DataFrame) -> DataFrame:
    """Chunks, distinct ones, characters stored and saved: the hashes are summed first, then the hashes' sums."""
    h = c.groupBy("hash").agg(F.count("*").alias("n"), F.max("len").alias("len"))
    return h.agg(F.sum("n").alias("chunks"), F.count("*").alias("unique_chunks"), F.sum("len").alias("stored"), F.sum((F.col("n") - 1) * F.col("len")).alias("saved"))


def orphans(refs: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return refs.join(parents.select(key), key, "left_anti")


def orphan_share(chunks_: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """Chunks without a reference, and their share in whole percent."""
    n = refs.groupBy(key).agg(F.count("*").alias("_n"))
    j = chunks_.select(key).distinct().join(n, key, "left")
    none = F.sum(F.col("_n").isNull().cast("long"))
    return j.agg(F.count("*").alias("total"), none.alias("orphans"), F.floor(100 * none / F.count("*")).cast("long").alias("pct"))


def ref_histogram(chunks_: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    n = refs.groupBy(key).agg(F.count("*").alias("_n"))
    j = chunks_.select(key).distinct().join(n, key, "left").select(F.coalesce("_n", F.lit(0)).alias("refs"))
    return j.groupBy("refs").agg(F.count("*").alias("cnt"))


def counter_diff(rows: DataFrame, stored: DataFrame, bucket: str) -> DataFrame:
    """Buckets whose recount differs from the stored count."""
    now = rows.groupBy(bucket).agg(F.count("*").alias("counted"))
    both = now.join(stored.select(bucket, "stored"), bucket, "full_outer").select(bucket, F.coalesce("counted", F.lit(0)).alias("counted"), F.coalesce("stored", F.lit(0)).alias("stored"))
    return both.where("counted <> stored")


def lookup(entries: DataFrame, parent, name: str) -> DataFrame:
    """The entry (parent, name, child, ...) of a directory with this name."""
    return entries.where((F.col("parent") == parent) & (F.col("name") == name))


def read_directory(entries: DataFrame, parent, marker: str = "", limit: int = 1000) -> DataFrame:
    """A page of a directory's entries after the marker, in order of name."""
    return entries.where((F.col("parent") == parent) & (F.col("name") > marker)).orderBy("name").limit(limit)


def directory_stat(entries: DataFrame, size: str) -> DataFrame:
    """Entries and bytes of each directory."""
    return entries.groupBy("parent").agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def inode_names(inodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Inodes (child, ...) with the names that lead to them; several names give several rows, none a null."""
    return inodes.join(entries.select("child", "parent", "name"), "child", "left")


def combinations(items, k: int):
    """All subsets of k items of a short array of distinct ones, each in the array's order, as an array of arrays."""
    out = F.transform(items, lambda x: F.array(x))
    for _ in range(k - 1):
        later = lambda c: F.slice(items, F.array_position(items, F.element_at(c, -1)).cast("int") + 1, F.size(items))
        out = F.flatten(F.transform(out, lambda c: F.transform(later(c), lambda x: F.concat(c, F.array(x)))))
    return out


def is_subset(part, whole):
    return F.size(F.array_except(part, whole)) == 0


def placement(df: DataFrame, key, rows: int) -> DataFrame:
    """Items in each placement row."""
    return df.groupBy(F.pmod(key, F.lit(rows)).alias("row")).agg(F.count("*").alias("cnt"))


def ring_owner(keys: DataFrame, ring: DataFrame, h: str) -> DataFrame:
    """The server with the least ring position at or after the key's hash, around the ring. ring: (pos, server), of any size.

    Keys and ring positions are dealt out by fixed ranges of the ring and sorted once; going down, each key sees the last
    position above it. A key without a hash takes the first position of all. A range's uppermost keys take the first position of the ranges after it, the last
    range's those of the first: one row for each range, which is all that is collected in one place.
    """
    names = keys.columns
    on_ring = ring.where("pos IS NOT NULL").select(F.col("pos").cast("long").alias("_h"), F.struct(F.col("pos").cast("long").alias("pos"), "server").alias("_s"), *(F.lit(None).cast(keys.schema[c].dataType).alias(c) for c in names))
    both = keys.select(F.col(h).cast("long").alias("_h"), F.lit(None).cast(on_ring.schema["_s"].dataType).alias("_s"), *names).unionByName(on_ring)
    dealt = both.withColumn("_p", F.coalesce(range_of(both, "_h"), F.lit(0)))
    down = Window.partitionBy("_p").orderBy(F.desc("_h"), F.col("_s").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = dealt.groupBy("_p").agg(F.min("_s.pos").alias("_pos"), F.min_by("_s.server", "_s.pos").alias("_first"))
    later = Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = firsts.select("_p", F.coalesce(F.last("_first", True).over(later), F.last("_first", True).over(everywhere)).alias("_next"))
    seen = dealt.withColumn("_own", F.last("_s", True).over(down)).where("_s IS NULL").join(F.broadcast(carried), "_p")
    return seen.select(*names, F.coalesce("_own.server", "_next").alias("server"))
