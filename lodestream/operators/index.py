"""Ordered key queries: ranges, prefixes, pages, merges, overlays, key/value sets.

Keys sort as bytes, Spark's default for strings. Filters on the key reach the Parquet scan, and an
order with a limit is a top-k (each task keeps k rows), so a page never sorts the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import pick, range_of


def range_page(df: DataFrame, key: str, marker: str | None = None, end: str | None = None, limit: int = 1000, inclusive: bool = False) -> DataFrame:
    """Keys after the marker (or from it on) up to and with end."""
    k = F.col(key)
    if marker is not None:
        df = df.where(k >= marker if inclusive else k > marker)
    if end is not None:
        df = df.where(k <= end)
    return df.orderBy(key).limit(limit)


def prefix_scan(df: DataFrame, key: str, prefix: str, marker: str = "", limit: int = 1000, strict: bool = True) -> DataFrame:
    """Keys with the prefix, from the marker on (with it). Without strict the prefix only sets the start."""
    start = max(prefix, marker, key=lambda s: (len(s), s))
    df = df.where(F.col(key) >= start)
    return (df.where(F.col(key).startswith(prefix)) if strict else df).orderBy(key).limit(limit)


def prefix_keys(df: DataFrame, key: str, prefix: str, marker: str = "", limit: int = 1000, details: tuple[str, ...] = ()) -> DataFrame:
    """Keys with the prefix, without values; with details the key and these columns, joined by tabs."""
    text = F.concat_ws("\t", key, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in details))
    return prefix_scan(df, key, prefix, marker, limit).select(text.alias("key"))


def overlay_scan(base: DataFrame, changes: DataFrame, key: str, value: str, start: str, limit: int = 1000, strict: bool = False) -> DataFrame:
    """A page of a listing seen through pending changes. Both sides are cut to the page's range before they meet."""
    cut = lambda d: d.where((F.col(key) >= start) & F.col(key).startswith(start)) if strict else d.where(F.col(key) >= start)
    return overlay(cut(base), cut(changes), key, value).orderBy(key).limit(limit)


def prefix_pages(df: DataFrame, key: str, prefix: str, size: int = 1000) -> DataFrame:
    """Every row with the prefix and its page, each row once."""
    return pages(df.where(F.col(key).startswith(prefix)), key, size)


def object_info(df: DataFrame, properties: str, names: tuple[str, ...]) -> DataFrame:
    """Numbers picked from a map of texts; what is no number is null."""
    return df.select("*", *(F.try_element_at(properties, F.lit(n)).try_cast("long").alias(n) for n in names))


def stat(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The wanted keys and whether they are there."""
    there = df.select(key).distinct().withColumn("_there", F.lit(True))
    return wanted.select(key).join(there, key, "left").select(key, F.col("_there").isNotNull().alias("found"))


def overlay_put(changes: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Pending changes (key, value, action) with newer ones in place of those of the same keys."""
    return changes.join(rows.select(key), key, "left_anti").select(*changes.columns).unionByName(rows)


def overlay_find(base: DataFrame, changes: DataFrame, key: str, value: str, k) -> DataFrame:
    """One key through the overlay: the change if there is one, else the stored row."""
    return overlay(base.where(F.col(key) == k), changes.where(F.col(key) == k), key, value)


def attributes_put(stored: DataFrame, rows: DataFrame, key: str, shards: int) -> DataFrame:
    """Attribute rows added to their shards: a later sum by shard gives the totals."""
    return stored.unionByName(rows.withColumn("shard", F.pmod(F.col(key), F.lit(shards)).cast(stored.schema["shard"].dataType)))


def apply_deltas(rows: DataFrame, deltas: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Rows with the sums of their keys' metadata deltas added; deltas of a change must agree in sign."""
    add = check_signs(deltas, cols).groupBy(key).agg(*(F.sum(c).alias(f"_{c}") for c in cols))
    return rows.join(add, key, "left").select(*((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) if c in cols else F.col(c) for c in rows.columns))


def pages(df: DataFrame, key: str, size: int = 1000) -> DataFrame:
    """Every row with its page number: what a client that pages through all keys sees, each row once.

    Rows of a range of keys are numbered there and start from the rows before it. Null keys come last.
    """
    numbered = df.withColumn("_p", F.coalesce(range_of(df, key), F.lit(1 << 30)))
    order = Window.partitionBy("_p").orderBy(key)
    rows = numbered.withColumn("_r", F.row_number().over(order))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return rows.join(F.broadcast(starts), "_p").withColumn("page", F.floor((F.col("_s") + F.col("_r") - 1) / size).cast("long")).drop("_p", "_r", "_s")


def cmp_filter(df: DataFrame, key: str, pattern: str, cmp: int) -> DataFrame:
    """cmp 1: greater; 0: greater or equal; -1: all."""
    return df.where(F.col(key) > pattern) if cmp > 0 else df.where(F.col(key) >= pattern) if cmp == 0 else df


def kway_merge(lists: list[DataFrame], key: str, value: str) -> DataFrame:
    """Sorted lists to one; of equal keys the first list's row is taken."""
    tagged = [d.select(key, value, F.lit(i).alias("_i")) for i, d in enumerate(lists)]
    return pick(reduce(DataFrame.unionByName, tagged), [key], ["_i", value], last=False).select(key, value)


def overlay(base: DataFrame, changes: DataFrame, key: str, value: str, precedence: str = "overlay") -> DataFrame:
    """Stored rows seen through pending changes (key, value, action PUT or DEL).

    With precedence 'base' a pending PUT does not replace a stored row; a DEL hides it either way.
    """
    b = base.select(key, F.col(value).alias("_b"), F.lit(True).alias("_stored"))
    c = changes.select(key, F.col(value).alias("_c"), "action")
    both = b.join(c, key, "full_outer").where(~F.col("action").eqNullSafe("DEL"))
    put = F.col("action").eqNullSafe("PUT")
    shown = F.when(put, F.col("_c")).otherwise(F.col("_b")) if precedence == "overlay" else F.when(F.col("_stored").isNotNull(), F.col("_b")).otherwise(F.col("_c"))
    return both.select(key, shown.alias(value))


def kv_get(df: DataFrame, key: str, k) -> DataFrame:
    return df.where(F.col(key) == k).limit(1)


def kv_put(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return df.join(rows.select(key), key, "left_anti").unionByName(rows)


def kv_delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def key_values(df: DataFrame, key: str, value: str, start: str, max_len: int, count: int) -> DataFrame:
    return df.where(F.col(key) >= start).orderBy(key).limit(count).select(key, F.substring(value, 1, max_len).alias(value))


def metadata_by_pattern(df: DataFrame, key: str, pattern: str) -> DataFrame:
    return df.where(F.col(key).startswith(pattern))


def service_objects(df: DataFrame, key: str, pattern: str, count: int) -> DataFrame:
    """Keys from the pattern on; asking for one gives it only if it is the pattern itself."""
    return df.where(F.col(key) == pattern).limit(1) if count == 1 else df.where(F.col(key) >= pattern).orderBy(key).limit(count)


def as_json(df: DataFrame, key: str, value: str) -> Column:
    """For an aggregation: one JSON object of a page's keys and values."""
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))))


def as_csv(key: str, value: str) -> Column:
    """'key;value', quoted only if the value has a comma, a line feed or two quotes in a row."""
    v = F.col(value).cast("string")
    odd = F.contains(v, F.lit(",")) | F.contains(v, F.lit("\n")) | F.contains(v, F.lit('""'))
    return F.concat_ws(";", F.col(key), F.when(odd, F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v))


def check_signs(deltas: DataFrame, cols: list[str]) -> DataFrame:
    """Metadata deltas of one change must all be at least 0, or all at most 0."""
    up = reduce(lambda a, b: a & b, [F.col(c) >= 0 for c in cols])
    down = reduce(lambda a, b: a & b, [F.col(c) <= 0 for c in cols])
    return deltas.where(F.when(up | down, F.lit(True)).otherwise(F.raise_error(F.lit("deltas of both signs")).cast("boolean")))


def sharded_sums(df: DataFrame, key: Column, shards: int, cols: list[str]) -> DataFrame:
    return df.groupBy(F.pmod(key, F.lit(shards)).alias("shard")).agg(*(F.sum(c).alias(c) for c in cols), F.count("*").alias("cnt"))
