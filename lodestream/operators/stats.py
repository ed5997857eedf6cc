"""Moving statistics, rates, and statistics of groups and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import pick

RING = 64


def _frame(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(RING - 1), 0)


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Sum of the last 64 samples over 64, also before there are 64; a whole number from 1 to 2,000,000."""
    s = F.sum(value).over(_frame(keys, order))
    return df.withColumn("mean64", F.least(F.greatest(F.floor(s / RING), F.lit(1)), F.lit(2_000_000)).cast("long"))


def moving_deviation(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return df.withColumn("std64", F.round(F.stddev_pop(value).over(_frame(keys, order)), 4))


def moving_p90(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """mean + 1.282 sample deviations of the same frame."""
    w = _frame(keys, order)
    return df.withColumn("p90", F.round(F.avg(value).over(w) + 1.282 * F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)), 4))


def rates(df: DataFrame, keys: list[str], order: list[str], value: str, seconds: int = 5) -> DataFrame:
    """Growth of a cumulative counter for each second; 0 if it did not grow."""
    d = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rate", F.when(d > 0, F.floor(d / seconds)).otherwise(0).cast("long"))


def sequential_reads(df: DataFrame, keys: list[str], order: list[str], off: str, length: str) -> DataFrame:
    """Runs in which each read begins where the last ended: run number within the keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    begins = (F.lag(F.col(off) + F.col(length)).over(w) == F.col(off)).eqNullSafe(True)
    return df.withColumn("run", F.sum((~begins).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def group_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median; of two middle values their mean, cut to a whole number."""
    return df.groupBy(*keys).agg(F.floor(F.percentile(value, 0.5)).cast("long").alias("median"))


def median_candidates(df: DataFrame, keys: list[str], ident: str, value: str) -> DataFrame:
    """The least value strictly below the group's median and the greatest strictly above; null if there is none."""
    m = df.join(group_median(df, keys, value), keys)
    below = F.min_by(ident, F.when(F.col(value) < F.col("median"), F.struct(value, ident)))
    above = F.max_by(ident, F.when(F.col(value) > F.col("median"), F.struct(value, ident)))
    return m.groupBy(*keys, "median").agg(below.alias("source"), above.alias("target"))


def distinct_alive(df: DataFrame, keys: list[str], ident: str, alive) -> DataFrame:
    """Distinct members, all and alive: members collapse first, so a hot group is counted from partial results."""
    one = df.groupBy(*keys, ident).agg(F.max(alive.cast("int")).alias("_a"))
    return one.groupBy(*keys).agg(F.count(ident).alias("members"), F.sum(F.when(F.col(ident).isNotNull(), F.col("_a"))).alias("alive"))


def health(df: DataFrame, keys: list[str], state: str) -> DataFrame:
    """All devices FAULTED: FAULTED; any FAULTED or READONLY: DEGRADED; else ONLINE."""
    bad, odd = F.sum((F.col(state) == "FAULTED").cast("int")), F.sum(F.col(state).isin("FAULTED", "READONLY").cast("int"))
    return df.groupBy(*keys).agg(F.when(bad == F.count("*"), "FAULTED").when(odd > 0, "DEGRADED").otherwise("ONLINE").alias("health"))


def cluster_summary(df: DataFrame, capacity: str, used: str, objects: str, state: str) -> DataFrame:
    on = F.col(state) == "ONLINE"
    t = df.agg(*(F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0)).cast("long").alias(n) for c, n in ((capacity, "capacity"), (used, "used"), (objects, "objects"))))
    return t.withColumn("available", F.col("capacity") - F.col("used")).withColumn("utilisation", F.when(F.col("capacity") > 0, F.floor(100 * F.col("used") / F.col("capacity"))).otherwise(0).cast("long"))


def utilisation_spread(df: DataFrame, keys: list[str], used: str, capacity: str) -> DataFrame:
    u = 100.0 * F.col(used) / F.col(capacity)
    return df.groupBy(*keys).agg(F.round(F.avg(u), 4).alias("mean_pct"), F.round(F.stddev_pop(u), 4).alias("std_pct"), F.count("*").alias("devices"))


def replica_count(df: DataFrame, keys: list[str], device: str, most: int) -> DataFrame:
    return df.select(*keys, device).distinct().groupBy(*keys).agg(F.least(F.count(device), F.lit(most)).cast("long").alias("replicas"))


def host_average(df: DataFrame, host: str, order: list[str], value: str) -> DataFrame:
    """Mean of the hosts' first reports, cut to a whole number."""
    first = pick(df.select(host, F.col(value).alias("_v"), *order), [host], order, last=False)
    return first.agg(F.floor(F.avg("_v")).cast("long").alias("average"), F.count("*").alias("hosts"))


def device_states(checkpoint: DataFrame, stats: DataFrame, keys: list[str], now: int, fresh: int = 20) -> DataFrame:
    """Devices of the checkpoint with their state: stale ones and those without statistics are FAULTED."""
    named = F.when(F.col("state") == 1, "ONLINE").when(F.col("state") == 2, "READONLY").otherwise("FAULTED")
    s = stats.select(*keys, F.when(F.col("ts") >= now - fresh, named).otherwise("FAULTED").alias("_s"))
    return checkpoint.join(s, keys, "left").select(*keys, F.coalesce("_s", F.lit("FAULTED")).alias("state"))


def rtt(df: DataFrame, row: str, kind: str, order: list[str], value: str) -> DataFrame:
    """Moving round-trip time of each placement row and kind of message."""
    return moving_average(df, [row, kind], order, value)


def size_class(size) -> Column:
    """Classes of payload size: 0 up to 4 KB, then one for each doubling, the last from 1 MB on."""
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(1)) / 4096)), F.lit(0)), F.lit(8)).cast("int")


def class_latency(df: DataFrame, keys: list[str], size: str, latency: str) -> DataFrame:
    """Mean latency (cut to a whole number) and samples of each size class."""
    return df.groupBy(*keys, size_class(F.col(size)).alias("size_class")).agg(F.floor(F.avg(latency)).cast("long").alias("latency"), F.count("*").alias("samples"))


def server_space(df: DataFrame, server: str, size: str, available: str) -> DataFrame:
    """Used and whole space of each server's devices."""
    return df.groupBy(server).agg(F.sum(F.col(size) - F.col(available)).alias("used"), F.sum(size).alias("capacity"), F.count("*").alias("devices"))


def medians_json(medians: DataFrame, group: str) -> DataFrame:
    """All groups' medians as one JSON list, in order of the groups; groups are servers or rows of a cluster."""
    return medians.agg(F.to_json(F.array_sort(F.collect_list(F.struct(group, "median")))).alias("medians"))


def object_health(df: DataFrame, obj: str, kind: str, replicas: str, verified: str, want: int) -> DataFrame:
    """Eighteen counts for each object: payload, manifest and parity chunks by all, verified, one reference, lost, too few, too many copies."""
    r = F.col(replicas)
    checks = {"total": F.lit(True), "verified": F.col(verified), "one": r == 1, "lost": r == 0, "few": r < want, "many": r > want}
    return df.groupBy(obj).agg(*(F.sum(((F.col(kind) == k) & c).cast("long")).alias(f"{k}_{n}") for k in ("payload", "manifest", "parity") for n, c in checks.items()))


def row_utilisation(usage: DataFrame, devices: DataFrame, server: str, rows_of: str, capacity: str) -> DataFrame:
    """Usage rows (server, row, mb) against the servers' table: share of the space, and whether as many rows are used as the table says."""
    used = usage.groupBy(server).agg(F.countDistinct("row").alias("rows"), F.sum("mb").alias("mb"))
    pct = F.when(F.col(capacity) > 0, F.floor(100 * F.col("mb") / F.col(capacity))).cast("long")
    joined = devices.join(used, server, "left").withColumn("rows", F.coalesce("rows", F.lit(0))).withColumn("mb", F.coalesce("mb", F.lit(0)))
    return joined.select(server, "rows", "mb", pct.alias("utilisation"), (F.col("rows") != F.col(rows_of)).alias("mismatch"))


def row_usage(df: DataFrame, server: str, listing: str) -> DataFrame:
    """Lists such as '3#120^7#5^' to rows (server, row, mb)."""
    item = F.explode(F.filter(F.split(listing, r"\^"), lambda x: x != ""))
    return df.select(server, item.alias("_i")).select(server, F.split_part("_i", F.lit("#"), F.lit(1)).cast("int").alias("row"), F.split_part("_i", F.lit("#"), F.lit(2)).cast("long").alias("mb"))


def skew(counts: DataFrame, cnt: str) -> DataFrame:
    return counts.agg(F.max(cnt).alias("most"), F.round(F.max(cnt) / F.avg(cnt), 4).alias("skew"), F.count("*").alias("rows"))
