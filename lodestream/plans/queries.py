"""Registered queries: each operator over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import content, index, metrics, stats, txlog, versions
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WIDTH = 3600


def samples(spark, d) -> DataFrame:
    """events as metric samples: (w, name, value, user_id, event_id, us)."""
    e = table(spark, d, "events")
    us = S.epoch_us(F.col("ts"))
    return e.select((F.floor(us / (1_000_000 * WIDTH)) * WIDTH).cast("long").alias("w"), F.col("event_type").alias("name"), "value", "user_id", "event_id", us.alias("us"))


SAMPLES = f"WITH s AS (SELECT (epoch_us(ts) // {1_000_000 * WIDTH}) * {WIDTH} AS w, event_type AS name, value, user_id, event_id, epoch_us(ts) AS us FROM events) "


@query(
    SAMPLES
    + """SELECT w, name, count(value) AS cnt, round(sum(value), 4) AS total, round(sum(value * value), 4) AS sum_sq, min(value) AS lo, max(value) AS hi,
    round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS stdev FROM s GROUP BY w, name"""
)
def counter_flush(spark, d):
    return metrics.counters(samples(spark, d), ["w", "name"])


@query("SELECT event_type AS name, count(value) AS cnt, round(sum(value), 4) AS total, round(sum(value * value), 4) AS sum_sq, min(value) AS lo, max(value) AS hi, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS stdev FROM events GROUP BY 1")
def timer_stats(spark, d):
    return metrics.counters(samples(spark, d), ["name"])


@query(SAMPLES + "SELECT w, name, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, count(*) AS cnt FROM s GROUP BY w, name")
def timer_quantiles_exact(spark, d):
    return metrics.quantiles_exact(samples(spark, d), ["w", "name"])


@query()
def timer_quantiles_approx(spark, d):
    return metrics.quantiles_approx(samples(spark, d), ["name"])


@query(SAMPLES + "SELECT w, name, value > 50 AS high, count(DISTINCT user_id) AS members FROM s GROUP BY 1, 2, 3")
def set_cardinality(spark, d):
    """All events in groups of an hour, counted exactly however large the groups are."""
    return metrics.set_cardinality(samples(spark, d).withColumn("high", F.col("value") > 50), ["w", "name", "high"], "user_id", None)


@query()
def set_cardinality_all(spark, d):
    """Over all events; large groups are estimated, so no SQL gives the same."""
    return metrics.set_cardinality(samples(spark, d).withColumn("day", F.expr("w div 86400")), ["day", "name"], "user_id")


@query()
def set_cardinality_estimated(spark, d):
    return metrics.set_cardinality(samples(spark, d), ["name"], "event_id")


@query()
def set_sketch_merge(spark, d):
    return metrics.merged_sets(metrics.set_sketches(samples(spark, d), ["w", "name"], "user_id"), ["name"])


HIST = """WITH n AS (SELECT DISTINCT event_type AS name FROM events), b AS (SELECT unnest(range(0, 5))::INT AS bin),
c AS (SELECT event_type AS name, (CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 4 ELSE least(floor((value - 0) / 30) + 1, 4) END)::INT AS bin, count(*) AS cnt FROM events GROUP BY 1, 2)
SELECT n.name, b.bin, coalesce(cnt, 0) AS cnt FROM n CROSS JOIN b LEFT JOIN c ON c.name = n.name AND c.bin = b.bin"""


@query(HIST)
def histogram_bins(spark, d):
    return metrics.histogram(samples(spark, d), ["name"], 0.0, 100.0, 30.0)


PREFIXES = [("", 0.0, 200.0, 20.0), ("s", 0.0, 100.0, 5.0), ("sign", 0.0, 50.0, 5.0), ("error", 1.0, 2.0, 0.5), ("pur", 0.0, 10.0, 1.0), ("nothing", 0.0, 1.0, 1.0)]


@query(
    "WITH c(prefix, lo, hi, width) AS (VALUES " + ", ".join(f"('{p}', {a}::DOUBLE, {b}::DOUBLE, {w}::DOUBLE)" for p, a, b, w in PREFIXES) + "), n AS (SELECT DISTINCT event_type AS name FROM events) "
    "SELECT name, arg_max(prefix, length(prefix)) AS prefix, arg_max(lo, length(prefix)) AS lo, arg_max(hi, length(prefix)) AS hi, arg_max(width, length(prefix)) AS width FROM n, c WHERE starts_with(name, prefix) GROUP BY name"
)
def histogram_prefix_match(spark, d):
    return metrics.longest_prefix(samples(spark, d), spark.createDataFrame(PREFIXES, "prefix string, lo double, hi double, width double"))


@query(SAMPLES + "SELECT w, name, arg_max(value, (us, event_id)) AS value FROM s GROUP BY w, name")
def gauge_last(spark, d):
    return metrics.gauge_last(samples(spark, d), ["w", "name"], ["us", "event_id"])


@query(
    SAMPLES
    + """, l AS (SELECT w, name, max(event_id) AS at, arg_max(value, event_id) AS v FROM s WHERE event_id % 3 <> 0 GROUP BY w, name)
    SELECT s.w, s.name, round(coalesce(max(l.v), 0) + coalesce(sum(CASE WHEN s.event_id % 3 = 0 AND (l.at IS NULL OR s.event_id > l.at) THEN s.value END), 0), 4) AS value
    FROM s LEFT JOIN l ON s.w = l.w AND s.name = l.name GROUP BY s.w, s.name"""
)
def gauge_delta(spark, d):
    return metrics.gauge_delta(samples(spark, d).withColumn("is_delta", F.col("event_id") % 3 == 0), ["w", "name"], ["event_id"])


@query(SAMPLES + "SELECT w, name, value, row_number() OVER (PARTITION BY w, name ORDER BY us DESC, event_id DESC)::INT AS pos FROM s")
def kv_passthrough(spark, d):
    return metrics.kv_passthrough(samples(spark, d), ["w", "name"], ["us", "event_id"])


@query(
    "SELECT event_type AS name, count(*) AS cnt, round(sum(CASE WHEN event_id % 2 = 0 AND event_id % 5 > 0 THEN value / ((event_id % 5) * 0.25) ELSE value END), 3) AS total "
    "FROM (SELECT * FROM events) GROUP BY 1"
)
def sample_scaling(spark, d):
    s = samples(spark, d).withColumn("type", F.when(F.col("event_id") % 2 == 0, "c").otherwise("ms")).withColumn("rate", (F.col("event_id") % 5) * 0.25)
    return metrics.scale_samples(s).groupBy("name").agg(F.count("*").alias("cnt"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT substring(event_type || ':' || user_id, 1, 6) AS key, arg_max(value, (epoch_us(ts), event_id)) AS value, max(epoch_us(ts)) AS ts FROM events GROUP BY 1")
def latest_values(spark, d):
    s = samples(spark, d).select(F.concat("name", F.lit(":"), F.col("user_id").cast("string")).alias("name"), "value", F.col("us").alias("ts"), "event_id")
    return metrics.latest_values(s, ["ts", "event_id"], 6)


@query("SELECT 'counts.' || event_type || '|' || printf('%.6f', round(sum(value), 4)) || '|0' AS line FROM events GROUP BY event_type")
def flush_format(spark, d):
    c = metrics.counters(samples(spark, d), ["name"]).withColumn("w", F.lit(0).cast("long"))
    return metrics.flush_lines(c)


@query("SELECT * FROM (SELECT p_name || '#' || lpad(p_partkey::VARCHAR, 8, '0') AS key, p_brand AS value FROM part) WHERE starts_with(key, 'cold') AND key >= 'cold gadget' ORDER BY key LIMIT 500")
def prefix_scan(spark, d):
    return index.prefix_scan(parts(spark, d), "key", "cold", "cold gadget", 500)


def parts(spark, d):
    return table(spark, d, "part").select(F.concat("p_name", F.lit("#"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("key"), F.col("p_brand").alias("value"))


def people(spark, d):
    return table(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name > 'Customer#000000010' AND c_name <= 'Customer#000000900' ORDER BY 1 LIMIT 300")
def range_page(spark, d):
    return index.range_page(people(spark, d), "key", "Customer#000000010", "Customer#000000900", 300)


@query("SELECT c_name AS key, c_mktsegment AS value, (row_number() OVER (ORDER BY c_name) - 1) // 1000 AS page FROM customer")
def paged_list(spark, d):
    return index.pages(people(spark, d), "key", 1000)


@query("SELECT c_name AS key, c_mktsegment AS value, c FROM customer, (SELECT unnest([-1, 0, 1]) AS c) WHERE c = -1 OR (c = 0 AND c_name >= 'Customer#000000100') OR (c = 1 AND c_name > 'Customer#000000100')")
def cmp_filter(spark, d):
    p = people(spark, d)
    one = lambda c: index.cmp_filter(p, "key", "Customer#000000100", c).withColumn("c", F.lit(c))
    return one(-1).unionByName(one(0)).unionByName(one(1))


@query("SELECT c_name AS key, substring(c_mktsegment, 1, 4) AS value FROM customer WHERE c_name >= 'Customer#000000050' ORDER BY 1 LIMIT 100")
def key_values(spark, d):
    return index.key_values(people(spark, d), "key", "value", "Customer#000000050", 4, 100)


@query("SELECT s_name AS key, s_nationkey AS value FROM supplier WHERE starts_with(s_name, 'Supplier#00000000')")
def metadata_by_pattern(spark, d):
    return index.metadata_by_pattern(table(spark, d, "supplier").select(F.col("s_name").alias("key"), F.col("s_nationkey").alias("value")), "key", "Supplier#00000000")


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name = 'Customer#000000007'")
def point_get(spark, d):
    return index.kv_get(people(spark, d), "key", "Customer#000000007")


@query("SELECT o_custkey AS key, arg_min(o_orderkey, (o_orderkey % 4, o_orderkey)) AS value FROM orders GROUP BY 1")
def kway_merge(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"))
    return index.kway_merge([o.where(F.col("value") % 4 == i) for i in range(4)], "key", "value")


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    one = lambda t, c: table(spark, d, t).select(F.col(c).alias("nation"))
    return one("customer", "c_nationkey").unionByName(one("supplier", "s_nationkey")).distinct()


@query("SELECT o_orderkey, o_custkey FROM orders")
def union_all(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.where("o_orderkey % 3 = 0").unionByName(o.where("o_orderkey % 3 = 1")).unionByName(o.where("o_orderkey % 3 = 2"))


def stored_rows(spark, d):
    return table(spark, d, "orders").where("o_orderkey % 4 <> 1").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))


def pending(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 3 = 0")
    return o.select(F.col("o_orderkey").alias("key"), F.concat(F.lit("new "), "o_orderpriority").alias("value"), F.when(F.col("o_orderkey") % 5 == 0, "DEL").otherwise("PUT").alias("action"))


OVERLAY = """WITH b AS (SELECT o_orderkey AS key, o_orderpriority AS bv FROM orders WHERE o_orderkey % 4 <> 1),
c AS (SELECT o_orderkey AS key, 'new ' || o_orderpriority AS cv, CASE WHEN o_orderkey % 5 = 0 THEN 'DEL' ELSE 'PUT' END AS action FROM orders WHERE o_orderkey % 3 = 0)
SELECT key, {} AS value FROM b FULL JOIN c USING (key) WHERE action IS DISTINCT FROM 'DEL'"""


@query(OVERLAY.format("coalesce(cv, bv)"))
def overlay_insert_wins(spark, d):
    return index.overlay(stored_rows(spark, d), pending(spark, d), "key", "value")


@query(OVERLAY.format("coalesce(bv, cv)"))
def overlay_base_wins(spark, d):
    return index.overlay(stored_rows(spark, d), pending(spark, d), "key", "value", "base")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def history_anti_join(spark, d):
    return txlog.not_processed(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def owner_semi_join(spark, d):
    mine = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(mine, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT key, value FROM (SELECT o_orderkey AS key, o_orderpriority AS value FROM orders WHERE o_orderkey % 4 <> 1) WHERE key % 3 <> 0")
def kv_delete(spark, d):
    return index.kv_delete(stored_rows(spark, d), pending(spark, d), "key")


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'new ' || o_orderpriority ELSE o_orderpriority END AS value FROM orders WHERE o_orderkey % 4 <> 1 OR o_orderkey % 3 = 0")
def kv_put(spark, d):
    return index.kv_put(stored_rows(spark, d), pending(spark, d).select("key", "value"), "key")


@query("SELECT o_custkey % 8 AS shard, sum(o_orderkey)::BIGINT AS o_orderkey, count(*) AS cnt FROM orders GROUP BY 1")
def sharded_sums(spark, d):
    return index.sharded_sums(table(spark, d, "orders"), F.col("o_custkey"), 8, ["o_orderkey"])


# --- roll-ups: customer is a bucket, nation a tenant, region a cluster; an order is an object ---


def buckets(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.floor(F.col("o_totalprice")).cast("long")).alias("size"), F.count("*").alias("objects"))
    j = c.join(o, "c_custkey", "left").join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.select(F.col("r_name").alias("cid"), F.col("n_name").alias("tid"), F.col("c_name").alias("bid"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("objects", F.lit(0)).alias("objects"), "c_custkey")


BUCKETS = """WITH b AS (SELECT r_name AS cid, n_name AS tid, c_name AS bid, coalesce(size, 0) AS size, coalesce(objects, 0) AS objects, c_custkey FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT o_custkey, sum(floor(o_totalprice)::BIGINT)::BIGINT AS size, count(*) AS objects FROM orders GROUP BY 1) ON o_custkey = c_custkey) """


@query(BUCKETS + "SELECT cid, tid, sum(size)::BIGINT AS size, sum(objects)::BIGINT AS objects, count(*) AS buckets FROM b GROUP BY cid, tid")
def tenant_rollup(spark, d):
    return buckets(spark, d).groupBy("cid", "tid").agg(F.sum("size").alias("size"), F.sum("objects").alias("objects"), F.count("*").alias("buckets"))


@query(BUCKETS + "SELECT cid, sum(size)::BIGINT AS size, sum(objects)::BIGINT AS objects, count(DISTINCT tid) AS tenants FROM b GROUP BY cid")
def cluster_rollup(spark, d):
    t = buckets(spark, d).groupBy("cid", "tid").agg(F.sum("size").alias("size"), F.sum("objects").alias("objects"))
    return t.groupBy("cid").agg(F.sum("size").alias("size"), F.sum("objects").alias("objects"), F.count("*").alias("tenants"))


@query(BUCKETS + "SELECT cid, tid, sum(size)::BIGINT AS size, grouping_id(cid, tid)::BIGINT AS level FROM b GROUP BY ROLLUP (cid, tid)")
def rollup_levels(spark, d):
    return buckets(spark, d).rollup("cid", "tid").agg(F.sum("size").alias("size"), F.grouping_id("cid", "tid").cast("long").alias("level"))


@query(
    BUCKETS
    + "SELECT cid, sum(floor(size * CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 > 0 THEN (4 + c_custkey % 3) / 4.0::DOUBLE ELSE 3 END)::BIGINT)::BIGINT AS used FROM b GROUP BY cid"
)
def estimated_used(spark, d):
    ec = F.when(F.col("c_custkey") % 3 > 0, 4 * 256 + F.col("c_custkey") % 3).otherwise(0).cast("int")
    factor = S.used_factor(F.lit(3), F.col("c_custkey") % 2 == 0, ec)
    return buckets(spark, d).groupBy("cid").agg(F.sum(F.floor(F.col("size") * factor).cast("long")).alias("used"))


# --- change log: an order's status is the kind of change of its customer's listing ---


def log(spark, d):
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "O", txlog.CREATE).when(F.col("o_orderstatus") == "F", txlog.DELETE).otherwise(txlog.UPDATE)
    size = F.floor(F.col("o_totalprice")).cast("long")
    return o.select(
        F.col("o_custkey").alias("phid"), (F.col("o_orderkey") % 10).alias("oid"), F.col("o_orderkey").alias("generation"), (S.epoch_s(F.col("o_orderdate"))).alias("timestamp"), kind.cast("int").alias("trtype"),
        F.when(F.col("o_orderstatus") == "F", -size).otherwise(size).alias("deltasize"), F.col("o_orderpriority").alias("tid"),
    )


LOG = """WITH g AS (SELECT o_custkey AS phid, o_orderkey % 10 AS oid, o_orderkey AS generation, epoch_us(o_orderdate) // 1000000 AS timestamp,
CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 4 END AS trtype, CASE WHEN o_orderstatus = 'F' THEN -floor(o_totalprice)::BIGINT ELSE floor(o_totalprice)::BIGINT END AS deltasize, o_orderpriority AS tid FROM orders) """


@query(LOG + "SELECT phid, oid, min(generation) AS generation, arg_min(trtype, generation)::INT AS trtype FROM g GROUP BY phid, oid")
def log_dedup(spark, d):
    g = log(spark, d).drop("tid")
    twice = g.unionByName(g.where("generation % 2 = 0"))
    return txlog.dedup(twice, ["phid", "oid"], ["generation"]).select("phid", "oid", "generation", "trtype")


@query(LOG + "SELECT phid, oid, generation, trtype, deltasize FROM (SELECT *, row_number() OVER (PARTITION BY phid, oid ORDER BY generation DESC, timestamp DESC) AS r FROM g) WHERE r = 1 AND trtype <> 2")
def log_apply(spark, d):
    return txlog.apply(log(spark, d).drop("tid"), ["phid", "oid"], ["generation", "timestamp"]).select("phid", "oid", "generation", "trtype", "deltasize")


@query(LOG + "SELECT count(*) AS rows, sum(generation)::BIGINT AS total FROM g WHERE timestamp <= 900000000 - 864000")
def log_cut_off(spark, d):
    return txlog.cut_off(log(spark, d), 900_000_000, 864_000).agg(F.count("*").alias("rows"), F.sum("generation").alias("total"))


@query(
    LOG + ", b AS (SELECT *, timestamp - timestamp % 864000 AS batch FROM g), h AS (SELECT * FROM b WHERE batch >= 820000000 - 820000000 % 864000 AND batch < 880000000 AND tid = '1-URGENT') "
    "SELECT generation, timestamp, batch FROM h WHERE batch IN (SELECT DISTINCT batch FROM h ORDER BY batch LIMIT 7)"
)
def log_search(spark, d):
    return txlog.search(log(spark, d), 820_000_000, 880_000_000, 864_000, 7, txlog.namespace_is(tid="1-URGENT")).select("generation", "timestamp", "batch")


@query(LOG + "SELECT generation, batch FROM (SELECT generation, timestamp - timestamp % 864000 AS batch, dense_rank() OVER (ORDER BY timestamp - timestamp % 864000) AS r FROM g) WHERE r <= 3")
def log_max_batches(spark, d):
    return txlog.search(log(spark, d), 0, 1 << 62, 864_000, 3, F.lit(True)).select("generation", "batch")


@query(LOG + "SELECT tid, sum(deltasize)::BIGINT AS size, sum(CASE trtype WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END)::BIGINT AS objects, sum(trunc(deltasize * 1.5::DOUBLE)::BIGINT)::BIGINT AS used FROM g GROUP BY tid")
def delta_rollup(spark, d):
    return txlog.delta_rollup(log(spark, d), ["tid"], F.lit(1.5))


@query(LOG + "SELECT trtype::INT AS trtype, count(*) AS cnt FROM g WHERE (trtype & 5) <> 0 GROUP BY 1")
def log_kind_filter(spark, d):
    return log(spark, d).where(txlog.kind_is(txlog.CREATE | txlog.UPDATE)).groupBy("trtype").agg(F.count("*").alias("cnt"))


@query(
    LOG + ", l AS (SELECT phid, list({'t': trtype, 'd': deltasize, 's': 0::BIGINT, 'n': 0::BIGINT} ORDER BY generation) AS l FROM g GROUP BY phid), "
    "r AS (SELECT phid, list_reduce(list_prepend({'t': 0, 'd': 0::BIGINT, 's': 0::BIGINT, 'n': 0::BIGINT}, l), lambda a, x: {'t': x.t, 'd': x.d, "
    "'s': CASE WHEN x.t = 2 AND -x.d > a.s THEN a.s ELSE greatest(a.s + x.d, 0) END, 'n': CASE x.t WHEN 2 THEN greatest(a.n - 1, 0) WHEN 1 THEN a.n + 1 ELSE a.n END}) AS r FROM l) "
    "SELECT phid, r.s::BIGINT AS size, r.n::BIGINT AS objects FROM r"
)
def clamped_rollup(spark, d):
    return txlog.clamped_rollup(log(spark, d), ["phid"], ["generation"])


@query(
    LOG + ", m AS (SELECT *, row_number() OVER w AS n, lead(trtype) OVER w AS nt, lag(trtype) OVER w AS pt FROM g WINDOW w AS (PARTITION BY phid ORDER BY generation, timestamp)) "
    "SELECT phid, n AS generation, trtype::INT AS trtype FROM m WHERE NOT (trtype = 1 AND coalesce(nt = 2, false)) AND NOT (trtype = 2 AND coalesce(pt = 1, false))"
)
def log_elide_pairs(spark, d):
    from pyspark.sql import Window

    g = log(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("phid").orderBy("generation", "timestamp")))
    numbered = g.withColumn("generation", F.col("n").cast("long")).drop("n")
    return txlog.elide_pairs(numbered, ["phid"]).select("phid", "generation", "trtype")


# --- versions: an order's lines are its versions ---


def history(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("object"), F.when(F.col("l_returnflag") == "R", -F.col("l_linenumber")).otherwise(F.col("l_linenumber")).cast("long").alias("generation"), S.epoch_s(F.col("l_shipdate")).alias("uvid_ts"),
        F.col("l_partkey").alias("content"), F.floor(F.col("l_extendedprice")).cast("long").alias("size"),
    )


HISTORY = "WITH v AS (SELECT l_orderkey AS object, (CASE WHEN l_returnflag = 'R' THEN -l_linenumber ELSE l_linenumber END)::BIGINT AS generation, epoch_us(l_shipdate) // 1000000 AS uvid_ts, l_partkey AS content, floor(l_extendedprice)::BIGINT AS size FROM lineitem) "


def one_of_each(spark, d):
    """Ties in generation and time go to the greatest content, in both engines: all in one number, so that rows are hashed and not sorted."""
    v = history(spark, d)
    digits = [(F.col("uvid_ts"), 1 << 40), (F.col("generation") + 64, 1 << 7), (F.col("content"), 1 << 40), (F.col("size"), 1 << 31)]
    order = F.lit(0).cast("decimal(38,0)")
    for c, base in digits:
        order = order * F.lit(base).cast("decimal(13,0)") + c
    got = v.groupBy("object", F.abs("generation").alias("_g")).agg(*(F.max_by(c, order).alias(c) for c in ("generation", "uvid_ts", "content", "size")))
    return got.select("object", "generation", "uvid_ts", "content", "size")


ONE = HISTORY.rstrip() + ", o AS (SELECT object, max(struct_pack(uvid_ts := uvid_ts, generation := generation, content := content, size := size)) AS r FROM v GROUP BY object, abs(generation)), u AS (SELECT object, r.generation AS generation, r.uvid_ts AS uvid_ts, r.content AS content, r.size AS size FROM o) "
TOP = "SELECT object, generation, uvid_ts, content, size FROM (SELECT *, row_number() OVER (PARTITION BY object ORDER BY abs(generation) DESC) AS r FROM u {}) WHERE r {} "


@query(ONE + TOP.format("", "= 1 AND generation > 0"))
def latest_version(spark, d):
    return versions.latest(one_of_each(spark, d), ["object"]).select("object", "generation", "uvid_ts", "content", "size")


@query(ONE + TOP.format("WHERE uvid_ts <= 880000000", "= 1 AND generation > 0"))
def as_of(spark, d):
    return versions.as_of(one_of_each(spark, d), ["object"], 880_000_000).select("object", "generation", "uvid_ts", "content", "size")


@query(ONE + TOP.format("", "<= 2"))
def keep_n_versions(spark, d):
    return versions.keep_newest(one_of_each(spark, d), ["object"], 2)


@query(ONE + "SELECT object, generation, content FROM u WHERE abs(generation) = 3")
def version_by_generation(spark, d):
    return versions.at_generation(one_of_each(spark, d), 3).select("object", "generation", "content")


def snapshots(spark, d):
    v = one_of_each(spark, d)
    return v.where("object % 2 = 0 AND abs(generation) = 1").select(F.lit("first").alias("snapshot"), "object", "generation")


@query(ONE + "SELECT 'first' AS snapshot, object, generation, content FROM u WHERE object % 2 = 0 AND abs(generation) = 1")
def snapshot_asof(spark, d):
    return versions.snapshot_read(snapshots(spark, d), one_of_each(spark, d), ["object"]).select("snapshot", "object", "generation", "content")


@query(ONE + ", t AS (SELECT object, max(abs(generation)) AS top FROM u GROUP BY object) SELECT object, generation, content FROM u UNION ALL SELECT object, top + 1, content FROM u JOIN t USING (object) WHERE object % 2 = 0 AND abs(generation) = 1")
def snapshot_rollback(spark, d):
    return versions.rollback(one_of_each(spark, d), snapshots(spark, d), ["object"]).select("object", "generation", "content")


@query(
    ONE + ", e AS (SELECT * FROM u WHERE abs(generation) = 3), k AS (SELECT * FROM u WHERE abs(generation) <> 3), t AS (SELECT object, max(abs(generation)) AS a FROM k GROUP BY object) "
    "SELECT e.object, e.generation AS expunged, k.generation, k.size - e.size AS deltasize FROM e JOIN t USING (object) JOIN k ON k.object = t.object AND abs(k.generation) = t.a WHERE t.a < 3"
)
def version_expunge(spark, d):
    v = one_of_each(spark, d)
    return versions.expunge(v, v.where("abs(generation) = 3"), ["object"])


@query(ONE + "SELECT object, abs(generation) AS part, size, coalesce(sum(size) OVER (PARTITION BY object ORDER BY abs(generation) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM u")
def part_offsets(spark, d):
    return versions.part_offsets(one_of_each(spark, d).select("object", F.abs("generation").alias("part"), "size"), ["object"], "part", "size")


@query(
    ONE + ", p AS (SELECT object, abs(generation) AS part, size, coalesce(sum(size) OVER (PARTITION BY object ORDER BY abs(generation) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM u) "
    "SELECT object, part FROM p WHERE 50000 >= off AND 50000 < off + size"
)
def part_at_offset(spark, d):
    p = one_of_each(spark, d).select("object", F.abs("generation").alias("part"), "size")
    return versions.part_at(p, p.select("object").distinct().withColumn("at", F.lit(50_000)), ["object"], "part", "size").select("object", "part")


# --- content ---


@query("SELECT doc_id, i::INT AS chunk_no, length(c)::INT AS len, sha256(c) AS hash FROM (SELECT doc_id, unnest(range(0, ceil(length(text) / 4096)::BIGINT)) AS i, text FROM documents WHERE length(text) > 0), LATERAL (SELECT substring(text, i * 4096 + 1, 4096) AS c)")
def chunk_split(spark, d):
    return content.chunks(table(spark, d, "documents"), "doc_id", "text", 4096).drop("chunk")


@query(
    "WITH c AS (SELECT substring(text, i * 512 + 1, 512) AS c FROM (SELECT unnest(range(0, ceil(length(text) / 512)::BIGINT)) AS i, text FROM documents WHERE length(text) > 0)), "
    "h AS (SELECT c, count(*) AS n, length(c) AS len FROM c GROUP BY c) SELECT sum(n)::BIGINT AS chunks, count(*) AS unique_chunks, sum(len)::BIGINT AS stored, sum((n - 1) * len)::BIGINT AS saved FROM h"
)
def chunk_dedup(spark, d):
    return content.dedup_stats(content.chunks(table(spark, d, "documents"), "doc_id", "text", 512))


@query("SELECT doc_id, quality::BIGINT AS quality FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = labels.doc_id AND lang = 'en')")
def orphan_refs(spark, d):
    return content.orphans(table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality")), table(spark, d, "documents").where("lang = 'en'"), "doc_id")


@query("SELECT count(*) AS total, count(*) FILTER (n IS NULL) AS orphans, (100 * count(*) FILTER (n IS NULL)) // count(*) AS pct FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) USING (doc_id)")
def orphan_pct(spark, d):
    return content.orphan_share(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT coalesce(n, 0) AS refs, count(*) AS cnt FROM (SELECT p_partkey FROM part) LEFT JOIN (SELECT l_partkey AS p_partkey, count(*) AS n FROM lineitem GROUP BY 1) USING (p_partkey) GROUP BY 1")
def ref_histogram(spark, d):
    return content.ref_histogram(table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("SELECT doc_id % 64 AS row, count(*) AS cnt FROM documents GROUP BY 1")
def placement_rows(spark, d):
    return content.placement(table(spark, d, "documents"), F.col("doc_id"), 64)


@query("WITH c AS (SELECT doc_id % 64 AS row, count(*) AS cnt FROM documents GROUP BY 1) SELECT max(cnt) AS most, round(max(cnt) / avg(cnt), 4) AS skew, count(*) AS rows FROM c")
def placement_skew(spark, d):
    return stats.skew(content.placement(table(spark, d, "documents"), F.col("doc_id"), 64), "cnt")


RING = "SELECT (s_suppkey * 2654435761) % 4294967296 AS pos, s_name AS server FROM supplier"


@query(f"WITH r AS ({RING}), k AS (SELECT o_orderkey, (o_orderkey * 40503) % 4294967296 AS h FROM orders), f AS (SELECT arg_min(server, pos) AS s FROM r) SELECT o_orderkey, coalesce(server, (SELECT s FROM f)) AS server FROM k ASOF LEFT JOIN r ON r.pos >= k.h")
def ring_placement(spark, d):
    ring = table(spark, d, "supplier").select((F.col("s_suppkey") * 2654435761 % 4294967296).alias("pos"), F.col("s_name").alias("server"))
    keys = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 40503 % 4294967296).alias("h"))
    return content.ring_owner(keys, ring, "h").select("o_orderkey", "server")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 25)")
def index_without_manifest(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber")
    return content.orphans(li, table(spark, d, "part").where("p_size <= 25"), "p_partkey").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def manifest_without_index(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority <> '5-LOW'").select("o_orderkey")
    return content.orphans(o, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT o_custkey AS bucket, counted, stored FROM (SELECT o_custkey, count(*) AS counted, count(*) FILTER (o_orderkey % 50 <> 0) AS stored FROM orders GROUP BY 1) WHERE counted <> stored")
def counter_diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("bucket"), "o_orderkey")
    return content.counter_diff(o, o.where("o_orderkey % 50 <> 0").groupBy("bucket").agg(F.count("*").alias("stored")), "bucket")


# --- moving and group statistics ---

FRAME = "(PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)"


def user_events(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "value", F.floor(F.col("value") * 100).cast("long").alias("v"))


@query(f"SELECT user_id, event_id, least(greatest(floor(sum(floor(value * 100)::BIGINT) OVER {FRAME} / 64), 1), 2000000)::BIGINT AS mean64 FROM events")
def moving_avg_64(spark, d):
    return stats.moving_average(user_events(spark, d), ["user_id"], ["event_id"], "v").select("user_id", "event_id", "mean64")


@query(f"SELECT user_id, event_id, round(stddev_pop(value) OVER {FRAME}, 4) AS std64 FROM events")
def moving_std_64(spark, d):
    return stats.moving_deviation(user_events(spark, d), ["user_id"], ["event_id"], "value").select("user_id", "event_id", "std64")


@query(f"SELECT user_id, event_id, round(avg(value) OVER {FRAME} + 1.282 * coalesce(stddev_samp(value) OVER {FRAME}, 0), 4) AS p90 FROM events")
def moving_p90(spark, d):
    return stats.moving_p90(user_events(spark, d), ["user_id"], ["event_id"], "value").select("user_id", "event_id", "p90")


@query("SELECT user_id, event_id, CASE WHEN v - lag(v) OVER w > 0 THEN (v - lag(v) OVER w) // 5 ELSE 0 END AS rate FROM (SELECT *, floor(value * 100)::BIGINT AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def counter_rate(spark, d):
    return stats.rates(user_events(spark, d), ["user_id"], ["event_id"], "v").select("user_id", "event_id", "rate")


@query("WITH x AS (SELECT user_id, event_id, event_id % 3 AS len, event_id AS off FROM events), b AS (SELECT *, CASE WHEN lag(off + len) OVER w IS NOT DISTINCT FROM off THEN 0 ELSE 1 END AS n FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, sum(n) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM b")
def sequential_reads(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("u"), "event_id", F.col("event_id").alias("off"), (F.col("event_id") % 3).alias("len"))
    return stats.sequential_reads(e, ["u"], ["event_id"], "off", "len").select("event_id", "run")


@query("SELECT l_suppkey, floor(quantile_cont(floor(l_extendedprice)::BIGINT, 0.5))::BIGINT AS median FROM lineitem GROUP BY 1")
def group_median(spark, d):
    return stats.group_median(table(spark, d, "lineitem").select("l_suppkey", F.floor("l_extendedprice").cast("long").alias("v")), ["l_suppkey"], "v")


@query(
    "WITH x AS (SELECT c_nationkey AS k, c_custkey AS id, floor(c_acctbal)::BIGINT AS v FROM customer), m AS (SELECT k, floor(quantile_cont(v, 0.5))::BIGINT AS median FROM x GROUP BY 1) "
    "SELECT k, median, arg_min(id, (v, id)) FILTER (v < median) AS source, arg_max(id, (v, id)) FILTER (v > median) AS target FROM x JOIN m USING (k) GROUP BY k, median"
)
def median_candidates(spark, d):
    return stats.median_candidates(table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.floor("c_acctbal").cast("long").alias("v")), ["k"], "id", "v")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS members, count(DISTINCT l_suppkey) FILTER (l_returnflag <> 'R') AS alive FROM lineitem GROUP BY 1")
def distinct_alive(spark, d):
    return stats.distinct_alive(table(spark, d, "lineitem"), ["l_partkey"], "l_suppkey", F.col("l_returnflag") != "R")


STATE = "CASE o_orderstatus WHEN 'O' THEN 'ONLINE' WHEN 'P' THEN 'READONLY' ELSE 'FAULTED' END"


@query(f"SELECT o_custkey, CASE WHEN count(*) FILTER (s = 'FAULTED') = count(*) THEN 'FAULTED' WHEN count(*) FILTER (s <> 'ONLINE') > 0 THEN 'DEGRADED' ELSE 'ONLINE' END AS health FROM (SELECT o_custkey, {STATE} AS s FROM orders) GROUP BY 1")
def health_rollup(spark, d):
    return stats.health(table(spark, d, "orders").select("o_custkey", F.expr(STATE).alias("s")), ["o_custkey"], "s")


@query(f"SELECT capacity, used, objects, capacity - used AS available, (100 * used) // capacity AS utilisation FROM (SELECT sum(2 * o_orderkey + 5)::BIGINT AS capacity, sum(o_orderkey)::BIGINT AS used, sum(o_custkey)::BIGINT AS objects FROM orders WHERE {STATE} = 'ONLINE')")
def cluster_summary(spark, d):
    o = table(spark, d, "orders").select((2 * F.col("o_orderkey") + 5).alias("cap"), F.col("o_orderkey").alias("u"), F.col("o_custkey").alias("n"), F.expr(STATE).alias("s"))
    return stats.cluster_summary(o, "cap", "u", "n", "s")


@query("SELECT l_linenumber, round(avg(100.0::DOUBLE * l_quantity / 60), 4) AS mean_pct, round(stddev_pop(100.0::DOUBLE * l_quantity / 60), 4) AS std_pct, count(*) AS devices FROM lineitem GROUP BY 1")
def util_spread(spark, d):
    return stats.utilisation_spread(table(spark, d, "lineitem").withColumn("cap", F.lit(60)), ["l_linenumber"], "l_quantity", "cap")


@query("SELECT l_partkey, least(count(DISTINCT l_suppkey), 3) AS replicas FROM lineitem GROUP BY 1")
def replica_count(spark, d):
    return stats.replica_count(table(spark, d, "lineitem"), ["l_partkey"], "l_suppkey", 3)


@query("SELECT floor(avg(v))::BIGINT AS average, count(*) AS hosts FROM (SELECT user_id, arg_min(floor(value)::BIGINT, event_id) AS v FROM events GROUP BY 1)")
def host_average(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("v"))
    return stats.host_average(e, "user_id", ["event_id"], "v")


@query(
    "SELECT c_custkey, CASE WHEN ts IS NULL OR ts < 900000000 - 20000000 THEN 'FAULTED' WHEN st = 1 THEN 'ONLINE' WHEN st = 2 THEN 'READONLY' ELSE 'FAULTED' END AS state "
    "FROM customer LEFT JOIN (SELECT o_custkey, max(epoch_us(o_orderdate) // 1000000) AS ts, max(o_orderkey) % 3 AS st FROM orders GROUP BY 1) ON o_custkey = c_custkey"
)
def device_states(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(S.epoch_s(F.col("o_orderdate"))).alias("ts"), (F.max("o_orderkey") % 3).alias("state"))
    return stats.device_states(table(spark, d, "customer").select("c_custkey"), s, ["c_custkey"], 900_000_000, 20_000_000)


@query("SELECT s_suppkey AS server, (s_suppkey % 16)::INT AS row, s_nationkey::BIGINT AS mb FROM supplier UNION ALL SELECT s_suppkey, (s_suppkey % 7 + 16)::INT, 5 FROM supplier")
def row_usage(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("server"), F.expr("concat(s_suppkey % 16, '#', s_nationkey, '^', s_suppkey % 7 + 16, '#5^')").alias("l"))
    return stats.row_usage(s, "server", "l")


# --- scalars ---


@query("SELECT page_id, translate(html, '<>', '[]') AS clean FROM pages")
def sanitize(spark, d):
    return table(spark, d, "pages").select("page_id", S.sanitize(F.col("html")).alias("clean"))


SQL["sanitize_all"], QUERIES["sanitize_all"] = SQL["sanitize"], sanitize


@query("SELECT p_partkey, (p_size * power(1024, p_partkey % 5))::BIGINT AS bytes FROM part")
def size_parse(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ["", "K", "M", "G", "T"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", S.size_bytes(F.concat(F.col("p_size").cast("string"), F.lit(" "), unit)).alias("bytes"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size::BIGINT ELSE 0 END AS n FROM part")
def cast_prefix_int(spark, d):
    s = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("kg"))).otherwise(F.concat(F.lit("x"), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", S.cast_prefix_int(s).alias("n"))


@query("SELECT p_partkey, s AS \"start\", least(e, 99) AS \"end\" FROM (SELECT p_partkey, p_size * 3 AS s, p_size * 4 AS e FROM part) WHERE s < 100 UNION ALL SELECT p_partkey, greatest(100 - p_size, 0), 99 FROM part WHERE p_size > 0")
def range_header(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("concat('bytes=', p_size * 3, '-', p_size * 4, ',-', p_size)").alias("h"))
    return p.select("p_partkey", F.explode(S.range_header(F.col("h"), F.lit(100))).alias("r")).select("p_partkey", F.col("r.start").cast("int").alias("start"), F.col("r.end").cast("int").alias("end"))


@query("SELECT page_id, split_part(replace(url, 'http://', ''), '/', 1) AS host, regexp_extract(url, 'utm_source=(\\w+)', 1) AS utm FROM pages")
def regex_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.split_part(F.replace("url", F.lit("http://"), F.lit("")), F.lit("/"), F.lit(1)).alias("host"), F.regexp_extract("url", r"utm_source=(\w+)", 1).alias("utm"))


@query("SELECT event_id, (epoch_us(ts) // 1000000) - (epoch_us(ts) // 1000000) % 10 AS batch FROM events")
def batch_floor(spark, d):
    return table(spark, d, "events").select("event_id", S.batch_floor(S.epoch_s(F.col("ts")), 10).alias("batch"))


@query("SELECT event_id, strftime(make_timestamp((epoch_us(ts) // 1000000) * 1000000), '%Y-%m-%d %H:%M:%S') AS t FROM events")
def epoch_text(spark, d):
    s = S.epoch_s(F.col("ts"))
    return table(spark, d, "events").select("event_id", S.epoch_autodetect(F.when(F.col("event_id") % 2 == 0, s * 1000).otherwise(s)).alias("t"))


@query("SELECT o_orderkey, floor(o_totalprice)::BIGINT // ceil(o_custkey % 50000 / 4096.0 + 0.5)::BIGINT AS lat FROM orders")
def normalised_latency(spark, d):
    size = (F.col("o_custkey") % 50000) + 2048
    return table(spark, d, "orders").select("o_orderkey", S.normalised_latency(F.floor("o_totalprice").cast("long"), size, 4096).alias("lat"))


@query("SELECT event_id, regexp_extract(props, '\"k\": (\\d+)', 1)::BIGINT AS k FROM events")
def json_path(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT sum(CASE WHEN contains(text, 'than the') THEN 1 ELSE 0 END)::BIGINT AS hits, count(*) AS lines FROM documents")
def substring_scan(spark, d):
    return table(spark, d, "documents").agg(F.sum(F.contains("text", F.lit("than the")).cast("long")).alias("hits"), F.count("*").alias("lines"))
