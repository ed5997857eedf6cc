import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestream.functions import scalars as S
from lodestream.operators import content, index, metrics, stats, txlog, versions
from lodestream.sources import lines, sinks
from lodestream.streaming import flows

SAMPLES = """count1:123|c
count1:1|c
count1:1|c
count2:125|c
ns.count2:-1|c
speed:10|g
ns.request:2400|ms
ns.bk1.create:obj4|s
ns.bk1.create:obj5|s
ns.bk1.create:obj6|s
ns.bk1:1|k
bad line
x:1|q""".split("\n") + [f"ns.count3:{i}|c|@0.80" for i in range(10)]


@pytest.fixture(scope="module")
def parsed(spark):
    return lines.parse_lines(spark.createDataFrame([(x, i) for i, x in enumerate(SAMPLES)], "value string, seq int"))


def test_lines_to_counters(parsed):
    c = metrics.scale_samples(parsed.drop("value").withColumnRenamed("value_number", "value").where("type = 'c'"))
    got = {r["name"]: r for r in metrics.counters(c, ["name"]).collect()}
    assert (got["count1"]["cnt"], got["count1"]["total"], got["count1"]["sum_sq"], got["count1"]["lo"], got["count1"]["hi"]) == (3, 125.0, 15131.0, 1.0, 123.0)
    assert got["count1"]["mean"] == pytest.approx(41.6667) and got["count1"]["stdev"] == pytest.approx(70.4367)
    assert got["count2"]["stdev"] == 0.0 and got["ns.count2"]["total"] == -1.0
    assert got["ns.count3"]["total"] == 56.25 and got["ns.count3"]["sum_sq"] == 445.3125
    assert parsed.count() == len(SAMPLES) - 2


def test_sets_timers_and_lines(parsed, spark):
    sets = metrics.set_cardinality(parsed.where("type = 's'"), ["name"], "text").collect()
    assert [(r["name"], r["members"]) for r in sets] == [("ns.bk1.create", 3)]
    t = parsed.where("type = 'm'").drop("value").withColumnRenamed("value_number", "value")
    q = metrics.quantiles_exact(t, ["name"]).first()
    assert q["p50"] == q["p95"] == q["p99"] == 2400.0
    flushed = metrics.flush_lines(spark.createDataFrame([(7, "count1", 125.0)], "w long, name string, total double"))
    assert flushed.first()[0] == "counts.count1|125.000000|7"
    both = metrics.counters(t, ["name"]).join(metrics.quantiles_exact(t, ["name"]).drop("cnt"), "name").withColumn("w", F.lit(7))
    got = {r[0] for r in metrics.timer_lines(both).collect()}
    assert len(got) == 10 and "timers.ns.request.p95|2400.000000|7" in got


def test_large_sets_are_estimated(spark):
    s = spark.range(5000).select(F.lit("a").alias("name"), F.col("id").alias("m"))
    assert abs(metrics.set_cardinality(s, ["name"], "m").first()["members"] - 5000) < 500


def test_histogram_tail_and_prefixes(spark):
    s = spark.createDataFrame([("a", v) for v in (-1.0, 0.0, 29.9, 30.0, 89.0, 95.0, 100.0)], "name string, value double")
    assert [r["cnt"] for r in metrics.histogram(s, ["name"], 0, 100, 30).orderBy("bin").collect()] == [1, 2, 1, 1, 2]
    conf = lines.histogram_config("[histogram1]\nprefix=api\nmin=0\nmax=100\nwidth=5\n[histogram2]\nmin=0\nmax=200\nwidth=20\n[net]\nx=1\n")
    assert conf == [("api", 0.0, 100.0, 5.0), ("", 0.0, 200.0, 20.0)]
    got = metrics.longest_prefix(spark.createDataFrame([("api.x",), ("b",)], "name string"), spark.createDataFrame(conf, "prefix string, lo double, hi double, width double"))
    assert {(r["name"], r["prefix"]) for r in got.collect()} == {("api.x", "api"), ("b", "")}
    with pytest.raises(ValueError):
        lines.histogram_config("[histogram]\nmin=0\nmax=9000\nwidth=1\n")


@pytest.mark.parametrize("seed", range(4))
def test_gauge_delta_folds_in_order(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("ab"), i, float(r.randint(-9, 9)), r.random() < 0.6) for i in range(60)]
    want = {}
    for name, _, v, d in rows:
        want[name] = want.get(name, 0.0) + v if d else v
    got = metrics.gauge_delta(spark.createDataFrame(rows, "name string, seq int, value double, is_delta boolean"), ["name"], ["seq"])
    assert {x["name"]: x["value"] for x in got.collect()} == want


def test_binary_records(spark):
    recs = [("a", "c", 1.5), ("set", "s", "member"), ("g", "g", -2.0)]
    blob = b"".join(lines.encode_binary(*r) for r in recs)
    got = lines.parse_binary(spark.createDataFrame([(bytearray(blob + b"\xaa\x01"),), (bytearray(b"plain"),), (None,)], "content binary")).collect()
    assert [tuple(r) for r in got] == [("a", "c", 1.5, None), ("set", "s", None, "member"), ("g", "g", -2.0, None)]
    assert spark.createDataFrame([(bytearray(blob),)], "b binary").select(lines.is_binary(F.col("b"))).first()[0]


def test_key_value_bodies(spark):
    assert {tuple(r) for r in lines.kv_csv(spark.createDataFrame([("a;1\nnothing\nb;2;3",)], "value string")).collect()} == {("a", "1"), ("b", "2;3")}
    assert {tuple(r) for r in lines.kv_json(spark.createDataFrame([('{"k":"v","n":1}',), ("broken",)], "value string")).collect()} == {("k", "v"), ("n", "1")}
    page = spark.createDataFrame([("b", "x,y"), ("a", "plain"), ("c", 'say ""')], "key string, value string")
    assert {r[0] for r in sinks.kv_lines(page, "key", "value").collect()} == {'b;"x,y"', "a;plain", 'c;"say """'}
    assert sinks.kv_document(page, "key", "value").first()[0].startswith('{"a":"plain","b":"x,y"')
    assert sinks.kv_document(page, "key", "value", False).first()[0] == '["a","b","c"]'


def test_finished_lines_and_graphite(spark):
    df = spark.createDataFrame([("counts.a.b|2.5|7",), ("gauges.x|oops|1",)], "value string")
    rows = lines.parse_finished(df)
    assert [tuple(r) for r in rows.collect()] == [("counts", "a.b", 2.5, 7)]
    assert sinks.graphite(rows, "p").first()[0] == "p.a.b 2.500000 7"


def test_pages_see_every_key_once(spark):
    df = spark.range(2500).select(F.format_string("key%05d", F.col("id")).alias("key")).repartition(7)
    got = index.pages(df, "key", 100).groupBy("page").agg(F.count("*").alias("n"), F.min("key").alias("k")).orderBy("page").collect()
    assert [(r["page"], r["n"], r["k"]) for r in got] == [(i, 100, f"key{i * 100:05d}") for i in range(25)]


def test_overlay_cases(spark):
    base = spark.createDataFrame([("b", "1"), ("d", "2"), ("f", "3")], "k string, v string")
    changes = spark.createDataFrame([("a", "x", "PUT"), ("b", "y", "PUT"), ("d", None, "DEL"), ("z", None, "DEL")], "k string, v string, action string")
    assert {tuple(r) for r in index.overlay(base, changes, "k", "v").collect()} == {("a", "x"), ("b", "y"), ("f", "3")}
    assert {tuple(r) for r in index.overlay(base, changes, "k", "v", "base").collect()} == {("a", "x"), ("b", "1"), ("f", "3")}


def test_merge_and_marker(spark):
    a, b = (spark.createDataFrame([(k, n) for k in ks], "k long, v string") for ks, n in (((5, 3, 1), "a"), ((6, 4, 2, 3), "b")))
    assert [tuple(r) for r in index.kway_merge([a, b], "k", "v").orderBy("k").collect()] == [(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "a"), (6, "b")]
    users = spark.range(100).select(F.format_string("user%05d", F.col("id")).alias("k"))
    assert [r[0] for r in index.range_page(users, "k", "user00004", "user00007", 5).collect()] == ["user00005", "user00006", "user00007"]
    assert index.range_page(users, "k", "user00004", None, 5, inclusive=True).first()[0] == "user00004"
    assert index.prefix_scan(users, "k", "user0009", "user00095").count() == 5
    assert index.prefix_scan(users, "k", "user0008", strict=False).count() == 20
    assert index.service_objects(users, "k", "user0000", 1).count() == 0


def test_signs(spark):
    ok = spark.createDataFrame([(1, 2), (0, 0), (-1, -3)], "a int, b int")
    assert index.check_signs(ok, ["a", "b"]).count() == 3
    with pytest.raises(Exception, match="both signs"):
        index.check_signs(spark.createDataFrame([(1, -2)], "a int, b int"), ["a", "b"]).collect()


def test_log_keys_round_trip(spark):
    row = {c: i if c in txlog.NUMBERS | txlog.INTS else f"t{i}" for i, c in enumerate(txlog.KEY_FIELDS)} | {"etag": "", "owner": None}
    schema = ", ".join(f"{c} {'long' if c in txlog.NUMBERS else 'int' if c in txlog.INTS else 'string'}" for c in txlog.KEY_FIELDS)
    got = spark.createDataFrame([row], schema).select(txlog.encode_key().alias("k")).select(*txlog.decode_key(F.col("k"))).first().asDict()
    assert got == row | {"owner": ""}


@pytest.mark.parametrize("seed", range(3))
def test_clamped_rollup(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("ab"), i, r.choice([1, 2, 4]), r.randint(-20, 20)) for i in range(50)]
    want = {}
    for b, _, t, d in rows:
        size, n = want.get(b, (0, 0))
        if t & 2:
            size = size if -d > size else max(size + d, 0)
            n = max(n - 1, 0)
        else:
            size, n = max(size + d, 0), n + (t & 1)
        want[b] = (size, n)
    got = txlog.clamped_rollup(spark.createDataFrame(rows, "b string, seq int, trtype int, deltasize long"), ["b"], ["seq"])
    assert {x["b"]: (x["size"], x["objects"]) for x in got.collect()} == want


def test_log_filters(spark):
    log = spark.createDataFrame([(1, 4, "a"), (50, 4, "TRLOG-x"), (95, 4, None), (95, 0x1004, "a")], "timestamp long, trtype int, tid string")
    assert sorted(r["timestamp"] for r in txlog.cut_off(log, 100, 10).collect()) == [1, 50, 95]
    assert log.where(txlog.namespace_is(tid="a")).count() == 3
    assert log.where(txlog.user_tenants(F.col("tid"))).count() == 2


def test_versions(spark):
    v = spark.createDataFrame([("o", 1, 10, 5), ("o", 2, 20, 7), ("o", -3, 30, 0), ("p", 1, 5, 2)], "object string, generation long, uvid_ts long, size long")
    assert {(r["object"], r["generation"]) for r in versions.latest(v, ["object"]).collect()} == {("p", 1)}
    assert {(r["object"], r["generation"]) for r in versions.as_of(v, ["object"], 25).collect()} == {("o", 2), ("p", 1)}
    c = versions.clone(v, ["object"], {"object": "o"}, {"object": "copy"}, 2).first()
    assert (c["object"], c["generation"], c["size"]) == ("copy", 1, 7)
    e = versions.expunge(v, v.where("object = 'o' AND generation = -3"), ["object"]).first()
    assert (e["expunged"], e["generation"], e["deltasize"]) == (-3, 2, 7)
    entries = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (1, "b", 9)], "parent long, name string, child long")
    assert versions.resolve_path(entries, "/a/b", 1).first()[0] == 3 and versions.resolve_path(entries, "/a/x", 1).count() == 0


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.uri_escape(F.lit("a b+c~*/é"))) == "a%20b%2Bc~%2A%2F%C3%A9" and one(S.uri_escape(F.lit("a/b"), True)) == "a/b"
    assert one(S.uri_unescape(F.lit("a+b%20c"))) == "a+b c" and one(S.uri_unescape(F.lit("a%00"))) is None
    assert one(S.cast_prefix_int(F.lit(" -12ab"))) == -12 and one(S.cast_prefix_int(F.lit("x"))) == 0
    assert one(S.as_uint8(F.lit(200))) == 200 and one(S.as_uint8(F.lit(200), True)) == -56
    assert one(S.lenient_decimal(F.lit("-1.5e3"))) == -1.5 and one(S.lenient_decimal(F.lit("q"))) == 0.0
    assert [tuple(r) for r in one(S.range_header(F.lit("bytes=0-4, 90-200,-3,500-,7-"), F.lit(100)))] == [(0, 4), (90, 99), (97, 99), (7, 99)]
    assert one(S.used_factor(F.lit(3), F.lit(True), F.lit(4 * 256 + 2))) == 1.5 and one(S.used_factor(F.lit(3), F.lit(False), F.lit(1026))) == 3.0
    assert one(S.blake2b_256(F.lit("abc"))) == __import__("hashlib").blake2b(b"abc", digest_size=32).hexdigest()
    assert one(S.size_bytes(F.lit("1.5 GB"))) == int(1.5 * 1024**3) and one(S.size_bytes(F.lit("x"))) is None
    assert one(S.bucket_of_host(F.lit("b.s3.org"), F.lit("/k"), "s3.org")) == "b" and one(S.bucket_of_host(F.lit("s3.org"), F.lit("/bk/k"), "s3.org")) == "bk"
    assert one(S.param_int(S.query_map(F.lit("a=1&b=x")), "a", 5)) == 1 and one(S.param_int(S.query_map(F.lit("a=1&b=x")), "b", 5)) == 5


def test_stats(spark):
    s = spark.range(2).select(F.lit("a").alias("k"), F.col("id"), F.lit(64).alias("v"))
    assert [r["mean64"] for r in stats.moving_average(s, ["k"], ["id"], "v").orderBy("id").collect()] == [1, 2]
    m = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 1), ("b", 2), ("b", 3), ("b", 4)], "k string, v long")
    assert {r["k"]: r["median"] for r in stats.group_median(m, ["k"], "v").collect()} == {"a": 2, "b": 2}
    h = spark.createDataFrame([("x", "FAULTED"), ("x", "FAULTED"), ("y", "ONLINE"), ("y", "READONLY"), ("z", "ONLINE")], "s string, st string")
    assert {r["s"]: r["health"] for r in stats.health(h, ["s"], "st").collect()} == {"x": "FAULTED", "y": "DEGRADED", "z": "ONLINE"}


@pytest.mark.parametrize("seed", range(3))
def test_ring(spark, seed):
    r = random.Random(seed)
    ring = sorted((r.randrange(1 << 32), f"s{i}") for i in range(r.choice([1, 5, 40])))
    keys = [r.randrange(1 << 32) for _ in range(200)]
    want = {k: next((s for p, s in ring if p >= k), ring[0][1]) for k in keys}
    got = content.ring_owner(spark.createDataFrame([(k,) for k in keys], "h long"), spark.createDataFrame(ring, "pos long, server string"), "h")
    assert {x["h"]: x["server"] for x in got.collect()} == want


def test_stream_flush_equals_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(seconds=i), "ab"[i % 2], float(i)) for i in range(100)] + [(t0 + timedelta(days=1), "end", 0.0)]
    spark.createDataFrame(rows, "ts timestamp, name string, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, name string, value double").parquet(f"{tmp_path}/in")
    q = flows.flush(stream).writeStream.format("memory").queryName("flushed").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["flushed"], r["name"], r["cnt"], r["total"]) for r in spark.table("flushed").collect()}
    batch = spark.read.parquet(f"{tmp_path}/in").where("name <> 'end'").groupBy(F.window("ts", "10 seconds"), "name").agg(F.count("*").alias("cnt"), F.sum("value").alias("total"))
    assert got == {(r["window"]["end"], r["name"], r["cnt"], r["total"]) for r in batch.collect()} and len(got) == 20


def test_stream_log_is_applied_once(spark, tmp_path):
    schema = "ts timestamp, phid string, generation long, trtype int"
    t0 = datetime(2024, 1, 1)
    first = [(t0, "a", 1, 1), (t0, "a", 1, 1), (t0, "b", 1, 1)]
    second = [(t0 + timedelta(seconds=5), "a", 2, 2), (t0 + timedelta(seconds=5), "c", 1, 1), (t0, "b", 1, 1)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = flows.deduplicated(stream, ["phid", "generation"]).writeStream.foreachBatch(flows.applied(f"{tmp_path}/t", ["phid"], ["generation"])).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    last = max(p.name for p in (tmp_path / "t").iterdir())
    assert {r["phid"] for r in flows.listing(spark.read.parquet(f"{tmp_path}/t/{last}")).collect()} == {"b", "c"}


def test_sinks_each_writer_gets_every_row(spark, tmp_path):
    df = spark.createDataFrame([("x",), ("y",)], "value string")
    sinks.each(sinks.to_text(f"{tmp_path}/a"), sinks.to_text(f"{tmp_path}/b"), sinks.to_command(["sh", "-c", f"cat > {tmp_path}/c"]))(df, 0)
    assert {r[0] for r in spark.read.text(f"{tmp_path}/a/batch=0").collect()} == {r[0] for r in spark.read.text(f"{tmp_path}/b").select("value").collect()} == {"x", "y"}
    assert sorted((tmp_path / "c").read_text().split()) == ["x", "y"]


def test_whole_tables(spark):
    from lodestream.plans import queries

    d = "/root/testdata/sf0.001"
    got = {r["page_id"]: r["clean"] for r in queries.QUERIES["sanitize_all"](spark, d).collect()}
    assert got == {r["page_id"]: r["html"].replace("<", "[").replace(">", "]") for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    want = {}
    for r in queries.samples(spark, d).collect():
        want.setdefault((r["w"] // 86400, r["name"]), set()).add(r["user_id"])
    got = {(r["day"], r["name"]): r["members"] for r in queries.QUERIES["set_cardinality_all"](spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - len(v)) <= 0.1 * len(v) for k, v in want.items())


def test_clamped_rollup_gathers_no_bucket(spark):
    log = spark.range(20_000).selectExpr("if(id % 3 = 0, 'a', null) AS b", "id AS seq", "CAST(1 AS int) AS trtype", "if(id = 9, null, id % 5) AS deltasize")
    got = txlog.clamped_rollup(log, ["b"], ["seq"])
    assert "collect_list" not in got._jdf.queryExecution().toString()
    want = {b: (sum(i % 5 for i in range(20_000) if (i % 3 == 0) == (b == "a") and (b is None or i > 9)), sum((i % 3 == 0) == (b == "a") for i in range(20_000))) for b in ("a", None)}
    assert {r["b"]: (r["size"], r["objects"]) for r in got.collect()} == want


@pytest.mark.parametrize("name", ["latest_version", "snapshot_rollback", "version_expunge", "log_apply", "log_dedup", "gauge_last", "kway_merge"])
def test_latest_rows_are_hashed_and_not_sorted(spark, name):
    from lodestream.plans import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


@pytest.mark.parametrize("last", [True, False])
def test_picked_rows_are_whole(spark, last):
    from lodestream.operators.rows import pick

    r = random.Random(last)
    rows = [(r.choice([1, 2, None]), r.choice([-3, 0, 5, 1 << 60, None]), r.randint(-9, 9), k, str(k)) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, a long, b int, n long, t string").repartition(3)
    best = {}
    for k, a, b, *_ in rows:
        v = (-(1 << 62) if a is None else a, b)
        best[k] = v if k not in best else (max if last else min)(best[k], v)
    for d in (df, df.drop("t")):
        got = pick(d, ["k"], ["a", "b"], last).collect()
        assert {x["k"]: (-(1 << 62) if x["a"] is None else x["a"], x["b"]) for x in got} == best and len(got) == len(best)
        # every row is one of the input's
        assert all((x["k"], x["a"], x["b"], x["n"]) == rows[x["n"]][:4] for x in got)
    assert pick(df.where("false"), ["k"], ["a"]).count() == 0


def test_checksums_and_small_scalars(spark):
    one = spark.range(1).select(S.crc32c(F.lit(b"123456789")).alias("crc"), S.crc32c(F.lit(b"")).alias("empty"), S.compression_ratio(F.lit(b"a" * 1000)).alias("r"), S.is_zero_block(F.lit(bytes(8))).alias("z"), S.from_base64(F.lit("%%")).alias("bad")).first()
    assert one["crc"] == 0xE3069283 and one["empty"] == 0 and one["r"] < 0.1 and one["z"] and one["bad"] is None
    head, tail = S.split_at(F.col("t"), "::")
    got = spark.createDataFrame([("a::b::c",), ("abc",), ("::x",), (None,)], "t string").select(head.alias("h"), tail.alias("x")).collect()
    assert [tuple(r) for r in got] == [("a", "b::c"), ("abc", None), ("", "x"), (None, None)]


def test_ranges_of_objects(spark):
    texts = [(1, "abcdefghij" * 7), (2, "xy"), (3, ""), (4, None)]
    c = content.chunks(spark.createDataFrame(texts, "k long, t string"), "k", "t", 8)
    for at, n in ((0, 5), (6, 20), (8, 8), (60, 100), (90, 1)):
        got = {r["k"]: r["data"] for r in content.read_range(c, "k", "chunk_no", "chunk", "len", at, n).collect()}
        assert got == {k: t[at : at + n] for k, t in texts if t and t[at : at + n]}


def test_combinations_and_subsets(spark):
    import itertools

    df = spark.createDataFrame([(["a", "b", "c", "d"],), (["a"],), ([],)], "x array<string>")
    for k in (1, 2, 3):
        got = [r[0] for r in df.select(content.combinations(F.col("x"), k)).collect()]
        assert got == [[list(c) for c in itertools.combinations(r[0], k)] for r in df.collect()]
    assert [r[0] for r in df.select(content.is_subset(F.array(F.lit("a")), F.col("x"))).collect()] == [True, True, False]


def test_exact_quantiles_of_nulls_and_ties(spark):
    rows = [("a", float(v)) for v in [1] * 90 + [2] * 8 + [3] * 2] + [("a", None), ("b", None)]
    got = {r["name"]: tuple(r)[1:] for r in metrics.quantiles_exact(spark.createDataFrame(rows, "name string, value double"), ["name"]).collect()}
    assert got == {"a": (1.0, 2.0, 3.0, 101), "b": (None, None, None, 1)}


def test_keys_through_the_overlay(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("bc", "3"), ("c", "4")], "key string, value string")
    changes = spark.createDataFrame([("b", None, "DEL"), ("bd", "5", "PUT")], "key string, value string, action string")
    page = lambda **kw: [tuple(r) for r in index.overlay_scan(base, changes, "key", "value", "b", **kw).collect()]
    assert page(strict=True) == [("bc", "3"), ("bd", "5")] and page() == [("bc", "3"), ("bd", "5"), ("c", "4")] and page(limit=1) == [("bc", "3")]
    newer = index.overlay_put(changes, spark.createDataFrame([("b", "6", "PUT")], changes.schema), "key")
    assert index.overlay_find(base, newer, "key", "value", "b").first()["value"] == "6" and index.overlay_find(base, changes, "key", "value", "b").count() == 0


def test_names_that_evict_others(spark):
    rows = [("fam.x.1", 1.0, 1), ("fam.x.2", 2.0, 2), ("other.x.1", 3.0, 1), ("other.x.2", 4.0, 1)]
    got = {r["key"]: r["value"] for r in metrics.latest_values(spark.createDataFrame(rows, "name string, value double, ts long"), ["ts"], families=("fam.",)).collect()}
    assert got == {"fam.x": 2.0, "other.x.1": 3.0, "other.x.2": 4.0}
