"""Work dealt by ranges of a key, with enough rows and small enough shuffle partitions that each place would join them in its own way."""

import bisect

import pytest
from pyspark.sql import functions as F

from lodestream.operators import content, index
from lodestream.operators.rows import range_of


@pytest.fixture()
def small_partitions(spark):
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_ring_of_many_keys(small_partitions):
    spark = small_partitions
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "500k")
    keys = spark.range(300_000).select("id", (F.col("id") * 40503 % 1_000_003).alias("h"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    ring = spark.range(700).select((F.col("id") * 2654435761 % 900_007).alias("pos"), F.concat(F.lit("s"), "id").alias("server"))
    at = sorted((i * 2654435761 % 900_007, f"s{i}") for i in range(700))
    positions = [p for p, _ in at]
    extra = spark.createDataFrame([(-1, None, "x")], keys.schema), spark.createDataFrame([(None, "lost")], ring.schema)
    got = content.ring_owner(keys.unionByName(extra[0]), ring.unionByName(extra[1]), "h").select("id", "server").collect()
    assert len(got) == 300_001
    own = {r["id"]: r["server"] for r in got}
    assert own.pop(-1) == at[0][1]
    assert all(own[i] == at[bisect.bisect_left(positions, i * 40503 % 1_000_003) % 700][1] for i in range(300_000))


def test_pages_of_many_keys(small_partitions):
    df = small_partitions.range(300_000).select(F.format_string("key%06d", F.col("id") * 7919 % 300_007).alias("key"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    keys = sorted(f"key{i * 7919 % 300_007:06d}" for i in range(300_000))
    got = index.pages(df, "key", 1000)
    got = got.groupBy("key", "page").agg(F.max("wide")).collect()
    assert len(got) == 300_000
    assert sorted((r["key"], r["page"]) for r in got) == [(k, i // 1000) for i, k in enumerate(keys)]


def test_null_keys_come_last(spark):
    df = spark.createDataFrame([(None,), ("a",), ("b",), (None,)], "key string")
    assert {(r["key"], r["page"]) for r in index.pages(df, "key", 2).collect()} == {("a", 0), ("b", 0), (None, 1)}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ranges_go_up_with_the_key(small_partitions, kind):
    spark = small_partitions
    df = spark.range(5000).select(F.when(F.col("id") % 100 > 0, F.col("id") * 7919 % 5003).cast(kind).alias("k"))
    got = {(r["k"], r["p"]) for r in df.select("k", range_of(df, "k", 50).alias("p")).collect()}
    assert (None, None) in got
    got = sorted(x for x in got if x[0] is not None)
    assert len({k for k, _ in got}) == len(got) and [p for _, p in got] == sorted(p for _, p in got)
    assert {p for _, p in got} == set(range(16))
    one = df.where("k IS NULL")
    assert {r["p"] for r in one.select(range_of(one, "k").alias("p")).collect()} == {None}
