"""Queries that give the SQL's rows on groups and values of any size."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestream.plans import more  # noqa: F401  registers its queries
from lodestream.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def big_groups(spark, tmp_path_factory):
    """Hours of 700 users, one group without any."""
    d = str(tmp_path_factory.mktemp("events"))
    e = spark.range(6000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 2 * 3600).alias("ts"), F.when(F.col("id") % 3 < 2, F.col("id") * 31 % 701).alias("user_id"),
        F.element_at(F.array(*map(F.lit, ("view", "click", "none"))), (F.col("id") % 3 + 1).cast("int")).alias("event_type"), (F.col("id") % 90).cast("double").alias("value"),
    )
    e.write.parquet(f"{d}/events.parquet")
    return d


def same_as_sql(spark, name, d, table):
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, d)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) and want


def test_large_sets_are_counted(spark, big_groups):
    same_as_sql(spark, "set_cardinality", big_groups, "events")


def test_large_sets_are_flushed(spark, big_groups):
    same_as_sql(spark, "set_flush", big_groups, "events")


def test_long_texts_as_base64(spark, tmp_path):
    urls = ["", "http://a.example", "x" * 57, "x" * 58, "ü" * 400, None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    same_as_sql(spark, "base64_text", str(tmp_path), "pages")
