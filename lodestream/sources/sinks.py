"""Sinks: formatters as columns, and writers for batches of a stream."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import index


def graphite(df: DataFrame, prefix: str) -> DataFrame:
    """prefix.name value seconds lines of rows (name, value, ts)."""
    return df.select(F.concat_ws(" ", F.concat(F.lit(prefix + "."), "name"), F.format_string("%.6f", F.col("value").cast("double")), F.col("ts").cast("string")).alias("value"))


def ascii_rows(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("|", "name", F.format_string("%.6f", F.col("value").cast("double")), F.col("ts").cast("string")).alias("value"))


def counters_wide(df: DataFrame) -> DataFrame:
    """Seven values for each counter, as the binary flush has them, where the text flush has the sum alone."""
    stats = ["cnt", "total", "sum_sq", "mean", "lo", "hi", "stdev"]
    return df.select("w", "name", *(F.col(c).cast("double").alias(c) for c in stats)).unpivot(["w", "name"], stats, "stat", "value")


def kv_lines(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(index.as_csv(key, value).alias("value"))


def kv_document(page: DataFrame, key: str, value: str, values: bool = True) -> DataFrame:
    """A page (of limited size) as one JSON text: an object with values, or an array of keys."""
    return page.agg((index.as_json(page, key, value) if values else F.to_json(F.array_sort(F.collect_list(key)))).alias("value"))


def each(*writers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every writer gets every row, from one computation."""

    def write(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for w in writers:
                w(df, batch)
        finally:
            df.unpersist()

    return write


def to_text(folder: str) -> Callable[[DataFrame, int], None]:
    """One folder for each batch, so a batch that runs again replaces its own output."""
    return lambda df, batch: df.write.mode("overwrite").text(f"{folder}/batch={batch}")


def to_command(command: list[str]) -> Callable[[DataFrame, int], None]:
    """Lines to a command's standard input, row by row from the driver: for the few lines of a flush."""

    def write(df: DataFrame, batch: int) -> None:
        with subprocess.Popen(command, stdin=subprocess.PIPE, text=True) as p:
            for r in df.toLocalIterator():
                p.stdin.write(r[0] + "\n")
            p.stdin.close()
        if p.returncode:
            raise RuntimeError(f"{command[0]} ended with {p.returncode}")

    return write


def bucket_xml(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("rootTag", "ListBucketResult").option("rowTag", "Contents").xml(path)


def stats_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def librato(df: DataFrame, source: str, most: int = 500) -> DataFrame:
    """Rows (name, value, ts) as request bodies of at most ``most`` gauges each, by ranges of name hashes."""
    gauge = F.struct("name", F.lit(source).alias("source"), F.col("value").cast("double").alias("value"), F.col("ts").alias("measure_time"))
    w = Window.partitionBy("ts", F.pmod(F.xxhash64("name"), F.lit(64)).alias("_b")).orderBy("name")
    chunked = df.withColumn("_b", F.pmod(F.xxhash64("name"), F.lit(64))).withColumn("_k", F.floor((F.row_number().over(w) - 1) / most))
    return chunked.groupBy("ts", "_b", "_k").agg(F.to_json(F.struct(F.array_sort(F.collect_list(gauge)).alias("gauges"))).alias("value")).select("value")


def ganglia(df: DataFrame, units: str = "units", tmax: int = 60, dmax: int = 0) -> DataFrame:
    """Rows (name, value) as the arguments of one metric command a line."""
    return df.select(F.concat(F.lit("--name="), "name", F.lit(" --value="), F.format_string("%.6f", F.col("value").cast("double")), F.lit(f" --type=double --units={units} --tmax={tmax} --dmax={dmax}")).alias("value"))


def octets(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values alone, as bytes, in order of their keys: what a client gets that asks for no form."""
    return df.orderBy(key).select(F.encode(F.col(value).cast("string"), "utf-8").alias("value"))
