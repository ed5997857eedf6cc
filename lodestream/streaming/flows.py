"""The same operators on streams: flush windows, de-duplicated change logs, applied listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import txlog
from ..operators.rows import pick
from ..session import stored


def flush(samples: DataFrame, window: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """Counter aggregates of (ts, name, value), one row for each window and name once the watermark has passed it."""
    v = F.col("value")
    w = samples.withWatermark("ts", late).groupBy(F.window("ts", window), "name")
    return w.agg(F.count(v).alias("cnt"), F.sum(v).alias("total"), F.sum(v * v).alias("sum_sq"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev")).select(
        F.col("window.end").alias("flushed"), "name", "cnt", "total", "sum_sq", "lo", "hi", "stdev"
    )


def deduplicated(log: DataFrame, identity: list[str], horizon: str = "640 seconds") -> DataFrame:
    """Rows seen for the first time within the horizon; state older than that is dropped."""
    return log.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(identity)


def applied(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps a listing table, <path>/v<batch>, in step with the log.

    Each batch reads the version before it and writes its own, so a batch that runs again gives the same table.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = None
        for k in range(number - 1, -1, -1):
            try:
                old = spark.read.parquet(f"{path}/v{k}")
                break
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        rows = batch if old is None else old.unionByName(batch)
        # deletions stay in the table until a later batch could no longer meet an older row of theirs
        stored(pick(rows, keys, order).select(*batch.columns), f"{path}/v{number}", spark)

    return write


def listing(df: DataFrame) -> DataFrame:
    """The rows of an applied table that are there."""
    return df.where(~txlog.kind_is(txlog.DELETE | txlog.EXPUNGE))
