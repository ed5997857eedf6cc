"""Session helpers shared by every operator: shipping the package, shared folders, table access."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


BATCH_BYTES, PLAN_TEXT = 8 << 20, 100_000


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each Spark application.

    The session's Arrow batches are cut to ``BATCH_BYTES`` where they may be larger: so many bytes, and not so many rows,
    are what a task holds on both sides, however long texts are. Texts of plans are cut to ``PLAN_TEXT`` characters.
    """
    sc = spark.sparkContext
    # plans hold tables as literals: their texts, which Spark keeps for its listeners, are cut
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.maxPlanStringLength", PLAN_TEXT)):
        if int(sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))) > most:
            spark.conf.set(name, str(most))
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables. Only Spark opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; where that is unset, below the warehouse, which executors share too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lodestream-shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. Survives the loss of any executor."""
    spark = spark or df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Let go of finished steps on the driver: plans that only cycles of Python objects hold, and then what the JVM
    holds for them. Spark's cleaner drops broadcasts and shuffles of data frames that are gone, on the executors too.
    What the driver's JVM has freed outside its heap (the compiler's memory, buffers) goes back to the system."""
    gc.collect()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    # the server's own class is hidden, so its interface is called
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    call = gateway.new_array(jvm.Object, 4)
    call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with contextlib.suppress(Py4JJavaError):  # not every JVM and C library can
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Hand at most this many rows at once to Python within the block: for rows that grow while they are worked on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def least_hashed(df: DataFrame, hashed: str, most: int) -> DataFrame:
    """About the ``most`` distinct rows with the least values of a 64-bit hash column (``most`` at the most).

    A range of hash values that holds about twice as many is cut out first, so a task sorts and sends only its
    share of the sample, however many tasks there are.
    """
    rows = df.count()
    if rows > 4 * most:
        df = df.where(f"`{hashed}` < {-(1 << 63) + (1 << 64) * 2 * most // rows}")
    return df.distinct().orderBy(hashed).limit(most)


def most_frequent(counts: DataFrame, column: str, most: int) -> DataFrame:
    """The rows with the greatest counts, as many whole eighths of an octave of the count as ``most`` rows hold.

    The least count is found from how many rows each level of count has, so that no rows are sorted or sent for it.
    """
    level = F.floor(8 * F.log2(column)).cast("int")
    left, least = most, None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("k"), F.min(column).alias("n")).orderBy(F.desc("level")).collect():
        left -= r["k"]
        if left < 0:
            break
        least = r["n"]
    return counts.where(F.lit(False) if least is None else F.col(column) >= least)
