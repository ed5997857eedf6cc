"""Text and binary sources of metric samples and key/value pairs, as transformations of what Spark has read."""

from __future__ import annotations

import configparser
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lenient_decimal, metric_name

# fixed values: first letter of a sample's type
TYPES = {"c": "counter", "m": "timer", "k": "kv", "g": "gauge", "s": "set", "z": "control"}


def parse_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """name:value|type[|@rate] lines: name, value (text), number, type, rate, is_delta. Lines of unknown type or form are left out."""
    m = lambda i: F.regexp_extract(line, r"^([^:|]+):([^|]*)\|([a-z]+)(?:\|@([0-9.]+))?\s*$", i)
    kind = F.substring(m(3), 1, 1)
    out = df.select("*", metric_name(m(1)).alias("name"), m(2).alias("text"), kind.alias("type"), m(4).alias("_rate")).where(F.col("type").isin(*TYPES) & (F.col("name") != ""))
    rate = F.coalesce(F.col("_rate").try_cast("double"), F.lit(1.0))
    return out.withColumn("value_number", lenient_decimal(F.regexp_replace("text", r"^\+", ""))).withColumn("rate", rate).withColumn("is_delta", (F.col("type") == "g") & F.col("text").rlike(r"^[+-]")).drop("_rate")


def parse_finished(df: DataFrame, line: str = "value") -> DataFrame:
    """type.name|value|seconds lines of finished values, such as another aggregator publishes."""
    p = F.split(line, r"\|")
    key = F.get(p, F.lit(0))
    rows = df.select(F.split_part(key, F.lit("."), F.lit(1)).alias("type"), F.regexp_replace(key, r"^[^.]*\.", "").alias("name"), F.get(p, F.lit(1)).try_cast("double").alias("value"), F.get(p, F.lit(2)).try_cast("long").alias("ts"))
    return rows.where(F.col("value").isNotNull() & F.col("ts").isNotNull())


def topic(df: DataFrame, prefix: str, metric: str = "name") -> DataFrame:
    return df.where(F.col(metric).startswith(prefix))


def stats_lines(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """Lines of a text file that hold a text."""
    return spark.read.text(path).where(F.contains("value", F.lit(wanted)))


# --- binary records: magic, type, name length (u16), then a double, or for sets a member's length (u16), name, member ---

MAGIC, BINARY_TYPES = 0xAA, "kctgs"


def encode_binary(name: str, kind: str, value) -> bytes:
    key = name.encode()
    head = struct.pack("<BBH", MAGIC, BINARY_TYPES.index(kind), len(key))
    if kind == "s":
        member = str(value).encode()
        return head + struct.pack("<H", len(member)) + key + member
    return head + struct.pack("<d", value) + key


def decode_binary(blob: bytes) -> list[tuple[str, str, float | None, str | None]]:
    out, at = [], 0
    while at + 4 <= len(blob):
        magic, kind, n = struct.unpack_from("<BBH", blob, at)
        if magic != MAGIC or kind >= len(BINARY_TYPES):
            break
        t = BINARY_TYPES[kind]
        size = 2 if t == "s" else 8
        if at + 4 + size > len(blob):
            break
        (v,) = struct.unpack_from("<H" if t == "s" else "<d", blob, at + 4)
        at += 4 + size
        end = at + n + (v if t == "s" else 0)
        if end > len(blob):
            break
        name = blob[at : at + n].decode("utf-8", "replace")
        out.append((name, t, None if t == "s" else v, blob[at + n : end].decode("utf-8", "replace") if t == "s" else None))
        at = end
    return out


def parse_binary(df: DataFrame, column: str = "content") -> DataFrame:
    """Blobs of binary records (of the binaryFile source, say) to name, type, value, member. A broken rest is left out."""
    schema = "name string, type string, value double, member string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows = [r for b in rb.column(column).to_pylist() for r in decode_binary(b or b"")]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["name", "type", "value", "member"])

    return df.select(column).mapInArrow(run, schema)


def is_binary(blob: Column) -> Column:
    return F.hex(F.substring(blob, 1, 1)) == "AA"


# --- key/value bodies ---


def kv_csv(df: DataFrame, body: str = "value") -> DataFrame:
    """key;value lines; lines without a semicolon are left out."""
    line = F.explode(F.split(body, "\n")).alias("_l")
    return df.select(line).where(F.contains("_l", F.lit(";"))).select(F.split_part("_l", F.lit(";"), F.lit(1)).alias("key"), F.regexp_replace("_l", "^[^;]*;", "").alias("value"))


def kv_json(df: DataFrame, body: str = "value") -> DataFrame:
    return df.select(F.explode(F.from_json(body, "map<string,string>")).alias("key", "value"))


def checkpoint_devices(spark: SparkSession, path: str) -> DataFrame:
    """{"vdevlist": [{"serverid": .., "vdevid": ..}]} files to rows."""
    return spark.read.schema("vdevlist array<struct<serverid:string,vdevid:string>>").json(path, multiLine=True).select(F.explode("vdevlist").alias("d")).select("d.*")


def histogram_config(text: str) -> list[tuple[str, float, float, float]]:
    """Sections named histogram* of an INI text: (prefix, min, max, width). More than 1024 bins is an error."""
    c = configparser.ConfigParser(strict=False)
    c.read_string(text)
    out = []
    for s in c.sections():
        if s.startswith("histogram"):
            lo, hi, width = (c.getfloat(s, k) for k in ("min", "max", "width"))
            if int((hi - lo) / width) + 2 > 1024:
                raise ValueError(f"{s}: too many bins")
            out.append((c.get(s, "prefix", fallback=""), lo, hi, width))
    return out
