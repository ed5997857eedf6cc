"""Change logs: de-duplication, cut-off, application to listings, roll-ups and search."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import pick

# fixed values: bits of a record's kind
CREATE, DELETE, UPDATE, SKIP_BTN, VERSION_EXPUNGE, EXPUNGE, ISGW = 1, 2, 4, 0x100, 0x200, 0x400, 0x1000
# fixed values: the fields of a text key, in order, joined by \1
KEY_FIELDS = [
    "phid", "nhid", "generation", "timestamp", "vmchid", "trtype", "deltasize", "cid", "tid", "bid", "oid", "size", "object_deleted", "multipart_size", "etag", "content_type", "serverid", "owner", "srcip",
]
NUMBERS = {"generation", "timestamp", "deltasize", "size", "multipart_size"}
INTS = {"trtype", "object_deleted"}
IDENTITY = KEY_FIELDS[:5]
SEP = "\x01"


def encode_key() -> Column:
    return F.concat_ws(SEP, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEY_FIELDS))


def decode_key(key: Column) -> list[Column]:
    """Columns of a text key. Empty fields stay in their place."""
    p = F.split(key, SEP)
    kind = lambda c: "long" if c in NUMBERS else "int" if c in INTS else "string"
    return [F.get(p, F.lit(i)).try_cast(kind(c)).alias(c) for i, c in enumerate(KEY_FIELDS)]


def dedup(log: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """One row for each identity, the first by order."""
    return pick(log, identity, order, last=False)


def not_processed(log: DataFrame, history: DataFrame, identity: list[str]) -> DataFrame:
    return log.join(history.select(*identity), identity, "left_anti")


def cut_off(log: DataFrame, batch: int, interval: int, quarantine: int = 1) -> DataFrame:
    """Rows old enough for this batch; those of remote sites always pass."""
    return log.where((F.col("timestamp") <= batch - quarantine * interval) | (F.col("trtype").bitwiseAND(ISGW) != 0))


def kind_is(mask: int) -> Column:
    return F.col("trtype").bitwiseAND(mask) != 0


def namespace_is(**levels: str) -> Column:
    """An empty level searches all; a record without the level passes."""
    c = F.lit(True)
    for name, want in levels.items():
        if want:
            c = c & (F.col(name).isNull() | (F.col(name) == want))
    return c


def user_tenants(tid: Column) -> Column:
    return ~tid.startswith("TRLOG-") & ~tid.isin("admin", "svcs")


def apply(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest state of each key: inserts and updates overwrite, deletes and expunges remove."""
    return pick(log, keys, order).where(~kind_is(DELETE | EXPUNGE))


def delta_rollup(log: DataFrame, keys: list[str], factor: Column) -> DataFrame:
    """Sums of size, of objects (+1 created, -1 deleted) and of used space."""
    one = F.when(kind_is(CREATE), 1).when(kind_is(DELETE), -1).otherwise(0)
    return log.groupBy(*keys).agg(F.sum("deltasize").alias("size"), F.sum(one).alias("objects"), F.sum((F.col("deltasize") * factor).cast("long")).alias("used"))


def clamped_rollup(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Bucket size and count in log order, never below 0: an update that would go below stops at 0, a delete of
    more than there is leaves the size and still counts.

    The order matters, so each bucket's changes are dealt to one task, sorted there (on disk if need be) and
    folded as a stream, with one (size, objects) as state. A null kind is none, a null delta sets the size to 0.
    """
    rest = [c for c in ("trtype", "deltasize") if c not in (*keys, *order)]
    rows = log.select(*dict.fromkeys([*keys, *order, *rest])).repartition(*keys).sortWithinPartitions(*dict.fromkeys([*keys, *order, "trtype", "deltasize"]))
    schema = T.StructType([log.schema[c] for c in keys] + [T.StructField("size", T.LongType()), T.StructField("objects", T.LongType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, size, n, kinds = None, None, 0, 0, None
        for rb in batches:
            kinds = [rb.schema.field(c).type for c in keys] + [pa.int64(), pa.int64()]
            done = []
            for k, t, d in zip(zip(*(rb.column(c).to_pylist() for c in keys)), rb.column("trtype").to_pylist(), rb.column("deltasize").to_pylist()):
                if k != key or now is None:
                    if now:
                        done.append((*key, size, n))
                    now, key, size, n = True, k, 0, 0
                t = t or 0
                gone = t & DELETE
                if d is None:
                    size = 0
                elif not (gone and -d > size):
                    size = max(size + d, 0)
                n = max(n - 1, 0) if gone else n + 1 if t & CREATE else n
            if done:
                yield _rows(done, kinds)
        if now:
            yield _rows([(*key, size, n)], kinds)

    def _rows(done: list[tuple], kinds: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate(kinds)], names=[*keys, "size", "objects"])

    return rows.mapInArrow(fold, schema)


def search(log: DataFrame, start: int, end: int, increment: int, max_batches: int, where: Column) -> DataFrame:
    """Rows of the first batches that have hits, from the batch of ``start`` to before ``end``, by time."""
    batch = F.col("timestamp") - F.col("timestamp") % increment
    hits = log.withColumn("batch", batch).where((F.col("batch") >= start - start % increment) & (F.col("batch") < end) & where)
    # distinct batches are few, and only max_batches of them come back
    chosen = hits.select("batch").distinct().orderBy("batch").limit(max_batches)
    return hits.join(F.broadcast(chosen), "batch", "left_semi").orderBy("timestamp")


def next_batch(log: DataFrame, marker: int, increment: int) -> DataFrame:
    """Rows of the first batch after the marker's: two passes that the filter on time prunes, no sort."""
    later = log.where(F.col("timestamp") >= marker - marker % increment + increment)
    first = later.agg(F.min("timestamp").alias("_t")).select((F.col("_t") - F.col("_t") % increment).alias("batch"))
    return later.withColumn("batch", F.col("timestamp") - F.col("timestamp") % increment).join(F.broadcast(first), "batch", "left_semi")


def retain(log: DataFrame, now: int, seconds: int = 7 * 86_400) -> DataFrame:
    """Rows that are not older than the retention time."""
    return log.where(F.col("timestamp") >= now - seconds)


def late(log: DataFrame, batch: int, interval: int, quarantine: int = 1) -> DataFrame:
    """What cut_off leaves for the next batch."""
    return log.where((F.col("timestamp") > batch - quarantine * interval) & (F.col("trtype").bitwiseAND(ISGW) == 0))


def pack(log: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, and the other columns as one text."""
    rest = [c for c in log.columns if c not in keys]
    return log.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("record"))


def unpack(packed: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Columns of records that pack made; a broken record gives nulls."""
    return packed.withColumn("_r", F.from_json("record", schema)).select(*(c for c in packed.columns if c != "record"), "_r.*")


def has_parent(phid: Column) -> Column:
    """Records whose parent's hash is not all zeros."""
    return F.coalesce(~phid.rlike("^0+$"), F.lit(False))


def is_part_record(oid: Column) -> Column:
    """Names of multipart pieces: the bytes EF BF BF 7B up to a 7D at 132, and something after it."""
    b = F.encode(oid, "utf-8")
    return (F.octet_length(oid) > 132) & F.hex(b).startswith("EFBFBF7B") & (F.hex(F.substring(b, 133, 1)) == "7D")


def pending_totals(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of pending changes and the newest generation for each shard."""
    return deltas.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("size", "objects", "used")), F.max("generation").alias("generation"))


def elide_pairs(log: DataFrame, keys: list[str]) -> DataFrame:
    """Drop a create that the next generation's delete undoes, and that delete."""
    w = Window.partitionBy(*keys).orderBy("generation", "timestamp")
    nxt = F.lead(F.struct("trtype", "generation")).over(w)
    prev = F.lag(F.struct("trtype", "generation")).over(w)
    undone = kind_is(CREATE) & (nxt["trtype"].bitwiseAND(DELETE) != 0) & (nxt["generation"] == F.col("generation") + 1)
    undoes = kind_is(DELETE) & (prev["trtype"].bitwiseAND(CREATE) != 0) & (prev["generation"] == F.col("generation") - 1)
    marked = log.withColumn("_u", F.coalesce(undone, F.lit(False))).withColumn("_d", F.coalesce(undoes, F.lit(False)))
    return marked.where("NOT _u AND NOT _d").drop("_u", "_d")
