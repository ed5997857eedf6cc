"""Versions of objects, as-of reads, snapshots, clones and rollbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import pick


def latest(v: DataFrame, keys: list[str], with_deleted: bool = False) -> DataFrame:
    """Newest generation by absolute value; a negative one is a deletion."""
    got = pick(v, keys, [F.abs("generation"), "uvid_ts"])
    return got if with_deleted else got.where("generation > 0")


def as_of(v: DataFrame, keys: list[str], ts) -> DataFrame:
    return latest(v.where(F.col("uvid_ts") <= ts), keys)


def at_generation(v: DataFrame, generation: int) -> DataFrame:
    return v.where(F.abs("generation") == generation)


def at_uvid(v: DataFrame, uvid_ts: int) -> DataFrame:
    return v.where(F.col("uvid_ts") == uvid_ts)


def listed(v: DataFrame, keys: list[str]) -> DataFrame:
    """All versions with their place, newest first."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs(F.col("generation"))), F.desc("uvid_ts"))
    return v.withColumn("place", F.row_number().over(w))


def delete(v: DataFrame, gone: DataFrame, keys: list[str], now: int) -> DataFrame:
    """All versions, and for each object to delete that is there a tombstone: a newest generation below 0 without content."""
    top = pick(v.select(*keys, "generation").join(gone.select(*keys).distinct(), keys, "left_semi"), keys, [F.abs("generation")])
    made = {"generation": -(F.abs("generation") + 1), "uvid_ts": F.lit(now).cast("long")}
    stones = top.where("generation > 0").select(*((made[c] if c in made else F.col(c) if c in keys else F.lit(None).cast(v.schema[c].dataType)).alias(c) for c in v.columns))
    return v.unionByName(stones)


def purge(v: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """All versions but those of the given objects (keys), or but the given versions (keys and generation)."""
    by = [*keys, "generation"] if "generation" in gone.columns else keys
    return v.join(gone.select(*by), by, "left_anti").select(*v.columns)


def copy(v: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """All versions, and for each pair (source, target) the source's latest version as the target's first generation."""
    got = latest(v, [key]).join(pairs, F.col(key) == F.col("source"))
    made = {key: F.col("target"), "generation": F.lit(1).cast(v.schema["generation"].dataType)}
    return v.unionByName(got.select(*((made[c] if c in made else F.col(c)).alias(c) for c in v.columns)))


def snapshot_create(snapshots: DataFrame, v: DataFrame, keys: list[str], name: str, ts: int | None = None) -> DataFrame:
    """The snapshots (snapshot, keys, generation) and one more of what is newest, or was at ts."""
    now = latest(v, keys) if ts is None else as_of(v, keys, ts)
    return snapshots.unionByName(now.select(F.lit(name).alias("snapshot"), *keys, "generation"))


def snapshot_delete(snapshots: DataFrame, name: str) -> DataFrame:
    return snapshots.where(F.col("snapshot") != name)


def snapshot_list(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("snapshot").agg(F.count("*").alias("objects"))


def keep_newest(v: DataFrame, keys: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs(F.col("generation"))), F.desc("uvid_ts"))
    return v.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def snapshot_read(snapshots: DataFrame, v: DataFrame, keys: list[str]) -> DataFrame:
    """snapshots (snapshot, keys, generation) to the rows they hold."""
    return snapshots.join(v, [*keys, "generation"])


def clone(v: DataFrame, keys: list[str], source: dict, target: dict, generation: int | None = None) -> DataFrame:
    """The chosen version of one object under another name, as its first generation."""
    chosen = v
    for k, x in source.items():
        chosen = chosen.where(F.col(k) == x)
    chosen = at_generation(chosen, generation) if generation else latest(chosen, keys)
    for k, x in target.items():
        chosen = chosen.withColumn(k, F.lit(x).cast(chosen.schema[k].dataType))
    return chosen.withColumn("generation", F.lit(1).cast(v.schema["generation"].dataType))


def rollback(v: DataFrame, snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """All versions, and for each object of a snapshot its old content as a new newest generation."""
    top = v.groupBy(*keys).agg(F.max(F.abs("generation")).alias("_top"))
    back = snapshot_read(snapshots.select(*keys, "generation"), v, keys).join(top, keys).withColumn("generation", F.col("_top") + 1)
    return v.unionByName(back.select(*v.columns))


def expunge(v: DataFrame, expunged: DataFrame, keys: list[str]) -> DataFrame:
    """For each expunged version that was the newest: an update to what is newest now, with the change of size."""
    gone = expunged.select(*keys, F.col("generation").alias("g"), F.col("size").alias("s"))
    left = v.join(expunged.select(*keys, "generation"), [*keys, "generation"], "left_anti")
    top = pick(left.select(*keys, "generation", "size"), keys, [F.abs("generation"), "size"])
    return gone.join(top, keys).where(F.abs("generation") < F.abs("g")).select(*keys, F.col("g").alias("expunged"), "generation", (F.col("size") - F.col("s")).alias("deltasize"))


def part_offsets(parts: DataFrame, keys: list[str], number: str, size: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def part_at(parts: DataFrame, wanted: DataFrame, keys: list[str], number: str, size: str) -> DataFrame:
    """wanted (keys, at) with the part that holds that offset: the join is on the object, the range only filters in it."""
    p = part_offsets(parts, keys, number, size)
    return wanted.join(p, keys).where((F.col("at") >= F.col("offset")) & (F.col("at") < F.col("offset") + F.col(size)))


def resolve_path(entries: DataFrame, path: str, root: int) -> DataFrame:
    """Walk (parent, name, child) level by level; one point join for each part of the path."""
    at = entries.sparkSession.createDataFrame([(root,)], "child long")
    for part in [p for p in path.split("/") if p]:
        step = entries.where(F.col("name") == part).select(F.col("parent"), F.col("child").alias("_c"))
        at = step.join(F.broadcast(at), step["parent"] == at["child"]).select(F.col("_c").alias("child"))
    return at
