"""One query for each operator of this subpackage, over its whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, fixity, gif, licenses, mixing, outliers, ranking, repair, setjoin, unigram


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.sized(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = repair.write_shards(table(spark, sf_dir, "documents"))
    return repair.read_shards(files)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = gif.store(table(spark, sf_dir, "documents"), ["doc_id"])
    return gif.described(media, ["doc_id", "n_bytes"]).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.rules(table(spark, sf_dir, "documents")).select("doc_id", *outliers.BASE, "base_failed", "kept", "distance2", "level")


def op9_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.drill(table(spark, sf_dir, "pages"))


def op9_fixity_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.drill_moved(table(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op1_license_scan": op1_license_scan, "op6_token_counts": op6_token_counts, "op9_fixity_audit": op9_fixity_audit, "op7_media_gif": op7_media_gif, "op5_token_files": op5_token_files, "op2_byte_bpe": op2_byte_bpe, "op10_jaccard_join": op10_jaccard_join, "op3_quality_classifier": op3_quality_classifier, "op8_quality_rules": op8_quality_rules, "op4_mix_sources": op4_mix_sources, "op9_fixity_moved": op9_fixity_moved}


def oracle_sql() -> dict:
    return {"op4_mix_sources": mixing.SQL, "op9_fixity_audit": fixity.SQL, "op9_fixity_moved": fixity.SQL_MOVED}
