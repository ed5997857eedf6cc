"""A corpus pipeline over ``documents``: five stages, each one of the operators of ``lodestream.llm``.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as
the next stage's docs. All but the last return the columns of ``documents``; the last returns the
encoded documents (doc_id, source, n_tokens, ids_sha256, ids).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bpe, mixing, outliers, ranking, setjoin
from lodestream.session import settle, shared_dir, ship, stored, table


def _begin(spark: SparkSession) -> None:
    """Each stage leaves the driver without what the one before it held."""
    ship(spark)
    settle(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    _begin(spark)
    return outliers.keep(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking scores below the threshold go. Labels teach only by documents that are still here."""
    _begin(spark)
    return ranking.keep(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    _begin(spark)
    return setjoin.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it."""
    _begin(spark)
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids."""
    _begin(spark)
    done = bpe.encode(docs.select("doc_id", "source", "text"), keep=["doc_id", "source"])
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: Neither the robust estimate, the fitted model, exact set similarity at this size nor BPE can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{base}/{k}")
    return docs
