"""Queries of the problems 2, 4, 7, 8 and 9, and SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, gmm, mixing, quality, topn


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return gmm.strays(table(spark, d, "poses_mapped"))


def p2_sites(spark: SparkSession, d: str) -> DataFrame:
    return gmm.sites(table(spark, d, "poses_mapped"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.best_poses(table(spark, d, "poses_mapped")).select("run_id", "cluster_id", "pose_id")


def p4_ranked(spark: SparkSession, d: str) -> DataFrame:
    return topn.best_poses(table(spark, d, "poses_mapped"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = bpe.count_tokens(table(spark, d, "documents").select("doc_id", "source", "text"))
    docs = docs.select("doc_id", F.when(F.col("source").isNotNull(), F.array("source")).alias("sources"), "n_tokens")
    return mixing.mix_sources(docs, table(spark, d, "source_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The shares of a mix of languages and sources: documents belong to their source and to their language, so sources overlap."""
    docs = bpe.count_tokens(table(spark, d, "documents").select("doc_id", F.array_compact(F.array("source", F.lower(F.substring("lang", 1, 2)))).alias("sources"), "text"))
    targets = table(spark, d, "source_targets")
    by_source = targets.select("source", (F.col("target_share") / 2).alias("target_share"), "max_repeats")
    langs = spark.createDataFrame([(x, 0.1, 3) for x in ("de", "fr", "es", "ru", "ja")], by_source.schema)
    return mixing.mix_sources(docs, by_source.unionByName(langs))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_speech(table(spark, d, "documents"))


def p9_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_quality(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_sites, p4_found, p4_ranked, p7_ids, p8_mix, p8_shares, p8_overlap, p9_found, p9_quality)}

_P4 = """
SELECT run_id, cluster_id, pose_id, vina_score, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY vina_score, pose_id) AS rank FROM (
    SELECT run_id, cluster_id, pose_id, min(vina_score) AS vina_score FROM poses_mapped
    WHERE run_id IS NOT NULL AND cluster_id IS NOT NULL AND pose_id IS NOT NULL AND vina_score IS NOT NULL AND NOT isnan(vina_score) AND NOT isinf(vina_score)
    GROUP BY 1, 2, 3) p) r WHERE rank <= 3"""

SQL = {"p4_found": f"SELECT run_id, cluster_id, pose_id FROM ({_P4}) t", "p4_ranked": _P4}
