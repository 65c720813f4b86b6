"""The corpus queries, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import drake, exact_dedup, merkle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    """Where the word-level public vocabulary lies; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import WEIGHTS, labelled_domains, mixture

    labelled = labelled_domains(_table(spark, sf_dir, "labels"))
    return mixture(_table(spark, sf_dir, "documents"), labelled, WEIGHTS)


def op2_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licences

    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licences(docs.select("doc_id", path.alias("path"), "text"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), word_vocabulary())


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_crf import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    groups = near_duplicates(_table(spark, sf_dir, "documents"), width=3, max_bits=3)
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lzprint import compare_in_order

    return compare_in_order(_table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(_table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features

    return media_features(_table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"), digest_all=True)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import tampered, verified_manifest

    return verified_manifest(_table(spark, sf_dir, "documents"), claimed=tampered())


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .drake import cluster_report

    return cluster_report(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_licence_scans": op2_licence_scans,
    "op3_packing": op3_packing,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_secret_scans": op5_secret_scans,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_pii": op9_pii,
    "op10_media_columns": op10_media_columns,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLE_SQL: dict[str, str] = {
    "op11_exact_dedup": exact_dedup.SQL,
    "op12_merkle_manifest": merkle.sql(),
    "op13_centroid_clustering": drake.sql(),
}
