"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "n_hits")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target domain is one source of the documents."""
    from .lm_score import score_cross_entropy

    out = score_cross_entropy(_table(spark, sf_dir, "documents"), F.col("source") == "src0")
    return out.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "difference")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("distance")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack, token_pieces

    return pack(token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_deleted", F.length("text").alias("n_chars"))


def op10_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_topk

    rows = _table(spark, sf_dir, "embeddings")
    return exact_topk(rows, rows.where("vec_id % 20 = 0"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main

    return extract_main(_table(spark, sf_dir, "pages"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    return cluster(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    named = [op1_license_scan, op2_ngram_jaccard_join, op3_toxicity, op4_quality_classifier, op5_lm_scoring, op6_language_id, op7_benchmark_decontamination, op8_best_fit_packing, op9_line_dedup, op10_exact_topk_search, op11_html_extraction, op12_phrase_collocations, op13_centroid_clustering]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
