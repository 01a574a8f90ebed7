"""A training-data pipeline over ``documents``: filter, clean, deduplicate, decontaminate, pack.

Every stage works on all rows that its predecessor kept. All but the last return the columns of ``documents``.
Rows are told apart by id and text together, so null and repeated ids are documents like others; a null id comes
after all others. Every stage takes an empty table and gives an empty one; extra columns, whatever their names,
are handed on by all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefinch.llm.decontaminate import contaminated
from rolefinch.llm.jaccard_join import jaccard_components
from rolefinch.llm.line_dedup import dedup_lines
from rolefinch.llm.packing import pack, token_pieces
from rolefinch.llm.quality import score_quality
from rolefinch.llm.shared import remove, shared_dir, stage, unused


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of id and text in an own column, nulls after all ids, and that column's name."""
    key = unused(docs, "row_key")
    return docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))), key


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``gone(key)``."""
    x, y = unused(docs, "gone_id"), unused(docs, "gone_hash")
    gone = gone.select(F.col(f"{key}.id").alias(x), F.col(f"{key}.h").alias(y)).distinct()
    return docs.join(gone, F.col(f"{key}.id").eqNullSafe(F.col(x)) & (F.col(f"{key}.h") == F.col(y)), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null and empty texts are scored like others."""
    return score_quality(docs, _table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that repeat earlier text; documents of which nothing is left go. Null and empty texts stay as they are."""
    out = dedup_lines(docs).where(r"n_deleted = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    return out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, of several texts of it the one with the least hash.

    Of rows that repeat id and text the first in order of their other columns stays. Texts without words are in no group and all stay.
    """
    keyed, key = _keyed(docs)
    found = jaccard_components(keyed, key)
    found = found.where("n_shingles > 0").groupBy(key).agg(F.min("component_id").alias("low"), F.count("*").alias("n"))
    found = found.where((F.col(key) != F.col("low")) | (F.col("n") > 1)).select(key, (F.col(key) == F.col("low")).alias("repeated"))
    found = stage(found, "copies")
    left = _without(keyed, key, found).select(*docs.columns)
    again = keyed.join(found.where("repeated").select(key), key, "left_semi").groupBy(key).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"))
    return left.unionByName(again.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts hold none."""
    keyed, key = _keyed(docs)
    return _without(keyed, key, contaminated(keyed, _table(spark, sf_dir, "benchmark"), id_col=key).select(key)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of 2048. A null text is one piece of one id, like an empty one."""
    import public_tokenizers

    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: The classifier and the tokenizer have no form in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (_, step) in enumerate(STAGES):
        step(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            remove(spark, f"{base}/{k - 1}")
    return docs
