"""Job-board tables laid over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scoring import Profile
from .functions.taxonomy import Pattern, Taxonomy
from .functions.text import content_hash
from .operators.backfill import backfill, memo
from .stored import new_path

NOW = "2024-01-31 00:00:00"
#: Stop words stand for skills: the test texts are invented prose.
WORDS = Taxonomy([Pattern(w, c, rf"\b{w}\b") for w, c in (("the", "en"), ("and", "en"), ("with", "en"), ("from", "en"), ("und", "de"), ("nicht", "de"), ("que", "es"), ("los", "es"), ("les", "fr"), ("dans", "fr"))])
PROFILE = Profile(skills=["and", "from", "que", "the", "und"], target_titles=["the and of", "der die und"], exclude_titles=["oneaea", "zz"], locations=["en", "fr"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("posting_id"), F.col("source").alias("company"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("body_text"),
        F.array("lang").alias("locations"), F.when(F.col("doc_id") % 5 == 0, "remote").otherwise("unknown").alias("remote_policy"),
        F.expr(f"timestamp_ntz'{NOW}' - make_dt_interval(cast(doc_id % 60 as int))").alias("posted_at"), F.when(F.col("doc_id") % 7 == 0, "closed").otherwise("open").alias("status"),
    )


_stored: dict[tuple[str, str], dict[str, str]] = {}


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``postings``, ``companies`` and the extraction memo as a job keeps them, written on first use and read from then on."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        paths = {name: new_path(spark, name) for name in ("postings", "companies", "extractions")}
        p = postings(spark, sf_dir).withColumn("content_hash", content_hash(F.col("body_text"))).withColumn("company_id", F.xxhash64("company"))
        p.drop("company").write.parquet(paths["postings"])
        p.select("company_id", "company").distinct().write.parquet(paths["companies"])
        backfill(spark.read.parquet(paths["postings"]), paths["extractions"], WORDS, held=True)
        _stored[key] = paths
    paths = _stored[key]
    return spark.read.parquet(paths["postings"]), spark.read.parquet(paths["companies"]), memo(spark, paths["extractions"])


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """board, seq, status: one scan of each board a day."""
    e = table(spark, sf_dir, "events")
    days = e.select(F.to_date("ts").alias("day")).distinct()
    boards = e.select(F.col("event_type").alias("board")).distinct()
    d = F.dayofmonth("day") % 7
    status = F.when(d == 3, "partial").when(d == 5, "failed").when(d == 6, "unchanged").otherwise("complete")
    return boards.crossJoin(days).select("board", F.datediff("day", F.lit("2024-01-01").cast("date")).alias("seq"), status.alias("status"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """board, posting_id, seq, content_hash: the last event of each user and day is that day's listing."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("board"), F.col("user_id").alias("posting_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("seq"), F.struct("event_id", "props").alias("last"))
    return e.groupBy("board", "posting_id", "seq").agg(F.max("last")["props"].alias("content_hash"))
