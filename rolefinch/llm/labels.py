"""Labelled rows to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000  # labelled documents a classifier is fitted on, at most


def training_rows(docs: DataFrame, labels: DataFrame, label: str, buckets: int, held_out: int, limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, y`` of at most ``limit`` labelled documents that are not held out, chosen by a hash of the id.

    Rows without a text, an id or a label do not count; an id with several labels takes the
    largest, one with several texts the first in order.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
    known = known.where(~is_held_out(F.col("id"), buckets, held_out)).groupBy("id").agg(F.max("y").alias("y"))
    some = known.orderBy(F.xxhash64("id"), "id").limit(limit)  # at most `limit` rows of two numbers
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return texts.join(F.broadcast(some), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def is_held_out(id_col, buckets: int, held_out: int):
    """Whether crc32 of the id as text has the remainder ``held_out``; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % buckets == held_out, F.lit(False))
