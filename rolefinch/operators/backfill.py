"""Extraction in batches that are committed one by one, so that what a crash leaves is taken up again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stored import new_path
from .tables import extract, missing_extractions

BATCH = 1_000_000  # postings of a batch at most
FEW = 100_000  # keys that are broadcast at most
SCHEMA = "posting_id long, content_hash string, kind string, engine_version string, skills array<string>, categories map<string,string>"


def memo(spark, path: str) -> DataFrame:
    """The extractions stored under ``path``; none if nothing has been stored there."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def current(known: DataFrame, version: str) -> DataFrame:
    return known.where((F.col("kind") == "taxonomy") & (F.col("engine_version") == version))


def pending(postings: DataFrame, known: DataFrame, version: str) -> tuple[DataFrame, int]:
    """Open postings without a current extraction, with their text, and their number. They are found by their keys: the texts are joined with nothing where nothing is known, else with what is missing, and are not sorted for it."""
    done = current(known, version)
    texts = postings.where("status = 'open'").select(F.col("posting_id").cast("long"), "content_hash", "body_text")
    keys = missing_extractions(postings.select(F.col("posting_id").cast("long"), "content_hash", "status"), done, version).select(F.col("posting_id").alias("_id"), F.col("content_hash").alias("_hash"))
    n = keys.count()
    if not n or done.isEmpty():
        return texts, n
    return texts.join(keys.hint("broadcast" if n <= FEW else "shuffle_hash"), F.col("posting_id").eqNullSafe(F.col("_id")) & F.col("content_hash").eqNullSafe(F.col("_hash")), "left_semi"), n


def in_batches(rows: DataFrame, n: int, batch: int, held: bool = False) -> Iterator[DataFrame]:
    """The ``n`` rows in parts of at most ``batch`` rows: whole files of a copy that is written once, as the rows come. Rows that are ``held`` in files of at most ``batch`` of them are not copied."""
    if n <= batch:
        yield rows
        return
    name = F.col("_metadata.file_path")
    counted = lambda: rows.groupBy(name.alias("file")).count().orderBy("file").collect()
    files = counted() if held else []
    if not files or max(count for _, count in files) > batch:
        path = new_path(rows.sparkSession, "pending")
        rows.write.option("maxRecordsPerFile", batch).parquet(path)
        rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
        files = counted()
    parts: list[list[str]] = []
    room = 0
    for file, count in files:
        if not parts or count > room:
            parts.append([])
            room = batch
        parts[-1].append(file)
        room -= count
    for some in parts:
        yield rows.where(name.isin(some))


def backfill(postings: DataFrame, path: str, taxonomy, batch: int = BATCH, committed: Callable[[int], None] | None = None, held: bool = False) -> int:
    """Add to the memo under ``path`` what open ``postings`` lack of the present taxonomy; how many that were.

    Each batch is extracted and appended by a job of its own, which shows all of its rows or none. After a crash the next
    call finds only what is still missing, so at most the open batch is done again, and no row twice. ``committed`` is told
    the number of each finished batch. ``postings`` are ``held`` if they are read from files as they are: where nothing
    is known yet of the present taxonomy, the batches are then taken from these files and nothing is copied.
    """
    known = memo(postings.sparkSession, path)
    missing, n = pending(postings, known, taxonomy.version)
    if not n:
        return 0
    for k, part in enumerate(in_batches(missing, n, batch, held and current(known, taxonomy.version).isEmpty())):
        extract(part, taxonomy).write.mode("append").parquet(path)
        if committed:
            committed(k)
    return n
