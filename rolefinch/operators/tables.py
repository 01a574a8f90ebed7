"""Upserts, insert-if-absent and rollups, as joins and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], refresh: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, columns in ``refresh`` are the new ones and the others the old ones."""
    fresh = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in old.columns if c not in keys), F.lit(True).alias("_in_new"))
    j = old.withColumn("_in_old", F.lit(True)).join(fresh, keys, "full")
    pick = lambda c: F.when(F.col("_in_new") & (F.col("_in_old").isNull() | F.lit(c in refresh)), F.col(f"_new_{c}")).otherwise(F.col(c))
    return j.select(*(F.col(c) if c in keys else pick(c).alias(c) for c in old.columns))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those new rows whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def missing_extractions(postings: DataFrame, extractions: DataFrame, version: str | Column, kind: str = "taxonomy", ordered: bool = False) -> DataFrame:
    """Open postings without a current extraction of their present content, ``ordered`` by id if wanted."""
    current = extractions.where((F.col("kind") == kind) & (F.col("engine_version") == version)).select("posting_id", "content_hash")
    out = postings.where("status = 'open'").join(current, ["posting_id", "content_hash"], "left_anti")
    return out.orderBy("posting_id") if ordered else out


def extraction_state(postings: DataFrame, extractions: DataFrame, version: str, kind: str = "taxonomy") -> DataFrame:
    """``postings`` with ``extraction``: current, superseded (only for other content or another version) or missing."""
    current = (F.col("e.engine_version") == version) & (F.col("e.content_hash") == F.col("p.content_hash"))
    known = postings.alias("p").join(extractions.where(F.col("kind") == kind).alias("e"), "posting_id").groupBy("posting_id").agg(F.max(current.cast("int")).alias("now"))
    said = F.when(F.col("now") == 1, "current").when(F.col("now") == 0, "superseded").otherwise("missing")
    return postings.join(known, "posting_id", "left").withColumn("extraction", said).drop("now")


def current_extractions(postings: DataFrame, extractions: DataFrame, version: str, kind: str = "taxonomy") -> DataFrame:
    current = extractions.where((F.col("kind") == kind) & (F.col("engine_version") == version)).select("posting_id", "content_hash", "skills")
    return postings.join(current, ["posting_id", "content_hash"], "left")


def extract(postings: DataFrame, taxonomy, kind: str = "taxonomy") -> DataFrame:
    """Extraction rows of postings: the memo's key, the skills and their categories."""
    x = postings.select("posting_id", "content_hash", F.lit(kind).alias("kind"), F.lit(taxonomy.version).alias("engine_version"), F.explode(F.array(taxonomy.skills(F.col("body_text")))).alias("skills"))  # found once, though categories and filters use them
    return x.withColumn("categories", taxonomy.categories(F.col("skills")))


def refresh_profile(profile: DataFrame, taxonomy) -> DataFrame:
    """``profile(..., text, skills, taxonomy_version)`` with skills found anew where another taxonomy version found them."""
    stale = ~F.col("taxonomy_version").eqNullSafe(F.lit(taxonomy.version))
    out = {"skills": F.when(stale, taxonomy.skills(F.col("text"))).otherwise(F.col("skills")), "taxonomy_version": F.lit(taxonomy.version)}
    return profile.select(*(out.get(c, F.col(c)).alias(c) for c in profile.columns))


def stale_profile(profile: DataFrame, version: str) -> DataFrame:
    return profile.where(~F.col("taxonomy_version").eqNullSafe(F.lit(version)))



def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def providers(companies: DataFrame) -> DataFrame:
    """The different providers of watched companies."""
    return companies.where("watched").select("provider").distinct()


def known_boards(companies: DataFrame, providers: list[str]) -> DataFrame:
    """Watched companies whose provider there is a source for: the boards that a run attempts."""
    return companies.where("watched").where(F.col("provider").isin(providers))


def unknown_providers(companies: DataFrame, providers: list[str]) -> DataFrame:
    """``board, error`` of watched companies that no source reads: errors of a run, though no boards of it."""
    return companies.where("watched").where(~F.coalesce(F.col("provider").isin(providers), F.lit(False))).select(F.col("slug").alias("board"), F.format_string("%s: unknown provider '%s'", "slug", "provider").alias("error"))


def run_errors(scan_log: DataFrame, companies: DataFrame, providers: list[str]) -> DataFrame:
    """``board, error``: what a run reports, a row each: failed boards, and companies of unknown providers."""
    failed = scan_log.where("status = 'failed'").select("board", F.format_string("%s: %s", "board", "error").alias("error"))
    return failed.unionByName(unknown_providers(companies, providers))


def requests(boards: DataFrame, http_cache: DataFrame) -> DataFrame:
    """Boards with the validators last kept for their url, null where there are none."""
    return boards.join(http_cache.select("url", "etag", "last_modified"), "url", "left")


def persist_validators(http_cache: DataFrame, observed: DataFrame) -> DataFrame:
    """``http_cache(url, etag, last_modified)`` after a scan: only complete scans count, and only if they showed validators."""
    new = observed.where("status = 'complete' and (etag is not null or last_modified is not null)").select("url", "etag", "last_modified")
    return upsert(http_cache, new, ["url"], ["etag", "last_modified"])


def open_run(runs: DataFrame, started_at: Column) -> DataFrame:
    """``runs`` with a new row, its id one more than the greatest, that counts nothing yet."""
    row = runs.agg((F.coalesce(F.max("run_id"), F.lit(0)) + 1).alias("run_id")).select("run_id", started_at.cast("timestamp_ntz").alias("started_at"))
    return runs.unionByName(row.withColumn("boards_attempted", F.lit(0).cast("long")), allowMissingColumns=True)


def finalize_run(runs: DataFrame, run_id: int, summary: DataFrame, finished_at: Column) -> DataFrame:
    """``runs`` with the counts of ``summary`` (one row) and the end in the row of ``run_id``."""
    counts = summary.select(F.lit(run_id).cast("long").alias("run_id"), finished_at.cast("timestamp_ntz").alias("finished_at"), *(c for c in summary.columns if c in runs.columns))
    return upsert(runs, counts.unionByName(runs.limit(0), allowMissingColumns=True).select(*runs.columns), ["run_id"], [c for c in counts.columns if c != "run_id"])


def run_summary(scan_log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for a run (for each value of ``by``) from ``scan_log(board, status, listed, new, reopened, closed, error)``. Its errors are counted; ``run_errors`` has them, a row each, however many boards failed."""
    return scan_log.groupBy(*by).agg(
        F.count("*").alias("boards_attempted"), F.count_if(F.col("status") == "complete").alias("boards_complete"), F.coalesce(F.sum("listed"), F.lit(0)).alias("postings_seen"), F.coalesce(F.sum("new"), F.lit(0)).alias("new_count"),
        F.coalesce(F.sum("reopened"), F.lit(0)).alias("reopened_count"), F.coalesce(F.sum("closed"), F.lit(0)).alias("closed_count"), F.count_if(F.col("status") == "failed").alias("n_errors"),
    )


def watched(companies: DataFrame, slug: str | None = None, provider: str | None = None) -> DataFrame:
    out = companies.where("watched")
    out = out if slug is None else out.where(F.col("slug") == slug)
    return out if provider is None else out.where(F.col("provider") == provider)
