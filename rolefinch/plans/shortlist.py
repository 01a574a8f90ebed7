"""The ranked shortlist and its explanation, each one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators.tables import current_extractions

COMPONENTS = ("skill_coverage", "title_match", "recency", "location_fit")


def candidates(postings: DataFrame, companies: DataFrame, extractions: DataFrame, version: str) -> DataFrame:
    """Open postings with their company's name and, from the memo, the skills of their present content (null if not extracted).

    ``postings(posting_id, company_id, content_hash, status, ...)``, ``companies(company_id, company)``; unwatched
    companies count too.
    """
    return current_extractions(postings.where("status = 'open'"), extractions, version).join(companies.select("company_id", "company"), "company_id")


def cheap(postings: DataFrame, profile: S.Profile, now, half_life_days: float = 14.0, hard_location: bool = False) -> DataFrame:
    """Postings with ``skills`` that pass the hard filters, with all components but the title's."""
    fit = S.location_fit(F.col("locations"), F.col("remote_policy"), profile)
    x = postings.where(S.passes(F.col("title"), fit, profile, hard_location))
    x = x.withColumn("skills", F.explode(F.array(F.coalesce("skills", F.array().cast("array<string>")))))  # found once, though several columns use them
    return x.withColumns({"skill_coverage": S.skill_coverage(F.col("skills"), profile.skills), "n_covered": S.covered(F.col("skills"), profile.skills), "n_skills": F.size("skills"), "recency": S.recency(F.col("posted_at"), F.lit(now).cast("timestamp_ntz"), half_life_days), "location_fit": fit})


def whole(x: DataFrame, profile: S.Profile, now, weights: S.Weights = S.Weights()) -> DataFrame:
    """Rows of ``cheap`` with the title's component, ``total`` and ``why``."""
    x = x.withColumn("title_match", S.title_match(F.col("title"), profile.target_titles))
    x = x.withColumn("total", S.total([F.col(c) for c in COMPONENTS], weights))
    return x.withColumn("why", S.why(F.col("skill_coverage"), F.col("n_covered"), F.col("n_skills"), F.col("title_match"), F.col("posted_at"), F.lit(now).cast("timestamp_ntz")))


def score(postings: DataFrame, profile: S.Profile, now, weights: S.Weights = S.Weights(), half_life_days: float = 14.0, hard_location: bool = False) -> DataFrame:
    """Postings with ``skills`` that pass the hard filters, with their components, ``total`` and ``why``. Filters come first: titles are compared only for rows that stay."""
    return whole(cheap(postings, profile, now, half_life_days, hard_location), profile, now, weights)


def top(scored: DataFrame, n: int = 10) -> DataFrame:
    return scored.orderBy(F.col("total").desc(), "posting_id").limit(n)


def contenders(postings: DataFrame, profile: S.Profile, now, n: int = 10, weights: S.Weights = S.Weights(), half_life_days: float = 14.0, hard_location: bool = False) -> DataFrame:
    """The rows of ``cheap`` that can be among the first ``n``, whatever their titles.

    A title's component lies between 0 and 1, so the others bound the total from below and above; a row whose upper
    bound does not reach the n-th best lower bound is out.
    """
    x = cheap(postings, profile, now, half_life_days, hard_location)
    if not profile.target_titles:
        return x
    bound = lambda v: S.total([F.lit(v).cast("double") if c == "title_match" else F.col(c) for c in COMPONENTS], weights)
    floor = x.select(bound(0.0).alias("low")).orderBy(F.col("low").desc()).limit(n).agg(F.min("low")).scalar()
    return x.where(bound(1.0) >= floor - 1e-9)  # sums of doubles may differ in their last digits


def best(postings: DataFrame, profile: S.Profile, now, n: int = 10, weights: S.Weights = S.Weights(), half_life_days: float = 14.0, hard_location: bool = False) -> DataFrame:
    """The first ``n`` of ``score``; only the titles of ``contenders`` are compared."""
    return top(whole(contenders(postings, profile, now, n, weights, half_life_days, hard_location), profile, now, weights), n)


def explain(scored: DataFrame, weights: S.Weights = S.Weights(), half_life_days: float = 14.0) -> DataFrame:
    """Four rows for each posting, in order: value, weight, weighted value (null where undefined) and detail."""
    said = S.details(*(F.col(c) for c in ("skill_coverage", "n_covered", "n_skills", "title_match", "recency", "location_fit")), half_life_days)
    rows = [F.struct(F.lit(k).alias("position"), F.lit(c).alias("component"), F.col(c).cast("double").alias("value"), F.lit(float(w)).alias("weight"), (F.col(c) * w).cast("double").alias("weighted"), said[k].alias("detail")) for k, (c, w) in enumerate(zip(COMPONENTS, weights.values(), strict=True))]
    return scored.select("posting_id", F.inline(F.array(*rows)))


def shown(postings: DataFrame, companies: DataFrame, extractions: DataFrame, version: str, profile: S.Profile, now, weights: S.Weights = S.Weights(), half_life_days: float = 14.0) -> DataFrame:
    """Postings of any status with their company and, where they are open, components and ``total``; closed ones are not ranked, nor is one left out by a filter."""
    x = current_extractions(postings, extractions, version).join(companies.select("company_id", "company"), "company_id")
    free = S.Profile(profile.skills, profile.target_titles, [], profile.locations, profile.remote_only)
    x = whole(cheap(x, free, now, half_life_days), free, now, weights)
    ranked = F.col("status") == "open"
    return x.withColumns({c: F.when(ranked, F.col(c)) for c in (*COMPONENTS, "total", "n_covered", "n_skills")}).withColumn("why", F.when(ranked, F.col("why")).otherwise("closed — not ranked"))
