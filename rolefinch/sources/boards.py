"""Job-board payloads to typed postings, with errors kept to their row.

A payload is one JSON text of a board in one of three layouts: ``greenhouse`` (object with escaped HTML),
``lever`` (bare array of plain text) or ``ashby`` (object with HTML and pay).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold, html_to_text, strip, unescape
from ..functions.times import EPOCH_MS, epoch_ms, iso_time

# Pay intervals.
INTERVALS = {"1 YEAR": "year", "1 MONTH": "month", "1 WEEK": "week", "1 DAY": "day", "1 HOUR": "hour"}
# What a scan says of a payload and of rows that failed.
INVALID, ALL_FAILED, SOME_FAILED, ONE_FAILED = "invalid board payload: ", "all %d jobs failed to parse", "%d of %d jobs failed to parse: ", "job %s: %s"
TOLD = 3  # rows whose errors are told
SPREAD = 10  # bits by which positions are grouped at each step of gathering them


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column, path: str) -> Column:
    """As a string: a JSON null is the word None, a missing key null."""
    return F.when(F.is_variant_null(F.variant_get(v, path, "variant")), "None").otherwise(_get(v, path))


def _dedup(places: Column) -> Column:
    return F.array_distinct(F.filter(places, lambda x: x.isNotNull() & (x != "")))


def _names(v: Column, path: str, field: str) -> Column:
    return F.coalesce(F.transform(_get(v, path, "array<variant>"), lambda x: _get(x, field)), F.array().cast("array<string>"))


def _present(v: Column, path: str) -> Column:
    x = F.variant_get(v, path, "variant")
    return x.isNotNull() & ~F.is_variant_null(x)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _number(v: Column, path: str) -> Column:
    """A JSON number, true as 1 and false as 0; anything else is null."""
    kind = _kind(F.variant_get(v, path, "variant"))
    return F.when(kind == "BOOLEAN", _get(v, path, "boolean").cast("double")).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), _get(v, path, "double"))


def _body_part(v: Column, path: str) -> tuple[Column, Column]:
    """A part of a plain body, null if it is empty or nothing, and whether it is something else than text."""
    x = F.variant_get(v, path, "variant")
    text = F.when(_kind(x) == "STRING", F.nullif(_get(v, path), F.lit("")))
    nothing = x.isNull() | F.is_variant_null(x) | (_kind(x) == "STRING") | (_number(v, path) == 0) | F.to_json(x).isin("[]", "{}")
    return text, ~F.coalesce(nothing, F.lit(False))


def remote_policy(locations: Column, flag: Column | None = None) -> Column:
    said = F.exists(locations, lambda x: F.contains(casefold(x), F.lit("remote")))
    return F.when(said if flag is None else said | F.coalesce(flag, F.lit(False)), "remote").otherwise("unknown")


PAY = "struct<salary_min double, salary_max double, salary_currency string, salary_period string, bad boolean>"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, however often it is used afterwards."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_pay(df: DataFrame, v: str = "raw") -> DataFrame:
    """``df`` with ``pay``, only for exactly one tier of exactly one salary with a known interval, a currency and a bound; ``bad`` if a bound is no number."""
    x = once(df, "_tiers", _get(F.col(v), "$.compensation.compensationTiers", "array<variant>"))
    x = once(x, "_parts", F.when(F.size("_tiers") == 1, _get(F.get("_tiers", F.lit(0)), "$.components", "array<variant>")))
    x = once(x, "_part", F.when(F.size("_parts") == 1, F.get("_parts", F.lit(0))))
    one, kinds = F.col("_part"), F.create_map(*(F.lit(y) for kv in INTERVALS.items() for y in kv))
    x = once(x, "_pay", F.struct(_get(one, "$.compensationType").alias("type"), F.try_element_at(kinds, F.upper(_get(one, "$.interval"))).alias("period"), _get(one, "$.currencyCode").alias("currency"), *(c for n in ("min", "max") for c in (_get(one, f"$.{n}Value", "double").alias(n), _present(one, f"$.{n}Value").alias(f"has_{n}")))))
    p = lambda c: F.col(f"_pay.{c}")
    bad = (p("has_min") & p("min").isNull()) | (p("has_max") & p("max").isNull())
    ok = (F.lower(p("type")) == "salary") & p("period").isNotNull() & (p("currency") != "") & (p("has_min") | p("has_max"))
    pay = F.when(ok, F.struct(p("min").alias("salary_min"), p("max").alias("salary_max"), p("currency").alias("salary_currency"), p("period").alias("salary_period"), bad.alias("bad")))
    return x.withColumn("pay", pay).drop("_tiers", "_parts", "_part", "_pay")


def _fields(layout: str, v: Column) -> dict[str, Column]:
    if layout == "greenhouse":
        places = _dedup(F.concat(F.array(_get(v, "$.location.name")), _names(v, "$.offices", "$.name")))
        body = html_to_text(unescape(F.coalesce(_get(v, "$.content"), F.lit(""))))
        return dict(id=_text(v, "$.id"), title=_text(v, "$.title"), url=_get(v, "$.absolute_url"), locations=places, department=F.get(_names(v, "$.departments", "$.name"), 0), body_text=body, remote_policy=remote_policy(places), posted_at=F.coalesce(iso_time(_get(v, "$.first_published")), iso_time(_get(v, "$.created_at"))), updated_at=iso_time(_get(v, "$.updated_at")))
    if layout == "lever":
        every = F.filter(_names(v, "$.categories.allLocations", "$"), lambda x: x.isNotNull() & (x != ""))
        single = _get(v, "$.categories.location")
        places = F.when(F.size(_get(v, "$.categories.allLocations", "array<variant>")) > 0, every).when(single != "", F.array(single)).otherwise(F.array().cast("array<string>"))
        first, second = _body_part(v, "$.descriptionPlain"), _body_part(v, "$.additionalPlain")
        body = F.concat_ws("\n\n", first[0], second[0])
        return dict(id=_text(v, "$.id"), title=_text(v, "$.text"), url=_get(v, "$.hostedUrl"), locations=places, department=_get(v, "$.categories.team"), body_text=body, remote_policy=remote_policy(places), posted_at=epoch_ms(_number(v, "$.createdAt")), updated_at=epoch_ms(_number(v, "$.updatedAt")), bad_body=first[1] | second[1], bad_time=F.coalesce(~_number(v, "$.createdAt").between(*EPOCH_MS), F.lit(False)) | F.coalesce(~_number(v, "$.updatedAt").between(*EPOCH_MS), F.lit(False)))
    if layout == "ashby":
        places = _dedup(F.concat(F.array(_get(v, "$.location")), _names(v, "$.secondaryLocations", "$.location")))
        remote = F.when(F.schema_of_variant(F.variant_get(v, "$.isRemote", "variant")) == "BOOLEAN", _get(v, "$.isRemote", "boolean"))
        return dict(id=_text(v, "$.id"), title=_text(v, "$.title"), url=_get(v, "$.jobUrl"), locations=places, department=_get(v, "$.department"), body_text=html_to_text(_get(v, "$.descriptionHtml")), remote_policy=remote_policy(places, remote), posted_at=iso_time(_get(v, "$.publishedAt")), updated_at=F.lit(None).cast("timestamp_ntz"))
    raise ValueError(f"no such layout: {layout}")


def elements(payloads: DataFrame, layout: str) -> DataFrame:
    """One row for each element of ``payloads(board, content)``; a payload that is no inventory gives one row without an element and with its cause.

    Of repeated JSON keys the last counts, for which the session's ``spark.sql.variant.allowDuplicateKeys`` is set.
    """
    payloads.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    x = payloads.select("board", F.try_parse_json("content").alias("v"))
    jobs = F.try_variant_get("v", "$" if layout == "lever" else "$.jobs", "array<variant>")
    cause = F.when(F.col("v").isNull(), "not JSON").when(jobs.isNull(), "no list of jobs")
    return x.select("board", jobs.alias("jobs"), cause.alias("cause")).select("board", F.col("cause").isNull().alias("valid"), "cause", F.posexplode_outer("jobs").alias("pos", "raw"))


def parse(payloads: DataFrame, layout: str) -> DataFrame:
    """``board, valid, cause, pos, provider_posting_id, title, ..., error``: every element, with its own error or none."""
    e = elements(payloads, layout)
    e = with_pay(e) if layout == "ashby" else e.withColumn("pay", F.lit(None).cast(PAY))
    f = _fields(layout, F.col("raw"))
    title, no = strip(f["title"]), F.lit(False)
    error = F.when(F.col("raw").isNotNull(), F.when(f["id"].isNull(), "missing id").when(f["title"].isNull(), "missing title").when(title == "", "empty title").when(f.get("bad_body", no), "body is no text").when(f.get("bad_time", no), "time out of range").when(F.coalesce(F.col("pay.bad"), no), "pay is no number"))
    return e.select("board", "valid", "cause", "pos", f["id"].alias("provider_posting_id"), title.alias("title"), F.coalesce(f["url"], F.lit("")).alias("url"), f["locations"].alias("locations"), f["department"].alias("department"), f["body_text"].alias("body_text"), f["remote_policy"].alias("remote_policy"), f["posted_at"].alias("posted_at"), f["updated_at"].alias("updated_at"), "pay.salary_min", "pay.salary_max", "pay.salary_currency", "pay.salary_period", F.to_json("raw").alias("raw_json"), error.alias("error"))


def snapshot_status(parsed: DataFrame) -> DataFrame:
    """``board, status, listed, error``: complete without errors, partial with some, failed if all rows or the payload failed; the first three are told with their ids.

    Rows are counted, and the first errors picked, by groups of positions, then by groups of such groups, then by
    board: no group holds more than a few thousand errors, however many a board has.
    """
    told = F.when(F.col("error").isNotNull(), F.struct("pos", F.coalesce("provider_posting_id", F.lit("?")).alias("id"), "error"))
    first = lambda c: F.slice(F.array_sort(c), 1, TOLD)
    g = parsed.select("board", "valid", "cause", F.coalesce("pos", F.lit(0)).alias("at"), F.col("pos").isNotNull().cast("long").alias("n"), F.col("error").isNotNull().cast("long").alias("bad"), told.alias("told"))
    sums = lambda firsts: (F.first("valid").alias("valid"), F.first("cause").alias("cause"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), first(firsts).alias("told"))
    g = g.groupBy("board", F.shiftright("at", SPREAD).alias("at")).agg(*sums(F.collect_list("told")))
    g = g.groupBy("board", F.shiftright("at", SPREAD).alias("at")).agg(*sums(F.flatten(F.collect_list("told"))))
    g = g.groupBy("board").agg(*sums(F.flatten(F.collect_list("told"))))
    said = F.concat(F.format_string(SOME_FAILED, "bad", "n"), F.array_join(F.transform("told", lambda x: F.format_string(ONE_FAILED, x["id"], x["error"])), "; "))
    status = F.when(~F.col("valid"), "failed").when(F.col("bad") == 0, "complete").when(F.col("bad") == F.col("n"), "failed").otherwise("partial")
    error = F.when(~F.col("valid"), F.concat(F.lit(INVALID), "cause")).when((F.col("bad") == F.col("n")) & (F.col("n") > 0), F.format_string(ALL_FAILED, "n")).when(F.col("bad") > 0, said)
    return g.select("board", status.alias("status"), (F.col("n") - F.col("bad")).alias("listed"), error.alias("error"))


def scan_rows(statuses: DataFrame, run_id: int, at) -> DataFrame:
    """A row of the scan log for each board of a run, whatever its status; only failed boards' errors are kept."""
    return statuses.select(F.lit(run_id).cast("long").alias("run_id"), "board", "status", F.when(F.col("status").isin("complete", "partial"), F.col("listed")).otherwise(0).alias("listed"), F.when(F.col("status") == "failed", F.col("error")).alias("error"), at.cast("timestamp_ntz").alias("at"))


def health(code: Column, n_jobs: Column) -> Column:
    """ok, empty, dead (404), error (other codes or no inventory) or unreachable (no code)."""
    return F.when(code.isNull(), "unreachable").when(code == 404, "dead").when((code != 200) | n_jobs.isNull(), "error").when(n_jobs == 0, "empty").otherwise("ok")
