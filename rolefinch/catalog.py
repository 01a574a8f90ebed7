"""All queries of the engine over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scoring as S
from .functions import text as X
from .operators import backfill, state, tables
from .plans import shortlist
from .sources import boards, payloads
from .stored import new_path
from .streaming import fold
from .testviews import NOW, PROFILE, WORDS, listings, postings, scans, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Text of the SQL that several queries share.
POSTINGS = f"""postings AS (SELECT doc_id AS posting_id, source AS company, substring(text, 1, 40) AS title, text AS body_text, [lang] AS locations,
  CASE WHEN doc_id % 5 = 0 THEN 'remote' ELSE 'unknown' END AS remote_policy,
  TIMESTAMP '{NOW}' - to_days(CAST(doc_id % 60 AS INT)) AS posted_at, CASE WHEN doc_id % 7 = 0 THEN 'closed' ELSE 'open' END AS status FROM documents)"""
SKILLS = "skilled AS (SELECT *, list_sort(list_filter([" + ", ".join(rf"CASE WHEN regexp_matches(body_text, '(?i)(^|[^\p{{L}}\p{{N}}_]){p.name}($|[^\p{{L}}\p{{N}}_])') THEN '{p.name}' END" for p in WORDS.patterns) + "], lambda x: x IS NOT NULL)) AS skills FROM postings)"
OWN = "[" + ", ".join(f"'{x}'" for x in PROFILE.skills) + "]"
FIT = "CASE WHEN " + " OR ".join(f"contains(lower(locations[1]), '{w}') OR contains('{w}', lower(locations[1]))" for w in PROFILE.locations) + " THEN 1.0 WHEN remote_policy = 'remote' THEN 0.5 ELSE 0.0 END"
VETO = " OR ".join(f"contains(lower(title), '{x}')" for x in PROFILE.exclude_titles)
AGE = f"greatest(date_diff('microsecond', posted_at, TIMESTAMP '{NOW}') / 86400000000.0, 0)"
COVER = f"len(list_intersect(skills, {OWN}))"
SCORED = f"""scored AS (SELECT *, CASE WHEN cov IS NULL THEN (0.15 * rec + 0.10 * fit) / 0.25 ELSE (0.50 * cov + 0.15 * rec + 0.10 * fit) / 0.75 END AS total FROM (
  SELECT posting_id, company, title, posted_at, {COVER} AS n_covered, len(skills) AS n_skills, CASE WHEN len(skills) > 0 THEN {COVER} / len(skills) END AS cov, exp(-ln(2) * {AGE} / 14.0) AS rec, {FIT} AS fit, {AGE} AS age
  FROM skilled WHERE status = 'open' AND NOT ({VETO})))"""
UNTITLED = S.Profile(PROFILE.skills, [], PROFILE.exclude_titles, PROFILE.locations)


def skilled(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).withColumn("skills", F.explode(F.array(WORDS.skills(F.col("body_text")))))


def open_candidates(spark: SparkSession, d: str) -> DataFrame:
    return shortlist.candidates(*stored(spark, d), WORDS.version)


def ranked(spark: SparkSession, d: str, profile=UNTITLED) -> DataFrame:
    return shortlist.score(open_candidates(spark, d), profile, NOW)


@query(f"WITH {POSTINGS} SELECT company, count(*) AS n FROM postings WHERE status = 'open' GROUP BY company")
def open_by_company(spark, d):
    return postings(spark, d).where("status = 'open'").groupBy("company").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


LEGAL = [" Inc.", ", LLC", " Labs", " & Co.", ""]


@query(rf"SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(s_name || [{', '.join(repr(x) for x in LEGAL)}][s_suppkey % {len(LEGAL)} + 1])), '[^a-z0-9 ]', '', 'g'), '\b({'|'.join(X.COMPANY_SUFFIXES)})\b', '', 'g'), '\s+', ' ', 'g')) AS name FROM supplier")
def normalize_company(spark, d):
    legal = F.element_at(F.array(*map(F.lit, LEGAL)), (F.col("s_suppkey") % len(LEGAL) + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", X.normalize_company(F.concat("s_name", legal)).alias("name"))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM part")
def normalize_title(spark, d):
    return table(spark, d, "part").select("p_partkey", X.normalize_title(F.col("p_name")).alias("title"))


def _html_sql() -> str:
    x = r"regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>', '', 'g')"
    x = rf"regexp_replace({x}, '[\r\n]', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?i)</?({'|'.join(X.BLOCK_TAGS)})\b[^>]*>', chr(10), 'g')"
    x = rf"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, char in X.ENTITIES:
        quoted = char.replace("'", "''")
        x = f"replace({x}, '{entity}', '{quoted}')"
    return rf"SELECT page_id, array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS body FROM pages"


@query(_html_sql())
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_to_text(F.col("html")).alias("body"))


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(p_name || ' ' || p_type, '(?i){p}') THEN '{n}'" for n, p in X.ROLE_FAMILIES) + " ELSE 'general_swe' END AS family FROM part")
def role_family(spark, d):
    return table(spark, d, "part").select("p_partkey", X.role_family(F.concat_ws(" ", "p_name", "p_type")).alias("family"))


@query(f"WITH {POSTINGS}, {SKILLS} SELECT posting_id, array_to_string(skills, ',') AS skills FROM skilled")
def skill_extract(spark, d):
    return skilled(spark, d).select("posting_id", F.array_join("skills", ",").alias("skills"))


@query(f"WITH {POSTINGS}, {SKILLS}, x AS (SELECT posting_id, unnest(skills) AS skill FROM skilled) SELECT posting_id, skill, CASE " + " ".join(f"WHEN skill = '{p.name}' THEN '{p.category}'" for p in WORDS.patterns) + " END AS category FROM x")
def skill_categories(spark, d):
    return skilled(spark, d).select("posting_id", F.explode(WORDS.categories(F.col("skills"))).alias("skill", "category"))


@query(f"WITH {POSTINGS}, {SKILLS} SELECT posting_id, {COVER} AS n_covered, len(skills) AS n_skills, CASE WHEN len(skills) > 0 THEN round({COVER} / len(skills), 6) END AS coverage FROM skilled")
def skill_coverage(spark, d):
    return skilled(spark, d).select("posting_id", S.covered(F.col("skills"), PROFILE.skills).cast("long").alias("n_covered"), F.size("skills").cast("long").alias("n_skills"), F.round(S.skill_coverage(F.col("skills"), PROFILE.skills), 6).alias("coverage"))


@query(f"WITH {POSTINGS} SELECT posting_id, round(exp(-ln(2) * {AGE} / 14.0), 6) AS recency FROM postings")
def recency(spark, d):
    return postings(spark, d).select("posting_id", F.round(S.recency(F.col("posted_at"), F.lit(NOW).cast("timestamp_ntz")), 6).alias("recency"))


@query(f"WITH {POSTINGS} SELECT posting_id, CAST({FIT} AS DOUBLE) AS fit FROM postings")
def location_fit(spark, d):
    return postings(spark, d).select("posting_id", S.location_fit(F.col("locations"), F.col("remote_policy"), PROFILE).alias("fit"))


def _ratio_sql(a: str, target: str) -> str:
    """token_set_ratio of a column and a literal in DuckDB; the subsequence length by nested list_reduce."""
    return f"""SELECT p_partkey, CASE WHEN len(ta) = 0 THEN 0.0 WHEN s > 0 AND (la = 0 OR lb = 0) THEN 1.0 ELSE round(greatest(
      100 - 100.0 * (la + lb - 2 * lcs) / (s + sep + la + s + sep + lb), CASE WHEN s > 0 THEN greatest(100 - 100.0 * (sep + la) / (s + s + sep + la), 100 - 100.0 * (sep + lb) / (s + s + sep + lb)) ELSE 0 END) / 100, 6) END AS score FROM (
      SELECT *, length(both_) AS s, length(oa) AS la, length(ob) AS lb, CASE WHEN length(both_) > 0 THEN 1 ELSE 0 END AS sep,
        CASE WHEN length(oa) = 0 OR length(ob) = 0 THEN 0 ELSE list_reduce(list_transform(string_split(oa, ''), lambda ch: [ord(ch)]), lambda prev, ch: list_reduce(list_transform(range(1, length(ob) + 1), lambda j: [j]), lambda cur, j: list_append(cur, CASE WHEN ord(substring(ob, j[1], 1)) = ch[1] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], cur[-1]) END), [0::BIGINT]), list_transform(range(0, length(ob) + 1), lambda j: 0::BIGINT))[-1] END AS lcs
      FROM (SELECT p_partkey, ta, array_to_string(list_sort(list_filter(ta, lambda x: list_contains(tb, x))), ' ') AS both_, array_to_string(list_sort(list_filter(ta, lambda x: NOT list_contains(tb, x))), ' ') AS oa, array_to_string(list_sort(list_filter(tb, lambda x: NOT list_contains(ta, x))), ' ') AS ob
        FROM (SELECT p_partkey, list_distinct(list_filter(string_split_regex(lower({a}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS ta, list_distinct(string_split('{target}', ' ')) AS tb FROM part)))"""


@query(_ratio_sql("p_name", "small blue widget"))
def title_match(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(S.title_match(F.col("p_name"), ["small blue widget"]), 6).alias("score"))


@query(f"WITH {POSTINGS} SELECT posting_id FROM postings WHERE NOT ({VETO}) AND {FIT} <> 0.0")
def hard_filter(spark, d):
    fit = S.location_fit(F.col("locations"), F.col("remote_policy"), PROFILE)
    return postings(spark, d).where(S.passes(F.col("title"), fit, PROFILE, hard_location=True)).select("posting_id")


@query(f"WITH {POSTINGS} SELECT count(*) AS matches FROM postings WHERE status = 'open' AND NOT ({VETO})")
def count_matches(spark, d):
    return postings(spark, d).where("status = 'open'").where(~S.vetoed(F.col("title"), PROFILE)).agg(F.count("*").alias("matches"))


@query(f"WITH {POSTINGS}, {SKILLS}, {SCORED} SELECT posting_id, company, title, round(total, 6) AS total FROM scored ORDER BY total DESC, posting_id LIMIT 10")
def rank_top(spark, d):
    return shortlist.top(ranked(spark, d), 10).select("posting_id", "company", "title", F.round("total", 6).alias("total"))


def _best_title_sql() -> str:
    """The best token_set_ratio of a posting's title, as rows (p_partkey is the posting)."""
    return "(SELECT p_partkey AS posting_id, max(score) AS title_match FROM (" + " UNION ALL ".join(_ratio_sql("p_name", t) for t in PROFILE.target_titles) + ") GROUP BY p_partkey)"


TITLED = f"""titled AS (SELECT s.*, m.title_match, (CASE WHEN cov IS NULL THEN 0 ELSE 0.5 * cov END + 0.25 * m.title_match + 0.15 * rec + 0.1 * fit) / (CASE WHEN cov IS NULL THEN 0.5 ELSE 1.0 END) AS best
  FROM scored s JOIN (WITH part AS (SELECT posting_id AS p_partkey, title AS p_name FROM scored) SELECT * FROM {_best_title_sql()}) m USING (posting_id))"""


@query(f"WITH {POSTINGS}, {SKILLS}, {SCORED}, {TITLED} SELECT posting_id, title, title_match, round(best, 6) AS total, CASE WHEN cov IS NOT NULL THEN 'covers ' || n_covered || '/' || n_skills || ' skills · ' ELSE '' END || CASE WHEN title_match >= 0.8 THEN 'title · ' ELSE '' END || CAST(floor(age) AS BIGINT) || 'd' AS why FROM titled ORDER BY best DESC, posting_id LIMIT 10")
def rank_top_titles(spark, d):
    """The shortlist with fuzzy title matching, from stored postings, companies and extractions."""
    return shortlist.best(open_candidates(spark, d), PROFILE, NOW, 10).select("posting_id", "title", F.round("title_match", 6).alias("title_match"), F.round("total", 6).alias("total"), "why")


@query(f"WITH {POSTINGS}, {SKILLS}, {SCORED} SELECT posting_id, position, component, round(value, 6) AS value, weight, round(value * weight, 6) AS weighted FROM (SELECT posting_id, 0 AS position, 'skill_coverage' AS component, cov AS value, 0.5::DOUBLE AS weight FROM scored UNION ALL SELECT posting_id, 1, 'title_match', NULL, 0.25::DOUBLE FROM scored UNION ALL SELECT posting_id, 2, 'recency', rec, 0.15::DOUBLE FROM scored UNION ALL SELECT posting_id, 3, 'location_fit', fit, 0.1::DOUBLE FROM scored)")
def explain_rows(spark, d):
    return shortlist.explain(ranked(spark, d)).select("posting_id", "position", "component", F.round("value", 6).alias("value"), "weight", F.round("weighted", 6).alias("weighted"))


@query(f"WITH {POSTINGS}, {SKILLS}, {SCORED} SELECT posting_id, CASE WHEN cov IS NOT NULL THEN 'covers ' || n_covered || '/' || n_skills || ' skills · ' ELSE '' END || CAST(floor(age) AS BIGINT) || 'd' AS why FROM scored")
def why_summary(spark, d):
    return ranked(spark, d).select("posting_id", "why")


@query(f"WITH {POSTINGS} SELECT posting_id FROM postings WHERE status = 'open' AND NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = posting_id)")
def missing_extractions(spark, d):
    p = postings(spark, d).withColumn("content_hash", X.content_hash(F.col("body_text")))
    done = p.join(table(spark, d, "labels").select(F.col("doc_id").alias("posting_id")), "posting_id", "left_semi")
    memo = done.select("posting_id", "content_hash", F.lit("taxonomy").alias("kind"), F.lit(WORDS.version).alias("engine_version"))
    return tables.missing_extractions(p, memo, WORDS.version).select("posting_id")


@query(f"WITH {POSTINGS}, {SKILLS} SELECT posting_id, array_to_string(skills, ',') AS skills FROM skilled WHERE status = 'open' AND posting_id NOT IN (SELECT doc_id FROM labels)")
def extraction_backfill(spark, d):
    p = postings(spark, d).withColumn("content_hash", X.content_hash(F.col("body_text")))
    done = p.join(table(spark, d, "labels").select(F.col("doc_id").alias("posting_id")), "posting_id", "left_semi")
    memo = done.select("posting_id", "content_hash", F.lit("taxonomy").alias("kind"), F.lit(WORDS.version).alias("engine_version"))
    return tables.extract(tables.missing_extractions(p, memo, WORDS.version), WORDS).select("posting_id", F.array_join("skills", ",").alias("skills"))


@query("SELECT doc_id AS posting_id, CASE doc_id % 3 WHEN 0 THEN 'current' WHEN 1 THEN 'superseded' ELSE 'missing' END AS extraction FROM documents")
def current_vs_superseded(spark, d):
    p = postings(spark, d).withColumn("content_hash", X.content_hash(F.col("body_text"))).select("posting_id", "content_hash")
    memo = p.select("posting_id", "content_hash", F.lit("taxonomy").alias("kind"), F.expr("element_at(array('{0}', 'old', null), cast(posting_id % 3 + 1 as int))".format(WORDS.version)).alias("engine_version"))
    return tables.extraction_state(p, memo.where("engine_version is not null"), WORDS.version).select("posting_id", "extraction")


HISTORY = """days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), brd AS (SELECT DISTINCT event_type AS board FROM events),
scans AS (SELECT board, date_diff('day', DATE '2024-01-01', day) AS seq, CASE day(day) % 7 WHEN 3 THEN 'partial' WHEN 5 THEN 'failed' WHEN 6 THEN 'unchanged' ELSE 'complete' END AS status FROM brd, days),
listings AS (SELECT event_type AS board, user_id AS posting_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS seq, arg_max(props, event_id) AS content_hash FROM events GROUP BY ALL),
live AS (SELECT *, sum(CASE WHEN status = 'complete' THEN 1 ELSE 0 END) OVER (PARTITION BY board ORDER BY seq) AS cc FROM scans WHERE status IN ('complete', 'partial')),
good AS (SELECT l.* FROM listings l JOIN live USING (board, seq)), firsts AS (SELECT board, posting_id, min(seq) AS first FROM good GROUP BY ALL),
spine AS (SELECT f.board, f.posting_id, v.seq, v.cc, g.content_hash, count(g.content_hash) OVER (PARTITION BY f.board, f.posting_id ORDER BY v.seq) AS island FROM firsts f JOIN live v ON v.board = f.board AND v.seq >= f.first LEFT JOIN good g ON g.board = f.board AND g.posting_id = f.posting_id AND g.seq = v.seq),
missed AS (SELECT *, least(2, cc - first_value(cc) OVER i) AS miss, first_value(content_hash) OVER i AS last_hash FROM spine WINDOW i AS (PARTITION BY board, posting_id, island ORDER BY seq)),
hist AS (SELECT *, lag(miss) OVER w AS pm, lag(last_hash) OVER w AS ph FROM missed WINDOW w AS (PARTITION BY board, posting_id ORDER BY seq)),
evs AS (SELECT board, posting_id, seq, 'new' AS kind FROM hist WHERE ph IS NULL UNION ALL SELECT board, posting_id, seq, 'reopened' FROM hist WHERE content_hash IS NOT NULL AND pm >= 2 UNION ALL SELECT board, posting_id, seq, 'revised' FROM hist WHERE content_hash IS NOT NULL AND ph <> content_hash UNION ALL SELECT board, posting_id, seq, 'closed' FROM hist WHERE content_hash IS NULL AND miss = 2 AND pm = 1)"""


def history(spark, d):
    return state.replay_history(scans(spark, d), listings(spark, d))


@query(f"WITH {HISTORY} SELECT board, posting_id, CAST(seq AS INT) AS seq, kind FROM evs")
def state_events(spark, d):
    return state.history_events(history(spark, d))


@query(f"WITH {HISTORY} SELECT board, posting_id, CASE WHEN arg_max(miss, seq) >= 2 THEN 'closed' ELSE 'open' END AS status, CAST(arg_max(miss, seq) AS BIGINT) AS missing, arg_max(last_hash, seq) AS content_hash FROM hist GROUP BY board, posting_id")
def state_final(spark, d):
    return state.history_final(history(spark, d)).withColumn("missing", F.col("missing").cast("long"))


@query(f"WITH {HISTORY}, n AS (SELECT board, seq, count(*) AS listed FROM good GROUP BY ALL) SELECT s.board, CAST(s.seq AS INT) AS seq, s.status, coalesce(n.listed, 0) AS listed FROM scans s LEFT JOIN n USING (board, seq)")
def board_scan_log(spark, d):
    s = scans(spark, d)
    n = listings(spark, d).join(s.where("status in ('complete', 'partial')"), ["board", "seq"], "left_semi").groupBy("board", "seq").agg(F.count("*").alias("listed"))
    return s.join(n, ["board", "seq"], "left").select("board", "seq", "status", F.coalesce("listed", F.lit(0)).alias("listed"))


@query(f"WITH {HISTORY} SELECT seq, count(*) AS boards_attempted, CAST(sum(ok) AS BIGINT) AS boards_complete, CAST(sum(listed) AS BIGINT) AS postings_seen, CAST(sum(n) AS BIGINT) AS new_count, CAST(sum(r) AS BIGINT) AS reopened_count, CAST(sum(c) AS BIGINT) AS closed_count FROM (SELECT CAST(s.seq AS INT) AS seq, CASE WHEN s.status = 'complete' THEN 1 ELSE 0 END AS ok, (SELECT count(*) FROM good g WHERE g.board = s.board AND g.seq = s.seq) AS listed, (SELECT count(*) FROM evs e WHERE e.board = s.board AND e.seq = s.seq AND kind = 'new') AS n, (SELECT count(*) FROM evs e WHERE e.board = s.board AND e.seq = s.seq AND kind = 'reopened') AS r, (SELECT count(*) FROM evs e WHERE e.board = s.board AND e.seq = s.seq AND kind = 'closed') AS c FROM scans s) GROUP BY seq")
def run_summary(spark, d):
    counts = board_counters(spark, d)
    log = board_scan_log(spark, d).join(counts, ["board", "seq"], "left")
    return log.groupBy("seq").agg(F.count("*").alias("boards_attempted"), F.count_if(F.col("status") == "complete").alias("boards_complete"), F.sum("listed").alias("postings_seen"), *(F.sum(F.coalesce(k, F.lit(0))).alias(f"{k}_count") for k in ("new", "reopened", "closed")))


@query(f"WITH {HISTORY} SELECT board, CAST(seq AS INT) AS seq, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("new", "reopened", "revised", "closed")) + " FROM evs GROUP BY board, seq")
def board_counters(spark, d):
    return state.board_counters(state_events(spark, d))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0 AND s_nationkey = 3")
def watched_filter(spark, d):
    c = table(spark, d, "supplier").select("s_suppkey", "s_name", (F.col("s_acctbal") > 0).alias("watched"), F.col("s_nationkey").cast("string").alias("provider"), F.lower("s_name").alias("slug"))
    return tables.watched(c, provider="3").select("s_suppkey", "s_name")


@query("SELECT coalesce(s_suppkey, c_custkey) AS id, coalesce(s_name, c_name) AS name, c_custkey IS NOT NULL AS watched FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def upsert_company(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(False).alias("watched"))
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(True).alias("watched"))
    return tables.upsert(old, new, ["id"], ["watched"])


@query("SELECT 1 AS id, 'new' AS text, count(*) AS n_skills FROM region")
def upsert_profile(spark, d):
    old = spark.range(1, 2).select(F.col("id").cast("int").alias("id"), F.lit("old").alias("text"), F.lit(0).cast("long").alias("n_skills"))
    new = table(spark, d, "region").agg(F.count("*").alias("n_skills")).select(F.lit(1).alias("id"), F.lit("new").alias("text"), "n_skills")
    return tables.upsert(old, new, ["id"], ["text", "n_skills"])


@query("SELECT coalesce(doc_id, page_id) AS page_id, CASE WHEN doc_id IS NOT NULL THEN 'new' ELSE 'old' END AS etag FROM pages FULL JOIN documents ON doc_id = page_id")
def validators_upsert(spark, d):
    old, new = table(spark, d, "pages").select("page_id", F.lit("old").alias("etag")), table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.lit("new").alias("etag"))
    return tables.upsert(old, new, ["page_id"], ["etag"])


@query("SELECT c_custkey, CASE WHEN c_mktsegment = n_name THEN c_mktsegment ELSE c_mktsegment || '|' || n_name END AS places FROM customer JOIN nation ON c_nationkey = n_nationkey")
def locations_dedupe(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(n, "c_nationkey").select("c_custkey", F.array_join(boards._dedup(F.array("c_mktsegment", "n_name", "c_mktsegment", F.lit(""))), "|").alias("places"))


@query("SELECT o_orderkey, CASE WHEN contains(lower(o_orderpriority), 'not') THEN 'remote' ELSE 'unknown' END AS policy FROM orders")
def remote_policy(spark, d):
    return table(spark, d, "orders").select("o_orderkey", boards.remote_policy(F.array(F.replace(F.lower("o_orderpriority"), F.lit("not"), F.lit("Remote")))).alias("policy"))


@query("SELECT event_id, date_trunc('millisecond', ts) AS at FROM events")
def epoch_ms(spark, d):
    return table(spark, d, "events").select("event_id", boards.epoch_ms(F.unix_millis(F.col("ts").cast("timestamp"))).alias("at"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN date_trunc('second', ts) END AS at FROM events")
def iso_parse(spark, d):
    text = F.when(F.col("event_id") % 3 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return table(spark, d, "events").select("event_id", boards.iso_time(text).alias("at"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS board, CASE WHEN s_suppkey % 4 = 3 THEN 'failed' WHEN s_suppkey % 4 = 2 THEN 'partial' ELSE 'complete' END AS status, CASE WHEN s_suppkey % 4 = 3 THEN 0 WHEN s_suppkey % 4 = 2 THEN 1 ELSE 2 END::BIGINT AS listed FROM supplier")
def snapshot_status(spark, d):
    body = F.when(F.col("s_suppkey") % 4 == 3, "{}").when(F.col("s_suppkey") % 4 == 2, '{"jobs":[{"id":1,"title":"a"},{"id":2}]}').otherwise('{"jobs":[{"id":1,"title":"a"},{"id":2,"title":"b"}]}')
    p = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("board"), body.alias("content"))
    return boards.snapshot_status(boards.parse(p, "greenhouse")).select("board", "status", "listed")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN known THEN o_totalprice END AS salary_min, CASE WHEN known THEN o_totalprice + 1 END AS salary_max, CASE WHEN known THEN 'USD' END AS salary_currency, CASE WHEN known THEN CASE WHEN o_orderstatus = 'F' THEN 'year' ELSE 'hour' END END AS salary_period FROM (SELECT *, o_orderstatus <> 'P' AS known FROM orders)")
def compensation(spark, d):
    interval = F.when(F.col("o_orderstatus") == "F", "1 YEAR").when(F.col("o_orderstatus") == "P", "1 AGE").otherwise("1 HOUR")
    part = F.array(F.struct(F.lit("Salary").alias("compensationType"), interval.alias("interval"), F.lit("USD").alias("currencyCode"), F.col("o_totalprice").alias("minValue"), (F.col("o_totalprice") + 1).alias("maxValue")))
    job = F.struct(F.col("o_orderkey").alias("id"), F.lit("t").alias("title"), F.struct(F.array(F.struct(part.alias("components"))).alias("compensationTiers")).alias("compensation"))
    p = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("board"), F.to_json(F.struct(F.array(job).alias("jobs"))).alias("content"))
    return boards.parse(p, "ashby").select(F.col("provider_posting_id").alias("id"), "salary_min", "salary_max", "salary_currency", "salary_period")


@query("SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'unreachable' WHEN 1 THEN 'dead' WHEN 2 THEN 'error' ELSE CASE WHEN n IS NULL THEN 'empty' ELSE 'ok' END END AS health FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def health_map(spark, d):
    """Customers as boards, their orders as jobs."""
    jobs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    m = F.col("c_nationkey") % 4
    code = F.when(m == 1, 404).when(m == 2, 500).when(m == 3, 200)
    return table(spark, d, "customer").join(jobs, "c_custkey", "left").select("c_custkey", boards.health(code, F.coalesce("n", F.lit(0))).alias("health"))


@query("SELECT content_hash, count(*) AS n FROM (SELECT sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS content_hash FROM documents) GROUP BY content_hash HAVING count(*) > 1")
def content_twins(spark, d):
    return table(spark, d, "documents").groupBy(X.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", boards._get(F.try_parse_json("props"), "$.k", "long").alias("k"))


# Sentences of our own that hold taxonomy terms, and some that only look like them.
SENTENCES = [
    "We write Python and Go services on Kubernetes with PostgreSQL.", "Ready to go to market in spring 2024.", "Spring Boot, Kafka and Redis behind REST APIs.", "React and TypeScript, some Node.js and GraphQL.",
    "PyTorch models, RAG pipelines and LLM tooling on AWS.", "The rest of the team reacts to mail.", "Terraform, Docker and CI/CD with GitHub Actions.", "C++ or Rust, and C# with .NET Core.",
    "Spark, Airflow and Snowflake for data; dbt is a plus.", "No terms here.",
]


def _re2(pattern: str) -> str:
    """A condition on ``t`` for RE2, which looks neither ahead nor behind: what the look-around forbids is taken out first."""
    import re

    held = "t"
    for ahead in re.findall(r"(\\b[A-Za-z]+\\b)\(\?!((?:[^()]|\([^()]*\))*)\)", pattern):
        held = f"regexp_replace({held}, '{ahead[0]}{ahead[1]}', ' ', 'g')"
        pattern = pattern.replace(f"(?!{ahead[1]})", "")
    for behind in re.findall(r"\(\?<!([^()]*)\)", pattern):
        held = f"regexp_replace({held}, '{behind}\\.', ' ', 'g')" if behind else held
        pattern = pattern.replace(f"(?<!{behind})", "")
    return f"regexp_matches({held}, '{pattern}')"


def _bundled_sql() -> str:
    from .functions.taxonomy import load

    cases = ", ".join(f"CASE WHEN {_re2(('' if p.case_sensitive else '(?i)') + p.pattern)} THEN '{p.name}' END" for p in load().patterns)
    listed = ", ".join(f"'{x}'" for x in SENTENCES)
    return rf"WITH x AS (SELECT doc_id AS posting_id, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') || ' ' || [{listed}][doc_id % {len(SENTENCES)} + 1] AS t FROM documents), y AS (SELECT posting_id, list_sort(list_filter([{cases}], lambda n: n IS NOT NULL)) AS skills FROM x) SELECT posting_id, array_to_string(skills, ',') AS skills, len(skills) AS n FROM y WHERE len(skills) > 0"


@query(_bundled_sql())
def bundled_skills(spark, d):
    """The bundled taxonomy over every document with a sentence of an advertisement after it."""
    from .functions.taxonomy import load

    said = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.col("posting_id") % len(SENTENCES) + 1).cast("int"))
    p = postings(spark, d).withColumn("body_text", F.concat_ws(" ", "body_text", said)).withColumn("content_hash", F.lit(""))
    return tables.extract(p, load()).where("size(skills) > 0").select("posting_id", F.array_join("skills", ",").alias("skills"), F.size("categories").cast("long").alias("n"))


# Payloads of one board for each document, in each layout: good, broken and partial jobs.
@query(r"""WITH d AS (SELECT *, regexp_replace(substring(text, 1, 20), '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS board, 0 AS pos, CAST(doc_id AS VARCHAR) AS id, t AS title, lang || '|' || source AS places, source AS department, 'R&D <' || lang || '>' || chr(10) || 'é' AS body, 'unknown' AS policy, TIMESTAMP '2024-01-02 01:04:05' AS posted_at, NULL AS error FROM d
UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, CAST(-doc_id AS VARCHAR), NULL, '', NULL, '', 'unknown', NULL, 'missing title' FROM d WHERE doc_id % 3 = 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, CAST(-doc_id AS VARCHAR), '', 'Remote ' || lang, NULL, '', 'remote', NULL, 'empty title' FROM d WHERE doc_id % 3 = 1
UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, 'None', 'ok', 'Remote ' || lang, NULL, '', 'remote', NULL, NULL FROM d WHERE doc_id % 3 = 2""")
def board_greenhouse(spark, d):
    return _parsed(_greenhouse(spark, d), "greenhouse")


def _parsed(payloads, layout, *more):
    return boards.parse(payloads, layout).select("board", "pos", F.col("provider_posting_id").alias("id"), "title", F.array_join("locations", "|").alias("places"), "department", F.col("body_text").alias("body"), F.col("remote_policy").alias("policy"), "posted_at", *more, "error")


def _greenhouse(spark, d):
    third = F.when(F.col("doc_id") % 3 == 0, F.format_string('{"id":%d}', -F.col("doc_id"))).when(F.col("doc_id") % 3 == 1, F.format_string('{"id":%d,"title":" \\t","location":{"name":"Remote %s"}}', -F.col("doc_id"), "lang")).otherwise(F.format_string('{"id":null,"title":"old","title":"ok","location":{"name":"Remote %s"}}', "lang"))
    name = lambda c: F.struct(F.col(c).alias("name"))
    content = F.concat(F.lit("&lt;div title=&quot;a&gt;b&quot;&gt;R&amp;amp;D &amp;lt;"), "lang", F.lit("&amp;gt;&lt;/div&gt;&amp;#233;"))
    job = F.struct(F.col("doc_id").alias("id"), F.concat(F.lit(" "), F.substring("text", 1, 20)).alias("title"), content.alias("content"), name("lang").alias("location"), F.array(name("source"), name("lang")).alias("offices"), F.array(name("source")).alias("departments"), F.lit("2024-01-02T03:04:05+02:00").alias("first_published"))
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("board"), F.concat(F.lit('{"jobs":['), F.to_json(job), F.lit(","), third, F.lit("]}")).alias("content"))


@query(r"""SELECT CAST(doc_id AS VARCHAR) AS board, 0 AS pos, CAST(doc_id AS VARCHAR) AS id, 'Clerk' AS title, CASE doc_id % 3 WHEN 0 THEN lang || '|' || lang WHEN 1 THEN source ELSE '' END AS places, source AS department, substring(text, 1, 30) || chr(10) || chr(10) || 'more' AS body, 'unknown' AS policy,
  CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE TIMESTAMP '2023-11-14 22:13:20.123' + to_seconds(doc_id) END AS posted_at, CASE WHEN doc_id % 5 = 0 THEN 'time out of range' END AS error FROM documents""")
def board_lever(spark, d):
    return _parsed(_lever(spark, d), "lever")


def _lever(spark, d):
    created = F.expr("case doc_id % 5 when 0 then '9223372036854775807' when 1 then '\"soon\"' else cast(1700000000123 + doc_id * 1000 as string) end")
    every = F.expr("case doc_id % 3 when 0 then array(lang, '', lang) when 2 then array('') end")
    job = F.struct(F.col("doc_id").alias("id"), F.lit("Clerk").alias("text"), F.struct(F.col("source").alias("team"), F.col("source").alias("location"), every.alias("allLocations")).alias("categories"), F.substring("text", 1, 30).alias("descriptionPlain"), F.lit("more").alias("additionalPlain"))
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("board"), F.concat(F.lit("["), F.regexp_replace(F.to_json(job), r"\}$", ""), F.lit(',"createdAt":'), created, F.lit("}]")).alias("content"))


@query(r"""WITH d AS (SELECT *, doc_id % 7 AS m FROM documents) SELECT CAST(doc_id AS VARCHAR) AS board, 0 AS pos, CAST(doc_id AS VARCHAR) AS id, 'Clerk' AS title, lang || '|' || source AS places, lang AS department, lang AS body, CASE WHEN m = 1 THEN 'remote' ELSE 'unknown' END AS policy, TIMESTAMP '2024-01-02 00:00:00' AS posted_at,
  CASE WHEN m = 1 THEN CAST(doc_id + 0.5 AS DOUBLE) END AS salary_min, CASE WHEN m < 2 THEN CAST(9 AS DOUBLE) END AS salary_max, CASE WHEN m < 2 OR m = 6 THEN 'EUR' END AS salary_currency, CASE WHEN m < 2 OR m = 6 THEN 'year' END AS salary_period, CASE WHEN m = 6 THEN 'pay is no number' END AS error FROM d""")
def board_ashby(spark, d):
    return _parsed(_ashby(spark, d), "ashby", "salary_min", "salary_max", "salary_currency", "salary_period")


def _ashby(spark, d):
    """Pay by the remainder of 7: one-sided, two-sided, equity, two parts, unknown interval, no currency, no number."""
    m = F.col("doc_id") % 7
    part = F.struct(
        F.when(m == 2, "Equity").otherwise("Salary").alias("compensationType"), F.when(m == 4, "1 AGE").otherwise("1 year").alias("interval"), F.when(m != 5, "EUR").alias("currencyCode"),
        F.when(m == 6, "much").when(m > 0, F.concat(F.col("doc_id").cast("string"), F.lit(".5"))).alias("minValue"), F.when(m != 6, 9).alias("maxValue"),
    )
    parts = F.when(m == 3, F.array(part, part)).otherwise(F.array(part))
    job = F.struct(F.col("doc_id").alias("id"), F.lit("Clerk").alias("title"), F.col("lang").alias("location"), F.array(F.struct(F.col("source").alias("location")), F.struct(F.col("lang").alias("location"))).alias("secondaryLocations"), F.col("lang").alias("department"), F.format_string("<p>%s</p><script>x</script>", "lang").alias("descriptionHtml"), (m == 1).alias("isRemote"), F.lit("2024-01-02").alias("publishedAt"), F.struct(F.array(F.struct(parts.alias("components"))).alias("compensationTiers")).alias("compensation"))
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("board"), F.to_json(F.struct(F.array(job).alias("jobs"))).alias("content"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS board, 7::BIGINT AS run_id, CASE WHEN doc_id % 5 = 4 THEN 'failed' WHEN doc_id % 3 = 2 THEN 'complete' ELSE 'partial' END AS status, CASE WHEN doc_id % 5 = 4 THEN 0 WHEN doc_id % 3 = 2 THEN 2 ELSE 1 END::BIGINT AS listed, CASE WHEN doc_id % 5 = 4 THEN 'invalid board payload: not JSON' END AS error, CASE WHEN doc_id % 5 = 4 THEN 'invalid board payload: not JSON' WHEN doc_id % 3 = 0 THEN '1 of 2 jobs failed to parse: job ' || -doc_id || ': missing title' WHEN doc_id % 3 = 1 THEN '1 of 2 jobs failed to parse: job ' || -doc_id || ': empty title' END AS told FROM documents""")
def scan_log(spark, d):
    p = _greenhouse(spark, d).withColumn("content", F.when(F.col("board").cast("long") % 5 == 4, "<html>").otherwise(F.col("content")))
    status = boards.snapshot_status(boards.parse(p, "greenhouse"))
    return boards.scan_rows(status, 7, F.lit(NOW)).join(status.select("board", F.col("error").alias("told")), "board").select("board", "run_id", "status", "listed", "error", "told")


FAMILIES = "['iOS Engineer', 'Site Reliability Engineer', 'Analytics Engineer', 'Machine Learning Scientist', 'Full-Stack Developer', 'Front End Developer', 'Back-end Developer', 'AppSec Analyst', 'Clerk']"


@query(f"SELECT p_partkey, ['mobile', 'devops_sre', 'data_eng', 'ml_ai', 'fullstack', 'frontend', 'backend', 'security', 'general_swe'][p_partkey % 9 + 1] AS family FROM part")
def role_families(spark, d):
    title = F.element_at(F.expr(f"array({FAMILIES[1:-1]})"), (F.col("p_partkey") % 9 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", X.role_family(F.concat_ws(" ", title, "p_type")).alias("family"))


@query(f"WITH {POSTINGS} SELECT posting_id, n_nationkey AS company_id, title, CASE WHEN l.doc_id IS NOT NULL THEN 'x' END AS skill FROM postings JOIN nation ON company = 'src' || n_nationkey LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = posting_id WHERE status = 'open'")
def shortlist_candidates(spark, d):
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("company_id"), F.concat(F.lit("src"), "n_nationkey").alias("company"))
    p = postings(spark, d).join(names, "company").drop("company").withColumn("content_hash", X.content_hash(F.col("body_text")))
    done = p.join(table(spark, d, "labels").select(F.col("doc_id").alias("posting_id")).distinct(), "posting_id", "left_semi")
    memo = done.select("posting_id", "content_hash", F.lit("taxonomy").alias("kind"), F.lit(WORDS.version).alias("engine_version"), F.array(F.lit("x")).alias("skills"))
    return shortlist.candidates(p, names, memo, WORDS.version).select("posting_id", "company_id", "title", F.get("skills", F.lit(0)).alias("skill"))


@query(f"WITH {POSTINGS}, {SKILLS}, {SCORED} SELECT posting_id, position, detail FROM (SELECT posting_id, 0 AS position, CASE WHEN cov IS NOT NULL THEN 'covers ' || n_covered || '/' || n_skills || ' skills' ELSE 'no recognized skills in this posting' END AS detail FROM scored UNION ALL SELECT posting_id, 1, 'no target titles set' FROM scored UNION ALL SELECT posting_id, 2, 'exp decay, half-life 14d' FROM scored UNION ALL SELECT posting_id, 3, 'exact / remote-OK / mismatch -> 1 / 0.5 / 0' FROM scored)")
def component_details(spark, d):
    return shortlist.explain(ranked(spark, d)).select("posting_id", "position", "detail")


@query(f"WITH {HISTORY} SELECT CAST(seq AS INT) AS seq, count(*) AS boards_attempted, count(*) FILTER (status = 'complete') AS boards_complete, count(*) FILTER (status = 'failed') AS n_errors FROM scans GROUP BY seq")
def run_rollup(spark, d):
    counts = board_counters(spark, d)
    log = board_scan_log(spark, d).join(counts, ["board", "seq"], "left").withColumn("error", F.concat(F.lit("no answer of "), "board"))
    return tables.run_summary(log, ("seq",)).select("seq", "boards_attempted", "boards_complete", "n_errors")


@query(f"""WITH {HISTORY} SELECT 0::BIGINT + id AS id, board, posting_id, seq, kind FROM (SELECT i AS id, 'b' AS board, 0::BIGINT AS posting_id, 0 AS seq, 'new' AS kind FROM range(1, 6) r(i)
UNION ALL SELECT 5 + row_number() OVER (ORDER BY seq, board, kind = 'closed', posting_id, list_position(['new', 'reopened', 'revised', 'closed'], kind)), board, posting_id, CAST(seq AS INT), kind FROM evs)""")
def event_log(spark, d):
    """All events of the history, numbered in their order after a log of five."""
    log = spark.range(1, 6).selectExpr("id", "'b' as board", "cast(0 as bigint) as posting_id", "0 as seq", "'new' as kind")
    return state.append_events(log, state_events(spark, d), "seq")


@query("""WITH s AS (SELECT source AS board, CASE (ascii(right(source, 1)) % 4) WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' ELSE 'complete' END AS scan FROM documents GROUP BY ALL),
x AS (SELECT doc_id, source, scan, doc_id % 5 <> 0 AS known, doc_id % 2 = 0 AS was_closed, doc_id % 3 <> 0 AND scan IN ('complete', 'partial') AS listed, doc_id % 7 = 0 AS edited, doc_id % 11 = 0 AS missed_before FROM documents JOIN s ON board = source)
SELECT doc_id AS posting_id, CASE WHEN listed THEN 'open' WHEN was_closed THEN 'closed' WHEN scan = 'complete' AND missed_before THEN 'closed' ELSE 'open' END AS status,
  CASE WHEN listed THEN 0 WHEN was_closed THEN 2 WHEN scan = 'complete' THEN CASE WHEN missed_before THEN 2 ELSE 1 END ELSE CASE WHEN missed_before THEN 1 ELSE 0 END END AS missing,
  CASE WHEN listed THEN 'new title' ELSE 'old title' END AS title, CASE WHEN listed THEN 'remote' ELSE 'unknown' END AS remote_policy, CASE WHEN listed AND (edited OR NOT known) THEN 'new body' ELSE 'old body' END AS body_text,
  CASE WHEN listed AND NOT known THEN 'new' WHEN listed AND was_closed AND edited THEN 'reopened,revised' WHEN listed AND was_closed THEN 'reopened' WHEN listed AND edited THEN 'revised' WHEN NOT listed AND NOT was_closed AND scan = 'complete' AND missed_before THEN 'closed' END AS kinds FROM x WHERE known OR listed""")
def apply_scan(spark, d):
    """One scan of every board on a state made of the documents."""
    t = table(spark, d, "documents").select(F.col("source").alias("board"), F.col("doc_id").alias("posting_id"))
    old = t.where("posting_id % 5 != 0").selectExpr("*", "'h' as content_hash", "'old body' as body_text", "'old title' as title", "'unknown' as remote_policy", "if(posting_id % 2 = 0, 'closed', 'open') as status", "case when posting_id % 2 = 0 then 2 when posting_id % 11 = 0 then 1 else 0 end as missing", f"timestamp_ntz'{NOW}' as first_seen", f"timestamp_ntz'{NOW}' as last_seen", "cast(null as timestamp_ntz) as closed_at")
    new = t.where("posting_id % 3 != 0").selectExpr("*", "if(posting_id % 7 = 0, 'g', 'h') as content_hash", "'new body' as body_text", "'new title' as title", "'remote' as remote_policy")
    scan = t.select("board").distinct().selectExpr("board", "element_at(array('complete', 'partial', 'failed', 'complete'), ascii(right(board, 1)) % 4 + 1) as status")
    out, events = state.apply_snapshot(old, new, scan, F.lit(NOW))
    kinds = events.groupBy("board", "posting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))
    return out.join(kinds, ["board", "posting_id"], "left").select("posting_id", "status", "missing", "title", "remote_policy", "body_text", "kinds")


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'e' || c_custkey ELSE 'old' END AS etag, c_acctbal > 0 AS cached FROM customer WHERE c_acctbal > 0 OR c_nationkey % 2 = 0")
def persisted_validators(spark, d):
    """Validators after a scan, from complete scans that showed some; then the requests that will send them."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey", F.col("c_custkey").cast("string").alias("url"))
    cache = c.where("c_acctbal > 0").select("url", F.lit("old").alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    seen = c.select("url", F.when(F.col("c_nationkey") % 2 == 0, "complete").when(F.col("c_nationkey") % 5 == 0, "complete").otherwise("partial").alias("status"), F.when((F.col("c_nationkey") % 2 == 0) | (F.col("c_nationkey") % 5 != 0), F.concat(F.lit("e"), "url")).alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    return tables.requests(c, tables.persist_validators(cache, seen)).where("etag is not null").select("c_custkey", "etag", (F.col("c_acctbal") > 0).alias("cached"))


@query("SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS provider FROM supplier WHERE s_acctbal > 0")
def watched_providers(spark, d):
    return tables.providers(table(spark, d, "supplier").select((F.col("s_acctbal") > 0).alias("watched"), F.col("s_nationkey").cast("string").alias("provider")))


@query("SELECT doc_id, text FROM documents WHERE doc_id = (SELECT min(doc_id) FROM labels)")
def posting_lookup(spark, d):
    wanted = table(spark, d, "labels").agg(F.min("doc_id")).scalar()
    return tables.by_id(table(spark, d, "documents"), "doc_id", wanted).select("doc_id", "text")


@query("SELECT 3::BIGINT AS run_id, TIMESTAMP '2024-01-31 00:00:00' AS started_at, count(*) AS boards_attempted, count(*) FILTER (status = 'complete') AS boards_complete, TIMESTAMP '2024-02-01 00:00:00' AS finished_at FROM (" + f"WITH {HISTORY} SELECT * FROM scans" + ")")
def run_record(spark, d):
    """A run that is opened after two others and finalized with the summary of its scans."""
    runs = spark.range(1, 3).selectExpr("id as run_id", "timestamp_ntz'2024-01-01 00:00:00' as started_at", "timestamp_ntz'2024-01-01 01:00:00' as finished_at", "1L as boards_attempted", "1L as boards_complete")
    log = board_scan_log(spark, d).selectExpr("*", "0L as new", "0L as reopened", "0L as closed", "'x' as error")
    out = tables.finalize_run(tables.open_run(runs, F.lit(NOW)), 3, tables.run_summary(log), F.lit("2024-02-01 00:00:00"))
    return tables.by_id(out, "run_id", 3).select("run_id", "started_at", "boards_attempted", "boards_complete", "finished_at")


@query(rf"SELECT p_partkey, list_sort(list_filter([" + ", ".join(rf"CASE WHEN regexp_matches(p_name || ' {p.name} x', '(?i)\b{p.name}\b') AND p_partkey % 2 = 0 THEN '{p.name}' END" for p in WORDS.patterns[:1]) + "], lambda x: x IS NOT NULL)) AS skills, p_partkey % 2 = 0 AS stale FROM part")
def profile_refresh(spark, d):
    """Profiles of another taxonomy version get their skills anew; the others keep what they have."""
    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" the x")).alias("text"), F.array().cast("array<string>").alias("skills"), F.when(F.col("p_partkey") % 2 == 0, "old").otherwise(WORDS.version).alias("taxonomy_version"))
    stale = tables.stale_profile(p, WORDS.version).select("p_partkey", F.lit(True).alias("stale"))
    return tables.refresh_profile(p, WORDS).join(stale, "p_partkey", "left").select("p_partkey", "skills", F.coalesce("stale", F.lit(False)).alias("stale"))


@query("SELECT p_partkey, string_split(p_name, ' ') AS parts, lower(p_brand) AS slug, array_to_string(list_transform(string_split(lower(replace(p_name, ' ', '-')), '-'), lambda w: upper(w[1]) || w[2:]), '-') AS name FROM part")
def list_fields(spark, d):
    t = table(spark, d, "part")
    return t.select("p_partkey", X.split_csv(F.concat(F.lit("\n, "), F.replace("p_name", F.lit(" "), F.lit(" ,\n")), F.lit(","))).alias("parts"), X.slug(F.concat(F.lit(" "), "p_brand")).alias("slug"), X.display_name(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name"))


@query("SELECT coalesce(l.doc_id, d.doc_id) AS posting_id, CASE WHEN l.doc_id IS NOT NULL THEN 'kept' ELSE 'added' END AS payload FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def insert_extractions(spark, d):
    """Extractions are inserted once: what the memo has stays as it is."""
    row = lambda t, said: t.select(F.col("doc_id").alias("posting_id"), F.lit("h").alias("content_hash"), F.lit("taxonomy").alias("kind"), F.lit("v").alias("engine_version"), F.lit(said).alias("payload"))
    keys = ["posting_id", "content_hash", "kind", "engine_version"]
    return tables.insert_if_absent(row(table(spark, d, "labels").select("doc_id").distinct(), "kept"), row(table(spark, d, "documents"), "added"), keys).select("posting_id", "payload")


ALL_SCORED = SCORED.replace(f" AND NOT ({VETO})", "")


@query(f"WITH {POSTINGS}, {SKILLS}, {ALL_SCORED} SELECT p.posting_id, p.status, round(total, 6) AS total, CASE WHEN p.status = 'closed' THEN 'closed — not ranked' ELSE CASE WHEN cov IS NOT NULL THEN 'covers ' || n_covered || '/' || n_skills || ' skills · ' ELSE '' END || CAST(floor(age) AS BIGINT) || 'd' END AS why FROM postings p LEFT JOIN scored USING (posting_id)")
def shown_postings(spark, d):
    """Every posting as it is shown: open ones with their score from the memo, closed ones without."""
    return shortlist.shown(*stored(spark, d), WORDS.version, UNTITLED, NOW).select("posting_id", "status", F.round("total", 6).alias("total"), "why")


@query(f"WITH {POSTINGS}, {SKILLS} SELECT posting_id, array_to_string(skills, ',') AS skills FROM skilled WHERE status = 'open'")
def preflight_backfill(spark, d):
    """The memo after two backfills in batches: of the labelled postings first, then of what is still missing."""
    p, path = stored(spark, d)[0], new_path(spark, "memo")
    known = p.join(table(spark, d, "labels").select(F.col("doc_id").alias("posting_id")).distinct(), "posting_id", "left_semi")
    for todo in (known, p):
        backfill.backfill(todo, path, WORDS, batch=max(1, p.count() // 3))
    return backfill.memo(spark, path).select("posting_id", F.array_join("skills", ",").alias("skills"))


@query("SELECT doc_id AS posting_id, doc_id % 4 < 3 AS vetoed, CASE WHEN doc_id % 3 < 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS fit, CASE WHEN doc_id % 3 < 2 THEN 'remote' ELSE 'unknown' END AS policy FROM documents")
def folded_matches(spark, d):
    """Vetoes, places and policies that only meet when case is folded."""
    p = S.Profile(exclude_titles=["HAUPTSTRASSE", "İnanilmaz"], locations=["GROSSE BLEICHEN"])
    pick = lambda n, *words: F.element_at(F.array(*map(F.lit, words)), (F.col("doc_id") % n + 1).cast("int"))
    title = F.concat(F.substring("text", 1, 30), pick(4, " Hauptstraße 1", " HAUPTSTRAẞE", " i̇NANILMAZ", " Hauptgasse"))
    places = F.array(pick(3, "große bleichen", "x", "Kleine Bleichen"), pick(3, "RemotE", "Große Bleichen, remoTe", "y"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("posting_id"), S.vetoed(title, p).alias("vetoed"), S.location_fit(places, F.lit("unknown"), p).alias("fit"), boards.remote_policy(places).alias("policy"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN ts - INTERVAL 90 MINUTE WHEN 3 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('week', ts) END::TIMESTAMP AS at FROM events""")
def iso_forms(spark, d):
    """Basic and extended, calendar and week dates, with and without an offset; a month alone is no time."""
    say = lambda f: F.date_format("ts", f)
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), "ts").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    forms = [say("yyyyMMdd'T'HHmmss"), F.concat(week, F.lit("-"), (F.weekday("ts") + 1).cast("string"), say("'T'HH:mm")), say("yyyy-MM-dd HH:mm:ss.SSSSSS'+0130'"), say("yyyyMMdd"), week, say("yyyy-MM")]
    text = F.coalesce(*(F.when(F.col("event_id") % 6 == k, f) for k, f in enumerate(forms)))
    return table(spark, d, "events").select("event_id", boards.iso_time(text).alias("at"))


@query(SQL["state_events"])
def streamed_events(spark, d):
    """The history as a stream, its state kept by Spark; the events are those of the whole history."""
    rows = fold.scan_rows(scans(spark, d), listings(spark, d))
    source, sink, marks = (new_path(spark, x) for x in ("scans", "streamed", "marks"))
    rows.write.parquet(source)
    out = fold.stream_events(spark.readStream.schema(rows.schema).parquet(source), parts=4).withColumn("seq", F.col("seq").cast("int"))
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


@query("""WITH x AS (SELECT doc_id, source, doc_id % 5 <> 0 AS known, doc_id % 3 <> 0 AND source IN ('src1', 'src3') AS listed, doc_id % 11 = 0 AS missed FROM documents)
SELECT doc_id AS posting_id, source AS board, CASE WHEN NOT listed AND source = 'src1' AND missed THEN 'closed' ELSE 'open' END AS status, CASE WHEN listed THEN 0 WHEN source = 'src1' THEN CASE WHEN missed THEN 2 ELSE 1 END ELSE CASE WHEN missed THEN 1 ELSE 0 END END AS missing,
CASE WHEN listed AND NOT known THEN 'new' WHEN NOT listed AND source = 'src1' AND missed THEN 'closed' END AS kind FROM x WHERE known OR listed""")
def pruned_scan(spark, d):
    """A scan of three boards merged into a state stored by board: src1 complete, src3 partial, src2 failed."""
    t = table(spark, d, "documents").select(F.col("source").alias("board"), F.col("doc_id").alias("posting_id"))
    path = new_path(spark, "state")
    t.where("posting_id % 5 != 0").selectExpr("*", "'h' as content_hash", "'b' as body_text", "'open' as status", "if(posting_id % 11 = 0, 1, 0) as missing", f"timestamp_ntz'{NOW}' as first_seen", f"timestamp_ntz'{NOW}' as last_seen", "cast(null as timestamp_ntz) as closed_at").write.partitionBy("board").parquet(path)
    new = t.where("posting_id % 3 != 0 and board in ('src1', 'src2', 'src3')").selectExpr("*", "'h' as content_hash", "'b' as body_text")
    scan = t.select("board").distinct().where("board in ('src1', 'src2', 'src3')").selectExpr("board", "case board when 'src1' then 'complete' when 'src2' then 'failed' else 'partial' end as status")
    events = state.merge_scan(path, new, scan, F.lit(NOW)).select("board", "posting_id", "kind")
    return spark.read.parquet(path).join(events, ["board", "posting_id"], "left").select("posting_id", "board", "status", "missing", "kind")


@query("SELECT n_name AS board, CASE WHEN n_nationkey % 3 = 0 THEN 'unchanged' WHEN n_nationkey % 3 = 1 THEN 'partial' ELSE 'complete' END AS status, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE count(*) END AS listed FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
def payload_scan(spark, d):
    """Payload files read a second time: boards whose first read was complete and cached are not opened again."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    job = F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    made = n.join(s, n["n_nationkey"] == s["s_nationkey"]).groupBy("n_name", "n_nationkey").agg(F.collect_list(job).alias("jobs"))
    bad = F.when(F.col("n_nationkey") % 3 == 1, F.array(F.struct(F.lit(None).cast("int").alias("id"), F.lit(" ").alias("title"))))
    jobs = F.concat("jobs", F.coalesce(bad.cast(made.schema["jobs"].dataType), F.array().cast(made.schema["jobs"].dataType)))
    path, cache = new_path(spark, "payloads"), new_path(spark, "validators")
    made.select(F.col("n_name").alias("board"), F.to_json(F.struct(jobs.alias("jobs"))).alias("value")).repartition("board").write.partitionBy("board").text(path)
    first = payloads.payloads(spark, path)
    seen = payloads.statuses(first, "greenhouse").join(first.select("board", "url", "etag"), "board").join(n.select(F.col("n_name").alias("board"), "n_nationkey"), "board").where("n_nationkey % 3 != 2")
    none = spark.createDataFrame([], "url string, etag string, last_modified string")
    tables.persist_validators(none, seen.withColumn("last_modified", F.lit(None).cast("string"))).write.parquet(cache)
    return payloads.statuses(payloads.payloads(spark, path, cache), "greenhouse").select("board", "status", "listed")


@query("""SELECT CASE WHEN s_nationkey < 20 THEN s_name ELSE lower(s_name) END AS board, CASE WHEN s_nationkey < 20 THEN s_name || ': no answer' ELSE lower(s_name) || ': unknown provider ''p' || s_nationkey || '''' END AS error
FROM supplier WHERE CASE WHEN s_nationkey < 20 THEN s_suppkey % 4 = 0 ELSE s_acctbal > 0 END""")
def run_error_rows(spark, d):
    """What a run reports: boards that failed, and watched companies whose provider no source reads."""
    s = table(spark, d, "supplier")
    companies = s.select(F.lower("s_name").alias("slug"), F.concat(F.lit("p"), "s_nationkey").alias("provider"), (F.col("s_acctbal") > 0).alias("watched"))
    log = s.where("s_nationkey < 20").select(F.col("s_name").alias("board"), F.when(F.col("s_suppkey") % 4 == 0, "failed").otherwise("complete").alias("status"), F.when(F.col("s_suppkey") % 4 == 0, "no answer").alias("error"))
    return tables.run_errors(log, companies, [f"p{k}" for k in range(20)])


WHOLE = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, 'https://x.example/' || doc_id AS url, {WHOLE} AS body, TIMESTAMP '2024-02-03 04:05:06' AS updated_at, CAST(doc_id AS VARCHAR) AS raw_id FROM documents UNION ALL SELECT 'n' || doc_id, '', '', NULL, 'n' || doc_id FROM documents")
def whole_greenhouse(spark, d):
    """Two jobs a board: the whole text as escaped HTML with address and time of update, and one without them; the raw element is kept."""
    body = F.concat(F.lit("<div><p>"), F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p></div>"))
    full = F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), F.concat(F.lit("https://x.example/"), "doc_id").alias("absolute_url"), F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")).alias("content"), F.lit("2024-02-03T05:05:06+01:00").alias("updated_at"))
    bare = F.struct(F.concat(F.lit("n"), "doc_id").alias("id"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("absolute_url"), F.lit(None).cast("string").alias("content"), F.lit("late").alias("updated_at"))
    return _whole(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("board"), F.to_json(F.struct(F.array(full, bare).alias("jobs"))).alias("content")), "greenhouse")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 'https://y.example/' || doc_id AS url, coalesce(nullif(text, '') || chr(10) || chr(10), '') || 'more' AS body, TIMESTAMP '1970-01-01 00:00:00' + to_milliseconds(doc_id) AS updated_at, CAST(doc_id AS VARCHAR) AS raw_id FROM documents")
def whole_lever(spark, d):
    job = F.struct(F.col("doc_id").alias("id"), F.lit("t").alias("text"), F.concat(F.lit("https://y.example/"), "doc_id").alias("hostedUrl"), F.col("text").alias("descriptionPlain"), F.lit("more").alias("additionalPlain"), F.col("doc_id").alias("updatedAt"))
    return _whole(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("board"), F.to_json(F.array(job)).alias("content")), "lever")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, 'https://z.example/' || doc_id AS url, {WHOLE} AS body, CAST(NULL AS TIMESTAMP) AS updated_at, CAST(doc_id AS VARCHAR) AS raw_id FROM documents")
def whole_ashby(spark, d):
    body = F.concat(F.lit("<p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p><style>p {}</style>"))
    job = F.struct(F.col("doc_id").alias("id"), F.lit("t").alias("title"), F.concat(F.lit("https://z.example/"), "doc_id").alias("jobUrl"), body.alias("descriptionHtml"))
    return _whole(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("board"), F.to_json(F.struct(F.array(job).alias("jobs"))).alias("content")), "ashby")


def _whole(payloads, layout):
    return boards.parse(payloads, layout).select(F.col("provider_posting_id").alias("id"), "url", F.col("body_text").alias("body"), "updated_at", F.get_json_object("raw_json", "$.id").alias("raw_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
