"""Pinned values of the scalar functions, parsing, change tracking and scoring."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rolefinch.functions import scoring as S
from rolefinch.functions import text as X
from rolefinch.functions.taxonomy import Pattern, Taxonomy, TaxonomyError, load
from rolefinch.operators import state, tables
from rolefinch.sources import boards

NOW = "2024-01-31 00:00:00"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("f, given, want", [
    (X.normalize_company, "Harbour, Inc.", "harbour"), (X.normalize_company, "Reed & Co.", "reed"), (X.normalize_company, "Lanternworks", "lanternworks"), (X.normalize_company, "Nordlicht GmbH", "nordlicht gmbh"), (X.normalize_company, "Crêpe Würfel Labs", "crpe wrfel"),
    (X.normalize_title, "F# / C++ Tinkerer", "f c tinkerer"), (X.normalize_body, " A  b\n", "a b"), (X.role_family, "Android Security Lead", "mobile"), (X.role_family, "AI Platform Engineer", "devops_sre"), (X.role_family, "Engineer", "general_swe"),
    (X.html_to_text, "<div>One line.</div><p>And one more.</p>", "One line.\nAnd one more."), (X.html_to_text, "half <i>slan</i>ted<style>x</style>", "half slanted"), (X.html_to_text, "", ""),
])
def test_text(spark, f, given, want):
    assert one(spark, f(F.lit(given))) == want


def test_escaped_html_is_unescaped_once(spark):
    assert one(spark, X.html_to_text(X.unescape(F.lit("&lt;p&gt;R&amp;amp;D&lt;/p&gt;")))) == "R&D"


def test_title_match(spark):
    m = lambda title, *targets: one(spark, S.title_match(F.lit(title), list(targets)))
    assert m("Keeper / Harbour", "harbour keeper") == 1 and m("Night harbour keeper", "harbour keeper", "cook") == 1
    assert m("Baker of Bread", "harbour keeper") < 0.8 and m("whoever") is None and m("?!", "b") == 0


def test_coverage_recency_and_location(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, S.skill_coverage(arr("knots", "sails", "charts", "radio", "stars"), ["radio", "knots", "cooking"])) == pytest.approx(2 / 5)
    assert one(spark, S.skill_coverage(arr(), ["knots"])) is None and one(spark, S.skill_coverage(arr("sails"), [])) is None
    now = F.lit(NOW).cast("timestamp_ntz")
    for days, want in ((0, 1.0), (14, 0.5), (28, 0.25), (-3, 1.0)):
        assert one(spark, S.recency(now - F.make_dt_interval(F.lit(days)), now)) == pytest.approx(want)
    fit = lambda places, policy, **k: one(spark, S.location_fit(arr(*places), F.lit(policy), S.Profile(**k)))
    assert fit(["Pier 4, Kiel"], "unknown", locations=["kiel"]) == 1 and fit(["el"], "unknown", locations=["Kiel"]) == 1
    assert fit(["Berlin"], "remote", locations=["Paris"]) == 0.5 and fit(["Berlin"], "unknown", locations=["Paris"]) == 0 and fit(["Berlin"], "remote") is None
    assert fit(["Berlin"], "remote", remote_only=True) == 1 and fit(["Berlin"], "unknown", remote_only=True, locations=["Berlin"]) == 0


def test_total_is_renormalized(spark):
    t = lambda *v: one(spark, S.total([F.lit(x).cast("double") for x in v], S.Weights()))
    assert t(None, 1.0, 0.5, 0.0) == pytest.approx(0.65) and t(2 / 3, None, 1.0, 1.0) == pytest.approx(0.777777, abs=1e-5) and t(None, None, None, None) == 0


def test_hard_filters(spark):
    p = S.Profile(exclude_titles=["deckhand"])
    ok = lambda title, fit: one(spark, S.passes(F.lit(title), F.lit(fit).cast("double"), p, hard_location=True))
    assert not ok("Head DeckHand, night", 1.0) and ok("Head cook, night", 1.0) and ok("x", None) and not ok("x", 0.0)


def test_taxonomy(spark):
    t = load()
    hits = lambda s: set(one(spark, t.skills(F.lit(s))))
    assert "Go" in hits("Half of it is Go") and "Go" not in hits("nowhere to go") and "Python" in hits("PYTHON, please")
    a, b = Taxonomy([Pattern("a", "x", "a")]), Taxonomy([Pattern("a", "x", "b")])
    assert a.version != b.version and a.version == Taxonomy([Pattern("a", "x", "a")]).version
    for bad in ([], [Pattern("a", "x", "a"), Pattern("a", "x", "b")], [Pattern("a", "x", "(")], [Pattern("", "x", "a")]):
        with pytest.raises(TaxonomyError):
            Taxonomy(bad)


def parsed(spark, layout, payload):
    return boards.parse(spark.createDataFrame([("b", payload if isinstance(payload, str) else json.dumps(payload))], "board string, content string"), layout)


def test_parse_greenhouse(spark):
    job = {"id": 7, "title": " Engineer ", "content": "&lt;p&gt;A&lt;/p&gt;", "location": {"name": "Remote - US"}, "offices": [{"name": "Berlin"}, {"name": "Remote - US"}], "departments": [{"name": "Eng"}], "first_published": "2024-01-02T03:04:05Z", "absolute_url": "u"}
    df = parsed(spark, "greenhouse", {"jobs": [job, {"id": 8}, {"id": 9, "title": " "}, {"id": None, "title": None}]})
    a, b, c, d = df.orderBy("pos").collect()
    assert (a["provider_posting_id"], a["title"], a["locations"], a["department"], a["body_text"], a["remote_policy"], str(a["posted_at"]), a["error"]) == ("7", "Engineer", ["Remote - US", "Berlin"], "Eng", "A", "remote", "2024-01-02 03:04:05", None)
    assert b["error"] == "missing title" and c["error"] == "empty title" and (d["provider_posting_id"], d["title"]) == ("None", "None")
    s = boards.snapshot_status(df).first()
    assert (s["status"], s["listed"], s["error"]) == ("partial", 2, "2 of 4 jobs failed to parse: job 8: missing title; job 9: empty title")


@pytest.mark.parametrize("content, want", [("{", "failed"), ("{}", "failed"), ('{"jobs": 3}', "failed"), ('{"jobs": []}', "complete"), ('{"jobs": [{"id": 1}]}', "failed")])
def test_payload_status(spark, content, want):
    assert boards.snapshot_status(parsed(spark, "greenhouse", content)).first()["status"] == want


def test_parse_lever(spark):
    jobs = [{"id": "u", "text": "T", "categories": {"team": "X", "location": "L", "allLocations": ["A", "", "A"]}, "createdAt": 1700000000123, "descriptionPlain": "d", "additionalPlain": "e"}, {"id": "v", "text": "T", "categories": {"location": "L", "allLocations": [""]}}, {"id": "w", "text": "T", "categories": {"location": "L"}}]
    a, b, c = parsed(spark, "lever", jobs).orderBy("pos").collect()
    assert a["locations"] == ["A", "A"] and b["locations"] == [] and c["locations"] == ["L"] and a["body_text"] == "d\n\ne" and str(a["posted_at"]) == "2023-11-14 22:13:20.123000"


def test_parse_ashby_pay(spark):
    part = lambda **k: {"compensationType": "Salary", "interval": "1 YEAR", "currencyCode": "EUR", "minValue": 1, "maxValue": 2} | k
    tiers = [[[part()]], [[part(maxValue=None)]], [[part()], [part()]], [[part(), part(compensationType="Equity")]], [[part(interval="1 AGE")]], [[part(minValue=None, maxValue=None)]], []]
    jobs = [{"id": str(k), "title": "t", "isRemote": k == 0, "compensation": {"compensationTiers": [{"components": c} for c in t]}} for k, t in enumerate(tiers)]
    got = parsed(spark, "ashby", {"jobs": jobs}).orderBy("pos").collect()
    assert [(r["salary_min"], r["salary_max"], r["salary_period"]) for r in got] == [(1, 2, "year"), (1, None, "year"), *[(None, None, None)] * 5]
    assert [r["remote_policy"] for r in got][:2] == ["remote", "unknown"]


def test_health(spark):
    h = lambda code, n: one(spark, boards.health(F.lit(code).cast("int"), F.lit(n).cast("int")))
    assert [h(200, 3), h(200, 0), h(404, None), h(500, None), h(None, None), h(200, None)] == ["ok", "empty", "dead", "error", "unreachable", "error"]


def fold(scans, listings):
    """The change rules, one scan after another."""
    known, events = {}, []
    for board, seq, status in sorted(scans, key=lambda s: s[1]):
        if status not in ("complete", "partial"):
            continue
        here = {p: h for b, p, s, h in listings if (b, s) == (board, seq)}
        for p, h in here.items():
            old = known.get((board, p))
            events += [(board, p, seq, k) for k in (["new"] if old is None else ["reopened"] * (old["miss"] >= 2) + ["revised"] * (old["hash"] != h))]
            known[board, p] = {"hash": h, "miss": 0}
        for (b, p), old in known.items():
            if b == board and p not in here and status == "complete" and old["miss"] < 2:
                old["miss"] += 1
                events += [(board, p, seq, "closed")] * (old["miss"] == 2)
    return known, events


def random_history():
    rng = random.Random(4)
    scans = [(b, s, rng.choice(["complete"] * 4 + ["partial", "failed", "unchanged"])) for b in "xyz" for s in range(25)]
    listings = [(b, p, s, rng.choice("pq")) for b, s, _ in scans for p in range(6) if rng.random() < 0.5]
    return scans, listings


def test_replay_equals_the_fold(spark):
    scans, listings = random_history()
    known, events = fold(scans, listings)
    h = state.replay_history(spark.createDataFrame(scans, "board string, seq int, status string"), spark.createDataFrame(listings, "board string, posting_id int, seq int, content_hash string"))
    assert sorted(map(tuple, state.history_events(h).collect())) == sorted(events)
    final = {(r["board"], r["posting_id"]): (r["status"], r["missing"], r["content_hash"]) for r in state.history_final(h).collect()}
    assert final == {k: ("closed" if v["miss"] == 2 else "open", v["miss"], v["hash"]) for k, v in known.items()}


def test_snapshots_equal_the_fold(spark, tmp_path):
    scans, listings = random_history()
    scans, listings = [s for s in scans if s[1] < 6], [x for x in listings if x[2] < 6]
    known, events = fold(scans, listings)
    now = spark.createDataFrame([], "board string, posting_id int, content_hash string, body_text string, title string, status string, missing int, first_seen timestamp_ntz, last_seen timestamp_ntz, closed_at timestamp_ntz")
    got = []
    for seq in range(6):
        new = spark.createDataFrame([(b, p, h, f"body {h}", f"title {seq}") for b, p, s, h in listings if s == seq], "board string, posting_id int, content_hash string, body_text string, title string")
        out, ev = state.apply_snapshot(now, new, spark.createDataFrame([(b, st) for b, s, st in scans if s == seq], "board string, status string"), F.lit(NOW))
        got += [(r["board"], r["posting_id"], seq, r["kind"]) for r in ev.collect()]
        out.write.parquet(f"{tmp_path}/{seq}")
        now = spark.read.parquet(f"{tmp_path}/{seq}")
    assert sorted(got) == sorted(events)
    assert {(r["board"], r["posting_id"]): (r["status"], r["missing"], r["content_hash"]) for r in now.collect()} == {k: ("closed" if v["miss"] == 2 else "open", v["miss"], v["hash"]) for k, v in known.items()}


def test_a_posting_listed_twice_fails(spark):
    df = spark.createDataFrame([("b", 1), ("b", 1)], "board string, posting_id int")
    with pytest.raises(Exception, match="listed twice"):
        state.validated(df).collect()


def test_extraction_is_done_once(spark):
    t = Taxonomy([Pattern("the", "en", r"\bthe\b")])
    p = spark.createDataFrame([(1, "h1", "the one", "open"), (2, "h2", "two", "open"), (3, "h3", "the", "closed")], "posting_id int, content_hash string, body_text string, status string")
    none = spark.createDataFrame([], "posting_id int, content_hash string, kind string, engine_version string")
    first = tables.extract(tables.missing_extractions(p, none, t.version), t)
    assert {(r["posting_id"], tuple(r["skills"])) for r in first.collect()} == {(1, ("the",)), (2, ())}
    memo = first.select("posting_id", "content_hash", F.lit("taxonomy").alias("kind"), F.lit(t.version).alias("engine_version"))
    assert tables.missing_extractions(p, memo, t.version).count() == 0 and tables.missing_extractions(p, memo, "other").count() == 2


def test_upsert_keeps_what_it_does_not_refresh(spark):
    old, new = spark.createDataFrame([(1, "a", False)], "id int, name string, watched boolean"), spark.createDataFrame([(1, "z", True), (2, "b", True)], "id int, name string, watched boolean")
    assert {tuple(r) for r in tables.upsert(old, new, ["id"], ["watched"]).select("id", "name", "watched").collect()} == {(1, "a", True), (2, "b", True)}
    assert tables.insert_if_absent(old, new, ["id"]).count() == 2


def test_all_entities_decode(spark):
    assert one(spark, X.html_to_text(F.lit("<p>caf&eacute; &#8217;s &#x2019; &uuml;&ldquo;x&rdquo;&bull;&euro;&amp;eacute;</p>"))) == "café ’s ’ ü“x”•€&eacute;"


def test_html_of_a_real_parser(spark):
    t = lambda s: one(spark, X.html_to_text(F.lit(s)))
    assert t('<p title="a>b">x</p>') == "x" and t("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2" and t(None) == ""
    assert t("<html><head><title>no</title></head><body>We&#8217;re caf&eacute;<br>&euro;<script>if (a<b) {}</script></body></html>") == "We’re café\n€"


def test_common_subsequence_against_a_table():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(9))) for _ in "xy")
        rows = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[-1]))
            rows.append(row)
        assert S.common_subsequence(a, b) == rows[-1][-1]


def test_own_yaml_replaces_the_bundled_taxonomy(spark, tmp_path):
    f = tmp_path / "own.yaml"
    f.write_text("patterns:\n  - {name: Tea, category: drink, pattern: '\\btea\\b', case_sensitive: true}\nversion: 3\n")
    t = load(f)
    assert one(spark, t.skills(F.lit("Tea or tea"))) == ["Tea"] and one(spark, t.skills(F.lit("Tea"))) == []
    f.write_text("version: 3\npatterns: [{category: drink, case_sensitive: true, pattern: '\\btea\\b', name: Tea}]\n")
    assert load(f).version == t.version
    for bad in ("patterns: 3", "patterns: [x]", "patterns: [{name: a}]", "patterns: [{name: a, category: b, pattern: '('}]", "a: ["):
        f.write_text(bad)
        with pytest.raises(TaxonomyError, match="own.yaml"):
            load(f)


def test_bad_values_are_row_errors(spark):
    jobs = [{"id": "a", "text": "T", "createdAt": 9223372036854775807}, {"id": "b", "text": "T", "createdAt": "soon"}, {"id": "c", "text": "T", "createdAt": 10**30}]
    got = parsed(spark, "lever", jobs).orderBy("pos").collect()
    assert [r["error"] for r in got] == ["time out of range", None, "time out of range"] and got[1]["posted_at"] is None
    part = {"compensationType": "Salary", "interval": "1 year", "currencyCode": "EUR", "minValue": "x", "maxValue": 2}
    job = lambda p: {"id": "1", "title": "t", "compensation": {"compensationTiers": [{"components": [p]}]}}
    a, b = parsed(spark, "ashby", {"jobs": [job(part), job(part | {"minValue": "3"})]}).orderBy("pos").collect()
    assert a["error"] == "pay is no number" and (b["error"], b["salary_min"], b["salary_period"]) == (None, 3.0, "year")
    twice = parsed(spark, "greenhouse", '{"jobs":[{"id":1,"title":"a","title":"b"}]}').first()
    assert (twice["title"], twice["error"]) == ("b", None)


def test_a_listing_refreshes_all_mutable_fields(spark):
    kinds = "board string, posting_id int, content_hash string, body_text string, title string, url string, locations array<string>, salary_min double"
    new = spark.createDataFrame([("b", 1, "h", "new body", "new", "u2", ["x"], 2.0)], kinds)
    old = spark.createDataFrame([("b", 1, "h", "old body", "old", "u1", ["y"], 1.0)], kinds).selectExpr("*", "'closed' as status", "2 as missing", f"timestamp_ntz'{NOW}' as first_seen", f"timestamp_ntz'{NOW}' as last_seen", f"timestamp_ntz'{NOW}' as closed_at")
    out, events = state.apply_snapshot(old, new, spark.createDataFrame([("b", "partial")], "board string, status string"), F.lit("2024-02-01 00:00:00"))
    r = out.first()
    assert (r["title"], r["url"], r["locations"], r["salary_min"], r["body_text"], r["status"], r["missing"], r["closed_at"]) == ("new", "u2", ["x"], 2.0, "old body", "open", 0, None)
    assert [e["kind"] for e in events.collect()] == ["reopened"]


def test_patterns_have_to_suit_spark_too(spark):
    assert load().checked(spark).patterns
    with pytest.raises(TaxonomyError, match="odd"):
        Taxonomy([Pattern("fine", "x", "a"), Pattern("odd", "x", r"(?P<y>a)(?P=y)")]).checked(spark)


def test_event_ids_are_in_order(spark):
    """Postings reopened and revised in one scan: the numbers follow scans, boards, closings last, postings, steps."""
    rng = random.Random(2)
    rows = [(b, p, k, s) for s in range(3) for b in "yx" for p in range(200) for k in rng.sample(["revised", "reopened", "closed", "new"], 2)]
    want = sorted(rows, key=lambda r: (r[3], r[0], r[2] == "closed", r[1], state.STEPS.index(r[2])))
    rng.shuffle(rows)
    kind = "board string, posting_id long, kind string, seq int"
    log = spark.createDataFrame([(7, "z", 1, "new", 0)], f"id long, {kind}")
    got = state.append_events(log, spark.createDataFrame(rows, kind).repartition(7), "seq").orderBy("id").collect()
    assert [tuple(r)[1:] for r in got[1:]] == want and [r["id"] for r in got] == list(range(7, 8 + len(want)))
    again = state.append_events(spark.createDataFrame([], log.schema), spark.createDataFrame(rows[:0], kind)).collect()
    assert again == []


def scored_postings(spark, n=400):
    rng = random.Random(12)
    word = lambda: rng.choice(["backend", "data", "Straße", "senior", "clerk", "of", "harbour"])
    rows = [(k, " ".join(word() for _ in range(rng.randrange(1, 4))), rng.choice([None, [], ["a"], ["a", "b"], ["c"]]), rng.choice([["Berlin"], ["Paris"], []]), rng.choice(["remote", "unknown"]), rng.choice([None, rng.randrange(90)])) for k in range(n)]
    df = spark.createDataFrame(rows, "posting_id long, title string, skills array<string>, locations array<string>, remote_policy string, days int").repartition(5)
    return df.withColumn("posted_at", F.expr(f"timestamp_ntz'{NOW}' - make_dt_interval(days)"))


@pytest.mark.parametrize("weights", [S.Weights(), S.Weights(0.1, 0.9, 0.3, 0.0), S.Weights(0, 0, 0, 0), S.Weights(1, 0, 0, 0)])
def test_the_pruned_shortlist_equals_full_scoring(spark, weights):
    from rolefinch.plans import shortlist

    df = scored_postings(spark)
    for n in (1, 10, 1000):
        for p in (S.Profile(["a", "c"], ["senior data clerk", "harbour"], ["of"], ["berlin"]), S.Profile(target_titles=["backend"]), S.Profile(["a"])):
            cols = ["posting_id", "total", "title_match", "why"]
            assert shortlist.best(df, p, NOW, n, weights).select(cols).collect() == shortlist.top(shortlist.score(df, p, NOW, weights), n).select(cols).collect()
    assert shortlist.best(df.where("false"), S.Profile(target_titles=["x"]), NOW).collect() == []


def test_titles_are_compared_only_where_they_can_matter(spark):
    from rolefinch.plans import shortlist

    df = spark.range(5000).selectExpr("id as posting_id", "concat('title ', id) as title", "array('a') as skills", "array('x') as locations", "'unknown' as remote_policy", f"timestamp_ntz'{NOW}' - make_dt_interval(cast(id as int)) as posted_at")
    assert 3 <= shortlist.contenders(df, S.Profile(["a"], ["title 7"], [], ["y"]), NOW, 3, S.Weights(0.1, 0.1, 0.8, 0.0)).count() < 20


def test_case_folding_equals_pythons(spark):
    words = ["Straße", "STRASSE", "İstanbul", "ΟΔΟΣ", "Οδος", "ﬁn", "ẞ", "plain", "", "aΣ b", "Ꭰ"] + [f"{chr(k)}x" for k in range(0x80, 0x600)]
    got = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string").select("w", X.casefold(F.col("w")).alias("f")).collect()
    assert all(r["f"] == (None if r["w"] is None else X.folded(r["w"])) for r in got)
    p = S.Profile(exclude_titles=["STRASSE"], locations=["GRÜẞE"])
    assert one(spark, S.vetoed(F.lit("Straßenbau"), p)) and not one(spark, S.vetoed(F.lit("Stra"), p))
    assert one(spark, S.location_fit(F.array(F.lit("Grüsse")), F.lit("unknown"), p)) == 1 and one(spark, boards.remote_policy(F.array(F.lit("ℛ"), F.lit("REMOTE")))) == "remote"


@pytest.mark.parametrize("slug", ["foo_bar", "acme2go", "two-words", "o'neil", "ÉCOLE x", "ABC", "", "a  b", "1a2b", "漢a"])
def test_display_names(spark, slug):
    assert one(spark, X.display_name(F.lit(slug))) == slug.title()


def test_backfill_takes_up_where_it_stopped(spark, tmp_path):
    from rolefinch.operators.backfill import backfill, memo

    t = Taxonomy([Pattern("tea", "drink", r"\btea\b")])
    rows = [(i, f"h{i}", "tea" if i % 2 else "mate", "closed" if i % 10 == 0 else "open") for i in range(100)]
    df = spark.createDataFrame(rows, "posting_id long, content_hash string, body_text string, status string")
    path, done = f"{tmp_path}/memo", []

    def crash(k):
        done.append(memo(spark, path).count())
        if k == 1:
            raise RuntimeError("power cut")

    with pytest.raises(RuntimeError):
        backfill(df, path, t, 20, crash)
    assert len(done) == 2 and 0 < done[0] < done[1] < 90
    assert backfill(df, path, t, 20) == 90 - done[1] and backfill(df, path, t, 20) == 0
    got = memo(spark, path).collect()
    assert sorted((r["posting_id"], r["skills"], r["categories"]) for r in got) == [(i, ["tea"] * (i % 2), {"tea": "drink"} if i % 2 else {}) for i in range(100) if i % 10]
    other = Taxonomy([Pattern("mate", "drink", "mate")])
    assert backfill(df, path, other, 1000) == 90 and memo(spark, path).count() == 180
    edited = df.withColumn("content_hash", F.when(F.col("posting_id") < 5, "new").otherwise(F.col("content_hash")))
    assert backfill(edited, path, t) == 4


def shuffled(spark):
    """Bytes that all stages of the application have written for shuffles or spilled so far."""
    jvm, sc = spark._jvm, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    every = (stages.apply(i) for i in range(stages.size()))
    return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() + x.diskBytesSpilled() + x.memoryBytesSpilled() for x in every}


def random_texts(n, size):
    rng = random.Random(5)
    return [(i, f"h{i}", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=size)), "open") for i in range(n)]


@pytest.mark.parametrize("batch", [1000, 100])
def test_backfill_moves_keys_not_texts(spark, tmp_path, batch):
    """In one batch or several, of nothing known or few missing, less is shuffled and spilled than a tenth of the texts."""
    from rolefinch.operators.backfill import backfill, memo

    rows = random_texts(400, 20_000)
    source, path, t = f"{tmp_path}/postings", f"{tmp_path}/memo", Taxonomy([Pattern("tea", "drink", r"\btea\b")])
    spark.createDataFrame(rows, "posting_id long, content_hash string, body_text string, status string").write.parquet(source)
    p, before = spark.read.parquet(source), shuffled(spark)
    sizes = []
    assert backfill(p.where("posting_id >= 40"), path, t, batch, lambda k: sizes.append(memo(spark, path).count())) == 360
    assert backfill(p, path, t, batch) == 40 and backfill(p, path, t, batch) == 0
    assert len(sizes) == (1 if batch == 1000 else len(sizes)) and all(b - a <= batch for a, b in zip([0, *sizes], sizes))
    assert sorted(r["posting_id"] for r in memo(spark, path).collect()) == list(range(400))
    assert sum(v for k, v in shuffled(spark).items() if k not in before) < 400 * 20_000 / 10


def test_backfill_of_many_missing_beside_known_ones(spark, tmp_path, monkeypatch):
    """More missing keys than are broadcast: each is done once, one without a content hash again each time."""
    from rolefinch.operators import backfill as B

    monkeypatch.setattr(B, "FEW", 10)
    t, path = Taxonomy([Pattern("tea", "drink", r"\btea\b")]), f"{tmp_path}/memo"
    rows = [(i, None if i == 9 else f"h{i % 50}", "tea" if i % 2 else None, "open") for i in range(300)]
    p = spark.createDataFrame(rows, "posting_id long, content_hash string, body_text string, status string")
    assert B.backfill(p.where("posting_id < 100"), path, t, 30) == 100
    missing, n = B.pending(p, B.memo(spark, path), t.version)
    assert n == 201 and "ShuffledHashJoin" in missing._jdf.queryExecution().executedPlan().toString()
    assert B.backfill(p, path, t, 30) == 201 and B.backfill(p, path, t, 30) == 1
    got = sorted((r["posting_id"], r["content_hash"], r["skills"]) for r in B.memo(spark, path).collect() if r["posting_id"] != 9)
    assert got == [(i, h, ["tea"] * (i % 2)) for i, h, _, _ in rows if i != 9]


@pytest.mark.parametrize("name", ["rank_top_titles", "shown_postings"])
def test_stored_texts_are_not_shuffled(spark, tmp_path, name):
    """The shortlist's tables are stored and read without moving texts between partitions."""
    from rolefinch import catalog

    rows = [(i, text, "en", "src0", len(text)) for i, _, text, _ in random_texts(400, 20_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    before = shuffled(spark)
    assert len(catalog.queries()[name](spark, str(tmp_path)).collect()) in (10, 400)
    assert sum(v for k, v in shuffled(spark).items() if k not in before) < 400 * 20_000 / 10


def written(spark):
    """Bytes that all stages of the application have written as output so far."""
    jvm, sc = spark._jvm, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(x.stageId(), x.attemptId()): x.outputBytes() for x in (stages.apply(i) for i in range(stages.size()))}


@pytest.mark.parametrize("batch", [400, 130])
def test_held_postings_are_not_copied(spark, tmp_path, batch):
    """Files of 100 postings, four or one to a batch: each is read where it lies, and no text is written again."""
    from rolefinch.operators.backfill import backfill, memo

    rows = random_texts(800, 20_000)
    source, path, t = f"{tmp_path}/post ings", f"{tmp_path}/memo", Taxonomy([Pattern("tea", "drink", r"\btea\b")])
    spark.createDataFrame(rows, "posting_id long, content_hash string, body_text string, status string").repartitionByRange(8, "posting_id").write.option("maxRecordsPerFile", 100).parquet(source)
    p, before, sizes = spark.read.parquet(source), written(spark), []
    assert backfill(p, path, t, batch, lambda k: sizes.append(memo(spark, path).count()), held=True) == 800
    assert len(sizes) > 1 and all(b - a <= batch for a, b in zip([0, *sizes], sizes))
    assert sorted(r["posting_id"] for r in memo(spark, path).collect()) == list(range(800))
    assert sum(v for k, v in written(spark).items() if k not in before) < 800 * 20_000 / 10
    # a file that holds more than a batch is copied in parts, and what a part of the memo lacks is found as ever
    other = f"{tmp_path}/other"
    assert backfill(p.where("posting_id < 150"), other, t, 70, held=True) == 150 and backfill(p, other, t, batch, held=True) == 650
    assert sorted(r["posting_id"] for r in memo(spark, other).collect()) == list(range(800))
