"""Stored state, streams and payload files: merges of few boards, restarts, unread files, run errors."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from rolefinch.functions import scoring as S
from rolefinch.operators import state, tables
from rolefinch.plans import shortlist
from rolefinch.sources import payloads
from rolefinch.streaming.fold import scan_rows, stream_events

from .test_operators import NOW, fold, random_history, scored_postings

SCANS, LISTINGS = "board string, seq int, status string", "board string, posting_id int, seq int, content_hash string"


@pytest.mark.parametrize("parts", [1, 5])
def test_a_restarted_stream_equals_the_fold(spark, tmp_path, parts):
    """Scans arrive in several batches; the stream stops after some and goes on from its checkpoint."""
    scans, listings = random_history()
    _, want = fold(scans, listings)
    source, sink, marks = (f"{tmp_path}/{x}" for x in ("in", "out", "marks"))
    rows = scan_rows(spark.createDataFrame(scans, SCANS), spark.createDataFrame(listings, LISTINGS)).cache()
    os.makedirs(source)
    for lo, hi in ((0, 1), (1, 9), (9, 10), (10, 25)):
        rows.where(F.col("seq").between(lo, hi - 1)).repartition(3).write.mode("append").parquet(source)
        out = stream_events(spark.readStream.schema(rows.schema).parquet(source), parts)
        query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()
        got = sorted(map(tuple, spark.read.parquet(sink).select("board", "posting_id", "seq", "kind").collect()))
        assert got == sorted(e for e in want if e[2] < hi)


def test_a_stream_refuses_a_posting_listed_twice():
    import pandas as pd

    from rolefinch.streaming.fold import fold as step

    frame = pd.DataFrame([("complete", 1, None, None), ("complete", 1, 5, "h"), ("complete", 1, 5, "h")], columns=["status", "seq", "posting_id", "content_hash"])
    with pytest.raises(ValueError, match="twice"):
        step({}, frame, 0)
    known = {}
    assert step(known, frame.iloc[:2], 0) == ([(5, 1, "new")], 1) and step(known, frame, 1) == ([], 1)


def test_a_merge_reads_and_writes_only_the_scanned_boards(spark, tmp_path):
    scans, listings = random_history()
    scans, listings = [s for s in scans if s[1] < 8], [x for x in listings if x[2] < 8]
    known, want = fold(scans, listings)
    path, kinds = f"{tmp_path}/state", "board string, posting_id int, content_hash string, body_text string"
    empty = spark.createDataFrame([("none", 0, "h", "b")], kinds).selectExpr("*", "'open' as status", "0 as missing", f"timestamp_ntz'{NOW}' as first_seen", f"timestamp_ntz'{NOW}' as last_seen", "cast(null as timestamp_ntz) as closed_at")
    empty.write.partitionBy("board").parquet(path)
    kept = {f: os.stat(f"{path}/board=none/{f}").st_mtime_ns for f in os.listdir(f"{path}/board=none")}
    got = []
    for seq in range(8):
        snapshot = spark.createDataFrame([(b, p, h, "x") for b, p, s, h in listings if s == seq], kinds)
        scan = spark.createDataFrame([(b, st) for b, s, st in scans if s == seq], "board string, status string")
        got += [(r["board"], r["posting_id"], seq, r["kind"]) for r in state.merge_scan(path, snapshot, scan, F.lit(NOW)).collect()]
    assert sorted(got) == sorted(want)
    final = {(r["board"], r["posting_id"]): (r["status"], r["missing"], r["content_hash"]) for r in spark.read.parquet(path).where("board != 'none'").collect()}
    assert final == {k: ("closed" if v["miss"] == 2 else "open", v["miss"], v["hash"]) for k, v in known.items()}
    assert kept == {f: os.stat(f"{path}/board=none/{f}").st_mtime_ns for f in os.listdir(f"{path}/board=none")}
    scan = spark.createDataFrame([("x", "complete")], "board string, status string")
    pruned = spark.read.parquet(path).join(state.scanned(scan), "board", "left_semi")
    assert "dynamicpruning" in pruned._jdf.queryExecution().executedPlan().toString()


def test_known_payloads_are_not_opened(spark, tmp_path):
    folder, cache = tmp_path / "in", f"{tmp_path}/cache"
    folder.mkdir()
    for name in ("a", "b", "c"):
        (folder / f"{name}.json").write_text(json.dumps({"jobs": [{"id": 1, "title": name}]}))
    (folder / "_hidden.json").write_text("no")
    first = payloads.payloads(spark, f"file://{folder}")
    seen = first.collect()
    assert sorted((r["board"], r["status"], json.loads(r["content"])["jobs"][0]["title"]) for r in seen) == [(x, "read", x) for x in "abc"]
    first.where("board != 'c'").select("url", "etag").write.parquet(cache)
    (folder / "b.json").write_text('{"jobs": "changed"}')
    os.chmod(folder / "a.json", 0)
    again = payloads.payloads(spark, str(folder), cache)
    assert again.rdd.getNumPartitions() == 3
    assert sorted((r["board"], r["status"], r["content"] is None) for r in again.collect()) == [("a", "unchanged", True), ("b", "read", False), ("c", "read", False)]
    assert sorted((r["board"], r["status"], r["listed"], r["error"]) for r in payloads.statuses(again, "greenhouse").collect()) == [("a", "unchanged", 0, None), ("b", "failed", 0, "invalid board payload: no list of jobs"), ("c", "complete", 1, None)]


def test_unknown_providers_are_errors_but_no_boards(spark):
    c = spark.createDataFrame([("a", "greenhouse", True), ("b", "carrier pigeon", True), ("c", None, True), ("d", "fax", False)], "slug string, provider string, watched boolean")
    log = spark.createDataFrame([("a", "failed", "no answer"), ("x", "partial", "1 of 2")], "board string, status string, error string")
    assert [r["slug"] for r in tables.known_boards(c, ["greenhouse"]).collect()] == ["a"]
    assert sorted(r["error"] for r in tables.run_errors(log, c, ["greenhouse"]).collect()) == ["a: no answer", "b: unknown provider 'carrier pigeon'", "c: unknown provider 'null'"]


def test_shown_postings(spark):
    """A point lookup reaches the scan; closed postings and those of another content have no score of that content."""
    p = scored_postings(spark).withColumn("status", F.when(F.col("posting_id") % 3 == 0, "closed").otherwise("open")).withColumn("content_hash", F.lit("h")).withColumn("company_id", F.lit(1))
    memo = p.select("posting_id", F.when(F.col("posting_id") % 2 == 0, "h").otherwise("old").alias("content_hash"), F.lit("taxonomy").alias("kind"), F.lit("v").alias("engine_version"), "skills")
    companies = spark.createDataFrame([(1, "Reed", True)], "company_id int, company string, watched boolean")
    profile = S.Profile(["a"], ["clerk"], ["of"], ["berlin"])
    got = {r["posting_id"]: r for r in shortlist.shown(p.drop("skills"), companies, memo, "v", profile, NOW).collect()}
    full = shortlist.score(p.withColumn("skills", F.when(F.col("posting_id") % 2 == 0, F.col("skills"))), S.Profile(["a"], ["clerk"], [], ["berlin"]), NOW)
    want = {r["posting_id"]: r for r in full.collect()}
    assert len(got) == 400
    for k, r in got.items():
        assert (r["total"], r["why"]) == ((None, "closed — not ranked") if k % 3 == 0 else (want[k]["total"], want[k]["why"])) and r["company"] == "Reed"
    one = shortlist.shown(tables.by_id(p.drop("skills"), "posting_id", 7), companies, memo, "v", profile, NOW).collect()
    assert [r["posting_id"] for r in one] == [7]


def test_backlog_in_order_of_ids(spark):
    p = spark.createDataFrame([(i, "h", "t", "open") for i in random.Random(1).sample(range(50), 50)], "posting_id long, content_hash string, body_text string, status string").repartition(4)
    none = spark.createDataFrame([], "posting_id long, content_hash string, kind string, engine_version string")
    assert [r["posting_id"] for r in tables.missing_extractions(p, none, "v", ordered=True).collect()] == list(range(50))
