"""Edges of payload parsing: times against the standard library, bodies, pay, statuses of large boards."""

import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from rolefinch.functions.times import iso_time, naive_utc
from rolefinch.sources import boards

TIMES = """2026-01-15 20260115 2026-W03 2026W03 2026-W03-2 2026W032 2026-W53-1 2020-W53-7 2021-W53 2026-W00 2026-W03-8 2026-W03-0 2026-W032 2026W03-2 2026 2026-01 2026-13-01 2026-02-30 0000-01-01 0000-01-01T00:00:00Z 2026-01-15T09 2026-01-15T09:30
2026-01-15T0930 2026-01-15T09:30:10 20260115T090000 20260115T09:00:00 2026-01-15T090000.5 2026-01-15T09:00:00,123456789 2026-01-15T09:00:00.1 2026-01-15T09:00:00.123456 2026-01-15T09:00:00.1234567Z 2026-01-15T09:0000 2026-01-15T0900:00 2026-01-15T24:00
2026-01-15T24:00:00 2026-01-15T09:60 2026-01-15T09:00:60 2026-01-15T09:00Z 2026-01-15T09:00+01 2026-01-15T09:00+0130 2026-01-15T09:00-01:30 2026-01-15T09:00:00.25+01:30:15.5 2026-01-15T09:00+24:00 2026-01-15T09:00+23:59 2026-01-15x09:00 2026-01-15+00:00
2026-01-15Z 2026-01-15T09:00z 2026-01-15T09:00:00.Z 2026-01-15T09:00:00. soon 12345678 2026-W03-2T09:00 2026W032T0900Z 2026-01-15T09+01 2026-1-15 26-01-15 2026-01-15T9:00 2026/01/15 9999-12-31T23:59:59Z""".split()


def by_library(text):
    try:
        t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def test_times_equal_the_standard_library(spark):
    rng = random.Random(3)
    texts = TIMES + ["", " 2026-01-15", "2026-01-15 ", "2026-01-15 09:00", "2026-01-15\n09:00"]
    texts += [rng.choice(TIMES[:12]) + "T" + f"{rng.randrange(26):02}" + rng.choice(["", ":30", "30", ":30:59", "3059", ":30:59.5"]) + rng.choice(["", "Z", "+02", "-0330", "+05:45"]) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in texts] + [(None,)], "v string")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = {r["v"]: r["t"] for r in df.select("v", iso_time(F.col("v")).alias("t")).collect()}
            assert spark.sql("select timestamp'2024-07-01 09:00:00+00:00' as t").select(naive_utc(F.col("t")).alias("t")).first()["t"] == datetime(2024, 7, 1, 9)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got.pop(None) is None and got == {x: by_library(x) for x in texts} and sum(t is not None for t in got.values()) > 150


def parsed(spark, layout, payload):
    return boards.parse(spark.createDataFrame([("b", json.dumps(payload))], "board string, content string"), layout)


@pytest.mark.parametrize("part, body, error", [("x", "x\n\ny", None), ("", "y", None), (None, "y", None), (0, "y", None), (0.0, "y", None), (False, "y", None), ([], "y", None), ({}, "y", None), ({"a": 1}, None, "body is no text"), (5, None, "body is no text"), (True, None, "body is no text"), ([0], None, "body is no text")])
def test_plain_bodies(spark, part, body, error):
    r = parsed(spark, "lever", [{"id": "1", "text": "t", "descriptionPlain": part, "additionalPlain": "y"}]).first()
    assert r["error"] == error and (error or r["body_text"] == body)


def test_epoch_of_true_is_a_millisecond(spark):
    a, b = parsed(spark, "lever", [{"id": "1", "text": "t", "createdAt": True}, {"id": "2", "text": "t", "createdAt": "1"}]).orderBy("pos").collect()
    assert a["posted_at"] == datetime(1970, 1, 1, 0, 0, 0, 1000) and b["posted_at"] is None and not a["error"]


@pytest.mark.parametrize("compensation", [None, 3, [], {}, {"compensationTiers": None}, {"compensationTiers": [3]}, {"compensationTiers": [{"components": [3]}]}, {"compensationTiers": [{"components": "x"}]}, {"compensationTiers": [{"components": [{"compensationType": "Salary", "interval": "1 YEAR", "currencyCode": "", "minValue": 1}]}]}])
def test_odd_pay_is_no_pay(spark, compensation):
    r = parsed(spark, "ashby", {"jobs": [{"id": "1", "title": "t", "compensation": compensation}]}).first()
    assert (r["salary_min"], r["salary_max"], r["salary_currency"], r["salary_period"], r["error"]) == (None,) * 5


def test_errors_of_a_large_board_are_gathered_in_small_groups(spark):
    """The first three errors in order of position; no list on the way holds more than a few thousand of them."""
    n = 40_000
    rows = spark.range(n).selectExpr("'big' as board", "true as valid", "cast(null as string) as cause", "cast(id as int) as pos", "concat('p', id) as provider_posting_id", "if(id % 7 = 5, 'missing title', null) as error").repartition(9)
    few = spark.createDataFrame([("none", False, "not JSON", None, None, None), ("empty", True, None, None, None, None), ("one", True, None, 0, None, "missing id"), ("fine", True, None, 0, "x", None)], "board string, valid boolean, cause string, pos int, provider_posting_id string, error string")
    got = {r["board"]: tuple(r)[1:] for r in boards.snapshot_status(rows.unionByName(few)).collect()}
    bad = len(range(5, n, 7))
    assert got["big"] == ("partial", n - bad, f"{bad} of {n} jobs failed to parse: job p5: missing title; job p12: missing title; job p19: missing title")
    assert got["none"] == ("failed", 0, "invalid board payload: not JSON") and got["empty"] == ("complete", 0, None) and got["one"] == ("failed", 0, "all 1 jobs failed to parse") and got["fine"] == ("complete", 1, None)
