"""License scan against plain alignment of every template at every place, and on edited, cut and repeated notices."""

import random

import numpy as np
import pytest


def least(block, template):
    """The fewest words missing and added of any stretch, by a plain table."""
    row = [0] * (len(block) + 1)
    for w in template:
        now = [row[0] + 1]
        for j, x in enumerate(block):
            now.append(min([row[j + 1] + 1, now[j] + 1] + [row[j]] * (x == w)))
        row = now
    return min(row)


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        at = rng.randrange(len(w))
        kind = rng.randrange(3)
        w[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice(["the", "software", "new", "license"])]
    return w


def test_every_notice_is_found_and_none_else():
    """A text has a row for a template exactly where plain alignment finds it, unless a notice that spares more lies there."""
    from rolefinch.llm.license_scan import TEMPLATES, Templates, words_of

    rng = random.Random(13)
    made = Templates(tuple(TEMPLATES.items()), 0.1)
    spoken = {n: words_of(t) for n, t in TEMPLATES.items()}
    filler = "a story of the software and this work to any person under the terms of use in all copies as is with".split()
    seen = 0
    for _ in range(150):
        name = rng.choice(sorted(TEMPLATES))
        n = int(0.1 * len(spoken[name]))
        w = edited(rng, spoken[name], rng.randrange(0, n + 3))
        w = w[rng.randrange(0, max(1, n)) :]
        text = " ".join(rng.choices(filler, k=rng.randrange(60)) + w + rng.choices(filler, k=rng.randrange(60)))
        own = words_of(text)
        rows = list(made.scan(text))
        assert made.may_hold(text) or not rows
        for _, start, end, found, saving, missing, added, apart in rows:
            part = words_of(text[start:end])
            assert missing + added == least(part, spoken[found]) <= int(0.1 * len(spoken[found])) and bool(apart) == (missing + added > 0)
        there = {t for t, x in spoken.items() if least(own, x) <= int(0.1 * len(x))}
        assert bool(there) == bool(rows) and {r[3] for r in rows} <= there
        seen += bool(there)
    assert 40 < seen < 150


@pytest.mark.parametrize("change", [lambda w: w[2:], lambda w: w[3:], lambda w: ["permissions", "are", *w[2:]], lambda w: w[:-4], lambda w: [*w[:30], "very", "much", *w[30:]], lambda w: [*w[:9], *w[11:40], *w[41:]]])
def test_a_notice_with_a_cut_or_edited_edge(spark, change):
    from rolefinch.llm.license_scan import TEMPLATES, scan_licenses, words_of

    text = "Some story. " * 400 + " ".join(change(words_of(TEMPLATES["MIT-text"]))) + " and so on." * 400
    r = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [x["license"] for x in r] == ["MIT-text"] and 0 < r[0]["n_missing"] + r[0]["n_added"] <= 6 and r[0]["differences"]


def test_a_notice_over_the_tolerance_is_none(spark):
    from rolefinch.llm.license_scan import TEMPLATES, scan_licenses, words_of

    w = words_of(TEMPLATES["MIT-text"])
    assert scan_licenses(spark.createDataFrame([(1, " ".join(w[7:])), (2, " ".join(reversed(w))), (3, " ".join(w[30:] + w[:30]))], "doc_id long, text string")).collect() == []


def test_many_notices_of_one_text_and_ties(spark):
    """All of many notices in a row are found; of equal templates the first name stays."""
    from rolefinch.llm.license_scan import TEMPLATES, scan_licenses

    text = " ".join([TEMPLATES["MIT-text"], TEMPLATES["ISC"], "Released under the MIT License."] * 50)
    df = spark.createDataFrame([(1, text), (1, text), (None, TEMPLATES["ISC"]), (2, None), (3, "")], "doc_id long, text string")
    got = [(r["doc_id"], r["license"]) for r in scan_licenses(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "MIT-text"), (1, "ISC"), (1, "MIT")] * 100 + [(None, "ISC")], key=str)
    same = {"b": "one two three four", "a": "one two three four", "c": "four five"}
    got = scan_licenses(spark.createDataFrame([(1, "zero one two three four five")], "doc_id long, text string"), same).collect()
    assert [r["license"] for r in got] == ["a"]


def test_alignment_lists_every_difference():
    from rolefinch.llm.license_scan import align

    t = np.arange(20)
    assert align(t, t, 0) == (0, 20, [])
    assert align(np.array([9, 9, *range(5), 77, *range(5, 20), 9]), t, 1) == (2, 23, [(5, 5, 7, 8)])
    assert align(np.array([*range(3, 10), 50, 51, *range(11, 20)]), t, 6) == (0, 18, [(0, 3, 0, 0), (10, 11, 7, 9)])
    assert align(np.array([*range(3, 10), 50, 51, *range(11, 20)]), t, 5) is None


def test_folder_of_templates(spark, tmp_path):
    from rolefinch.llm.license_scan import read_templates, scan_licenses

    (tmp_path / "Own-1.0").write_text("You may copy this work if you tell your neighbours about it first. " * 9)
    got = scan_licenses(spark.createDataFrame([(1, "x " + "You may copy this work if you tell your neighbours about it first.\n" * 9)], "doc_id long, text string"), read_templates(str(tmp_path))).collect()
    assert [(r["license"], r["n_missing"], r["n_added"]) for r in got] == [("Own-1.0", 0, 0)]
