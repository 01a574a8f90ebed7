"""Phrase collocations against plain counting, perfect hashing against dictionaries."""

import re
from collections import Counter, defaultdict

import numpy as np

SCHEMA = "doc_id long, lang string, text string"


def plain_collocations(rows, minimum, top=2000):
    words, counts = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        held = {p: c for p, c in f.items() if len(p) > 1 and c >= minimum}
        kept = []
        for p, a in held.items():
            score, _, l, r = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in held.items()):
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, words[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def corpus():
    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        vocabulary = ["a", "B", "the", "é", "of", "漢", "x-y", "zz"][: 3 + i % 6]
        text = "".join(str(rng.choice(vocabulary)) + str(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r", ":"])) for _ in range(60))
        rows.append((i, [None, "en", "de", "en"][i % 4], text + "new york city hall x " * (i % 3)))
    rows += [(900, "en", None), (901, "en", ""), (902, None, " \t\n.,"), (903, "en", "a " * 3000), (904, "und", "go on go on go on go on"), (None, "en", rows[1][2]), (None, "en", rows[1][2])]
    return rows


def as_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_collocations_against_plain_counting(spark):
    from rolefinch.llm.collocations import collocations

    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for minimum, top in ((3, 2000), (40, 2000), (5, 7)):
        want = plain_collocations([r[1:] for r in rows], minimum, top)
        assert as_rows(collocations(df, minimum, top=top)) == want and len(want) > 20
    clash = df.selectExpr("*", *(f"'z' as {c}" for c in "word one two n slot a firsts lasts first rest rank phrase score s e".split()))
    assert as_rows(collocations(clash, 40)) == as_rows(collocations(df, 40))


def test_collocations_in_several_blocks_and_rows(spark, monkeypatch):
    from rolefinch.llm import collocations as m

    monkeypatch.setattr(m, "BLOCK", 7)
    rows = corpus()
    assert as_rows(m.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), 10)) == plain_collocations([r[1:] for r in rows], 10)


def test_collocations_of_nothing(spark):
    from rolefinch.llm.collocations import collocations

    df = spark.createDataFrame([(1, "en", "a b"), (2, None, None)], SCHEMA)
    assert collocations(df.where("false")).collect() == [] and collocations(df).collect() == [] and collocations(df.where("doc_id = 2"), 1).collect() == []
    assert as_rows(collocations(df, 1)) == [("en", 1, "a b", 1, 1, 1, 2, 2000)]


def test_rows_of_slots_keep_neighbours_together(monkeypatch):
    from rolefinch.llm import collocations as m

    monkeypatch.setattr(m, "ROW", 5)
    s = np.array([-1, -1, 3, 4, -1, -1, 5, 6, 7, 8, 9, 10, 11, -1, 2, -1])
    rows = [np.frombuffer(b.column("s")[0].as_py(), np.int32).tolist() for b in m._rows(s, s)]
    assert [x for r in rows for x in r] == [-1, 3, 4, -1, 5, 6, 7, 8, 9, 10, 11, -1, 2, -1] and all(r[-1] == -1 for r in rows) and len(rows) == 2


def test_perfect_hash_against_a_dictionary():
    from rolefinch.llm.perfect_hash import PerfectHash

    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        table = PerfectHash(keys, keys[::-1].copy())
        assert sorted(table.slots(keys, keys[::-1])) == list(range(len(keys)))
        assert (table.keys[table.slots(keys, keys[::-1])] == keys).all()
        others = np.setdiff1d(rng.integers(0, 2**63, 1000).astype(np.uint64), keys)
        assert (table.slots(others, others) == -1).all()
        if n > 63:
            assert (table.slots(keys, keys) == -1).sum() > n // 2  # verified by the second key too
