"""Word vectors and pooling of the quality classifier, and languages by the hundred, against plain Python."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

TEXTS = ["The cat sat on the mat", "a Cat, a MAT! x9 x9", "", "one", None, "ünï 漢字 The The THE cat. " * 7, "\n\t two  words"]


def plain_slots(c):
    """(slot, shape slot, sign and place of each index entry) of each word of each text."""
    from rolefinch.llm.quality import DIM, _slots
    from rolefinch.llm.text import mix

    w, slot, shape = _slots(c)
    out = defaultdict(list)
    for i in range(len(w.start)):
        h = int(mix(np.array([w.hash[i] + np.uint64(99)], np.uint64))[0])
        entries = [((h >> 8 * k) % DIM, -1 if h >> (40 + k) & 1 else 1) for k in (0, 1)]
        out[int(w.doc[i])].append((int(slot[i]), int(shape[i]), entries))
    return out


def chunked(texts):
    from rolefinch.llm.text import chunks

    (c,) = chunks(pa.array(texts))
    return c


def test_context_vectors_against_plain_sums(spark):
    from rolefinch.llm.quality import DIM, REACH, SHAPES, SLOTS, context_vectors

    sums = np.zeros((SLOTS + SHAPES, DIM))
    for words in plain_slots(chunked(TEXTS)).values():
        for i, (slot, shape, _) in enumerate(words):
            for j in range(max(0, i - REACH), min(len(words), i + REACH + 1)):
                for place, sign in words[j][2] if i != j else ():
                    sums[slot, place] += sign
                    sums[shape, place] += sign
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    want = (sums - sums.mean(axis=0)).astype(np.float32)
    got = context_vectors(spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3))
    assert got == pytest.approx(want, abs=1e-6) and np.abs(sums).max() > 0.1


def test_pooling_against_plain_means():
    from rolefinch.llm.quality import DIM, SHAPES, SLOTS, pooled

    vectors = np.random.default_rng(3).normal(0, 1, (SLOTS + SHAPES, DIM)).astype(np.float32)
    c = chunked(TEXTS)
    got, words = pooled(c, vectors), plain_slots(c)
    for d in range(len(TEXTS)):
        own = words.get(d, [])
        want = [x for k in (0, 1) for x in (np.mean([vectors[w[k]] for w in own], axis=0), np.std([vectors[w[k]] for w in own], axis=0))] if own else [np.zeros(DIM)] * 4
        assert got[d] == pytest.approx(np.concatenate([*want, [np.log1p(len(own))]]), abs=2e-3)


def test_network_is_calibrated():
    from rolefinch.llm.quality import Network

    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (4000, 6))
    share = 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1] * x[:, 2]))
    y = (rng.random(4000) < share).astype(float)
    p = Network(x[:2000], y[:2000]).probability(x[2000:])
    for lo in (0.0, 0.25, 0.5, 0.75):
        some = (p >= lo) & (p < lo + 0.25)
        assert abs(p[some].mean() - y[2000:][some].mean()) < 0.08
    assert (Network(x[:5], y[:5]).probability(x) == y[:5].mean()).all() and (Network(x[:0], y[:0]).probability(x) == 0.5).all()


def made_up(n, rng):
    """Documents of ``n`` languages, each of syllables of its own."""
    rows = []
    for k in range(n):
        syllables = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(12)]
        for i in range(30):
            rows.append((30 * k + i, f"lang{k:03}", " ".join("".join(rng.choice(syllables, 2)) for _ in range(25))))
    return rows


def test_a_hundred_languages(spark):
    """Each language has a tree of its own contexts only: the model is the sum of the languages', and told by its texts."""
    from rolefinch.llm import langid

    rows = made_up(100, np.random.default_rng(4))
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    truth = {i: lang for i, lang, _ in rows}
    got = langid.identify(df).collect()
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.99
    sizes = [sum(len(k) for k in t.keys) for t in langid.train(df.select("lang", "text")).trees]
    alone = [sum(len(k) for k in langid.train(df.where(f"lang = 'lang{k:03}'").select("lang", "text")).trees[0].keys) for k in (0, 57)]
    assert len(sizes) == 100 and [sizes[0], sizes[57]] == alone


def test_a_model_over_its_bound_is_refused(spark, monkeypatch):
    from rolefinch.llm import langid

    monkeypatch.setattr(langid, "MODEL_BYTES", 1000)
    with pytest.raises(ValueError, match="fewer documents"):
        langid.identify(spark.createDataFrame(made_up(2, np.random.default_rng(4)), "doc_id long, lang string, text string"))
