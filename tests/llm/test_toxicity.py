"""Disguised terms, and the features of the toxicity model, against plain Python."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from .test_operators import edit_distance

TERMS = ["stupid", "worthless", "idiot", "hate", "übelst"]


def chunked(texts):
    from rolefinch.llm.text import chunks

    (c,) = chunks(pa.array(texts))
    return c


def pieces(text):
    """(word, whether a space stands before it, characters before it that belong to no word)"""
    out, at = [], 0
    for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+", text):
        out.append((m[0].lower() if m[0].isascii() else "".join(x.lower() if x.isascii() else x for x in m[0]), text[at : m.start()]))
        at = m.end()
    return out


def plain_hits(text, terms):
    """{piece: (term, distance)}: whole pieces first, then runs of linked pieces, the fewest edits and the longest run first."""
    from rolefinch.llm.toxicity import edits_allowed

    def nearest(word):
        near = [(d, k) for k, x in enumerate(terms) if (d := edit_distance(word, x)) <= edits_allowed(len(x))]
        return min(near) if near else None

    p = pieces(text)
    out = {i: (x[1], x[0]) for i, (w, _) in enumerate(p) if (x := nearest(w))}
    taken = set(out)
    runs = []
    for i in range(len(p)):
        for j in range(i + 1, len(p)):
            gap, one = p[j][1], len(p[j][0]) == len(p[j - 1][0]) == 1
            if len(gap) > 2 or (re.search(r"[\s]", gap) and not one):
                break
            if x := nearest("".join(w for w, _ in p[i : j + 1])):
                runs.append((x[0], -(j - i + 1), i, x[1]))
    for d, n, i, t in sorted(runs):
        if not taken & set(range(i, i - n)):
            taken |= set(range(i, i - n))
            out[i] = (t, max(1, d))
    return out


@pytest.mark.parametrize("text", ["st*pid", "s.t.u.p.i.d", "worth-less", "stu_pid", "s t u p i d", "s-t-u-p-1-d", "You ST*PID!", "w.o.r.t.h.l.e.s.s", "h a t e", "i.d-i.o*t", "wor..thless", "über", "so very un-stu_pid"])
def test_disguised_terms(text):
    from rolefinch.llm.toxicity import Lexicon

    _, term, far = Lexicon(TERMS, [1.0] * 5).hits(chunked([text]))
    assert {i: (int(t), int(d)) for i, (t, d) in enumerate(zip(term, far)) if t >= 0} == plain_hits(text, TERMS)
    assert (term >= 0).sum() == (text not in ("über",))


def test_words_side_by_side_are_no_term():
    from rolefinch.llm.toxicity import Lexicon

    _, term, _ = Lexicon(TERMS, [1.0] * 5).hits(chunked(["stu pid worth less h ate", "stu", "pid", "stu---pid", "a b c d e f g h i"]))
    assert (term < 0).all()


def test_hits_of_random_texts_against_plain_matching():
    from rolefinch.llm.toxicity import Lexicon

    rng = np.random.default_rng(17)
    texts = ["".join(str(rng.choice(["s", "st", "tu", "pid", "stupid", "worth", "less", "wrth", "h", "hate", "at", "übel", "st", "x", "idiot", "i", "d"])) + str(rng.choice(["", "", " ", "  ", "-", "*", "._", ". ", "---", "\n"])) for _ in range(12)) for _ in range(400)]
    w, term, far = Lexicon(TERMS, [1.0] * 5).hits(chunked(texts))
    for d, text in enumerate(texts):
        lo, hi = w.first[d], w.first[d + 1]
        assert {i: (int(term[lo + i]), int(far[lo + i])) for i in range(hi - lo) if term[lo + i] >= 0} == plain_hits(text, TERMS), text


def plain_features(text, terms, weights):
    from rolefinch.llm.toxicity import ADDRESS, QUOTES, REPORT, WINDOW

    p = pieces(text)
    words, hits = [w for w, _ in p], plain_hits(text, terms)
    starts = [m.start() for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+", text)]
    sums, best, kinds = [0.0] * 6, 0.0, set()
    for i, (t, d) in hits.items():
        lo, hi = max(0, i - WINDOW), min(len(p), i + WINDOW + 1)
        around = text[starts[lo] : starts[hi] if hi < len(p) else len(text)]
        quoted = 1.5 * min(2, sum(ch in QUOTES for ch in around)) + sum(x in REPORT for x in words[lo:hi])
        abused = 1.0 + sum(x in ADDRESS for x in words[lo:hi]) + 0.5 * min(2, around.count("!"))
        share = 1 / (1 + math.exp(-(abused - quoted)))
        k = int(d > 0)
        sums[k] += weights[t] * share
        sums[2 + k] += weights[t] * (1 - share)
        sums[4 + k] += 1
        if not d:
            best, kinds = max(best, weights[t]), kinds | {t}
    return [*map(math.log1p, sums), best, math.log1p(len(kinds))]


def test_features_and_context_shares_against_plain_python():
    from rolefinch.llm.toxicity import Lexicon

    weights = [2.5, 3.0, 4.5, 2.4, 3.3]
    rng = np.random.default_rng(23)
    bag = ["you", "are", "stupid", "stu_pid", "idiot", "idiott", "he", "said", "wrote", "the", "word", '"stupid"', "“hate”", "hate!", "‘worthless’", "wort", "dein", "übelst", "ubelst!", "fine", "day", "!", "«", "»", "c'est"]
    texts = [" ".join(map(str, rng.choice(bag, int(rng.integers(0, 40))))) for _ in range(300)]
    got, n = Lexicon(TERMS, weights).features(chunked(texts))
    for k, text in enumerate(texts):
        assert got[k] == pytest.approx(plain_features(text, TERMS, weights), abs=1e-9), text
        assert n[k] == len(plain_hits(text, TERMS))
    said, meant = Lexicon(TERMS, weights).features(chunked(['He said the word "stupid" and wrote it.', "You are stupid!"]))[0]
    assert said[2] > said[0] and meant[0] > meant[2]
