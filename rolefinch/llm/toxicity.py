"""Toxicity: Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from labelled documents: words and stems far likelier in toxic ones. Every different word
of a chunk is matched by running its Levenshtein automaton along the trie, so that a misspelled term is found
without comparing the word to all terms. So are terms cut up by other characters: pieces with one or two such
characters between them, or single letters with spaces between them, are matched as one word. A hit's context window tells quotation (quote marks, words of report)
from abuse (address, exclamation); exact and misspelled hits, weighted by context, are the features of a
logistic model.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labels import SAMPLE, is_held_out, training_rows
from .shared import small_batches, unused
from .text import _SPACE, LOWER, Chunk, chunks, shingles, spans, words

WINDOW = 6  # words on each side of a hit

# Words of report and of address in the languages at hand.
REPORT = "said says saying quote quoted quotes wrote writes cited cites called word term sagte sagt schrieb zitat zitiert wort dit disait citation écrit mot dijo dice cita escribió palabra".split()
ADDRESS = "you your you're youre yourself u du dich dir dein deine ihr tu te toi vous ton ta tus usted ustedes eres".split()
QUOTES = "\"'«»“”„‘’‹›"

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[48:58] = _SEPARATOR[65:91] = _SEPARATOR[97:123] = False
_SEPARATOR[128:] = False
_QUOTE_BYTES = np.zeros(256, bool)
_QUOTE_BYTES[[34, 39]] = True


class Automaton:
    """The Levenshtein automata of all terms, run together over the trie of the terms.

    A state is the set of trie nodes that the letters read so far can have led to, each with the fewest edits. It
    is made deterministic as words need it: each state and each step from it is built once.
    """

    STATES = 60_000  # kept; then building starts anew

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.most: list[int] = [0]  # edits that some term below a node allows
        for k, t in enumerate(terms):
            node, d = 0, edits_allowed(len(t))
            self.most[0] = max(self.most[0], d)
            for ch in t:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.most.append(0)
                node = nxt
                self.most[node] = max(self.most[node], d)
            self.term[node] = k
        self.allowed = [edits_allowed(len(t)) for t in terms]
        self._reset()

    def _reset(self):
        self.states, self.number, self.steps, self.ends = [], {}, [], []
        self._add(self._closed({0: 0}))

    def _closed(self, nodes: dict[int, int]) -> frozenset:
        """With the nodes that missing letters lead to."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            e = nodes[node] + 1
            for nxt in self.children[node].values():
                if e <= self.most[nxt] and e < nodes.get(nxt, 99):
                    nodes[nxt] = e
                    todo.append(nxt)
        return frozenset(nodes.items())

    def _add(self, state: frozenset) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            ends = [(e, self.term[n]) for n, e in state if self.term[n] >= 0 and e <= self.allowed[self.term[n]]]
            self.ends.append(min(ends) if ends else None)
        return self.number[state]

    def _step(self, state: int, ch: str) -> int:
        out: dict[int, int] = {}

        def reach(node, e):
            if e <= self.most[node] and e < out.get(node, 99):
                out[node] = e

        for node, e in self.states[state]:
            reach(node, e + 1)  # a letter too many
            for own, nxt in self.children[node].items():
                reach(nxt, e + (own != ch))
        return self._add(self._closed(out)) if out else -1

    def search(self, word: str) -> tuple[int, int] | None:
        """(distance, term) of the nearest term within its edits; ties go to the first term."""
        if len(self.states) > self.STATES:
            self._reset()
        state = 0
        for ch in word:
            nxt = self.steps[state].get(ch)
            if nxt is None:
                nxt = self.steps[state][ch] = self._step(state, ch)
            if nxt < 0:
                return None
            state = nxt
        return self.ends[state]


def edits_allowed(n: int) -> int:
    return 0 if n < 5 else 1 if n < 8 else 2


class Lexicon:
    """Finds terms in chunks of text. ``weights`` are the terms' log odds."""

    def __init__(self, terms: list[str], weights: list[float]):
        self.terms, self.weights = terms, np.array(weights, np.float64)
        self.automaton = Automaton(terms)
        self.sizes = np.array([len(t) for t in terms], np.int64)
        self.bits = np.array([_letters(t.encode()) for t in terms], np.uint32)
        self.edits = np.array([edits_allowed(len(t)) for t in terms], np.int64)

    def __reduce__(self):
        return Lexicon, (self.terms, self.weights.tolist())

    def _near(self, sizes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Which words can be within a term's edits: one changes the number of characters by one at most, and which ASCII letters there are by two."""
        close = np.zeros(len(sizes), bool)
        for t, s, d in zip(self.bits, self.sizes, self.edits, strict=True):
            close |= (np.bitwise_count(letters ^ t) <= 2 * d) & (np.abs(sizes - s) <= d)
        return close

    def hits(self, c: Chunk):
        """Words of a chunk; for each word the matched term (or -1) and its distance. A term in pieces is matched at its first one, at a distance of one at least."""
        w = words(c, space=_SEPARATOR)
        term, far = np.full(len(w.start), -1, np.int64), np.zeros(len(w.start), np.int64)
        if not len(w.start) or not self.terms:
            return w, term, far
        _, index, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        characters = np.concatenate([[0], np.cumsum((c.buf & 0xC0) != 0x80)])
        sizes = characters[w.end] - characters[w.start]
        one = np.where(c.buf < 128, np.uint32(1) << (LOWER[c.buf] & 31).astype(np.uint32), np.uint32(0))
        letters = np.bitwise_or.reduceat(np.append(one, np.uint32(0)), np.stack([w.start, w.end], 1).ravel())[::2]
        low = LOWER[c.buf]
        spoken = lambda i: low[w.start[i] : w.end[i]].tobytes()
        found = {}
        for k in np.flatnonzero(self._near(sizes[index], letters[index])):
            got = self.automaton.search(spoken(index[k]).decode("utf-8", "replace"))
            if got:
                found[k] = got
        if found:
            t_of, d_of = np.full(len(index), -1, np.int64), np.zeros(len(index), np.int64)
            for k, (d, t) in found.items():
                t_of[k], d_of[k] = t, d
            term, far = t_of[inverse], d_of[inverse]
        taken = term >= 0
        known: dict[bytes, tuple[int, int] | None] = {}
        pieces = []
        for first, n in self._pieces(c, w, sizes, letters):
            word = b"".join(spoken(i) for i in range(first, first + n))
            if word not in known:
                known[word] = self.automaton.search(word.decode("utf-8", "replace"))
            if known[word]:
                pieces.append((known[word][0], -n, first, known[word][1]))
        for d, n, first, t in sorted(pieces):  # the fewest edits, then the most pieces
            if not taken[first : first - n].any():
                taken[first : first - n] = True
                term[first], far[first] = t, max(1, d)
        return w, term, far

    def _pieces(self, c: Chunk, w, sizes: np.ndarray, letters: np.ndarray):
        """(first word, number of words) of runs of two or more that together can be a term."""
        gap = w.start[1:] - w.end[:-1]
        blank = np.concatenate([[0], np.cumsum(_SPACE[c.buf])])
        apart = blank[w.start[1:]] > blank[w.end[:-1]]
        linked = np.append((w.doc[1:] == w.doc[:-1]) & (gap <= 2) & (~apart | ((sizes[1:] == 1) & (sizes[:-1] == 1))), False)
        most = self.sizes.max() + self.edits.max()
        first = np.flatnonzero(linked)
        size, bits, n = sizes[first], letters[first], 1
        while len(first):
            size, bits, n = size + sizes[first + n], bits | letters[first + n], n + 1
            fits = size <= most
            first, size, bits = first[fits], size[fits], bits[fits]
            for k in first[self._near(size, bits)].tolist():
                yield k, n
            more = linked[first + n - 1]
            first, size, bits = first[more], size[more], bits[more]

    def features(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """A row of features for each text of a chunk, and its number of hits."""
        n = c.hi - c.lo
        w, term, far = self.hits(c)
        at = np.flatnonzero(term >= 0)
        out = np.zeros((n, 8))
        if not len(at):
            return out, np.zeros(n, np.int64)
        doc = w.doc[at]
        lo, hi = np.maximum(at - WINDOW, w.first[doc]), np.minimum(at + WINDOW + 1, w.first[doc + 1])
        around = lambda flag: (lambda s: s[hi] - s[lo])(np.concatenate([[0], np.cumsum(flag)]))
        report, address = around(np.isin(w.hash, _hashes(tuple(REPORT)))), around(np.isin(w.hash, _hashes(tuple(ADDRESS))))
        left, right = w.start[lo], np.where(hi < w.first[doc + 1], w.start[np.minimum(hi, len(w.start) - 1)], c.offsets[doc + 1])
        quotes = np.concatenate([[0], np.cumsum(_QUOTE_BYTES[c.buf] | ((c.buf == 0xC2) & np.isin(np.append(c.buf[1:], 0), [0xAB, 0xBB])) | ((c.buf == 0xE2) & (np.append(c.buf[1:], 0) == 0x80) & (np.append(c.buf[2:], [0, 0])[: len(c.buf)] >= 0x98)))])
        shouts = np.concatenate([[0], np.cumsum(c.buf == 33)])
        quoted = 1.5 * np.minimum(2, quotes[right] - quotes[left]) + 1.0 * report
        abused = 1.0 + address + 0.5 * np.minimum(2, shouts[right] - shouts[left])
        share = 1 / (1 + np.exp(-np.clip(abused - quoted, -20, 20)))
        weight = self.weights[term[at]]
        for k, v in enumerate((np.where(far[at] == 0, weight * share, 0), np.where(far[at] > 0, weight * share, 0), np.where(far[at] == 0, weight * (1 - share), 0), np.where(far[at] > 0, weight * (1 - share), 0), far[at] == 0, far[at] > 0)):
            out[:, k] = np.log1p(np.bincount(doc, v, n))
        exact = at[far[at] == 0]
        np.maximum.at(out[:, 6], w.doc[exact], self.weights[term[exact]])
        kinds = np.unique(np.stack([w.doc[exact], term[exact]]), axis=1)
        out[:, 7] = np.log1p(np.bincount(kinds[0], minlength=n))
        return out, np.bincount(doc, minlength=n)


def _letters(word: bytes) -> int:
    out = 0
    for b in word:
        out |= 1 << (int(LOWER[b]) & 31) if b < 128 else 0
    return out


@lru_cache(8)
def _hashes(listed: tuple[str, ...]) -> np.ndarray:
    raw = [x.encode() for x in listed]
    end = np.cumsum([len(x) for x in raw])
    return spans(np.frombuffer(b"".join(raw), np.uint8), end - [len(x) for x in raw], end, lower=True)


class Logistic:
    """Logistic regression by Newton steps, with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2):
        x1 = np.hstack([x, np.ones((len(x), 1))])
        self.w = np.zeros(x1.shape[1])
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.1
        self.w[-1] = np.log(share / (1 - share))
        if len(y) >= 8 and 0 < y.sum() < len(y):
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(x1 @ self.w, -30, 30)))
                penalty = np.full(len(self.w), ridge)
                penalty[-1] = 1e-6
                h = x1.T @ (x1 * (p * (1 - p))[:, None]) / len(y) + np.diag(penalty)
                step = np.linalg.solve(h, x1.T @ (p - y) / len(y) + penalty * self.w)
                self.w = self.w - np.clip(step, -4, 4)
                if np.abs(step).max() < 1e-6:
                    break

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.w[:-1] + self.w[-1], -30, 30)))


def learn_lexicon(train: DataFrame, terms: int | None = None) -> Lexicon:
    """Words of three letters or more far likelier in toxic texts of ``train(id, text, y)``; texts that share their least shingle hash, as near copies do, count once."""

    def listed(batches):
        for b in batches:
            ys = b.column("y").to_pylist()
            for c in chunks(b.column("text")):
                s, first = shingles(words(c))
                w = words(c, space=_SEPARATOR)
                for d in range(c.hi - c.lo):
                    own = range(w.first[d], w.first[d + 1])
                    text = LOWER[c.buf].tobytes() if d == 0 else text
                    seen = {text[w.start[i] : w.end[i]] for i in own if 3 <= w.end[i] - w.start[i] <= 40}
                    least = int(s[first[d] : first[d + 1]].min().astype(np.int64)) if first[d + 1] > first[d] else 0
                    yield pa.RecordBatch.from_arrays([pa.array([least]), pa.array([ys[c.lo + d]], pa.int32()), pa.array([sorted(x.decode("utf-8", "replace") for x in seen)], pa.list_(pa.string()))], ["least", "y", "terms"])

    docs = train.select("text", "y").mapInArrow(listed, "least long, y int, terms array<string>").groupBy("least").agg(F.max("y").alias("y"), F.min("terms").alias("terms"))
    sizes = docs.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    p, n = sizes["p"] or 0, (sizes["n"] or 0) - (sizes["p"] or 0)
    if not p or not n:
        return Lexicon([], [])
    each = docs.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (p + 1)) - F.log((F.col("b") + 0.5) / (n + 1))
    least = max(2, round(0.01 * p))
    kept = each.where(F.col("a") >= least).withColumn("odds", odds).where(F.col("odds") > 2.3).withColumn("rank", F.col("odds") * F.sqrt("a"))
    kept = kept.orderBy(F.col("rank").desc(), "term")
    rows = (kept if terms is None else kept.limit(terms)).collect()  # each is in a hundredth of the toxic texts at least
    return Lexicon([r["term"] for r in rows], [r["odds"] for r in rows])


def score_toxicity(docs: DataFrame, labels: DataFrame, buckets: int = 4, held_out: int = 2, threshold: float = 0.3, sample: int = SAMPLE, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``held_out, score, predicted, n_hits``; earlier columns of these names are replaced.

    ``score`` is the probability of label 1. Null, empty and wordless texts have no hits and score as such.
    Without labels of both kinds the lexicon is empty and every score is the label's smoothed share. A null id is
    kept and not held out; repeated rows each get their score. Very long texts are read whole, one at a time. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    train = training_rows(docs, labels, label, buckets, held_out, sample, id_col, text_col)
    lexicon = spark.sparkContext.broadcast(learn_lexicon(train))

    def features(batches):
        for b in batches:
            for c in chunks(b.column("text")):
                f, _ = lexicon.value.features(c)
                yield pa.RecordBatch.from_arrays([b.column("y").slice(c.lo, c.hi - c.lo), pa.array([x.tobytes() for x in f], pa.binary())], ["y", "x"])

    got = train.select("text", "y").mapInArrow(features, "y int, x binary").collect()
    got.sort(key=lambda r: (r["y"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float64) for r in got]) if got else np.zeros((0, 8))
    model = spark.sparkContext.broadcast(Logistic(x, np.array([r["y"] for r in got], np.float64)))
    keep = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted", "n_hits")]
    text = unused(docs, "text_")
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).cast("string").alias(text))

    def score(batches):
        for b in batches:
            got = [lexicon.value.features(c) for c in chunks(b.column(text))]
            p = np.concatenate([model.value.probability(f) for f, _ in got]) if got else np.empty(0)
            n = np.concatenate([h for _, h in got]) if got else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p), pa.array(n)], [*keep, "score", "n_hits"])

    out = source.mapInArrow(score, T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.LongType())]))
    return out.select(*(F.col(f"`{c}`") for c in keep), is_held_out(F.col(id_col), buckets, held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")
