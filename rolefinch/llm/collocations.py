"""Phrase collocations of each language by level-wise counting over minimal perfect hashes.

A phrase can only be frequent if its first and its last words but one are (Apriori). So phrases of k words are
looked for where two frequent phrases of k - 1 words overlap, and a phrase's key is a pair of whole numbers: the
slot of its first k - 1 words and the slot of its last word. Words themselves are keyed by 128 bits of hash.

For each length, tasks report what they see of such phrases, counts cut off at the minimum: enough to tell which
phrases reach it, the candidates. A minimal perfect hash gives every candidate a slot; the texts, held as arrays of
slots from the first length on, get the slots of the longer phrases, each lookup verified by the stored key; the tasks
count slots in arrays, which the executors add up. A phrase keeps the counts of all its beginnings and ends, so each
cut is read from the counts of two slots. Candidates are hashed in blocks of ``BLOCK`` keys, so what is broadcast and
counted at once has a fixed size; there are as many passes over the arrays as there are blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .perfect_hash import PerfectHash
from .shared import merged_counters, small_batches, stage, unstage
from .text import LOWER, Chunk, chunks, give_back, mix, running, spans_of, words

LONGEST = 5
MINIMUM = 100
TOP = 2000
BLOCK = 1 << 22  # keys of one perfect hash
ROW = 1 << 14  # slots in a row of the arrays, more only without a break
SEEN = 1 << 18  # slots whose phrases are told together

_SPACE = np.zeros(256, bool)
_SPACE[[9, 32]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_OTHER = np.argsort(mix(np.arange(257, 513, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))).astype(np.uint8)  # the bytes in another order


def _lang_keys(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Chunk, object, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of texts with their languages, words, which words begin a piece, and two 64-bit keys of each word."""
    for b in batches:
        langs = b.column(0).to_pylist()
        for c in chunks(b.column(1)):
            w = words(c, True, _SPACE | _BREAK)
            ends = np.concatenate([[0], np.cumsum(_BREAK[c.buf])])
            fresh = np.ones(len(w.start), bool)
            fresh[1:] = (ends[w.start[1:]] != ends[w.end[:-1]]) | (w.doc[1:] != w.doc[:-1])
            lang = _lang_keys(langs[c.lo : c.hi])[w.doc]
            other = spans_of(running(_OTHER[LOWER[c.buf]]), w.start, w.end)
            yield langs[c.lo : c.hi], c, w, fresh, mix(w.hash ^ lang), mix(other + lang)


def _seen_words(minimum: int):
    def of(batches):
        for langs, c, w, _, one, two in _read(batches):
            low = LOWER[c.buf]
            _, at, n = np.unique(one, return_index=True, return_counts=True)
            said = [low[s:e].tobytes().decode() for s, e in zip(w.start[at], w.end[at])]
            per = np.diff(w.first)
            whole = {x: 0 for x in langs}
            for x, k in zip(langs, per.tolist()):
                whole[x] += k
            yield pa.RecordBatch.from_arrays([
                pa.array([langs[d] for d in w.doc[at]] + list(whole), pa.string()), pa.array(said + [None] * len(whole), pa.string()),
                pa.concat_arrays([pa.array(one[at].view(np.int64)), pa.nulls(len(whole), pa.int64())]), pa.concat_arrays([pa.array(two[at].view(np.int64)), pa.nulls(len(whole), pa.int64())]),
                pa.array(np.concatenate([np.minimum(n, minimum), np.array(list(whole.values()), np.int64)]).astype(np.int64)),
            ], ["lang", "word", "one", "two", "n"])

    return of


def _rows(s: np.ndarray, e: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Arrays of slots as rows, cut at breaks (-1); breaks in a row are one."""
    if len(s):
        kept = (s >= 0) | (np.concatenate([[0], s[:-1]]) >= 0)
        s, e = s[kept], None if e is None else e[kept]
    breaks = np.flatnonzero(s < 0) + 1
    lo, parts = 0, []
    while lo < len(s):
        k = np.searchsorted(breaks, lo + ROW)
        hi = int(breaks[k]) if k < len(breaks) else len(s)
        parts.append((lo, hi))
        lo = hi
    for lo, hi in parts:
        yield pa.RecordBatch.from_arrays([pa.array([s[lo:hi].astype(np.int32).tobytes()], pa.binary()), pa.array([None if e is None else e[lo:hi].astype(np.int32).tobytes()], pa.binary())], ["s", "e"])


def _arrays(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots of phrases and of their last words, rows joined behind a break until there are many."""
    held, size = [], 0

    def joined():
        return tuple(np.concatenate([x for pair in held for x in (pair[k], [np.int32(-1)])]) for k in (0, 1))

    for b in batches:
        for s, e in zip(b.column("s"), b.column("e")):
            s = np.frombuffer(s.as_buffer(), np.int32)
            held.append((s, np.frombuffer(e.as_buffer(), np.int32) if e.is_valid else s))
            size += len(s)
            if size >= SEEN:
                yield joined()
                held, size = [], 0
                give_back()
    if held:
        yield joined()


def _longer(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two phrases overlap, and the keys of the phrases one word longer."""
    at = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
    return at, (s[at].astype(np.int64) << 32) | e[at + 1]


def _seen_phrases(minimum: int):
    def of(batches):
        for s, e in _arrays(batches):
            at, keys = _longer(s, e)
            keys, first, n = np.unique(keys, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(s[at[first] + 1].astype(np.int64)), pa.array(np.minimum(n, minimum).astype(np.int64))], ["one", "rest", "n"])

    return of


def _blocks(candidates: DataFrame, cols: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The candidates' keys, in blocks of about ``BLOCK`` of a hash range, with the slot at which each block begins."""
    n = candidates.count()
    parts, lo = -(-n // BLOCK), 0
    for k in range(parts):
        rows = candidates.where(F.pmod(F.xxhash64("one"), F.lit(parts)) == k).select(*cols).toArrow()
        yield lo, [rows.column(c).to_numpy().view(np.uint64) for c in cols]
        lo += rows.num_rows
    if lo >= 1 << 31:
        raise ValueError("more than 2^31 frequent phrases of one length")


def _slotted(candidates: DataFrame, hashes: list, counts: list, schema: str, cols: list[str]) -> DataFrame:
    """``candidates`` with ``slot`` and the count read there."""
    out = None
    for k, (known, n) in enumerate(zip(hashes, counts)):
        said = candidates.sparkSession.sparkContext.broadcast(n)

        def read(batches, known=known, said=said):
            lo, table = known.value
            for b in batches:
                keys = [b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("one", "two") if c in b.schema.names]
                slot = table.slots(*keys)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(lo + slot), pa.array(said.value[slot])], [*cols, "slot", "a"])

        part = candidates.where(F.pmod(F.xxhash64("one"), F.lit(len(hashes))) == k).mapInArrow(read, f"{schema}, slot long, a long")
        out = part if out is None else out.unionByName(part)
    return out


def _counts(arrays: DataFrame, hashes: list) -> list[np.ndarray]:
    out = []
    for known in hashes:
        lo, table = known.value
        size = len(table)

        def slots(batches, lo=lo, size=size):
            total = np.zeros(size, np.int64)
            for s, _ in _arrays(batches):
                found, n = np.unique(s[(s >= lo) & (s < lo + size)], return_counts=True)
                total[found - lo] += n
            return total

        out.append(merged_counters(arrays, slots, size, np.int64))
    return out


def _fill_words(docs: DataFrame, hashes: list) -> DataFrame:
    """Arrays of word slots; a word that is not frequent, and the end of a piece, is a break."""

    def of(batches):
        for _, _, w, fresh, one, two in _read(batches):
            slot = np.full(len(one), -1, np.int64)
            for known in hashes:
                lo, table = known.value
                found = table.slots(one, two)
                slot[found >= 0] = lo + found[found >= 0]
            at = np.arange(len(slot)) + np.cumsum(fresh)
            s = np.full(len(slot) + int(fresh.sum()) + 1, -1, np.int64)
            s[at] = slot
            yield from _rows(s, None)

    return docs.mapInArrow(of, "s binary, e binary")


def _fill_phrases(arrays: DataFrame, hashes: list) -> DataFrame:
    def of(batches):
        for s, e in _arrays(batches):
            at, keys = _longer(s, e)
            slot = np.full(len(keys), -1, np.int64)
            for known in hashes:
                lo, table = known.value
                found = table.slots(keys.view(np.uint64))
                slot[found >= 0] = lo + found[found >= 0]
            new, last = np.full(len(s), -1, np.int64), np.full(len(s), -1, np.int64)
            new[at], last[at] = slot, e[at + 1]
            yield from _rows(new, last)

    return arrays.mapInArrow(of, "s binary, e binary")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) in decimals of 38 digits."""
    up = (a * 1000).cast("decimal(20,0)") * n.cast("decimal(18,0)")
    return F.call_function("div", up, left.cast("decimal(19,0)") * right.cast("decimal(19,0)")).cast("long")


def collocations(docs: DataFrame, minimum: int = MINIMUM, longest: int = LONGEST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs.
    A phrase counts wherever its words stand in a row within a piece. A candidate is a phrase with a count a of
    ``minimum`` at least; of its cuts into two parts, with counts l and r, the one of the least
    floor(1000 a n / (l r)) counts, the earliest of several (n: all words of the language). A candidate that a longer
    one holds, with the same count, is left out. Order: score, a, both descending, then the phrase. Null texts are
    empty, a null language is ``und``; repeated rows count each; no candidate gives no row. Very long texts are read
    whole, one at a time. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    broadcast = spark.sparkContext.broadcast
    staged: list[DataFrame] = []

    def hold(df: DataFrame, name: str) -> DataFrame:
        staged.append(stage(df, name))
        return staged[-1]

    try:
        seen = hold(texts.mapInArrow(_seen_words(minimum), "lang string, word string, one long, two long, n long").groupBy("lang", "word", "one", "two").agg(F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= minimum)), "words")
        sizes = seen.where("word is null").select("lang", "n")
        found, arrays, levels = seen.where("word is not null").drop("n"), None, []
        for k in range(1, longest + 1):
            cols = ["one", "two"] if k == 1 else ["one"]
            hashes = [broadcast((lo, PerfectHash(*keys))) for lo, keys in _blocks(found, cols)]
            if not hashes:
                break
            filled = hold(_fill_words(texts, hashes) if k == 1 else _fill_phrases(arrays, hashes), "slots")
            if arrays is not None:
                unstage(arrays)
            arrays = filled
            counts = _counts(arrays, hashes)
            if k == 1:
                level = _slotted(found, hashes, counts, "lang string, word string", ["lang", "word"])
                level = level.select("lang", F.col("word").alias("phrase"), "slot", "a", F.array("a").alias("firsts"), F.array("a").alias("lasts"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("rest"))
            else:
                own = _slotted(found, hashes, counts, "one long, rest long", ["one", "rest"]).select(F.shiftright("one", 32).alias("first"), "rest", "slot", "a")
                p = levels[-1].select(F.col("slot").alias("first"), "lang", F.col("phrase").alias("p"), "firsts")
                q = levels[-1].select(F.col("slot").alias("rest"), F.substring_index("phrase", " ", -1).alias("q"), "lasts")
                level = own.join(p, "first").join(q, "rest").select("lang", F.concat("p", F.lit(" "), "q").alias("phrase"), "slot", "a", F.concat("firsts", F.array("a")).alias("firsts"), F.concat("lasts", F.array("a")).alias("lasts"), "first", "rest")
            levels.append(hold(level, f"phrases{k}"))
            for known in hashes:
                known.unpersist()
            if k < longest:
                seen = arrays.mapInArrow(_seen_phrases(minimum), "one long, rest long, n long").groupBy("one", "rest").agg(F.sum("n").alias("n"))
                found = hold(seen.where(F.col("n") >= minimum).drop("n"), "candidates")
        rows = None
        for k, level in enumerate(levels[1:], 2):
            cuts = F.array(*(F.struct(_score(F.col("a"), F.col("n"), F.get("firsts", F.lit(j)), F.get("lasts", F.lit(k - 2 - j))).alias("score"), F.lit(j).alias("cut"), F.get("firsts", F.lit(j)).alias("l"), F.get("lasts", F.lit(k - 2 - j)).alias("r")) for j in range(k - 1)))
            part = level.join(sizes, "lang").withColumn("cut", F.array_min(cuts))
            if k < len(levels):  # what a phrase one word longer holds as often; a longer one still has one of those between
                over = levels[k].select(F.explode(F.array("first", "rest")).alias("slot"), "a").distinct()
                part = part.join(over, ["slot", "a"], "left_anti")
            part = part.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
        order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
        best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return stage(best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    finally:
        unstage(*staged)

