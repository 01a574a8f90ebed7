"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to ``ORDER``: how often each byte followed each context, whatever
the bytes are, white space included. A byte's code length is that of its longest known context: if the byte was
seen there c times among n, of q different ones, it costs -log2(c / (n + q)), else the escape -log2(q / (n + q))
and what the shorter context asks; below order 0 all 256 bytes are equally likely. The first bytes of a text have
shorter contexts. A byte belongs to a context of two bytes or more only if it followed it ``FLOOR`` times or more
in the texts learned from. Statistics are frozen: counted before anything is scored, so a byte's code length
depends on itself and the ``ORDER`` bytes before it, and a text's is the sum over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labels import is_held_out
from .shared import small_batches, stage, unstage
from .text import Chunk, chunks

ORDER = 4
CHUNK = 1_000_000  # bytes scored or counted at once
FLOOR = 2
ENTRY, MODEL_BYTES = 32, 600_000_000  # bytes of an entry of a tree, and of all trees, which every worker gets
PER_LANGUAGE = 2_000  # documents that a language is learned from, about, where it has more
_LETTER = regex.compile(r"\p{L}")


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << 8 * (order + 1)) - 1)


def _parts(c: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of a chunk: each byte with the ``ORDER`` before it as one number, its text, and its place there up to ``ORDER``."""
    for lo in range(0, len(c.buf), CHUNK):
        hi = min(len(c.buf), lo + CHUNK)
        back = max(0, lo - ORDER)
        wide = c.buf[back:hi].astype(np.uint64)
        full = wide.copy()
        for order in range(1, ORDER + 1):
            full[order:] |= wide[:-order] << np.uint64(8 * order)
        of = np.repeat(np.arange(len(c.offsets) - 1), np.diff(np.clip(c.offsets, lo, hi)))
        yield full[lo - back :], of, np.minimum(ORDER, np.arange(lo, hi) - c.offsets[of])


class Tree:
    """Code lengths of all contexts that one language knows; one table for each order."""

    def __init__(self, order: np.ndarray, key: np.ndarray, count: np.ndarray):
        """``count[i]`` is how often the last byte of ``key[i]`` followed the bytes before it."""
        self.keys, self.bits, self.contexts, self.escapes = [], [], [], []
        for o in range(ORDER + 1):
            at = np.flatnonzero(order == o)
            at = at[np.argsort(key[at])]
            k, c = key[at], count[at].astype(np.float64)
            uniq, inverse, kinds = np.unique(k >> np.uint64(8), return_inverse=True, return_counts=True)
            total = np.bincount(inverse, c, len(uniq))
            self.keys.append(k)
            self.bits.append(-np.log2(c / (total + kinds)[inverse]))
            self.contexts.append(uniq)
            self.escapes.append(-np.log2(kinds / (total + kinds)))

    def code(self, key: np.ndarray, order: int) -> np.ndarray:
        """Code lengths of bytes in contexts of one order, known or not."""
        out = np.zeros(len(key))
        at = np.arange(len(key))
        for o in range(order, -1, -1):
            i, hit = _find(self.keys[o], key)
            out[at[hit]] += self.bits[o][i[hit]]
            key, at = key[~hit], at[~hit]
            i, known = _find(self.contexts[o], key >> np.uint64(8))
            out[at[known]] += self.escapes[o][i[known]]
            if o:
                key = key & _mask(o - 1)
        out[at] += 8.0
        return out


class Model:
    """The trees of all languages."""

    def __init__(self, langs: list[str], trees: list[Tree]):
        self.langs, self.trees = langs, trees

    def totals(self, c: Chunk) -> np.ndarray:
        """Code length of each text of a chunk for each language, one language after another."""
        n = len(c.offsets) - 1
        out = np.zeros((n, len(self.langs)))
        for full, of, place in _parts(c):
            for order in range(ORDER + 1):
                at = np.flatnonzero(place == order)
                # Equal bytes in equal contexts of a text are looked up once, in order.
                pair = np.sort((of[at].astype(np.uint64) << np.uint64(40)) | (full[at] & _mask(order)))
                first = np.flatnonzero(np.diff(pair, prepend=~pair[:1]))
                times = np.diff(first, append=len(pair))
                pair = pair[first]
                # All texts ask a tree for the same contexts: each is looked up once, in order of the tables.
                key, inverse = np.unique(pair & _mask(ORDER), return_inverse=True)
                own = (pair >> np.uint64(40)).astype(np.int64)
                for k, tree in enumerate(self.trees):
                    out[:, k] += np.bincount(own, tree.code(key, order)[inverse] * times, n)
        return out


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


def train(texts: DataFrame) -> Model:
    """Context trees of ``texts(lang, text)``, counted on the executors; the counts that pass ``FLOOR`` come to the driver."""

    def count(batches):
        for b in batches:
            langs = b.column("lang").to_pylist()
            for c in chunks(b.column("text"), CHUNK):
                names = sorted(set(langs[c.lo : c.hi]))
                lang_of = np.array([names.index(x) for x in langs[c.lo : c.hi]], np.int64)
                for full, of, place in _parts(c):
                    for k, name in enumerate(names):
                        own = lang_of[of] == k
                        for order in range(ORDER + 1):
                            keys, n = np.unique(full[own & (place >= order)] & _mask(order), return_counts=True)
                            of_name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(keys), np.int32)), pa.array([name])).dictionary_decode()
                            yield pa.RecordBatch.from_arrays([of_name, pa.array(np.full(len(keys), order, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "order", "key", "n"])

    counts = texts.select("lang", "text").mapInArrow(count, "lang string, order int, key long, n long").groupBy("lang", "order", "key").agg(F.sum("n").alias("n"))
    counts = stage(counts.where(F.expr(f"order < 2 or n >= {FLOOR}")), "contexts")
    try:
        sizes = {r["lang"]: r["k"] for r in counts.groupBy("lang").agg(F.count("*").alias("k")).collect()}  # a row for each language
        if ENTRY * sum(sizes.values()) > MODEL_BYTES:
            raise ValueError(f"the context trees of {len(sizes)} languages would take more than {MODEL_BYTES} bytes; learn from fewer documents of each")
        trees = []
        for lang in sorted(sizes):
            got = counts.where(F.col("lang") == lang).select("order", "key", "n").toArrow()
            order, key, n = (got.column(c).to_numpy() for c in ("order", "key", "n"))
            trees.append(Tree(order, key.view(np.uint64), n))
        return Model(sorted(sizes), trees)
    finally:
        unstage(counts)


def training_texts(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``lang, text`` of about ``per_language`` documents of each language, or of all where it has fewer, chosen by a hash of the id."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    more = [F.when((F.col("lang") == r["lang"]) & (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) >= int(1_000_003 * per_language / r["n"])), True) for r in sizes if r["n"] > per_language]
    return (known.where(F.coalesce(*more, F.lit(False)) == F.lit(False)) if more else known).select("lang", "text")


def identify(docs: DataFrame, buckets: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col, held_out, lang_pred, score, bits``: one row for each row of ``docs``.

    Learns from the whole texts of about ``per_language`` documents of each language that are not held out.
    ``bits`` is the text's code length under the predicted language, ``score`` that language's share of the
    likelihood. A null text, a text without a letter, or any text when nothing could be learned is ``und`` with
    score 0. Ties go to the language first in order. A null id is kept and not held out, repeated rows each get
    theirs, other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = train(training_texts(docs.where(~is_held_out(F.col(id_col), buckets, held_out)), per_language, id_col, text_col, lang_col))
    frozen = spark.sparkContext.broadcast(model)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True

    def predict(batches):
        m = frozen.value
        for b in batches:
            for c in chunks(b.column("text"), CHUNK):
                n = c.hi - c.lo
                langs, best, share = ["und"] * n, np.zeros(n), np.zeros(n)
                if m.langs and len(c.buf):
                    total = m.totals(c)
                    pick = total.argmin(axis=1)
                    low = total[np.arange(n), pick]
                    odds = 1 / np.exp2(np.maximum(low[:, None] - total, -1000)).sum(axis=1)
                    seen = np.concatenate([[0], np.cumsum(ascii_letter[c.buf])])
                    letters = seen[c.offsets[1:]] > seen[c.offsets[:-1]]
                    for d in range(n):
                        if letters[d] or _LETTER.search(c.text(d).decode("utf-8", "replace")):
                            langs[d], best[d], share[d] = m.langs[pick[d]], low[d], odds[d]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(c.lo, n), pa.array(langs), pa.array(share), pa.array(best)], ["id", "lang_pred", "score", "bits"])

    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(predict, T.StructType(fields))
    return out.select(F.col("id").alias(id_col), is_held_out(F.col("id"), buckets, held_out).alias("held_out"), "lang_pred", "score", "bits")
