"""Cross-entropy difference of documents under a target and a background n-gram model.

Both models are interpolated bigram models over one vocabulary: all words of the corpus. The target model counts
the documents of a target domain, the background model the whole corpus. Smoothing uses the same weights for both, so
that losses are comparable for each token. A document's score is its mean loss under the target less that under
the background: lower is more like the target.

Counts of words and bigrams are a distributed table that grows with the corpus. Documents are coded once, in parts
of about ``PART`` bytes. Each part sends the hashes of its different words and bigrams with their counts to buckets of
the hash range; a bucket adds them up and sends each part the sums of what it has. So a common bigram costs one
number a part, and neither driver nor broadcast holds words. A part has a row for each bucket of which it holds a
key: parts times buckets, but never more than the parts have different bigrams and words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import release, small_batches, stage, unstage
from .text import chunks, gathered, give_back, mix, signed, words

MIX = 0.7  # weight of bigrams against single words
HELD = 200_000  # different words that a task counts before it hands them on
PART = 6_000_000  # bytes of text that are coded together
BUCKET = 4_000_000  # tokens for each bucket, about
_START, _UNKNOWN = np.uint64(0x5D1F2A9C3B7E4861), np.uint64(0xA3C59AC2E81B7F05)


def _counted(batches):
    """(word, documents of the target it is in or not: n) from each task, merged before the shuffle."""
    held: dict[int, list[np.ndarray]] = {0: [], 1: []}

    def merge(k):
        if not held[k]:
            return None
        h, n = (np.concatenate(x) for x in zip(*held[k], strict=True))
        keys, inverse = np.unique(h, return_inverse=True)
        held[k] = []
        return keys, np.bincount(inverse, n, len(keys)).astype(np.int64)

    def out(k):
        got = merge(k)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(signed(got[0])), pa.array(np.full(len(got[0]), bool(k))), pa.array(got[1])], ["word", "target", "n"])

    for b in batches:
        target = b.column("target").to_numpy(zero_copy_only=False).astype(np.int64)
        for c in chunks(b.column("text")):
            w = words(c)
            of = target[c.lo : c.hi][w.doc]
            for k in (0, 1):
                held[k].append(np.unique(w.hash[of == k], return_counts=True))
                if sum(len(x) for x, _ in held[k]) > 5 * HELD:
                    got = merge(k)
                    held[k] = [got]
                    if len(got[0]) > 5 * HELD:
                        yield from out(k)
    for k in (0, 1):
        yield from out(k)


def _packed(x: np.ndarray) -> bytes:
    """Compressed planes of bytes: high bytes are mostly zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()) if len(x) else b""


def _unpacked(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1).T.copy().view(dtype).ravel() if raw else np.empty(0, dtype)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0))


class Part:
    """The words and bigrams of one part: their keys in order, and which of them each token is."""

    def __init__(self, held: dict, k: int):
        self.size = np.frombuffer(held["sizes"][k].as_py(), np.int32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        target = np.frombuffer(held["targets"][k].as_py(), np.uint8)[self.doc]
        keys = np.cumsum(_unpacked(held["words"][k].as_py(), np.uint64), dtype=np.uint64)
        self.code = _unpacked(held["codes"][k].as_py(), np.uint32).astype(np.int64)
        self.before = np.concatenate([[0], self.code[:-1]]).astype(np.int64)[: len(self.code)]
        self.start = len(keys)
        self.before[(np.cumsum(self.size) - self.size)[self.size > 0]] = self.start
        pairs, self.pair = np.unique(self.before * (self.start + 1) + self.code, return_inverse=True)
        h = np.append(keys, _START)
        two = mix(h[pairs // (self.start + 1)] * np.uint64(0xF1357AEA2E62A9C5) + h[pairs % (self.start + 1)])
        one = mix(keys + np.uint64(0x9E3779B97F4A7C15))
        both = np.concatenate([two & ~np.uint64(1), one | np.uint64(1)])  # words are odd
        self.order = np.argsort(both, kind="stable")
        self.n_pairs, self.keys = len(pairs), both[self.order]
        count = lambda weights: np.concatenate([np.bincount(self.pair, weights, len(pairs)), np.bincount(self.code, weights, len(keys))]).astype(np.int64)[self.order]
        self.t, self.b = count(target), count(None)


def score_cross_entropy(docs: DataFrame, target: Column, vocabulary: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, loss_target, loss_background, difference`` for each row of ``docs``, in nats a token.

    ``target`` is a condition on the columns of ``docs``; null counts as false. Tokens are lower-cased words; the
    first of a text follows a start mark. With a ``vocabulary`` only that many of the commonest words count as such
    and all others are one unknown word. Null, empty and wordless texts have no tokens and null losses. A null
    id is kept, and repeated rows are scored each. With an empty target its model is the uniform one. A very long text
    is a part of its own, read whole. Other columns are read only by ``target``. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    kept = None
    if vocabulary is not None:
        per_word = source.select("text", "target").mapInArrow(_counted, "word long, target boolean, n long").groupBy("word").agg(F.sum("n").alias("b"))
        kept = spark.sparkContext.broadcast(np.array([r["word"] for r in per_word.orderBy(F.col("b").desc(), "word").limit(vocabulary).collect()], np.int64).view(np.uint64))
    id_type = docs.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)
    names = ["part", "ids", "sizes", "targets", "words", "codes", "n_t", "n_b", "starts_t", "starts_b"]

    def coded(batches):
        part = TaskContext.get().partitionId() << 32
        for b in gathered(batches, "text", PART):
            target = b.column("target").to_numpy(zero_copy_only=False).astype(np.uint8)
            for c in chunks(b.column("text"), 3 * PART // 2):
                w = words(c)
                keys, code = np.unique(w.hash if kept is None else np.where(np.isin(w.hash, kept.value), w.hash, _UNKNOWN), return_inverse=True)
                size, of = np.diff(w.first), target[c.lo : c.hi]
                ids = pa.ListArray.from_arrays(pa.array([0, c.hi - c.lo], pa.int32()), b.column("id").slice(c.lo, c.hi - c.lo).cast(arrow_id))
                blobs = (size.astype(np.int32).tobytes(), of.tobytes(), _packed(_steps(keys)), _packed(code.astype(np.uint32)))
                sums = (size[of > 0].sum(), size.sum(), (size[of > 0] > 0).sum(), (size > 0).sum())
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), ids, *(pa.array([x], pa.binary()) for x in blobs), *(pa.array([int(x)], pa.int64()) for x in sums)], names)
                part += 1

    blob = lambda *listed: [T.StructField(n, T.BinaryType()) for n in listed]
    long = lambda *listed: [T.StructField(n, T.LongType()) for n in listed]
    parts = stage(source.mapInArrow(coded, T.StructType([*long("part"), T.StructField("ids", T.ArrayType(id_type)), *blob(*names[2:6]), *long(*names[6:])])), "lm-parts")
    total = parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names[6:])).first()
    buckets = max(total["n_b"] // BUCKET, min(64, 1 + total["n_b"] // 100_000))

    def sent(batches):
        for b in batches:
            held = {c: b.column(c) for c in names[2:6]}
            for k in range(b.num_rows):
                p = Part(held, k)
                at = ((p.keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                some, lo = np.unique(at, return_index=True)
                cuts = [*zip(lo, [*lo[1:], len(at)])]
                cut = lambda x: pa.array([_packed(x[a:z]) for a, z in cuts], pa.binary())
                keys = pa.array([_packed(_steps(p.keys[a:z])) for a, z in cuts], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), b.column("part")[k].as_py(), np.int64)), keys, cut(p.t), cut(p.b)], ["bucket", "part", "keys", "t", "b"])
            give_back()

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, keys, t, b = [], [], [], []
        for x in batches:
            of.extend(x.column("part").to_pylist())
            keys.extend(np.cumsum(_unpacked(y.as_py(), np.uint64), dtype=np.uint64) for y in x.column("keys"))
            t.extend(_unpacked(y.as_py(), np.int64) for y in x.column("t"))
            b.extend(_unpacked(y.as_py(), np.int64) for y in x.column("b"))
        ends = np.cumsum([len(x) for x in keys])
        uniq, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(inverse, np.concatenate(x), len(uniq)).astype(np.int64) for x in (t, b)]
        new = int((uniq & np.uint64(1)).sum())
        for k, (part, z) in enumerate(zip(of, ends, strict=True)):
            at = inverse[z - len(keys[k]) : z]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([key[0].as_py()], pa.int64()), *(pa.array([_packed(s[at])], pa.binary()) for s in sums), pa.array([new if k == 0 else 0], pa.int64())], ["part", "bucket", "t", "b", "n_words"])
        give_back()

    sums = parts.select("part", *names[2:6]).mapInArrow(sent, T.StructType([*long("bucket", "part"), *blob("keys", "t", "b")])).groupBy("bucket").applyInArrow(added, T.StructType([*long("part", "bucket"), *blob("t", "b"), *long("n_words")]))
    sums = stage(sums, "lm-sums")
    release(spark)
    n_words = (sums.agg(F.sum("n_words").alias("n")).first()["n"] or 0) if kept is None else len(kept.value)
    tokens, starts = (total["n_t"], total["n_b"]), (total["starts_t"], total["starts_b"])

    def losses(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("bucket")
        out = []
        for k in range(right.num_rows):
            p = Part({c: right.column(c) for c in names[2:6]}, k)
            ids = right.column("ids")[k].values
            row = [ids, pa.array(p.size)]
            for name, whole, first in zip(("t", "b"), tokens, starts, strict=True):
                n = np.empty(len(p.keys))
                n[p.order] = np.concatenate([_unpacked(x.as_py(), np.int64) for x in left.column(name)]) if left.num_rows else 0
                one = n[p.n_pairs :]
                share = ((one + 1) / (whole + n_words + 2))[p.code]
                follow = np.append(one, first)[p.before]
                two = np.where(follow > 0, n[: p.n_pairs][p.pair] / np.maximum(follow, 1), share)
                loss = np.bincount(p.doc, -np.log(MIX * two + (1 - MIX) * share), len(p.size))
                row.append(pa.array(loss / np.maximum(p.size, 1), mask=p.size == 0))
            out.append(pa.Table.from_arrays(row, ["id", "n_tokens", "t", "b"]))
        give_back()
        return pa.concat_tables(out)

    scored = stage(sums.select("part", "bucket", "t", "b").groupBy("part").cogroup(parts.select("part", "ids", *names[2:6]).groupBy("part")).applyInArrow(losses, T.StructType([T.StructField("id", id_type), *long("n_tokens"), T.StructField("t", T.DoubleType()), T.StructField("b", T.DoubleType())])), "lm-losses")
    unstage(parts, sums)
    return scored.select(F.col("id").alias(id_col), "n_tokens", F.col("t").alias("loss_target"), F.col("b").alias("loss_background"), (F.col("t") - F.col("b")).alias("difference"))
