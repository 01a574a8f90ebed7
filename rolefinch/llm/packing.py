"""Packing token sequences by exact-complement hashing, then best fit.

Only lengths matter for a plan, and there are at most ``capacity`` of them. The plan works on counts: it keeps
an index of the single, pair and triple sums of available lengths, by sum, and for each length takes the
combinations that fill its gap exactly as often as counts allow. What is left is packed best-fit. The plan has a few rows for each length however many
documents there are; Spark counts lengths, ranks the pieces of each length, and gives each its place.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import small_batches, stage, unused
from .text import give_back, spans

PER_SALT = 500  # pieces of one length that are ranked together, about; more where that makes over ``SALTS`` groups
SALTS = 4096


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """``(times, lengths)`` of sequences that use all of ``counts``: first exact fills, then best fit.

    Where long pieces outnumber short ones, sums of many short pieces leave long ones alone; so fills by triples,
    pairs and singles at most are each planned, and the plan with the fewest sequences is taken.
    """
    return min((_plan(counts, capacity, depth) for depth in (3, 2, 1)), key=lambda p: sum(times for times, _ in p))


class Sums:
    """How many single lengths, pairs and triples of available lengths make each sum up to ``capacity``."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.have = np.zeros(capacity + 1, np.int64)
        self.pairs, self.triples = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.have[length] = n
            self._change(length, 1)

    def _change(self, x: int, sign: int):
        """Add or remove what length x, which is available, makes with all that are."""
        there = np.flatnonzero(self.have[: len(self.have) - x])
        if sign > 0:
            self.pairs[there + x] += 1
        self.triples[x:] += sign * self.pairs[: len(self.pairs) - x]
        if sign < 0:
            self.pairs[there + x] -= 1

    def take(self, lengths: list[int]) -> int:
        """Use up a combination as often as it is available; returns how often."""
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(self.have[x]) // n for x, n in need.items())
        for x, n in need.items() if times else ():
            if self.have[x] == times * n:
                self._change(x, -1)
            self.have[x] -= times * n
        return times

    def fills(self, gap: int, depth: int):
        """Combinations of at most ``depth`` available lengths that sum to ``gap``: singles, pairs most evenly available first, then triples."""
        if self.have[gap]:
            yield [gap]
        if depth > 1 and self.pairs[gap]:
            a = np.flatnonzero(self.have[: gap // 2 + 1])
            a = a[self.have[gap - a] > 0]
            yield from ([int(x), gap - int(x)] for x in a[np.argsort(-np.minimum(self.have[a], self.have[gap - a]), kind="stable")])
        if depth > 2 and self.triples[gap]:
            c = np.flatnonzero(self.have[: gap + 1])[::-1]
            for x in c[self.pairs[gap - c] > 0]:
                rest = gap - int(x)
                a = np.flatnonzero(self.have[: rest // 2 + 1])
                yield from ([int(x), int(y), rest - int(y)] for y in a[self.have[rest - a] > 0])


def _plan(counts: dict[int, int], capacity: int, depth: int) -> list[tuple[int, list[int]]]:
    sums = Sums(counts, capacity)
    have, out = sums.have, []
    if times := sums.take([capacity]):
        out.append((times, [capacity]))
    for first in range(capacity - 1, 0, -1):
        while have[first]:
            found = next(((times, [first, *x]) for x in sums.fills(capacity - first, depth) if (times := sums.take([first, *x]))), None)
            if not found:
                break
            out.append(found)
    # Best fit, longest first: open sequences by the room they have left.
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    for length in range(capacity, 0, -1):
        left = int(have[length])
        while left:
            room = next((r for r in range(length, capacity + 1) if rooms.get(r)), None)
            if room is None:
                each = min(capacity // length, left)
                times = left // each
                key, new = (length,) * each, capacity - length * each
            else:
                old, there_ = next(iter(rooms[room].items()))
                each = min(room // length, left)
                times = min(there_, left // each)
                rooms[room][old] -= times
                if not rooms[room][old]:
                    del rooms[room][old]
                key, new = old + (length,) * each, room - length * each
            left -= times * each
            at = rooms.setdefault(new, {})
            at[key] = at.get(key, 0) + times
    out.extend((times, list(key)) for held in rooms.values() for key, times in held.items())
    return out


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces(..., length)``, each length 1 to ``capacity``.

    Sequences are gapless from 0. Ties among pieces of equal length are broken by a hash of the row, equal rows
    share a rank's order arbitrarily but get different places. Rows with a null length or a length outside the
    range raise an error. Other columns are kept, whatever their names, except that ``sequence_id`` and ``offset``
    are replaced. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    bad = F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > capacity)
    pieces = stage(pieces.withColumn("length", F.when(bad, F.raise_error(F.lit("a piece has no length from 1 to the capacity"))).otherwise(F.col("length"))), "pieces")
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    counts = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # Where each length's ranks go: (length, first rank, first sequence, offset); at most a few for each length.
    used = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    for times, lengths in plan(counts, capacity):
        at = 0
        for x in lengths:
            rows.append((x, used[x], sequence, at))
            used[x] += times
            at += x
        sequence += times
    rows.sort()
    keys = np.array([(x << 44) + r for x, r, _, _ in rows], np.int64)
    base = np.array([(r, s, o) for _, r, s, o in rows], np.int64).reshape(-1, 3)
    steps = spark.sparkContext.broadcast((keys, base))

    # Ranks without gathering a length in one task: rank within salts, plus the salts before. There are at most
    # ``SALTS`` salts besides the lengths, so what is collected and broadcast is bounded.
    per_salt = max(PER_SALT, -(-sum(counts.values()) // SALTS))
    salts = F.create_map(*(F.lit(v) for x, n in counts.items() if n > per_salt for v in (x, -(-n // per_salt)))) if any(n > per_salt for n in counts.values()) else None
    n_salts = F.lit(1) if salts is None else F.coalesce(F.try_element_at(salts, F.col("length").cast("int")), F.lit(1))
    key, salt, start, rank = (unused(pieces, x) for x in ("key", "salt", "start_rank", "rank"))
    salted = pieces.withColumn(key, F.xxhash64(*(F.col(f"`{c}`") for c in names))).withColumn(salt, F.pmod(F.col(key), n_salts))
    sizes = salted.groupBy("length", salt).agg(F.count("*").alias("n")).collect()
    starts, before = [], {}
    for length, k, n in sorted((int(r["length"]), r[salt], r["n"]) for r in sizes):
        starts.append((length, k, before.get(length, 0)))
        before[length] = starts[-1][2] + n
    starts = spark.createDataFrame(starts or [(0, 0, 0)], f"length long, `{salt}` long, `{start}` long")
    ranked = salted.withColumn(rank, F.row_number().over(W.partitionBy("length", salt).orderBy(key)) - 1)
    ranked = ranked.join(F.broadcast(starts), ["length", salt]).withColumn(rank, F.col(rank) + F.col(start)).select(*(f"`{c}`" for c in names), rank)

    def place(batches):
        k, b = steps.value
        for x in batches:
            length, at = (x.column(c).to_numpy().astype(np.int64) for c in ("length", rank))
            i = np.searchsorted(k, (length << 44) + at, "right") - 1
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in names), pa.array(b[i, 1] + at - b[i, 0]), pa.array(b[i, 2])], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


# Words of a byte-level BPE: the alternatives of the published pattern, on character classes.
_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3


@lru_cache(1)
def _classes() -> np.ndarray:
    import regex

    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = _OTHER
    return out


def word_starts(text: str) -> np.ndarray:
    """Where the pattern's matches begin in ``text``, as indexes of characters.

    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
    """
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    if not n:
        return np.empty(0, np.int64)
    k = _classes()[cp]
    start = np.ones(n, bool)
    start[1:] = k[1:] != k[:-1]
    space = k == _SPACE
    # The last white space before a word is its own match, or begins the word if it is U+0020.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:]
    start |= last
    joins = np.flatnonzero(last & (cp == 32)) + 1
    start[joins] = False
    # An apostrophe that begins a match may take letters with it.
    tick = np.flatnonzero((cp == 39) & start)
    tick = tick[tick + 1 < n]
    if len(tick):
        c1 = cp[tick + 1]
        c2 = np.where(tick + 2 < n, cp[np.minimum(tick + 2, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = np.zeros(len(tick), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (c1 == ord(a)) & (c2 == ord(b))
        for at, size in ((tick[one], 2), (tick[two & ~one], 3)):
            for j in range(1, size):
                start[at + j] = False
            after = at[at + size < n] + size
            letters = after[k[after] == k[after - 1]]
            start[letters] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of many texts at once: each different word is tokenised once in a while, the rest is array work."""

    WORDS = 500_000  # words remembered

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        self.whole, self.model = t, t.model
        self.added = [x.content for x in t.get_added_tokens_decoder().values()]
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.chars = {b: chr(b) if b in set(kept) else None for b in range(256)}
        self.chars = {b: c or chr(next(spare)) for b, c in self.chars.items()}
        self._reset()

    def _reset(self):
        self.keys, self.first, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def _learn(self, words: list[bytes], hashes: np.ndarray):
        ids = [[t.id for t in self.model.tokenize(w.decode("latin-1").translate(self.chars))] for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.pool) + np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        self.pool = np.concatenate([self.pool, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))])
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.first, self.size = np.insert(self.keys, at, hashes), np.insert(self.first, at, first), np.insert(self.size, at, size)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Texts that hold an added token go through the tokenizer itself, which looks for them first."""
        special = {k for k, t in enumerate(texts) if any(x in t for x in self.added)}
        out = self._encode([t for k, t in enumerate(texts) if k not in special])
        for k in sorted(special):
            out.insert(k, np.array(self.whole.encode(texts[k], add_special_tokens=False).ids, np.uint32))
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        text = "".join(texts)
        starts, at, blobs = [], 0, 0
        for t in texts:
            starts.append(word_starts(t) + at)
            at += len(t)
        raw = text.encode("utf-8", "surrogatepass")
        buf = np.frombuffer(raw, np.uint8)
        begin = np.flatnonzero((buf & 0xC0) != 0x80)  # each character's first byte
        s = np.concatenate(starts) if starts else np.empty(0, np.int64)
        b0 = begin[s]
        b1 = np.concatenate([b0[1:], [len(buf)]]) if len(b0) else b0
        h = spans(buf, b0, b1)
        uniq, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        known = np.searchsorted(self.keys, uniq)
        known[known == len(self.keys)] = 0
        new = np.flatnonzero(self.keys[known] != uniq) if len(self.keys) else np.arange(len(uniq))
        if len(self.keys) + len(new) > self.WORDS:
            self._reset()
            new = np.arange(len(uniq))
        self._learn([raw[b0[i] : b1[i]] for i in index[new]], uniq[new])
        at = np.searchsorted(self.keys, uniq)[inverse]
        first, size = self.first[at], self.size[at]
        end = np.cumsum(size)
        ids = self.pool[np.repeat(first - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in starts])])
        ends = np.concatenate([[0], end])
        return [ids[ends[cuts[k]] : ends[cuts[k + 1]]] for k in range(len(texts))]


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, ids_crc32``: each text's ids and ``end_id``, cut where longer than ``capacity``.

    The first piece takes the remainder; all others have ``capacity`` ids. A null text is empty: one piece of one
    id. A null id stays null and repeated rows are documents of their own. Texts are tokenised whole.
    """
    id_type = docs.schema[id_col].dataType
    small_batches(docs.sparkSession)
    arrow_id = to_arrow_type(id_type)

    def cut(batches):
        encoder = _encoder(tokenizer_path)
        for b in batches:
            texts, ids = b.column("text"), b.column("id")
            lo = 0
            while lo < len(texts):
                held, total, hi = [], 0, lo
                while hi < len(texts) and (hi == lo or total < 500_000):
                    held.append(texts[hi].as_py() or "")
                    total += len(held[-1])
                    hi += 1
                rows = []
                for k, x in enumerate(encoder.encode(held)):
                    x = np.append(x, np.uint32(end_id)).astype("<u4")
                    n = -(-len(x) // capacity)
                    cuts = [0, *range(len(x) - (n - 1) * capacity, len(x) + 1, capacity)]
                    rows.extend((lo + k, p, a, z - a, zlib.crc32(x[a:z].tobytes())) for p, (a, z) in enumerate(zip(cuts, cuts[1:])))
                at, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)).cast(arrow_id), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], [id_col, "piece", "start", "length", "ids_crc32"])
                lo = hi
            give_back()

    out = T.StructType([T.StructField(id_col, id_type), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, out)
