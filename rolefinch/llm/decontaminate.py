"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

Texts and items become lower-case words of letters and digits. A window that is similar enough to an item holds
many of its shingles, and of the windows that hold the same ones the one that begins with the first of them is
the most similar. So item-sized windows are laid where a text holds a shingle of an item and enough others of
it follow within the item's size. Windows and items get a SimHash of ``BITS`` bits over their shingles, the second,
third ... occurrence of one counted as shingles of their own. Multi-index Hamming blocks then propose items to
windows, whichever item a window was laid for: of two fingerprints within a radius, one of the ``BLOCKS`` bytes
differs by radius // BLOCKS bits at most, so every item of the window's size within the radius is found by that
byte. The weighted similarity of the shingles, each as often as it occurs, decides exactly.

The radius follows from the similarity. The bits of a fingerprint are independent, and for two bags of given sizes
and a given intersection each differs with a probability that ``bit_differs`` computes; the radius is the smallest
one that a pair at the least similarity, at the worst sizes, exceeds with a probability below ``LOST``.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import release, stage, unstage, unused

SHINGLE = 5
LANES = 4  # fingerprints are so many numbers of 64 bits
BITS = 64 * LANES
BLOCKS = 8 * LANES
LOST = 1e-9
BROADCAST_ROWS = 200_000  # rows of two numbers, some MB, up to which a side is broadcast


def bit_differs(a: int, b: int, both: int) -> float:
    """The chance that a bit of the SimHashes of bags of ``a`` and ``b`` shingles differs if they share ``both``."""

    def sums(n):
        k = np.arange(n + 1)
        log = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in k]) - n * math.log(2)
        return 2 * k - n, np.exp(log)

    at, p = sums(both)
    up = []
    for n in (a - both, b - both):
        v, q = sums(n)
        up.append(np.array([q[v > -x].sum() for x in at]))
    return float((p * (up[0] * (1 - up[1]) + (1 - up[0]) * up[1])).sum())


@lru_cache(8)
def radius_for(percent: int, bits: int = BITS, lost: float = LOST) -> int:
    """Bits that fingerprints of bags at a similarity of ``percent`` / 100 differ in at most, but for a chance of ``lost``.

    The worst sizes are small: from 100 shingles on the chance of a bit is that of the angle between the bags.
    """
    worst = math.acos(math.sqrt(percent / 100)) / math.pi  # one bag within the other
    worst = max(worst, math.acos(2 * percent / (100 + percent)) / math.pi)
    for a in range(1, 101):
        for b in range(math.ceil(percent * a / 100), a + 1):
            both = math.ceil(percent * (a + b) / (100 + percent))
            if 0 < both <= b:
                worst = max(worst, bit_differs(a, b, both))
    tail, r = 0.0, bits
    while r and (tail := tail + math.comb(bits, r) * worst**r * (1 - worst) ** (bits - r)) < lost:
        r -= 1
    return r


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _shingles(hashed: Column, size: Column, k: int) -> Column:
    """Hashes of the k-word shingles of an array of word hashes, in order."""
    at = F.when(size >= k, F.sequence(F.lit(0), size - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(hashed, i + j) for j in range(k))))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, however often it is used afterwards."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def tagged(df: DataFrame, shingles: Column, name: str) -> DataFrame:
    """``df`` with a column of the shingles in order of their hashes, the second and later occurrences of one told apart from the first."""
    ordered = unused(df, "ordered")
    x = once(df, ordered, F.array_sort(shingles))
    return once(x, name, F.transform(ordered, lambda y, i: F.xxhash64(y, i - F.array_position(ordered, y)))).drop(ordered)


def fingerprints(bags: DataFrame, keys: list[str], bag: str) -> DataFrame:
    """``keys, f``: the SimHash of each row's bag of hashes, ``LANES`` numbers; a row without any has none.

    Votes are counted for two bits at a time, in the halves of a number.
    """
    one, low = F.lit(1).cast("long"), F.lit((1 << 32) - 1).cast("long")
    shift = lambda x, k: F.call_function("shiftleft", x, k)
    bits = lambda v, k: F.when(2 * v.bitwiseAND(low) > F.col("n"), shift(one, 2 * k)).otherwise(0 * one).bitwiseOR(F.when(2 * F.shiftright(v, 32) > F.col("n"), shift(one, 2 * k + 1)).otherwise(0 * one))
    x = bags.select(*keys, F.explode(bag).alias("x")).select(*keys, F.explode(F.array(*map(F.lit, range(LANES)))).alias("lane"), "x")
    x = x.select(*keys, "lane", F.xxhash64("x", "lane").alias("y"))
    pair = lambda k: F.getbit("y", F.lit(2 * k)).cast("long") + F.shiftleft(F.getbit("y", F.lit(2 * k + 1)).cast("long"), 32)
    votes = x.groupBy(*keys, "lane").agg(F.count("*").alias("n"), *(F.sum(pair(k)).alias(f"v{k}") for k in range(32)))
    number = F.aggregate(F.transform(F.array(*(f"v{k}" for k in range(32))), bits), 0 * one, lambda a, b: a.bitwiseOR(b))
    lanes = votes.select(*keys, "lane", number.alias("f")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lane", "f"))).alias("f"))
    return lanes.withColumn("f", F.transform("f", lambda l: l["f"]))


def _bytes(fingerprint: Column) -> Column:
    """The bytes of a fingerprint with their places."""
    return F.flatten(F.transform(fingerprint, lambda f, lane: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.struct((lane * 8 + k).alias("block"), F.call_function("shiftrightunsigned", f, k * 8).bitwiseAND(F.lit(255).cast("long")).alias("value")))))


def _small(df: DataFrame) -> DataFrame:
    """``df`` (staged), marked for broadcast if it is proved small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75, radius: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id_col, item_col, start_word, n_words, distance, similarity``: the best window of each document and item.

    A row says that a window of the item's size reaches a weighted similarity of ``percent`` / 100 (sum of the
    lesser over sum of the greater shingle counts) and a SimHash within ``radius`` bits, by default ``radius_for``
    the similarity. Items of fewer than five words are one shingle. Texts and items that are null or hold no word
    match nothing, null ids neither. Repeated rows of an id are one document with several texts; an item with several
    texts matches by any of them. Ties go to the first window. Very long texts are searched whole. Empty tables give an
    empty result; other columns are not read.
    """
    radius = radius_for(percent) if radius is None else radius
    staged: list[DataFrame] = []

    def hold(df: DataFrame, name: str) -> DataFrame:
        staged.append(stage(df, name))
        return staged[-1]

    try:
        items = benchmark.select(F.col(item_col).alias("item"), _words(F.col(item_text).cast("string")).alias("w")).where("item is not null and size(w) > 0").distinct()
        items = items.select("item", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), F.size("w").alias("m"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"))
        ks = [r["k"] for r in items.select("k").distinct().collect()]  # five values at most
        pick = lambda h, m: F.coalesce(*(F.when(F.col("k") == k, _shingles(h, m, k)) for k in range(1, SHINGLE + 1)))
        items = hold(tagged(once(items, "s", pick(F.col("h"), F.col("m"))), F.col("s"), "bag"), "items")
        marks = hold(items.select("item", "m", "k", F.explode("s").alias("x")).distinct(), "marks")
        wanted = _small(hold(marks.select("k", "x").distinct(), "wanted"))
        source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null").withColumn("t", F.xxhash64("text"))
        hashed = source.select("id", "t", F.transform(_words(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
        found = None
        for k in ks:
            each = hashed.select("id", "t", F.size("h").alias("n"), F.posexplode(_shingles(F.col("h"), F.size("h"), k)).alias("p", "x")).join(wanted.where(F.col("k") == k), "x")
            found = each if found is None else found.unionByName(each)
        kinds = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {item_col} {benchmark.schema[item_col].dataType.simpleString()}, start_word int, n_words int, distance int, similarity double"
        if found is None:
            return docs.sparkSession.createDataFrame([], kinds)
        # For each text and item the places of the item's shingles; a window begins at one that enough others follow.
        hits = found.join(marks, ["k", "x"]).groupBy("id", "t", "item", "m", "k").agg(F.first("n").alias("n"), F.sort_array(F.collect_set("p")).alias("at"))
        hits = hits.withColumn("need", F.ceil(F.lit(percent) * (F.col("m") - F.col("k") + 1) / 100).cast("int")).where("size(at) >= need")
        begin = F.filter("at", lambda p, j: F.get(F.col("at"), j + F.col("need") - 1) - p <= F.col("m") - F.col("k"))
        places = hold(hits.select("id", "t", "m", "k", F.explode(F.array_distinct(F.transform(begin, lambda p: F.greatest(F.lit(0), F.least(p, F.col("n") - F.col("m")))))).alias("p0")).distinct(), "places")
        texts = source.join(_small(places.select("id", "t").distinct()), ["id", "t"], "left_semi").select("id", "t", F.transform(_words(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
        texts = texts.groupBy("id", "t").agg(F.first("h").alias("h"))  # rows that repeat id and text
        windows = texts.join(places, ["id", "t"]).select("id", "t", "p0", "m", "k", F.slice("h", F.col("p0") + 1, F.col("m")).alias("h"))
        windows = tagged(once(once(windows, "own", F.col("h")), "s", pick(F.col("own"), F.size("own"))), F.col("s"), "bag")
        windows = hold(windows.select("id", "t", "p0", "m", "bag").where("size(bag) > 0"), "windows")
        # Only fingerprints meet in the index: a window's bytes are looked up among those that an item's bytes can become.
        window = ["id", "t", "p0", "m"]
        keys = hold(fingerprints(windows, window, "bag"), "prints").withColumn("b", F.explode(_bytes(F.col("f")))).select(*window, "f", "b.block", "b.value")
        flips = [sum(1 << b for b in c) for n in range(radius // BLOCKS + 1) for c in combinations(range(8), n)]
        known = hold(items.join(fingerprints(items, ["item", "h", "m"], "bag"), ["item", "h", "m"]).select("item", "m", F.col("f").alias("f2"), F.col("bag").alias("bag2")), "known")
        probes = known.select("item", "m", "f2").withColumn("b", F.explode(_bytes(F.col("f2"))))
        probes = probes.withColumn("flip", F.explode(F.array(*(F.lit(x).cast("long") for x in flips)))).select("item", "m", "f2", F.col("b.block").alias("block"), F.col("b.value").bitwiseXOR(F.col("flip")).alias("value"))
        apart = F.aggregate(F.zip_with("f", "f2", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
        # The probes are many times the items, which Spark's estimate does not know: never broadcast.
        near = keys.join(probes.hint("merge"), ["m", "block", "value"]).withColumn("distance", apart).where(F.col("distance") <= radius).groupBy(*window, "item", "f2").agg(F.first("distance").alias("distance"))
        # The shingles of what is left decide.
        near = near.join(windows, window).join(known, ["item", "m", "f2"])
        exact = near.withColumn("both", F.size(F.array_intersect("bag", "bag2"))).withColumn("all", F.size("bag") + F.size("bag2") - F.col("both")).where(f"100 * both >= {percent} * `all`")
        best = exact.select("id", "item", F.struct((-F.col("both") / F.col("all")).alias("less"), "p0", "m", "distance").alias("w")).groupBy("id", "item").agg(F.min("w").alias("w"))
        return stage(best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("w.p0").alias("start_word"), F.col("w.m").alias("n_words"), F.col("w.distance").alias("distance"), (-F.col("w.less")).alias("similarity")), "contaminated")
    finally:
        unstage(*staged)
        staged.clear()
        release(docs.sparkSession)
