"""N-gram Jaccard self-join by adaptive multi-match prefixes, reported as components.

A document's set is its distinct five-word shingles. Sets are put in one global order, rare shingles first
(frequencies from a counter sketch over all documents). Two sets that reach the threshold share at least l
shingles within their l-prefixes, for every l; each set takes the l whose prefix has the least estimated
candidate cost, and a pair is verified only if it shares as many prefix shingles as the smaller of its two l.

Equal sets are one node from the start, so copies never meet each other. Linked nodes are contracted in rounds
in which each node is verified against one hub of its buckets, so the join that follows takes only pairs of
different components. What it joins is bounded three times before a row is made, and no bound drops a link:

* of the l shingles that a pair must share, the smaller set may leave out its l - 1 most frequent ones;
* the parity bitmap of a set (each shingle flips one bit) bounds the difference of two sets from below;
* Jaccard distance is a metric, so what the rounds measured against a hub rules out pairs of which one lies near
  that hub and the other far from it.

Every link is verified on whole shingle sets. A group in which very many texts are all close to the threshold, yet
not linked, still has to compare these with each other: no exact method known avoids it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import merged_counters, release, small_batches, stage, unstage
from .text import chunks, mix, shingles, signed, words

SKETCH_BITS = 21  # counters of the frequency sketch: 2 M of one byte each after merging
BLOOM_BITS = 26  # bits of the filter that names the sets to be verified: 8 MB; with more nodes than it can tell apart, a join does it
BLOOM_SLICES = 64
MIN_L, MAX_L = 6, 24  # prefix shingles that a pair has to share, where the sets are large enough
MARK = 16  # words of 64 bits of a parity bitmap in the rows of a join
HUB_ROUNDS = 4
BROADCAST_PAIRS = 500_000  # pairs of two numbers, 8 MB
COPIES = 1000  # of one text, beyond which they are named apart from the rest
SALTS = 32
VERIFY_COST = 30.0  # of a verification, in rows of a bucket


def _sets(batches, id_name: str, text_name: str):
    """(ids, set) for each text: its distinct shingle hashes in ascending order."""
    for b in batches:
        ids, texts = b.column(id_name), b.column(text_name)
        for c in chunks(texts):
            s, first = shingles(words(c))
            for d in range(c.hi - c.lo):
                yield ids[c.lo + d], np.unique(s[first[d] : first[d + 1]])


def _node(u: np.ndarray) -> int:
    """A set's 64-bit name, the same in whatever order it is hashed."""
    with np.errstate(over="ignore"):
        x = np.uint64(len(u)) * np.uint64(0x9E3779B97F4A7C15) + np.bitwise_xor.reduce(u) + np.sum(u * (u >> np.uint64(17) | np.uint64(1)), dtype=np.uint64)
    return int(np.uint64(x).astype(np.int64))


def _parity(u: np.ndarray) -> list[int]:
    """A bitmap of two bits a shingle or more, ``MARK`` words at least; each shingle flips the bit that its hash names."""
    width = max(64 * MARK, 1 << (2 * len(u) - 1).bit_length())
    flips = np.bincount((u >> np.uint64(24) & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits(flips & 1, bitorder="little").view(np.int64).tolist()


def _folded(mark: Column, words: Column) -> Column:
    """A bitmap folded to so many words, as if it had been made with them."""
    fold = lambda i: F.aggregate(F.sequence(i, F.size(mark) - 1, words), F.lit(0).cast("long"), lambda s, j: s.bitwiseXOR(F.get(mark, j)))
    return F.when(F.size(mark) == words, mark).otherwise(F.transform(F.sequence(F.lit(0), words - 1), fold))


def _apart(x: Column, y: Column) -> Column:
    """Bits in which two bitmaps differ, the wider one folded: at most the size of the sets' difference."""
    words = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(_folded(x, words), _folded(y, words), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _bits(node: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """A node's slice of the filter and its bits there."""
    h = mix(node.astype(np.int64).view(np.uint64))
    size = np.uint64((1 << BLOOM_BITS) // BLOOM_SLICES - 1)
    return (h >> np.uint64(58)).astype(np.int64), [((h >> np.uint64(k)) & size).astype(np.int64) for k in (0, 19, 38)]


def _batches(rows, names, types, every=2000):
    """Record batches of at most ``every`` rows from an iterator of tuples."""
    held = []
    schema = pa.schema(list(zip(names, types, strict=True)))

    def out():
        return pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*held, strict=True), types, strict=True)], schema=schema)

    for r in rows:
        held.append(r)
        if len(held) >= every:
            yield out()
            held = []
    if held:
        yield out()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``id_col, n_shingles, component_id``: one row for each row of ``docs``.

    Two documents link when 100 * intersection >= ``percent`` * union. ``component_id`` is the smallest id that
    links reach. Null or wordless texts have no shingles and link with nothing. A null id stays null and never
    names a component unless all of its ids are null. Rows that repeat an id are documents of their own. Other
    columns, of whatever names, are not read. Very long texts are read whole, one at a time. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    staged: list[DataFrame] = []

    def hold(df: DataFrame, name: str) -> DataFrame:
        staged.append(stage(df, name))
        return staged[-1]

    try:
        return stage(_components(docs, hold, id_col, text_col, percent), "jaccard")
    finally:
        unstage(*staged)


def _components(docs: DataFrame, hold, id_col: str, text_col: str, percent: int) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    mask = np.uint64((1 << SKETCH_BITS) - 1)

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for c in chunks(b.column(0)):
                s, _ = shingles(words(c))
                total += np.bincount((s & mask).astype(np.int64), minlength=len(total))
        return np.minimum(total, 65535).astype(np.uint16)

    sketch = merged_counters(src.select("text"), count, 1 << SKETCH_BITS, np.uint16)
    noise = float(np.median(sketch))
    shared = spark.sparkContext.broadcast((np.minimum(255, 8 * np.log2(sketch + 1.0)).astype(np.uint8), noise))

    def _least_shared(n: int) -> int:
        """The shingles that a set of n shares with any partner, at least."""
        return max(1, -(-percent * (-(-percent * n // 100)) // 100))

    def prefix(u: np.ndarray) -> tuple[np.ndarray, int, int, int]:
        """The set's prefix in global order, l, and how much of it counts where this is the smaller set."""
        n = len(u)
        level, base = shared.value
        cls = level[(u & mask).astype(np.int64)]
        order = np.argsort((cls.astype(np.uint64) << np.uint64(56)) | (u >> np.uint64(8)), kind="stable")
        need = -(-percent * n // 100)
        least = min(MIN_L, _least_shared(n))
        most = max(least, min(MAX_L, need))
        head = order[: n - need + most]
        df = np.maximum(2.0 ** (cls[head] / 8.0) - 1.0 - base, 1.0)
        sums = np.cumsum(df)
        costs = [sums[min(n, n - need + k) - 1] * (1 + VERIFY_COST / (k * k)) + 4.0 * k for k in range(least, most + 1)]
        best = int(np.argmin(costs)) + least
        as_smaller = n - math.ceil(2 * percent * n / (100 + percent)) + best
        return u[head[: n - need + best]], best, as_smaller, n

    def node_rows(batches):
        def rows():
            for _, u in _sets(batches, "id", "text"):
                if len(u):
                    tokens, best, small, n = prefix(u)
                    yield _node(u), n, best, small, signed(tokens), _parity(u)

        many = pa.list_(pa.int64())
        yield from _batches(rows(), ["node", "n", "l", "small", "tokens", "mark"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), many, many])

    nodes = src.mapInArrow(node_rows, "node long, n int, l int, small int, tokens array<long>, mark array<long>")
    nodes = hold(nodes.groupBy("node").agg(*(F.first(x).alias(x) for x in ("n", "l", "small", "tokens", "mark"))), "nodes")
    release(spark)

    # Of each node the prefix shingles that other nodes have in theirs, with their exact numbers of nodes. Only
    # shingle, node and place are shuffled; what is known of a node is joined when most rows are gone.
    often = hold(nodes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "often")
    release(spark)
    kept = nodes.select("node", F.posexplode("tokens").alias("pos", "token")).join(often, "token").groupBy("node").agg(F.collect_list(F.struct("token", "pos", "df")).alias("kept"))
    # A node has a partner only if it shares as many of its shingles as the least l that both could have.
    enough = f"size(kept) >= least({MIN_L}, greatest(1, ceil({percent} * ceil({percent} * n / 100) / 100)))"
    live = kept.join(nodes.select("node", "n", "l", "small", "mark"), "node").where(enough)
    live = hold(live.withColumn("c", F.col("node")), "live")
    unstage(nodes, often)
    del nodes, often, kept
    release(spark)
    n_live = live.count()

    def set_rows(batches):
        def rows():
            for _, u in _sets(batches, "id", "text"):
                if len(u) and wanted(_node(u)):
                    yield _node(u), u.tobytes()

        yield from _batches(rows(), ["node", "s"], [pa.int64(), pa.binary()], 500)

    if n_live <= (1 << BLOOM_BITS) // 10:
        bloom = spark.sparkContext.broadcast(_filter(live.select("node")))

        def wanted(node: int) -> bool:
            at, bits = _bits(np.array([node]))
            return all(bloom.value[at[0], x[0] >> 3] >> (x[0] & 7) & 1 for x in bits)
    else:

        def wanted(node: int) -> bool:
            return True

    sets = src.mapInArrow(set_rows, "node long, s binary").join(live.select("node"), "node", "left_semi")
    sets = hold(sets.groupBy("node").agg(F.first("s").alias("s")), "sets")
    release(spark)

    def verify(pairs: DataFrame) -> DataFrame:
        """``a, b, dist, linked`` from whole sets; only sets of nodes in ``pairs`` are shuffled where these are few."""

        def check(batches):
            for b in batches:
                dist, ok = [], []
                for x, y in zip(b.column("x"), b.column("y"), strict=True):
                    u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    union = len(np.union1d(u, v))
                    both = len(u) + len(v) - union
                    dist.append(1.0 - both / union)
                    ok.append(100 * both >= percent * union)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(dist, pa.float64()), pa.array(ok, pa.bool_())], ["a", "b", "dist", "linked"])

        # Few pairs go to the sets instead of the sets to them.
        few = F.broadcast if pairs.count() <= BROADCAST_PAIRS else lambda df: df
        x = sets.withColumnsRenamed({"node": "a", "s": "x"}).join(few(pairs), "a")
        y = sets.join(few(pairs.select(F.col("b").alias("node")).distinct()), "node", "left_semi").withColumnsRenamed({"node": "b", "s": "y"})
        return x.join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long, dist double, linked boolean")

    def sift(pairs: DataFrame) -> DataFrame:
        """``a, b, lo, open``: a lower bound of each pair's distance, and whether it leaves a link possible."""
        x = live.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("mark").alias("x"))
        y = live.select(F.col("node").alias("b"), F.col("n"), F.col("mark").alias("y"))
        both = pairs.join(x, "a").join(y, "b").withColumn("apart", F.explode(F.array(_apart(F.col("x"), F.col("y")))))
        return both.select("a", "b", (2 * F.col("apart") / (F.col("m") + F.col("n") + F.col("apart"))).alias("lo"), F.expr(f"{100 + percent} * apart <= {100 - percent} * (m + n)").alias("open"))

    links, rounds = None, 0
    for k in range(HUB_ROUNDS):
        # A text whose prefix is all in use by others is likely the one that the others are edited from: first hub.
        order = F.expr(f"-100 * size(kept) div (n - ceil({percent} * n / 100) + l)") if k == 0 else F.xxhash64("c", F.lit(k))
        rows = live.select("node", "n", "c", order.alias("o"), F.explode("kept").alias("e"))
        hubs = rows.groupBy("e.token").agg(F.min(F.struct("o", "node", "c", "n")).alias("hub"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("token", "hub.node", "hub.c", "hub.n").withColumnsRenamed({"node": "b", "c": "hub_c", "n": "hub_n"})
        rows = rows.select("node", "n", *(["c", "e"] if k else []), F.col("e.token").alias("token"))
        met = rows.join(hubs, "token").drop("token").withColumn("c", F.col("c" if k else "node"))
        if k:  # what is left of each node: shingles that two components have
            met = hold(met, "met")
        pairs = met.where(f"c != hub_c and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").select("node", "b")
        # The hub that shares most of a node's buckets is the likeliest partner.
        pairs = pairs.groupBy("node", "b").agg(F.count("*").alias("hits"))
        pairs = pairs.groupBy("node").agg(F.max(F.struct("hits", F.xxhash64("b", F.lit(k)).alias("o"), "b")).alias("h")).select(F.col("node").alias("a"), F.col("h.b").alias("b"))
        sifted = sift(pairs)
        sifted = hold(sifted, "sifted")
        release(spark)
        found = hold(verify(sifted.where("open").select("a", "b")), "found")
        release(spark)
        new = found.where("linked").select("a", "b")
        links = new if links is None else links.unionByName(new)
        n_new = new.count()
        # Distances to the round's hub: exact ones, or a lower bound (then at most 1).
        seen = sifted.join(found.select("a", "b", "dist"), ["a", "b"], "left").select(F.col("a").alias("node"), F.col("b").alias(f"h{k}"), F.coalesce("dist", "lo").alias(f"lo{k}"), F.coalesce("dist", F.lit(1.0)).alias(f"hi{k}"))
        known = live
        if k:
            known = live.drop("kept").join(met.groupBy("node").agg(F.collect_list("e").alias("kept")), "node").where(enough)
        known = known.join(seen, "node", "left")
        if n_new:
            label = live.select("node", "c")
            met_c = new.join(label.withColumnsRenamed({"node": "a", "c": "p"}), "a").join(label.withColumnsRenamed({"node": "b", "c": "q"}), "b") if k else new.withColumnsRenamed({"a": "p", "b": "q"})
            known = known.join(hold(merged(met_c.select("p", "q")), "merged"), "c", "left").withColumn("c", F.coalesce("to", "c")).drop("to")
        known = hold(known, "live")
        unstage(live, sifted, *([met] if k else []))
        live, rounds = known, k + 1
        del known, seen, met, pairs, rows, hubs, sifted
        release(spark)
        if n_new < max(20, n_live // 500):
            break

    # Pairs of different components: rows of the smaller set (s), without its most frequent shingles, meet those of the larger (t).
    mixed = live.select("c", F.explode("kept.token").alias("token")).groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("token")
    known = ["node", "n", "l", "c", *(f"{x}{k}" for k in range(rounds) for x in ("h", "lo", "hi")), *(F.col("fold")[w].alias(f"m{w}") for w in range(MARK))]
    folded = live.withColumn("fold", F.explode(F.array(_folded(F.col("mark"), F.lit(MARK)))))
    ranked = F.expr("transform(array_sort(transform(filter(kept, x -> x.pos < small), x -> struct(-x.df, x.token as token))), x -> x.token)")
    s = folded.select(*known, F.posexplode(ranked).alias("rank", "token")).join(mixed, "token").alias("s")
    t = folded.select(*known, F.explode("kept.token").alias("token")).join(mixed, "token").alias("t")
    most = 1 - percent / 100 + 1e-9
    near = [f"s.token = t.token and s.c != t.c and struct(s.n, s.node) < struct(t.n, t.node) and 100 * s.n >= {percent} * t.n and s.rank >= least(s.l, t.l) - 1"]
    near.append(f"{100 + percent} * ({' + '.join(f'bit_count(s.m{w} ^ t.m{w})' for w in range(MARK))}) <= {100 - percent} * (s.n + t.n)")
    near.append("not coalesce(" + " or ".join(f"(s.h{k} = t.h{k} and (s.lo{k} - t.hi{k} > {most!r} or t.lo{k} - s.hi{k} > {most!r}))" for k in range(rounds)) + ", false)")
    pairs = hold(s.join(t, F.expr(" and ".join(near))).select(F.col("s.node").alias("a"), F.col("t.node").alias("b")).distinct(), "pairs")
    release(spark)
    # The wider bitmaps have to leave a link possible, and the prefixes to share as many shingles as the smaller l.
    x = live.select(F.col("node").alias("a"), F.col("l").alias("l"), F.expr("transform(filter(kept, x -> x.pos < small), x -> x.token)").alias("x"))
    y = live.select(F.col("node").alias("b"), F.col("l").alias("k"), F.col("kept.token").alias("y"))
    near = sift(pairs).where("open").select("a", "b")
    shared_ = hold(near.join(x, "a").join(y, "b").where("size(array_intersect(x, y)) >= least(l, k)").select("a", "b"), "shared")
    release(spark)
    found = hold(verify(shared_), "found")
    links = links.unionByName(found.where("linked").select("a", "b"))
    groups = connected(links)
    comps = groups.withColumnRenamed("c", "comp")
    unstage(live, sets, pairs, shared_)

    def member_rows(batches):
        yield from _batches(((i.as_py(), len(u), _node(u)) for i, u in _sets(batches, "id", "text")), ["id", "n", "node"], [id_type, pa.int64(), pa.int64()])

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    members = hold(src.mapInArrow(member_rows, f"id {kind}, n long, node long"), "members")
    some = members.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    linked = some.join(comps, "node")
    low = linked.groupBy("comp").agg(F.min("least").alias("low"))
    low = linked.join(low, "comp").select("node", "low")
    named = hold(some.join(low, "node", "left").select("node", F.coalesce("low", "least").alias("component_id"), "copies"), "named")
    unstage(groups)
    # Texts with many copies are few; their copies are named apart from the rest, not all in one task.
    common = named.where(F.col("copies") > COPIES).select("node", F.col("component_id").alias("common_id"))
    if common.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        out = members.join(F.broadcast(common), "node", "left")
    else:
        salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        out = salted.join(common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["node", "salt"], "left")
    out = out.withColumn("key", F.when(F.col("common_id").isNull() & (F.col("n") > 0), F.col("node")).otherwise(F.xxhash64("id", "n")))  # the others are dealt at random
    out = out.join(named.where(F.col("copies") <= COPIES).select(F.col("node").alias("key"), "component_id"), "key", "left")
    out = out.withColumn("component_id", F.coalesce("common_id", "component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _filter(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of different nodes: each slice of it is made from the nodes that it holds, on the executors."""

    def part(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros((1 << BLOOM_BITS) // BLOOM_SLICES >> 3, np.uint8)
        for b in batches:
            for x in _bits(b.column("node").to_numpy())[1]:
                np.bitwise_or.at(flags, x >> 3, (1 << (x & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([flags.tobytes()], pa.binary())], ["slice", "part"])

    def sliced(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bits(b.column("node").to_numpy())[0]), b.column("node")], ["slice", "node"])

    out = np.zeros((BLOOM_SLICES, (1 << BLOOM_BITS) // BLOOM_SLICES >> 3), np.uint8)
    for r in nodes.mapInArrow(sliced, "slice long, node long").groupBy("slice").applyInArrow(part, "slice long, part binary").collect():
        out[r["slice"]] = np.frombuffer(r["part"], np.uint8)
    return out


def merged(links: DataFrame, steps: int = 3) -> DataFrame:
    """``c, to``: a common name for components that ``links(p, q)`` connect, by taking the least name of all neighbours a few times.

    That is all for a hub and its partners. On longer chains the names of connected components may still differ,
    but equal names always mean connected ones.
    """
    both = links.union(links.select("q", "p")).where("p != q").distinct()
    to = both.groupBy("p").agg(F.least("p", F.min("q")).alias("to"))
    for _ in range(steps - 1):
        near = both.join(to.withColumnsRenamed({"p": "q"}), "q").groupBy("p").agg(F.min("to").alias("near"))
        to = to.join(near, "p").select("p", F.least("to", "near").alias("to"))
    return to.withColumnRenamed("p", "c")


def connected(links: DataFrame) -> DataFrame:
    """``node, c``: the least node of each node's component, for all nodes of ``links(a, b)``.

    Alternates large-star and small-star steps, so a hub of any size is spread over its neighbours' keys and the
    number of rounds grows with the logarithm of the longest chain.
    """
    edges = stage(links.select("a", "b").where("a != b").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        new = stage(small, "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        unstage(edges)
        edges = new
        if now == before:
            break
        before = now
    c = edges.groupBy("a").agg(F.min("b").alias("c"))
    roots = c.select(F.col("c").alias("a")).distinct().withColumn("c", F.col("a"))
    out = stage(c.union(roots).select(F.col("a").alias("node"), "c"), "components")
    unstage(edges)
    return out
