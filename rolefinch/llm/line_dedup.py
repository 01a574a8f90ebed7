"""Removal of line runs that repeat earlier text, by winnowing over line hashes.

A window is a run of consecutive lines of one document with at least ``min_words`` words that is as short as it
can be from its first line on, or from its last line back. Of each window the line with the least hash (the
first of equal ones) is selected as fingerprint. A repeated run of at least that many words holds whole windows,
and wherever such a window occurs the same line of it is selected: so only places of selected lines are joined, and
lines selected once only drop out. A place knows the hashes of the lines around it, as far as the windows reach that
selected it, and it meets the first place at which one of these windows occurs. From there the match is extended
both ways, line by line, to one maximal run; the runs of a document merge. Every occurrence but the first (in order
of id, then line) is deleted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches, stage, unstage, unused
from .text import _SPACE, Chunk, chunks, signed, spans

SALTS = 32  # parts into which the places of one line, or of one window, are dealt in a join


def _lines(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number, and words before it (one more than there are lines), for all lines of a chunk."""
    buf, n = c.buf, len(c.buf)
    full = np.flatnonzero(np.diff(c.offsets) > 0)
    newline = np.flatnonzero(buf == 10)
    start = np.union1d(c.offsets[full], newline + 1)
    owner = np.searchsorted(c.offsets, start, "right") - 1
    # A text that ends with a newline has an empty last line; its start belongs to that text, not to the next.
    tail = newline[np.isin(newline + 1, c.offsets[1:])]
    end = np.empty(len(start), np.int64)
    nl = np.append(newline, n)
    end[:] = np.minimum(nl[np.searchsorted(nl, start)], c.offsets[np.minimum(owner + 1, len(c.offsets) - 1)])
    if len(tail):
        owner_tail = np.searchsorted(c.offsets, tail, "right") - 1
        keep = (start < n) & (end >= start)
        start, end, owner = start[keep], end[keep], owner[keep]
        start, end, owner = np.append(start, tail + 1), np.append(end, tail + 1), np.append(owner, owner_tail)
        order = np.lexsort((start, owner))
        start, end, owner = start[order], end[order], owner[order]
    word = ~_SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = c.offsets[(c.offsets > 0) & (c.offsets < n)]
    first[inner] = word[inner]
    count = np.concatenate([[0], np.cumsum(first)])
    words = np.concatenate([[0], np.cumsum(count[end] - count[start])])
    return start, end, owner, words


def selected(c: Chunk, min_words: int) -> tuple[np.ndarray, ...]:
    """All windows of a chunk, those of one selected line together, and the hash of every line.

    (text number, selected line, first and last line of the window, hash of the window's lines); lines count from 0 in
    the chunk. Then the line hashes, and the first line of each line's text.
    """
    start, end, owner, words = _lines(c)
    n = len(start)
    line = np.arange(n)
    b = np.searchsorted(words, words[:-1] + min_words, "left") - 1
    ok = b < n
    ok[ok] = owner[b[ok]] == owner[ok]
    a = np.searchsorted(words, words[1:] - min_words, "right") - 1
    ok2 = a >= 0
    ok2[ok2] = owner[a[ok2]] == owner[ok2]
    a = np.minimum(a, line)
    pairs = np.unique(np.concatenate([line[ok] * (n + 1) + b[ok], a[ok2] * (n + 1) + line[ok2]]))
    a, b = pairs // (n + 1), pairs % (n + 1)
    each = spans(c.buf, start, end)
    hashes, order = np.unique(each, return_inverse=True)
    if len(a):
        low = np.minimum.reduceat(np.append(order, n), np.stack([a, b + 1], 1).ravel())[::2]
        places = np.sort(order * n + line)
        at = places[np.searchsorted(places, low * n + a)] % n
    else:
        at = a
    by = np.lexsort((b, a, at))
    a, b, at = a[by], b[by], at[by]
    return owner[a], at, a, b, signed(spans(c.buf, start[a], end[b])), signed(each), np.searchsorted(owner, owner)


def _without(text: str, runs: np.ndarray) -> tuple[str, int]:
    """The text without the lines of ``runs`` (first and last line of each), and how many these are."""
    lines = text.split("\n")
    edges = np.zeros(len(lines) + 1, np.int64)
    np.add.at(edges, runs[:, 0], 1)
    np.add.at(edges, runs[:, 1] + 1, -1)
    gone = np.cumsum(edges[:-1]) > 0
    return "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), int(gone.sum())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` with repeated line runs deleted from ``text_col``, plus ``n_lines`` and ``n_deleted``.

    A line goes if a run of consecutive lines around it, of ``min_words`` words or more, occurs earlier: in a
    document with a smaller id (null ids come last), or further up in the same one. Lines are compared byte for
    byte and end at newlines; the rest of the text is kept as it is. Null texts stay null, empty ones empty; both
    have no lines. Rows that repeat id and text count as one document, so none of them is later than the others;
    rows that repeat an id with other texts are told apart. Other columns are kept, whatever their names, except
    that ``n_lines`` and ``n_deleted`` are replaced. Very long texts are read whole, one at a time. An empty table gives
    an empty result.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in ("h", "line", "fingerprint", "at")), *(T.StructField(x, T.ArrayType(T.LongType())) for x in ("lines", "windows"))])

    def emit(batches):
        for x in batches:
            ids, hs = x.column("id"), x.column("h")
            for c in chunks(x.column("text")):
                d, at, a, b, content, each, head = selected(c, min_words)
                first = np.flatnonzero(np.diff(at, prepend=-1) != 0)
                if not len(first):
                    continue
                ends = np.append(first, len(d))
                lo, hi = np.minimum.reduceat(a, first), np.maximum.reduceat(b, first) + 1
                around = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
                lines = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int32)), pa.array(each[around]))
                of, place = pa.array(d[first] + c.lo), at[first]
                yield pa.RecordBatch.from_arrays([ids.take(of), hs.take(of), pa.array(place - head[place]), pa.array(each[place]), pa.array(place - lo), lines, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(content))], schema.names)

    salt = F.pmod(F.xxhash64("id", "h", "line"), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    places = keyed.select("id", "h", "text").mapInArrow(emit, schema)
    shared = places.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint", salts)
    rows = stage(places.select("*", salt).join(shared, ["fingerprint", "salt"]), "places")
    windows = rows.select("fingerprint", "salt", F.explode("windows").alias("window"), F.struct(F.col("id").isNull().alias("last"), "id", "h", "line").alias("place"), F.struct("at", "lines").alias("here"))
    first = windows.groupBy("fingerprint", "window").agg(F.min("place").alias("first"), F.max("place").alias("final"), F.min_by("here", "place").alias("there")).where("first != final").select("fingerprint", "window", "first", "there", salts)
    later = windows.join(first, ["fingerprint", "window", "salt"]).where("place > first")
    same = lambda x, y: F.coalesce(F.nullif(F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False), F.lit(0)) - 1, F.size(x))  # noqa: E731  how many agree from the start; the longer one is padded with nulls
    ahead = lambda w: F.slice(F.col(f"{w}.lines"), F.col(f"{w}.at") + 1, F.size(f"{w}.lines"))
    behind = lambda w: F.reverse(F.slice(F.col(f"{w}.lines"), F.lit(1), F.col(f"{w}.at")))
    run = F.struct((F.col("place.line") - same(behind("here"), behind("there"))).cast("int").alias("a"), (F.col("place.line") + same(ahead("here"), ahead("there")) - 1).cast("int").alias("b"))
    key, mark, runs = unused(docs, "id"), unused(docs, "h"), unused(docs, "runs")
    found = stage(later.groupBy(F.col("place.id").alias(key), F.col("place.h").alias(mark)).agg(F.collect_set(run).alias(runs)), "runs")
    unstage(rows)
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_deleted")]
    whole = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in kept))
    joined = whole.join(found.hint("merge"), F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(mark)), "left").select(*(F.col(f"`{c}`") for c in kept), runs)

    def cut(batches):
        for x in batches:
            texts, gone = x.column(text_col), x.column(runs)
            lines = pc.if_else(pc.greater(pc.binary_length(texts), 0), pc.add(pc.count_substring(texts, "\n"), 1), 0)
            n_lines = pc.fill_null(lines, 0).cast(pa.int32()).to_numpy()
            n_gone, changed = np.zeros(len(texts), np.int32), {}
            for k in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)):
                both = gone[int(k)].values
                changed[int(k)], n_gone[k] = _without(texts[int(k)].as_py(), np.stack([both.field(0).to_numpy(), both.field(1).to_numpy()], 1))
            if changed:
                touched = np.zeros(len(texts), bool)
                touched[list(changed)] = True
                texts = pc.replace_with_mask(texts, pa.array(touched), pa.array(list(changed.values()), texts.type))
            yield pa.RecordBatch.from_arrays([*(texts if c == text_col else x.column(c) for c in kept), pa.array(n_lines), pa.array(n_gone)], [*kept, "n_lines", "n_deleted"])

    fields = [*(T.StructField(c, T.StringType() if c == text_col else docs.schema[c].dataType) for c in kept), T.StructField("n_lines", T.IntegerType()), T.StructField("n_deleted", T.IntegerType())]
    return joined.mapInArrow(cut, T.StructType(fields))
