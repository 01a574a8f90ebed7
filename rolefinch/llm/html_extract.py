"""Main text of web pages by consensus of their host.

Pages of a host share templates. Each page scores its containers by the text they hold outside of links and page
furniture and votes for the path of the best one: the tags and classes from the body down, numbers in them
generalised. Spark adds up the votes by host and path. A path with at least a tenth of its host's votes wins, so a
host has ten at most. Then every page is read again: from its own path if that has won, else from the most voted
winning path it has, else (few pages, a template of its own) from its own best container.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .page_tree import CONTAINERS, Page, parse, visible
from .shared import small_batches, stage, unstage

SHARE = 10  # a path wins with a SHARE-th of the votes
BROADCAST_HOSTS = 50_000  # hosts whose winning paths are broadcast, some ten MB; more are joined
SALTS = 32


def host(url: Column) -> Column:
    """The host of an address in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def scores(page: Page, shown: list[bool]) -> list[int]:
    """Characters outside of links and furniture that each element holds."""
    total = [0] * len(page.tags)
    for node, text, linked in page.blocks:
        if shown[node]:
            total[node] += max(0, len(text) - linked)
    for k in range(len(total) - 1, 0, -1):
        total[page.parents[k]] += total[k]
    return total


def best_container(page: Page, shown: list[bool], total: list[int]) -> int:
    """From the top down, the container that holds four fifths of what the one around it holds; an article is taken whole. 0 if nothing is shown."""
    inner: dict[int, int] = {}  # the container around each element
    under: dict[int, list[int]] = {}
    for k in range(1, len(page.tags)):
        around = inner.get(page.parents[k], 0)
        inner[k] = around
        if page.tags[k] in CONTAINERS and shown[k]:
            under.setdefault(around, []).append(k)
            inner[k] = k
    at = 0
    while total[at] and page.tags[at] != "article" and at in under:
        k = max(under[at], key=lambda k: (total[k], -k))
        if 5 * total[k] < 4 * total[at]:
            break
        at = k
    return at


def path_of(page: Page, node: int) -> str:
    out = []
    while node:
        out.append(page.labels[node])
        node = page.parents[node]
    return ">".join(reversed(out))


@lru_cache(4096)
def _trie(paths: tuple[str, ...]) -> dict:
    root: dict = {}
    for rank, path in enumerate(paths):
        at = root
        for label in path.split(">"):
            at = at.setdefault(label, {})
        at[None] = rank
    return root


def on_paths(page: Page, paths: tuple[str, ...]) -> dict[int, list[int]]:
    """The elements on each of ``paths``, by the path's place in the list."""
    at: list = [_trie(paths)] + [None] * (len(page.tags) - 1)
    found: dict[int, list[int]] = {}
    for k in range(1, len(page.tags)):
        up = at[page.parents[k]]
        if up is not None:
            at[k] = here = up.get(page.labels[k])
            if here is not None and None in here:
                found.setdefault(here[None], []).append(k)
    return found


def main_text(source: str, paths: tuple[str, ...]) -> str:
    """The text of a page, given the winning paths of its host, most voted first."""
    page = parse(source)
    shown = visible(page)
    total = scores(page, shown)
    own = best_container(page, shown, total)
    chosen = {own}
    if own:
        found = on_paths(page, paths) if paths else {}
        ranked = sorted(found, key=lambda r: (own not in found[r], r))
        for r in ranked:
            most = max(total[k] for k in found[r] if shown[k]) if any(shown[k] for k in found[r]) else 0
            if most:
                chosen = {k for k in found[r] if shown[k] and (page.tags[k] == "article" or 5 * total[k] >= most)}
                break
    inside = [k in chosen for k in range(len(page.tags))]
    for k in range(1, len(inside)):
        inside[k] = inside[k] or inside[page.parents[k]]
    return "\n".join(text for node, text, _ in page.blocks if inside[node] and shown[node])


def votes(pages: DataFrame) -> DataFrame:
    """``host, path, votes, score`` of ``pages(host, html)``; a page without text or without a container does not vote."""

    def vote(batches):
        for b in batches:
            out = []
            for h, source in zip(b.column(0).to_pylist(), b.column(1)):
                page = parse(source.as_py() or "")
                shown = visible(page)
                total = scores(page, shown)
                node = best_container(page, shown, total)
                if node:
                    out.append((h, path_of(page, node), total[node]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["host", "path", "score"])

    return pages.mapInArrow(vote, "host string, path string, score long").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))


def winners(counted: DataFrame) -> DataFrame:
    """``host, paths``: the paths with a ``SHARE``-th of their host's votes at least, most voted first."""
    whole = counted.groupBy("host").agg(F.sum("votes").alias("whole"))
    won = counted.join(whole, "host").where(F.col("votes") * SHARE >= F.col("whole"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path")))
    return won.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars``: the main text of every page, blocks in page order joined by line ends.

    Left out are menus, headers, footers, sidebars, notices, adverts, forms, remarks, scripts, styles and markup; an
    article's own header keeps its headings. Character references are decoded, white space within a block is one
    space, a line break too. A null page is an empty text, as is one without any. Pages without an address or a host have
    no consensus and are read by themselves. Null and repeated ids and addresses are rows like others; very long pages
    are read whole, one at a time; an empty table gives an empty result. Other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    h, w = "host", "paths"
    data = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host(F.col(url_col).cast("string")).alias(h), F.col(html_col).cast("string").alias("html"))
    counted = stage(votes(data.where(F.col(h) != "").select(h, "html")), "votes")
    won = stage(winners(counted), "winners")
    unstage(counted)
    if won.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        joined = data.join(F.broadcast(won), h, "left")
    else:  # a host with very many pages is spread over SALTS tasks
        salted = data.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
        joined = salted.join(won.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [h, "salt"], "left")
    out = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def read(batches):
        for b in batches:
            texts = [main_text(x.as_py() or "", tuple(p or ())) for x, p in zip(b.column("html"), b.column(w).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], out.names)

    return joined.select("id", "url", "html", w).mapInArrow(read, out).toDF(id_col, url_col, "text", "n_chars")
