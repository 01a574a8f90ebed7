"""Change tracking of a stream of scans, with state kept by Spark between micro-batches.

The rules are those of ``operators.state``. A scan's listings go to ``parts`` groups of their board by a hash of the
posting; the scan itself, as a row without a posting, goes to all of them, so that each group knows what was missed.
A group's state is what it knows of its postings, some thousandths of a large board.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import MISSES

PARTS = 64


def scan_rows(scans: DataFrame, listings: DataFrame) -> DataFrame:
    """``board, seq, status, posting_id, content_hash``: a row for each listing, and one without a posting for each scan."""
    rows = listings.join(scans, ["board", "seq"]).select("board", "seq", "status", "posting_id", "content_hash")
    return scans.select("board", "seq", "status").unionByName(rows, allowMissingColumns=True)


def fold(known: dict, rows: pd.DataFrame, last: int) -> tuple[list[tuple], int]:
    """Events of the scans in ``rows`` after number ``last``, in order; ``known`` (posting: hash, misses) is brought up to date."""
    events = []
    for seq, scan in rows[rows["seq"] > last].sort_values("seq", kind="stable").groupby("seq"):
        last, status = int(seq), scan["status"].iloc[0]
        if status not in ("complete", "partial"):
            continue
        here = scan[scan["posting_id"].notna()]
        if here["posting_id"].duplicated().any():
            raise ValueError(f"scan {seq} lists a posting twice")
        listed = dict(zip(here["posting_id"], here["content_hash"]))
        for p, content in sorted(listed.items()):
            before, misses = known.get(p, (None, 0))
            kinds = ["new"] if p not in known else ["reopened"] * (misses >= MISSES) + ["revised"] * (before != content)
            events += [(p, last, kind) for kind in kinds]
            known[p] = (content, 0)
        if status == "complete":
            for p, (content, misses) in sorted(known.items()):
                if p not in listed and misses < MISSES:
                    known[p] = (content, misses + 1)
                    events += [(p, last, "closed")] * (misses + 1 == MISSES)
    return events, last


def stream_events(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """``board, posting_id, seq, kind`` of a stream of ``scan_rows``, as an appending stream.

    Rows of a scan have to arrive together and scans of a board in the order of ``seq``; what arrives later than a
    greater number of its board is taken as seen before and ignored.
    """
    posting = rows.schema["posting_id"].dataType
    to = F.when(F.col("posting_id").isNull(), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.pmod(F.xxhash64("posting_id"), F.lit(parts)).cast("int")))
    as_text = F.col("posting_id").cast("string")  # a column of numbers with nulls would turn to doubles on the way
    dealt = rows.select("board", F.col("seq").cast("long").alias("seq"), "status", as_text.alias("posting_id"), "content_hash", F.explode(to).alias("part"))
    out = T.StructType([T.StructField("board", T.StringType()), T.StructField("posting_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType())])
    held = T.StructType([T.StructField("last", T.LongType()), T.StructField("posting", T.ArrayType(T.StringType())), T.StructField("hash", T.ArrayType(T.StringType())), T.StructField("misses", T.ArrayType(T.IntegerType()))])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, known = -1, {}
        if state.exists:
            last, postings, hashes, misses = state.get
            known = {p: (h, int(m)) for p, h, m in zip(postings, hashes, misses)}
        events, last = fold(known, pd.concat(frames), last)
        state.update((last, list(known), [h for h, _ in known.values()], [m for _, m in known.values()]))
        yield pd.DataFrame([(key[0], *e) for e in events], columns=out.names)

    events = dealt.groupBy("board", "part").applyInPandasWithState(step, out, held, "append", GroupStateTimeout.NoTimeout)
    return events.withColumn("posting_id", F.col("posting_id").cast(posting))
