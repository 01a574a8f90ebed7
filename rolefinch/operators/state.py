"""Change tracking of postings over board scans.

A scan is complete, partial, failed or unchanged. Complete and partial scans list postings; a listed posting is
new, or refreshed, revised if its content changed, and reopened if it was closed. A complete scan that does not
list an open posting is a miss; the second miss in a row closes it. Failed and unchanged scans change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..stored import kept

MISSES = 2


def validated(snapshot: DataFrame) -> DataFrame:
    """The snapshot, or an error if it lists a posting twice on one board."""
    n = F.count("*").over(W.partitionBy("board", "posting_id"))
    return snapshot.withColumn("_n", n).withColumn("posting_id", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("listed twice: "), F.col("posting_id").cast("string")))).otherwise(F.col("posting_id"))).drop("_n")


#: What a listing refreshes although its content is the same, as far as state and snapshot have it.
MUTABLE = ("title", "normalized_title", "url", "locations", "remote_policy", "department", "posted_at", "updated_at", "salary_min", "salary_max", "salary_currency", "salary_period", "raw_json")


def scan_result(state: DataFrame, snapshot: DataFrame, scans: DataFrame, now) -> DataFrame:
    """The state after one scan of each board, with ``kinds``, the kinds of events in order; one join on (board, posting)."""
    at = now.cast("timestamp_ntz")
    mutable = [c for c in MUTABLE if c in state.columns and c in snapshot.columns]
    lists = scans.where(F.col("status").isin("complete", "partial")).select("board", F.col("status").alias("scan"))
    new = validated(snapshot.join(lists, "board", "left_semi")).select("board", "posting_id", *(F.col(c).alias(f"new_{c}") for c in ("content_hash", "body_text", *mutable)), F.lit(True).alias("listed"))
    j = state.withColumn("known", F.lit(True)).join(new, ["board", "posting_id"], "full").join(lists, "board", "left")
    listed, known = F.coalesce("listed", F.lit(False)), F.coalesce("known", F.lit(False))
    missed = ~listed & (F.col("scan") == "complete") & (F.col("status") == "open")
    closes = F.coalesce(missed & (F.col("missing") + 1 >= MISSES), F.lit(False))
    revised = listed & known & (F.col("new_content_hash") != F.col("content_hash"))
    new_values = {
        "content_hash": F.when(listed, F.col("new_content_hash")).otherwise(F.col("content_hash")),
        "body_text": F.when(listed & (~known | revised), F.col("new_body_text")).otherwise(F.col("body_text")),  # an edit that leaves the hash leaves the stored text
        **{c: F.when(listed, F.col(f"new_{c}")).otherwise(F.col(c)) for c in mutable},
        "status": F.when(listed, "open").when(closes, "closed").otherwise(F.col("status")),
        "missing": F.when(listed, 0).when(missed, F.col("missing") + 1).otherwise(F.col("missing")).cast("int"),
        "first_seen": F.when(known, F.col("first_seen")).otherwise(at),
        "last_seen": F.when(listed, at).otherwise(F.col("last_seen")),
        "closed_at": F.when(listed, F.lit(None)).when(closes, at).otherwise(F.col("closed_at")),
    }
    kinds = F.array(F.when(listed & ~known, "new"), F.when(listed & known & (F.col("status") == "closed"), "reopened"), F.when(revised, "revised"), F.when(closes, "closed"))
    return j.select(*(new_values.get(c, F.col(c)).alias(c) for c in state.columns), F.array_compact(kinds).alias("kinds"))


def result_events(result: DataFrame, now) -> DataFrame:
    return result.select("board", "posting_id", F.posexplode("kinds").alias("step", "kind"), now.cast("timestamp_ntz").alias("at"))


def apply_snapshot(state: DataFrame, snapshot: DataFrame, scans: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(new state, events) after one scan of each board.

    ``state(board, posting_id, content_hash, body_text, MUTABLE..., status, missing, first_seen, last_seen, closed_at)``,
    ``snapshot(board, posting_id, content_hash, body_text, MUTABLE...)``, ``scans(board, status)``, ``now`` a column.
    Boards that are not scanned keep their state.
    """
    result = scan_result(state, snapshot, scans, now)
    return result.drop("kinds"), result_events(result, now)


def merge_scan(path: str, snapshot: DataFrame, scans: DataFrame, now) -> DataFrame:
    """Bring the state stored under ``path``, partitioned by board, up to date with one scan of some boards; the events.

    Only the partitions of boards with a complete or partial scan are read (Spark prunes them by the scans) and
    written; the join is made once. A run that stops before the last write leaves the state as it was.
    """
    spark = snapshot.sparkSession
    state = spark.read.parquet(path)
    result = kept(scan_result(state.join(scanned(scans), "board", "left_semi"), snapshot, scans, now), "scan")
    result.drop("kinds").select(*state.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("board").parquet(path)
    return result_events(result, now)


def scanned(scans: DataFrame) -> DataFrame:
    """The boards whose scan lists postings; failed and unchanged scans change nothing."""
    return scans.where(F.col("status").isin("complete", "partial")).select("board")


#: The order of a posting's events in one scan; closings come after all listings of their board.
STEPS = ("new", "reopened", "revised", "closed")


def append_events(log: DataFrame, events: DataFrame, scan: str | None = None) -> DataFrame:
    """``log(id, ...)`` with ``events(board, posting_id, kind, ...)`` after it, numbered on from the greatest id without gaps.

    An id is a cursor: what is greater happened later. The order is that of scans (column ``scan``, if given), in a scan
    that of boards, on a board listings before closings, then postings, of a posting ``STEPS``. Rows are dealt to
    partitions by ranges of this order and sorted there; only the partitions' sizes are summed up in one place.
    """
    keys = [*([F.col(scan)] if scan else []), F.col("board"), F.col("kind") == STEPS[-1], F.col("posting_id"), F.array_position(F.array(*map(F.lit, STEPS)), F.col("kind"))]
    place = F.monotonically_increasing_id()  # the partition's number, then the row's in it
    x = kept(events.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", place), "events").withColumn("_part", F.shiftright("_place", 33))
    sizes = x.groupBy("_part").agg(F.count("*").alias("n"))
    starts = sizes.select("_part", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("_start"))  # a row for each partition
    top = log.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    x = x.join(F.broadcast(starts), "_part").withColumn("id", top + F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return log.unionByName(x.select(*log.columns))


def replay_history(scans: DataFrame, listings: DataFrame) -> DataFrame:
    """A row for each listing of a complete or partial scan, with what follows it, by windows over listings alone.

    ``scans(board, seq, status)`` and ``listings(board, posting_id, seq, content_hash)``; listings of failed and
    unchanged scans do not count. ``gap`` is how many complete scans missed the posting since its listing before,
    ``ahead`` how many miss it after this one and until its next, ``closing`` the scan of the second of them.
    """
    per_board = W.partitionBy("board")
    live = scans.where(F.col("status").isin("complete", "partial")).withColumn("whole", (F.col("status") == "complete").cast("int"))
    live = live.withColumn("cc", F.sum("whole").over(per_board.orderBy("seq"))).withColumn("total", F.sum("whole").over(per_board))
    closings = live.where("whole = 1").select("board", (F.col("cc") - MISSES).alias("cc"), F.col("seq").alias("closing"))
    live = live.join(closings, ["board", "cc"], "left").select("board", "seq", "whole", "cc", "total", "closing")
    w = W.partitionBy("board", "posting_id").orderBy("seq")
    x = listings.join(live, ["board", "seq"])
    missed_before = F.col("cc") - F.col("whole") - F.lag("cc").over(w)
    missed_after = F.coalesce(F.lead(F.col("cc") - F.col("whole")).over(w), F.col("total")) - F.col("cc")
    return x.select("board", "posting_id", "seq", "content_hash", F.lag("content_hash").over(w).alias("before"), missed_before.alias("gap"), missed_after.alias("ahead"), "closing", F.lead("seq").over(w).isNull().alias("last"))


def history_events(history: DataFrame) -> DataFrame:
    known = F.col("before").isNotNull()
    kinds = F.array(
        F.when(~known, F.struct("seq", F.lit("new").alias("kind"))), F.when(known & (F.col("gap") >= MISSES), F.struct("seq", F.lit("reopened").alias("kind"))),
        F.when(known & (F.col("before") != F.col("content_hash")), F.struct("seq", F.lit("revised").alias("kind"))), F.when(F.col("ahead") >= MISSES, F.struct(F.col("closing").alias("seq"), F.lit("closed").alias("kind"))),
    )
    return history.select("board", "posting_id", F.inline(F.array_compact(kinds)))


def history_final(history: DataFrame) -> DataFrame:
    missing = F.least(F.lit(MISSES), F.col("ahead")).cast("int")
    return history.where("last").select("board", "posting_id", F.when(missing >= MISSES, "closed").otherwise("open").alias("status"), missing.alias("missing"), "content_hash")


def board_counters(events: DataFrame) -> DataFrame:
    """``board, seq, new, reopened, revised, closed``: how many events of each kind every scan of a board made."""
    return events.groupBy("board", "seq").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("new", "reopened", "revised", "closed")))
