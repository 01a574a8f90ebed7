"""Tables and small counters that the stages of one operator hand on through shared storage."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


FAN_IN = 512  # counters of so many tasks are summed at once
# Arrow batches: the settings' names, Spark's defaults, and what operators on texts use instead.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows and 16 MB at most, as texts may be long, where the session still has Spark's defaults."""
    for key, (default, own) in BATCHES.items():
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, own)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset and all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rolefinch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later uses neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in shared storage."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unstage(*frames: DataFrame) -> None:
    """Remove staged tables that nothing lazy reads any more."""
    for df in frames:
        if path := getattr(df, "staged_path", None):
            remove(df.sparkSession, path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over: it does so once the driver has collected their plans. The driver's own free memory goes back to the system."""
    from .text import give_back

    for _ in range(2):  # the first round frees what the second one's references stood for
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)
    give_back()


def merged_counters(df: DataFrame, column_fn, size: int, dtype, slices: int = 32) -> np.ndarray:
    """One array of ``size`` counters over all rows of ``df``.

    ``column_fn(batches)`` gives one array per task (``dtype``); the arrays are cut into ``slices``, of which empty
    ones are left out, summed by slice on the executors, and the sums, of a fixed total size, come to the driver.
    With many tasks they are summed in two steps, so that no task reads the slices of more than ``FAN_IN`` others.
    """
    step = -(-size // slices)
    wide = np.int64
    tasks = df.rdd.getNumPartitions()

    def per_task(batches):
        arr = column_fn(batches)
        if arr is not None:
            group = TaskContext.get().partitionId() // FAN_IN
            for k in range(slices):
                part = arr[k * step : (k + 1) * step]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([group], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "group", "part"])

    def per_slice(kind):
        def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for x in b.column("part"):
                    a = np.frombuffer(x.as_buffer(), kind)
                    total = a.astype(wide) if total is None else total + a
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "part"])

        return add

    schema = "slice int, part binary"
    parts = df.mapInArrow(per_task, "slice int, group int, part binary")
    if tasks > FAN_IN:
        parts = parts.groupBy("slice", "group").applyInArrow(per_slice(dtype), schema).groupBy("slice").applyInArrow(per_slice(wide), schema)
    else:
        parts = parts.groupBy("slice").applyInArrow(per_slice(dtype), schema)
    out = np.zeros(size, wide)
    for r in parts.collect():
        a = np.frombuffer(r["part"], wide)
        out[r["slice"] * step : r["slice"] * step + len(a)] = a
    return out
