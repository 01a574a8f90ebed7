"""Stored payloads of boards as a Spark source that leaves unchanged ones unread."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .boards import parse, snapshot_status


@dataclass
class Payload(InputPartition):
    board: str
    path: str
    etag: str
    known: bool


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.cache = options["path"], options.get("cache")

    def partitions(self) -> list[Payload]:
        """One for each board: its file, and whether the cache has it as it is."""
        files, root = fs.FileSystem.from_uri(self.path)
        known = set()
        if self.cache:
            held, folder = fs.FileSystem.from_uri(self.cache)
            t = ds.dataset(folder, filesystem=held, format="parquet").to_table(columns=["url", "etag"])
            known = set(zip(t["url"].to_pylist(), t["etag"].to_pylist()))
        out = []
        for f in files.get_file_info(fs.FileSelector(root, recursive=True)):
            if f.type == fs.FileType.File and not re.search(r"/[._][^/]*$", f.path):
                board = re.search(r"/board=([^/]+)/", f.path)
                etag = f"{f.mtime_ns}-{f.size}"
                out.append(Payload(board[1] if board else f.base_name.rsplit(".", 1)[0], f.path, etag, (f.path, etag) in known))
        return out

    def read(self, partition: Payload) -> Iterator[tuple]:
        if partition.known:
            yield (partition.board, partition.path, partition.etag, "unchanged", None)
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_stream(partition.path) as f:
            yield (partition.board, partition.path, partition.etag, "read", f.read().decode("utf-8", "replace"))


class BoardPayloads(DataSource):
    """Format ``boardpayloads``: ``path`` is a folder with a file for each board (``board=NAME/...`` or ``NAME.json``), ``cache`` a Parquet table ``url, etag`` of payloads that need not be read again. Both are read where pyarrow's file systems reach."""

    @classmethod
    def name(cls) -> str:
        return "boardpayloads"

    def schema(self) -> str:
        return "board string, url string, etag string, status string, content string"

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))


def payloads(spark: SparkSession, path: str, cache: str | None = None) -> DataFrame:
    """``board, url, etag, status, content``: the payloads under ``path``, without content where the cache has them."""
    spark.dataSource.register(BoardPayloads)
    read = spark.read.format("boardpayloads").option("path", path)
    return (read.option("cache", cache) if cache else read).load()


def statuses(read: DataFrame, layout: str) -> DataFrame:
    """``board, status, listed, error`` of payloads: unchanged ones list nothing and are no inventory."""
    fresh = snapshot_status(parse(read.where("status = 'read'").select("board", "content"), layout))
    same = read.where("status = 'unchanged'").select("board", "status", F.lit(0).cast("long").alias("listed"), F.lit(None).cast("string").alias("error"))
    return fresh.unionByName(same)
