"""Immutable snapshots in the folder that driver and executors share, and the net changes since."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import shared_root


class Store:
    """Every write goes to a new folder, so a frame that was handed out stays readable until its folder is dropped."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = shared_root(spark, "cache")

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def counted(self, df: DataFrame) -> tuple[DataFrame, str, int]:
        """As ``put``, and the number of rows, counted by the write itself."""
        seen = Observation()
        frame, path = self.put(df.observe(seen, F.count(F.lit(1)).alias("n")))
        return frame, path, seen.get["n"]

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def size(self, path: str) -> int:
        files, where = self._files(path)
        return files.getContentSummary(where).getLength() if files.exists(where) else 0

    def drop(self, path: str) -> None:
        files, where = self._files(path)
        files.delete(where, True)


#: Net changes are put into the rows when they are over this part of them.
COMPACT = 8


@dataclass(frozen=True)
class Snapshot:
    """Rows of a table, as written once, and the last change of each key since.

    A batch of changes writes no more than the changes held so far; rows are
    written anew when changes are over an eighth of them, so each change is
    written a bounded number of times. Folders that a change replaces are
    dropped by the next change, so frames live for one more.
    """

    store: Store
    key: tuple[str, ...]
    written: DataFrame
    path: str | None = None
    rows: int | None = None
    net: DataFrame | None = None
    net_path: str | None = None
    retired: tuple[str, ...] = field(default=())

    @staticmethod
    def of(store: Store, key: list[str], df: DataFrame) -> Snapshot:
        frame, path, n = store.counted(df)
        return Snapshot(store, tuple(key), frame, path, n)

    @property
    def frame(self) -> DataFrame:
        if self.net is None:
            return self.written
        columns = self.written.columns
        fresh = self.net.where("op <> 'D'").select(*columns)
        return self.written.join(self.net.select(*self.key), list(self.key), "left_anti").select(*columns).unionByName(fresh)

    def changed(self, net: DataFrame, admitted: Column | None = None) -> Snapshot:
        """After net changes (op, the columns; one row per key); rows that aren't admitted leave."""
        columns = ["op", *self.written.columns]
        net = net if admitted is None else net.withColumn("op", F.when(admitted, F.col("op")).otherwise("D"))
        net = net.select(*columns)
        if self.net is not None:
            net = self.net.join(net.select(*self.key), list(self.key), "left_anti").select(*columns).unionByName(net)
        frame, path, n = self.store.counted(net)
        rows = self.written.count() if self.rows is None else self.rows
        for old in self.retired:
            self.store.drop(old)
        after = replace(self, rows=rows, net=frame, net_path=path, retired=tuple(p for p in (self.net_path,) if p))
        if n * COMPACT <= rows:
            return after
        whole = Snapshot.of(self.store, list(self.key), after.frame)
        return replace(whole, retired=tuple(p for p in (self.path, self.net_path, path) if p))

    def replaced(self, df: DataFrame) -> Snapshot:
        """Other rows in place of all."""
        for old in self.retired:
            self.store.drop(old)
        return replace(Snapshot.of(self.store, list(self.key), df), retired=tuple(p for p in (self.path, self.net_path) if p))

    def folders(self) -> list[str]:
        return [p for p in (self.path, self.net_path) if p]

    def size(self) -> int:
        return sum(self.store.size(p) for p in self.folders())

    def drop(self) -> None:
        for path in (*self.folders(), *self.retired):
            self.store.drop(path)
