"""A keyed table of Parquet folders for streams: each batch adds a folder, folders merge level by level, readers take the newest row of a key."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many finished folders of a level merge into one of the next: readers meet less than FAN folders a level, levels grow with the logarithm.
FAN = 4
_NAME = re.compile(r"L(\d+)-(\d+)-(\d+)$")
VERSION = "batch_id"


class KeyedTable:
    """Rows by key under path; of a key the row of the newest version counts, and a version that is written again replaces itself.

    A folder counts once Spark has marked it complete, so a writer may stop anywhere. Folders older than the version being
    written merge; what a merge has taken in is deleted a version later, when readers that had listed it are done. One writer.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str | None = None):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._of = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folders(self) -> list[tuple[int, int, int]]:
        """(level, first, last) of the complete folders."""
        if not self._fs.exists(self._of(self.path)):
            return []
        names = (str(s.getPath()) for s in self._fs.listStatus(self._of(self.path)))
        found = [tuple(map(int, m.groups())) for m in map(_NAME.search, names) if m]
        return sorted(f for f in found if self._fs.exists(self._of(f"{self._folder(f)}/_SUCCESS")))

    def _folder(self, f: tuple[int, int, int]) -> str:
        return f"{self.path}/L{f[0]}-{f[1]:010d}-{f[2]:010d}"

    def live(self) -> list[tuple[int, int, int]]:
        """The folders that readers need: those no folder of a higher level has taken in."""
        all_ = self._folders()
        return [f for f in all_ if not any(g[0] > f[0] and g[1] <= f[1] and f[2] <= g[2] for g in all_)]

    def version(self) -> int:
        """The newest version; -1 for an empty table."""
        return max((f[2] for f in self._folders()), default=-1)

    def _newest(self, folders: list[tuple[int, int, int]]) -> DataFrame:
        rows = self.spark.read.parquet(*map(self._folder, folders))
        others = [c for c in rows.columns if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), VERSION).alias("newest"))
        return newest.select(*self.keys, "newest.*")

    def read(self) -> DataFrame:
        """The newest row of each key; an empty table needs its schema."""
        folders = self.live()
        if not folders:
            if not self.schema:
                raise ValueError(f"{self.path} has no rows yet and no schema was given")
            return self.spark.createDataFrame([], self.schema)
        return self._newest(folders).drop(VERSION)

    def write(self, rows: DataFrame, version: int) -> None:
        """Adds rows (one a key) as a version, then merges what is older."""
        live = self.live()
        for f in set(self._folders()) - set(live):
            self._fs.delete(self._of(self._folder(f)), True)
        rows.withColumn(VERSION, F.lit(version).cast("long")).write.mode("overwrite").parquet(self._folder((0, version, version)))
        level = 0
        while len(done := [f for f in self.live() if f[0] == level and f[2] < version]) >= FAN:
            self._newest(done).write.mode("overwrite").parquet(self._folder((level + 1, done[0][1], done[-1][2])))
            level += 1

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each micro-batch is a version."""
        return lambda df, batch: self.write(df, batch)


def latest_by_key(spark: SparkSession, path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest row of each key."""
    return KeyedTable(spark, path, keys).sink()


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key of latest_by_key's table."""
    return KeyedTable(spark, path, keys).read()
