"""A keyed table kept as a log of batches and snapshots: written exactly once, read as an upsert would have left it.

``log/batch=N`` holds what batch N brought. Writing a batch again replaces its own folder, so a replay changes nothing; one that a snapshot
holds already is left out. ``snapshots/upto=N`` holds the last row of each key after batch N. A folder counts once Spark has committed it
(``_SUCCESS``), so readers never see half a batch. Compaction writes the next snapshot and then removes what it stands for; a reader needs
one snapshot and the few batches behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedLog:
    """Rows of ``schema`` under ``path`` (any store that Spark writes to); of each of ``keys`` the row with the highest ``order`` stands.

    Rows with equal keys and order are ordered by all their other columns, so that the table is the same however batches are cut.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: str):
        self.spark, self.path, self.schema, self.keys, self.order = spark, path.rstrip("/"), schema, list(keys), order

    def _committed(self, kind: str, name: str) -> list[int]:
        """The numbers of the committed folders of a kind."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        found = [x.getPath() for x in fs.listStatus(where) if x.getPath().getName().startswith(f"{name}=")]
        return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _remove(self, folder: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def upto(self) -> int:
        """The last batch that a snapshot holds; -1 for none."""
        return max(self._committed("snapshots", "upto"), default=-1)

    def write(self, rows: DataFrame, batch: int) -> None:
        """Batch number ``batch`` (0 and up), whether it was written before or not."""
        if batch > self.upto():
            rows.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")

    def _latest(self, rows: DataFrame) -> DataFrame:
        columns = rows.columns
        rest = [c for c in columns if c not in (*self.keys, self.order)]
        last = rows.groupBy(*self.keys).agg(F.max(F.struct(self.order, *rest)).alias("_last"))
        return last.select(*(c if c in self.keys else F.col(f"_last.{c}").alias(c) for c in columns))

    def current(self) -> DataFrame:
        """The table as it stands."""
        upto = self.upto()
        parts = [f"snapshots/upto={upto}"] * (upto >= 0) + [f"log/batch={n}" for n in self._committed("log", "batch") if n > upto]
        return self._latest(self._read(parts))

    def compact(self) -> None:
        """Makes all committed batches a snapshot, if there are any. Ended half-way, it may be run again."""
        batches = self._committed("log", "batch")
        upto = self.upto()
        if batches and batches[-1] > upto:
            self.current().write.mode("overwrite").parquet(f"{self.path}/snapshots/upto={batches[-1]}")
            upto = batches[-1]
        for n in batches:
            if n <= upto:
                self._remove(f"log/batch={n}")
        for n in self._committed("snapshots", "upto"):
            if n < upto:
                self._remove(f"snapshots/upto={n}")
