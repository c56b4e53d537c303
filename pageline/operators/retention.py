"""What is old enough to go, and deletion that can't leave its folder."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESERVED = ("gemini", "ranking")
_SAFE = re.compile(r"[A-Za-z0-9_-]+")


def last_touched(files: DataFrame, keys: list[str]) -> DataFrame:
    return files.groupBy(*keys).agg(F.max("modified_at").alias("last_touched"), F.sum("size").alias("bytes"))


def expired(files: DataFrame, keys: list[str], cutoff: Column) -> DataFrame:
    """Editions last touched before ``cutoff`` (not at it)."""
    return last_touched(files, keys).filter(F.col("last_touched") < cutoff)


def expired_caches(files: DataFrame, cutoff: Column, name: str = "cache") -> DataFrame:
    """Caches as old, but for those that are kept."""
    return expired(files.filter(~F.col(name).isin(*RESERVED)), [name], cutoff)


def checked_partition(edition: str, date: str) -> tuple[str, str]:
    """Both values, if neither can lead out of its folder; this comes before any look at what exists."""
    for value in (edition, date):
        if not _SAFE.fullmatch(value):
            raise ValueError(f"not a partition value: {value!r}")
    return edition, date


def without_edition(df: DataFrame, edition: str, date: str) -> DataFrame:
    """A table without an edition's rows."""
    edition, date = checked_partition(edition, date)
    return df.filter(~((F.col("edition") == edition) & (F.col("date") == date)))


def edition_files(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """root, edition, date, size and modified_at of every file below ``roots`` (name: path), laid out as edition and date folders, plain or
    as key=value. Only names and sizes are read."""
    out = None
    for name, path in roots.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
        inner = F.split(F.element_at(F.split("path", F.lit(re.escape(path.rstrip("/").split("/")[-1]) + "/"), 2), -1), "/")
        value = lambda k: F.regexp_replace(F.try_element_at(inner, F.lit(k)), "^[a-z_]+=", "")
        rows = files.select(F.lit(name).alias("root"), value(1).alias("edition"), value(2).alias("date"), "size", "modified_at").filter(F.size(inner) > 2)
        out = rows if out is None else out.unionByName(rows)
    return out


def editions_anywhere(files: DataFrame) -> DataFrame:
    """The editions that any root holds, whatever the others hold."""
    return files.select("edition", "date").distinct()


def bytes_freed(files: DataFrame, gone: DataFrame) -> DataFrame:
    """Of each edition that goes: the bytes of its files in all roots, 0 where there are none."""
    key = ["edition", "date"]
    size = files.groupBy(*key).agg(F.sum("size").alias("bytes_freed"))
    return gone.select(*key).distinct().join(size, key, "left").fillna(0, ["bytes_freed"])


def delete_edition(spark: SparkSession, roots: dict[str, str], edition: str, date: str) -> int:
    """Removes an edition's folders below all roots and says how many bytes they held. Names are checked before anything is looked at;
    caches are no root, so they stay."""
    edition, date = checked_partition(edition, date)
    jvm, conf, freed = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for root in roots.values():
        for inner in (f"{edition}/{date}", f"edition={edition}/date={date}"):
            path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{inner}")
            fs = path.getFileSystem(conf)
            if fs.exists(path):
                freed += fs.getContentSummary(path).getLength()
                fs.delete(path, True)
    return freed
