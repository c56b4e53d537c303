"""Tables in between, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where none is set, a local session gets one of its own (driver and
    executors are one process there); on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named and spark.sparkContext.master.startswith("local"):
        named = tempfile.mkdtemp(prefix="pageline-")
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, what: str, codec: str = "zstd", partition_by: str | None = None) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder, read back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    out = df.write.option("compression", codec)
    if partition_by:
        out = out.partitionBy(partition_by)
    out.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def reading(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, marked as one that reads ``tables``: who has written its rows elsewhere may ``forget`` it, and these with it."""
    df._reads = tables
    return df


def forget(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made, and those that a DataFrame is marked to read, once nothing that is still to be read comes
    from them. Others are left alone."""
    for df in [t for own in tables for t in (own, *getattr(own, "_reads", ()))]:
        path = getattr(df, "_written_to", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
