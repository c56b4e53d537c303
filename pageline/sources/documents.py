"""Sources: characters, line tables, annotations and the trace log, always with explicit schemas; and discovery of what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageline import schemas

PAGE_JSON = "metadata struct<page_num:int,width:double,height:double,modal_font_size:double,char_count:int,line_count:int>, lines array<struct<line_no:int,text:string,corrected_text:string,bbox:array<double>,stream_start:int,stream_end:int>>"


def read_chars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHARS).parquet(path)


def read_raw_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Whole files as bytes, with edition and date of their folders; pages come from whatever parser the caller has."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return raw.select("path", F.element_at(parts, -3).alias("edition"), F.element_at(parts, -2).alias("date"), "length", "modificationTime", "content")


def read_page_json(spark: SparkSession, path: str) -> DataFrame:
    """One document for each page."""
    return spark.read.schema(PAGE_JSON).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)


def page_json_lines(pages: DataFrame) -> DataFrame:
    """Their lines; a missing correction is the text itself, and the box becomes a struct."""
    x = pages.select(F.col("metadata.page_num").alias("page_num"), F.explode("lines").alias("l")).select("page_num", "l.*")
    box = F.struct(*(F.col("bbox")[k].alias(n) for k, n in enumerate(("x0", "top", "x1", "bottom"))))
    return x.withColumn("corrected_text", F.coalesce(F.nullif("corrected_text", F.lit("")), "text")).withColumn("bbox", box)


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Recorded annotations: page_num and the JSON text of each."""
    return spark.read.schema("page_num int, json string").parquet(path)


def read_trace(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``runs``, ``events`` or ``raw``."""
    return spark.read.schema({"runs": schemas.RUNS, "events": schemas.EVENTS, "raw": schemas.RAW}[name]).parquet(f"{path}/{name}")


def read_manifest(spark: SparkSession, path: str, editions: DataFrame) -> DataFrame:
    """``editions`` (edition, date) with their manifests; page_count and pages are null where there is none."""
    found = spark.read.schema("edition string, date string, page_count int, pages array<int>").option("recursiveFileLookup", "true").json(path)
    return editions.join(found, ["edition", "date"], "left")


def read_gold(spark: SparkSession, path: str, schema: str | T.StructType, **keys: str | int) -> DataFrame:
    """Articles of a partitioned table, of some partitions if ``keys`` name them; files that are gone by now are passed over."""
    df = spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(path)
    for name, value in keys.items():
        df = df.filter(F.col(name) == value)
    return df


def page_events(events: DataFrame, run_id: str, page_num: int | None = None) -> DataFrame:
    """The events, or raw exchanges, of a run, or of one of its pages; both tests reach the scan."""
    df = events.filter(F.col("run_id") == run_id)
    return df if page_num is None else df.filter(F.col("page_num") == page_num)


def discover(df: DataFrame) -> DataFrame:
    """Editions and dates that a partitioned table holds."""
    return df.select("edition", "date").distinct().orderBy("edition", "date")


def with_default(df: DataFrame, name: str, kind: str | T.DataType, value: Column) -> DataFrame:
    """``df`` with a column that older files may lack."""
    return df if name in df.columns else df.withColumn(name, value.cast(kind))
