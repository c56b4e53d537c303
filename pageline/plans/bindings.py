"""The engine's operators bound to the generic tables: lines of ``documents``, ``events`` as a stage log, ``lineitem`` as an ordered stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageline.sources.tables import table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no (from 1) and text of every line of every document."""
    split = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    return table(spark, sf_dir, "documents").select("doc_id", split.alias("pos", "text")).select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "text")


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each document as its headline; no need to split the rest."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("headline"))


def page_of(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log: id, run_id, stage, page_num, started_at, duration_s, is_error."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("stage"),
        page_of(F.col("props")).alias("page_num"),
        F.col("ts").alias("started_at"),
        F.col("value").alias("duration_s"),
        (F.col("event_type") == "error").alias("is_error"),
    )


#: The same log in SQL.
EVENTS_SQL = """e AS (SELECT event_id AS id, user_id AS run_id, event_type AS stage, CAST(json_extract_string(props, '$.k') AS BIGINT) AS page_num,
  ts AS started_at, value AS duration_s, event_type = 'error' AS is_error FROM events)"""
LINES_SQL = """l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))"""
HEADS_SQL = "h AS (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10))[1] AS headline FROM documents)"
