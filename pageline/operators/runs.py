"""The view of runs: what kind a run is, its state out of an append-only log, its stages in order, and where it was slow or failed."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageline.operators.scan import running_sum
from pageline.operators.trace import CALL, detail, latest, run_totals

#: What a stage says of its attempts.
ATTEMPTS = "array<struct<attempt:int,elapsed_s:double,error_code:string,error_message:string,sleep_s:double>>"
#: Tokens that fill the width of a page's bar.
BAR_TOKENS = 20_000


def new_run_id() -> str:
    return uuid.uuid4().hex[:16]


def new_job_id() -> str:
    return uuid.uuid4().hex[:12]


def run_label(pdf_hash: Column) -> Column:
    """A run that read a file has its hash; one that worked on what was there has none."""
    return F.when(F.coalesce(pdf_hash, F.lit("")) != "", "Full extract").otherwise("Re-validation")


def run_states(log: DataFrame, events: DataFrame) -> DataFrame:
    """Runs as they stand, from a log of openings and endings (run_id, edition, date, pdf_hash, page_count, at, status) and the events.

    A run that was opened and not closed is running. What an ending adds (end, duration, tokens, share of cached calls) is null until then.
    """
    opened = log.filter("status = 'running'").groupBy("run_id").agg(F.min_by(F.struct("edition", "date", "pdf_hash", "page_count", "at"), "at").alias("o"))
    closed = latest(log.filter("status <> 'running'"), ["run_id"], F.desc("at"), "status").select("run_id", F.col("at").alias("finished_at"), "status")
    out = opened.join(closed, "run_id", "left").join(run_totals(events), "run_id", "left")
    over = F.col("finished_at").isNotNull()
    seconds = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("o.at").cast("timestamp"))) / 1e6
    return out.select(
        "run_id", "o.edition", "o.date", "o.pdf_hash", "o.page_count", F.col("o.at").alias("started_at"), "finished_at",
        F.when(over, seconds).alias("total_wall_clock_s"), F.when(over, F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"), F.when(over, F.col("cache_hit_ratio")).alias("cache_hit_ratio"),
        F.coalesce("status", F.lit("running")).alias("status"),
    )


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id"))


def page_stages(events: DataFrame) -> DataFrame:
    """The stages of each run and page with their place in time; equal times go by id."""
    order = Window.partitionBy("run_id", "page_num").orderBy("started_at", "id")
    return events.withColumn("nth", F.row_number().over(order)).orderBy("run_id", "page_num", "nth")


def attempts(detail_json: Column) -> Column:
    return F.from_json(F.get_json_object(detail_json, "$.attempts"), ATTEMPTS)


def has_diagnostic(error: Column, detail_json: Column) -> Column:
    """Whether a stage has something to tell: an error of its own or of one of its attempts."""
    tried = F.exists(F.coalesce(attempts(detail_json), F.array().cast(ATTEMPTS)), lambda a: F.coalesce(a["error_message"], F.lit("")) != "")
    return (F.coalesce(error, F.lit("")) != "") | tried


def retry_rollup(detail_json: Column) -> dict[str, Column]:
    """Attempts of a call, and the seconds slept between them."""
    tried = F.coalesce(attempts(detail_json), F.array().cast(ATTEMPTS))
    slept = F.aggregate(tried, F.lit(0.0), lambda s, a: s + F.coalesce(a["sleep_s"], F.lit(0.0)))
    return {"attempt_count": F.size(tried), "sleep_total_s": F.round(slept, 3)}


def stage_widths(events: DataFrame) -> DataFrame:
    """The last event of each stage of a page, and its share of the page's time in percent (a page without time counts as 1 s)."""
    total = F.nullif(F.sum("duration_s").over(Window.partitionBy("run_id", "page_num")), F.lit(0.0))
    rows = events.withColumn("_total", F.coalesce(total, F.lit(1.0)))
    last = latest(rows, ["run_id", "page_num", "stage"], F.desc("started_at"), F.desc("id"))
    return last.select("run_id", "page_num", "stage", "id", "duration_s", (F.col("duration_s") / F.col("_total") * 100).alias("width_pct"))


def page_tokens(events: DataFrame, call: str = CALL) -> DataFrame:
    """Of each run and page: prompt, thinking and output tokens of its last call, their sum, the width of its bar and the run's total so far."""
    last = latest(events.filter(F.col("stage") == call), ["run_id", "page_num"], F.desc("started_at"), F.desc("id"))
    said = {"prompt": "prompt_token_count", "thinking": "thoughts_token_count", "output": "candidates_token_count"}
    rows = events.select("run_id", "page_num").distinct().join(last.select("run_id", "page_num", *(detail(v).alias(k) for k, v in said.items())), ["run_id", "page_num"], "left").fillna(0, list(said))
    total = F.col("prompt") + F.col("thinking") + F.col("output")
    rows = rows.withColumn("tokens", total).withColumn("bar_pct", F.least(F.lit(100.0), F.col("tokens") / BAR_TOKENS * 100))
    return running_sum(rows, ["run_id"], [F.asc("page_num")], {"running_total": F.col("tokens")})


def failure_counts(detail_json: Column) -> Column:
    """How many things a validation found wrong: of a ranking (it has ``issues``) its issues and pairs, of a page its four kinds of issue."""
    n = lambda name: F.coalesce(F.json_array_length(F.get_json_object(detail_json, f"$.{name}")), F.lit(0))
    ranking = F.get_json_object(detail_json, "$.issues").isNotNull()
    pages = n("checksum_mismatches") + n("contiguity_issues") + n("overlap_issues") + n("headline_quality_issues")
    return F.when(ranking, n("issues") + n("duplicate_continuations")).otherwise(pages)


def failure_stage(kind: Column) -> Column:
    """Where the second phase failed: errors of the call or the service come from the call, all others from assembly."""
    return F.when(kind.isin("own", "service"), CALL).otherwise("assembly")
