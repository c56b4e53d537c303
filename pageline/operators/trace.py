"""Runs, stage events and quotas as queries over an append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageline.operators.scan import before

CALLS = ("gemini_call", "ranking")
CALL = CALLS[0]


def detail(name: str, kind: str = "long") -> Column:
    """A value of an event's free-form detail; null where it is missing or malformed."""
    return F.expr(f"try_cast(get_json_object(detail_json, '$.{name}') as {kind})")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key: the state of something that is only appended to."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def run_totals(events: DataFrame, calls: tuple[str, ...] = CALLS) -> DataFrame:
    """Of each run: tokens (cached calls count), and the share of calls answered from a cache, null without calls."""
    call = F.col("stage").isin(*calls)
    hit = F.when(call, F.coalesce(detail("cache_hit", "boolean"), F.lit(False)).cast("double"))
    return events.groupBy("run_id").agg(F.sum(F.when(call, F.coalesce(detail("total_token_count"), F.lit(0))).otherwise(0)).alias("total_tokens"), F.avg(hit).alias("cache_hit_ratio"))


def quota(events: DataFrame, now: Column | DataFrame, call: str = CALL, seconds: int = 60) -> DataFrame:
    """Calls since midnight (UTC) and tokens within the last ``seconds``, cached ones included. ``now`` may be a table of one value."""
    calls = events.filter(F.col("stage") == call)
    if isinstance(now, DataFrame):
        calls, now = calls.join(F.broadcast(now.toDF("_now"))), F.col("_now")  # one row
    recent = F.col("started_at") >= now - F.make_interval(secs=F.lit(seconds))
    return calls.agg(
        F.count_if(F.col("started_at") >= F.date_trunc("day", now)).alias("requests_today"),
        F.coalesce(F.sum(F.when(recent, F.coalesce(detail("total_token_count"), F.lit(0)))), F.lit(0)).alias("tokens_last_minute"),
    )


def sliding(df: DataFrame, keys: list[str], ts: str, seconds: int, slices: int = 60, **sums: Column) -> DataFrame:
    """Each row with the count and sums of the rows of its key in the ``seconds`` up to it, the limits included.

    Time is cut into slices of ``slices`` x ``seconds``. A row stands in its own slice, and one of the last ``seconds`` of a slice once
    more in the next, as a shadow that is only counted there. So the rows of a key are dealt over as many tasks as there are slices.
    """
    step, reach = seconds * slices * 1_000_000, seconds * 1_000_000
    rows = df.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumns({f"_v_{k}": c for k, c in sums.items()})
    own = F.floor(F.col("_at") / step)
    last = F.floor((F.col("_at") + reach) / step)
    rows = rows.withColumn("_slice", F.explode(F.when(last > own, F.array(own, last)).otherwise(F.array(own)))).withColumn("_own", F.col("_slice") == own)
    w = Window.partitionBy(*keys, "_slice").orderBy("_at").rangeBetween(-reach, 0)
    out = rows.withColumns({"window_rows": F.count("*").over(w)} | {k: F.sum(f"_v_{k}").over(w) for k in sums}).filter("_own")
    return out.drop("_at", "_slice", "_own", *(f"_v_{k}" for k in sums))


def last_before(df: DataFrame, keys: list[str], value: str, order: str, default: int = 1) -> DataFrame:
    """The value of the last event of each key; 0 and null count as ``default``."""
    return df.groupBy(*keys).agg(F.coalesce(F.nullif(F.max_by(value, order), F.lit(0)), F.lit(default)).alias(value))


def as_of(rows: DataFrame, states: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Each of ``rows`` with ``value`` of the last of ``states`` of its key before it, in ``order``, or null: one union and the last known
    value, no join of times. At equal places states come first."""
    told = states.select(*keys, *order, value.alias(name), F.lit(0).alias("_of"))
    both = rows.withColumn("_of", F.lit(1)).unionByName(told, allowMissingColumns=True)
    return before(both, keys, [*(F.asc(c) for c in order), F.asc("_of")], F.col(name), "_known").filter("_of = 1").withColumn(name, F.col("_known")).drop("_known", "_of")


def retry_ladder(spark: SparkSession, attempts: int = 4, base: float = 4.0, factor: float = 2.0, most: float = 30.0, jitter: float = 0.5) -> DataFrame:
    """After each failed attempt but the last: nominal sleep, and the least and most that jitter makes of it."""
    n = spark.range(1, attempts).select(F.col("id").cast("int").alias("attempt"))
    nominal = F.least(F.lit(base) * F.pow(F.lit(factor), F.col("attempt") - 1), F.lit(most))
    return n.select("attempt", nominal.alias("nominal_s"), (nominal * (1 - jitter)).alias("least_s"), (nominal * (1 + jitter)).alias("most_s"))


def classify_error(kind: Column, code: Column, message: Column) -> dict[str, Column]:
    """Of an error: its own kind, service code and message. Own errors and client errors are final, 429 and the rest can be tried again."""
    low = F.lower(F.coalesce(message, F.lit("")))
    daily = low.contains("day") & (low.contains("quota") | low.contains("exceeded") | low.contains("resource_exhausted"))
    again = F.when(kind == "own", False).when(code == 429, ~daily).when(code >= 500, True).when(code >= 400, False).otherwise(kind == "transport")
    return {"is_429": F.coalesce(code == 429, F.lit(False)), "daily_quota": F.coalesce(code == 429, F.lit(False)) & daily, "retryable": F.coalesce(again, F.lit(False))}


def delete_runs(runs: DataFrame, events: DataFrame, raw: DataFrame, edition: str, date: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without an edition's runs; what belongs to these goes with them."""
    gone = runs.filter((F.col("edition") == edition) & (F.col("date") == date)).select("run_id")
    return tuple(df.join(gone, "run_id", "left_anti") for df in (runs, events, raw))
