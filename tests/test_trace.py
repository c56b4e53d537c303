import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pageline import schemas
from pageline.config import Config, load_config
from pageline.operators import cachekeys, retention, runs, status, trace

T0 = dt.datetime(2025, 9, 13, 10, 0, 0)


def event(i, run, page, stage, detail="{}", at=T0, error=None):
    return (i, run, page, stage, at, at, 1.0, detail, error)


def test_run_totals(spark):
    e = spark.createDataFrame([event(1, "r", 1, "gemini_call", '{"total_token_count": 7147}'), event(2, "r", 1, "gemini_call", '{"total_token_count": 100, "cache_hit": true}'), event(3, "s", 1, "ranking", '{"total_token_count": 23408}'), event(4, "t", 1, "lines", "broken")], schemas.EVENTS)
    got = {r.run_id: (r.total_tokens, r.cache_hit_ratio) for r in trace.run_totals(e).collect()}
    assert got == {"r": (7247, 0.5), "s": (23408, 0.0), "t": (0, None)}
    q = trace.quota(e, F.lit(T0).cast("timestamp")).first()
    assert (q.requests_today, q.tokens_last_minute) == (2, 7247)


def test_window_keeps_what_is_exactly_as_old(spark):
    e = spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(seconds=60)), (3, T0 + dt.timedelta(seconds=121))], "id int, at timestamp").withColumn("k", F.lit(1))
    assert [r.window_rows for r in trace.sliding(e, ["k"], "at", 60).orderBy("id").collect()] == [1, 2, 1]


def test_errors_and_retries(spark):
    rows = [("service", 503, ""), ("service", 429, "slow"), ("service", 429, "quota exceeded per day"), ("service", 404, ""), ("transport", None, ""), ("own", None, "")]
    df = spark.createDataFrame(rows, "k string, c int, m string")
    assert [r[0] for r in df.select(trace.classify_error(F.col("k"), F.col("c"), F.col("m"))["retryable"]).collect()] == [True, True, False, False, True, False]


def test_page_status_and_failed_pages_differ_on_purpose(spark):
    key = "edition string, date string, page_num int"
    gold, errors = spark.createDataFrame([("e", "d", 1)], key), spark.createDataFrame([("e", "d", 1), ("e", "d", 2)], key)
    live = spark.createDataFrame([("e", "d", 3, "extracting")], key + ", status string")
    manifest = spark.createDataFrame([("e", "d", 4)], "edition string, date string, page_count int")
    kind = "edition string, date string, pages_total int"

    def states(*jobs):
        counts = status.page_counts(manifest, spark.createDataFrame(list(jobs), kind), gold)
        return {r.page_num: r.status for r in status.page_status(counts, gold, errors, live).collect()}

    assert states() == {1: "done", 2: "failed", 3: "pending", 4: "pending"}
    # a live job alone has the word: what lies on disk is not asked, and pages it doesn't have read null
    assert states(("e", "d", 3)) == {1: "pending", 2: "pending", 3: "in_progress"}
    assert states(("e", "d", 0)) == {1: None, 2: None, 3: None, 4: None}
    assert sorted(r.page_num for r in status.failed_pages(errors).collect()) == [1, 2]


def test_cache_keys_and_retention(spark):
    df = spark.createDataFrame([("p", "v")], "a string, b string")
    r = df.select(cachekeys.page_key(F.col("a"), F.col("b")).alias("p"), cachekeys.ranking_key(F.col("a"), F.col("b")).alias("r"), cachekeys.page_key(F.col("a"), F.lit("w")).alias("o")).first()
    assert len(r.p) == 24 and len({r.p, r.r, r.o}) == 3
    files = spark.createDataFrame([("a", T0, 5), ("a", T0 + dt.timedelta(days=2), 6), ("b", T0, 7)], "edition string, modified_at timestamp, size long")
    assert [(r.edition, r.bytes) for r in retention.expired(files, ["edition"], F.lit(T0 + dt.timedelta(days=1))).collect()] == [("b", 7)]
    with pytest.raises(ValueError):
        retention.checked_partition("../x", "2025-09-13")


def test_rows_of_one_stage_are_dealt_over_slices(spark):
    rng = random.Random(3)
    at = sorted(rng.randrange(20_000) for _ in range(900))
    e = spark.createDataFrame([(k, T0 + dt.timedelta(seconds=a), a) for k, a in enumerate(at)], "id int, at timestamp, n int").withColumn("k", F.lit(1))
    got = {r.id: (r.window_rows, r.total) for r in trace.sliding(e, ["k"], "at", 60, slices=3, total=F.col("n")).collect()}
    assert got == {k: (sum(a - 60 <= b <= a for b in at), sum(b for b in at if a - 60 <= b <= a)) for k, a in enumerate(at)}


def test_state_as_it_stood(spark):
    calls = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (1, 30, None), (2, 5, "c")], "k int, t int, v string")
    asked = spark.createDataFrame([(1, 9), (1, 10), (1, 25), (1, 31), (2, 6), (3, 1)], "k int, t int")
    got = trace.as_of(asked, calls, ["k"], ["t"], F.struct("v"), "s")
    assert {(r.k, r.t): r.s and r.s.v for r in got.collect()} == {(1, 9): None, (1, 10): "a", (1, 25): "b", (1, 31): None, (2, 6): "c", (3, 1): None}


def test_the_ladder_as_a_table(spark):
    assert [tuple(r) for r in trace.retry_ladder(spark).orderBy("attempt").collect()] == [(1, 4.0, 2.0, 6.0), (2, 8.0, 4.0, 12.0), (3, 16.0, 8.0, 24.0)]


def test_runs_open_and_close_in_the_log(spark):
    kind = "run_id string, edition string, date string, pdf_hash string, page_count int, at timestamp, status string"
    later = T0 + dt.timedelta(seconds=90)
    log = spark.createDataFrame([("r", "e", "d", "h", 2, T0, "running"), ("s", "e", "d", None, 1, later, "running"), ("r", "e", "d", "h", 2, later, "done")], kind)
    e = spark.createDataFrame([event(1, "r", 1, "gemini_call", '{"total_token_count": 70}'), event(2, "s", 1, "gemini_call", '{"total_token_count": 5}')], schemas.EVENTS)
    got = runs.newest_first(runs.run_states(log, e)).collect()
    assert [(r.run_id, r.status, r.total_wall_clock_s, r.total_tokens) for r in got] == [("s", "running", None, None), ("r", "done", 90.0, 70)]
    assert len(runs.new_run_id()) == 16 and len(runs.new_job_id()) == 12 and runs.new_run_id() != runs.new_run_id()


def test_an_edition_is_deleted_from_all_roots(spark, tmp_path):
    for root, size in (("raw", 5), ("bronze", 7), ("cache", 9)):
        for date in ("d1", "d2"):
            folder = tmp_path / root / "chennai" / date
            folder.mkdir(parents=True)
            (folder / "x.bin").write_bytes(b"x" * size)
    roots = {k: str(tmp_path / k) for k in ("raw", "bronze")}
    files = retention.edition_files(spark, roots)
    assert sorted(tuple(r) for r in files.select("root", "edition", "date", "size").collect()) == [(r, "chennai", d, n) for r, n in (("bronze", 7), ("raw", 5)) for d in ("d1", "d2")]
    assert sorted(tuple(r) for r in retention.editions_anywhere(files).collect()) == [("chennai", "d1"), ("chennai", "d2")]
    assert retention.delete_edition(spark, roots, "chennai", "d1") == 12
    assert not (tmp_path / "raw/chennai/d1").exists() and (tmp_path / "raw/chennai/d2").exists() and (tmp_path / "cache/chennai/d1").exists()
    assert retention.delete_edition(spark, roots, "nowhere", "d1") == 0
    with pytest.raises(ValueError):
        retention.delete_edition(spark, roots, "..", "d1")


def test_config(monkeypatch):
    monkeypatch.setenv("PAGELINE_TOP_N", "5")
    assert load_config(values={"outlier_ratio": 2}).top_n == 5
    with pytest.raises(ValueError):
        load_config(values={"what": 1})
