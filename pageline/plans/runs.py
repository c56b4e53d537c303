"""Named queries that run the operators of runs, jobs, editions and rankings, each with the SQL that says the same.

``events`` is the log of stages: a run is a user, its stages the event types, a page the number in ``props``. What a stage says of itself
(detail) follows fixed rules of the event's number. ``documents`` are the candidates of a ranking: an edition is a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageline.config import Config
from pageline.functions.text import page_list as parse_pages
from pageline.operators import lifecycle, masthead, ranking, retention, runs, status, trace, views
from pageline.plans.bindings import EVENTS_SQL, HEADS_SQL, events, first_lines
from pageline.plans.register import Registry
from pageline.sources.tables import table

registry = Registry()
query = registry.query

# Runs ------------------------------------------------------------------------------------------------------------------

_STAGE = {"click": "gemini_call", "view": "char_extraction", "purchase": "assembly", "signup": "validation", "error": "ranking"}
_STAGE_SQL = "CASE stage " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STAGE.items()) + " ELSE stage END"


def stage_events(spark: SparkSession, d: str) -> DataFrame:
    """The log with named stages, an error on every 23rd event, and a detail with tokens, and attempts on every 5th."""
    stage = F.col("stage")
    for k, v in _STAGE.items():
        stage = F.when(F.col("stage") == k, v).otherwise(stage)
    i = F.col("id")
    tried = F.array(
        F.struct(F.lit(1).alias("attempt"), F.when(i % 10 == 0, "503").alias("error_code"), F.when(i % 10 == 0, "try again").alias("error_message"), F.lit(1.25).alias("sleep_s")),
        F.struct(F.lit(2).alias("attempt"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"), F.lit(0.5).alias("sleep_s")),
    )
    said = F.struct((i % 700).alias("prompt_token_count"), (i % 90).alias("thoughts_token_count"), (i % 50).alias("candidates_token_count"), F.when(i % 5 == 0, tried).alias("attempts"))
    return events(spark, d).withColumns({"stage": stage, "error": F.when(i % 23 == 0, "broken"), "detail_json": F.to_json(said)})


_EV = f"{EVENTS_SQL}, v AS (SELECT *, {_STAGE_SQL} AS st FROM e)"


@query(f"WITH {_EV} SELECT id, id % 23 = 0 OR id % 10 = 0 AS diagnostic, CASE WHEN id % 5 = 0 THEN 2 ELSE 0 END AS attempt_count, CASE WHEN id % 5 = 0 THEN 1.75 ELSE 0.0 END AS sleep_total_s FROM v")
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """PF22, AG18: which stages have something to tell, and what retries cost."""
    e = stage_events(spark, d)
    return e.select("id", runs.has_diagnostic(F.col("error"), F.col("detail_json")).alias("diagnostic"), *(c.alias(k) for k, c in runs.retry_rollup(F.col("detail_json")).items()))


@query(
    f"""WITH {_EV}, t AS (SELECT run_id, page_num, coalesce(nullif(sum(duration_s), 0), 1) AS total FROM v GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY run_id, page_num, st ORDER BY started_at DESC, id DESC) AS k FROM v)
    SELECT run_id, page_num, st AS stage, id, round(duration_s / total * 100, 6) AS width_pct FROM x JOIN t USING (run_id, page_num) WHERE k = 1"""
)
def stage_widths(spark: SparkSession, d: str) -> DataFrame:
    """AG22, AG23: the share of a page's time that its stages took."""
    return runs.stage_widths(stage_events(spark, d)).select("run_id", "page_num", "stage", "id", F.round("width_pct", 6).alias("width_pct"))


@query(
    f"""WITH {_EV}, x AS (SELECT *, row_number() OVER (PARTITION BY run_id, page_num ORDER BY started_at DESC, id DESC) AS k FROM v WHERE st = 'gemini_call'), p AS (SELECT DISTINCT run_id, page_num FROM v),
    y AS (SELECT p.run_id, p.page_num, coalesce(id % 700, 0) AS prompt, coalesce(id % 90, 0) AS thinking, coalesce(id % 50, 0) AS output FROM p LEFT JOIN x ON x.run_id = p.run_id AND x.page_num IS NOT DISTINCT FROM p.page_num AND k = 1)
    SELECT *, prompt + thinking + output AS tokens, round(least(100, (prompt + thinking + output) / 20000 * 100), 6) AS bar_pct, CAST(sum(prompt + thinking + output) OVER (PARTITION BY run_id ORDER BY page_num ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_total FROM y"""
)
def page_tokens(spark: SparkSession, d: str) -> DataFrame:
    """AG22, WN9: tokens of each page's last call, and the run's total so far."""
    return runs.page_tokens(stage_events(spark, d)).withColumn("bar_pct", F.round("bar_pct", 6))


@query(f"WITH {_EV} SELECT id, CAST(row_number() OVER (PARTITION BY run_id, page_num ORDER BY started_at, id) AS INTEGER) AS nth, CASE WHEN st IN ('char_extraction') THEN 'extracting' WHEN st IN ('gemini_call', 'validation', 'assembly') THEN 'grouping' END AS page_state FROM v")
def stage_order(spark: SparkSession, d: str) -> DataFrame:
    """SL2, PF20: the stages of a page in time, and what the page does meanwhile."""
    return runs.page_stages(stage_events(spark, d)).select("id", "nth", status.stage_status(F.col("stage")).alias("page_state"))


@query(
    f"""WITH {_EV}, o AS (SELECT run_id, min(started_at) AS a, max(started_at) AS z, count(*) AS n FROM v GROUP BY 1), c AS (SELECT run_id, avg(0.0) AS hit, sum(0) AS tokens FROM v WHERE st IN ('gemini_call', 'ranking') GROUP BY 1)
    SELECT o.run_id, 'u' || run_id % 7 AS edition, CASE WHEN run_id % 2 = 0 THEN 'Full extract' ELSE 'Re-validation' END AS kind, CASE WHEN run_id % 3 = 0 THEN 'running' WHEN run_id % 3 = 1 THEN 'done' ELSE 'failed' END AS status,
    CASE WHEN run_id % 3 <> 0 THEN round(epoch_us(z) / 1e6 - epoch_us(a) / 1e6, 3) END AS seconds, CASE WHEN run_id % 3 <> 0 THEN coalesce(CAST(tokens AS BIGINT), 0) END AS total_tokens, CASE WHEN run_id % 3 <> 0 THEN hit END AS cache_hit_ratio FROM o LEFT JOIN c USING (run_id)"""
)
def run_view(spark: SparkSession, d: str) -> DataFrame:
    """SK6, SL1, PF19, AG7: runs out of a log of openings and endings, the newest first."""
    e = stage_events(spark, d)
    ends = e.groupBy("run_id").agg(F.min("started_at").alias("a"), F.max("started_at").alias("z"), F.count("*").alias("n"))
    k = F.col("run_id")
    about = ends.select("run_id", F.concat(F.lit("u"), k % 7).alias("edition"), F.lit("d").alias("date"), F.when(k % 2 == 0, "f00d").alias("pdf_hash"), F.col("n").cast("int").alias("page_count"), "a", "z")
    log = about.select(*about.columns[:5], F.col("a").alias("at"), F.lit("running").alias("status"))
    log = log.unionByName(about.filter("run_id % 3 <> 0").select(*about.columns[:5], F.col("z").alias("at"), F.when(k % 3 == 1, "done").otherwise("failed").alias("status")))
    out = runs.newest_first(runs.run_states(log, e))
    return out.select("run_id", "edition", runs.run_label(F.col("pdf_hash")).alias("kind"), "status", F.round("total_wall_clock_s", 3).alias("seconds"), "total_tokens", "cache_hit_ratio")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS failures, CASE event_id % 4 WHEN 0 THEN 'gemini_call' WHEN 1 THEN 'gemini_call' ELSE 'assembly' END AS stage FROM events""")
def failure_summary(spark: SparkSession, d: str) -> DataFrame:
    """AG22, PF18: how much a validation found wrong, and where an error of the second phase comes from."""
    i = F.col("event_id")
    found = F.when(i % 3 == 0, F.array(F.lit("x"), F.lit("y")))
    more = F.when(i % 4 == 0, F.array(F.lit("z")))
    page = F.to_json(F.struct(found.alias("checksum_mismatches"), more.alias("overlap_issues")))
    ranked = F.to_json(F.struct(F.coalesce(found, F.array().cast("array<string>")).alias("issues"), more.alias("duplicate_continuations")))
    kind = F.when(i % 4 == 0, "own").when(i % 4 == 1, "service").when(i % 4 == 2, "transport").otherwise("other")
    return table(spark, d, "events").select("event_id", runs.failure_counts(F.when(i % 2 == 0, ranked).otherwise(page)).alias("failures"), runs.failure_stage(kind).alias("stage"))


# Jobs and editions -----------------------------------------------------------------------------------------------------

_JOBS_SQL = f"""{EVENTS_SQL}, p AS (SELECT run_id, page_num, bool_or(is_error) AS failed, bool_or(stage = 'purchase') AS done, bool_or(stage = 'click') AS busy, sum(id % 4) AS found FROM e GROUP BY ALL),
s AS (SELECT *, CASE WHEN failed THEN 'failed' WHEN done THEN 'done' WHEN busy THEN 'grouping' ELSE 'pending' END AS st FROM p)"""


def job_pages(spark: SparkSession, d: str) -> DataFrame:
    p = events(spark, d).groupBy(F.col("run_id").alias("job_id"), "page_num").agg(
        F.bool_or("is_error").alias("failed"), F.bool_or(F.col("stage") == "purchase").alias("done"), F.bool_or(F.col("stage") == "click").alias("busy"), F.sum(F.col("id") % 4).alias("articles_found")
    )
    state = F.when(F.col("failed"), "failed").when(F.col("done"), "done").when(F.col("busy"), "grouping").otherwise("pending")
    return p.select("job_id", "page_num", state.alias("status"), "articles_found", (F.col("page_num") % 9 != 1).alias("validation_ok"), F.lit(False).alias("cached"))


@query(
    f"""WITH {_JOBS_SQL} SELECT run_id AS job_id, CAST(sum(found) AS BIGINT) AS articles_found, CAST(count_if(st = 'grouping') AS INTEGER) AS in_flight, CAST(count_if(st = 'failed') AS INTEGER) AS failed,
    CAST(count_if(st = 'failed' OR page_num % 9 = 1) AS INTEGER) AS failures FROM s GROUP BY 1"""
)
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    """AG24: sums and subsets of a job's pages."""
    out = status.job_progress(job_pages(spark, d))
    return out.select("job_id", "articles_found", *(F.size(c).alias(c) for c in ("in_flight", "failed", "failures")))


@query(
    f"""WITH {_JOBS_SQL}, j AS (SELECT run_id, count_if(st IN ('done', 'failed')) AS k, count(*) AS n, bool_or(st = 'failed') AS f FROM s GROUP BY 1), q AS (SELECT -1 - c_custkey AS job_id FROM customer WHERE c_custkey % 10 = 0)
    SELECT run_id AS job_id, CASE WHEN run_id % 11 = 0 THEN 'failed' WHEN k < n THEN 'running' WHEN f THEN 'completed_with_errors' ELSE 'done' END AS status, k AS pages_done, n AS pages_total,
      CASE WHEN run_id % 11 <> 0 AND k < n AND k > 0 THEN round(120.0 / k * (n - k), 6) END AS eta_s FROM j UNION ALL SELECT job_id, 'queued', 0, 0, NULL FROM q"""
)
def job_states(spark: SparkSession, d: str) -> DataFrame:
    """SR5, AG13, AG21: jobs from queued to done or failed, and what is left of those that run."""
    pages = job_pages(spark, d)
    known = pages.select("job_id").distinct().select("job_id", F.lit(True).alias("started"), F.when(F.col("job_id") % 11 == 0, "no such file").alias("error"))
    queued = table(spark, d, "customer").filter("c_custkey % 10 = 0").select((-1 - F.col("c_custkey")).alias("job_id"), F.lit(False).alias("started"), F.lit(None).cast("string").alias("error"))
    out = status.job_state(pages, known.unionByName(queued))
    eta = status.eta_seconds(F.lit(120.0), F.col("pages_done"), F.col("pages_total"), F.col("status") == "running")
    return out.select("job_id", "status", "pages_done", "pages_total", F.round(eta, 6).alias("eta_s"))


@query(
    """WITH j AS (SELECT o_custkey % 50 AS edition, o_orderkey AS ord, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'queued' ELSE 'done' END AS status FROM orders) SELECT 'e' || edition AS edition, max(ord) AS job_id, arg_max(status, ord) AS status FROM j WHERE status <> 'done' GROUP BY edition"""
)
def active_jobs(spark: SparkSession, d: str) -> DataFrame:
    """SR7: of each edition its last live job."""
    state = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "queued").otherwise("done")
    jobs = table(spark, d, "orders").select(F.concat(F.lit("e"), F.col("o_custkey") % 50).alias("edition"), F.lit("d").alias("date"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("job_id"), state.alias("status"))
    return status.active_by_edition(jobs).select("edition", "job_id", "status")


def _edition_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each line item as a page of an edition (supplier) with its number: done with articles, failed, or neither."""
    x = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("edition"), F.lit("d").alias("date"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 40 + 1).cast("int").alias("page_num"), "l_returnflag", "l_suppkey", "l_quantity")
    return x


_PAGES_SQL = """x AS (SELECT 's' || l_suppkey AS edition, l_suppkey AS k, CAST((l_orderkey + l_linenumber) % 40 + 1 AS INTEGER) AS page_num, l_returnflag AS f FROM lineitem),
g AS (SELECT edition, k, page_num, count(*) AS n FROM x WHERE f = 'N' GROUP BY ALL), z AS (SELECT DISTINCT edition, page_num FROM x WHERE f = 'A'), er AS (SELECT DISTINCT edition, page_num FROM x WHERE f = 'R'), ed AS (SELECT DISTINCT edition, k FROM x)"""


@query(
    f"""WITH {_PAGES_SQL}, lv AS (SELECT edition, k, CASE WHEN k % 5 = 0 THEN 30 WHEN k % 5 = 1 THEN 0 END AS lp FROM ed), c AS (SELECT edition, k, lp, CASE WHEN lp > 0 THEN lp WHEN k % 5 <> 2 THEN 35 ELSE (SELECT count(DISTINCT page_num) FROM (SELECT edition, page_num FROM g UNION SELECT edition, page_num FROM z) q WHERE q.edition = lv.edition) END AS n FROM lv),
    p AS (SELECT edition, k, lp, CAST(unnest(range(1, n + 1)) AS INTEGER) AS page_num FROM c WHERE n > 0)
    SELECT p.edition, p.page_num, CASE WHEN lp IS NOT NULL THEN CASE WHEN p.page_num <= lp THEN CASE WHEN p.page_num % 4 = 1 THEN 'in_progress' WHEN p.page_num % 4 = 2 THEN 'failed' ELSE 'pending' END END
      WHEN g.n IS NOT NULL OR z.edition IS NOT NULL THEN 'done' WHEN er.edition IS NOT NULL THEN 'failed' ELSE 'pending' END AS status
    FROM p LEFT JOIN g USING (edition, page_num) LEFT JOIN z USING (edition, page_num) LEFT JOIN er USING (edition, page_num)"""
)
def live_page_status(spark: SparkSession, d: str) -> DataFrame:
    """PF12, PF13, JN15: the state of every page where some editions have a live job: what lies on disk says nothing of these."""
    x = _edition_pages(spark, d)
    gold, errors = x.filter("l_returnflag in ('N', 'A')"), x.filter("l_returnflag = 'R'")
    eds = x.select("edition", "date", "l_suppkey").distinct()
    jobs = eds.filter("l_suppkey % 5 in (0, 1)").select("edition", "date", F.when(F.col("l_suppkey") % 5 == 0, 30).otherwise(0).alias("pages_total"))
    made = eds.filter("l_suppkey % 5 <> 2").select("edition", "date", F.lit(35).alias("page_count"))
    said = F.when(F.col("page_num") % 4 == 1, "grouping").when(F.col("page_num") % 4 == 2, "failed")
    live = jobs.filter("pages_total > 0").withColumn("page_num", F.explode(F.sequence(F.lit(1), F.col("pages_total")))).withColumn("status", said).filter("status is not null")
    return status.page_status(status.page_counts(made, jobs, gold), gold, errors, live).select("edition", "page_num", "status")


@query(
    f"""WITH {_PAGES_SQL}, pg AS (SELECT edition, page_num FROM g UNION SELECT edition, page_num FROM z), a AS (SELECT pg.edition, pg.page_num, coalesce(n, 0) AS n FROM pg LEFT JOIN g USING (edition, page_num))
    SELECT edition, CAST(sum(n) AS BIGINT) AS article_count, CAST(count_if(n > 0) AS BIGINT) AS pages_with_articles, coalesce(string_agg(page_num, ',' ORDER BY page_num) FILTER (n = 0), '') AS pages_with_zero_articles, 35 AS pages FROM a GROUP BY 1"""
)
def edition_details(spark: SparkSession, d: str) -> DataFrame:
    """AG11: articles of each edition, and its pages with and without any."""
    x = _edition_pages(spark, d)
    gold, done = x.filter("l_returnflag = 'N'"), x.filter("l_returnflag in ('N', 'A')")
    counts = x.select("edition", "date").distinct().withColumn("page_count", F.lit(35))
    states = status.page_status(counts, done, x.filter("l_returnflag = 'R'"), x.limit(0).select("edition", "date", "page_num", F.lit("").alias("status")))
    out = status.edition_detail(counts, status.article_counts(done, gold), states)
    zero = F.array_join(F.transform("pages_with_zero_articles", lambda p: p.cast("string")), ",")
    return out.filter("article_count > 0 or pages_with_articles > 0 or size(pages_with_zero_articles) > 0").select("edition", "article_count", "pages_with_articles", zero.alias("pages_with_zero_articles"), F.size("pages").alias("pages"))


@query("SELECT 'ok' AS status, count(*) > 0 AS has_editions FROM region")
def health(spark: SparkSession, d: str) -> DataFrame:
    return status.health(table(spark, d, "region"))


@query("SELECT doc_id, 'done' AS status, 1 AS article_count, doc_id % 3 = 0 AS validation_ok, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS width, CASE WHEN doc_id % 2 = 0 THEN 7 END AS line_count FROM documents")
def page_views(spark: SparkSession, d: str) -> DataFrame:
    """JN17: pages that are done with the measures of their source, where it is there."""
    docs = table(spark, d, "documents")
    done = docs.select("doc_id", F.lit(1).alias("articles"), (F.col("doc_id") % 3 == 0).alias("validation_ok"), F.lit(1.0).alias("coverage_ratio"))
    about = docs.filter("doc_id % 2 = 0").select("doc_id", F.col("n_chars").alias("width"), F.lit(1).alias("height"), F.lit(7).alias("line_count"))
    return views.page_view(done, about, ["doc_id"]).drop("coverage_ratio", "height")


@query("SELECT o_custkey AS edition, o_orderdate::VARCHAR AS date FROM orders WHERE o_orderkey % 3 <> 0 UNION SELECT c_custkey, '1990-01-01 00:00:00' FROM customer WHERE c_custkey % 7 = 0")
def editions_anywhere(spark: SparkSession, d: str) -> DataFrame:
    """SO3: editions that any of three roots holds."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("edition"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"), "o_orderkey")
    roots = [o.filter("o_orderkey % 3 = 1"), o.filter("o_orderkey % 3 = 2"), table(spark, d, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("edition"), F.lit("1990-01-01 00:00:00").alias("date"))]
    files = roots[0].select("edition", "date")
    for r in roots[1:]:
        files = files.unionByName(r.select("edition", "date"))
    return retention.editions_anywhere(files)


@query("SELECT c_custkey AS edition, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS bytes_freed FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 3 = 0 GROUP BY 1")
def bytes_freed(spark: SparkSession, d: str) -> DataFrame:
    """SK9, AG19: the bytes that editions hold which are deleted."""
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("edition"), F.lit("d").alias("date"), F.col("o_orderkey").alias("size"))
    gone = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("edition"), F.lit("d").alias("date"))
    return retention.bytes_freed(files, gone).select("edition", "bytes_freed")


@query("SELECT o_orderkey, o_totalprice + 1 AS price, 'right' AS side FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT o_orderkey, o_totalprice, 'left' FROM orders WHERE o_orderkey % 100 = 0")
def regression(spark: SparkSession, d: str) -> DataFrame:
    """SO5: what tells a table from its baseline."""
    a = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    b = a.withColumn("price", F.when(F.col("o_orderkey") % 100 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return lifecycle.same_set(a, b)


@query("SELECT o_orderkey, array_to_string(list_concat(range(1, CAST(o_orderkey % 4 + 2 AS BIGINT)), [9], range(CAST(o_custkey % 5 AS BIGINT), CAST(o_custkey % 5 + 3 AS BIGINT))), ' ') AS pages FROM orders")
def page_list(spark: SparkSession, d: str) -> DataFrame:
    """PF14: lists of pages, made of every order, as numbers."""
    o, c = F.col("o_orderkey") % 4 + 1, F.col("o_custkey") % 5
    said = F.concat(F.lit("1-"), o.cast("string"), F.lit(", 9,"), c.cast("string"), F.lit("-"), (c + 2).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(parse_pages(said), lambda p: p.cast("string")), " ").alias("pages"))


# Rankings --------------------------------------------------------------------------------------------------------------

CONFIG = Config(top_n=30, most_excluded=5)
EDITION = ["edition"]


def candidates(spark: SparkSession, d: str) -> DataFrame:
    h = first_lines(spark, d)
    k = F.col("doc_id")
    return h.select(
        F.col("source").alias("edition"), F.concat(F.lit("p"), k.cast("string")).alias("article_id"), (k % 50).cast("int").alias("page"), "headline", F.lit("").alias("deck"),
        F.when(k % 6 == 0, (k % 25).cast("int")).alias("continues_on_page"), F.substring("headline", 1, 20).alias("body_preview"),
    )


def proposed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A ranking of each source that is wrong in all the ways there are."""
    h, k = first_lines(spark, d), F.col("doc_id")
    name = F.when(k % 41 == 0, "nowhere").otherwise(F.concat(F.lit("p"), F.when(k % 37 == 0, k + 1).otherwise(k).cast("string")))
    ranked = h.filter("doc_id % 4 <> 3").select(
        F.col("source").alias("edition"), k.cast("int").alias("pos"), name.alias("article_id"), F.when(k % 29 != 0, (k % 1000).cast("int")).alias("rank"), (100 - k % 103).cast("int").alias("importance_score"),
        F.when(k % 10 == 0, "NONSENSE").otherwise("ECONOMY").alias("category"), F.repeat(F.lit("w "), F.when(k % 31 == 0, 41).otherwise(3)).alias("why_it_matters"), F.when(k % 15 == 0, F.lit(None)).otherwise("none").alias("exclusion_risk"),
    )
    excluded = h.filter("doc_id % 4 = 3 or doc_id % 8 = 0").select(F.col("source").alias("edition"), k.cast("int").alias("pos"), name.alias("article_id"), F.when(k % 7 == 0, "WHAT").otherwise("OTHER").alias("reason_code"), F.lit("").alias("note"))
    return ranked, excluded


_RANK_SQL = f"""{HEADS_SQL}, nm AS (SELECT *, CASE WHEN doc_id % 41 = 0 THEN 'nowhere' ELSE 'p' || CASE WHEN doc_id % 37 = 0 THEN doc_id + 1 ELSE doc_id END END AS a FROM h),
rk AS (SELECT source AS edition, doc_id AS pos, a, CASE WHEN doc_id % 29 <> 0 THEN doc_id % 1000 END AS rank, 100 - doc_id % 103 AS score FROM nm WHERE doc_id % 4 <> 3), ex AS (SELECT source AS edition, doc_id AS pos, a FROM nm WHERE doc_id % 4 = 3 OR doc_id % 8 = 0),
co AS (SELECT source AS edition, 'p' || doc_id AS a, doc_id % 50 AS page, headline, CASE WHEN doc_id % 6 = 0 THEN doc_id % 25 END AS goes FROM h),
iss AS (SELECT edition, 'unknown_id' AS rule, 'ranked' AS list, pos, a, 'article_id ''' || a || ''' does not exist in the input corpus' AS told FROM rk WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.edition IS NOT DISTINCT FROM rk.edition AND co.a = rk.a)
  UNION ALL SELECT edition, 'unknown_id', 'excluded', pos, a, 'excluded article_id ''' || a || ''' does not exist in the input corpus' FROM ex WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.edition IS NOT DISTINCT FROM ex.edition AND co.a = ex.a)
  UNION ALL SELECT edition, 'duplicate_id', 'ranked', pos, a, 'duplicate article_id ''' || a || ''' in ranked list' FROM (SELECT *, row_number() OVER (PARTITION BY edition, a ORDER BY pos) AS k FROM rk) WHERE k > 1
  UNION ALL SELECT edition, 'duplicate_id', 'excluded', pos, a, 'duplicate article_id ''' || a || ''' in excluded list' FROM (SELECT *, row_number() OVER (PARTITION BY edition, a ORDER BY pos) AS k FROM ex) WHERE k > 1
  UNION ALL SELECT edition, 'category', 'ranked', pos, a, 'article ''' || a || ''': category ''NONSENSE'' is not in the fixed enum' FROM rk WHERE pos % 10 = 0
  UNION ALL SELECT edition, 'exclusion_risk', 'ranked', pos, a, 'article ''' || a || ''': exclusion_risk None is not in the fixed enum' FROM rk WHERE pos % 15 = 0
  UNION ALL SELECT edition, 'score_range', 'ranked', pos, a, 'article ''' || a || ''': importance_score ' || score || ' is not an integer in 0-100' FROM rk WHERE score NOT BETWEEN 0 AND 100
  UNION ALL SELECT edition, 'why_length', 'ranked', pos, a, 'article ''' || a || ''': why_it_matters is 41 words, well over the 30-word cap' FROM rk WHERE pos % 31 = 0
  UNION ALL SELECT edition, 'ranked_and_excluded', 'excluded', pos, a, 'article ''' || a || ''' appears in both ranked and excluded lists' FROM ex WHERE EXISTS (SELECT 1 FROM rk WHERE rk.edition IS NOT DISTINCT FROM ex.edition AND rk.a = ex.a)
  UNION ALL SELECT edition, 'reason_code', 'excluded', pos, a, 'excluded article ''' || a || ''': reason_code ''WHAT'' is not in the fixed enum' FROM ex WHERE pos % 7 = 0
  UNION ALL SELECT edition, 'too_many', 'ranked', NULL, NULL, 'returned ' || count(*) || ' articles, expected at most 30' FROM rk GROUP BY edition HAVING count(*) > 30
  UNION ALL SELECT edition, 'too_many', 'excluded', NULL, NULL, 'excluded list has ' || count(*) || ' entries, expected at most 5' FROM ex GROUP BY edition HAVING count(*) > 5
  UNION ALL SELECT edition, 'score_order', 'ranked', pos, a, 'rank ' || coalesce(rank::VARCHAR, 'None') || ' (score ' || score || ') scores higher than a lower rank number (score ' || prev || ')' FROM (SELECT *, lag(score) OVER (PARTITION BY edition ORDER BY coalesce(rank, 0), pos) AS prev FROM rk) WHERE score > prev)"""


@query(f"WITH {_RANK_SQL} SELECT edition, rule, list, CAST(pos AS INTEGER) AS pos, a AS article_id, told FROM iss")
def ranking_check(spark: SparkSession, d: str) -> DataFrame:
    """ST17, PF11, AG16, AG17, JN7, JN8, WN5: everything that is wrong with the rankings of all editions."""
    return ranking.ranking_issues(*proposed(spark, d), candidates(spark, d), CONFIG, EDITION).drop("ord")


_TOPIC = "list_distinct(list_filter(string_split(lower(regexp_replace(headline, '[^\\p{L}\\p{N}]', ' ', 'g')), ' '), lambda x: x <> '' AND NOT list_contains({stop}, x)))"


def _pairs_sql() -> str:
    from pageline.functions.text import STOPWORDS

    words = _TOPIC.replace("{stop}", "[" + ",".join(f"'{w}'" for w in STOPWORDS) + "]")
    return f"""WITH {_RANK_SQL}, rw AS (SELECT co.*, {words} AS w FROM co WHERE EXISTS (SELECT 1 FROM rk WHERE rk.edition IS NOT DISTINCT FROM co.edition AND rk.a = co.a))
    SELECT x.edition, x.a AS article_id, y.a AS continuation_id, CAST(y.page AS INTEGER) AS page FROM rw x JOIN rw y ON x.edition = y.edition AND x.goes = y.page AND x.a <> y.a AND len(x.w) > 0 AND len(y.w) > 0
    AND len(list_intersect(x.w, y.w)) >= 2 AND len(list_intersect(x.w, y.w)) >= 0.5 * least(len(x.w), len(y.w))"""


@query(_pairs_sql())
def ranking_pairs(spark: SparkSession, d: str) -> DataFrame:
    """JN9, ST18, ST19: articles that are ranked together with what continues them."""
    return ranking.duplicate_continuations(proposed(spark, d)[0], candidates(spark, d), CONFIG, EDITION)


@query(
    f"""WITH {_RANK_SQL} SELECT edition, md5(count(*) || ' candidate articles from this edition:' || chr(10) || string_agg('--- article_id=' || a || ' page=' || page || ' continues_on_page=' || coalesce(goes::VARCHAR, 'None') || ' ---' || chr(10) || 'headline: ' || headline || chr(10)
    || 'deck: ' || chr(10) || 'body_preview: ' || left(headline, 20), chr(10) || chr(10) ORDER BY page, a)) AS prompt FROM co GROUP BY edition"""
)
def ranking_prompts(spark: SparkSession, d: str) -> DataFrame:
    """ST14: the candidates of each edition as one text."""
    return masthead.ranking_prompt(candidates(spark, d), EDITION).select("edition", F.md5("prompt").alias("prompt"))


@query(f"WITH {_RANK_SQL}, rr AS (SELECT edition, a, pos, coalesce(rank, 999) AS rank FROM rk) SELECT rr.edition, rr.a AS article_id, CAST(rr.pos AS INTEGER) AS pos, coalesce(CAST(page AS INTEGER), -1) AS page, coalesce(headline, '') AS headline FROM rr LEFT JOIN co ON co.edition = rr.edition AND co.a = rr.a")
def ranking_enriched(spark: SparkSession, d: str) -> DataFrame:
    """JN6, SL4: rankings with page and headline of the corpus."""
    return ranking.enrich(proposed(spark, d)[0], candidates(spark, d), EDITION).select("edition", "article_id", "pos", "page", "headline")


@query(
    f"""WITH {_RANK_SQL}, n AS (SELECT edition, count(*) AS issues FROM iss GROUP BY 1), r2 AS (SELECT edition, CAST(count(*) AS INTEGER) AS ranked FROM rk GROUP BY 1), e2 AS (SELECT edition, CAST(count(*) AS INTEGER) AS excluded FROM ex GROUP BY 1), c AS (SELECT DISTINCT edition FROM co)
    SELECT c.edition, coalesce(n.issues, 0) > 0 AS retried, coalesce(ranked, 0) AS first_ranked, coalesce(excluded, 0) AS first_excluded FROM c LEFT JOIN n USING (edition) LEFT JOIN r2 USING (edition) LEFT JOIN e2 USING (edition) WHERE ranked IS NOT NULL OR excluded IS NOT NULL"""
)
def ranking_records(spark: SparkSession, d: str) -> DataFrame:
    """OC9, SK8: rankings with one second attempt, which is told what was wrong; the record says so."""
    corpus = candidates(spark, d)
    first = proposed(spark, d)

    def propose(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        return tuple(df.join(asked.select("edition"), "edition", "left_semi") for df in first)

    out = ranking.rank_editions(propose, corpus, CONFIG, EDITION)
    return out.select("edition", "retried", F.coalesce(F.size("ranked"), F.lit(0)).alias("first_ranked"), F.coalesce(F.size("excluded"), F.lit(0)).alias("first_excluded"))


@query("SELECT o_orderkey, o_orderpriority AS category FROM orders WHERE o_orderpriority = '1-URGENT'")
def category_view(spark: SparkSession, d: str) -> DataFrame:
    """PF21: what of a ranking is of one category, in its order."""
    ranked = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("category"), F.col("o_orderkey").alias("rank"), F.col("o_orderkey").alias("pos"))
    return views.by_category(ranked, "1-URGENT").select("o_orderkey", "category")


# Rows of operators that no other query reaches -------------------------------------------------------------------------


@query(f"WITH {EVENTS_SQL} SELECT run_id, count(*) AS n_events, count(*) FILTER (is_error) AS n_raw FROM e WHERE NOT (run_id % 10 = 3 AND run_id % 3 = 1) GROUP BY run_id")
def deleted_runs(spark: SparkSession, d: str) -> DataFrame:
    """SK9, JN16: what is left of all runs, their events and raw answers once the runs of one edition are deleted."""
    e = events(spark, d)
    about = e.select("run_id", F.concat(F.lit("e"), F.col("run_id") % 10).alias("edition"), F.concat(F.lit("d"), F.col("run_id") % 3).alias("date")).distinct()
    kept, log, raw = trace.delete_runs(about, e, e.filter("is_error"), "e3", "d1")
    counted = log.groupBy("run_id").agg(F.count("*").alias("n_events")).join(raw.groupBy("run_id").agg(F.count("*").alias("n_raw")), "run_id", "left")
    return kept.select("run_id").join(counted, "run_id").fillna(0, ["n_raw"]).select("run_id", "n_events", "n_raw")


@query(f"WITH {EVENTS_SQL} SELECT run_id, coalesce(nullif(arg_max(page_num, id), 0), 1) AS page_num FROM e GROUP BY run_id")
def last_attempts(spark: SparkSession, d: str) -> DataFrame:
    """JN18: the page of each run's last event, as the number of its last attempt; none or 0 counts as 1."""
    return trace.last_before(events(spark, d), ["run_id"], "page_num", "id")


@query(
    """WITH x AS (SELECT l_suppkey AS k, (l_orderkey + l_linenumber) % 40 + 1 AS page_num, l_returnflag AS f FROM lineitem),
    g AS (SELECT k, count(*) AS article_count, count(DISTINCT page_num) AS pages FROM x WHERE f = 'N' GROUP BY 1), r AS (SELECT k, string_agg(DISTINCT page_num, ',' ORDER BY page_num) AS failed FROM x WHERE f = 'R' GROUP BY 1),
    o AS (SELECT o_custkey AS k, max(o_orderkey) AS run_id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1)
    SELECT 's' || s_suppkey AS edition, o.run_id, o.status, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 45 ELSE g.pages END AS INTEGER) AS page_count, coalesce(article_count, 0) AS article_count, coalesce(failed, '') AS failed_pages
    FROM supplier LEFT JOIN g ON g.k = s_suppkey LEFT JOIN r ON r.k = s_suppkey LEFT JOIN o ON o.k = s_suppkey"""
)
def edition_summaries(spark: SparkSession, d: str) -> DataFrame:
    """JN14, SL3: each edition with its last run, pages, articles and failed pages."""
    x = _edition_pages(spark, d)
    named = lambda k: (F.concat(F.lit("s"), F.col(k)).alias("edition"), F.lit("d").alias("date"))
    made, failed = x.filter("l_returnflag = 'N'"), x.filter("l_returnflag = 'R'")
    editions = table(spark, d, "supplier").select("s_suppkey", *named("s_suppkey"))
    manifest = editions.filter("s_suppkey % 3 = 0").select("edition", "date", F.lit(45).alias("page_count"))
    jobs = spark.createDataFrame([], "edition string, date string, pages_total int")
    log = table(spark, d, "orders").select(*named("o_custkey"), F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.lit(0).alias("total_tokens"), F.timestamp_micros("o_orderkey").alias("started_at"))
    out = status.edition_summary(editions.drop("s_suppkey"), log, status.page_counts(manifest, jobs, made), made, failed)
    pages = F.coalesce(F.array_join(F.transform("failed_pages", lambda v: v.cast("string")), ","), F.lit(""))
    return out.select("edition", "run.run_id", "run.status", "page_count", "article_count", pages.alias("failed_pages"))
