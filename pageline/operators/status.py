"""Editions and pages as they stand: gold, errors, manifests and live jobs joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageline.operators.trace import latest

KEY = ["edition", "date"]
#: The stages of the two phases, and the job states in which a job is live.
PHASE_1, PHASE_2 = ("char_extraction", "line_building", "ligature_canary"), ("gemini_call", "validation", "assembly")
ACTIVE = ("queued", "running")


def stage_status(stage: Column) -> Column:
    """What a page does while a stage runs; null for stages of no page."""
    return F.when(stage.isin(*PHASE_1), "extracting").when(stage.isin(*PHASE_2), "grouping")


def live_status(status: Column) -> Column:
    return F.when(status.isin("extracting", "grouping"), "in_progress").when(status.isNotNull(), status)


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that are queued or run, so that a reader can find them again (jobs: job_id, edition, date, status, ...)."""
    return jobs.filter(F.col("status").isin(*ACTIVE))


def active_by_edition(jobs: DataFrame) -> DataFrame:
    """Of each edition its last live job (``ord`` tells which came last)."""
    return latest(active_jobs(jobs), KEY, F.desc("ord"))


def page_counts(manifest: DataFrame, jobs: DataFrame, gold: DataFrame) -> DataFrame:
    """Pages of each edition: of a live job that knows them, else the manifest, else as many as have articles; null for none.

    ``gold`` has a row for each page that is done. ``live`` says whether a job is: then ``live_pages`` (0 before it knows) decides what
    pages there are, whatever ``page_count`` says.
    """
    counted = gold.groupBy(*KEY).agg(F.countDistinct("page_num").alias("_gold"))
    keys = manifest.select(*KEY).union(jobs.select(*KEY)).union(gold.select(*KEY)).distinct()
    live = jobs.groupBy(*KEY).agg(F.max("pages_total").alias("live_pages"), F.lit(True).alias("live"))
    out = keys.join(live, KEY, "left").join(manifest.select(*KEY, F.col("page_count").alias("_manifest")), KEY, "left").join(counted, KEY, "left")
    total = F.coalesce(F.nullif("live_pages", F.lit(0)), "_manifest", F.nullif(F.col("_gold"), F.lit(0)))
    return out.select(*KEY, total.cast("int").alias("page_count"), F.coalesce("live", F.lit(False)).alias("live"), F.coalesce("live_pages", F.lit(0)).cast("int").alias("live_pages"))


def page_status(counts: DataFrame, gold: DataFrame, errors: DataFrame, live: DataFrame) -> DataFrame:
    """Every page from 1 on. With a live job only that job's word counts: a page it has no state for is pending, whatever lies on disk,
    and one beyond its pages reads null. Without one: done, failed or pending, and articles outweigh an error."""
    counts = counts if "live" in counts.columns else counts.withColumns({"live": F.lit(False), "live_pages": F.lit(0)})
    pages = counts.filter("page_count > 0").select(*KEY, "live", "live_pages", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("page_num"))
    key = [*KEY, "page_num"]
    done = gold.select(*key, F.lit(True).alias("_done")).distinct()
    failed = errors.select(*key, F.lit(True).alias("_failed")).distinct()
    out = pages.join(done, key, "left").join(failed, key, "left").join(live.select(*key, live_status(F.col("status")).alias("_live")), key, "left")
    settled = F.when(F.col("_done"), "done").when(F.col("_failed"), "failed").otherwise("pending")
    said = F.when(F.col("page_num") <= F.col("live_pages"), F.coalesce("_live", F.lit("pending")))
    return out.select(*key, F.when(F.col("live"), said).otherwise(settled).alias("status"))


def failed_pages(errors: DataFrame, jobs: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """Pages with an error record, whether they have articles by now or not; of editions with a live job those it says failed."""
    found = errors.select(*KEY, "page_num").distinct()
    if jobs is None or live is None:
        return found
    return found.join(jobs.select(*KEY).distinct(), KEY, "left_anti").unionByName(live.filter("status = 'failed'").select(*KEY, "page_num").distinct())


def edition_summary(editions: DataFrame, runs: DataFrame, counts: DataFrame, gold: DataFrame, errors: DataFrame) -> DataFrame:
    """Each edition with its last run, pages, articles and failed pages; the latest first, those never run last."""
    last = runs.groupBy(*KEY).agg(F.max_by(F.struct("run_id", "status", "total_tokens", "started_at"), "started_at").alias("run"))
    articles = gold.groupBy(*KEY).agg(F.count("*").alias("article_count"))
    failed = failed_pages(errors).groupBy(*KEY).agg(F.array_sort(F.collect_set("page_num")).alias("failed_pages"))
    out = editions.join(last, KEY, "left").join(counts, KEY, "left").join(articles, KEY, "left").join(failed, KEY, "left").fillna(0, ["article_count"])
    return out.orderBy(F.col("run.started_at").desc_nulls_last(), *KEY)


def article_counts(pages: DataFrame, gold: DataFrame) -> DataFrame:
    """Articles of each page that is done (``pages``), none included."""
    key = [*KEY, "page_num"]
    n = gold.groupBy(*key).agg(F.count("*").alias("articles"))
    return pages.select(*key).distinct().join(n, key, "left").fillna(0, ["articles"])


def edition_detail(counts: DataFrame, by_page: DataFrame, states: DataFrame) -> DataFrame:
    """Of each edition: articles, pages with and without any (``by_page``: article_counts), and the state of every page (``states``)."""
    per = by_page.groupBy(*KEY).agg(
        F.sum("articles").alias("article_count"),
        F.count_if(F.col("articles") > 0).alias("pages_with_articles"),
        F.array_sort(F.collect_list(F.when(F.col("articles") == 0, F.col("page_num")))).alias("pages_with_zero_articles"),
    )
    listed = states.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("page_num", F.coalesce("status", F.lit("pending")).alias("status")))).alias("pages"))
    out = counts.filter("page_count is not null").select(*KEY, "page_count").join(per, KEY, "left").join(listed, KEY, "left")
    return out.fillna(0, ["article_count", "pages_with_articles"]).withColumn("pages_with_zero_articles", F.coalesce("pages_with_zero_articles", F.array().cast("array<int>")))


def health(editions: DataFrame) -> DataFrame:
    """One row: ok, and whether there is any edition."""
    return editions.limit(1).agg(F.lit("ok").alias("status"), (F.count("*") > 0).alias("has_editions"))


def job_state(pages: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Of each job: whether all its pages came from the cache, any failed, how far it is, and its state.

    ``jobs`` (job_id, started, error) has jobs without pages too: one that hasn't started is queued, one with an error of its own failed.
    """
    out = pages.groupBy("job_id").agg(
        F.bool_and(F.coalesce("cached", F.lit(False))).alias("all_cached"),
        F.bool_or(F.col("status") == "failed").alias("any_failed"),
        F.count_if(F.col("status").isin("done", "failed")).alias("pages_done"),
        F.count("*").alias("pages_total"),
    )
    over = F.col("pages_done") == F.col("pages_total")
    state = F.when(~over, "running").when(F.col("any_failed"), "completed_with_errors").otherwise("done")
    if jobs is None:
        return out.withColumn("status", state)
    out = jobs.select("job_id", "started", "error").join(out, "job_id", "left").fillna(0, ["pages_done", "pages_total"]).fillna(False, ["all_cached", "any_failed"])
    own = F.when(F.col("error").isNotNull(), "failed").when(~F.col("started"), "queued").when(F.col("pages_total") == 0, "running")
    return out.withColumn("status", F.coalesce(own, state)).drop("started", "error")


def job_progress(pages: DataFrame) -> DataFrame:
    """Of each job: articles found, pages in flight and failed, pages that failed or did not validate."""
    failed = F.col("status") == "failed"
    pages_where = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("page_num"))))
    return pages.groupBy("job_id").agg(
        F.sum(F.coalesce("articles_found", F.lit(0))).cast("long").alias("articles_found"),
        pages_where(F.col("status").isin("extracting", "grouping")).alias("in_flight"),
        pages_where(failed).alias("failed"),
        pages_where(failed | F.coalesce(~F.col("validation_ok"), F.lit(False))).alias("failures"),
    )


def eta_seconds(elapsed: Column, done: Column, total: Column, running: Column) -> Column:
    """What is left of a running job at its pace so far; null before its first page."""
    return F.when(running & (done > 0), elapsed / done * F.greatest(total - done, F.lit(0)))
