"""The edition's ranking: corpus, checks of a proposed ranking, and its join back to the corpus."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageline.config import Config
from pageline.functions.text import first_words, same_story, topic_words, words
from pageline.operators import stories
from pageline.operators.masthead import corrections, ranking_prompt
from pageline.operators.scan import before
from pageline.sources.scratch import written

#: Fixed values.
CATEGORIES = (
    "POLITY_GOVERNANCE", "ECONOMY", "INTERNATIONAL", "ENVIRONMENT", "SCIENCE_TECH", "SOCIAL_ISSUES",
    "JUDICIARY", "SECURITY_DEFENCE", "AGRICULTURE", "HEALTH", "EDUCATION", "OTHER",
)
EXCLUSION_RISKS = ("none", "possible_opinion", "possible_promotional")
REASON_CODES = (
    "PROMOTIONAL", "OPINION_WITHOUT_ANALYSIS", "ENTERTAINMENT", "LOCAL_WITHOUT_BROADER_RELEVANCE",
    "ROUTINE_STATEMENT", "CONTINUATION_OF_EARLIER_ARTICLE", "BELOW_THRESHOLD", "OTHER",
)


def build_corpus(gold: DataFrame, config: Config = Config(), keys: Sequence[str] = ()) -> DataFrame:
    """Candidates: page-qualified id, headline, deck, where the story goes on, and the first words of the body; ``keys`` go along."""
    return gold.select(
        *keys,
        F.concat(F.format_string("p%02d-", "page_num"), F.col("article_id")).alias("article_id"),
        F.col("page_num").alias("page"),
        "headline",
        F.array_join("deck", " ").alias("deck"),
        "continues_on_page",
        first_words(F.col("body"), config.body_preview_words).alias("body_preview"),
    )


def repeated(df: DataFrame, *by: str) -> DataFrame:
    """Each row whose id came before."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by[:-1]).orderBy(by[-1]))).filter("_k > 1").drop("_k")


def ranking_issues(ranked: DataFrame, excluded: DataFrame, corpus: DataFrame, config: Config = Config(), keys: Sequence[str] = ()) -> DataFrame:
    """What is wrong with each ranking: keys, rule, list, pos, article_id, what is told of it, and its place (``ord``) among the issues.

    All editions (``keys``) are checked at once.
    """
    keys = list(keys)
    by = [*keys, "article_id"]
    ids = corpus.select(*by).distinct()
    name = F.concat(F.lit("'"), F.coalesce("article_id", F.lit("None")), F.lit("'"))
    said = lambda c: F.coalesce(F.concat(F.lit("'"), F.col(c), F.lit("'")), F.lit("None"))
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    lacks = lambda ok: ~F.coalesce(ok, F.lit(False))
    parts, place = [], {"ranked": 0, "excluded": 2, "order": 4}

    def add(df: DataFrame, rule: str, of: str, told: list, nth: int, part: int | None = None) -> None:
        at = F.lit((place[of] if part is None else part) * 1_000_000_000).cast("long") + F.coalesce("pos", F.lit(0)).cast("long") * 16 + nth
        parts.append(df.select(*keys, F.lit(rule).alias("rule"), F.lit(of).alias("list"), F.col("pos").cast("int").alias("pos"), "article_id", F.concat(*(F.lit(t) if isinstance(t, str) else t for t in told)).alias("told"), at.alias("ord")))

    for df, of, word in ((ranked, "ranked", ""), (excluded, "excluded", "excluded ")):
        add(df.join(ids, by, "left_anti"), "unknown_id", of, [f"{word}article_id ", name, " does not exist in the input corpus"], 0)
        add(repeated(df, *by, "pos"), "duplicate_id", of, ["duplicate article_id ", name, f" in {of} list"], 1)
    add(ranked.filter(lacks(F.col("category").isin(*CATEGORIES))), "category", "ranked", ["article ", name, ": category ", said("category"), " is not in the fixed enum"], 2)
    add(ranked.filter(lacks(F.col("exclusion_risk").isin(*EXCLUSION_RISKS))), "exclusion_risk", "ranked", ["article ", name, ": exclusion_risk ", said("exclusion_risk"), " is not in the fixed enum"], 3)
    add(ranked.filter(lacks(F.col("importance_score").between(0, 100))), "score_range", "ranked", ["article ", name, ": importance_score ", none("importance_score"), " is not an integer in 0-100"], 4)
    long_ = F.size(words(F.coalesce("why_it_matters", F.lit(""))))
    add(ranked.filter(long_ > config.most_why_words), "why_length", "ranked", ["article ", name, ": why_it_matters is ", long_.cast("string"), f" words, well over the {config.asked_why_words}-word cap"], 5)
    add(excluded.join(ranked.select(*by).distinct(), by, "left_semi"), "ranked_and_excluded", "excluded", ["article ", name, " appears in both ranked and excluded lists"], 2)
    add(excluded.filter(lacks(F.col("reason_code").isin(*REASON_CODES))), "reason_code", "excluded", ["excluded article ", name, ": reason_code ", said("reason_code"), " is not in the fixed enum"], 3)
    for df, of, most, text in ((ranked, "ranked", config.top_n, "returned %d articles, expected at most %d"), (excluded, "excluded", config.most_excluded, "excluded list has %d entries, expected at most %d")):
        total = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > most).withColumns({"pos": F.lit(None).cast("int"), "article_id": F.lit(None).cast("string")})
        add(total, "too_many", of, [F.format_string(text, "n", F.lit(most))], 15, place[of] + 1)
    falls = not_falling(ranked.withColumn("_all", F.lit(0)), keys or ["_all"], F.coalesce("rank", F.lit(0)), "pos", "importance_score", keep="_last")
    add(falls.withColumn("_rank", none("rank")), "score_order", "ranked", ["rank ", F.col("_rank"), " (score ", none("importance_score"), ") scores higher than a lower rank number (score ", none("_last"), ")"], 0, place["order"])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def not_falling(df: DataFrame, keys: list[str], rank, pos: str, score: str, keep: str | None = None) -> DataFrame:
    """Rows whose score is above the last known score before them, in the order of rank."""
    out = before(df, keys, [rank.asc(), F.asc(pos)], F.col(score), keep or "_last").filter(F.col(score) > F.col(keep or "_last"))
    return out if keep else out.drop("_last")


def duplicate_continuations(ranked: DataFrame, corpus: DataFrame, config: Config = Config(), keys: Sequence[str] = ()) -> DataFrame:
    """Ranked articles and the ranked head on the page where they go on, if both tell the same story."""
    keys = list(keys)
    rows = ranked.select(*keys, "article_id").distinct().join(corpus, [*keys, "article_id"])
    rows = written(rows.select(*keys, "article_id", "page", "continues_on_page", topic_words(F.col("headline")).alias("_w")), "ranked-words")
    a = rows.filter("continues_on_page is not null").select(*keys, "article_id", F.col("continues_on_page").alias("page"), F.col("_w").alias("_wa"))
    b = rows.select(*keys, F.col("article_id").alias("continuation_id"), "page", F.col("_w").alias("_wb"))
    # a page of a large edition has many heads, so only those meet that share words, see stories.candidates
    by, rule = [*keys, "page"], (config.least_shared_words, config.least_shared_ratio)
    heads, tails = a.select(*by, F.col("article_id").alias("id"), F.col("_wa").alias("w")), b.select(*by, F.col("continuation_id").alias("id"), F.col("_wb").alias("w"))
    near = stories.candidates(heads, tails, by, *rule).toDF(*by, "article_id", "continuation_id")
    near = near.unionByName(stories.candidates(tails, heads, by, *rule, strictly=True).toDF(*by, "continuation_id", "article_id"))
    return near.join(a, [*by, "article_id"]).join(b, [*by, "continuation_id"]).filter(same_story(F.col("_wa"), F.col("_wb"), *rule)).select(*keys, "article_id", "continuation_id", "page")


def enrich(entries: DataFrame, corpus: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Ranked or excluded entries with page (-1) and headline ('') of the corpus; ranked ones by rank, those without a rank last."""
    keys = list(keys)
    about = corpus.select(*keys, "article_id", "page", "headline").dropDuplicates([*keys, "article_id"])
    out = entries.join(about, [*keys, "article_id"], "left").fillna(-1, ["page"]).fillna("", ["headline"])
    return out.orderBy(*keys, *([F.coalesce("rank", F.lit(999))] if "rank" in entries.columns else []), "pos")


def ranking_record(ranked: DataFrame, excluded: DataFrame, issues: DataFrame, pairs: DataFrame, config: Config = Config(), keys: Sequence[str] = ("edition", "date")) -> DataFrame:
    """One row for each edition, as it is kept: both lists in order (enriched), issues, pairs, whether all is well, and a note where
    fewer articles came than were asked for."""
    keys = list(keys)

    def listed(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
        cols = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*cols).alias("v")))), lambda x: x["v"]).alias(name))

    out = ranked.select(*keys).unionByName(excluded.select(*keys)).distinct()
    out = out.join(listed(ranked, "ranked", F.coalesce("rank", F.lit(999)).alias("r"), "pos"), keys, "left").join(listed(excluded, "excluded", "pos"), keys, "left")
    out = out.join(listed(issues.select(*keys, "ord", "told"), "validation_issues", "ord"), keys, "left").join(listed(pairs, "duplicate_continuations", "article_id", "continuation_id"), keys, "left")
    n = F.coalesce(F.size("ranked"), F.lit(0))
    told = F.transform(F.coalesce("validation_issues", F.array().cast(dict(out.dtypes)["validation_issues"])), lambda x: x["told"])
    note = F.when(n < config.top_n, F.format_string("returned %d articles, fewer than the requested %d", n, F.lit(config.top_n)))
    ok = F.col("validation_issues").isNull() & F.col("duplicate_continuations").isNull()
    return out.withColumns({"top_n": F.lit(config.top_n), "validation_ok": ok, "validation_issues": told, "eligible_count_note": note})


def rank_editions(propose: Callable[[DataFrame], tuple[DataFrame, DataFrame]], corpus: DataFrame, config: Config = Config(), keys: Sequence[str] = ("edition", "date")) -> DataFrame:
    """Rankings of all editions, with one second attempt for those that are not well.

    ``propose`` is the outside model: given keys, prompt and corrections (null at first) of the editions it is to rank, it returns the
    ranked and the excluded entries. What is wrong goes into the corrections of the second call, which covers these editions alone; the
    second answer stands as it is. The record says ``retried``.
    """
    keys = list(keys)
    asked = ranking_prompt(corpus, keys).withColumn("corrections", F.lit(None).cast("string"))
    first = propose(asked)
    issues, pairs = (f(first[0], *rest, corpus, config, keys) for f, rest in ((ranking_issues, (first[1],)), (duplicate_continuations, ())))
    wrong = corrections(issues, pairs, keys)
    second = propose(asked.drop("corrections").join(wrong, keys))
    lists = [a.join(wrong.select(*keys), keys, "left_anti").unionByName(b, allowMissingColumns=True) for a, b in zip(first, second, strict=True)]
    ranked, excluded = (enrich(df, corpus, keys) for df in lists)
    issues, pairs = ranking_issues(*lists, corpus, config, keys), duplicate_continuations(lists[0], corpus, config, keys)
    out = ranking_record(ranked, excluded, issues, pairs, config, keys)
    return out.join(wrong.select(*keys, F.lit(True).alias("retried")), keys, "left").fillna(False, ["retried"])
