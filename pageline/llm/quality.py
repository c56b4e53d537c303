"""Quality classifier: a sparse rule ensemble, compiled into Spark column expressions.

Statistics of a text are Spark expressions over the whole text. On a bounded sample of labelled rows small trees are grown by gradient
boosting; each path to a node becomes a conjunctive rule over the statistics. Lasso logistic regression (proximal gradient steps) then
weighs rules and statistics, most weights become 0, and what is left is one Spark expression, so scoring is a projection.

The sample: at most ``SAMPLE`` labelled documents, the lowest by a hash of their id. Everything else covers all rows.

Cases. Null and empty texts have all statistics 0 and are scored like any text. Rows with null or missing labels teach nothing; with no
label, or one kind of label, the score is that label's share (0.5 without labels). Repeated labels of a document count once each.
Ties in the sample are settled by doc_id. Empty tables give no rows. Columns besides doc_id and text pass through ``score`` untouched, but for a column named ``score``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageline.llm.common import documents, n_words
from pageline.llm.langid import held_out

SAMPLE = 6_000
TREES, DEPTH, SHRINK, LEAST_LEAF, CUTS = 40, 3, 0.3, 8, 24
LASSO, STEPS = 0.002, 600


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a whole text, as Spark expressions."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t).cast("double")
    words = n_words(t).cast("double")

    def share(pattern: str) -> Column:
        return F.when(chars > 0, 1 - F.length(F.regexp_replace(t, pattern, "")) / chars).otherwise(0.0)

    lines = F.split(t, "\n", -1)
    fields = F.split(t, r"[\x20\x09-\x0D]++", -1)
    distinct = F.size(F.array_distinct(fields)).cast("double")
    return {
        "log_chars": F.log1p(chars),
        "word_length": F.when(words > 0, chars / words).otherwise(0.0),
        "upper": share(r"[\p{Lu}]++"),
        "digit": share(r"[0-9]++"),
        "symbol": share(r"[^\p{L}\p{N}\s.,;:'-]++"),
        "unstopped": share(r"[^.!?]++"),
        "gap": share(r"[\x20\x09-\x0D]++"),
        "words_distinct": F.when(words > 0, distinct / F.size(fields)).otherwise(0.0),
        "lines_distinct": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_length": chars / F.size(lines),
    }


@dataclass(frozen=True)
class Rule:
    """All of (statistic, whether above, cut) hold; a rule without conditions stands for the statistic's own (clipped, scaled) value."""

    tests: tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def expression(self, stats: dict[str, Column]) -> Column:
        """The probability of label 1."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            held = None
            for name, above, cut in rule.tests:
                one = stats[name] > float(cut) if above else stats[name] <= float(cut)
                held = one if held is None else held & one
            total = total + F.when(held, F.lit(float(weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[np.ndarray, list[list[tuple[int, bool, float]]]]:
    """A regression tree on gradients g and curvatures h: its prediction, and the path to every node below the root."""
    out, paths = np.zeros(len(x)), []

    def grow(rows: np.ndarray, path: list[tuple[int, bool, float]]) -> None:
        if path:
            paths.append(path)
        best, gs, hs = (1e-6, -1, 0.0), g[rows].sum(), h[rows].sum()
        if len(path) < DEPTH:
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                k = np.searchsorted(cut, x[rows, j], side="left")
                n, gl, hl = (np.cumsum(np.bincount(k, w, len(cut) + 1))[:-1] for w in (None, g[rows], h[rows]))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(n < LEAST_LEAF) | (n > len(rows) - LEAST_LEAF)] = -1
                m = int(np.argmax(gain))
                if gain[m] > best[0]:
                    best = (float(gain[m]), j, float(cut[m]))
        if best[1] < 0:
            out[rows] = gs / (hs + 1)
            return
        above = x[rows, best[1]] > best[2]
        grow(rows[~above], [*path, (best[1], False, best[2])])
        grow(rows[above], [*path, (best[1], True, best[2])])

    grow(np.arange(len(x)), [])
    return out, paths


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Ensemble:
    """Rules from boosted trees, weights by lasso logistic regression. Deterministic."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or len(y) < 2 * LEAST_LEAF:
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Ensemble(float(np.log(p / (1 - p))), ())
    cuts = [np.unique(np.round(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1]), 6)) for j in range(x.shape[1])]
    margin, rules = np.full(len(y), np.log(share / (1 - share))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step, paths = _tree(x, y - p, p * (1 - p), cuts)
        margin = margin + SHRINK * step
        for path in paths:
            rules.setdefault(tuple(sorted(set(path))), None)
    paths = list(rules)
    z = np.stack([np.all([(x[:, j] > c) == above for j, above, c in path], axis=0) for path in paths], 1).astype(float)
    mean, scale = z.mean(0), np.maximum(z.std(0), 0.05)
    z = (z - mean) / scale
    w, b, last, moment = np.zeros(z.shape[1]), float(np.log(share / (1 - share))), np.zeros(z.shape[1]), 1.0
    rate = 4.0 / max(1e-9, np.linalg.norm(z, 2) ** 2 / len(y))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(z @ last + b)))
        b -= float((p - y).mean())
        new = last - rate * (z.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * LASSO, 0)
        following = (1 + np.sqrt(1 + 4 * moment**2)) / 2
        last, w, moment = new + (moment - 1) / following * (new - w), new, following
    used = np.flatnonzero(w)
    weights = w / scale
    kept = tuple((Rule(tuple((names[j], above, c) for j, above, c in paths[k])), round(float(weights[k]), 6)) for k in used)
    return Ensemble(round(b - float((weights * mean).sum()), 6), kept)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """An ensemble from ``labels`` (doc_id, quality) and the texts of these documents."""
    chosen = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most ``sample`` rows
    stats = statistics(F.col("text"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("double").alias("y"), *(c.alias(k) for k, c in stats.items()))
    found = rows.toPandas().sort_values(["doc_id", "y"])
    return fit(found[list(stats)].to_numpy(float), found["y"].to_numpy(float), list(stats))


def score(df: DataFrame, ensemble: Ensemble) -> DataFrame:
    """``df`` with ``score``, the probability of label 1 by the statistics of ``text`` alone."""
    stats = statistics(F.col("text"))
    kept = [c for c in df.columns if c != "score"]
    with_stats = df.select(*kept, F.struct(*(c.alias(k) for k, c in stats.items())).alias("_stats"))
    return with_stats.select(*kept, F.round(ensemble.expression({k: F.col(f"_stats.{k}") for k in stats}), 6).alias("score"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels of those whose crc32(doc_id) mod 3 is not 1."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = held_out(F.col("doc_id"), 3, 1)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ensemble = learn(docs, labels.filter(~out))
    return score(docs, ensemble).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
