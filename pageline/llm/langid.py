"""Language identification by rank-order profiles: a document's most frequent n-grams against those of each language, by
out-of-place distance.

An n-gram is one to three letters or word edges (a gap counts as one blank); texts are lower-cased. A profile ranks the ``TOP`` most
frequent ones, ties by code point. The distance of a document to a language sums how far each of its own top n-grams is out of place,
``TOP`` where the profile lacks it; the score is 1 less that distance as a share of the largest possible one.

Profiles are fitted on a bounded sample: at most ``SAMPLE`` documents of each language, the lowest by a hash of their id and text. Every language
that a row names has one. Every document is then judged by its whole text.

Cases. Rows that repeat an id each teach the language they name; rows equal in id, language and text teach once. Null texts and texts without a letter give ``und`` and score 0. Rows without a language teach nothing; where no row teaches, all
documents give ``und``. Ties between languages go to the first by code point. Empty tables give no rows, repeated rows equal results;
columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageline.llm.common import documents, slices

TOP = 300
PIECE = 1 << 20
SAMPLE = 400
#: Up to so many languages the sample's ids are sent to all documents; those of more meet them in a join.
FEW = 256
UNKNOWN = "und"
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters; made once for each worker."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((0xD800 <= c < 0xE000 or chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _LETTERS[0xD800:0xE000] = False
    return _LETTERS


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, as integers in the order of their code points, and their counts."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[cp] if len(cp) else np.zeros(0, bool)
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cp = np.where(letter, cp, 32).astype(np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of several gaps in a row the first stays
    cp = np.concatenate([[32], cp[keep], [32]])
    if cp[-2] == 32:
        cp = cp[:-1]
    two = (cp[:-1] << 21) | cp[1:]
    three = (two[:-1] << 21) | cp[2:]
    return np.unique(np.concatenate([cp[cp != 32], two, three]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The ``top`` most frequent n-grams, the most frequent first, ties by code point."""
    if len(grams) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        held = counts >= least
        grams, counts = grams[held], counts[held]
    return grams[np.argsort(-counts, kind="stable")][:top]


class Profiles:
    """Ranks of each language's n-grams: for each n-gram the languages that have it, and its places there."""

    def __init__(self, ranks: dict[str, np.ndarray], top: int = TOP):
        self.langs, self.top = sorted(ranks), top
        grams = np.concatenate([np.zeros(0, np.int64), *(ranks[lang] for lang in self.langs)])
        lang = np.repeat(np.arange(len(self.langs)), [len(ranks[x]) for x in self.langs])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(ranks[x])) for x in self.langs)])
        order = np.argsort(grams, kind="stable")
        self.lang, self.place = lang[order].astype(np.int32), place[order].astype(np.int32)
        self.grams, self.first, self.n = np.unique(grams[order], return_index=True, return_counts=True)

    def judge(self, text: str | None) -> tuple[str, float]:
        own = ranked(*gram_counts(text), self.top)
        if not len(own) or not len(self.grams):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        rank = np.flatnonzero(self.grams[at] == own)
        n = self.n[at[rank]]
        of = np.repeat(self.first[at[rank]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        # what a profile has is nearer than ``top`` by so much
        near = np.bincount(self.lang[of], self.top - np.abs(self.place[of] - np.repeat(rank, n)), len(self.langs))
        best = int(np.argmax(near))
        return self.langs[best], round(1 - float(self.top * len(own) - near[best]) / (self.top * len(own)), 6)


def _lowest(df: DataFrame, most: int, spread: str, order: list) -> DataFrame:
    """The first ``most`` rows of each language in the given order, with their number ``nth``.

    A language is dealt over slices, and then fewer slices, by a hash of ``spread``; each step keeps ``most`` of a slice, so the last one
    sees 16 x ``most`` rows of a language, however many there were.
    """
    for deal in (256, 16, 1):
        part = Window.partitionBy("lang", F.pmod(F.xxhash64(spread), F.lit(deal))).orderBy(*order)
        df = df.withColumn("nth", F.row_number().over(part)).filter(F.col("nth") <= most)
    return df


def fit(df: DataFrame, sample: int = SAMPLE, top: int = TOP) -> Profiles:
    """Profiles from the rows of ``df`` (doc_id, text, lang) that name a language."""
    taught = df.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang", F.xxhash64("text").alias("same"))
    named = taught.select("doc_id", "lang", "same", F.xxhash64("doc_id", "same").alias("draw"))
    few = named.select("lang").distinct().limit(FEW + 1).count() <= FEW
    chosen = _lowest(named, sample, "draw", ["draw", "doc_id", "same"]).select("doc_id", "lang", "same").distinct()  # at most sample x langs rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in slices(batches, limit=PIECE):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(gram_counts(text))
        for lang, parts in held.items():
            grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    # a row teaches the language it names itself; rows that are equal in id, language and text teach once
    met = taught.alias("t").join((F.broadcast(chosen) if few else chosen).alias("c"), [F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ("doc_id", "lang", "same")], "leftsemi")
    texts = met.dropDuplicates(["doc_id", "lang", "same"]).select("text", "lang")
    counts = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = _lowest(counts, top, "gram", [F.desc("n"), "gram"])
    found = first.select("lang", "gram", "nth").toPandas().sort_values(["lang", "nth"])  # at most top x langs rows
    return Profiles({lang: rows["gram"].to_numpy(np.int64) for lang, rows in found.groupby("lang")}, top)


def predict(df: DataFrame, profiles: Profiles) -> DataFrame:
    """``df`` with lang_pred and score. Only doc_id-free text goes into a judgement."""
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    schema = df.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    held = df.sparkSession.sparkContext.broadcast(profiles)  # top x langs entries

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = held.value.judge
        for batch in slices(batches, limit=PIECE):
            out = [judge(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.float64())], [*kept, "lang_pred", "score"])

    return df.select(*kept).mapInArrow(work, schema)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, from profiles of those whose crc32(doc_id) mod 4 is not 2."""
    docs = documents(spark, sf_dir)
    out = held_out(F.col("doc_id"), 4, 2)
    profiles = fit(docs.filter(~out))
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), profiles).select("doc_id", out.alias("held_out"), "lang_pred", "score")
