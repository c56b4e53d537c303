"""Benchmark decontamination: rare word pairs lead from training texts to test items; Smith-Waterman alignment scores them.

Words are runs of letters and digits, lower-cased. A document's passage is aligned with the whole item (match +1, mismatch and gap
-``LOSS``). The score is the best local alignment over the item's words; from ``LEAST`` on (and ``LEAST_WORDS`` words' worth) the
document holds a copy, edited or not. An alignment worth ``ENOUGH`` words suffices however long the item is.

No such copy is missed. An alignment of score S with M matches and E edits has M - E / 2 >= S; of the M - 1 steps from one match to the
next at most E / 2 hold two edits or more, so S - 1 steps hold one at most. Such a step is a pair of words that stand one or two words
apart in the item and in the document. So a document that holds a copy has S - 1 pairs of the item, from as many places of it, within
the span of the longest alignment of that score. Half of these may be spared: the places of an item whose pairs are commonest in the
documents lead nowhere, and the rest of the S - 1 is asked for. What has them is aligned; the alignment alone decides.

Documents are read twice (counts, alignment) and never shuffled. Test items come in blocks of at most ``BLOCK_BYTES`` of text, which
bounds what the driver gathers and sends; each block meets all documents. Places of pairs are handled ``HELD`` at a time. Their number
grows with documents x items where both use the same few words.

Cases. Test items whose item_id is null or no whole number are left out; items that repeat an id are items each, a document has the best
hit of an id. Null and empty texts and items match nothing, nor do items of fewer than ``FEWEST`` words. A document that holds an item several
times has its best place once. Items with equal texts each match. Repeated documents give equal hits; empty tables none. Columns of the
documents pass through ``scan`` untouched, but for one named ``hits``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageline.llm.common import PLAIN_GAPS, documents, mix64, slices, word_hashes

FEWEST = 3
#: Words of a pair are so many words apart: next to each other, or with one between.
FAR = (1, 2)
#: The bound on pairs holds for one half and more.
LOSS = 0.5
LEAST = 0.4
#: Least score of a hit in words, or the whole item where it is shorter.
LEAST_WORDS = 8
#: Score of a hit in words, whatever share of its item that is: chance doesn't bring so many in a row.
ENOUGH = 13
BLOCK_BYTES = 8 << 20
PIECE = 1 << 20
#: Places of pairs that are looked at together.
HELD = 1 << 21
#: Alignments that are computed together, and words of their texts.
TOGETHER = 256
TOGETHER_WORDS = 1 << 17
#: Words of a text that one alignment walks, besides the longest copy of the item.
STRIP = 1 << 16
HITS = "array<struct<item_id:long,score:double,start:long,end:long>>"


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([(t or "").lower().encode() for t in texts], gaps=PLAIN_GAPS)


def _pairs(h: np.ndarray, far: int) -> np.ndarray:
    return mix64(h[:-far] * np.uint64(0x9E3779B97F4A7C15) + h[far:])


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Best local alignment of each item with its text: score, and the last item and text word of it (rows x 3)."""
    m, n = max(map(len, items)), max(map(len, texts))
    a, b = np.zeros((len(items), m), np.uint64), np.ones((len(items), n), np.uint64)
    for k, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    best = np.zeros((len(items), 3))
    row, step = np.zeros((len(items), n)), LOSS * np.arange(1, n + 1)
    for i in range(m):
        down = np.where(a[:, i : i + 1] == b, 1.0, -LOSS)
        down[:, 1:] += row[:, :-1]
        np.maximum(down, row - LOSS, out=down)
        np.maximum(down, 0, out=down)
        row = np.maximum.accumulate(down + step, axis=1) - step
        j = row.argmax(axis=1)
        top = row[np.arange(len(j)), j]
        better = top > best[:, 0] + 1e-9
        best[better] = np.stack([top, np.full(len(j), i), j], 1)[better]
    return best


class Items:
    """Test items as words, and the pairs of words that lead to them."""

    def __init__(self, ids: list[int], texts: list[str | None], least: float = LEAST):
        h, begin = _words(texts)
        self.ids, self.words = ids, [h[x:y] for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        size = np.array([len(w) for w in self.words], np.int64)
        #: Least score of a copy, most words that one spans, and pairs of it that a document has.
        self.score = np.minimum(np.maximum(least * size, np.minimum(size, LEAST_WORDS)), ENOUGH)
        self.span = np.ceil(size + (size - self.score) / LOSS).astype(np.int64)
        self.asked = np.maximum(np.ceil(self.score - 1 - 1e-9).astype(np.int64), 1)
        parts = [(_pairs(w, far), k) for k, w in enumerate(self.words) if len(w) >= FEWEST for far in FAR]
        self.gram = np.concatenate([np.zeros(0, np.uint64), *(g for g, _ in parts)])
        self.item = np.concatenate([np.zeros(0, np.int64), *(np.full(len(g), k) for g, k in parts)])
        self.at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g, _ in parts)])
        self._sorted()

    def _sorted(self) -> None:
        order = np.lexsort((self.at, self.item, self.gram))
        self.gram, self.item, self.at = self.gram[order], self.item[order], self.at[order]
        self.known, self.first, self.n = np.unique(self.gram, return_index=True, return_counts=True)
        self.likely = np.zeros(1 << 22, bool)
        self.likely[(self.known >> np.uint64(42)).astype(np.int64)] = True

    def without_common(self, counts: np.ndarray) -> Items:
        """Without the commonest places of each item, half as many as a copy has pairs; ``counts`` go with ``known``."""
        spared = self.asked // 2
        common = np.repeat(counts, self.n)
        place, of = np.unique(np.stack([self.item, self.at]), axis=1, return_inverse=True)
        weight = np.bincount(of.ravel(), common, minlength=place.shape[1])
        order = np.lexsort((place[1], -weight, place[0]))
        item = place[0][order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        stays = np.zeros(len(item), bool)
        stays[order] = nth >= spared[item]
        keep = stays[of.ravel()]
        out = object.__new__(Items)
        out.ids, out.words, out.score, out.span, out.asked = self.ids, self.words, self.score, self.span, self.asked - spared
        out.gram, out.item, out.at = self.gram[keep], self.item[keep], self.at[keep]
        out._sorted()
        return out

    def find(self, h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a pair of the items stands within one text: index in ``known`` and first word, in the order of these."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for far in FAR if len(self.known) else ():
            grams = _pairs(h, far)
            pos = np.flatnonzero(self.likely[(grams >> np.uint64(42)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.known, grams[pos]), len(self.known) - 1)
            same = self.known[k] == grams[pos]
            k, pos = k[same], pos[same]
            same = pos + far < begin[np.searchsorted(begin, pos, side="right")]
            found.append((k[same], pos[same]))
        k, pos = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(pos, kind="stable")
        return k[order], pos[order]

    def passages(self, k: np.ndarray, pos: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Text, item, first and one past the last word of what has enough pairs of an item within the span of a copy."""
        n = self.n[k]
        of = np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pos, item = np.repeat(pos, n), self.item[of]
        doc = np.searchsorted(begin, pos, side="right") - 1
        order = np.lexsort((pos, item, doc))
        doc, item, pos = doc[order], item[order], pos[order]
        last = np.arange(len(pos)) + self.asked[item] - 1
        first = np.flatnonzero(last < len(pos))
        last = last[first]
        near = (doc[last] == doc[first]) & (item[last] == item[first]) & (pos[last] - pos[first] < self.span[item[first]])
        first, last = first[near], last[near]
        if not len(first):
            return
        doc, item, lo, hi = doc[first], item[first], pos[last], pos[first]
        lo, hi = np.maximum(begin[doc], lo - self.span[item]), np.minimum(begin[doc + 1], hi + self.span[item])
        # what overlaps is one passage
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])]))
        for d, i, x, y in zip(doc[new].tolist(), item[new].tolist(), lo[new].tolist(), hi[np.append(new[1:], len(doc)) - 1].tolist(), strict=True):
            # a very long passage goes by strips, which overlap by the longest copy
            reach = int(self.span[i])
            for a in range(x, max(x + 1, y - reach), STRIP):
                yield d, i, a, min(y, a + STRIP + reach)

    def hits(self, texts: list[str | None]) -> list[list[tuple[int, float, int, int]]]:
        """Of each text: item_id, score, first and one past the last word of the passage."""
        h, begin = _words(texts)
        k, pos = self.find(h, begin)
        out: list[list] = [[] for _ in texts]
        if not len(k):
            return out
        reach, total = int(self.span.max()), np.cumsum(self.n[k])
        work, lo, hi = [], 0, 0
        while hi < len(h):
            # pieces overlap by the longest copy, so each copy is within one
            a = int(np.searchsorted(pos, lo))
            b = int(np.searchsorted(total, (total[a - 1] if a else 0) + HELD, side="right"))
            hi = len(h) if b >= len(pos) else max(int(pos[b]), lo + 2 * reach)
            b = int(np.searchsorted(pos, hi))
            for d, i, x, y in self.passages(k[a:b], pos[a:b], begin):
                part = h[x:y]
                # no alignment scores more than the words that both have
                if np.isin(self.words[i], part).sum() >= self.score[i] - 1e-9 and np.isin(part, self.words[i]).sum() >= self.score[i] - 1e-9:
                    work.append((d, i, x, part))
            lo = hi - reach
        work.sort(key=lambda w: (len(w[3]), len(self.words[w[1]])))
        at = 0
        while at < len(work):
            stop = at + 1
            while stop < min(len(work), at + TOGETHER) and (stop + 1 - at) * len(work[stop][3]) <= TOGETHER_WORDS:
                stop += 1
            some, at = work[at:stop], stop
            got = align([self.words[w[1]] for w in some], [w[3] for w in some])
            some = [(*w, *g) for w, g in zip(some, got.tolist(), strict=True) if g[0] >= self.score[w[1]] - 1e-9]
            if not some:
                continue
            # the same backwards from where the alignment ends gives where it begins
            back = align([self.words[w[1]][: int(w[5]) + 1][::-1] for w in some], [w[3][: int(w[6]) + 1][::-1] for w in some])
            for (d, i, lo, _, score, _, j), (_, _, length) in zip(some, back.tolist(), strict=True):
                end = lo + int(j) + 1 - int(begin[d])
                out[d].append((self.ids[i], round(score / len(self.words[i]), 6), end - int(length) - 1, end))
        return [_best(x) for x in out]


def _best(found: list[tuple[int, float, int, int]]) -> list[tuple[int, float, int, int]]:
    best: dict[int, tuple] = {}
    for x in found:
        if x[0] not in best or (x[1], -x[2]) > (best[x[0]][1], -best[x[0]][2]):
            best[x[0]] = x
    return [best[k] for k in sorted(best)]


def gram_counts(df: DataFrame, items: Items) -> np.ndarray:
    """How often each pair of the items occurs in all documents; the driver holds one number for each."""
    held = df.sparkSession.sparkContext.broadcast(items)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value.known), np.int64)
        for batch in slices(batches, limit=PIECE):
            k, _ = held.value.find(*_words(batch.column(0).to_pylist()))
            total += np.bincount(k, minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["k", "n"])

    out = np.zeros(len(items.known), np.int64)
    found = df.select("text").mapInArrow(work, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out[found["k"].to_numpy()] = found["n"].to_numpy()
    return out


def scan(df: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """``df`` (text, ...) with ``hits``: the test items of ``benchmark`` (item_id, text) that each text holds, and where."""
    about = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(about / BLOCK_BYTES))
    out = df.select(*(c for c in df.columns if c != "hits"), F.lit(None).cast(HITS).alias("hits"))
    names = out.columns
    for k in range(blocks):
        # one block of the test items, of bounded size
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).select(F.expr("try_cast(item_id AS long)").alias("item_id"), "text").filter("item_id is not null and text is not null").collect()
        items = Items([r[0] for r in sorted(rows)], [r[1] for r in sorted(rows)], least)
        seeds = df.sparkSession.sparkContext.broadcast(items.without_common(gram_counts(df, items)))

        def work(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            at = names.index("text")
            for batch in slices(batches, limit=PIECE):
                found = seeds.value.hits(batch.column(at).to_pylist())
                had = batch.column(len(names) - 1).to_pylist()
                both = [[*(tuple(x.values()) for x in old or []), *new] or None for old, new in zip(had, found, strict=True)]
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
                rows = [b and [dict(zip(("item_id", "score", "start", "end"), x, strict=True)) for x in b] for b in both]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], names)

        out = out.mapInArrow(work, out.schema)
    return out


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Each document and test item of which it holds a copy: score, and first and one past the last word of the passage."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.item_id", "hit.score", F.col("hit.start").alias("start_word"), F.col("hit.end").alias("end_word"))
