"""Mixing sources to target weights by the cube method.

A source's target over its size says how often each of its documents is taken: whole times surely, and once more with the fraction
left as inclusion probability. The cube method settles these fractions: its flight phase moves three documents at a time along the
null space of the constraints (documents and words of the source stay what they are) until all but two are 0 or 1. Blocks of a source
fly apart, in parallel; the few documents that each leaves undecided meet in the next round, and the last are landed, together with a
few settled ones of all sizes, where the words come nearest. So the hot source is many blocks and no task sees more than a block.

Cases. Null or empty texts have size 0 and are taken 0 words. Null sources form one source, the last. Repeated rows are documents of
their own. A source without words has target 0. Empty tables give no rows. Extra columns pass through ``mix`` untouched, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageline.llm.common import documents, n_words, reading, written

WEIGHTS = (1, 2, 3)
#: No document is taken more often.
MOST = 3
#: Documents of one block, about.
BLOCK = 4096
#: Documents that a landing settles together.
POOL = 18
#: Blocks whose undecided documents (two each) meet in the next round.
GATHER = 1024
#: Most rows whose numbers of copies are sent to all executors (a byte each).
SENT = 32 << 20
EPS = 1e-9


def targets(sizes: Sequence[float], weights: Sequence[float], most: float = MOST) -> list[float]:
    """All sizes shared by weight, but at most ``most`` times a source's size; what is above goes round again by weight."""
    size, weight = np.asarray(sizes, float), np.asarray(weights, float)
    out, free, rest = np.zeros(len(size)), size > 0, float(size.sum())
    while free.any():
        share = rest * weight / weight[free].sum()
        above = free & (share > most * size)
        if not above.any():
            out[free] = share[free]
            break
        out[above] = most * size[above]
        rest -= out[above].sum()
        free &= ~above
    return out.tolist()


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved until at most two lie between 0 and 1; their sum and that of pi x size stay as they were."""
    pi = [float(p) for p in pi]
    waiting = [i for i in range(len(pi)) if EPS < pi[i] < 1 - EPS][::-1]
    draws, at, work = rng.random(len(pi) + 8), 0, []
    while True:
        while waiting and len(work) < 3:
            work.append(waiting.pop())
        if len(work) == 3:
            a, b, c = (size[i] for i in work)
            u = (float(c - b), float(a - c), float(b - a))
            if not any(u):
                u = (1.0, -1.0, 0.0)
        elif len(work) == 2 and size[work[0]] == size[work[1]]:
            u = (1.0, -1.0)
        else:
            return np.array(pi)
        moved = [(i, v) for i, v in zip(work, u, strict=True) if v]
        up = min((1 - pi[i]) / v if v > 0 else pi[i] / -v for i, v in moved)
        down = min(pi[i] / v if v > 0 else (1 - pi[i]) / -v for i, v in moved)
        step = up if draws[at] * (up + down) < down else -down
        at += 1
        for i, v in moved:
            pi[i] += step * v
            if pi[i] < EPS or pi[i] > 1 - EPS:
                pi[i] = float(round(pi[i]))
                work.remove(i)


def spread(size: np.ndarray, most: int) -> np.ndarray:
    """The places of at most ``most`` documents of all sizes, from the longest to the shortest, ties by place."""
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    return order[np.unique(np.linspace(0, len(order) - 1, min(most, len(order))).astype(np.int64))] if len(order) else order


def land(pi: np.ndarray, size: np.ndarray, pool: int = POOL) -> np.ndarray:
    """The last fractions become 0 or 1, and some whole ones turn round, such that the words, and then the documents, come nearest to
    what they were: the best of all 2 ^ ``pool`` ways to settle the undecided and a spread of others, no longer than what is amiss."""
    open_ = [i for i in range(len(pi)) if EPS < pi[i] < 1 - EPS]
    out = np.round(pi)
    out[open_] = 0
    words, docs = float(sum(pi[i] * size[i] for i in open_)), float(sum(pi[i] for i in open_))
    if not open_:
        return out
    fit = np.ones(len(pi), bool)
    fit[open_] = False
    if (fit & (size <= 2 * words) & (size > 0)).sum() >= pool - len(open_):
        fit &= size <= 2 * words
    others = np.flatnonzero(fit)
    turn = open_ + others[spread(size[others], pool - len(open_))].tolist()
    gain, count = np.zeros(1), np.zeros(1)
    for i in turn:
        sign = 1 - 2 * out[i]
        gain, count = np.concatenate([gain, gain + sign * size[i]]), np.concatenate([count, count + sign])
    off = np.abs(gain - words)
    near = np.flatnonzero(off <= off.min() + 1e-6)
    way = int(near[np.lexsort((near, np.abs(count[near] - docs)))[0]])
    for k, i in enumerate(turn):
        if way >> k & 1:
            out[i] = 1 - out[i]
    return out


def _fly(rows: DataFrame, level: int) -> DataFrame:
    """One round: the blocks of each source fly; where a source is one block, what is left is landed. A block that isn't the last marks
    some settled documents of all sizes as spare: they go on with the undecided ones, for the landing."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        # the longest first, so that what is left to land is short
        pdf = pdf.sort_values(["size", "draw"], ascending=[False, True], kind="stable")
        rng = np.random.default_rng([int(pdf["nth"].iloc[0]), int(pdf["block"].iloc[0]), level])
        size = pdf["size"].to_numpy(float)
        pi = flight(pdf["pi"].to_numpy(float), size, rng)
        spare = np.zeros(len(pi), bool)
        if pdf["blocks"].iloc[0] <= 1:
            pi = land(pi, size)
        else:
            spare[spread(np.where((pi > EPS) & (pi < 1 - EPS), 0, size), POOL)] = True
        return pdf.assign(pi=pi, spare=spare)

    return rows.groupBy("nth", "block").applyInPandas(block, rows.schema)


def source_plan(base: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Of each source its place by code point (``nth``, null last), size, rows and target. Nothing of it is gathered but one number for
    each partition and sums: sources may be many."""
    spark = base.sparkSession
    last = F.col("source").asc_nulls_last()
    found = base.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n"))
    found = written(found.repartitionByRange(last).sortWithinPartitions(last).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part, before = F.shiftright("at", 33).cast("int"), []
    for r in sorted(found.groupBy(part.alias("part")).count().collect()):
        before.append((r["part"], sum(x[2] for x in before[-1:]) + (before[-1][1] if before else 0), r["count"]))
    starts = spark.createDataFrame([x[:2] for x in before], "part int, before long")
    found = found.withColumn("part", part).join(starts, "part").withColumn("nth", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    found = found.select("source", "source_size", "n", "nth", weight.alias("weight"))
    # the share of a weight of 1, which rises while sources reach their most
    share, capped = 0.0, -1
    while True:
        above = F.col("weight") * share > most * F.col("source_size")
        free = ~above & (F.col("source_size") > 0)
        r = found.agg(F.sum("source_size"), F.sum(F.when(above, most * F.col("source_size"))), F.sum(F.when(free, F.col("weight"))), F.count_if(above & (F.col("source_size") > 0))).first()
        if r[3] == capped or not r[2]:
            break
        capped, share = r[3], (float(r[0]) - float(r[1] or 0)) / float(r[2])
    return found.withColumn("target", F.least(F.col("weight") * share, most * F.col("source_size").cast("double")))


def decide(df: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """row, doc_id, source, size, source_size, target, copies (how often the mix takes it) and taken (words) of each row of ``df``.

    ``row`` is the column of that name where ``df`` has one (a number of the row), else a number made here.
    """
    row = F.col("row") if "row" in df.columns else F.monotonically_increasing_id()
    base = df.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("same"))
    # rows without an id are told apart by their number
    draw = F.when(F.col("doc_id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("doc_id", "same"))
    base = written(base.withColumn("draw", draw).drop("same"), "mix-base")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    plan = source_plan(base, weights, most).withColumn("sure", F.floor(rate + EPS).cast("int"))
    plan = plan.select(F.col("source").alias("of"), "nth", "source_size", "target", "sure", F.greatest(F.lit(0.0), rate - F.col("sure")).alias("pi"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    plan = written(plan, "mix-plan")
    rows = base.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("block", F.pmod("draw", F.col("blocks")).cast("int")).withColumn("spare", F.lit(False))
    most_blocks, level, done = plan.agg(F.max("blocks")).first()[0] or 1, 0, []
    goes_on = ((F.col("pi") > EPS) & (F.col("pi") < 1 - EPS)) | F.col("spare")
    while True:
        flown = written(_fly(rows, level), "mix-flown")
        if most_blocks <= 1:
            done.append(flown)
            break
        done.append(flown.filter(~goes_on))
        most_blocks, level = -(-most_blocks // GATHER), level + 1
        rows = flown.filter(goes_on).withColumns({"blocks": F.ceil(F.col("blocks") / GATHER).cast("int"), "block": F.floor(F.col("block") / GATHER).cast("int")})
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("sure") + F.round("pi")).cast("int")
    return out.select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def _packed_copies(made: DataFrame) -> dict[int, np.ndarray]:
    """Copies of each row by its number: of each partition (the upper bits) an array over the rows in it (the lower bits), a byte each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            part, at, copies = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for p in np.unique(part).tolist():
                held.setdefault(p, []).append(np.stack([at[part == p], copies[part == p]], 1))
        for p, pieces in held.items():
            found = np.concatenate(pieces)
            out = np.zeros(int(found[:, 0].max()) + 1, np.uint8)
            out[found[:, 0]] = found[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], ["part", "copies"])

    rows = made.select(F.shiftright("row", 33).cast("int").alias("part"), F.col("row").bitwiseAND((1 << 33) - 1).alias("at"), F.col("copies").cast("long").alias("copies"))
    found = rows.repartition("part").mapInArrow(work, "part int, copies binary").collect()
    return {r["part"]: np.frombuffer(zlib.decompress(r["copies"]), np.uint8) for r in found}


def mix(df: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed rows: each row of ``df`` (doc_id, text, source, ...) as often as it is taken, with the columns of ``df``.

    The rows are written with a number each, by which they meet their copies, so rows without an id or with the same one stay apart. Up to
    ``SENT`` rows the numbers of copies, a byte each, are sent to the rows, and no text moves; beyond, rows and copies are joined.
    """
    kept = written(df.select(F.struct(*(f"`{c}`" for c in df.columns)).alias("whole"), F.monotonically_increasing_id().alias("row")), "mix-rows")
    made = decide(kept.select("row", "whole.doc_id", "whole.source", "whole.text"), weights, most)
    if made.count() <= SENT:
        copies = df.sparkSession.sparkContext.broadcast(_packed_copies(made))  # SENT bytes at most

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row = batch.column(1).to_numpy()
                part, at = row >> 33, row & ((1 << 33) - 1)
                n = np.zeros(len(row), np.int64)
                for p in np.unique(part).tolist():
                    n[part == p] = copies.value[p][at[part == p]]
                times = np.repeat(np.arange(len(row)), n)
                # no more bytes at once than the batch had
                for k in range(0, len(times), max(1, len(row))):
                    yield batch.select(["whole"]).take(pa.array(times[k : k + len(row)]))

        taken = kept.mapInArrow(work, kept.select("whole").schema)
    else:
        taken = kept.join(made.filter("copies > 0").select("row", "copies"), "row").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return reading(taken.select(*(F.col("whole").getField(c).alias(c) for c in df.columns)), kept)


def op7_cube_mix(spark, sf_dir: str) -> DataFrame:
    """All documents mixed: sources by code point weigh 1, 2, 3, repeating, and share as many words as there are."""
    return decide(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
