"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly; a group goes where the dot product of its load with
a shard's residual capacity is highest.

A group is all rows of one text. Light groups are first gathered in a fixed number of cells by the hash of their text, so what the
driver packs is bounded by parameters: ``CELLS`` cells a shard, at most three times ``HEAVY`` heavy groups a shard, and the pieces of
those. Only a group that exceeds a whole shard (in bytes, tokens or rows) is dealt in pieces, of a ``PIECES``-th of a shard at most.

Cases. Null text counts as empty, 16 bytes and no token. Null ids and repeated rows are placed like any others and get slots of their
own. Empty tables give no rows. Columns besides doc_id and text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageline.llm.common import documents, n_words, written

SHARDS = 40
CELLS = 200
HEAVY = 50
PIECES = 4
#: Rows that one task numbers, about.
NUMBERED = 250_000


def pack(loads: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each load (rows x dimensions, as shares of the whole): largest first, each where load . residual is highest.

    Ties go to the lowest shard, so equal input gives equal output.
    """
    residual = np.full((shards, loads.shape[1]), 1.0 / shards)
    out = np.zeros(len(loads), np.int64)
    for i in np.argsort(-loads.max(axis=1), kind="stable"):
        k = int(np.argmax(residual @ loads[i]))
        residual[k] -= loads[i]
        out[i] = k
    return out


def shard_rows(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, n_tokens, shard and slot of each row of ``df`` (doc_id, text)."""
    spark = df.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = written(
        df.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            n_words(F.col("text")).alias("n_tokens"),
            F.md5(text.cast("binary")).alias("key"),
            # tells rows apart that share an id or have none; the table is written, so it stays what it is
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-base",
    )
    whole = base.agg(F.sum("size"), F.sum("n_tokens"), F.count("*")).first()
    total = np.array([max(float(x or 0), 1.0) for x in whole])
    sums = [F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")]
    share = F.greatest(*(F.col(c) / F.lit(t) for c, t in zip(("bytes", "tokens", "rows"), total.tolist(), strict=True)))
    heavy = base.groupBy("key").agg(*sums).withColumn("share", share).filter(F.col("share") > 1.0 / (shards * HEAVY)).select("key", "share").collect()
    pieces = [(r.key, math.ceil(r.share * shards * PIECES) if r.share * shards > 1 else 1) for r in heavy]
    if pieces:
        # at most 3 x HEAVY x shards rows, whatever the table holds
        base = base.join(F.broadcast(spark.createDataFrame(pieces, "key string, pieces int")), "key", "left")
    else:
        base = base.withColumn("pieces", F.lit(None).cast("int"))
    item = F.when(F.col("pieces").isNotNull(), F.concat("key", F.lit("/"), F.pmod(F.xxhash64("doc_id", "row"), F.col("pieces")))).otherwise(
        F.concat(F.lit("cell"), F.pmod(F.xxhash64("key"), F.lit(CELLS * shards)))
    )
    base = base.withColumn("item", item)
    found = sorted(base.groupBy("item").agg(*sums).collect())
    loads = np.array([[r.bytes, r.tokens, r.rows] for r in found], float).reshape(-1, 3) / total
    placed = [(r.item, int(k)) for r, k in zip(found, pack(loads, shards), strict=True)]
    dealt = base.join(F.broadcast(spark.createDataFrame(placed, "item string, shard int")), "item")
    # rows with an id are dealt alike however the table is read; those without by their number
    draw = F.when(F.col("doc_id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("doc_id", "text_crc32"))
    subs = max(16, math.ceil(float(whole[2]) / (shards * NUMBERED)))
    dealt = dealt.withColumn("sub", F.pmod(draw, F.lit(subs)))
    before = dealt.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    before = before.select("shard", "sub", (F.sum("n").over(Window.partitionBy("shard").orderBy("sub")) - F.col("n")).alias("before"))
    order = Window.partitionBy("shard", "sub").orderBy("doc_id", "key", "row")
    numbered = dealt.withColumn("nth", F.row_number().over(order)).join(before, ["shard", "sub"])
    return numbered.select("doc_id", "size", "text_crc32", "n_tokens", "shard", (F.col("before") + F.col("nth") - 1).alias("slot"))


def op10_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law ``bytes``."""
    rows = shard_rows(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")
