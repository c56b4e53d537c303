"""Running values within a key, in two levels: blocks of rows are scanned, block totals are scanned, and what comes before is carried in.

A key that fits a block takes a plain window. The rows of longer ones (``BLOCK`` rows and more; there are few such keys, the table holds
that many times fewer of them) are numbered by ranges, cut into blocks and scanned block by block, so no task holds more than a block, even
where one key has half of all rows. The carried row stands first in its block: one window sees both, and no join meets a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageline.sources.scratch import reading, written

BLOCK = 1 << 16
_ROW_BITS = 33


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """The rows of ``df`` with nth_of_all (from 1) in the given order: ranges are sorted apart, and what comes before each is added.

    Rows that ``order`` doesn't tell apart share a range, in any order.
    """
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_at")), "numbered")
    part, at = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    # a row for each range
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    out = dealt.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("nth_of_all", F.col("_before") + at + 1)
    return reading(out.drop("_part", "_at", "_before"), dealt)


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return [a[k].eqNullSafe(b[k]) for k in keys]


def by_length(df: DataFrame, keys: Sequence[str], short: Callable[[DataFrame], DataFrame], long: Callable[[DataFrame], DataFrame], block: int | None = None) -> DataFrame:
    """``short`` over the rows of all keys of up to ``block`` rows, ``long`` over the others."""
    found = written(df.groupBy(*keys).count().filter(F.col("count") > (block or BLOCK)).select(*keys), "long-keys")
    if found.isEmpty():
        return short(df)
    a, b = short(df.join(found, _same(df, found, keys), "left_anti")), long(df.join(found, _same(df, found, keys), "left_semi"))
    return reading(a.unionByName(b), found, *getattr(b, "_reads", ()))


def blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: int | None = None) -> DataFrame:
    """The rows with _nth, their number in the order of keys and ``order``, and _block, which holds ``block`` numbers."""
    rows = numbered(df, *(F.asc(k) for k in keys), *order)
    cut = rows.withColumnRenamed("nth_of_all", "_nth").withColumn("_block", F.floor((F.col("_nth") - 1) / (block or BLOCK)))
    return reading(cut, *rows._reads)


def carried(rows: DataFrame, keys: Sequence[str], totals: dict[str, Column], scan: Callable[[str, Window], Column]) -> DataFrame:
    """``rows`` and, in front of each block's, one with what ``scan`` makes of the ``totals`` of the blocks before; _carried tells them apart."""
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = rows.groupBy(*keys, "_block").agg(*(c.alias(n) for n, c in totals.items()))
    carry = total.select(*keys, "_block", *(scan(n, before).alias(n) for n in totals), F.lit(True).alias("_carried"))
    return rows.withColumn("_carried", F.lit(False)).unionByName(carry, allowMissingColumns=True)


def _in_block(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, "_block").orderBy(F.desc("_carried"), "_nth")


def lagged(rows: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Blocks with ``value`` of the row before within the key, or null."""
    rows = rows.withColumn(name, F.struct(value.alias("v")))
    both = carried(rows, keys, {name: F.max_by(name, "_nth")}, lambda n, w: F.last(n).over(w))
    return both.withColumn(name, F.lag(name).over(_in_block(keys))).filter(~F.col("_carried")).withColumn(name, F.col(name)["v"]).drop("_carried")


def running(rows: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Blocks with the running sum of each of ``values`` within the key."""
    rows = rows.withColumns(values)
    both = carried(rows, keys, {n: F.sum(n) for n in values}, lambda n, w: F.sum(n).over(w))
    so_far = _in_block(keys).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({n: F.sum(n).over(so_far) for n in values}).filter(~F.col("_carried")).drop("_carried")


def _last(column: Column | str) -> Column:
    return F.last(column, ignorenulls=True)


def known_before(rows: DataFrame, keys: Sequence[str], value: Column, name: str, largest: bool = False) -> DataFrame:
    """Blocks with the last value before each row, within the key, that is not null; or with the ``largest``."""
    rows = rows.withColumn(name, value)
    total = F.max(name) if largest else F.max_by(name, F.when(F.col(name).isNotNull(), F.col("_nth")))
    scan = F.max if largest else _last
    both = carried(rows, keys, {name: total}, lambda n, w: scan(n).over(w))
    before = _in_block(keys).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(name, scan(name).over(before)).filter(~F.col("_carried")).drop("_carried")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: dict[str, Column], block: int | None = None) -> DataFrame:
    """``df`` with running sums within each key, in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def long(rows: DataFrame) -> DataFrame:
        cut = blocks(rows, keys, order, block)
        return reading(running(cut, keys, values).drop("_nth", "_block"), *cut._reads)

    return by_length(df, keys, lambda rows: rows.withColumns({n: F.sum(c).over(w) for n, c in values.items()}), long, block)


def before(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str, largest: bool = False, block: int | None = None) -> DataFrame:
    """``df`` with the last value before each row, within the key and in ``order``, that is not null; or with the ``largest``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def long(rows: DataFrame) -> DataFrame:
        cut = blocks(rows, keys, order, block)
        return reading(known_before(cut, keys, value, name, largest).drop("_nth", "_block"), *cut._reads)

    return by_length(df, keys, lambda rows: rows.withColumn(name, (F.max if largest else _last)(value).over(w)), long, block)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[Column], previous: Column, breaks: Column, name: str, block: int | None = None) -> DataFrame:
    """``df`` with a number, from 1, of the island each row belongs to; ``breaks``, over the row and ``_prev`` (``previous`` of the row before
    it, null for the first), says where a new one begins (null: it does)."""
    flag = F.coalesce(breaks, F.lit(True)).cast("int")
    w = Window.partitionBy(*keys).orderBy(*order)

    def short(rows: DataFrame) -> DataFrame:
        told = rows.withColumn("_prev", F.lag(previous).over(w))
        return told.withColumn(name, F.sum(flag).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_prev")

    def long(rows: DataFrame) -> DataFrame:
        cut = blocks(rows, keys, order, block)
        # read twice, for the totals and for the scan
        told = written(lagged(cut, keys, previous, "_prev").withColumn(name, flag).drop("_prev"), "island-breaks")
        out = running(told, keys, {name: F.col(name)}).withColumn(name, F.col(name).cast("int"))
        return reading(out.drop("_nth", "_block"), told, *cut._reads)

    return by_length(df, keys, short, long, block)
