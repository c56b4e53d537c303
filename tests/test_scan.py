"""Running values of short and long keys against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from pageline.operators import scan


@pytest.fixture(scope="module")
def rows():
    """One key with half of all rows, null keys, keys of one row, ties in the first column of the order."""
    rng = random.Random(2)
    return [(rng.choice(("hot", "hot", "hot", "a", "b", None, f"k{i}")), rng.randrange(40), i, rng.choice((None, 1, 2, 5))) for i in range(900)]




def order():
    return [F.asc("t"), F.asc("i")]


def by_key(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        found.setdefault(r[0], []).append(r)
    return found


@pytest.mark.parametrize("block", (1, 7, 100, 10_000))
def test_sums_last_values_and_islands(spark, rows, block):
    df = spark.createDataFrame(rows, "k string, t int, i int, v int")
    sums, lasts, isles, most = {}, {}, {}, {}
    for mine in by_key(rows).values():
        total, last, n, prev = None, None, 0, None
        for r in mine:
            lasts[r[2]] = last
            most[r[2]] = max((x[3] for x in mine[: mine.index(r)] if x[3] is not None), default=None)
            last = r[3] if r[3] is not None else last
            total = total if r[3] is None else (total or 0) + r[3]
            sums[r[2]] = total
            n += prev is None or prev[3] is None or r[3] is None or abs(r[3] - prev[3]) > 1
            isles[r[2]] = n
            prev = r
    got = scan.running_sum(df, ["k"], order(), {"s": F.col("v")}, block)
    assert {r.i: r.s for r in got.collect()} == sums and set(got.columns) == {"k", "t", "i", "v", "s"}
    assert {r.i: r["last"] for r in scan.before(df, ["k"], order(), F.col("v"), "last", block=block).collect()} == lasts
    assert {r.i: r["most"] for r in scan.before(df, ["k"], order(), F.col("v"), "most", True, block).collect()} == most
    got = scan.islands(df, ["k"], order(), F.struct("v"), F.abs(F.col("v") - F.col("_prev.v")) > 1, "isle", block)
    assert {r.i: r.isle for r in got.collect()} == isles and "_prev" not in got.columns


def test_no_task_holds_more_than_a_block(spark, rows):
    df = spark.createDataFrame([("hot", 0, i, 1) for i in range(4000)], "k string, t int, i int, v int")
    cut = scan.blocks(df, ["k"], order(), 100)
    assert cut.groupBy("_block").count().agg(F.max("count")).first()[0] == 100
    plan = scan.running(cut, ["k"], {"s": F.col("v")})._jdf.queryExecution().executedPlan().toString()
    # the only window over whole keys is that of the block totals, one row a block
    assert plan.count("hashpartitioning(k") >= 2 and "rangepartitioning" not in plan
    assert scan.running_sum(df, ["k"], order(), {"s": F.col("v")}, 100).agg(F.max("s")).first()[0] == 4000


def test_short_keys_take_one_window(spark, rows):
    df = spark.createDataFrame(rows, "k string, t int, i int, v int")
    plan = scan.running_sum(df, ["k"], order(), {"s": F.col("v")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
