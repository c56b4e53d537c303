"""A second run works on new pages alone, gives what one run over all would give, and never exchanges the cache."""

import re
import uuid

from pyspark.sql import functions as F

from pageline.operators.incremental import ResultCache, run


def pages(spark, numbers):
    rows = [(n, f"text {n // 2}" if n % 9 else None) for n in numbers]
    return spark.createDataFrame(rows, "page int, text string").withColumn("key", F.sha2("text", 256))


def test_a_second_run_computes_new_pages_alone(spark):
    cache = ResultCache(spark, f"cache_{uuid.uuid4().hex}", 4)
    worked = []

    def compute(todo):
        worked.append(sorted(r.text for r in todo.collect()))
        return todo.select("key", F.upper("text").alias("result"))

    try:
        first = run(pages(spark, range(40)), cache, compute)
        assert not any(r.hit for r in first.collect())
        second = run(pages(spark, range(44)), cache, compute)
        assert len(worked[0]) == 20 and worked[1] == ["text 20", "text 21"]
        got = {r.page: (r.result, r.hit) for r in second.collect()}
        assert got == {n: (f"TEXT {n // 2}" if n % 9 else None, n < 40 and n % 9 != 0) for n in range(44)}
        third = run(pages(spark, range(44)), cache, compute)
        assert worked[2] == [] and sum(r.hit for r in third.collect()) == sum(n % 9 != 0 for n in range(44))
        for df in (cache.misses(pages(spark, range(50))), cache.get(pages(spark, range(50)))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            cached = plan[plan.index("Bucketed: true") - 400 :]
            assert "SortMergeJoin" in plan and not re.search(r"Exchange[^\n]*\n[^\n]*(Project|Filter|ColumnarToRow|FileScan)[^\n]*\n[^\n]*FileScan parquet[^\n]*Bucketed: true", plan), cached
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {cache.table}")
