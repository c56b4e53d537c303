"""Incremental runs: results are kept by key in a bucketed table, and only pages whose key it lacks are worked on.

The table is bucketed and sorted by key, so pages meet it bucket by bucket: they are exchanged, the cache, however large, is not. What was
found and what was made leave by one way, out of the table, so a second run gives what the first one gave.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageline.sources.scratch import forget, written


class ResultCache:
    """A table of results by ``key`` (a string), in so many buckets; made with the first results that are put in.

    The number of buckets is fixed with the table: choose it for the size that the table will have, some 100 to 200 MB a bucket.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 32):
        self.spark, self.table, self.buckets = spark, table, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def _met(self, pages: DataFrame) -> DataFrame:
        """Pages where their bucket's task has them."""
        return pages.repartition(self.buckets, "key")

    def misses(self, pages: DataFrame) -> DataFrame:
        """The pages (key, ...) whose key the table lacks; one page of each key."""
        new = pages.filter("key is not null").dropDuplicates(["key"])
        return self._met(new).join(self.spark.table(self.table).select("key").hint("merge"), "key", "left_anti") if self.exists() else new

    def put(self, results: DataFrame) -> None:
        results.write.bucketBy(self.buckets, "key").sortBy("key").mode("append").format("parquet").saveAsTable(self.table)

    def get(self, pages: DataFrame) -> DataFrame:
        """The pages with their results; those without a result keep nulls."""
        return self._met(pages).join(self.spark.table(self.table).hint("merge"), "key", "left")


def run(pages: DataFrame, cache: ResultCache, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``pages`` (key, ...) with hit, whether the cache had them before, and their results. ``compute`` gets the pages it lacked and returns
    key and results, whose names must not be those of the pages' columns.

    A run that was cut off has put in nothing or all it made, and may be run again. Pages without a key are never cached, nor computed.
    """
    todo = written(cache.misses(pages), "cache-misses")
    made = written(compute(todo).withColumn("cached_at", F.current_timestamp()), "cache-made")
    cache.put(made)
    seen = todo.select("key", F.lit(True).alias("_new"))
    out = written(cache.get(pages).join(seen, "key", "left").withColumn("hit", F.col("_new").isNull() & F.col("cached_at").isNotNull()).drop("_new", "cached_at"), "incremental")
    forget(todo, made)
    return out
