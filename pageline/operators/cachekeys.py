"""Content-addressed keys, and which work they save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def short_hash(value: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(value.cast("binary"), 256), 1, length)


def page_key(*parts: Column) -> Column:
    """Of prompt, its version, model and settings: parts with NUL between them."""
    return short_hash(F.concat_ws("\0", *(p.cast("string") for p in parts)), 24)


def ranking_key(*parts: Column) -> Column:
    """As ``page_key``, with a NUL behind the last part too."""
    return short_hash(F.concat(F.concat_ws("\0", *(p.cast("string") for p in parts)), F.lit("\0")), 24)


def hits(work: DataFrame, index: DataFrame, key: str = "cache_key") -> DataFrame:
    return work.join(index, key)


def misses(work: DataFrame, index: DataFrame, key: str = "cache_key") -> DataFrame:
    return work.join(index.select(key), key, "left_anti")
