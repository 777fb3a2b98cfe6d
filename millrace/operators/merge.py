"""Merging new rows into what earlier runs left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.constants import MERGE_KEY_CHARS


def merge_key(column: str = "text", key: str = "hash") -> Column:
    """What makes two samples the same: the whole text (``hash``, its SHA-256), or, with
    ``prefix``, its first 100 characters. A template header is most of such a prefix, so it also
    drops samples whose text is new."""
    if key == "hash":
        return F.sha2(column, 256)
    if key == "prefix":
        return F.substring(column, 1, MERGE_KEY_CHARS)
    raise ValueError(f"unknown merge key {key!r}")


def incremental_anti_join(new: DataFrame, existing: DataFrame, key: str = "hash") -> DataFrame:
    """Drop new samples whose merge key an existing one has.

    The existing side is cut to distinct keys before it is shuffled, so the join cannot multiply
    rows; a key shared by many new samples is split by the adaptive skew join, which may
    divide the left side of an anti join. Spark broadcasts the keys only below its threshold.
    """
    return without_known(new, existing.select(merge_key(key=key).alias("_key")), merge_key(key=key))


def without_known(new: DataFrame, keys: DataFrame, own: Column) -> DataFrame:
    """New rows whose key is not in the one column of ``keys``."""
    known = keys.toDF("_key").distinct()
    return new.join(known, own == F.col("_key"), "left_anti")


def union_incremental(new: DataFrame, existing: DataFrame, key: str = "hash") -> DataFrame:
    """Existing rows and the surviving new ones; repeats inside either side stay."""
    return existing.unionByName(incremental_anti_join(new, existing, key))


def store_keys(existing: DataFrame, table: str, key: str = "hash", buckets: int = 64) -> DataFrame:
    """Distinct merge keys of existing samples as a table in buckets of the key, sorted. ``without_known`` and joins
    on ``_key`` read such a table as it lies: only the new side is shuffled, and into as many parts."""
    keys = existing.select(merge_key(key=key).alias("_key")).distinct()
    dealt = keys.repartition(buckets, "_key")  # as the buckets are, so that a task writes one file
    dealt.write.mode("overwrite").bucketBy(buckets, "_key").sortBy("_key").saveAsTable(table)
    return existing.sparkSession.table(table)
