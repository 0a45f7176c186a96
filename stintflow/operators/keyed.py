"""User functions by record and by key, for what built-in expressions can't say."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat_map(df: DataFrame, fn: Callable[[pd.DataFrame], Iterable[pd.DataFrame]], schema: str) -> DataFrame:
    """fn on Arrow batches: none, one or several rows for each."""

    def run(batches):
        for b in batches:
            yield from fn(b)

    return df.mapInPandas(run, schema)


def reduce_by_key(df: DataFrame, keys: list[str], fn: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn on the rows of a key. The rows must fit one task: combine first where a key is large."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def combined(df: DataFrame, keys: list[str], combine: list[Column], merge: list[Column], salts: int = 16) -> DataFrame:
    """Two-level aggregation with an associative combiner: by key and salt first, then by key. A hot key's rows are split
    over `salts` tasks; merge's columns refer to combine's names."""
    first = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts))).groupBy(*keys, "__salt").agg(*combine)
    return first.groupBy(*keys).agg(*merge)


def conservation(before: DataFrame, after: DataFrame, keys: list[str], count: str) -> DataFrame:
    """(emitted, received, keys_in_several_rows, keys_in_several_partitions): whether an aggregate kept every record, has one
    row a key, and has each key in one partition, as its rows lie when they are read."""
    e = before.agg(F.count("*").alias("emitted"))
    by = after.withColumn("__p", F.spark_partition_id()).groupBy(*keys).agg(F.count("*").alias("m"), F.countDistinct("__p").alias("p"), F.sum(count).alias("c"))
    several = lambda c: F.coalesce(F.sum((F.col(c) > 1).cast("long")), F.lit(0))
    return e.crossJoin(by.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("received"), several("m").alias("keys_in_several_rows"), several("p").alias("keys_in_several_partitions")))
