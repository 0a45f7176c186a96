"""Ranks over a whole table without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintflow.sources.tables import stored


def global_rank(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with its rank from 0 in `order` (ties in any order) in column `name`.

    Rows are dealt by ranges, sorted there and stored; a rank is the place in the range plus the rows of the ranges
    before, a table of one row a range that every task may get. The result is the same for any number of ranges.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The id of a row is its range times 2**33 plus its place there.
    kept = stored(spark, df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    kept = kept.withColumn("__range", F.shiftright("__at", 33))
    before = kept.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__n", F.sum("__n").over(Window.orderBy("__range")) - F.col("__n"))
    return kept.join(F.broadcast(before), "__range").withColumn(name, F.col("__n") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__range", "__at", "__n")
