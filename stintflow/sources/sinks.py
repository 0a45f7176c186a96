"""Writers: partitioned layers, checked swaps, JSON lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stintflow.operators.profile import require


def write_layer(df: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = ("season", "gp", "session")) -> None:
    """Zstd Parquet below season=..., the rows of a session together in few files. Only the seasons at hand are replaced."""
    spread = [c for c in by if c in df.columns]
    out = df.repartition(*spread) if spread else df
    writer = out.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy("season") if "season" in df.columns else writer).parquet(path)


def covers(spark: SparkSession, path: str, seasons: list[str]) -> bool:
    """Whether a stored table is there and has all listed seasons."""
    from pyspark.errors import AnalysisException

    try:
        have = {str(r[0]) for r in spark.read.parquet(path).select("season").distinct().collect()}
    except AnalysisException:
        return False
    return set(map(str, seasons)) <= have


def reuse_or_build(spark: SparkSession, path: str, seasons: list[str], build) -> DataFrame:
    """The stored table restricted to the seasons if it covers them, else build() stored and read again."""
    if not covers(spark, path, seasons):
        write_layer(build(), path)
    return spark.read.parquet(path).filter(F.col("season").cast("string").isin([str(s) for s in seasons]))


def checked_export(df: DataFrame, path: str, columns: list[str], rows: int | None = None) -> None:
    """Write aside, check the written rows and columns, then swap the directories; a failed check leaves the old table."""
    spark = df.sparkSession
    aside, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    require(spark.read.parquet(aside), columns, rows)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(conf)
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    fs.rename(p(aside), p(path))
    if fs.exists(p(old)):
        fs.delete(p(old), True)


def to_json_lines(df: DataFrame) -> DataFrame:
    """One canonical JSON object a row: columns by name, nulls kept."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    to_json_lines(df).write.mode("overwrite").text(path)


def replace_sessions(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows of all sessions but the fresh ones, and the fresh rows."""
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


class StepCounts:
    """Rows and columns of the steps of a job, counted while it runs: to see where rows or columns get lost.

    watch() each step's frame and go on with what it returns; once an action on the last one has ended, rows() has what
    this very run has seen. Nothing is computed again.
    """

    def __init__(self) -> None:
        self.steps: list[tuple[str, int, Observation]] = []

    def watch(self, step: str, df: DataFrame) -> DataFrame:
        seen = Observation()
        self.steps.append((step, len(df.columns), seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def rows(self) -> list[tuple[str, int, int]]:
        """(step, rows, columns), in the order of the steps. It waits for the action."""
        return [(step, seen.get["rows"], columns) for step, columns, seen in self.steps]


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name, missing columns as nulls."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def synthetic_laps(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """n laps from a formula and noise keyed by the row: the same on any partitioning."""
    from stintflow.functions.scalars import keyed_normal

    i = F.col("id")
    return spark.range(n).select((i % 20).cast("string").alias("driver"), (F.floor(i / 20) % 60 + 1).cast("int").alias("lap"), (F.floor(i / 1200) + 2021).cast("string").alias("season"), F.element_at(F.array(F.lit("SOFT"), F.lit("MEDIUM"), F.lit("HARD")), (i % 3 + 1).cast("int")).alias("compound"), (90 + 0.05 * (F.floor(i / 20) % 20) + 0.3 * keyed_normal(F.lit(seed), i)).alias("laptime"))
