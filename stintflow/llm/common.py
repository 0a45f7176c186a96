"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of the word pattern [^\x20\x09-\x0D]+ as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"
_hash = xxhash.xxh64_intdigest
_FOLDED: list[str] = []
_TABLES: list[str] = []


def words(text: str | None) -> list[bytes]:
    """The UTF-8 words [^\\x20\\x09-\\x0D]+ of a text; bytes.split() cuts at exactly these separators. None has none."""
    return text.encode("utf-8", "replace").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """words() with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def hash_words(ws: list[bytes], seed: int = 0) -> np.ndarray:
    """XXH64 of each word, unsigned."""
    return np.fromiter((_hash(w, seed) for w in ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (the splitmix finaliser)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share.

    A folder is made here only where the session has none, as in local tests.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        sc: SparkContext = spark.sparkContext
        known = sc._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            known = sc._jsc.sc().getCheckpointDir()
        where = known.get()
    return where.rstrip("/")


def fold(spark: SparkSession, df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there and each task runs once.

    (checkpoint() runs its last stage twice, once to count and once to write.) The tables stay until remove_folded().
    """
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _FOLDED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(spark: SparkSession, df: DataFrame, key: str, n: int, name: str = "table") -> DataFrame:
    """df as a table of n buckets by key in the shared folder: groups and cogroups by key then read it without a shuffle.

    Rows are shuffled once, to one task and one file a bucket. The table stays until remove_folded().
    """
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    df.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd").option("path", path).saveAsTable(table)
    _FOLDED.append(path)
    _TABLES.append(table)
    return spark.table(table)


def remove_folded(spark: SparkSession) -> int:
    """Delete the tables that fold() and bucketed() have written in this process; call it when no result that reads them is
    needed."""
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_FOLDED)
    while _FOLDED:
        path = jvm.org.apache.hadoop.fs.Path(_FOLDED.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def free_name(df: DataFrame, base: str) -> str:
    """base, with underscores behind it until no column of df has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of all columns of a row; maps count by their sorted entries."""
    named = [F.col(f"`{f.name}`") if f.dataType.typeName() != "map" else F.sort_array(F.map_entries(f"`{f.name}`")) for f in df.schema]
    return F.xxhash64(*named), F.xxhash64(F.lit(1), *named)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def empty_like(df: DataFrame) -> DataFrame:
    return df.filter(F.lit(False))
