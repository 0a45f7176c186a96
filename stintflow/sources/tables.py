"""Tables between the steps of a job, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STORED: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where the session has none, as in local tests, one is made and set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        sc = spark.sparkContext
        known = sc._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            known = sc._jsc.sc().getCheckpointDir()
        where = known.get()
    return where.rstrip("/")


def stored(spark: SparkSession, df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: what several steps read is computed once, and a lost executor
    costs a read. The tables stay until remove_stored()."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession) -> int:
    """Delete the tables that stored() has written in this process; call it when no result that reads them is needed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_STORED)
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
