"""A recorded feed of laps as a stream: a Python data source with offsets."""

from __future__ import annotations

import glob
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FEED = "race string, driver_number int, lap_number int, lap_duration double, compound string, stint_number int, track_temp double, at timestamp"
_ARROW = pa.schema([("race", pa.string()), ("driver_number", pa.int32()), ("lap_number", pa.int32()), ("lap_duration", pa.float64()), ("compound", pa.string()), ("stint_number", pa.int32()), ("track_temp", pa.float64()), ("at", pa.timestamp("us", tz="UTC"))])


@dataclass
class Slice(InputPartition):
    """The laps (start, end] of one file."""

    path: str
    start: int
    end: int


class LapReplayReader(DataSourceStreamReader):
    """Replays a Parquet table of feed rows lap by lap: an offset is a lap number, a micro-batch the laps since the last one.

    What is out is a function of the offset alone, so a query that starts again from its checkpoint goes on where it was,
    without loss or repeats. With laps_per_second, lap n comes n / laps_per_second seconds after `begin` (seconds since
    1970); without it, all laps of the table are there. Each file is read by a task of its own, only the laps that it
    needs. The folder must be one that all machines can open; rows without a lap number never come.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.rate, self.begin = float(options.get("laps_per_second", 0)), float(options.get("begin", 0))

    def files(self) -> list[str]:
        return sorted(glob.glob(os.path.join(self.path, "*.parquet"))) if os.path.isdir(self.path) else [self.path]

    def last_lap(self) -> int:
        found = [pc.max(pq.read_table(f, columns=["lap_number"]).column(0)).as_py() for f in self.files()]
        return max([0, *(x for x in found if x is not None)])

    def initialOffset(self) -> dict:
        return {"lap": 0}

    def latestOffset(self) -> dict:
        due = int((time.time() - self.begin) * self.rate) if self.rate else None
        return {"lap": self.last_lap() if due is None else max(0, min(self.last_lap(), due))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Slice(f, start["lap"], end["lap"]) for f in self.files()]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        rows = pq.read_table(partition.path, columns=_ARROW.names, filters=[("lap_number", ">", partition.start), ("lap_number", "<=", partition.end)])
        yield from rows.cast(_ARROW).combine_chunks().to_batches()

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class LapReplay(DataSource):
    """spark.readStream.format("lap_replay").option("path", ...)"""

    @classmethod
    def name(cls) -> str:
        return "lap_replay"

    def schema(self) -> str:
        return FEED

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LapReplayReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LapReplay)
