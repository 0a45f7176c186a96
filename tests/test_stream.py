"""The lap stream against its batch twin: laps in any order, restarts, replay, watermarks."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from stintflow.sources import replay
from stintflow.sources.readers import lap_feed
from stintflow.streaming import live

LAPS = "race string, driver string, lap int, laptime double, compound string, stint int, track_temp double, probability double, life double, at timestamp"
T0 = dt.datetime(2024, 5, 1, 12, 0, 0)


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def race(driver, n=12):
    return [("r", driver, k, 90.0 + (k * 7 % 5) * 0.7 + (3 if k > 8 else 0), "SOFT" if k < 6 else "HARD", None, 30.0 + k, 0.9 if k in (4, 5, 9, 10) else 0.1, 10.0, T0 + dt.timedelta(minutes=k)) for k in range(1, n + 1)]


def numbers(df):
    return {(r.driver, r.lap): (r.stint_no, r.laps_into_stint, round(r.fuel_corr, 6), round(r.pace_above_best, 6), round(r.slope, 6), r.in_cliff_now) for r in df.collect()}


def run(spark, stream, tmp_path, **how):
    q = live.snapshots(stream, **how).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return q, spark.read.parquet(str(tmp_path / "out"))


def files(spark, tmp_path, batches):
    """One file a micro-batch, in the order of their times."""
    src = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, LAPS).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    return spark.readStream.schema(spark.createDataFrame([], LAPS).schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_laps_out_of_order_across_batches_give_the_batch_rows(spark, tmp_path):
    rows = race("a") + race("b")
    random.Random(2).shuffle(rows)
    dull = [("r", "a", None, 90.0, "SOFT", None, None, None, None, T0), ("r", "a", 5, None, "SOFT", None, None, None, None, T0)]
    stream = files(spark, tmp_path, [rows[:9] + dull, rows[9:15], rows[15:]])
    _, out = run(spark, stream, tmp_path)
    got = live.latest(out)
    want = live.batch_snapshots(spark.createDataFrame(rows, LAPS), ["race", "driver"])
    assert numbers(got) == numbers(want) and got.count() == 24
    assert out.count() > 24 and out.agg(F.max("revision")).first()[0] == 3
    assert {(r.driver, r.lap): r.alert for r in got.collect() if r.alert} == {(d, k): "trigger" for d in "ab" for k in (5, 10)}
    assert live.decision_state(got).columns[2] == "cur_lap"


def test_a_lap_that_comes_again_replaces_the_first(spark, tmp_path):
    rows = race("a", 4)
    again = [(*rows[1][:3], 80.0, *rows[1][4:])]
    _, out = run(spark, files(spark, tmp_path, [rows, again]), tmp_path)
    want = live.batch_snapshots(spark.createDataFrame([rows[0], *again, *rows[2:]], LAPS), ["race", "driver"])
    assert numbers(live.latest(out)) == numbers(want)


def test_state_goes_by_event_time_and_late_rows_are_counted(spark, tmp_path):
    old, new = race("a", 3), [(*r[:9], r[9] + dt.timedelta(hours=5)) for r in race("b", 3)]
    late = [(*r[:9], T0) for r in race("a", 5)[3:]]
    stream = files(spark, tmp_path, [old, new, new, late]).withWatermark("at", "1 minute")
    q, out = run(spark, stream, tmp_path, keep=600)
    assert live.dropped_rows(q) == 2
    assert {(r.driver, r.lap) for r in live.latest(out).collect()} == {(d, k) for d in "ab" for k in (1, 2, 3)}


def feed(spark, path, laps, mode="append"):
    rows = [("r", 7, k, 90.0 + k % 3, "SOFT" if k < 5 else None, 1, 30.0, T0 + dt.timedelta(minutes=k)) for k in laps]
    rows += [("r", 8, k, None if k == 2 else 91.0, "HARD", 1, None, T0) for k in laps]
    spark.createDataFrame(rows, replay.FEED).repartition(2).write.mode(mode).parquet(path)


def test_replay_goes_on_from_its_checkpoint_without_loss_or_repeats(spark, tmp_path):
    replay.register(spark)
    src = str(tmp_path / "feed")

    def laps(**options):
        rows = spark.readStream.format("lap_replay").option("path", src).options(**options).load()
        return lap_feed(rows).withColumns({"race": F.lit("r"), "probability": F.lit(None).cast("double"), "life": F.lit(None).cast("double")})

    def run_until_done(**options):
        q = live.snapshots(laps(**options)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).start()
        q.processAllAvailable()
        done = q.recentProgress
        q.stop()
        return sum(p.numInputRows for p in done)

    feed(spark, src, range(1, 8))
    assert run_until_done() == 14
    assert run_until_done() == 0
    feed(spark, src, range(8, 13))
    assert run_until_done() == 10
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == live.latest(out).count() == 23  # in order: no snapshot came twice, and one lap has no time
    want = lap_feed(spark.read.parquet(src)).withColumn("race", F.lit("r"))
    assert numbers(live.latest(out)) == numbers(live.batch_snapshots(want, ["race", "driver"]))


def test_replay_offsets_follow_the_clock(spark, tmp_path):
    src = str(tmp_path / "feed")
    feed(spark, src, range(1, 8), "overwrite")
    reader = lambda seconds: replay.LapReplayReader({"path": src, "laps_per_second": "1", "begin": str(time.time() - seconds)})
    assert [reader(s).latestOffset()["lap"] for s in (-5, 0.5, 3.5, 99)] == [0, 0, 3, 7]
    r = reader(99)
    parts = r.partitions({"lap": 2}, {"lap": 4})
    assert sorted(x for p in parts for b in r.read(p) for x in b.column(2).to_pylist()) == [3, 3, 4, 4]
