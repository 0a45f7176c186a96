"""Lap state per driver, kept on a stream, and its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stintflow.functions.scalars import FUEL_SECONDS_PER_LAP

CLIFF = 1.5
OUT = "race string, driver string, lap int, stint_no int, laps_into_stint int, compound string, fuel_corr double, pace_above_best double, in_cliff_now boolean, slope double, track_temp double, track_temp_mean double, compounds_used array<string>, alert string, revision int"


def batch_snapshots(laps: DataFrame, keys: list[str], lap: str = "lap", laptime: str = "laptime", compound: str = "compound", stint: str | None = None) -> DataFrame:
    """A snapshot per lap by windows: a new stint starts where the compound (or the feed's stint number) changes."""
    w = Window.partitionBy(*keys).orderBy(lap)
    changed: Column = ~F.col(compound).eqNullSafe(F.lag(compound).over(w))
    if stint:
        changed = changed | ~F.col(stint).eqNullSafe(F.lag(stint).over(w))
    df = laps.withColumn("__new", F.when(F.row_number().over(w) == 1, 1).otherwise(changed.cast("int"))).withColumn("stint_no", F.sum("__new").over(w))
    s = Window.partitionBy(*keys, "stint_no").orderBy(lap)
    run = s.rowsBetween(Window.unboundedPreceding, 0)
    y, x = F.col("fuel_corr"), F.col("laps_into_stint").cast("double")
    df = df.withColumns({"laps_into_stint": F.row_number().over(s), "fuel_corr": F.col(laptime) + FUEL_SECONDS_PER_LAP * F.col(lap)})
    df = df.withColumns({"pace_above_best": y - F.min(y).over(run), "__sx": F.sum(x).over(run), "__sy": F.sum(y).over(run), "__sxx": F.sum(x * x).over(run), "__sxy": F.sum(x * y).over(run)})
    slope = F.when(x < 2, 0.0).otherwise(F.try_divide(x * F.col("__sxy") - F.col("__sx") * F.col("__sy"), x * F.col("__sxx") - F.col("__sx") * F.col("__sx")))
    return df.withColumns({"in_cliff_now": F.col("pace_above_best") > CLIFF, "slope": slope}).drop("__new", "__sx", "__sy", "__sxx", "__sxy")


def step(s: dict, row: dict) -> dict:
    """The state after one lap. It holds sums only, so it doesn't grow with the race."""
    compound = (row.get("compound") or s["compound"] or "MEDIUM").upper()
    explicit = row.get("stint")
    fresh = s["n"] == 0 and s["stint_no"] == 0
    if fresh or compound != s["compound"] or (explicit is not None and s["explicit"] is not None and explicit != s["explicit"]):
        s |= {"stint_no": s["stint_no"] + 1, "n": 0, "best": None, "sx": 0.0, "sy": 0.0, "sxx": 0.0, "sxy": 0.0, "above": 0, "ended": False}
    used = s["used"].split(",") if s["used"] else []
    y = row["laptime"] + FUEL_SECONDS_PER_LAP * row["lap"]
    n = s["n"] + 1
    s |= {"lap": row["lap"], "compound": compound, "explicit": explicit if explicit is not None else s["explicit"], "n": n, "best": y if s["best"] is None else min(s["best"], y), "sx": s["sx"] + n, "sy": s["sy"] + y, "sxx": s["sxx"] + n * n, "sxy": s["sxy"] + n * y, "used": ",".join(used if compound in used else [*used, compound])}
    t = row.get("track_temp")
    if t is not None:
        s |= {"temp": t, "t_sum": s["t_sum"] + t, "t_n": s["t_n"] + 1}
    return s


def alert(s: dict, probability: float | None, life: float | None, threshold: float, joint_limit: float, imminent_at: float) -> str | None:
    """The debounced monitor's word for this lap; it falls silent for the stint after a trigger or an imminent end."""
    if probability is None or life is None or s["ended"]:
        return None
    if life <= imminent_at:
        s["ended"] = True
        return "imminent"
    s["above"] = s["above"] + 1 if probability > threshold else 0
    if s["above"] < 2:
        return None
    if life > joint_limit:
        s["above"] = 0
        return "anomaly"
    s["ended"] = True
    return "trigger"


EMPTY = {"lap": 0, "stint_no": 0, "explicit": None, "n": 0, "compound": None, "best": None, "sx": 0.0, "sy": 0.0, "sxx": 0.0, "sxy": 0.0, "temp": None, "t_sum": 0.0, "t_n": 0, "used": "", "above": 0, "ended": False}


class LapState(StatefulProcessor):
    """The laps of one (race, driver), by number, and how often their snapshots were given out.

    A lap that comes late is put in its place: its own snapshot comes out, and those of the laps after it once more, with
    a higher revision. A lap that comes again replaces what came before. The state holds a race's laps, some dozens, and
    goes at the event time of its timer, `keep` after the last lap seen.
    """

    def __init__(self, threshold: float, joint_limit: float, imminent_at: float, keep_ms: int | None):
        self.how, self.keep_ms = (threshold, joint_limit, imminent_at), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.laps = handle.getMapState("laps", "lap int", "laptime double, compound string, stint int, track_temp double, probability double, life double")
        self.revision = handle.getValueState("revision", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, latest = None, None
        for frame in rows:
            plain = frame.astype(object).where(frame.notna(), None)
            for row in plain.to_dict("records"):
                if row["laptime"] is None or row["lap"] is None:
                    continue
                lap = int(row["lap"])
                value = (float(row["laptime"]), row["compound"], None if row["stint"] is None else int(row["stint"]), *[None if row[c] is None else float(row[c]) for c in ("track_temp", "probability", "life")])
                self.laps.updateValue((lap,), value)
                first = lap if first is None else min(first, lap)
                if self.keep_ms is not None and row["at"] is not None:
                    at = int(pd.Timestamp(row["at"]).timestamp() * 1000)
                    latest = at if latest is None else max(latest, at)
        if latest is not None:
            timers = list(self.handle.listTimers())
            if all(t < latest + self.keep_ms for t in timers):
                for t in timers:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(latest + self.keep_ms)
        if first is not None:
            revision = (self.revision.get()[0] if self.revision.exists() else 0) + 1
            self.revision.update((revision,))
            known = sorted((k[0], *v) for k, v in self.laps.iterator())
            yield pd.DataFrame(list(self.snapshots(key, known, first, revision)), columns=[c.strip().split(" ")[0] for c in OUT.split(", ")])

    def snapshots(self, key, known: list[tuple], first: int, revision: int) -> Iterator[tuple]:
        s = dict(EMPTY)
        for lap, laptime, compound, stint, temp, probability, life in known:
            s = step(s, {"lap": lap, "laptime": laptime, "compound": compound, "stint": stint, "track_temp": temp})
            word = alert(s, probability, life, *self.how)
            if lap < first:
                continue
            n, y = s["n"], laptime + FUEL_SECONDS_PER_LAP * lap
            det, gap = n * s["sxx"] - s["sx"] * s["sx"], y - s["best"]
            slope = (n * s["sxy"] - s["sx"] * s["sy"]) / det if n >= 2 and abs(det) > 1e-9 else 0.0
            yield (key[0], key[1], lap, s["stint_no"], n, s["compound"], y, gap, gap > CLIFF, slope, s["temp"], s["t_sum"] / s["t_n"] if s["t_n"] else None, s["used"].split(","), word, revision)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.laps.clear()
        self.revision.clear()
        yield pd.DataFrame(columns=[c.strip().split(" ")[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def snapshots(stream: DataFrame, threshold: float = 0.5, joint_limit: float = 15.0, imminent_at: float = 2.0, keep: float | None = None) -> DataFrame:
    """Snapshots of a stream (race, driver, lap, laptime, compound, stint, track_temp, probability, life), keyed by (race, driver).

    Laps may come in any order, within a micro-batch and across them: no lap is left out. latest() of the output has, for
    each lap, what batch_snapshots() gives for all laps so far. With `keep` seconds, the stream has an event time `at` with
    a watermark, and a driver's state goes when the watermark is that far past the driver's last lap; rows that the
    watermark rules out are counted by dropped_rows(). Laps without number or time fall out. It takes the RocksDB state
    store (spark.sql.streaming.stateStore.providerClass), which transformWithState asks for.
    """
    processor = LapState(threshold, joint_limit, imminent_at, None if keep is None else int(keep * 1000))
    columns = ["race", "driver", "lap", "laptime", "compound", "stint", "track_temp", "probability", "life", *(["at"] if keep is not None else [])]
    return stream.select(*columns).groupBy("race", "driver").transformWithStateInPandas(processor, OUT, "append", "None" if keep is None else "EventTime")


def latest(snapshot: DataFrame) -> DataFrame:
    """The last revision of each lap's snapshot."""
    keys = ["race", "driver", "lap"]
    return snapshot.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in snapshot.columns if c not in keys]), "revision").alias("s")).select(*keys, "s.*")


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came past the watermark, over the progress reports that the query still has."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def decision_state(snapshot: DataFrame) -> DataFrame:
    """What a plan needs of a snapshot."""
    return snapshot.select("race", "driver", F.col("lap").alias("cur_lap"), "compound", F.col("laps_into_stint").alias("into"), F.col("fuel_corr").alias("base_pace"), F.col("track_temp").alias("temp"), F.col("compounds_used").alias("used"), "in_cliff_now")
