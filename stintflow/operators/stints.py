"""Windows over the ordered laps of a stint."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stint:
    """Column roles: the stint's keys, and the columns that order its laps without ties."""

    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    @property
    def ordered(self) -> WindowSpec:
        return self.whole.orderBy(*self.order)

    @property
    def all_ordered(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    @property
    def running(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    def last(self, n: int) -> WindowSpec:
        return self.ordered.rowsBetween(1 - n, 0)


def position(s: Stint) -> Column:
    """Zero-based place of a lap in its stint."""
    return F.row_number().over(s.ordered) - 1


def flying_baseline(s: Stint, value: Column, place: Column) -> Column:
    """The first value after the opening lap, or the stint's first value if there is none."""
    return F.coalesce(F.first(F.when(place >= 1, value), ignorenulls=True).over(s.all_ordered), F.first(value, ignorenulls=True).over(s.all_ordered))


def degradation(laps: DataFrame, s: Stint, pace: str, jump: float = 2.0) -> DataFrame:
    """Adds position, baseline, delta to it (0 at the opening lap), delta to the lap before, the cliff flag and its running
    count. A null pace gives null deltas and no flag; the count counts true flags only."""
    df = laps.withColumn("position", position(s))
    c = F.col
    df = df.withColumn("baseline", flying_baseline(s, c(pace), c("position")))
    df = df.withColumns({"delta_start": F.when(c("position") == 0, 0.0).otherwise(c(pace) - c("baseline")), "delta_previous": c(pace) - F.lag(pace).over(s.ordered)})
    df = df.withColumn("cliff_flag", F.coalesce((c("delta_start") > jump) & (c("position") >= 1), F.lit(False)).cast("int"))
    return df.withColumn("cliff_count", F.sum("cliff_flag").over(s.running))


def pace_features(laps: DataFrame, s: Stint, pace: str, last_sector: str | None = None, wide: int = 5, narrow: int = 3) -> DataFrame:
    """Causal features: rolling mean, spread (0 for one lap), range, median, k-lap slope, running best, gap to it, and
    their rolling means. All windows share one partitioning and order, so the data is sorted once."""
    c = F.col
    roll = s.last(wide)
    df = laps.withColumns({
        "roll_mean": F.avg(pace).over(roll), "roll_std": F.when(F.count(pace).over(roll) > 0, F.coalesce(F.stddev_samp(pace).over(roll), F.lit(0.0))), "roll_range": F.max(pace).over(roll) - F.min(pace).over(roll), "roll_median": F.percentile(c(pace), F.lit(0.5)).over(s.last(narrow)),
        "slope": (c(pace) - F.lag(pace, wide - 1).over(s.ordered)) / (wide - 1), "best_so_far": F.min(pace).over(s.running),
    }).withColumn("gap_to_best", c(pace) - c("best_so_far"))
    out = {"gap_roll_mean": F.avg("gap_to_best").over(roll), "gap_slope": (c("gap_to_best") - F.lag("gap_to_best", wide - 1).over(s.ordered)) / (wide - 1)}
    if last_sector:
        df = df.withColumn("sector_delta", c(last_sector) - F.first(last_sector, ignorenulls=True).over(s.all_ordered))
        out["sector_roll_mean"] = F.avg("sector_delta").over(roll)
    return df.withColumns(out)


def green_features(laps: DataFrame, s: Stint, pace: str, flag: str, wide: int = 5, narrow: int = 3) -> DataFrame:
    """pace_features of the green laps alone, carried forward onto neutralised laps, never back.

    One pass: the flag joins the partitioning for the features, then the last known value is taken over the stint. A
    join on the lap would lose laps without life and multiply repeated ones.
    """
    inner = Stint((*s.keys, flag), s.order)
    df = pace_features(laps, inner, pace, None, wide, narrow)
    names = ["roll_mean", "roll_std", "roll_range", "roll_median", "slope", "best_so_far", "gap_to_best", "gap_roll_mean", "gap_slope"]
    green = F.coalesce(F.col(flag), F.lit(0)) == 0
    df = df.withColumns({n: F.when(green, F.col(n)) for n in names})
    return df.withColumns({n: F.when(green, F.col(n)).otherwise(F.last(n, ignorenulls=True).over(s.running)) for n in names})


def eligible(laps: DataFrame, s: Stint, pace: str, flag: str, rain: str, least: int = 5, share: float = 0.7, wet_least: int = 3) -> DataFrame:
    """Adds n_valid, valid_share, ends_neutralised (one of the last two laps is flagged), wet (of the first lap) and keep."""
    c = F.col
    backwards = s.whole.orderBy(*[c(o).desc() for o in s.order])
    df = laps.withColumn("__back", F.row_number().over(backwards))
    df = df.withColumns({
        "n_valid": F.count(pace).over(s.whole), "valid_share": F.count(pace).over(s.whole) / F.count("*").over(s.whole), "ends_neutralised": F.max(F.when((c("__back") <= 2) & (c(flag) == 1), 1).otherwise(0)).over(s.whole), "wet": F.first(c(rain)).over(s.all_ordered),
    })
    keep = ((c("n_valid") >= least) | (F.coalesce(c("wet"), F.lit(0)) > 0)) & (c("valid_share") > share) & (c("ends_neutralised") == 0) & (c("n_valid") >= wet_least)
    return df.withColumn("keep", keep).drop("__back")


def stint_best(s: Stint, pace: Column, flag: Column) -> Column:
    """The best pace of the stint's green laps, of all laps if none is green."""
    return F.coalesce(F.min(F.when(F.coalesce(flag, F.lit(0)) == 0, pace)).over(s.whole), F.min(pace).over(s.whole))


def pit_flags(laps: DataFrame, s: Stint, stint: str, run_keys: list[str]) -> DataFrame:
    """Adds is_pit_out (first lap of a stint) and is_pit_in (last lap of one that another follows)."""
    n = F.count("*").over(s.whole)
    df = laps.withColumns({"position": position(s), "__n": n, "__last": F.max(stint).over(Window.partitionBy(*run_keys))})
    return df.withColumns({"is_pit_out": F.col("position") == 0, "is_pit_in": (F.col("position") == F.col("__n") - 1) & (F.col(stint) < F.col("__last"))}).drop("__n", "__last")


def stint_summary(laps: DataFrame, keys: list[str], lap: str, pace: str, life: str, delta: str, cliff: str, means: list[str] = ()) -> DataFrame:
    """One row per stint: ends by lap, length, decay, cliffs, means, and the slope between the ends (null for one lap)."""
    c = F.col
    out = laps.groupBy(*keys).agg(F.min_by(pace, lap).alias("first_pace"), F.max_by(pace, lap).alias("last_pace"), F.count("*").alias("length"), F.max(life).alias("max_life"), F.max_by(delta, lap).alias("decay_at_end"), F.max(cliff).alias("had_cliff"), F.sum(cliff).alias("n_cliffs"), F.avg(delta).alias("delta_mean"), *[F.avg(m).alias(f"{m}_mean") for m in means])
    return out.withColumn("slope", F.try_divide(c("last_pace") - c("first_pace"), c("length") - 1))


def hot_laps(laps: DataFrame, run_keys: list[str], pace: str, pit_out: str, pit_in: str, flag: str, within: float = 1.07) -> DataFrame:
    """Adds reason: null for a hot lap, else why it is none (no_time, pit, slow, neutralised; the first that holds).

    The session's best is a window minimum; it needs no join."""
    best = F.min(pace).over(Window.partitionBy(*run_keys))
    c = F.col
    return laps.withColumn("best", best).withColumn("reason", F.when(c(pace).isNull(), "no_time").when(c(pit_out) | c(pit_in), "pit").when(c(pace) > within * c("best"), "slow").when(c(flag) == 1, "neutralised"))


def drop_counts(judged: DataFrame) -> DataFrame:
    """How many laps each reason drops, in one pass."""
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def indexed_positions(laps: DataFrame, s: Stint, usable: Column, green: Column) -> DataFrame:
    """Adds fit_position: place among the usable laps, -1 for laps that are not usable or not green."""
    place = F.row_number().over(Stint((*s.keys, "__usable"), s.order).ordered) - 1
    df = laps.withColumn("__usable", F.coalesce(usable, F.lit(False)))
    return df.withColumn("fit_position", F.when(F.col("__usable") & green, place).otherwise(-1)).drop("__usable")


def running_volume(laps: DataFrame, keys: list[str], lap: str, wet: Column, rain: Column) -> DataFrame:
    """Per session and lap number: cars, any wet tyre, any rain, laps run so far, and whether it was wet by then."""
    per = laps.groupBy(*keys, lap).agg(F.count("*").alias("n_cars"), F.bool_or(F.coalesce(wet, F.lit(False))).alias("any_wet"), F.bool_or(F.coalesce(rain, F.lit(False))).alias("any_rain"))
    w = Window.partitionBy(*keys).orderBy(lap).rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumns({"laps_so_far": F.sum("n_cars").over(w), "wet_by": F.max((F.col("any_wet") | F.col("any_rain")).cast("int")).over(w)})


def carry_over(sessions: DataFrame, group: list[str], order: str, weight: str, volume: str, wet: str, wash: float = 0.3, effect: float = 0.5) -> DataFrame:
    """Adds prior: what earlier sessions of the group leave, R <- R * wash(wet) + weight * volume * effect(wet), from 0.

    The fold of an ordered group is written in closed form: each earlier session's share times the washes after it up to
    the session before this one. A group (a weekend) has few sessions, which are folded as one array.
    """
    steps = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(weight).cast("double").alias("w"), F.col(volume).cast("double").alias("v"), F.coalesce(F.col(wet), F.lit(False)).alias("wet"))).over(Window.partitionBy(*group)))
    earlier = F.filter("__steps", lambda x: x["o"] < F.col(order))
    prior = F.aggregate(earlier, F.lit(0.0), lambda r, x: r * F.when(x["wet"], wash).otherwise(1.0) + x["w"] * x["v"] * F.when(x["wet"], effect).otherwise(1.0))
    return sessions.withColumn("__steps", steps).withColumn("prior", prior).drop("__steps")


def track_evolution(per_lap: DataFrame, priors: DataFrame, keys: list[str], weight: str = "weight", wash: float = 0.3, wet_grip: float = 0.6) -> DataFrame:
    """Adds track_index: the prior, washed from the first wet lap on, plus weight times laps so far; less on wet laps."""
    df = per_lap.join(priors.select(*keys, weight, "prior"), keys, "left")
    base = F.col("prior") * F.when(F.col("wet_by") == 1, wash).otherwise(1.0) + F.col(weight) * F.col("laps_so_far")
    return df.withColumn("track_index", base * F.when(F.col("any_wet"), wet_grip).otherwise(1.0))


def wet_context(laps: DataFrame, keys: list[str], rain: str, index: str) -> DataFrame:
    """Adds rain_intensity (null: 0) and drying: the track index against the session's largest, held in 0..1, 0 without."""
    top = F.max(index).over(Window.partitionBy(*keys))
    return laps.withColumns({"rain_intensity": F.coalesce(F.col(rain).cast("double"), F.lit(0.0)), "__top": top}).withColumn("drying", F.when(F.col("__top") > 0, F.least(F.greatest(F.col(index) / F.col("__top"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)).drop("__top")


def runs(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Contiguous runs of numbers by key: first, last, length (repeated numbers count once)."""
    w = Window.partitionBy(*keys).orderBy(number)
    once = rows.select(*keys, number).filter(F.col(number).isNotNull()).distinct()
    return once.withColumn("__g", F.col(number) - F.row_number().over(w)).groupBy(*keys, "__g").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("length")).drop("__g")


def alerts(laps: DataFrame, s: Stint, probability: str, life: str, lap: str, threshold: float, joint_limit: float = 15, imminent_at: float = 2, needed: int = 2) -> DataFrame:
    """One row per stint: trigger, anomaly and imminent laps of the debounced monitor.

    A fold over the stint's ordered laps: remaining life at most imminent_at ends it; needed laps in a row above the
    threshold trigger and end it, unless the remaining life is still above joint_limit, which marks an anomaly and resets.
    """
    steps = F.sort_array(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(s.order)], F.col(lap).cast("int").alias("lap"), (F.col(probability) > threshold).alias("above"), F.col(life).cast("double").alias("life"))))
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("n"), none.alias("trigger"), none.alias("anomaly"), none.alias("imminent"))

    def step(a: Column, x: Column) -> Column:
        ended = a["trigger"].isNotNull() | a["imminent"].isNotNull()
        soon = x["life"] <= imminent_at
        n = F.when(F.coalesce(x["above"], F.lit(False)), a["n"] + 1).otherwise(0)
        fires = n >= needed
        far = x["life"] > joint_limit
        return F.when(ended, a).when(F.coalesce(soon, F.lit(False)), F.struct(a["n"].alias("n"), a["trigger"].alias("trigger"), a["anomaly"].alias("anomaly"), x["lap"].alias("imminent"))).otherwise(
            F.struct(F.when(fires & far, 0).otherwise(n).alias("n"), F.when(fires & ~far, x["lap"]).otherwise(a["trigger"]).alias("trigger"), F.when(fires & far, x["lap"]).otherwise(a["anomaly"]).alias("anomaly"), a["imminent"].alias("imminent"))
        )

    return laps.groupBy(*s.keys).agg(F.aggregate(steps, start, step).alias("a"), F.count("*").alias("n_laps")).select(*s.keys, "n_laps", "a.trigger", "a.anomaly", "a.imminent")
