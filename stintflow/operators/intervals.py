"""Deploy and end events: matching, expansion to laps, first onsets and hazards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_order(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return events.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def match_periods(starts: DataFrame, ends: DataFrame, keys: list[str], lap: str = "lap", rank: str = "rank") -> DataFrame:
    """(keys, rank, start_lap, end_lap): for each start the smallest later end lap at or after it; itself if there is none.

    Later means a larger rank. The smallest end lap over the ends after a start is a window minimum over all events of
    the key from the next one on, if laps rise with the rank; in general an end may come later with a smaller lap, so
    starts and ends meet in an equi-join on the key, bounded by the range, and the minimum is taken by start.
    """
    s = starts.select(*keys, F.col(rank).alias("rank"), F.col(lap).alias("start_lap"))
    e = ends.select(*keys, F.col(rank).alias("__rank"), F.col(lap).alias("__lap"))
    on = [s[k] == e[k] for k in keys] + [e["__lap"] >= s["start_lap"], e["__rank"] > s["rank"]]
    joined = s.join(e, on, "left").select(*[s[k] for k in keys], s["rank"], "start_lap", "__lap")
    return joined.groupBy(*keys, "rank", "start_lap").agg(F.coalesce(F.min("__lap"), F.col("start_lap")).alias("end_lap"))


def match_rising(events: DataFrame, keys: list[str], is_start: Column, is_end: Column, order: list[str], lap: str = "lap") -> DataFrame:
    """match_periods where the order rises with the lap: one window over the events and no join, so a key with many
    events stays linear."""
    after = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    df = events.withColumn("end_lap", F.min(F.when(is_end, F.col(lap))).over(after))
    return df.filter(is_start).select(*keys, *[o for o in order if o not in keys], F.col(lap).alias("start_lap"), F.coalesce("end_lap", F.col(lap)).alias("end_lap"))


def expand(periods: DataFrame, keys: list[str], first: str = "start_lap", last: str = "end_lap", out: str = "lap") -> DataFrame:
    return periods.select(*keys, F.explode(F.sequence(F.col(first), F.col(last))).alias(out))


def flagged_laps(periods: DataFrame, single: DataFrame, keys: list[str], lap: str = "lap") -> DataFrame:
    """The distinct laps of periods and single flags; flags without a lap are left out."""
    return expand(periods, keys, out=lap).unionByName(single.select(*keys, lap).filter(F.col(lap).isNotNull())).distinct()


def with_flag(laps: DataFrame, flags: DataFrame, keys: list[str], out: str = "is_flagged") -> DataFrame:
    once = flags.select(*keys).distinct().withColumn(out, F.lit(1))
    return laps.join(once, keys, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def hazards(races: DataFrame, first_onsets: DataFrame, race_keys: list[str], circuit: str, n_laps: str = "n_laps", onset: str = "onset") -> DataFrame:
    """(circuit, lap, exposed, events, hazard): a race counts as exposed up to its first onset, that lap included."""
    r = races.select(*race_keys, circuit, n_laps).join(first_onsets.select(*race_keys, onset), race_keys, "left")
    laps = r.withColumn("lap", F.explode(F.sequence(F.lit(1), F.coalesce(onset, n_laps).cast("int"))))
    out = laps.groupBy(circuit, "lap").agg(F.count("*").alias("exposed"), F.sum(F.coalesce((F.col("lap") == F.col(onset)).cast("int"), F.lit(0))).alias("events"))
    return out.withColumn("hazard", F.least(F.greatest(F.col("events") / F.col("exposed"), F.lit(0.0)), F.lit(1.0)))


def latest_before(queries: DataFrame, facts: DataFrame, keys: list[str], at: str, order: str, columns: list[str]) -> DataFrame:
    """As-of lookup: for each query row the columns of the fact with the largest order at or before `at`.

    Facts and queries are laid on one line by key, and the last fact is carried forward, so there is no range join; facts
    of one key and order are settled by the largest struct of the columns.
    """
    f = facts.groupBy(*keys, F.col(order).alias("__t")).agg(F.max(F.struct(F.lit(True).alias("ok"), *columns)).alias("__f"))
    line = f.select(*keys, "__t", "__f", F.lit(0).alias("__q"), F.lit(None).cast(_struct(queries)).alias("__row")).unionByName(queries.select(*keys, F.col(at).alias("__t"), F.lit(None).cast(f.schema["__f"].dataType).alias("__f"), F.lit(1).alias("__q"), F.struct(*queries.columns).alias("__row")))
    w = Window.partitionBy(*keys).orderBy("__t", "__q").rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("__f", F.last("__f", ignorenulls=True).over(w)).filter("__q = 1")
    return found.select("__row.*", *[F.col(f"__f.{c}").alias(f"latest_{c}") for c in columns])


def _struct(df: DataFrame):
    return df.select(F.struct(*df.columns).alias("x")).schema["x"].dataType
