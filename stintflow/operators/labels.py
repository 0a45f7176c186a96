"""Remaining-life labels from sustained crossings of the stint's best pace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintflow.functions.scalars import DEFAULT_LIFE_CAP, LIFE_CAPS, capped_life
from stintflow.operators.stints import Stint, position, stint_best


def onset(laps: DataFrame, s: Stint, pace: str, life: str, flag: str, threshold: float = 1.5, sustained: int = 2, narrow: int = 3) -> DataFrame:
    """Adds onset: the stint's first life at which the rolling median exceeds the best by threshold for sustained laps in
    a row (looking ahead), on green laps after the second; null for a stint without."""
    c = F.col
    df = laps.withColumns({"__pos": position(s), "__best": stint_best(s, c(pace), c(flag)), "__median": F.percentile(c(pace), F.lit(0.5)).over(s.last(narrow))})
    df = df.withColumn("__above", F.coalesce((c("__median") > c("__best") + threshold) & (c("__pos") >= 2) & (F.coalesce(c(flag), F.lit(0)) == 0), F.lit(False)))
    crossing = reduce(lambda a, b: a & b, [c("__above"), *[F.lead("__above", k, False).over(s.ordered) for k in range(1, sustained)]])
    df = df.withColumn("__cross", crossing).withColumn("onset", F.min(F.when(c("__cross"), c(life))).over(s.whole))
    return df.drop("__pos", "__best", "__median", "__above", "__cross")


def remaining_life(laps: DataFrame, s: Stint, pace: str, life: str, flag: str, category: str, caps: dict[str, int] | None = None, default: int = DEFAULT_LIFE_CAP, near: int = 3, **how) -> DataFrame:
    """Adds onset, raw_life, target_life (0 to the category's cap) and onset_near: 1 if the onset is within `near` laps.

    A stint without onset is censored at its end: it has the laps to its last one, and one more.
    """
    c = F.col
    df = onset(laps, s, pace, life, flag, **how)
    df = df.withColumn("raw_life", F.when(c("onset").isNotNull(), c("onset") - c(life)).otherwise(F.max(life).over(s.whole) - c(life) + 1))
    return df.withColumns({"target_life": capped_life(c("raw_life"), c(category), caps or LIFE_CAPS, default), "onset_near": F.coalesce((c("onset") - c(life)).between(0, near), F.lit(False)).cast("int")})


def sensitivity(laps: DataFrame, s: Stint, pace: str, life: str, flag: str, thresholds: list[float], windows: list[int], narrow: int = 3) -> DataFrame:
    """Label rates by threshold and sustained window, one row a pair, as onset() would label: one shuffle by stint.

    The rolling median is taken once; beside each lap stand, by threshold, how many laps from it on are above in a row,
    and from these the onsets of all pairs.
    """
    c = F.col
    df = laps.withColumns({"__pos": position(s), "__best": stint_best(s, c(pace), c(flag)), "__median": F.percentile(c(pace), F.lit(0.5)).over(s.last(narrow)), "__n": F.count("*").over(s.whole)})
    green = (c("__pos") >= 2) & (F.coalesce(c(flag), F.lit(0)) == 0)
    above = [F.coalesce((c("__median") > c("__best") + t) & green, F.lit(False)) for t in thresholds]
    ahead = s.ordered.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumns({f"__run{k}": F.coalesce(F.min(F.when(~a, c("__pos"))).over(ahead), c("__n")) - c("__pos") for k, a in enumerate(above)})
    pairs = [(k, t, w) for k, t in enumerate(thresholds) for w in windows]
    df = df.withColumns({f"__on{k}_{w}": F.min(F.when(c(f"__run{k}") >= w, c(life))).over(s.whole) for k, _, w in pairs})
    on = lambda k, w: c(f"__on{k}_{w}")
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(w).alias("sustained"), on(k, w).isNotNull().cast("int").alias("labelled"), F.coalesce((on(k, w) - c(life)).between(0, 3), F.lit(False)).cast("int").alias("near")) for k, t, w in pairs])
    return df.select(F.inline(rows)).groupBy("threshold", "sustained").agg(F.count("*").alias("n"), F.avg("labelled").alias("labelled_rate"), F.avg("near").alias("near_rate"))
