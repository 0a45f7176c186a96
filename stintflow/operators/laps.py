"""Statistics of high-rate samples by lap, by session and by season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(condition: Column) -> Column:
    """The share of all rows for which condition holds; null counts as not holding."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def lap_statistics(samples: DataFrame, keys: list[str], speed: str = "speed", throttle: str = "throttle", brake: str = "brake", drs: str = "drs", gap: str = "gap", distance: str = "distance", accelerations: tuple[str, ...] = (), near: float = 10.0) -> DataFrame:
    """One row per lap: counts, speed moments, shares of active pedals and close following, and the distance."""
    c = F.col
    return samples.groupBy(*keys).agg(
        F.count("*").alias("n_samples"), F.avg(speed).alias("speed_mean"), F.max(speed).alias("speed_max"), F.min(speed).alias("speed_min"), F.stddev_samp(speed).alias("speed_std"),
        F.avg(throttle).alias("throttle_mean"), share(c(throttle) > 0).alias("throttle_share"), share(c(brake) > 0).alias("brake_share"), share(c(drs) > 0).alias("drs_share"), share(c(gap) < near).alias("near_share"), F.max(distance).alias("distance_max"),
        *[F.avg(F.abs(c(a))).alias(f"{a}_abs_mean") for a in accelerations],
    )


def rising_edges(samples: DataFrame, keys: list[str], order: list[str], channels: list[str]) -> DataFrame:
    """samples with <channel>_on: 1 where the channel becomes positive (a null before counts as zero)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return samples.withColumns({f"{c}_on": F.when((F.col(c) > 0) & (F.coalesce(F.lag(c).over(w), F.lit(0.0)) <= 0), 1).otherwise(0) for c in channels})


def rich_lap_statistics(samples: DataFrame, keys: list[str], order: list[str], speed: str = "speed", throttle: str = "throttle", brake: str = "brake", acceleration: str = "acc", gap: str = "gap") -> DataFrame:
    """lap_statistics's kin with spreads, edge counts, conditional means, extremes, a low quantile and load products."""
    c = F.col
    s = rising_edges(samples, keys, order, [throttle, brake])
    out = s.groupBy(*keys).agg(
        F.count("*").alias("n_samples"), F.avg(speed).alias("speed_mean"), F.max(speed).alias("speed_max"), F.stddev_samp(speed).alias("speed_std"), F.stddev_samp(throttle).alias("throttle_std"), F.sum(f"{throttle}_on").alias("throttle_edges"), F.sum(f"{brake}_on").alias("brake_edges"),
        F.avg(F.when(c(brake) > 0, c(brake))).alias("brake_when_braking"), F.max(F.abs(c(acceleration))).alias("acc_abs_max"), F.avg(F.abs(c(acceleration))).alias("acc_abs_mean"), F.percentile(c(gap), F.lit(0.1)).alias("gap_p10"), F.avg(c(acceleration) * c(acceleration) * c(speed)).alias("energy"),
    )
    return out.withColumns({"lateral_load": c("acc_abs_mean") * c("speed_max"), "braking_load": c("brake_when_braking") * c("speed_max")})


def micro_sectors(samples: DataFrame, keys: list[str], position: str, channels: dict[str, str], bins: int = 10) -> DataFrame:
    """Wide profile by equal parts of the lap: <channel>_<bin> with max of absolutes ("absmax") or mean ("mean")."""
    b = F.least(F.greatest(F.floor(F.col(position) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    how = {"mean": lambda c: F.avg(c), "absmax": lambda c: F.max(F.abs(F.col(c)))}
    wide = samples.filter(F.col(position).isNotNull()).withColumn("bin", b).groupBy(*keys).pivot("bin", list(range(bins))).agg(*[how[h](c).alias(c) for c, h in channels.items()])
    if len(channels) == 1:
        only = next(iter(channels))
        return wide.select(*keys, *[F.col(str(k)).alias(f"{only}_{k}") for k in range(bins)])
    return wide.select(*keys, *[F.col(f"{k}_{c}").alias(f"{c}_{k}") for k in range(bins) for c in channels])


def environment(samples: DataFrame, keys: list[str], air: str, track: str, rain: str, wind: str, direction: str) -> DataFrame:
    """One row per session: temperatures, spread, any rain, wind, the mean direction's components, count."""
    c = F.col
    out = samples.groupBy(*keys).agg(F.avg(air).alias("air_mean"), F.max(air).alias("air_max"), F.avg(track).alias("track_mean"), F.max(track).alias("track_max"), F.stddev_samp(track).alias("track_std"), F.max(F.when(c(rain), 1).otherwise(0)).alias("rain_flag"), F.avg(wind).alias("wind_mean"), F.avg(F.sin(F.radians(c(direction)))).alias("direction_sin"), F.avg(F.cos(F.radians(c(direction)))).alias("direction_cos"), F.count("*").alias("n"))
    return out.withColumn("track_range", c("track_max") - c("track_mean"))


def style_profile(laps: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean and sample spread of each column by season and driver."""
    return laps.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def partials(samples: DataFrame, keys: list[str], batch: Column, channels: list[str], shares: dict[str, Column] | None = None) -> DataFrame:
    """Mergeable statistics by key and batch: per channel n, mean, m2, min, max; per share its count; rows."""
    out = [F.count("*").alias("rows")]
    for c in channels:
        v = F.col(c)
        out += [F.count(v).alias(f"{c}_n"), F.avg(v).alias(f"{c}_mean"), (F.var_pop(v) * F.count(v)).alias(f"{c}_m2"), F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max")]
    out += [F.sum(F.coalesce(e, F.lit(False)).cast("long")).alias(f"{n}_count") for n, e in (shares or {}).items()]
    return samples.withColumn("batch", batch).groupBy(*keys, "batch").agg(*out)


def merge_partials(parts: DataFrame, keys: list[str], channels: list[str], shares: list[str] = ()) -> DataFrame:
    """Statistics of all batches together: the parallel variance formula on (n, mean, m2), centred on the first mean.

    Stored partials of old batches and partials of new ones merge alike, so a table of statistics is refreshed without
    its samples.
    """
    w = Window.partitionBy(*keys)
    p = parts
    for c in channels:
        p = p.withColumn(f"__{c}", F.max(f"{c}_mean").over(w))
    out = [F.sum("rows").alias("rows")]
    for c in channels:
        n, shift = F.sum(f"{c}_n"), F.col(f"{c}_mean") - F.col(f"__{c}")
        first, second = F.sum(F.col(f"{c}_n") * shift), F.sum(F.col(f"{c}_n") * shift * shift)
        out += [n.alias(f"{c}_n"), (F.max(f"__{c}") + F.try_divide(first, n)).alias(f"{c}_mean"), (F.sum(f"{c}_m2") + second - F.coalesce(F.try_divide(first * first, n), F.lit(0.0))).alias(f"{c}_m2"), F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max")]
    out += [F.sum(f"{n}_count").alias(f"{n}_count") for n in shares]
    return p.groupBy(*keys).agg(*out)


def finalise_partials(merged: DataFrame, keys: list[str], channels: list[str], shares: list[str] = ()) -> DataFrame:
    """Mean, sample spread, extremes and shares from merged partials."""
    out = [F.col("rows").alias("n_samples")]
    for c in channels:
        out += [F.col(f"{c}_mean"), F.when(F.col(f"{c}_n") > 1, F.sqrt(F.greatest(F.col(f"{c}_m2"), F.lit(0.0)) / (F.col(f"{c}_n") - 1))).alias(f"{c}_std"), F.col(f"{c}_min"), F.col(f"{c}_max")]
    return merged.select(*keys, *out, *[(F.col(f"{n}_count") / F.col("rows")).alias(f"{n}_share") for n in shares])


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs of columns over rows that have both, in one pass; constant columns have 0."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def corr(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        spread = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
        return F.coalesce(F.when(spread, F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y))), F.lit(0.0))

    one = df.agg(*[corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def sector_times(df: DataFrame, marks: list[str], out: list[str]) -> DataFrame:
    """df with the time of each sector from cumulative marks: the first mark itself, then the differences; a difference is
    null if a mark is missing or falls back."""
    gap = lambda a, b: F.when(F.col(b) >= F.col(a), F.col(b) - F.col(a))
    return df.withColumns({out[0]: F.col(marks[0]), **{o: gap(a, b) for o, a, b in zip(out[1:], marks, marks[1:], strict=False)}})


def sample_rate(samples: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """(keys, n_samples, seconds, rate_hz): intervals by seconds from first to last sample; null where no time passes."""
    s = samples.groupBy(*keys).agg(F.count(ts).alias("n_samples"), ((F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1e6).alias("seconds"))
    return s.withColumn("rate_hz", F.try_divide(F.col("n_samples") - 1, F.when(F.col("seconds") > 0, F.col("seconds"))))
