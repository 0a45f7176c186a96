"""Sample and lap statistics over events and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintflow.functions import scalars as S
from stintflow.operators import laps as L
from stintflow.plans.registry import query
from stintflow.plans.roles import LAPS_SQL, SAMPLES_SQL, laps, samples, table

KEYS = ["driver", "lap"]


@query("lap_statistics", f"""WITH {SAMPLES_SQL}
SELECT driver, lap::BIGINT AS lap, count(*) AS n_samples, round(avg(speed), 5) + 0.0 AS speed_mean, round(max(speed), 5) + 0.0 AS speed_max, round(min(speed), 5) + 0.0 AS speed_min, round(stddev_samp(speed), 5) + 0.0 AS speed_std,
  round(avg(throttle), 5) + 0.0 AS throttle_mean, round(avg(CASE WHEN throttle > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 5) AS throttle_share, round(avg(CASE WHEN brake > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 5) AS brake_share,
  round(avg(CASE WHEN drs > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 5) AS drs_share, round(avg(CASE WHEN gap < 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 5) AS near_share, round(max(position), 5) AS distance_max, round(avg(abs(acc)), 5) AS acc_abs_mean
FROM samples GROUP BY driver, lap""")
def lap_statistics(spark, sf_dir):
    return L.lap_statistics(samples(spark, sf_dir), KEYS, distance="position", accelerations=("acc",))


@query("rich_lap_statistics", f"""WITH {SAMPLES_SQL}, e AS (
  SELECT *, CASE WHEN throttle > 0 AND coalesce(lag(throttle) OVER w, 0) <= 0 THEN 1 ELSE 0 END AS t_on, CASE WHEN brake > 0 AND coalesce(lag(brake) OVER w, 0) <= 0 THEN 1 ELSE 0 END AS b_on
  FROM samples WINDOW w AS (PARTITION BY driver, lap ORDER BY ts, event_id)), g AS (
  SELECT driver, lap, count(*) AS n_samples, avg(speed) AS speed_mean, max(speed) AS speed_max, stddev_samp(speed) AS speed_std, stddev_samp(throttle) AS throttle_std, sum(t_on)::BIGINT AS throttle_edges, sum(b_on)::BIGINT AS brake_edges,
    avg(CASE WHEN brake > 0 THEN brake END) AS brake_when_braking, max(abs(acc)) AS acc_abs_max, avg(abs(acc)) AS acc_abs_mean, quantile_cont(gap, 0.1) AS gap_p10, avg(acc * acc * speed) AS energy FROM e GROUP BY driver, lap)
SELECT driver, lap::BIGINT AS lap, n_samples, round(speed_mean, 5) AS speed_mean, round(speed_max, 5) AS speed_max, round(speed_std, 5) AS speed_std, round(throttle_std, 5) AS throttle_std, throttle_edges, brake_edges, round(brake_when_braking, 5) AS brake_when_braking, round(acc_abs_max, 5) AS acc_abs_max, round(acc_abs_mean, 5) AS acc_abs_mean, round(gap_p10, 5) AS gap_p10, round(energy / 1000, 5) AS energy, round(acc_abs_mean * speed_max, 5) AS lateral_load, round(brake_when_braking * speed_max, 5) AS braking_load FROM g""")
def rich_lap_statistics(spark, sf_dir):
    return L.rich_lap_statistics(samples(spark, sf_dir), KEYS, ["ts", "event_id"]).withColumn("energy", F.col("energy") / 1000)


_BINS = ", ".join(f"round(max(CASE WHEN bin = {k} THEN abs(acc) END), 5) AS acc_{k}, round(avg(CASE WHEN bin = {k} THEN speed END), 5) AS speed_{k}" for k in range(10))


@query("micro_sectors", f"""WITH {SAMPLES_SQL}, b AS (SELECT *, least(greatest(floor(position * 10), 0), 9)::INT AS bin FROM samples WHERE position IS NOT NULL)
SELECT driver, lap::BIGINT AS lap, {_BINS} FROM b GROUP BY driver, lap""")
def micro_sectors(spark, sf_dir):
    return L.micro_sectors(samples(spark, sf_dir), KEYS, "position", {"acc": "absmax", "speed": "mean"})


@query("environment", """SELECT user_id AS driver, round(avg(value), 5) AS air_mean, round(max(value), 5) AS air_max, round(avg(value / 2 + 20), 5) AS track_mean, round(max(value / 2 + 20), 5) AS track_max, round(stddev_samp(value / 2 + 20), 5) AS track_std,
  max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS rain_flag, round(avg(value / 10), 5) AS wind_mean, round(avg(sin(radians(value * 3))), 5) + 0.0 AS direction_sin, round(avg(cos(radians(value * 3))), 5) + 0.0 AS direction_cos, count(*) AS n, round(max(value / 2 + 20) - avg(value / 2 + 20), 5) AS track_range
FROM events GROUP BY user_id""")
def environment(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("driver"), "value", (F.col("value") / 2 + 20).alias("track"), (F.col("event_type") == "error").alias("rain"), (F.col("value") / 10).alias("wind"), (F.col("value") * 3).alias("direction"))
    return L.environment(e, ["driver"], "value", "track", "rain", "wind", "direction")


@query("style_profile", f"""WITH {LAPS_SQL} SELECT driver, season, {", ".join(f"round(avg({c}), 4) AS {c}_mean, round(stddev_samp({c}), 4) AS {c}_std" for c in ("pace", "load", "dirty", "temp"))} FROM laps GROUP BY driver, season""", 4)
def style_profile(spark, sf_dir):
    return L.style_profile(laps(spark, sf_dir), ["driver", "season"], ["pace", "load", "dirty", "temp"])


@query("merged_partials", f"""WITH {SAMPLES_SQL} SELECT driver, lap::BIGINT AS lap, count(*) AS n_samples, round(avg(speed), 5) AS speed_mean, round(stddev_samp(speed), 5) AS speed_std, round(min(speed), 5) AS speed_min, round(max(speed), 5) AS speed_max,
  round(avg(throttle), 5) AS throttle_mean, round(stddev_samp(throttle), 5) AS throttle_std, round(min(throttle), 5) AS throttle_min, round(max(throttle), 5) AS throttle_max, round(avg(CASE WHEN brake > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 5) AS brake_share FROM samples GROUP BY driver, lap""")
def merged_partials(spark, sf_dir):
    channels = ["speed", "throttle"]
    parts = L.partials(samples(spark, sf_dir), KEYS, F.pmod("event_id", F.lit(7)), channels, {"brake": F.col("brake") > 0})
    return L.finalise_partials(L.merge_partials(parts, KEYS, channels, ["brake"]), KEYS, channels, ["brake"])


@query("correlations", f"""WITH {LAPS_SQL}, v AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for i, a in enumerate(("pace", "load", "dirty", "temp", "life")) for b in ("pace", "load", "dirty", "temp", "life")[i:])}) t(a, b)),
l AS (SELECT row_number() OVER () AS r, pace, load, dirty, temp, life::DOUBLE AS life FROM laps), u AS ({" UNION ALL ".join(f"SELECT r, '{c}' AS c, {c} AS x FROM l" for c in ("pace", "load", "dirty", "temp", "life"))})
SELECT v.a, v.b, round(coalesce(corr(p.x, q.x), 0), 4) + 0.0 AS r FROM v JOIN u p ON p.c = v.a JOIN u q ON q.c = v.b AND q.r = p.r GROUP BY v.a, v.b""", 4)
def correlations(spark, sf_dir):
    return L.correlations(laps(spark, sf_dir), ["pace", "load", "dirty", "temp", "life"])


@query("session_types", """SELECT CASE WHEN s LIKE 'race%' THEN 'Race' WHEN s LIKE 'sprint%' THEN 'Sprint' WHEN s LIKE 'qualifying%' OR s LIKE '%shootout%' THEN 'Qualifying' WHEN s LIKE 'practice%' THEN 'Practice' ELSE 'Testing' END AS kind, count(*) AS n, round(sum(CASE WHEN s LIKE 'race%' OR s LIKE 'sprint%' THEN o_totalprice + 0.03::DOUBLE * (o_orderkey % 70) ELSE o_totalprice END), 2) AS total
FROM (SELECT *, lower(CASE o_orderpriority WHEN '1-URGENT' THEN 'Race' WHEN '2-HIGH' THEN 'Sprint Qualifying' WHEN '3-MEDIUM' THEN 'Qualifying' WHEN '4-NOT SPECIFIED' THEN 'Practice 1' ELSE 'Pre-Season' END) AS s FROM orders) GROUP BY 1""", 2)
def session_types(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = S.looked_up(F.col("o_orderpriority"), {"1-URGENT": "Race", "2-HIGH": "Sprint Qualifying", "3-MEDIUM": "Qualifying", "4-NOT SPECIFIED": "Practice 1"}, "Pre-Season")
    kind = S.session_type(name)
    return o.select(kind.alias("kind"), S.fuel_corrected(F.col("o_totalprice"), F.col("o_orderkey") % 70, kind).alias("t")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("t").alias("total"))


@query("null_tokens", """WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'None' WHEN 1 THEN ' N/A ' WHEN 2 THEN 'garbage' WHEN 3 THEN 'nan' ELSE value::VARCHAR END AS raw FROM events)
SELECT event_id, round(CASE WHEN trim(raw) IN ('', 'None', 'none', 'null', 'N/A', 'nan') THEN NULL ELSE try_cast(trim(raw) AS DOUBLE) END, 5) AS as_double, trunc(CASE WHEN trim(raw) IN ('', 'None', 'none', 'null', 'N/A', 'nan') THEN NULL ELSE try_cast(trim(raw) AS DOUBLE) END)::BIGINT AS as_int, CASE WHEN trim(raw) IN ('', 'None', 'none', 'null', 'N/A', 'nan') THEN NULL WHEN trim(raw) = 'garbage' THEN 'garbage' ELSE 'number' END AS as_text FROM r""")
def null_tokens(spark, sf_dir):
    k = F.col("event_id") % 6
    raw = F.when(k == 0, "None").when(k == 1, " N/A ").when(k == 2, "garbage").when(k == 3, "nan").otherwise(F.col("value").cast("string"))
    text = S.as_string(raw)
    return table(spark, sf_dir, "events").select("event_id", S.as_double(raw).alias("as_double"), S.as_int(raw).alias("as_int"), F.when(text == "garbage", text).when(text.isNotNull(), "number").alias("as_text"))


@query("circular_blend", """SELECT event_id, round(sin(radians(value * 3.6::DOUBLE)), 5) + 0.0 AS s, round(cos(radians(value * 3.6::DOUBLE)), 5) + 0.0 AS c,
  round(greatest(least((12.0 - value / 5) / 6, 1), 0) * (value / 2) + (1 - greatest(least((12.0 - value / 5) / 6, 1), 0)) * (value / 5), 5) AS blended, user_id::VARCHAR || '|' || event_type || '|' || CASE WHEN event_id % 2 = 0 THEN 'None' ELSE event_id::VARCHAR END AS k FROM events""")
def circular_blend(spark, sf_dir):
    s, c = S.circular(F.col("value") * 3.6)
    key = S.natural_key(F.col("user_id"), F.col("event_type"), F.when(F.col("event_id") % 2 != 0, F.col("event_id")))
    return table(spark, sf_dir, "events").select("event_id", s.alias("s"), c.alias("c"), S.blended(F.col("value") / 5, F.col("value") / 2).alias("blended"), key.alias("k"))
