"""Windows, labels and intervals over the lap view."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintflow.operators import intervals as I
from stintflow.operators import labels as B
from stintflow.operators import stints as W
from stintflow.plans.registry import query
from stintflow.plans.roles import LAP_KEYS, LAPS_SQL, STINT, laps, samples, SAMPLES_SQL, table

_P = "PARTITION BY driver, season, stint"
_W = f"({_P} ORDER BY life)"
_ALL = f"({_P} ORDER BY life ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_RUN = f"({_P} ORDER BY life ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_KEYS = "driver, season, stint, life::BIGINT AS life"

DEGRADATION_SQL = f"""p AS (SELECT *, row_number() OVER {_W} - 1 AS position FROM laps), b AS (
  SELECT *, coalesce(first_value(CASE WHEN position >= 1 THEN pace END IGNORE NULLS) OVER {_ALL}, first_value(pace IGNORE NULLS) OVER {_ALL}) AS baseline, pace - lag(pace) OVER {_W} AS delta_previous FROM p), d AS (
  SELECT *, CASE WHEN position = 0 THEN 0.0::DOUBLE ELSE pace - baseline END AS delta_start FROM b), f AS (
  SELECT *, coalesce(delta_start > 2.0 AND position >= 1, false)::INT AS cliff_flag FROM d), g AS (SELECT *, (sum(cliff_flag) OVER {_RUN})::BIGINT AS cliff_count FROM f)"""


@query("degradation", f"""WITH {LAPS_SQL}, {DEGRADATION_SQL}
SELECT {_KEYS}, position::BIGINT AS position, round(baseline, 5) AS baseline, round(delta_start, 5) + 0.0 AS delta_start, round(delta_previous, 5) + 0.0 AS delta_previous, cliff_flag::BIGINT AS cliff_flag, cliff_count FROM g""")
def degradation(spark, sf_dir):
    return W.degradation(laps(spark, sf_dir), STINT, "pace").select(*LAP_KEYS, "position", "baseline", "delta_start", "delta_previous", "cliff_flag", "cliff_count")


def _features(w: str, run: str, r5: str, r3: str) -> str:
    return f"""avg(pace) OVER {r5} AS roll_mean, CASE WHEN count(pace) OVER {r5} > 0 THEN coalesce(stddev_samp(pace) OVER {r5}, 0) END AS roll_std, max(pace) OVER {r5} - min(pace) OVER {r5} AS roll_range, quantile_cont(pace, 0.5) OVER {r3} AS roll_median,
  (pace - lag(pace, 4) OVER {w}) / 4 AS slope, min(pace) OVER {run} AS best_so_far"""


_R5, _R3 = f"({_P} ORDER BY life ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", f"({_P} ORDER BY life ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
_NAMES = ["roll_mean", "roll_std", "roll_range", "roll_median", "slope", "best_so_far", "gap_to_best", "gap_roll_mean", "gap_slope"]


@query("pace_features", f"""WITH {LAPS_SQL}, a AS (SELECT *, {_features(_W, _RUN, _R5, _R3)} FROM laps), b AS (SELECT *, pace - best_so_far AS gap_to_best, load - first_value(load IGNORE NULLS) OVER {_ALL} AS sector_delta FROM a), c AS (
  SELECT *, avg(gap_to_best) OVER {_R5} AS gap_roll_mean, (gap_to_best - lag(gap_to_best, 4) OVER {_W}) / 4 AS gap_slope, avg(sector_delta) OVER {_R5} AS sector_roll_mean FROM b)
SELECT {_KEYS}, {", ".join(f"round({n}, 4) + 0.0 AS {n}" for n in [*_NAMES, "sector_delta", "sector_roll_mean"])} FROM c""", 4)
def pace_features(spark, sf_dir):
    return W.pace_features(laps(spark, sf_dir), STINT, "pace", "load").select(*LAP_KEYS, *_NAMES, "sector_delta", "sector_roll_mean")


_PF = "PARTITION BY driver, season, stint, flag ORDER BY life"


@query("green_features", f"""WITH {LAPS_SQL}, a AS (SELECT *, {_features(f"({_PF})", f"({_PF} ROWS UNBOUNDED PRECEDING)", f"({_PF} ROWS 4 PRECEDING)", f"({_PF} ROWS 2 PRECEDING)")} FROM laps), b AS (SELECT *, pace - best_so_far AS gap_to_best FROM a), c AS (
  SELECT *, avg(gap_to_best) OVER ({_PF} ROWS 4 PRECEDING) AS gap_roll_mean, (gap_to_best - lag(gap_to_best, 4) OVER ({_PF})) / 4 AS gap_slope FROM b)
SELECT {_KEYS}, flag::BIGINT AS flag, {", ".join(f"round(CASE WHEN flag = 0 THEN {n} ELSE last_value(CASE WHEN flag = 0 THEN {n} END IGNORE NULLS) OVER {_RUN} END, 4) + 0.0 AS {n}" for n in _NAMES)} FROM c""", 4)
def green_features(spark, sf_dir):
    return W.green_features(laps(spark, sf_dir), STINT, "pace", "flag").select(*LAP_KEYS, "flag", *_NAMES)


ELIGIBLE_SQL = f"""e0 AS (SELECT *, row_number() OVER ({_P} ORDER BY life DESC) AS back FROM laps), e1 AS (
  SELECT *, count(pace) OVER ({_P}) AS n_valid, count(pace) OVER ({_P}) / count(*) OVER ({_P}) AS valid_share, max(CASE WHEN back <= 2 AND flag = 1 THEN 1 ELSE 0 END) OVER ({_P}) AS ends_neutralised, first_value(rain) OVER {_ALL} AS wet FROM e0), e AS (
  SELECT *, (n_valid >= 5 OR coalesce(wet, 0) > 0) AND valid_share > 0.7 AND ends_neutralised = 0 AND n_valid >= 3 AS keep FROM e1)"""


@query("eligible_stints", f"""WITH {LAPS_SQL}, {ELIGIBLE_SQL} SELECT {_KEYS}, n_valid, round(valid_share, 5) AS valid_share, ends_neutralised::BIGINT AS ends_neutralised, wet::BIGINT AS wet, keep::INT::BIGINT AS keep FROM e""")
def eligible_stints(spark, sf_dir):
    return W.eligible(laps(spark, sf_dir), STINT, "pace", "flag", "rain").select(*LAP_KEYS, "n_valid", "valid_share", "ends_neutralised", "wet", "keep")


def _onset_sql(threshold: str = "1.5", sustained: int = 2, tag: str = "") -> str:
    ahead = " AND ".join(["above", *[f"lead(above, {k}, false) OVER {_W}" for k in range(1, sustained)]])
    return f"""o1{tag} AS (SELECT *, row_number() OVER {_W} - 1 AS pos, coalesce(min(CASE WHEN coalesce(flag, 0) = 0 THEN pace END) OVER ({_P}), min(pace) OVER ({_P})) AS best, quantile_cont(pace, 0.5) OVER {_R3} AS med FROM laps),
o2{tag} AS (SELECT *, coalesce(med > best + {threshold}::DOUBLE AND pos >= 2 AND coalesce(flag, 0) = 0, false) AS above FROM o1{tag}), o3{tag} AS (SELECT *, {ahead} AS crosses FROM o2{tag}),
o{tag} AS (SELECT *, min(CASE WHEN crosses THEN life END) OVER ({_P}) AS onset FROM o3{tag})"""


@query("remaining_life", f"""WITH {LAPS_SQL}, {_onset_sql()}, r AS (SELECT *, CASE WHEN onset IS NOT NULL THEN onset - life ELSE max(life) OVER ({_P}) - life + 1 END AS raw_life FROM o)
SELECT {_KEYS}, onset::BIGINT AS onset, raw_life::BIGINT AS raw_life, least(greatest(raw_life, 0), CASE stint WHEN 'R' THEN 15 WHEN 'A' THEN 22 ELSE 20 END)::BIGINT AS target_life, coalesce(onset - life BETWEEN 0 AND 3, false)::INT::BIGINT AS onset_near FROM r""")
def remaining_life(spark, sf_dir):
    return B.remaining_life(laps(spark, sf_dir), STINT, "pace", "life", "flag", "stint", {"R": 15, "A": 22}).select(*LAP_KEYS, "onset", "raw_life", "target_life", "onset_near")


@query("label_sensitivity", f"""WITH {LAPS_SQL}, {", ".join(_onset_sql(str(t), k, f"_{i}_{k}") for i, t in enumerate((1.0, 1.5, 2.0)) for k in (1, 2, 3))}
{" UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, {k}::BIGINT AS sustained, count(*) AS n, round(avg((onset IS NOT NULL)::INT), 5) AS labelled_rate, round(avg(coalesce(onset - life BETWEEN 0 AND 3, false)::INT), 5) AS near_rate FROM o_{i}_{k}" for i, t in enumerate((1.0, 1.5, 2.0)) for k in (1, 2, 3))}""")
def label_sensitivity(spark, sf_dir):
    return B.sensitivity(laps(spark, sf_dir), STINT, "pace", "life", "flag", [1.0, 1.5, 2.0], [1, 2, 3])


PIT_SQL = f"""q0 AS (SELECT *, row_number() OVER {_W} - 1 AS position, count(*) OVER ({_P}) AS n, max(stint) OVER (PARTITION BY driver, season) AS last_stint FROM laps), q AS (SELECT *, position = 0 AS is_pit_out, position = n - 1 AND stint < last_stint AS is_pit_in FROM q0)"""


@query("pit_flags", f"WITH {LAPS_SQL}, {PIT_SQL} SELECT {_KEYS}, is_pit_out::INT::BIGINT AS is_pit_out, is_pit_in::INT::BIGINT AS is_pit_in FROM q")
def pit_flags(spark, sf_dir):
    return W.pit_flags(laps(spark, sf_dir), STINT, "stint", ["driver", "season"]).select(*LAP_KEYS, "is_pit_out", "is_pit_in")


@query("hot_lap_drops", f"""WITH {LAPS_SQL}, {PIT_SQL}, h AS (SELECT *, min(pace) OVER (PARTITION BY driver, season) AS best FROM q)
SELECT coalesce(CASE WHEN pace IS NULL THEN 'no_time' WHEN is_pit_out OR is_pit_in THEN 'pit' WHEN pace > 1.07::DOUBLE * best THEN 'slow' WHEN flag = 1 THEN 'neutralised' END, 'kept') AS reason, count(*) AS n FROM h GROUP BY 1""")
def hot_lap_drops(spark, sf_dir):
    df = W.pit_flags(laps(spark, sf_dir), STINT, "stint", ["driver", "season"])
    return W.drop_counts(W.hot_laps(df, ["driver", "season"], "pace", "is_pit_out", "is_pit_in", "flag"))


@query("stint_summary", f"""WITH {LAPS_SQL}, {DEGRADATION_SQL}, s AS (SELECT driver, season, stint, arg_min_null(pace, lap) AS first_pace, arg_max_null(pace, lap) AS last_pace, count(*) AS length, max(life)::BIGINT AS max_life, arg_max_null(delta_start, lap) AS decay_at_end, max(cliff_flag)::BIGINT AS had_cliff, sum(cliff_flag)::BIGINT AS n_cliffs, avg(delta_start) AS delta_mean, avg(temp) AS temp_mean, avg(load) AS load_mean FROM g GROUP BY driver, season, stint)
SELECT driver, season, stint, round(first_pace, 4) AS first_pace, round(last_pace, 4) AS last_pace, length, max_life, round(decay_at_end, 4) + 0.0 AS decay_at_end, had_cliff, n_cliffs, round(delta_mean, 4) + 0.0 AS delta_mean, round(temp_mean, 4) AS temp_mean, round(load_mean, 4) AS load_mean, round((last_pace - first_pace) / nullif(length - 1, 0), 4) + 0.0 AS slope FROM s""", 4)
def stint_summary(spark, sf_dir):
    return W.stint_summary(W.degradation(laps(spark, sf_dir), STINT, "pace"), ["driver", "season", "stint"], "lap", "pace", "life", "delta_start", "cliff_flag", ["temp", "load"])


@query("fit_positions", f"""WITH {LAPS_SQL}, i AS (SELECT *, coalesce(dirty < 0.09::DOUBLE, false) AS usable FROM laps) SELECT {_KEYS}, (CASE WHEN usable AND flag = 0 THEN row_number() OVER (PARTITION BY driver, season, stint, usable ORDER BY life) - 1 ELSE -1 END)::BIGINT AS fit_position FROM i""")
def fit_positions(spark, sf_dir):
    return W.indexed_positions(laps(spark, sf_dir), STINT, F.col("dirty") < 0.09, F.col("flag") == 0).select(*LAP_KEYS, "fit_position")


_VOLUME_SQL = """v0 AS (SELECT season, stint, lap, count(*) AS n_cars, bool_or(coalesce(dirty >= 0.1::DOUBLE, false)) AS any_wet, bool_or(coalesce(temp >= 0.08::DOUBLE, false)) AS any_rain FROM laps GROUP BY season, stint, lap),
v AS (SELECT *, (sum(n_cars) OVER w)::BIGINT AS laps_so_far, max((any_wet OR any_rain)::INT) OVER w AS wet_by FROM v0 WINDOW w AS (PARTITION BY season, stint ORDER BY lap ROWS UNBOUNDED PRECEDING))"""


def _volume(df):
    return W.running_volume(df, ["season", "stint"], "lap", F.col("dirty") >= 0.1, F.col("temp") >= 0.08)


@query("running_volume", f"WITH {LAPS_SQL}, {_VOLUME_SQL} SELECT season, stint, lap::BIGINT AS lap, n_cars, any_wet::INT::BIGINT AS any_wet, any_rain::INT::BIGINT AS any_rain, laps_so_far, wet_by::BIGINT AS wet_by FROM v")
def running_volume(spark, sf_dir):
    return _volume(laps(spark, sf_dir))


_SESSIONS_SQL = """y AS (SELECT season, stint, sum(n_cars)::DOUBLE AS volume, bool_or(any_wet OR any_rain) AND stint <> 'N' AS wet, CASE stint WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS ord, CASE stint WHEN 'A' THEN 0.6 WHEN 'N' THEN 1.2 ELSE 1.5 END::DOUBLE AS weight FROM v GROUP BY season, stint),
z AS (SELECT a.*, coalesce((SELECT sum(b.weight * b.volume * CASE WHEN b.wet THEN 0.5 ELSE 1.0 END * CASE WHEN b.ord = 1 AND a.ord = 3 AND EXISTS (SELECT 1 FROM y m WHERE m.season = a.season AND m.ord = 2 AND m.wet) THEN 0.3 ELSE 1.0 END) FROM y b WHERE b.season = a.season AND b.ord < a.ord), 0) AS prior FROM y a)"""


def _sessions(volume):
    s = volume.groupBy("season", "stint").agg(F.sum("n_cars").cast("double").alias("volume"), F.bool_or(F.col("any_wet") | F.col("any_rain")).alias("w"))
    c = F.col("stint")
    s = s.select("season", "stint", "volume", (F.col("w") & (c != "N")).alias("wet"), F.when(c == "A", 1).when(c == "N", 2).otherwise(3).alias("ord"), F.when(c == "A", 0.6).when(c == "N", 1.2).otherwise(1.5).alias("weight"))
    return W.carry_over(s, ["season"], "ord", "weight", "volume", "wet")


@query("carry_over", f"WITH {LAPS_SQL}, {_VOLUME_SQL}, {_SESSIONS_SQL} SELECT season, stint, round(prior, 3) AS prior FROM z", 3)
def carry_over(spark, sf_dir):
    return _sessions(_volume(laps(spark, sf_dir))).select("season", "stint", "prior")


@query("track_evolution", f"""WITH {LAPS_SQL}, {_VOLUME_SQL}, {_SESSIONS_SQL} SELECT v.season, v.stint, v.lap::BIGINT AS lap, round((z.prior * CASE WHEN v.wet_by = 1 THEN 0.3 ELSE 1.0 END + z.weight * v.laps_so_far) * CASE WHEN v.any_wet THEN 0.6 ELSE 1.0 END, 3) AS track_index FROM v JOIN z USING (season, stint)""", 3)
def track_evolution(spark, sf_dir):
    v = _volume(laps(spark, sf_dir))
    return W.track_evolution(v, _sessions(v), ["season", "stint"]).select("season", "stint", "lap", "track_index")


@query("contiguous_runs", f"""WITH {LAPS_SQL}, d AS (SELECT DISTINCT driver, season, lap FROM laps WHERE flag = 1), n AS (SELECT *, lap - row_number() OVER (PARTITION BY driver, season ORDER BY lap) AS g FROM d)
SELECT driver, season, min(lap)::BIGINT AS first, max(lap)::BIGINT AS last, count(*) AS length FROM n GROUP BY driver, season, g""")
def contiguous_runs(spark, sf_dir):
    return W.runs(laps(spark, sf_dir).filter("flag = 1"), ["driver", "season"], "lap")


@query("alerts", f"""WITH RECURSIVE {LAPS_SQL}, x AS (SELECT driver, season, stint, life, lap, load > 55000 AS above, ((part % 40) + 1.5)::DOUBLE AS remaining FROM laps),
f AS (SELECT driver, season, stint, 0 AS life, 0 AS n, NULL::INT AS trigger, NULL::INT AS anomaly, NULL::INT AS imminent FROM x WHERE life = 1
  UNION ALL SELECT x.driver, x.season, x.stint, x.life,
    CASE WHEN f.trigger IS NOT NULL OR f.imminent IS NOT NULL OR remaining <= 2 THEN f.n WHEN NOT above THEN 0 WHEN f.n + 1 >= 2 AND remaining > 15 THEN 0 ELSE f.n + 1 END,
    CASE WHEN f.trigger IS NOT NULL OR f.imminent IS NOT NULL OR remaining <= 2 THEN f.trigger WHEN above AND f.n + 1 >= 2 AND remaining <= 15 THEN x.lap ELSE f.trigger END,
    CASE WHEN f.trigger IS NOT NULL OR f.imminent IS NOT NULL OR remaining <= 2 THEN f.anomaly WHEN above AND f.n + 1 >= 2 AND remaining > 15 THEN x.lap ELSE f.anomaly END,
    CASE WHEN f.trigger IS NOT NULL OR f.imminent IS NOT NULL THEN f.imminent WHEN remaining <= 2 THEN x.lap END
  FROM f JOIN x ON x.driver = f.driver AND x.season = f.season AND x.stint = f.stint AND x.life = f.life + 1)
SELECT driver, season, stint, max(life)::BIGINT AS n_laps, arg_max_null(trigger, life)::BIGINT AS trigger, arg_max_null(anomaly, life)::BIGINT AS anomaly, arg_max_null(imminent, life)::BIGINT AS imminent FROM f GROUP BY driver, season, stint""")
def alerts(spark, sf_dir):
    df = laps(spark, sf_dir).withColumns({"p": F.col("load"), "remaining": (F.col("part") % 40 + 1.5).cast("double")})
    return W.alerts(df, STINT, "p", "remaining", "lap", 55000.0)


_EVENTS_SQL = "ev AS (SELECT user_id AS session, day(ts)::INT AS lap, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY day(ts), ts, event_id) AS rank FROM events WHERE event_type IN ('error', 'signup'))"
_PERIODS_SQL = "m AS (SELECT s.session, s.rank, s.lap AS start_lap, coalesce(min(e.lap), s.lap) AS end_lap FROM ev s LEFT JOIN ev e ON e.event_type = 'signup' AND e.session = s.session AND e.lap >= s.lap AND e.rank > s.rank WHERE s.event_type = 'error' GROUP BY s.session, s.rank, s.lap)"


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "signup")).select(F.col("user_id").alias("session"), F.dayofmonth("ts").alias("lap"), "ts", "event_id", "event_type")
    return I.event_order(e, ["session"], ["lap", "ts", "event_id"])


@query("matched_periods", f"WITH {_EVENTS_SQL}, {_PERIODS_SQL} SELECT session, rank, start_lap::BIGINT AS start_lap, end_lap::BIGINT AS end_lap FROM m")
def matched_periods(spark, sf_dir):
    e = _events(spark, sf_dir)
    return I.match_periods(e.filter("event_type = 'error'"), e.filter("event_type = 'signup'"), ["session"])


@query("matched_rising", f"WITH {_EVENTS_SQL}, {_PERIODS_SQL} SELECT session, rank, start_lap::BIGINT AS start_lap, end_lap::BIGINT AS end_lap FROM m")
def matched_rising(spark, sf_dir):
    return I.match_rising(_events(spark, sf_dir), ["session"], F.col("event_type") == "error", F.col("event_type") == "signup", ["rank"])


@query("flagged_laps", f"""WITH {_EVENTS_SQL}, {_PERIODS_SQL} SELECT session, lap::BIGINT AS lap FROM (SELECT session, unnest(generate_series(start_lap, end_lap)) AS lap FROM m UNION SELECT user_id, day(ts) FROM events WHERE event_type = 'purchase' AND value > 90)""")
def flagged_laps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    single = e.filter("event_type = 'purchase' AND value > 90").select(F.col("user_id").alias("session"), F.dayofmonth("ts").alias("lap"))
    return I.flagged_laps(matched_rising(spark, sf_dir), single, ["session"])


@query("flag_join", f"""WITH {_EVENTS_SQL}, {_PERIODS_SQL}, x AS (SELECT DISTINCT session, unnest(generate_series(start_lap, end_lap)) AS lap FROM m) SELECT e.event_id, (x.lap IS NOT NULL)::INT::BIGINT AS is_flagged FROM events e LEFT JOIN x ON x.session = e.user_id AND x.lap = day(e.ts)""")
def flag_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session"), F.dayofmonth("ts").alias("lap"))
    return I.with_flag(e, I.expand(matched_rising(spark, sf_dir), ["session"]), ["session", "lap"]).select("event_id", "is_flagged")


@query("hazards", f"""WITH {LAPS_SQL}, r AS (SELECT driver, season, max(lap) AS n_laps, min(CASE WHEN flag = 1 THEN lap END) AS onset FROM laps GROUP BY driver, season), x AS (SELECT season, onset, unnest(generate_series(1, coalesce(onset, n_laps))) AS lap FROM r)
SELECT season, lap::BIGINT AS lap, count(*) AS exposed, sum((coalesce(lap = onset, false))::INT)::BIGINT AS events, round(sum((coalesce(lap = onset, false))::INT) / count(*), 5) AS hazard FROM x GROUP BY season, lap""")
def hazards(spark, sf_dir):
    df = laps(spark, sf_dir)
    races = df.groupBy("driver", "season").agg(F.max("lap").alias("n_laps"))
    firsts = df.filter("flag = 1").groupBy("driver", "season").agg(F.min("lap").alias("onset"))
    return I.hazards(races, firsts, ["driver", "season"], "season")


@query("latest_before", f"""WITH {SAMPLES_SQL}, q AS (SELECT event_id, driver, ts FROM samples WHERE event_type = 'purchase'), f AS (SELECT driver, ts AS t, speed FROM samples WHERE event_type = 'click')
SELECT q.event_id, round(f.speed, 5) AS latest_speed FROM q ASOF LEFT JOIN f ON q.driver = f.driver AND q.ts >= f.t""")
def latest_before(spark, sf_dir):
    s = samples(spark, sf_dir)
    return I.latest_before(s.filter("event_type = 'purchase'").select("event_id", "driver", "ts"), s.filter("event_type = 'click'"), ["driver"], "ts", "ts", ["speed"]).select("event_id", "latest_speed")


@query("wet_context", f"""WITH {LAPS_SQL}, {_VOLUME_SQL}, {_SESSIONS_SQL}, x AS (SELECT v.season, v.stint, v.lap, v.any_rain, (z.prior * CASE WHEN v.wet_by = 1 THEN 0.3 ELSE 1.0 END + z.weight * v.laps_so_far) * CASE WHEN v.any_wet THEN 0.6 ELSE 1.0 END AS i FROM v JOIN z USING (season, stint))
SELECT season, stint, lap::BIGINT AS lap, any_rain::INT::DOUBLE AS rain_intensity, round(CASE WHEN max(i) OVER (PARTITION BY season, stint) > 0 THEN least(greatest(i / max(i) OVER (PARTITION BY season, stint), 0), 1) ELSE 0 END, 5) AS drying FROM x""")
def wet_context(spark, sf_dir):
    v = _volume(laps(spark, sf_dir))
    t = W.track_evolution(v, _sessions(v), ["season", "stint"]).withColumn("rain", F.col("any_rain").cast("int"))
    return W.wet_context(t, ["season", "stint"], "rain", "track_index").select("season", "stint", "lap", "rain_intensity", "drying")
