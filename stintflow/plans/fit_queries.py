"""Slopes, roll-ups, responses and priors over the lap view."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintflow.operators import fits as T
from stintflow.operators import labels as B
from stintflow.plans.registry import query
from stintflow.plans.roles import LAPS_SQL, STINT, laps, table
from stintflow.plans.stint_queries import _onset_sql

SLOPES_SQL = """n0 AS (SELECT *, row_number() OVER (PARTITION BY driver, season, stint ORDER BY life NULLS FIRST, lap NULLS FIRST) AS n FROM laps),
slopes AS (SELECT driver, season, stint, count(*) AS n, covar_samp(pace, CASE WHEN pace IS NOT NULL THEN life::DOUBLE END) / nullif(var_samp(life::DOUBLE), 0) AS slope, avg(dirty) AS dirty_mean, avg(temp) AS temp_mean, arg_min(part, n) AS part_first FROM n0 WHERE n > 3 AND coalesce(flag, 0) = 0 GROUP BY driver, season, stint HAVING count(*) >= 4)"""


def slopes(spark, sf_dir):
    return T.stint_slopes(laps(spark, sf_dir), ["driver", "season", "stint"], "life", "lap", "pace", "flag", means=["dirty", "temp"], firsts=["part"])


@query("stint_slopes", f"WITH {LAPS_SQL}, {SLOPES_SQL} SELECT driver, season, stint, n, round(slope, 5) + 0.0 AS slope, round(dirty_mean, 5) AS dirty_mean, round(temp_mean, 5) AS temp_mean, part_first FROM slopes")
def stint_slopes(spark, sf_dir):
    return slopes(spark, sf_dir)


@query("compound_slopes", f"""WITH {LAPS_SQL}, {SLOPES_SQL}, r AS (SELECT stint, slope, row_number() OVER (PARTITION BY stint ORDER BY slope) - 1 AS k, count(*) OVER (PARTITION BY stint) AS m FROM slopes WHERE slope IS NOT NULL), a AS (SELECT median(slope) AS med FROM slopes)
SELECT stint, count(*) AS n_stints, round(CASE WHEN count(*) >= 5 THEN median(slope) ELSE any_value(a.med) END, 5) + 0.0 AS beta,
  round(CASE WHEN count(*) >= 5 THEN least(greatest((max(CASE WHEN k = floor((m - 1) * 0.75 + 0.5) THEN slope END) - max(CASE WHEN k = floor((m - 1) * 0.25 + 0.5) THEN slope END)) / 1.349, 0.02), 0.5) ELSE coalesce(stddev_samp(slope), 0.05) END, 5) AS sigma FROM r, a GROUP BY stint""")
def compound_slopes(spark, sf_dir):
    return T.category_slopes(slopes(spark, sf_dir), "stint")


@query("driver_profile", f"""WITH {LAPS_SQL}, {SLOPES_SQL}, l AS (SELECT driver, season, count(*) AS n_laps, avg(pace) AS pace_mean, median(pace) AS pace_median, avg(flag) AS flag_share, avg((dirty > 0.05::DOUBLE)::INT) AS near_share FROM laps GROUP BY 1, 2), s AS (SELECT driver, season, avg(slope) AS slope_mean, count(slope) AS n_stints FROM slopes GROUP BY 1, 2)
SELECT driver, season, n_laps, round(pace_mean, 5) AS pace_mean, round(pace_median, 5) AS pace_median, round(flag_share, 5) AS flag_share, round(near_share, 5) AS near_share, round(slope_mean, 5) + 0.0 AS slope_mean, n_stints FROM l LEFT JOIN s USING (driver, season)""")
def driver_profile(spark, sf_dir):
    return T.driver_profile(laps(spark, sf_dir).withColumn("near", (F.col("dirty") > 0.05).cast("int")), slopes(spark, sf_dir), ["driver", "season"], "pace", "flag", "near")


@query("pace_by_category", f"WITH {LAPS_SQL} SELECT stint, season, round(avg(pace), 5) AS pace_mean, round(stddev_samp(pace), 5) AS pace_std, count(pace) AS n FROM laps GROUP BY stint, season")
def pace_by_category(spark, sf_dir):
    return T.pace_by(laps(spark, sf_dir), ["stint", "season"], "pace")


@query("flag_share", "SELECT year(l_shipdate) AS season, l_linestatus AS status, round(avg((l_tax >= 0.07::DOUBLE)::INT), 5) AS share FROM lineitem GROUP BY 1, 2")
def flag_share(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.year("l_shipdate").alias("season"), F.col("l_linestatus").alias("status")).agg(F.avg((F.col("l_tax") >= 0.07).cast("int")).alias("share"))


_RESPONSE_SQL = """k AS (SELECT dirty_mean AS x, slope + 0.3 AS y FROM slopes WHERE slope + 0.3 > 0 AND slope + 0.3 < 1 AND dirty_mean IS NOT NULL), e AS (SELECT quantile_cont(x, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]) AS e FROM k),
b AS (SELECT least(greatest(len(list_filter(e, lambda v: v <= x)) - 1, 0), 7) AS bin, count(*) AS n, avg(x) AS xm, median(y) AS ym FROM k, e GROUP BY 1 HAVING count(*) >= 3),
t AS (SELECT coalesce(median((q.ym - p.ym) / (q.xm - p.xm)), 0) AS slope FROM b p JOIN b q ON q.xm - p.xm > 1e-9), i AS (SELECT slope, median(ym - slope * xm) AS intercept FROM b, t GROUP BY slope)"""


#: Means that differ by the order of their sums alone are equal, also at an edge (as in quantile_bins).
_BINS_SQL = _RESPONSE_SQL.replace("dirty_mean AS x", "floor(dirty_mean * 1e12::DOUBLE + 0.5::DOUBLE) / 1e12::DOUBLE AS x").replace("SELECT quantile_cont(x, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]) AS e", "SELECT list_transform(quantile_cont(x, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]), lambda v: floor(v * 1e15::DOUBLE + 0.5::DOUBLE) / 1e15::DOUBLE) AS e")


@query("response_bins", f"WITH {LAPS_SQL}, {SLOPES_SQL}, {_BINS_SQL} SELECT bin, n, round(xm, 5) AS x_mean, round(ym, 5) AS y_median FROM b")
def response_bins(spark, sf_dir):
    k = slopes(spark, sf_dir).select(F.col("dirty_mean").alias("x"), (F.col("slope") + 0.3).alias("y")).filter("y > 0 and y < 1")
    return T.quantile_bins(k, "x", "y", 8)


_R2_SQL = "f AS (SELECT slope, intercept, count(*) AS bins, CASE WHEN (count(*) - 1) * var_samp(ym) > 1e-9 THEN 1 - sum((ym - slope * xm - intercept) ** 2) / ((count(*) - 1) * var_samp(ym)) ELSE 0 END AS r2 FROM b, i GROUP BY 1, 2)"


@query("response", f"""WITH {LAPS_SQL}, {SLOPES_SQL}, {_RESPONSE_SQL}, {_R2_SQL}, a AS (SELECT count(*) AS n, quantile_cont(x, 0.9) AS p, quantile_cont(x, 0.99) AS q FROM k)
SELECT n, round(slope, 4) + 0.0 AS slope, round(intercept, 4) + 0.0 AS intercept, round(r2, 4) + 0.0 AS r2, round(CASE WHEN n >= 30 AND bins >= 3 THEN least(greatest((slope * p + intercept) / greatest(intercept, 1e-6), 1.0), 2.5) ELSE 1.15 END, 4) AS mult_near, round(CASE WHEN n >= 30 AND bins >= 3 THEN least(greatest((slope * q + intercept) / greatest(intercept, 1e-6), 1.0), 2.5) ELSE 1.25 END, 4) AS mult_far, (n >= 30 AND bins >= 3)::INT::BIGINT AS fitted FROM f, a""", 4)
def response(spark, sf_dir):
    return T.response(slopes(spark, sf_dir).select(F.col("dirty_mean").alias("x"), (F.col("slope") + 0.3).alias("y")), "x", "y")


_GAPS_SQL = """w AS (SELECT driver, season, stint, min(pace) AS best, avg(temp) AS idx FROM laps GROUP BY 1, 2, 3), g AS (SELECT o.driver, o.season, o.stint, o.best - n.best AS gap, o.idx - n.idx AS index_gap FROM w o JOIN w n ON n.driver = o.driver AND n.season = o.season AND n.stint = 'N' WHERE o.stint IN ('A', 'R') AND o.best - n.best IS NOT NULL AND o.idx - n.idx IS NOT NULL)"""


@query("paired_gaps", f"WITH {LAPS_SQL}, {_GAPS_SQL} SELECT driver, season, stint, round(gap, 5) + 0.0 AS gap, round(index_gap, 5) + 0.0 AS index_gap FROM g")
def paired_gaps(spark, sf_dir):
    return T.paired_gaps(laps(spark, sf_dir), ["driver", "season"], "stint", "N", ["A", "R"], "pace", "temp")


@query("paired_fit", f"WITH {LAPS_SQL}, {_GAPS_SQL} SELECT stint, regr_count(gap, index_gap)::BIGINT AS n, round(regr_slope(gap, index_gap), 4) + 0.0 AS slope, round(regr_r2(gap, index_gap), 4) + 0.0 AS r2, round(least(greatest(CASE WHEN regr_count(gap, index_gap) >= 20 THEN regr_intercept(gap, index_gap) ELSE median(gap) END, -3), 3), 4) + 0.0 AS \"offset\" FROM g GROUP BY stint", 4)
def paired_fit(spark, sf_dir):
    return T.paired_fit(paired_gaps(spark, sf_dir), "stint")


@query("temperature_effect", f"WITH {LAPS_SQL} SELECT count(*) AS n, round(CASE WHEN count(*) > 50 THEN covar_samp(pace, temp) / nullif(var_pop(temp), 0) END, 4) + 0.0 AS effect FROM laps WHERE temp IS NOT NULL AND pace IS NOT NULL", 4)
def temperature_effect(spark, sf_dir):
    return T.temperature_effect(laps(spark, sf_dir), "temp", "pace")


@query("group_offsets", f"WITH {LAPS_SQL}, {SLOPES_SQL} SELECT driver % 5 AS cluster, count(slope) AS n, round(median(slope) - (SELECT median(slope) FROM slopes), 5) + 0.0 AS \"offset\" FROM slopes GROUP BY 1 HAVING count(slope) >= 30")
def group_offsets(spark, sf_dir):
    return T.group_offsets(slopes(spark, sf_dir).withColumn("cluster", F.col("driver") % 5), "cluster")


@query("degradation_curve", f"WITH {LAPS_SQL}, d AS (SELECT stint, life, pace - min(pace) OVER (PARTITION BY driver, season, stint) AS l FROM laps) SELECT stint, life::BIGINT AS life, round(median(l), 5) AS loss, count(*) AS n FROM d WHERE l IS NOT NULL GROUP BY 1, 2")
def degradation_curve(spark, sf_dir):
    return T.degradation_curve(laps(spark, sf_dir), ["driver", "season", "stint"], "stint", "life", "pace")


@query("onset_distribution", f"""WITH {LAPS_SQL}, {_onset_sql()}, s AS (SELECT driver, season, stint, max(onset) AS onset FROM o GROUP BY 1, 2, 3), x AS (SELECT stint, CASE WHEN onset >= 3 THEN onset::DOUBLE END AS onset FROM s), y AS (
  SELECT stint, count(*) AS n, avg((onset IS NULL)::INT) AS censored, quantile_cont(onset, [{", ".join(str(0.05 + 0.9 * k / 24) for k in range(25))}]) AS q FROM x GROUP BY 1)
SELECT stint, n, round(censored, 5) AS censored, round(q[1], 4) AS q05, round(q[13], 4) AS q50, round(q[25], 4) AS q95, len(q)::BIGINT AS n_quantiles FROM y""", 4)
def onset_distribution(spark, sf_dir):
    s = B.onset(laps(spark, sf_dir), STINT, "pace", "life", "flag").groupBy("driver", "season", "stint").agg(F.max("onset").alias("onset"))
    q = F.col("quantiles")
    return T.onset_distribution(s, "stint", "onset").select("stint", "n", F.round(F.col("censored") * 1.00000000001, 5).alias("censored"), q[0].alias("q05"), q[12].alias("q50"), q[24].alias("q95"), F.size(q).alias("n_quantiles"))


@query("practice_prior", f"""WITH {LAPS_SQL}, s AS (SELECT season, driver, rain, stint, count(*) AS length, median(pace) AS m FROM laps WHERE pace IS NOT NULL GROUP BY 1, 2, 3, 4), o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY season, driver, rain ORDER BY length DESC, m, stint) = 1),
f AS (SELECT season, rain, m AS field, length AS field_length FROM o QUALIFY row_number() OVER (PARTITION BY season, rain ORDER BY length DESC, m, driver) = 1), d AS (SELECT DISTINCT season, driver FROM laps)
SELECT d.season, d.driver, f.rain::BIGINT AS rain, round(coalesce(o.m, f.field), 5) AS prior, coalesce(o.length, f.field_length) AS length FROM d JOIN f USING (season) LEFT JOIN o ON o.season = d.season AND o.driver = d.driver AND o.rain = f.rain""")
def practice_prior(spark, sf_dir):
    return T.longest_stint_prior(laps(spark, sf_dir), ["season"], "driver", "rain", ["stint"], "pace")


@query("histogram", "SELECT (floor((c_acctbal - 4500) / 500) * 500)::DOUBLE AS bin, count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1")
def histogram(spark, sf_dir):
    return T.histogram(table(spark, sf_dir, "customer").select((F.col("c_acctbal") - 4500).alias("v")), "v", 500)


@query("cluster_decay", f"""WITH {LAPS_SQL}, s AS (SELECT driver, season, stint, count(*) AS n, arg_min(pace + 0.03 * lap, lap) AS a, arg_max(pace + 0.03 * lap, lap) AS b FROM laps WHERE pace IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 4), d AS (SELECT driver, season, avg((b - a) / (n - 1)) AS slope FROM s GROUP BY 1, 2)
SELECT driver % 5 AS cluster, round(avg(slope), 5) + 0.0 AS decay, count(*) AS n FROM d GROUP BY 1""")
def cluster_decay(spark, sf_dir):
    df = laps(spark, sf_dir).filter("pace is not null").withColumn("p", F.col("pace") + 0.03 * F.col("lap"))
    s = df.groupBy("driver", "season", "stint").agg(F.count("*").alias("n"), F.min_by("p", "lap").alias("a"), F.max_by("p", "lap").alias("b")).filter("n >= 4")
    d = s.groupBy("driver", "season").agg(F.avg((F.col("b") - F.col("a")) / (F.col("n") - 1)).alias("slope"))
    return d.groupBy((F.col("driver") % 5).alias("cluster")).agg(F.avg("slope").alias("decay"), F.count("*").alias("n"))
