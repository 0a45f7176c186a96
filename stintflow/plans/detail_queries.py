"""Sector times, sample rates, unwound arrays, observed levels, profile reconciliation, scored laps and cluster profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintflow.operators import documents as D
from stintflow.operators import fits as T
from stintflow.operators import laps as L
from stintflow.operators import metrics as M
from stintflow.operators import profile as P
from stintflow.operators import strategy as S
from stintflow.plans.registry import query
from stintflow.plans.roles import LAPS_SQL, SAMPLES_SQL, STINT, laps, samples, table


@query("sector_times", "WITH m AS (SELECT l_linestatus, l_quantity AS a, l_quantity + 100 * l_tax - 3 AS b, l_quantity + 200 * l_discount AS c FROM lineitem) SELECT l_linestatus, round(sum(a), 3) AS s1, round(sum(CASE WHEN b >= a THEN b - a END), 3) AS s2, round(sum(CASE WHEN c >= b THEN c - b END), 3) AS s3, count(CASE WHEN c >= b THEN 1 END) AS whole FROM m GROUP BY 1", 3)
def sector_times(spark, sf_dir):
    q, t, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    marks = table(spark, sf_dir, "lineitem").select("l_linestatus", q.alias("a"), (q + 100 * t - 3).alias("b"), (q + 200 * d).alias("c"))
    s = L.sector_times(marks, ["a", "b", "c"], ["s1", "s2", "s3"])
    return s.groupBy("l_linestatus").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("s3").alias("s3"), F.count("s3").alias("whole"))


@query("sample_rate", f"WITH {SAMPLES_SQL}, g AS (SELECT driver, lap, count(ts) AS n_samples, date_diff('microsecond', min(ts), max(ts)) / 1e6::DOUBLE AS seconds FROM samples GROUP BY 1, 2) SELECT driver, lap::BIGINT AS lap, n_samples, round(seconds, 3) AS seconds, round(1000 * (n_samples - 1) / CASE WHEN seconds > 0 THEN seconds END, 3) AS rate_mhz FROM g", 3)
def sample_rate(spark, sf_dir):
    return L.sample_rate(samples(spark, sf_dir), ["driver", "lap"], "ts").select("driver", "lap", "n_samples", "seconds", (1000 * F.col("rate_hz")).alias("rate_mhz"))


@query("stint_categories", f"WITH {LAPS_SQL}, s AS (SELECT driver, season, stint, count(*) AS k FROM laps GROUP BY 1, 2, 3) SELECT stint AS category, count(*) AS n, count(DISTINCT (driver, season)) AS n_documents FROM s WHERE k >= 3 AND stint <> 'R' GROUP BY 1")
def stint_categories(spark, sf_dir):
    """Stints of at least three laps, unwound from the races' documents, without one category."""
    races = S.executed_stints(laps(spark, sf_dir), ["driver", "season"], "stint", "stint", "lap")
    return D.unwound_counts(races, "stints", lambda x: (x["length"] >= 3) & (x["category"] != "R"), ["category"])


@query("observed_levels", "SELECT o_orderstatus AS status, count(*) AS n, sum((o_orderpriority = '1-URGENT')::INT)::BIGINT AS urgent, sum((o_orderpriority = '5-LOW')::INT)::BIGINT AS low FROM orders GROUP BY 1")
def observed_levels(spark, sf_dir):
    o = M.one_hot(table(spark, sf_dir, "orders"), "o_orderpriority")
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum("`o_orderpriority_1-URGENT`").alias("urgent"), F.sum("`o_orderpriority_5-LOW`").alias("low"))


@query("profile_reconciliation", f"""WITH {LAPS_SQL}, m AS (SELECT count(*) AS matched FROM (SELECT DISTINCT driver, season FROM laps)) SELECT c AS "column", matched, 0::BIGINT AS only_a, 0::BIGINT AS only_b, 0::BIGINT AS null_differs, 0::BIGINT AS differs, 0.0::DOUBLE AS max_abs FROM m, (VALUES ('n_laps'), ('pace_mean'), ('flag_share'), ('near_share')) t(c)""")
def profile_reconciliation(spark, sf_dir):
    """Driver profiles in one step against those rolled up from sums by stint."""
    df, keys = laps(spark, sf_dir).withColumn("near", (F.col("dirty") > 0.05).cast("int")), ["driver", "season"]
    none = df.select(*keys).distinct().withColumn("slope", F.lit(None).cast("double"))
    direct = T.driver_profile(df, none, keys, "pace", "flag", "near").select(*keys, "n_laps", "pace_mean", "flag_share", "near_share")
    part = df.groupBy(*keys, "stint").agg(F.count("*").alias("n"), F.sum("pace").alias("p"), F.count("pace").alias("np"), F.sum("flag").alias("f"), F.sum("near").alias("d"))
    rolled = part.groupBy(*keys).agg(F.sum("n").alias("n_laps"), F.try_divide(F.sum("p"), F.sum("np")).alias("pace_mean"), (F.sum("f") / F.sum("n")).alias("flag_share"), (F.sum("d") / F.sum("n")).alias("near_share"))
    return P.reconcile(direct, rolled, keys, 1e-6).withColumn("max_abs", F.round("max_abs", 3))


@query("scored_laps")
def scored_laps(spark, sf_dir):
    """Each test lap's truth beside two regressors, their blend, and the probability of a cliff."""
    from stintflow.operators.ml import cliff_classifiers, life_regressor
    from stintflow.operators.ml import scored_laps as scored
    from stintflow.plans.ml_queries import labelled

    keys = [*STINT.keys, "life"]
    df = labelled(spark, sf_dir).select(*keys, "fold", "features", "target", F.col("onset_near").cast("double").alias("y")).persist()
    train, validation = df.filter("fold = 'train'").drop("fold"), df.filter("fold = 'validation'").drop("fold")
    regressors = {"p_even": life_regressor(train, "target", trees=8)}
    regressors["p_late"] = life_regressor(train, "target", 2.5, rounds=1, trees=8, start=regressors["p_even"])
    models, weights = cliff_classifiers(train, validation, "y", trees=8)
    return scored(df.filter("fold = 'test'"), regressors, models, weights, [*keys, "target"])


@query("cluster_profiles")
def cluster_profiles(spark, sf_dir):
    from stintflow.operators.ml import cluster_profiles as profiles
    from stintflow.operators.ml import clusters

    out, _ = clusters(table(spark, sf_dir, "embeddings"), "embedding", 10)
    return profiles(out.select("cluster", *[F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(4)]), "cluster", [f"x{k}" for k in range(4)])
