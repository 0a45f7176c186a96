"""Metrics and models over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintflow.operators import labels as B
from stintflow.operators import metrics as M
from stintflow.operators import stints as W
from stintflow.plans.registry import query
from stintflow.plans.roles import LAPS_SQL, STINT, laps, table

_REG_SQL = "p AS (SELECT (l_quantity)::DOUBLE AS y, l_quantity * 0.9::DOUBLE + (l_linenumber - 3) * 1.5::DOUBLE AS p, year(l_shipdate) AS season, l_returnflag AS c, l_partkey FROM lineitem)"


def _reg(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_quantity").cast("double").alias("y"), (F.col("l_quantity") * 0.9 + (F.col("l_linenumber") - 3) * 1.5).alias("p"), F.year("l_shipdate").alias("season"), F.col("l_returnflag").alias("c"), "l_partkey")


def _part(name: str, cond: str) -> str:
    return f"count(*) FILTER ({cond}) AS n{name}, round(avg(abs(p - y)) FILTER ({cond}), 4) AS mae{name}, round(sqrt(avg((p - y) * (p - y)) FILTER ({cond})), 4) AS rmse{name}, round(1 - sum((p - y) * (p - y)) FILTER ({cond}) / (var_pop(y) FILTER ({cond}) * count(*) FILTER ({cond})), 4) AS r2{name}"


@query("regression_metrics", f"WITH {_REG_SQL} SELECT season, {_part('', 'true')}, {_part('_critical', 'y <= 10')}, {_part('_other', 'y > 10')}, round(sum(exp(CASE WHEN p >= y THEN (p - y) / 5 ELSE (y - p) / 10 END) - 1), 4) AS score FROM p GROUP BY season", 4)
def regression_metrics(spark, sf_dir):
    return M.regression_metrics(_reg(spark, sf_dir), "y", "p", keys=["season"])


_CLS_SQL = "s AS (SELECT (quality = 0)::INT AS y, least(n_chars / 4000.0::DOUBLE, 1.0) AS prob FROM labels JOIN documents USING (doc_id))"


def _cls(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select((F.col("quality") == 0).cast("int").alias("y"), F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("prob"))


@query("classification_metrics", f"WITH {_CLS_SQL}, c AS (SELECT count(*) FILTER (y = 1 AND prob >= 0.4) AS tp, count(*) FILTER (y <> 1 AND prob >= 0.4) AS fp, count(*) FILTER (y = 1 AND prob < 0.4) AS fn, count(*) FILTER (y <> 1 AND prob < 0.4) AS tn FROM s) SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 5) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 5) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 5) AS f1 FROM c")
def classification_metrics(spark, sf_dir):
    return M.classification_metrics(_cls(spark, sf_dir), "y", "prob", 0.4)


@query("roc_auc", f"WITH {_CLS_SQL}, r AS (SELECT y, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS r FROM s) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 5) AS auc FROM r")
def roc_auc(spark, sf_dir):
    return M.roc_auc(_cls(spark, sf_dir), "y", "prob")


@query("threshold_search", f"""WITH {_CLS_SQL}, t AS (SELECT DISTINCT unnest(quantile_cont(prob, [{", ".join(repr(k / 49) for k in range(50))}])) AS threshold FROM s), m AS (SELECT threshold, count(*) FILTER (y = 1 AND prob >= threshold) AS tp, count(*) FILTER (y <> 1 AND prob >= threshold) AS fp, count(*) FILTER (y = 1 AND prob < threshold) AS fn FROM s, t GROUP BY 1), f AS (SELECT *, 2 * tp / (2 * tp + fp + fn) AS f1 FROM m)
SELECT round(threshold, 5) AS threshold, tp, fp, fn, round(f1, 5) AS f1, (threshold = (SELECT min(threshold) FROM f WHERE f1 >= 0.99 * (SELECT max(f1) FROM f)))::INT::BIGINT AS chosen FROM f""")
def threshold_search(spark, sf_dir):
    return M.threshold_search(_cls(spark, sf_dir), "y", "prob", 50)


@query("baselines", f"WITH {_REG_SQL}, a AS (SELECT avg(y) AS p_constant FROM p WHERE season < 1997), b AS (SELECT c, avg(y) AS m FROM p WHERE season < 1997 GROUP BY c) SELECT p.c, count(*) AS n, round(avg(abs(p.y - a.p_constant)), 4) AS mae_constant, round(avg(abs(p.y - coalesce(b.m, a.p_constant))), 4) AS mae_category FROM p LEFT JOIN b USING (c), a WHERE p.season >= 1997 GROUP BY p.c", 4)
def baselines(spark, sf_dir):
    df = _reg(spark, sf_dir)
    out = M.baselines(df.filter("season < 1997"), df.filter("season >= 1997"), "y", "c")
    return out.groupBy("c").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("p_constant"))).alias("mae_constant"), F.avg(F.abs(F.col("y") - F.col("p_category"))).alias("mae_category"))


@query("standardised", f"WITH {_REG_SQL}, f AS (SELECT *, CASE WHEN season IN (1995, 1996, 1997) THEN 'train' WHEN season = 1998 THEN 'validation' WHEN season = 1999 THEN 'test' END AS fold FROM p), m AS (SELECT avg(y) AS a, stddev_samp(y) AS b, avg(p) AS c, stddev_samp(p) AS d FROM f WHERE fold = 'train') SELECT coalesce(fold, 'none') AS fold, count(*) AS n, round(avg((y - a) / b), 4) + 0.0 AS zy, round(stddev_samp((f.p - m.c) / d), 4) AS sp FROM f, m GROUP BY 1", 4)
def standardised(spark, sf_dir):
    df = M.split(_reg(spark, sf_dir), F.col("season"), [1995, 1996, 1997], [1998], [1999])
    return M.standardised(df, ["y", "p"]).groupBy(F.coalesce("fold", F.lit("none")).alias("fold")).agg(F.count("*").alias("n"), F.avg("z_y").alias("zy"), F.stddev_samp("z_p").alias("sp"))


@query("category_codes", "WITH v AS (SELECT coalesce(CASE WHEN p_size > 40 THEN NULL ELSE p_brand END, 'UNKNOWN') AS b, p_type FROM part), l AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS code FROM (SELECT DISTINCT b FROM v)) SELECT code, count(*) AS n, sum((p_type = 'ECONOMY')::INT)::BIGINT AS economy FROM v JOIN l USING (b) GROUP BY code")
def category_codes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_size") <= 40, F.col("p_brand")).alias("b"), "p_type")
    return M.one_hot(M.category_codes(p, "b"), "p_type", ["ECONOMY"]).groupBy("code").agg(F.count("*").alias("n"), F.sum("p_type_ECONOMY").alias("economy"))


@query("signatures", "SELECT label::BIGINT AS label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 5) + 0.0 AS first, round(avg(embedding[64]::DOUBLE), 5) + 0.0 AS last FROM embeddings GROUP BY label")
def signatures(spark, sf_dir):
    s = M.signature(table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e")), ["label"], "e", 64)
    return s.select("label", "n", F.col("signature")[0].alias("first"), F.col("signature")[63].alias("last"))


@query("outliers", "WITH q AS (SELECT quantile_cont(value, 0.99) AS q FROM events) SELECT event_id FROM events, q WHERE value > q")
def outliers(spark, sf_dir):
    return M.outliers(table(spark, sf_dir, "events"), "value").filter("is_outlier").select("event_id")


@query("stint_sequences", f"WITH {LAPS_SQL} SELECT driver, season, stint, count(*) AS n_steps, list_aggregate(list_transform(list(pace ORDER BY life), lambda x: coalesce(round(x, 1)::DECIMAL(9,1)::VARCHAR, '-')), 'string_agg', ' ') AS paces FROM laps GROUP BY 1, 2, 3")
def stint_sequences(spark, sf_dir):
    s = M.sequences(laps(spark, sf_dir), ["driver", "season", "stint"], ["life"], ["pace"])
    return s.select("driver", "season", "stint", F.size("steps").alias("n_steps"), F.array_join(F.transform("steps", lambda v: F.coalesce(F.round(v[0] * 1.00000000001, 1).cast("decimal(9,1)").cast("string"), F.lit("-"))), " ").alias("paces"))


_FEATURES = ["roll_mean", "roll_std", "slope", "gap_to_best", "life", "temp"]


def labelled(spark, sf_dir):
    """The labelled frame: eligible stints, green features, labels, fold by season."""
    from stintflow.operators.ml import assembled

    df = W.eligible(laps(spark, sf_dir), STINT, "pace", "flag", "rain").filter("keep")
    df = B.remaining_life(W.green_features(df, STINT, "pace", "flag"), STINT, "pace", "life", "flag", "stint", {"R": 15, "A": 22})
    df = M.split(df, F.col("season"), [1995, 1996, 1997], [1998], [1999, 2000, 2001]).filter("fold is not null")
    return assembled(df.withColumn("target", F.col("target_life").cast("double")), _FEATURES)


@query("life_models")
def life_models(spark, sf_dir):
    from stintflow.operators.ml import life_regressor

    df = labelled(spark, sf_dir).select("fold", "stint", "features", "target").persist()
    train, test = df.filter("fold = 'train'"), df.filter("fold = 'test'")
    models = {"symmetric": life_regressor(train, "target", trees=8)}
    models["late"] = life_regressor(train, "target", 2.5, rounds=1, trees=8, start=models["symmetric"])
    scored = M.baselines(train, test, "target", "stint").withColumnsRenamed({"p_category": "category", "p_constant": "constant"})
    for name, model in models.items():
        scored = model.transform(scored).withColumnRenamed("prediction", name)
    each = F.array(*[F.struct("target", F.col(name).alias("prediction"), F.lit(name).alias("model")) for name in (*models, "constant", "category")])
    return M.regression_metrics(scored.select(F.inline(each)), "target", "prediction", keys=["model"])


@query("cliff_models")
def cliff_models(spark, sf_dir):
    from stintflow.operators.ml import cliff_classifiers, combined_probability

    df = labelled(spark, sf_dir).select("fold", "features", F.col("onset_near").cast("double").alias("y")).persist()
    models, weights = cliff_classifiers(df.filter("fold = 'train'"), df.filter("fold = 'validation'"), "y", trees=8)
    scored = combined_probability(df.filter("fold = 'test'").select("features", "y"), models, weights, "p")
    counted = M.scores_counted(scored, "y", "p")
    df.unpersist()
    return M.classification_metrics(counted, "y", "p", 0.5, "n").crossJoin(M.roc_auc(counted, "y", "p", "n"))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    from stintflow.operators.ml import importances, life_regressor

    df = labelled(spark, sf_dir).filter("fold = 'train'").select("features", "target").persist()
    return importances(spark, _FEATURES, life_regressor(df, "target", trees=8))


@query("model_search")
def model_search(spark, sf_dir):
    from stintflow.operators.ml import searched

    df = labelled(spark, sf_dir).select("fold", "features", "target").persist()
    return searched(df.filter("fold = 'train'"), df.filter("fold = 'validation'"), "target", [2, 4], [5])


@query("style_embedding")
def style_embedding(spark, sf_dir):
    from stintflow.operators.ml import embedding

    e = embedding(table(spark, sf_dir, "embeddings"), "embedding", 8)
    return M.outliers(e, "error").select("vec_id", "label", F.col("latent")[0].alias("latent_0"), "error", "is_outlier")


@query("style_clusters")
def style_clusters(spark, sf_dir):
    from stintflow.operators.ml import clusters

    out, silhouette = clusters(table(spark, sf_dir, "embeddings"), "embedding", 10)
    return out.groupBy("cluster").agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels")).withColumn("silhouette", F.lit(silhouette))


@query("live_snapshots", f"""WITH {LAPS_SQL}, f AS (SELECT driver, season, lap, stint, pace + 0.03 * lap AS y FROM laps WHERE pace IS NOT NULL), n AS (SELECT *, coalesce(stint <> lag(stint) OVER (PARTITION BY driver, season ORDER BY lap), true)::INT AS new FROM f), g AS (SELECT *, sum(new) OVER (PARTITION BY driver, season ORDER BY lap) AS part FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY driver, season, part ORDER BY lap)::DOUBLE AS x FROM g)
SELECT driver, season, lap::BIGINT AS lap, part::BIGINT AS stint_no, x::BIGINT AS laps_into_stint, round(y, 4) AS fuel_corr, round(y - min(y) OVER w, 4) + 0.0 AS pace_above_best, (y - min(y) OVER w > 1.5)::INT::BIGINT AS in_cliff_now,
  round(CASE WHEN x < 2 THEN 0 ELSE (x * sum(x * y) OVER w - sum(x) OVER w * sum(y) OVER w) / (x * sum(x * x) OVER w - sum(x) OVER w * sum(x) OVER w) END, 3) + 0.0 AS slope FROM r WINDOW w AS (PARTITION BY driver, season, part ORDER BY lap ROWS UNBOUNDED PRECEDING)""", 4)
def live_snapshots(spark, sf_dir):
    from stintflow.streaming.live import batch_snapshots

    df = laps(spark, sf_dir).filter("pace is not null").select("driver", "season", "lap", F.col("stint").alias("compound"), F.col("pace").alias("laptime"))
    out = batch_snapshots(df, ["driver", "season"])
    return out.select("driver", "season", "lap", "stint_no", "laps_into_stint", "fuel_corr", "pace_above_best", "in_cliff_now", F.round(F.col("slope") * 1.00000000001, 3).alias("slope"))
