"""Regression and classification metrics, thresholds, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintflow.operators.fits import exact_quantiles
from stintflow.operators.ranks import global_rank
from stintflow.sources.tables import stored


def _finite(*cols: Column) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok


def regression_metrics(df: DataFrame, y: str, p: str, critical: float = 10.0, early: float = 10.0, late: float = 5.0, keys: list[str] = ()) -> DataFrame:
    """n, MAE, RMSE, R2 of all, critical (y <= critical) and other rows, and the asymmetric score sum(exp(|d| / a) - 1),
    d = p - y, with a = late for predictions above the truth and early below. Rows that aren't finite are left out."""
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    d = pp - yy
    rows = df.filter(_finite(yy, pp))

    def part(name: str, cond: Column) -> list[Column]:
        e, t = F.when(cond, d), F.when(cond, yy)
        return [F.count(e).alias(f"n{name}"), F.avg(F.abs(e)).alias(f"mae{name}"), F.sqrt(F.avg(e * e)).alias(f"rmse{name}"), (1 - F.try_divide(F.sum(e * e), F.var_pop(t) * F.count(t))).alias(f"r2{name}")]

    score = F.sum(F.exp(F.when(d >= 0, d / late).otherwise(-d / early)) - 1).alias("score")
    return rows.groupBy(*keys).agg(*part("", F.lit(True)), *part("_critical", yy <= critical), *part("_other", yy > critical), score)


def scores_counted(df: DataFrame, y: str, prob: str, n: str = "n") -> DataFrame:
    """(y, prob, n): the rows of each label and score as one, stored: several metrics then score the rows once."""
    return stored(df.sparkSession, df.groupBy(y, prob).agg(F.count("*").alias(n)), "scores")


def classification_metrics(df: DataFrame, y: str, prob: str, threshold: float, rows: str | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, F1. `rows` names how many rows a row stands for; by default one."""
    hit, said = F.col(y) == 1, F.col(prob) >= threshold
    many = F.col(rows) if rows else F.lit(1)
    n = lambda c, a: F.coalesce(F.sum(c.cast("long") * many), F.lit(0)).alias(a)
    one = df.filter(F.col(y).isNotNull() & F.col(prob).isNotNull()).agg(n(hit & said, "tp"), n(~hit & said, "fp"), n(hit & ~said, "fn"), n(~hit & ~said, "tn"))
    c = F.col
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return one.select("*", zero(F.try_divide(c("tp"), c("tp") + c("fp"))).alias("precision"), zero(F.try_divide(c("tp"), c("tp") + c("fn"))).alias("recall"), zero(F.try_divide(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn"))).alias("f1"))


def roc_auc(df: DataFrame, y: str, prob: str, rows: str | None = None) -> DataFrame:
    """Area under the ROC curve from mid-ranks: rows are counted by score first, then ranked over the distinct scores.
    `rows` names how many rows a row stands for; by default one.

    Counts before each score come from range partitions: a running sum inside each, and the sums of those before it, so
    no task sees all scores.
    """
    many = F.col(rows) if rows else F.lit(1)
    by = df.filter(F.col(y).isNotNull() & F.col(prob).isNotNull()).groupBy(F.col(prob).alias("s")).agg(F.sum(many).alias("n"), F.sum(F.col(y).cast("long") * many).alias("pos"))
    cut = by.agg(F.percentile_approx("s", F.array(*[F.lit(k / 64) for k in range(1, 64)]), 1000).alias("cuts"))
    part = by.crossJoin(F.broadcast(cut)).withColumn("part", F.size(F.filter("cuts", lambda c: c <= F.col("s")))).drop("cuts")
    before = part.groupBy("part").agg(F.sum("n").alias("m")).withColumn("below", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    w = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = part.withColumn("inside", F.coalesce(F.sum("n").over(w), F.lit(0))).join(F.broadcast(before), "part")
    rank = F.col("below") + F.col("inside") + (F.col("n") + 1) / 2
    one = ranked.agg(F.sum(F.col("pos") * rank).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("all"))
    return one.select((F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("all") - F.col("p")))).alias("auc"))


def threshold_search(df: DataFrame, y: str, prob: str, most: int = 200, near: float = 0.99) -> DataFrame:
    """(threshold, tp, fp, fn, f1, chosen) at up to `most` quantiles of the probability; chosen is the smallest threshold
    within 1 % of the best F1. Each row adds to one bucket between thresholds; counts above are sums over the buckets."""
    rows = df.filter(F.col(y).isNotNull() & F.col(prob).isNotNull()).select(F.col(y).cast("long").alias("y"), F.col(prob).alias("p"))
    qs = rows.agg(F.array_sort(F.array_distinct(F.percentile("p", F.array(*[F.lit(k / (most - 1)) for k in range(most)])))).alias("t"))
    placed = rows.crossJoin(F.broadcast(qs)).groupBy("t", F.size(F.filter("t", lambda t: t <= F.col("p"))).alias("b")).agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    listed = placed.groupBy("t").agg(F.collect_list(F.struct("b", "n", "pos")).alias("c"), F.sum("n").alias("all"), F.sum("pos").alias("all_pos"))
    each = listed.select(F.posexplode("t").alias("k", "threshold"), "c", "all_pos")
    above = F.filter("c", lambda x: x["b"] > F.col("k"))
    add = lambda f: F.aggregate(F.transform(above, lambda x: x[f]), F.lit(0).cast("long"), lambda a, x: a + x)
    out = each.select("threshold", add("pos").alias("tp"), (add("n") - add("pos")).alias("fp"), "all_pos").withColumn("fn", F.col("all_pos") - F.col("tp"))
    out = out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))).drop("all_pos")
    best = out.agg(F.max("f1").alias("__best"))
    ok = out.crossJoin(F.broadcast(best)).filter(F.col("f1") >= near * F.col("__best")).agg(F.min("threshold").alias("__t"))
    return out.crossJoin(F.broadcast(ok)).withColumn("chosen", F.col("threshold") == F.col("__t")).drop("__t")


def baselines(train: DataFrame, test: DataFrame, y: str, category: str) -> DataFrame:
    """test with p_constant, the mean of train, and p_category, the category's mean or the constant."""
    constant = train.agg(F.avg(y).alias("p_constant"))
    by = train.groupBy(category).agg(F.avg(y).alias("__m"))
    return test.join(by, category, "left").crossJoin(F.broadcast(constant)).withColumn("p_category", F.coalesce("__m", "p_constant")).drop("__m")


def split(df: DataFrame, season: Column, train: list, validation: list, test: list) -> DataFrame:
    """df with fold: train, validation or test by lists of seasons; other rows have null."""
    return df.withColumn("fold", F.when(season.isin(train), "train").when(season.isin(validation), "validation").when(season.isin(test), "test"))


def standardised(df: DataFrame, columns: list[str], fold: str = "fold") -> DataFrame:
    """z_<column> with the train rows' mean and sample spread: values that aren't finite are 0 before, a spread of 0 or
    null is 1."""
    v = lambda c: F.when(_finite(F.col(c).cast("double")), F.col(c).cast("double")).otherwise(0.0)
    train = F.col(fold) == "train"
    stats = df.agg(*[F.avg(F.when(train, v(c))).alias(f"__m_{c}") for c in columns], *[F.stddev_samp(F.when(train, v(c))).alias(f"__s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        s = F.when(F.coalesce(F.col(f"__s_{c}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"__s_{c}"))
        out = out.withColumn(f"z_{c}", (v(c) - F.coalesce(F.col(f"__m_{c}"), F.lit(0.0))) / s)
    return out.drop(*[f"__{x}_{c}" for x in "ms" for c in columns])


def category_codes(df: DataFrame, column: str, unknown: str = "UNKNOWN") -> DataFrame:
    """code: place of the value (null: UNKNOWN) among the sorted distinct values, which are ranked by ranges."""
    v = F.coalesce(F.col(column), F.lit(unknown))
    coded = global_rank(df.select(v.alias("__v")).distinct(), ["__v"], "code")
    return df.withColumn("__v", v).join(coded, "__v").drop("__v")


def one_hot(df: DataFrame, column: str, levels: list[str] | None = None, most: int = 200) -> DataFrame:
    """df with a 0/1 column for each level; by default for the observed ones in order, of which there may be at most `most`."""
    if levels is None:
        levels = sorted(r[0] for r in df.select(F.col(column).cast("string")).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect())
        if len(levels) > most:
            raise ValueError(f"{column} has over {most} levels")
    return df.withColumns({f"{column}_{lv}": F.coalesce((F.col(column) == lv).cast("int"), F.lit(0)) for lv in levels})


def sequences(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """(keys, steps): each stint's vectors in order. A stint is bounded by a race's length."""
    return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.array(*[F.col(c).cast("double") for c in columns]).alias("v")))), lambda x: x["v"]).alias("steps"))


def noise_floor(samples: DataFrame, keys: list[str], value: str, rmse: float, fraction: float, seed: int) -> DataFrame:
    """Mean within-key spread of a Bernoulli sample against a model's RMSE."""
    spread = samples.sample(False, fraction, seed).groupBy(*keys).agg(F.stddev_samp(value).alias("s"))
    return spread.agg(F.avg("s").alias("noise"), (F.avg("s") / rmse).alias("ratio"))


def signature(vectors: DataFrame, keys: list[str], column: str, size: int) -> DataFrame:
    """Mean of each element of a vector column by key, and rows."""
    return vectors.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.avg(F.col(column)[k]) for k in range(size)]).alias("signature"))


def outliers(df: DataFrame, value: str, q: float = 0.99) -> DataFrame:
    """Adds is_outlier: above the exact quantile of all rows, which is found by refinement and is one row."""
    cut = exact_quantiles(df, [], value, [q]).select(F.col("quantiles")[0].alias("__q"))
    return df.crossJoin(F.broadcast(cut)).withColumn("is_outlier", F.col(value) > F.col("__q")).drop("__q")
