"""Models on tables with MLlib: remaining life, cliff probability, embeddings, clusters, search."""

from __future__ import annotations

from itertools import product

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintflow.functions.scalars import blended


def assembled(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """Finite doubles as one vector; null and NaN become 0."""
    clean = df.withColumns({f"__{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol=out).transform(clean).drop(*[f"__{c}" for c in columns])


def life_regressor(train: DataFrame, label: str, late_penalty: float = 1.0, rounds: int = 2, depth: int = 4, trees: int = 15, seed: int = 3, start=None):
    """A boosted regressor of remaining life. With late_penalty over 1, rows whose life the last model overestimates get
    this weight and the model is fitted again: iterated weights approach the asymmetric least-squares fit. start is the
    fit without weights, if the caller has it already."""
    gbt = lambda w: GBTRegressor(labelCol=label, maxDepth=depth, maxIter=trees, seed=seed, **({"weightCol": w} if w else {}))
    model = start or gbt(None).fit(train)
    if late_penalty > 1:
        for _ in range(rounds):
            weighted = model.transform(train).withColumn("__w", F.when(F.col("prediction") > F.col(label), late_penalty).otherwise(1.0)).drop("prediction")
            model = gbt("__w").fit(weighted)
    return model


def cliff_classifiers(train: DataFrame, validation: DataFrame, label: str, depth: int = 4, trees: int = 15, seed: int = 3):
    """(models, weights): boosted and bagged trees with the square root of the class ratio as weight of the positives,
    combined by how far their validation AUC is above one half."""
    neg, pos = train.agg(F.sum((F.col(label) == 0).cast("long")), F.sum((F.col(label) == 1).cast("long"))).first()
    ratio = ((neg or 0) / pos) ** 0.5 if pos else 1.0
    weighted = train.withColumn("__w", F.when(F.col(label) == 1, ratio).otherwise(1.0))
    models = [GBTClassifier(labelCol=label, maxDepth=depth, maxIter=trees, seed=seed, weightCol="__w").fit(weighted), RandomForestClassifier(labelCol=label, maxDepth=depth, numTrees=trees, seed=seed, weightCol="__w").fit(weighted)]
    auc = [BinaryClassificationEvaluator(labelCol=label).evaluate(m.transform(validation)) for m in models]
    above = [max(a - 0.5, 0.0) for a in auc]
    total = sum(above)
    return models, [a / total for a in above] if total else [0.5, 0.5]


def combined_probability(df: DataFrame, models, weights: list[float], out: str = "probability_cliff") -> DataFrame:
    """df with the models' weighted probability of class 1."""
    keep = df.columns
    for k, m in enumerate(models):
        df = m.transform(df).withColumn(f"__p{k}", vector_to_array("probability")[1]).select(*keep, *[f"__p{j}" for j in range(k + 1)])
    return df.withColumn(out, sum((F.col(f"__p{k}") * w for k, w in enumerate(weights)), F.lit(0.0))).select(*keep, out)


def importances(spark, columns: list[str], model) -> DataFrame:
    """(feature, importance, share, rank, cumulative, unused, bottom_decile) by falling importance: the shares summed down
    to a feature, whether the model never splits by it, and whether it is in the last tenth of the ranks."""
    values = [float(v) for v in model.featureImportances.toArray()]
    total = sum(values) or 1.0
    order = sorted(range(len(columns)), key=lambda k: (-values[k], columns[k]))
    rows, seen = [], 0.0
    for r, k in enumerate(order):
        seen += values[k] / total
        rows.append((columns[k], values[k], values[k] / total, r + 1, seen, values[k] == 0.0, 10 * (r + 1) > 9 * len(order)))
    return spark.createDataFrame(rows, "feature string, importance double, share double, rank int, cumulative double, unused boolean, bottom_decile boolean")


def embedding(df: DataFrame, column: str, size: int = 16, out: str = "latent") -> DataFrame:
    """df with its principal components and the mean squared error of what they rebuild."""
    v = df.withColumn("__v", array_to_vector(F.col(column).cast("array<double>")))
    model = PCA(k=size, inputCol="__v", outputCol="__z").fit(v)
    pc = model.pc.toArray()
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in pc])
    z = model.transform(v).withColumn(out, vector_to_array("__z"))
    rebuilt = F.transform(rows, lambda r: F.aggregate(F.zip_with(r, F.col(out), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    gap = F.zip_with(F.col(column).cast("array<double>"), rebuilt, lambda a, b: (a - b) * (a - b))
    return z.withColumn("error", F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / F.size(column)).drop("__v", "__z")


def clusters(df: DataFrame, column: str, k: int, seed: int = 5, least: int = 3, far: float = 0.95) -> tuple[DataFrame, float]:
    """(df with cluster, silhouette): k-means, with -1 for members of clusters smaller than `least` and for points beyond
    the `far` quantile of the distance to their centre. Density clustering's noise is a rule after the fact here."""
    v = df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))
    model = KMeans(k=k, seed=seed).fit(v)
    got = model.transform(v)
    silhouette = ClusteringEvaluator().evaluate(got)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    centre = F.element_at(centres, F.col("prediction") + 1)
    got = got.withColumn("__d", F.aggregate(F.zip_with(F.col(column).cast("array<double>"), centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    sizes = got.groupBy("prediction").agg(F.count("*").alias("__n"))
    cut = got.agg(F.percentile("__d", F.lit(far)).alias("__cut"))
    out = got.join(F.broadcast(sizes), "prediction").crossJoin(F.broadcast(cut))
    return out.withColumn("cluster", F.when((F.col("__n") < least) | (F.col("__d") > F.col("__cut")), -1).otherwise(F.col("prediction"))).drop("prediction", "features", "__n", "__d", "__cut"), silhouette


def cluster_profiles(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """(cluster, n, share, and by column its mean and how far that lies from the mean of all, in standard deviations)."""
    total = df.agg(F.count("*").alias("__all"), *[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"__s_{c}") for c in columns])
    own = df.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in columns]).crossJoin(F.broadcast(total))
    return own.select(cluster, "n", (F.col("n") / F.col("__all")).alias("share"), *[x for c in columns for x in (F.col(f"{c}_mean"), F.try_divide(F.col(f"{c}_mean") - F.col(f"__m_{c}"), F.col(f"__s_{c}")).alias(f"{c}_z"))])


def scored_laps(df: DataFrame, regressors: dict, classifiers, weights: list[float], keep: list[str], start: float = 12.0, width: float = 6.0) -> DataFrame:
    """A row a lap: keep, a prediction of each of two regressors (by name), their blend, and probability_cliff."""
    names = list(regressors)
    for name, model in regressors.items():
        df = model.transform(df).withColumnRenamed("prediction", name)
    df = df.withColumn("blend", blended(F.col(names[0]), F.col(names[1]), start, width))
    return combined_probability(df.select(*keep, *names, "blend", "features"), classifiers, weights).drop("features")


def searched(train: DataFrame, validation: DataFrame, label: str, depths: list[int], trees: list[int], seed: int = 3) -> DataFrame:
    """(depth, trees, mae) on a fixed validation set by rising error."""
    spark = train.sparkSession
    rows = []
    for d, t in product(depths, trees):
        m = life_regressor(train, label, depth=d, trees=t, seed=seed)
        rows.append((d, t, m.transform(validation).agg(F.avg(F.abs(F.col("prediction") - F.col(label)))).first()[0]))
    return spark.createDataFrame(sorted(rows, key=lambda r: (r[2] if r[2] is not None else 1e300)), "depth int, trees int, mae double")
