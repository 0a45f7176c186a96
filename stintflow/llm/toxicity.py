"""Toxicity by a classifier chain: each category's linear model sees the probabilities of the categories before it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a feature token: all ASCII but letters, which are lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def tokens(text: str | None) -> set[bytes]:
    """The distinct lower-cased words of a text without digits, punctuation and marks."""
    return set(text.encode("utf-8", "replace").translate(_FOLD).split()) if text else set()


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """(id, text, fold_key, y array<int>) of at most max_rows labelled rows, chosen by a hash of the id.

    max_rows is the documented bound on what the models are fitted on; it also bounds the broadcast side of the join.
    Where several rows have one id, the one whose text has the least hash stands for it. Rows with a null id or a null
    label are not used.
    """
    picked = labels.select(F.col(id_col).alias("id"), F.array(*[F.col(c).cast("int") for c in categories]).alias("y")).filter("id is not null and not exists(y, v -> v is null)")
    picked = picked.groupBy("id").agg(F.min("y").alias("y")).withColumn("fold_key", F.xxhash64(F.col("id"), F.lit(seed))).orderBy("fold_key", "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")
    return rows.groupBy("id").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"), F.first("fold_key").alias("fold_key"), F.first("y").alias("y")).select("id", "text", "y", "fold_key")


def vocabulary(sample: DataFrame, n_categories: int, size: int = 512, least: int = 5) -> list[bytes]:
    """The words most tied to any category: per category the size words with the largest |z| of their document counts.

    Counted by Spark over the sample: words are counted per task first and then by word.
    """

    def count(batches):
        seen: dict[bytes, np.ndarray] = {}
        for b in batches:
            ys = b.column(1).to_pylist()
            for text, y in zip(b.column(0).to_pylist(), ys, strict=True):
                add = np.array([1, *y], np.int64)
                for w in tokens(text):
                    if w in seen:
                        seen[w] += add
                    else:
                        seen[w] = add.copy()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([v.tolist() for v in seen.values()], pa.list_(pa.int64()))], ["word", "n"])

    n = [F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(n_categories + 1)]
    words = sample.select("text", "y").mapInArrow(count, "word binary, n array<long>").groupBy("word").agg(*n).filter(F.col("n0") >= least)
    head = sample.agg(F.count("*"), *[F.sum(F.col("y")[k]) for k in range(n_categories)]).first()
    total = max(1, head[0])
    chosen: dict[bytes, None] = {}
    for k in range(1, n_categories + 1):
        rate = (head[k] or 0) / total
        z = F.abs(F.col(f"n{k}") - F.col("n0") * rate) / F.sqrt(F.col("n0") * max(rate * (1 - rate), 1e-6))
        for r in words.select("word", z.alias("z")).filter("z >= 3").orderBy(F.desc("z"), "word").limit(size).collect():
            chosen.setdefault(bytes(r["word"]))
    return list(chosen)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25, extra: np.ndarray | None = None, chunk: int = 1024) -> np.ndarray:
    """Weights (words, extra columns, bias) of a ridge logistic regression by Newton steps; the bias isn't shrunk.

    Gradient and curvature are summed over chunks of rows, so beside x (bytes of 0 and 1) only one chunk is held as
    doubles.
    """
    extra = np.zeros((len(x), 0)) if extra is None else extra
    size = x.shape[1] + extra.shape[1] + 1
    w, shrink = np.zeros(size), np.full(size, ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        grad, curve = shrink * w, np.diag(shrink)
        for k in range(0, len(x), chunk):
            part = np.hstack([x[k : k + chunk].astype(np.float64), extra[k : k + chunk], np.ones((len(x[k : k + chunk]), 1))])
            p = sigmoid(part @ w)
            grad += part.T @ (p - y[k : k + chunk])
            curve += (part * (p * (1 - p) + 1e-6)[:, None]).T @ part
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    return w


def linear(x: np.ndarray, extra: np.ndarray, w: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """x and extra times w, by chunks of rows."""
    n = x.shape[1]
    return np.concatenate([x[k : k + chunk].astype(np.float64) @ w[:n] for k in range(0, len(x), chunk)] or [np.zeros(0)]) + extra @ w[n:-1] + w[-1]


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap below the cut with the largest F1; at least 0.05."""
    order = np.argsort(-p, kind="stable")
    ranked, hits = p[order], np.cumsum(y[order])
    ends = np.append(np.flatnonzero(np.diff(ranked) < 0), len(ranked) - 1)
    f1 = 2 * hits[ends] / (ends + 1 + max(1.0, y.sum()))
    k = int(np.argmax(f1))
    below = ranked[ends[k] + 1] if ends[k] + 1 < len(ranked) else 0.0
    return float(max(0.05, (ranked[ends[k]] + below) / 2)) if y.any() else 0.5


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Chain:
    """Words and, per category, weights over words, the probabilities of the earlier categories, and a bias.

    thresholds has, per category, the out-of-fold probability that gave the best F1 (one half without any labels).
    """

    def __init__(self, categories: list[str], words: list[bytes], weights: list[np.ndarray], thresholds: list[float]):
        self.categories, self.words, self.weights, self.thresholds = categories, words, weights, thresholds

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.categories)))
        for k, w in enumerate(self.weights):
            out[:, k] = sigmoid(np.hstack([x, out[:, :k]]) @ w[:-1] + w[-1])
        return out


def fit_chain(spark: SparkSession, sample: DataFrame, categories: list[str], size: int = 512, folds: int = 4, ridge: float = 0.3) -> Chain:
    """The chain of the categories in the given order.

    Category k is fitted on words and the out-of-fold probabilities of categories 0 to k-1: for each fold, a model of the
    other folds scores it. The fits of a category (its folds and the final one) run as one Spark job, a task each; what
    a task holds is the bounded sample as bits of at most size words a category. Without labelled rows all
    probabilities are one half and nothing reaches its threshold; a category of one class gets its constant.
    """
    from pyspark.sql import types as T

    words = vocabulary(sample, len(categories), size)
    index = {w: k for k, w in enumerate(words)}

    def bits(batches):
        for b in batches:
            hits = [sorted(index[w] for w in tokens(t) if w in index) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(hits, pa.list_(pa.int32()))], ["y", "fold_key", "hits"])

    rows = sorted((r["fold_key"], r["y"], r["hits"]) for r in sample.select("text", "y", "fold_key").mapInArrow(bits, "y array<int>, fold_key long, hits array<int>").collect())
    if not rows:
        return Chain(categories, words, [np.zeros(len(words) + k + 1) for k in range(len(categories))], [1.01] * len(categories))
    x = np.zeros((len(rows), len(words)), np.uint8)
    for k, (_, _, hits) in enumerate(rows):
        x[k, hits] = 1
    y = np.array([r[1] for r in rows], np.float64)
    fold = np.arange(len(rows)) % folds
    sent = spark.sparkContext.broadcast((np.packbits(x, axis=1), x.shape[1], y, fold))
    before = np.zeros((len(rows), 0))
    weights: list[np.ndarray] = []
    thresholds: list[float] = []
    for k in range(len(categories)):
        earlier = before

        def fit(batches, k=k, earlier=earlier):
            packed, wide, ys, f = sent.value
            xs = np.unpackbits(packed, axis=1)[:, :wide]
            for b in batches:
                for out in b.column(0).to_pylist():
                    rest = f != out
                    w = fit_logistic(xs[rest], ys[rest, k], ridge, extra=earlier[rest])
                    p = sigmoid(linear(xs[~rest], earlier[~rest], w))
                    yield pa.RecordBatch.from_arrays([pa.array([out], pa.int64()), pa.array([w.tolist()]), pa.array([p.tolist()], pa.list_(pa.float64()))], ["fold", "w", "p"])

        jobs = spark.range(0, folds + 1, 1, folds + 1)
        got = {r["fold"]: r for r in jobs.mapInArrow(fit, T.StructType.fromDDL("fold long, w array<double>, p array<double>")).collect()}
        held = np.zeros(len(rows))
        for f in range(folds):
            held[fold == f] = got[f]["p"]
        weights.append(np.array(got[folds]["w"]))
        thresholds.append(best_threshold(held, y[:, k]))
        before = np.hstack([before, held[:, None]])
    return Chain(categories, words, weights, thresholds)


def score(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """docs with a column <prefix><category> for each category; null and empty texts are scored as texts without words.

    A column of docs that has such a name already, in any case, is replaced.
    """
    spark = docs.sparkSession
    new = {f"{prefix}{c}".lower() for c in chain.categories}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    sent = spark.sparkContext.broadcast((chain.categories, chain.words, chain.weights, chain.thresholds))
    names = [f"{prefix}{c}" for c in chain.categories]

    def run(batches):
        own = Chain(*sent.value)
        categories, words = own.categories, own.words
        known, index = frozenset(words), {w: k for k, w in enumerate(words)}
        for b in batches:
            texts = b.column(at)
            parts = []
            for k in range(0, len(b), 512):
                part = texts.slice(k, 512).to_pylist()
                x = np.zeros((len(part), len(words)))
                for i, t in enumerate(part):
                    x[i, [index[w] for w in known & tokens(t)]] = 1
                parts.append(own.probabilities(x))
            p = np.concatenate(parts) if parts else np.zeros((0, len(categories)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, k]) for k in range(len(categories)))], [*b.schema.names, *names])

    at = docs.columns.index(text_col)
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return docs.mapInArrow(run, schema)


CATEGORIES = ["quality", "toxic"]


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, categories: list[str] | None = None, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, text, p_<category>..., toxic) of every row: toxic is that the last category's probability reaches its
    threshold, which is set on the out-of-fold probabilities.

    The chain runs over the label columns in the given order, the judged category last.
    """
    own = categories or CATEGORIES
    rows = docs.select("doc_id", "text")
    chain = fit_chain(spark, labelled_sample(rows, labels, own, max_rows), own)
    return score(rows, chain).withColumn("toxic", F.col(f"p_{own[-1]}") >= chain.thresholds[-1])


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, categories: list[str] | None = None, max_rows: int = 20_000) -> DataFrame:
    """The rows of docs, all columns, that the chain doesn't judge toxic."""
    own = categories or CATEGORIES
    chain = fit_chain(spark, labelled_sample(docs, labels, own, max_rows), own)
    prefix = "p_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return score(docs, chain, prefix=prefix).filter(F.col(f"{prefix}{own[-1]}") < chain.thresholds[-1]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(spark, docs, labels).drop("text")
