"""Importance resampling: hashed n-gram models of target and raw text, weights, and Gumbel top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintflow.llm.common import fold, free_name, hash_words, lower_words, mix

_FEATURES = 1 << 14


def features(text: str | None, size: int = _FEATURES) -> np.ndarray:
    """Buckets of a text's hashed words and word pairs, repeats included."""
    h = hash_words(lower_words(text), 1)
    pairs = mix(h[:-1] * np.uint64(31) + h[1:])
    return (np.concatenate([mix(h), pairs]) & np.uint64(size - 1)).astype(np.int64)


def _counts(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of all texts and of those with target = true. Each task sends its two arrays in 64 blocks."""
    block = size // 64

    def run(batches):
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            for text, good in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                f = np.bincount(features(text.as_py(), size), minlength=size)
                raw += f
                if good:
                    target += f
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64), pa.int64()), pa.array(raw.reshape(64, block).tolist()), pa.array(target.reshape(64, block).tolist())], ["block", "raw", "target"])

    parts = rows.select("text", "target").mapInArrow(run, "block long, raw array<long>, target array<long>")
    summed = parts.groupBy("block").agg(*[F.array(*[F.sum(F.col(c)[k]) for k in range(block)]).alias(c) for c in ("raw", "target")])
    raw, target = np.zeros((64, block), np.int64), np.zeros((64, block), np.int64)
    for r in summed.collect():
        raw[r["block"]], target[r["block"]] = r["raw"], r["target"]
    return raw.ravel(), target.ravel()


def log_ratio(raw: np.ndarray, target: np.ndarray, prior: float = 50.0) -> np.ndarray:
    """Log of the ratio of the two bucket models. The target's model leans on the raw one with `prior` times its rates, so
    that a bucket the target hasn't seen is unlikely there but not impossible."""
    base = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    near = (target + prior * len(raw) * base * 0.01) / (target.sum() + prior * len(raw) * 0.01)
    return np.log(near) - np.log(base)


def weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_target: int = 20_000, size: int = _FEATURES, seed: int = 11) -> DataFrame:
    """(id, n_features, log_weight, key): the log importance weight of every row and its Gumbel key.

    The raw model counts every document. The target model counts the labelled ones with label 1, at most max_target rows
    of labels chosen by a hash of the id (the documented bound; it makes the label side small enough to broadcast).
    Both are sums of fixed-size arrays. key is log_weight plus Gumbel noise drawn from the id's hash: the largest k keys
    are a sample of k without replacement in proportion to the weights, the same on every run and partitioning.
    Null and empty texts have no features and weight 0; rows with equal ids share their noise.
    """
    spark = docs.sparkSession
    picked = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("id")).filter("id is not null").distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max_target).withColumn("target", F.lit(True))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    raw, target = _counts(rows.join(F.broadcast(picked), "id", "left"), size)
    sent = spark.sparkContext.broadcast(log_ratio(raw, target))

    def run(batches):
        ratio = sent.value
        for b in batches:
            w, n = np.zeros(len(b)), np.zeros(len(b), np.int64)
            for k, text in enumerate(b.column(1)):
                f = features(text.as_py(), len(ratio))
                w[k], n[k] = ratio[f].sum(), len(f)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(w)], ["id", "n_features", "log_weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_features long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return out.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))


def gumbel_top_k(spark: SparkSession, scored: DataFrame, k: int | None = None, bins: int = 1024, most: int = 10_000) -> DataFrame:
    """scored with selected: whether a row is among the k largest keys, of rows with any type of id; exactly k are.

    By default k is the number of rows that the target model finds likelier than the raw one. Of equal keys, those with
    smaller ids come first if ids are whole numbers (null ones last), then a hash of the row decides, then the row's place in
    the stored table, so that repeated rows count one by one. The
    k-th row is found by counting (see _nth), thus only counts and a few values reach the driver and nothing is sorted
    as a whole.
    """
    place, tie = free_name(scored, "place"), free_name(scored, "tie")
    rows = fold(spark, scored.withColumns({place: F.monotonically_increasing_id(), tie: F.shiftrightunsigned(F.xxhash64(*scored.columns), 11)}), "scored")
    if k is None:
        k = rows.filter("log_weight > 0").count()
    if k <= 0 or k >= rows.count():
        return rows.select(*scored.columns, F.lit(k > 0).alias("selected"))
    chosen, level, need = F.lit(False), F.lit(True), k
    small_first = []
    if scored.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        small_first = [free_name(rows, "order")]
        rows = rows.withColumn(small_first[0], F.coalesce(-F.col("id").cast("long"), F.lit(-(1 << 63))))
    for by in ("key", *small_first, tie, place):
        cut, need, ties = _nth(rows.filter(level), by, need, bins, most)
        chosen = chosen | (level & (F.col(by) > F.lit(cut)))
        level = level & (F.col(by) == F.lit(cut))
        if need == ties:
            chosen = chosen | level
            break
    return rows.select(*scored.columns, chosen.alias("selected"))


def _nth(rows: DataFrame, by: str, need: int, bins: int, most: int) -> tuple[float, int, int]:
    """The need-th largest value of a numeric column, how many of its rows are needed, and how many rows have it.

    Rows are counted in `bins` equal steps, and again inside the step that holds the value, until that step has at most
    `most` rows, whose values are then read, or one value alone.
    """
    while True:
        low, high, n = rows.agg(F.min(by), F.max(by), F.count("*")).first()
        if low == high:
            return low, need, n
        if n <= most:
            values = sorted((r[0] for r in rows.select(by).collect()), reverse=True)
            cut = values[need - 1]
            return cut, need - sum(v > cut for v in values), sum(v == cut for v in values)
        step = F.least(F.floor((F.col(by).cast("double") - F.lit(float(low))) / F.lit((high - low) / bins)), F.lit(bins - 1))
        for b, m in sorted(((r["b"], r["n"]) for r in rows.groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True):
            if need <= m:
                rows = rows.filter(step == b)
                break
            need -= m


def op6_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return gumbel_top_k(spark, weights(docs, labels)).filter("selected").select(F.col("id").alias("doc_id"), "n_features", "log_weight", "key")
