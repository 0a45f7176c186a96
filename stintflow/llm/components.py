"""Connected components of a large graph: stars within tasks, then star contraction by shuffles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintflow.llm.common import fold, partitions

_HELD = 500_000
EDGE = "a long, b long"


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the graph with edges a[k] - b[k], for all nodes but the smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lx, ly = label[x], label[y]
        open_ = lx != ly
        if not open_.any():
            break
        x, y, lx, ly = x[open_], y[open_], lx[open_], ly[open_]
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


class Stars:
    """Takes edges, and gives batches (a, b) of their stars; at most half a million edges are held."""

    def __init__(self):
        self.held, self.n = [], 0

    def add(self, a: np.ndarray, b: np.ndarray):
        if not len(a):
            return
        self.held.append((a, b))
        self.n += len(a)
        if self.n >= _HELD:
            node, root = stars(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
            self.held, self.n = [(node, root)], len(node)
            if self.n >= _HELD // 2:
                yield from self.rest()

    def rest(self):
        if self.n:
            node, root = stars(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
            self.held, self.n = [], 0
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])


def _pairs(batch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(), batch.column(1).to_numpy()


def _within(batches):
    """The stars of a task's edges."""
    found = Stars()
    for batch in batches:
        yield from found.add(*_pairs(batch))
    yield from found.rest()


def _to_least(batches):
    """Over edges (a, b < a) sorted by both: every a and its other ends are tied to the least end; then a task's stars."""
    found, last, least = Stars(), None, None
    for batch in batches:
        a, b = _pairs(batch)
        if not len(a):
            continue
        new = np.concatenate(([last is None or a[0] != last], a[1:] != a[:-1]))
        low = np.concatenate(([least if least is not None else b[0]], b[new]))[np.cumsum(new)]
        last, least = a[-1], low[-1]
        yield from found.add(a, low)
        other = b > low
        yield from found.add(b[other], low[other])
    yield from found.rest()


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an undirected edge table (a, b) of longs; component is its smallest node.

    Each task first turns the edges it has into stars, without a shuffle. A round then lifts every edge's smaller end to
    the least node seen next to it (a join whose hub keys the skew rule can split) and ties all smaller ends of a node to
    the least of them (dealt by the larger end, which has at most one edge a task): large star and small star, whose edges never grow
    in number and which settle after about log(diameter) rounds. What is least next to a node is a map-side minimum; when
    no node has two, that table is the result. Null ends and loops are left out; an empty table gives an empty one.
    """
    clean = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    e = fold(spark, clean.mapInArrow(_within, EDGE), "edges")
    for _ in range(max_rounds):
        ends = e.select(F.col("a").alias("node"), "b").unionByName(e.select(F.col("b").alias("node"), "b"))
        seen = fold(spark, ends.groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high")), "least")
        if seen.filter("low <> high").isEmpty():
            return seen.select("node", F.col("low").alias("component"))
        lifted = e.join(seen.select(F.col("node").alias("b"), "low").hint("merge"), "b").select("a", F.col("low").alias("b"))
        e = fold(spark, lifted.repartition(partitions(spark), "a").sortWithinPartitions("a", "b").mapInArrow(_to_least, EDGE), "edges")
    raise RuntimeError("components did not settle")
