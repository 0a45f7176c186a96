"""SimHash near-duplicates: fingerprints linked by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintflow.llm.common import fold, free_name, lower_words, partitions, row_hashes
from stintflow.llm.components import EDGE, Stars, connected_components

_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of one text: a bit is 1 if set in over half of the shingle hashes (0 without words)."""
    ws = lower_words(text)
    if not ws:
        return 0
    h = xxhash.xxh64_intdigest
    if len(ws) <= shingle:
        return h(b" ".join(ws), seed)
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(ws) - shingle + 1].tolist()
    hs = np.fromiter((h(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    octets = hs.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return sum(1 << int(k) for k in np.flatnonzero(2 * counts > len(hs)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) of every row; fp holds the unsigned fingerprint's bits as a long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _ball(width: int, radius: int) -> list[int]:
    """All masks of at most radius of width bits."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _runs(max_group: int, radius: int):
    """Over rows sorted by (part, key, fp): stars of the verified links inside small buckets, members of large ones (a = b).

    Rows of one bucket are compared at growing offsets, all buckets at once; what is carried from batch to batch is
    at most max_group + 1 rows, since a bucket that grows past this is only passed on.
    """

    def links(part, key, fp):
        new = np.concatenate(([True], (part[1:] != part[:-1]) | (key[1:] != key[:-1])))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        each = np.repeat(size, size)
        big = each > max_group
        out_a, out_b = [fp[:0]], [fp[:0]]
        rank = np.arange(len(key)) - np.repeat(start, size)
        at = np.flatnonzero(~big & (each > 1))
        for k in range(1, max_group):
            at = at[rank[at] + k < each[at]]
            if not len(at):
                break
            a, b = fp[at], fp[at + k]
            ok = _popcount(a ^ b) <= radius
            out_a.append(a[ok])
            out_b.append(b[ok])
        return np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64), fp[big]

    def passed(big):
        if len(big):
            big = pa.array(np.unique(big).view(np.int64))
            yield pa.RecordBatch.from_arrays([big, big], ["a", "b"])

    def run(batches):
        found = Stars()
        tail: list[np.ndarray] | None = None
        open_key, flooded = None, False
        for batch in batches:
            cols = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)]
            if not len(cols[0]):
                continue
            if tail is not None:
                cols = [np.concatenate([t, c]) for t, c in zip(tail, cols, strict=True)]
            part, key, fp = cols
            if flooded:  # the bucket that went over is still running: its members are only passed on
                same = (part == open_key[0]) & (key == open_key[1])
                n = len(same) if same.all() else int(np.argmin(same))
                yield from passed(fp[:n])
                part, key, fp = part[n:], key[n:], fp[n:]
                if not len(part):
                    tail = None
                    continue
                flooded = False
            last = (part == part[-1]) & (key == key[-1])
            first = len(part) - int(last.sum())
            if first:
                a, b, big = links(part[:first], key[:first], fp[:first])
                yield from found.add(a, b)
                yield from passed(big)
            open_key = (part[-1], key[-1])
            if len(part) - first > max_group:
                yield from passed(fp[first:])
                flooded, tail = True, None
            else:
                tail = [part[first:], key[first:], fp[first:]]
        if tail is not None and len(tail[0]):
            a, b, big = links(*tail)
            yield from found.add(a, b)
            yield from passed(big)
        yield from found.rest()

    return run


def links(spark: SparkSession, fps: DataFrame, radius: int = 4, blocks: int = 2, max_group: int = 64) -> DataFrame:
    """Edges (a, b) that connect every two distinct fingerprints (fp long) within radius bits, directly or by a path.

    blocks = 1 hashes whole fingerprints: each emits all variants within half the radius, and two that share a variant
    are within the radius, so the members of a variant are tied to its smallest by a star without pairs. That is 2,081
    variants for radius 4. With more blocks, two fingerprints within the radius agree in some block of 64 / blocks bits
    up to radius // blocks, so the same balls are laid around the blocks (66 variants for two) and shuffled on
    (block, variant). There, groups of up to max_group are verified exactly at growing offsets; the members of larger
    groups go through the ball of the whole fingerprint, which is linear in them, so no link is lost and no group makes
    pairs of all its members.
    """
    if blocks == 1:
        return _whole_ball(fps, radius)
    width, inner = 64 // blocks, (radius // blocks + 1) // 2
    masks = F.array(*[F.lit(m) for m in _ball(width, inner)])
    low = (1 << width) - 1
    keyed = None
    for part in range(blocks):
        piece = F.shiftrightunsigned(F.col("fp"), part * width).bitwiseAND(F.lit(low))
        rows = fps.select(F.lit(part).cast("byte").alias("part"), piece.alias("piece"), "fp").select("part", F.explode(masks).alias("mask"), "piece", "fp").select("part", F.col("piece").bitwiseXOR(F.col("mask").cast("long")).alias("key"), "fp")
        keyed = rows if keyed is None else keyed.unionByName(rows)
    found = fold(spark, keyed.repartition(partitions(spark), "part", "key").sortWithinPartitions("part", "key", "fp").mapInArrow(_runs(max_group, radius), EDGE), "links")
    near = found.filter("a <> b")
    return near.unionByName(_whole_ball(found.filter("a = b").select(F.col("a").alias("fp")).distinct(), radius))


def _whole_ball(fps: DataFrame, radius: int) -> DataFrame:
    """Stars of all fingerprints that share a variant within half the radius (for an even radius).

    Variants are dealt by their value and sorted; the fingerprints of a variant, as many as its own ball at most, are tied
    to the first. The masks are taken in slices, so that a row makes a bounded array at a time.
    """
    if radius % 2:
        raise ValueError("the ball of whole fingerprints needs an even radius")
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in _ball(64, radius // 2)]

    def variants(batches):
        flips = np.array(masks, np.int64)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 256):
                part = fp[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ flips[None, :]).ravel()), pa.array(np.repeat(part, len(flips)))], ["key", "fp"])

    def meet(batches):
        found, last, least = Stars(), None, None
        for b in batches:
            key, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(key):
                continue
            new = np.concatenate(([last is None or key[0] != last], key[1:] != key[:-1]))
            low = np.concatenate(([least if least is not None else fp[0]], fp[new]))[np.cumsum(new)]
            last, least = key[-1], low[-1]
            tied = fp != low
            yield from found.add(fp[tied], low[tied])
        yield from found.rest()

    keyed = fps.mapInArrow(variants, "key long, fp long").repartition(partitions(fps.sparkSession), "key")
    return keyed.sortWithinPartitions("key", "fp").mapInArrow(meet, EDGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, blocks: int = 2, max_group: int = 64) -> DataFrame:
    """(id, fp, component_id) of every row: component_id is the smallest id that links of at most radius bits reach.

    Equal fingerprints become one node before anything is linked, so copies cost a map-side combine and never pairs; the
    classes return to the rows by one join on the fingerprint, whose hot keys the skew-join rule splits. Null and blank
    texts have fingerprint zero and are linked like any other; rows with one id twice each get their own line; a null id
    never becomes a component's name unless nothing else is in it. An empty table gives an empty one.
    """
    rows = fold(spark, fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    comps = connected_components(spark, links(spark, nodes.select("fp"), radius, blocks, max_group))
    linked = nodes.join(comps.withColumnRenamed("node", "fp").hint("merge"), "fp")
    groups = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = linked.join(groups.hint("merge"), "component").select("fp", "component_id")
    named = nodes.join(classes.hint("merge"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(named.hint("merge"), "fp").select("id", "fp", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each class of near duplicates: that of the smallest id (a null id only if there is no other).

    Rows are told apart by 128 bits of hashes of all their columns, so equal rows count as one; the survivors come back by
    a semi-join on these, and equal rows meet there without another shuffle. The hashes' columns get names that docs
    doesn't have.
    """
    r1, r2 = free_name(docs, "row_hash"), free_name(docs, "row_check")
    h1, h2 = row_hashes(docs)
    rows = docs.withColumns({r1: h1, r2: h2})
    keyed = rows.select(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.col(r1).alias("h"), F.col(r2).alias("c")).alias("key"), F.col(text_col).alias("text"))
    found = near_duplicates(spark, keyed, "key", "text", **how)
    best = found.filter("id = component_id").select(F.col("id.h").alias(r1), F.col("id.c").alias(r2)).distinct()
    return rows.join(best.hint("merge"), [r1, r2], "left_semi").dropDuplicates([r1, r2]).select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(spark, docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
