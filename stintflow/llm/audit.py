"""Filter interaction audit: what each filter removes, alone and behind every other, in every order of the filters."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintflow.llm.common import SPACE, read

NAMES = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_failures(text: Column) -> list[Column]:
    """Whether a text (not null) fails A: under 50 words; B: under 65 % distinct words; C: over 5 % capitals A-Z;
    D: any of the marks # $ % & * |."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return [F.size(words) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words), 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]")]


def bits(conditions: list[Column]) -> Column:
    """The conditions as an integer, the first as its lowest bit."""
    return sum((c.cast("int") * (1 << k) for k, c in enumerate(conditions)), F.lit(0))


def with_later_copies(rows: DataFrame, bit: int) -> DataFrame:
    """rows (id, digest, part, mask, good, toxic) as counts (part, mask, good, toxic, n), with `bit` in the mask of every row
    whose digest also comes with a smaller id.

    Each step is a count that map tasks combine: by id, then by digest and part with the count of the smallest id, which
    a window over one digest's parts compares. A text that a third of all rows repeat is a row a task, not a group of
    rows. A null id is neither smaller nor larger than another.
    """
    same = ["digest", "part", "mask", "good", "toxic"]
    ids = rows.groupBy("id", *same).agg(F.count("*").alias("n"))
    known = F.col("id").isNotNull()
    parts = ids.groupBy(*same).agg(F.sum("n").alias("n"), F.min(F.when(known, F.struct("id", "n"))).alias("first"), F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("unknown"))
    least = F.expr("min(first.id) over (partition by digest)")
    parts = parts.withColumn("firsts", F.col("unknown") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0))
    both = F.array(F.struct("mask", F.col("firsts").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))
    return parts.select("part", "good", "toxic", F.inline(both))


def cells(counts: DataFrame, filters: int) -> DataFrame:
    """(part, n, good, toxic): one row a part, each count an array over the 2**filters masks of failures."""
    one = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    by_mask = one.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("m"))
    at = lambda c: F.transform(F.sequence(F.lit(0), F.lit((1 << filters) - 1)), lambda k: F.coalesce(F.try_element_at("m", k)[c], F.lit(0).cast("long"))).alias(c)
    return by_mask.select("part", *[at(c) for c in ("n", "good", "toxic")])


def survivors(cell: np.ndarray) -> np.ndarray:
    """cell[part, mask, measure] to survivors[part, subset, measure]: what passes all filters of a subset.

    The subsets are walked in Gray-code order, so that one filter is switched at a step. Each mask has a counter of the
    switched-on filters that it fails; where a counter leaves or reaches zero, the mask's cell leaves or joins the
    running survivors.
    """
    masks = cell.shape[1]
    out, failing, on = np.empty_like(cell), np.zeros(masks, np.int64), 0
    running = cell.sum(axis=1)
    out[:, 0] = running
    for step in range(1, masks):
        bit = step & -step
        hit = np.flatnonzero(np.arange(masks) & bit)
        if on & bit:
            failing[hit] -= 1
            running = running + cell[:, hit[failing[hit] == 0]].sum(axis=1)
        else:
            running = running - cell[:, hit[failing[hit] == 0]].sum(axis=1)
            failing[hit] += 1
        on ^= bit
        out[:, on] = running
    return out


def states(cell_rows: DataFrame) -> DataFrame:
    """(part, n, good, toxic): cells() as survivors of every subset of filters, in arrays by the subset's bits."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.slice(at, 1000)
                cell = np.stack([part.column(k).flatten().to_numpy().reshape(len(part), -1) for k in (1, 2, 3)], axis=2)
                found = survivors(cell)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(list(found[:, :, k]), pa.list_(pa.int64())) for k in range(3)]], ["part", "n", "good", "toxic"])

    return cell_rows.mapInArrow(run, "part string, n array<long>, good array<long>, toxic array<long>")


def steps(state_rows: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, counts): every step of every order of the filters, as differences of two states."""
    bit = {c: 1 << k for k, c in enumerate(names)}
    orders = ["".join(p) for p in permutations(names)]
    ends = [(o, k + 1, sum(bit[c] for c in o[:k]), bit[o[k]]) for o in orders for k in range(len(names))]
    before, own = (np.array([e[k] for e in ends]) for k in (2, 3))
    total = (1 << len(names)) - 1

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 100):
                part = b.slice(at, 100)
                n, good, toxic = (part.column(k).flatten().to_numpy().reshape(len(part), -1) for k in (1, 2, 3))
                lost = lambda s: s[:, before] - s[:, before | own]
                removed = lost(n)
                shapley = np.zeros_like(removed)
                for x in bit.values():
                    shapley[:, own == x] = removed[:, own == x].sum(axis=1)[:, None]
                found = [n[:, before | own], removed, n[:, [0]] - n[:, own] - removed, n[:, total & ~own] - n[:, [total]], lost(good), lost(toxic), shapley]
                cols = [part.column(0).take(pa.array(np.repeat(np.arange(len(part)), len(ends)))), pa.array([e[0] for e in ends] * len(part)), pa.array([e[1] for e in ends] * len(part), pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(f.ravel(), pa.int64()) for f in found]], ["part", "filter_order", "step", *COUNTS])

    return state_rows.mapInArrow(run, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}")


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): documents by part and by which of the filters A to E they fail.

    A null text is empty and a null part the empty string; E compares SHA-256 of whole texts. A document is good or
    toxic if a label row of its id says 1; ids without labels and null ids are neither. Rows with one id count each, and
    are no copies of each other by that id alone.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), bits(text_failures(text)).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    rows = rows.join(marks, "id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    return with_later_copies(rows, 16)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row for each part, order of the filters and step, zeros included; see failure_counts() for nulls and repeats. An
    empty table has no parts and so no rows. Documents are read once; what leaves the map side are counts by mask.
    """
    return steps(states(cells(failure_counts(docs, labels, id_col, text_col, part_col), len(NAMES))), NAMES)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
