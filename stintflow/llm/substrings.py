"""Removal of word windows that an earlier document has: a count-min prefilter, then exact grouping.

The sketch grows with the corpus and is never held whole: parts of the corpus send the cells they fill to the blocks of the
sketch, and every block answers each part with those of its cells that are counted twice.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintflow.llm.common import bucketed, hash_words, mix, partitions, words

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLOCK_BITS = 24
_FLUSH = 2_000_000
#: Characters of a part of the corpus: some three million windows.
_PART = 18_000_000


def word_hashes(text: str | None) -> np.ndarray:
    return mix(hash_words(words(text), 5))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all windows of width words, from the words' hashes."""
    n = len(h) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _STEP + h[k : k + n]
    return mix(out)


def anchors(text_hashes: np.ndarray, width: int, part: int = 6) -> np.ndarray:
    """For each window of word hashes, the smallest hash of its runs of part words: neighbouring windows mostly share
    it, and equal windows always do."""
    if len(text_hashes) < width:
        return np.empty(0, np.uint64)
    part = min(part, width)
    n = len(text_hashes) - part + 1
    runs = np.zeros(n, np.uint64)
    for k in range(part):
        runs = runs * _STEP + text_hashes[k : k + n]
    low, span, size = mix(runs), 1, width - part + 1
    while 2 * span <= size:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    rest = size - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """A window's cell in a row of the sketch. Those of row 0 rise with the hash, so sorted windows have sorted cells."""
    return (mix(h + np.uint64(row * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)) if row else h) >> np.uint64(64 - bits)


def pack_cells(c: np.ndarray) -> bytes:
    """Sorted distinct cells of a block as gaps: a byte each; the long ones (marked 255) are listed behind, in two bytes
    each if all of them fit."""
    gaps = np.diff(c.astype(np.int64), prepend=-1) - 1
    long = gaps[gaps >= 255]
    wide = bool(len(long) and long.max() > 0xFFFF)
    return (2 * len(gaps) + wide).to_bytes(4, "little") + np.minimum(gaps, 255).astype(np.uint8).tobytes() + long.astype("<u4" if wide else "<u2").tobytes()


def unpack_cells(b: bytes) -> np.ndarray:
    n, wide = divmod(int.from_bytes(b[:4], "little"), 2)
    gaps = np.frombuffer(b, np.uint8, n, 4).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(b, "<u4" if wide else "<u2", -1, 4 + n)
    return np.cumsum(gaps + 1) - 1


def sketch(h: np.ndarray, rows: int, bits: int):
    """(block, cells) of a part's sketch of the sorted windows h, only blocks that aren't empty: the packed cells that
    the part fills. A block is 1 << 24 cells of one row (or the whole row)."""
    size = min(_BLOCK_BITS, bits)
    for r in range(rows):
        c = cells(h, r, bits)
        if r:
            c.sort()
        c = c[np.concatenate(([True], c[1:] != c[:-1]))] if len(c) else c
        block = c >> np.uint64(size)
        at = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(c) else np.empty(0, np.int64)
        for low, high in zip(at.tolist(), np.append(at, len(c))[1:].tolist(), strict=True):
            yield r << (bits - size) | int(block[low]), pack_cells(c[low:high] - (block[low] << np.uint64(size)))


def merged_block(sent: list[tuple[int, bytes]], size: int):
    """(part, cells): of the cells that each part sent to one block, those that another part sent too. Sketches merge in
    any order. Held are the packed cells and two flags a cell."""
    seen, again = np.zeros(1 << size, bool), np.zeros(1 << size, bool)
    for _, b in sent:
        c = unpack_cells(b)
        again[c[seen[c]]] = True
        seen[c] = True
    for part, b in sent:
        c = unpack_cells(b)
        c = c[again[c]]
        if len(c):
            yield part, pack_cells(c)


def estimated_repeats(h: np.ndarray, answers: list[tuple[int, bytes]], rows: int, bits: int) -> np.ndarray:
    """Places of the sorted windows h of a part whose smallest counter is 2 or more: in every row, their cell holds two
    windows of the part or came back in the answers (block, cells)."""
    size = min(_BLOCK_BITS, bits)
    ok = np.arange(len(h))
    for r in range(rows):
        c = cells(h, r, bits)
        own = c if not r else np.sort(c)
        twice = own[1:][own[1:] == own[:-1]]
        back = [unpack_cells(b).astype(np.uint64) + (np.uint64(k & (1 << (bits - size)) - 1) << np.uint64(size)) for k, b in sorted(answers) if k >> (bits - size) == r]
        counted = np.unique(np.concatenate([twice, *back]))
        if not len(counted):
            return ok[:0]
        c = c[ok]
        ok = ok[counted[np.minimum(np.searchsorted(counted, c), len(counted) - 1)] == c]
    return ok


def sketch_bits(n_windows: int) -> int:
    """Cells of a row as a power of two: four to eight for each window, whatever the size of the corpus; so of windows
    that are never repeated about one in twenty passes two rows."""
    return max(16, int(4 * max(1, n_windows)).bit_length())


def repeated_cells(parts: DataFrame, width: int, rows: int, bits: int) -> DataFrame:
    """(part, block, cells): the answers of the sketch's blocks to the parts of (part, id, body, text)."""
    size = min(_BLOCK_BITS, bits)

    def build(part: pa.Table) -> pa.Table:
        found = [windows(word_hashes(t.as_py()), width) for t in part["text"]]
        h = np.concatenate(found)
        del found
        h.sort()
        got = list(zip(*sketch(h, rows, bits), strict=True)) or [(), ()]
        return pa.table({"part": pa.array([part["part"][0].as_py()] * len(got[0]), pa.int32()), "block": pa.array(got[0], pa.int64()), "cells": pa.array(got[1], pa.binary())})

    def merge(batches):
        # Rows come sorted by block, so one block is held at a time.
        block, sent = None, []

        def done():
            got = list(merged_block(sent, size))
            for k in range(0, len(got), 64):
                some = got[k : k + 64]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([x[1] for x in some], pa.binary())], ["part", "block", "cells"])

        for batch in batches:
            for part, here, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if here != block:
                    yield from done()
                    block, sent = here, []
                sent.append((part, b))
        yield from done()

    filled = parts.groupBy("part").applyInArrow(build, "part int, block long, cells binary")
    return filled.repartition(partitions(parts.sparkSession), "block").sortWithinPartitions("block").mapInArrow(merge, "part int, block long, cells binary")


def _runs(*columns: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """First places of runs in which pos rises by one and the columns stay the same."""
    new = np.concatenate(([True], pos[1:] != pos[:-1] + 1))
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def in_parts(rows: DataFrame) -> tuple[DataFrame, int]:
    """((part, id, body, text), characters): the rows dealt into parts of about 18 million characters, stored as a table
    bucketed by part, so that all later steps find a part's texts without a shuffle.

    A part is a hash of the row and of the partition it comes from, so copies of one row lie in many parts.
    """
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = min(1 << 16, max(partitions(rows.sparkSession), -(-total // _PART)))
    each = -(-total // (n * _PART)) or 1
    part = F.pmod(F.xxhash64("id", "body", F.spark_partition_id()), F.lit(n * each)).cast("int").alias("part")
    return bucketed(rows.sparkSession, rows.select(part, "id", "body", "text"), "part", n, "parts"), total


def repeated_runs(parts: DataFrame, total: int, width: int = 13, sketch_rows: int = 2) -> DataFrame:
    """(part, id, body, start int, n int): runs of n neighbouring windows of a row that also start in a row of a smaller id.

    parts: (part, id long, body long, text) of total characters. A row may get several runs, also overlapping ones. The first
    pass builds the sketch. In the second, each part keeps the windows estimated as repeated and settles what it can by
    itself: of all its rows with a window, only the one with the smallest id goes on to the shuffle, so a passage that a
    third of all rows share sends one row a part, not one a document. Windows are dealt by their anchor, a run of six words
    which equal windows share and neighbours mostly do, so they travel as one row a run. Where they meet, the ids of a window are
    read in order, and all but the first are repeated; nothing but the current window's smallest id is held.
    """
    spark = parts.sparkSession
    bits = sketch_bits(total // 6)
    names = ["deal", "part", "id", "body", "start", "n", "windows"]

    def second(part: pa.Table, answers: pa.Table) -> pa.Table:
        number = part["part"][0].as_py()
        back = list(zip(answers["block"].to_pylist(), answers["cells"].to_pylist(), strict=True))
        ids, bodies = (part[k].combine_chunks() for k in ("id", "body"))
        known = np.asarray(ids.is_valid())
        ids, bodies = ids.fill_null(0).to_numpy(), bodies.to_numpy()
        hs, ans = [], []
        for t in part["text"]:
            ws = word_hashes(t.as_py())
            hs.append(windows(ws, width))
            ans.append(anchors(ws, width))
        counts = np.array([len(x) for x in hs], np.int64)
        h = np.concatenate(hs)
        del hs
        order = np.argsort(h).astype(np.int32)
        at = order[estimated_repeats(h[order], back, sketch_rows, bits)]
        del order, back
        at.sort()
        line = np.repeat(np.arange(len(counts), dtype=np.int32), counts)[at]
        at, line = at[known[line]], line[known[line]]
        h, anchor = h[at], np.concatenate(ans)[at]
        del ans
        pos = (at - (np.cumsum(counts) - counts)[line]).astype(np.int32)
        order = np.argsort(h)
        own = h[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(h) else order
        own = ids[line[order]]
        late = np.empty(len(h), bool)
        if len(h):
            late[order] = own > np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(h))))
        del own, order, first
        out = []
        for settled in (True, False):
            on = np.flatnonzero(late == settled)
            if not len(on):
                continue
            run = _runs(line[on], *(() if settled else (anchor[on],)), pos=pos[on])
            count = np.diff(np.append(run, len(on)))
            k = on[run]
            listed = pa.nulls(len(run), pa.list_(pa.int64())) if settled else pa.ListArray.from_arrays(pa.array(np.append(run, len(on)).astype(np.int32)), pa.array(h[on].view(np.int64)))
            deal = mix(ids[line[k]].view(np.uint64)) if settled else anchor[k]
            own = pa.array(np.full(len(k), number, np.int32))
            out.append(pa.table([pa.array(deal.view(np.int64)), own, pa.array(ids[line[k]]), pa.array(bodies[line[k]]), pa.array(pos[k]), pa.array(count.astype(np.int32)), listed], names))
        return pa.concat_tables(out) if out else pa.schema(list(zip(names, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())], strict=True))).empty_table()

    def exact(batches):
        last_window, least = None, None
        kept: list[tuple] = []
        n = 0
        columns = ["part", "id", "body", "start", "n"]

        def flush():
            part, ids, bodies, pos = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.lexsort((pos, bodies, ids, part))
            part, ids, bodies, pos = part[order], ids[order], bodies[order], pos[order]
            at = _runs(part, ids, bodies, pos=pos)
            return pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(ids[at]), pa.array(bodies[at]), pa.array(pos[at].astype(np.int32)), pa.array(np.diff(np.append(at, len(pos))).astype(np.int32))], columns)

        for b in batches:
            done = b.filter(b.column(0).is_null())
            if len(done):
                yield pa.RecordBatch.from_arrays([done.column(k) for k in range(1, 6)], columns)
            b = b.filter(b.column(0).is_valid())
            if not len(b):
                continue
            h, ids = b.column(0).to_numpy(), b.column(2).to_numpy()
            new = np.concatenate(([last_window is None or h[0] != last_window], h[1:] != h[:-1]))
            smallest = np.concatenate(([least if least is not None else ids[0]], ids[new]))[np.cumsum(new)]
            late = ids > smallest
            last_window, least = h[-1], smallest[-1]
            if late.any():
                kept.append((b.column(1).to_numpy()[late], ids[late], b.column(3).to_numpy()[late], b.column(4).to_numpy()[late]))
                n += int(late.sum())
            if n >= _FLUSH:
                yield flush()
                kept, n = [], 0
        if kept:
            yield flush()

    answers = repeated_cells(parts, width, sketch_rows, bits)
    found = parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(second, "deal long, part int, id long, body long, start int, n int, windows array<long>")
    dealt = found.repartition(partitions(spark), "deal").select("part", "id", "body", "start", "n", F.posexplode_outer("windows").alias("k", "window"))
    lined = dealt.select("window", "part", "id", "body", (F.col("start") + F.coalesce("k", F.lit(0))).cast("int").alias("start"), "n").sortWithinPartitions("window", "id")
    return lined.mapInArrow(exact, "part int, id long, body long, start int, n int")


def covered(n_words: int, start: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Which of n_words words lie in a window of one of the runs of n windows from start on."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n - 1 + width, -1)
    return np.cumsum(edge[:-1]) > 0


def dedup_substrings(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """(id, text, n_words, n_removed): every row's words that no repeated window covers, joined by one space.

    A window of width words is repeated if it also starts in a row with a smaller id; windows are judged on the input.
    Windows are told apart by a 64-bit hash. Rows with the same id never count against each other; a null id neither
    removes nor loses anything; null and blank texts have no words and stay as an empty text. An empty table gives an
    empty one. Ids are whole numbers; ids of another type raise a ValueError.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids must be whole numbers, not {kind}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("body", F.xxhash64("text")).select("id", "body", "text")
    parts, total = in_parts(rows)

    def cut(part: pa.Table, runs: pa.Table) -> pa.Table:
        ids, bodies, start, n = (runs[k].to_numpy() for k in ("id", "body", "start", "n"))
        order = np.lexsort((bodies, ids))
        ids, bodies, start, n = ids[order], bodies[order], start[order], n[order]
        at = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (bodies[1:] != bodies[:-1])))) if len(ids) else order
        own = {(i, b): (low, high) for i, b, low, high in zip(ids[at].tolist(), bodies[at].tolist(), at.tolist(), np.append(at, len(ids))[1:].tolist(), strict=True)}
        text, total, gone = [], [], []
        for i, body, t in zip(part["id"].to_pylist(), part["body"].to_pylist(), part["text"], strict=True):
            ws = words(t.as_py())
            low, high = own.get((i, body), (0, 0))
            drop = covered(len(ws), start[low:high], n[low:high], width)
            total.append(len(ws))
            gone.append(int(drop.sum()))
            text.append(b" ".join(w for w, d in zip(ws, drop.tolist(), strict=True) if not d) if gone[-1] else b" ".join(ws))
        return pa.table({"id": part["id"], "text": pa.array(text, pa.binary()).cast(pa.string()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64())})

    runs = repeated_runs(parts, total, width)
    return parts.groupBy("part").cogroup(runs.groupBy("part")).applyInArrow(cut, "id long, text string, n_words long, n_removed long")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
