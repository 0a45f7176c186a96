"""Benchmark decontamination: rare pairs of near words find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


#: Bytes stripped from both ends of a word before words are compared.
_EDGE = b".,;:!?\"'()[]{}*#$%&-_|/\\"


def compared(text: str | None) -> list[bytes]:
    """Lower-cased words without marks at their ends; words of marks alone fall out."""
    return [w for w in (x.strip(_EDGE) for x in text.lower().encode("utf-8", "replace").split()) if w] if text else []


def align(a: np.ndarray, b: np.ndarray, match: float = 2.0, mismatch: float = -1.0, gap: float = -1.0) -> tuple[float, int]:
    """The best Smith-Waterman score of two word-id arrays and the end (exclusive) of its stretch in b.

    A row is one array operation: with a linear gap cost, runs of insertions are a running maximum.
    """
    h = np.zeros(len(b) + 1)
    slope = -gap * np.arange(len(b) + 1)
    best, end = 0.0, 0
    for x in a.tolist():
        now = np.zeros(len(b) + 1)
        now[1:] = np.maximum(np.maximum(h[:-1] + np.where(b == x, match, mismatch), h[1:] + gap), 0)
        h = np.maximum.accumulate(now + slope) - slope
        k = int(np.argmax(h))
        if h[k] > best:
            best, end = float(h[k]), k
    return best, end


def needed(length: int, least_score: float) -> tuple[int, int, int]:
    """(need, sure, wide) of an item of so many words: an alignment that reaches least_score has at least `need` pairs of
    neighbouring matches one or two places apart, within `wide` words of the text (see _matches); `sure` of them are
    rare seeds."""
    need = max(1, math.ceil(least_score * length - 1 - 1e-9))
    return need, 1 + need // 8, math.ceil((3 - 2 * least_score) * length)


def seeds_of(items: list[np.ndarray], base: int, n: int, least_score: float) -> tuple[np.ndarray, np.ndarray, list]:
    """(keys, items, own): the rare seeds of all items of at least n words, by key, and each item's sorted pairs.

    A pair is two words one or two places apart. Rarity is relative: pairs are ranked within their item by how many pairs
    of the block are equal, then by how common their words are there, so it doesn't depend on the corpus. The `need`
    pairs of an alignment start at different words of the item. So an item keeps the pairs of its rarest starts, as many
    that all alignments have `sure` of them; the other pairs are common ones, which are never looked up.
    """
    keys, who, own = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], []
    pairs = [[_pair_keys(ws[:-d], ws[d:], base) for d in (1, 2)] if len(ws) >= n else None for ws in items]
    equal, number = np.unique(np.concatenate([k for p in pairs if p for k in p] or keys), return_counts=True)
    common = np.bincount(np.concatenate(items), minlength=base) if items else np.empty(0)
    for k, ws in enumerate(items):
        if pairs[k] is None:
            own.append(None)
            continue
        one, two = pairs[k]
        own.append(np.unique(np.concatenate((one, two))))
        need, sure, _ = needed(len(ws), least_score)
        held = number[np.searchsorted(equal, one)]
        held[:-1] = np.maximum(held[:-1], number[np.searchsorted(equal, two)])
        seen = np.minimum(common[ws[:-1]], common[ws[1:]])
        start = np.lexsort((seen, held))[: max(1, len(ws) - 1 - need + sure)]
        rare = np.unique(np.concatenate((one[start], two[start[start < len(two)]])))
        keys.append(rare)
        who.append(np.full(len(rare), k, np.int32))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return key[order], np.concatenate(who)[order], own


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 3, least_score: float = 0.5, block: int = 20_000) -> DataFrame:
    """(id, item_id, score, n_seeds, first_word, end_word) of every document and item whose best local alignment reaches
    least_score of a full match of the item.

    Items are a stated query set: they are taken in blocks of at most `block` items, whose words and seeds are sent to
    all tasks (a bound on the broadcast), against all documents; a document is scanned once per block and nothing is
    shuffled. The rare seeds lose nothing that alignment of every text with every item would find, whatever the corpus (see
    _matches), if least_score times an item's words is above 1. Items of fewer than n words match texts that are nothing
    else. Null or empty texts and items match nothing; repeated rows give repeated results.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    schema = f"id {kind}, item_id {item_kind.simpleString()}, score double, n_seeds int, first_word int, end_word int"
    out = None
    for items in item_blocks(benchmark, item_col, item_text_col, block):
        found = _block(rows, items, schema, to_arrow_type(item_kind), n, least_score)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _prepared(items: list, n: int, least_score: float) -> tuple:
    """What a task needs of a block of items: word ids, item ids, coded items, the seeds, and the items below n words."""
    index = {w: k for k, w in enumerate(sorted({w for _, ws in items for w in ws}))}
    coded = [np.array([index[w] for w in ws], np.int64) for _, ws in items]
    short: dict[tuple[int, ...], list[int]] = {}
    for k, ws in enumerate(coded):
        if len(ws) < n:
            short.setdefault(tuple(ws.tolist()), []).append(k)
    base = len(index) + 1
    return index, [i for i, _ in items], coded, seeds_of(coded, base, n, least_score), short, base


def _coded(text: str | None, index: dict) -> np.ndarray:
    """compared() as word ids, -1 for words of no item; every spelling is stripped and looked up once a text."""
    ws = text.lower().encode("utf-8", "replace").split() if text else []
    known = {}
    for w in set(ws):
        bare = w.strip(_EDGE)
        known[w] = index.get(bare, -1) if bare else -2
    x = np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))
    return x[x > -2]


def _judge(text: str | None, prepared: tuple, n: int, least_score: float) -> list[tuple]:
    """(item id, score, seeds, first word, end word) of the items that a text holds."""
    index, ids, codes, seeds, short, base = prepared
    x = _coded(text, index)
    if not len(x):
        return []
    return [(ids[item], *rest) for item, *rest in _matches(x, codes, seeds, short, base, n, least_score)]


def _block(rows: DataFrame, items: list, schema: str, item_type: pa.DataType, n: int, least_score: float) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(_prepared(items, n, least_score))

    def run(batches):
        for b in batches:
            got = [(row, *found) for row, text in enumerate(b.column(1)) for found in _judge(text.as_py(), sent.value, n, least_score)]
            cols = list(zip(*got, strict=True)) if got else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_type), pa.array(cols[2], pa.float64()), *(pa.array(c, pa.int32()) for c in cols[3:])], ["id", "item_id", "score", "n_seeds", "first_word", "end_word"])

    return rows.mapInArrow(run, schema)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block: int):
    """Lists of at most block (item id, words), sorted; the driver holds one partition of items and one block at a time."""
    held = []
    for r in benchmark.select(F.col(item_col), F.col(text_col).cast("string")).filter(F.col(text_col).isNotNull()).toLocalIterator():
        if ws := compared(r[1]):
            held.append((r[0], ws))
        if len(held) == block:
            yield sorted(held, key=lambda x: (str(x[0]), x[1]))
            held = []
    if held:
        yield sorted(held, key=lambda x: (str(x[0]), x[1]))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 3, least_score: float = 0.5, block: int = 20_000) -> DataFrame:
    """The rows of docs, all columns, that leaks() finds nothing in. Rows are judged where they are read.

    Texts of another type are judged as strings. Rows with a null or empty text stay, equal rows stay or go together; an
    empty benchmark removes nothing.
    """
    at = docs.columns.index(text_col)
    out = docs
    for items in item_blocks(benchmark, item_col, item_text_col, block):
        sent = docs.sparkSession.sparkContext.broadcast(_prepared(items, n, least_score))

        def run(batches, sent=sent):
            for b in batches:
                yield b.filter(pa.array([not _judge(t.as_py(), sent.value, n, least_score) for t in b.column(at).cast(pa.string())], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def _pair_keys(a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    return a.astype(np.uint64) * np.uint64(base) + b.astype(np.uint64)


def _matches(x: np.ndarray, codes, seeds, short, base: int, n: int, least_score: float):
    """(item, score, seeds, first word, end word): the best stretch of each item that a text holds.

    With 2 a match and -1 an error, m matches and g errors reach the share s of an item of L words only if g <= 2m - 2sL.
    So at most m - sL neighbouring matches have two errors or more between them, and at least sL - 1 have one or none:
    both their words are then one or two places apart in the item and in the text. The text's part has at most
    m + g <= (3 - 2s) L words. Where fewer such pairs lie within so many words, or fewer than `sure` rare ones (see
    seeds_of), no alignment can reach s. An item's other pairs are only looked up around its rare seeds.
    """
    if len(x) <= n:
        own = x.tolist()
        while own and own[-1] < 0:
            own.pop()
        for item in short.get(tuple(own), []):
            yield item, 1.0, 1, 0, len(own)
    keys, who, pairs = seeds
    text_at, text_key = [], []
    for d in (1, 2):
        at = np.flatnonzero((x[:-d] >= 0) & (x[d:] >= 0))
        text_at.append(at)
        text_key.append(_pair_keys(x[at], x[at + d], base))
    text_at, text_key = np.concatenate(text_at), np.concatenate(text_key)
    order = np.argsort(text_at, kind="stable")
    text_at, text_key = text_at[order], text_key[order]
    low = np.searchsorted(keys, text_key, side="left")
    number = np.searchsorted(keys, text_key, side="right") - low
    item = who[np.repeat(low - np.cumsum(number) + number, number) + np.arange(number.sum())]
    at = np.repeat(text_at, number)
    order = np.argsort(item, kind="stable")
    item, at = item[order], at[order]
    bounds = np.append(np.flatnonzero(np.diff(item, prepend=-1)), len(item)).tolist()
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        k = int(item[low])
        a = codes[k]
        need, sure, wide = needed(len(a), least_score)
        rare = _close(at[low:high], sure, wide)
        best = (0.0, 0, 0, 0)
        for group in np.split(rare, np.flatnonzero(np.diff(rare) > 2 * wide) + 1) if len(rare) else ():
            near = slice(*np.searchsorted(text_at, (group[0] - wide, group[-1] + 2 * wide + 1)).tolist())
            place = np.minimum(np.searchsorted(pairs[k], text_key[near]), len(pairs[k]) - 1)
            where = text_at[near][pairs[k][place] == text_key[near]]
            hit = _close(where, need, wide)
            for part in np.split(hit, np.flatnonzero(np.diff(hit) > 2 * wide) + 1) if len(hit) else ():
                first, last = max(0, int(part[0]) - wide), min(len(x), int(part[-1]) + wide + 2)
                score, end = align(a, x[first:last])
                if score > best[0]:
                    best = (score, int(np.count_nonzero((where >= first) & (where < last))), first, first + end)
        share = best[0] / (2.0 * len(a))
        if share >= least_score:
            yield k, share, best[1], max(best[2], best[3] - len(a) - max(4, len(a) // 2)), best[3]


def _close(where: np.ndarray, count: int, wide: int) -> np.ndarray:
    """The sorted places with which count places within wide words begin."""
    if len(where) < count:
        return where[:0]
    begin = where[: len(where) - count + 1]
    return begin[where[count - 1 :] - begin <= wide]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks(docs, benchmark).withColumnRenamed("id", "doc_id")
