"""Vector best-fit packing of tokenized documents into bounded sequences."""

from __future__ import annotations

import os
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintflow.llm.common import fold

_GROUP = 1_000_000


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Marks that are cut off a chunk's end: with letters before them they are a pre-token of their own.
_MARKS = ".,;:!?%$&*#"


class ChunkTokenizer:
    """Ids of texts, looked up by the chunks between ASCII white space.

    For tokenizers that lower-case, whose pre-tokenizer drops white space and parts letters from marks (true of
    word_bpe_49k.json), a text's ids are its chunks' ids in order, and those of letters with marks behind them are the ids of
    the lower-cased letters and of the marks. New parts of a batch are encoded in one call. Both caches keep what came
    first, which is what is frequent, up to max_cached entries; what comes later is encoded once a batch.
    """

    def __init__(self, path: str, max_cached: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.max_cached = Tokenizer.from_file(path), max_cached
        self.chunks: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        out = {}
        for at in range(0, len(parts), 20_000):
            some = parts[at : at + 20_000]
            got = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(got.ids, "<u4").tobytes()
            owner = np.fromiter((-1 if w is None else w for w in got.word_ids), np.int64, len(raw) // 4)
            ends = np.searchsorted(owner, np.arange(len(some) + 1)).tolist()
            out.update((c, raw[4 * s : 4 * e]) for c, s, e in zip(some, ends[:-1], ends[1:], strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        split = [t.encode("utf-8", "replace").split() if t else [] for t in texts]
        found = [list(map(self.chunks.get, x)) for x in split]
        lacking = [k for k, f in enumerate(found) if None in f]
        if lacking:
            new = {c for k in lacking for c, f in zip(split[k], found[k], strict=True) if f is None}
            cut = {}
            for c in new:
                s = c.decode("utf-8")
                core = s.rstrip(_MARKS)
                low = core if "\u03a3" in core else core.lower()
                # A letter whose lower case ends in a combining mark would draw the marks behind it into its own pre-token.
                letters = core.isalpha() and (core.isascii() or (core.lower().isalpha() and unicodedata.is_normalized("NFC", core)))
                cut[c] = (low, s[len(core) :]) if letters else (s, "")
            fresh = self.encode_parts(list({p for both in cut.values() for p in both if p and p not in self.parts}))
            get = lambda p: self.parts[p] if p in self.parts else fresh[p] if p else b""
            known = {c: get(a) + get(b) for c, (a, b) in cut.items()}
            for k in lacking:
                found[k] = [f if f is not None else known[c] for c, f in zip(split[k], found[k], strict=True)]
            if len(self.parts) < self.max_cached:
                self.parts.update(fresh)
            if len(self.chunks) < self.max_cached // 2:
                self.chunks.update(known)
        return [b"".join(f) for f in found]


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer_of(path: str) -> ChunkTokenizer:
    """One tokenizer a worker process, so that its caches outlive a task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, tokenizer_path: str | None = None, end_id: int = 1) -> DataFrame:
    """(id, piece, start, length, ids_crc32): every document's ids and end id, cut only where it is longer than capacity.

    A null text counts as empty and gives one piece with the end id alone.
    """
    path = tokenizer_path or _default_tokenizer()

    def run(batches):
        tok, end = tokenizer_of(path), np.uint32(end_id).astype("<u4").tobytes()
        for b in batches:
            who, piece, start, length, crc = [], [], [], [], []
            texts = b.column(1)
            for at in range(0, len(texts), 256):
                for k, ids in enumerate(tok.encode(texts.slice(at, 256).to_pylist())):
                    raw = ids + end
                    for p, s in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[s : s + 4 * capacity]
                        who.append(at + k)
                        piece.append(p)
                        start.append(s // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence. Attention cost is the sum of squared piece lengths (block-diagonal attention).

    With the defaults, those of op7_packing, only the tokens can bind: a sequence has no more pieces than tokens, and the
    sum of squares is at most the square of the sum. The other two then only weigh in the score; lower limits bind.
    """

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    rule: str = "dot"  # or "norm"
    weights: tuple[float, float, float] = (1.0, 0.05, 0.25)


def plan(counts: dict[int, int], limits: Limits) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, number, first sequence, offset) that place counts[length] pieces of each length.

    Vector best-fit, decreasing, on classes: pieces of one length are alike and so are sequences of one history, so a
    step moves a whole run of pieces into a whole run of sequences. A piece goes to the feasible sequences with the
    largest weighted dot-product of its need and their residual ("dot", on the residual's complement so that fuller
    bins win ties of direction) or the smallest weighted norm of what is left ("norm"); only if none can take it are
    sequences opened. The input is a histogram with at most `tokens` rows, whatever the corpus' size.
    """
    cap = np.array([limits.tokens, limits.documents, limits.attention], float)
    weight = np.array(limits.weights)
    left = np.empty((0, 3))
    first, number = np.empty(0, np.int64), np.empty(0, np.int64)
    slots, opened = [], 0
    for length in sorted(counts, reverse=True):
        n, rank = counts[length], 0
        need = np.array([length, 1, length * length], float)
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities of an empty sequence")
        while n:
            fits = np.flatnonzero((left >= need).all(axis=1) & (number > 0)) if len(left) else np.empty(0, np.int64)
            if len(fits):
                rest = (left[fits] - need) / cap
                if limits.rule == "norm":
                    k = fits[np.argmin((weight * rest * rest).sum(axis=1))]
                else:
                    k = fits[np.argmax((weight * (need / cap) * (1 - rest)).sum(axis=1))]
                m = int(min(n, number[k]))
                slots.append((length, rank, m, int(first[k]), int(limits.tokens - left[k, 0])))
                after, at = left[k] - need, int(first[k])
                first[k] += m
                number[k] -= m
            else:
                per = int(min(n, (cap // need).min()))  # a fresh sequence takes further pieces of this length by the same rule
                m = n // per
                for j in range(per):
                    slots.append((length, rank + j * m, m, opened, j * length))
                after, at = cap - per * need, opened
                opened += m
                left, first, number = np.vstack([left, after]), np.append(first, at), np.append(number, m)
                n, rank = n - per * m, rank + per * m
                continue
            same = np.flatnonzero((left == after).all(axis=1) & (first + number == at))
            if len(same):
                number[same[0]] += m
            else:
                left, first, number = np.vstack([left, after]), np.append(first, at), np.append(number, m)
            if len(left) > 4096:
                keep = number > 0
                left, first, number = left[keep], first[keep], number[keep]
            n, rank = n - m, rank + m
    return slots


def pack(spark: SparkSession, cut: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """cut (id, piece, start, length, ...) with sequence_id and offset.

    Pieces that fill a sequence alone are numbered where they lie, below zero, without a shuffle. The others are numbered
    within (length, salt of the id), with a salt for each million pieces of a length, so that no group grows with the
    table; the groups' sizes give each piece its rank among its length. Only the histogram by length and the groups' sizes
    (a number for each million pieces) reach the driver, and the plan made from them is broadcast. Rows with equal ids and
    pieces stay separate pieces. An empty table gives an empty one.
    """
    alone = F.col("length") == limits.tokens
    stored = fold(spark, cut, "pieces")
    full = stored.filter(alone).withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long"))
    total = {r["length"]: r["n"] for r in stored.filter(~alone).groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = {n: -(-m // _GROUP) for n, m in total.items() if m > _GROUP}
    salt = F.lit(0)
    if salts:
        number = F.create_map(*[F.lit(x) for pair in salts.items() for x in pair])
        salt = F.pmod(F.xxhash64("id", "piece"), F.coalesce(F.try_element_at(number, "length"), F.lit(1))).cast("int")
    rows = stored.filter(~alone).withColumn("salt", salt)
    sizes = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    by_length: dict[int, dict[int, int]] = {}
    done: dict[int, int] = {}
    for r in sorted(sizes.collect(), key=lambda r: (r["length"], r["salt"])):
        by_length.setdefault(r["length"], {})[r["salt"]] = done.get(r["length"], 0)
        done[r["length"]] = done.get(r["length"], 0) + r["n"]
    table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    grouped: dict[int, list] = {}
    for length, rank, n, seq, offset in plan(total, limits):
        grouped.setdefault(length, []).append((rank, seq, offset))
    for length, got in grouped.items():
        table[length] = tuple(np.array(x, np.int64) for x in zip(*sorted(got), strict=True))
    sent = spark.sparkContext.broadcast((by_length, table))
    within = Window.partitionBy("length", "salt").orderBy("id", "piece", "start")
    ranked = rows.withColumn("at", F.row_number().over(within) - 1)

    def place(batches):
        before, slots = sent.value
        for b in batches:
            n, length, salt, at = len(b), b.column("length").to_numpy(), b.column("salt").to_numpy(), b.column("at").to_numpy()
            seq, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if n else []:
                own = int(length[part[0]])
                rank = np.array([before[own][s] for s in salt[part].tolist()], np.int64) + at[part]
                starts, seqs, offsets = slots[own]
                k = np.searchsorted(starts, rank, side="right") - 1
                seq[part], offset[part] = seqs[k] + rank - starts[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(seq), pa.array(offset)], [*keep, "sequence_id", "offset"])

    keep = [c for c in rows.columns if c != "salt"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "salt") + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).unionByName(full)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(spark: SparkSession, docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    packed = pack(spark, pieces(docs, capacity=limits.tokens), limits)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
