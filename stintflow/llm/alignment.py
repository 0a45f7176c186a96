"""Cross-tokenizer alignment: stretches of text that two tokenizers cut alike, and which ids of one meet which of the other."""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintflow.llm.common import fold, free_name, read

#: Bytes of text that one task aligns at once, and links that are counted at once.
BUFFER, LINKS = 16 << 20, 1 << 20
#: Before a single blank or line feed between other characters neither tokenizer has a token across, see Pair.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_BLANK = "▁"


def _files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others in order
    from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Pair:
    """Two tokenizers and the bytes of their tokens: A byte-level (tokenizers), B of pieces with byte fallback (sentencepiece).

    encode() takes chunks of a text that begin with a blank or a line feed. A's pre-tokens end before white space that
    stands alone, and no piece of B holds a blank after another character, or a line feed; so the tokens of a text are
    those of its chunks. B is checked for this when it is loaded, and otherwise texts are not cut (cuts is False).
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        symbols = _byte_symbols()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_BLANK, " ").encode() for k, p in enumerate(pieces)]
        self.cuts = not any(_BLANK in p.lstrip(_BLANK) or "\n" in p or " " in p for p in pieces)
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # Ids in decimal behind what separates them: first of a text, of a group, of B in a group, or none of these.
        self.said_a, self.said_b = ([s + str(k) for s in ("\n", ";", "|", ",") for k in range(len(t))] for t in (self.bytes_a, self.bytes_b))

    def chunks(self, text: str) -> list[str]:
        """The text with a blank before it, in chunks."""
        return _CUT.split(" " + text) if self.cuts else [" " + text]

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids of each chunk; both are empty where the tokens' bytes aren't the chunk's."""
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        # B puts a blank before a text: it stands for that of the chunk, or goes where the chunk begins with a line feed.
        b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        for k, c in enumerate(chunks):
            own = b[k] if c[0] == " " else b[k][1:]
            raw = c.encode("utf-8", "replace")
            if b"".join(map(self.bytes_a.__getitem__, a[k])) != raw or b"".join(map(self.bytes_b.__getitem__, own)) != raw:
                a[k], own = [], []
            b[k] = own
        return a, b


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    """One pair of tokenizers a worker process."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def coalesced(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The group of each interval: by start, a group breaks where a start reaches the maximum of all ends before it."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.empty(len(starts), np.int64)
    group[order] = np.concatenate(([0], np.cumsum(starts[order][1:] >= reach[:-1]))) if len(starts) else 0
    return group


@dataclass
class Aligned:
    """Texts laid end to end: tokens of A and of B, in order, with the text and the group that each belongs to."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    text_a: np.ndarray
    text_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    ends_a: np.ndarray  # byte offsets over all texts
    texts: int

    @property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        n = int(self.group_a[-1]) + 1 if len(self.group_a) else 0
        return np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)

    @property
    def text_of_group(self) -> np.ndarray:
        return self.text_a[np.flatnonzero(np.diff(self.group_a, prepend=-1))]


def align(pair: Pair, a: list[list[int]], b: list[list[int]]) -> Aligned:
    """The tokens of texts whose A and B bytes agree, in groups."""
    flat = lambda x: (np.fromiter((i for y in x for i in y), np.int64, sum(map(len, x))), np.repeat(np.arange(len(x)), [len(y) for y in x]))
    (ids_a, text_a), (ids_b, text_b) = flat(a), flat(b)
    ends_a, ends_b = np.cumsum(pair.length_a[ids_a]), np.cumsum(pair.length_b[ids_b])
    group = coalesced(np.concatenate((ends_a - pair.length_a[ids_a], ends_b - pair.length_b[ids_b])), np.concatenate((ends_a, ends_b)))
    return Aligned(ids_a, ids_b, text_a, text_b, group[: len(ids_a)], group[len(ids_a) :], ends_a, len(a))


def written(pair: Pair, x: Aligned) -> list[str]:
    """Each text's groups as a1,a2|b1;a3|b2,b3; an empty string where it has no tokens."""
    p, q = x.sizes
    if not len(p):
        return [""] * x.texts
    new_a, new_b = np.diff(x.group_a, prepend=-1) > 0, np.diff(x.group_b, prepend=-1) > 0
    sign_a = np.where(np.diff(x.text_a, prepend=-1) > 0, 0, np.where(new_a, 1, 3))
    order = np.empty(len(x.ids_a) + len(x.ids_b), object)
    # A token stands behind the other side's tokens of earlier groups; B's also behind A's of its own.
    order[np.arange(len(x.ids_a)) + (np.cumsum(q) - q)[x.group_a]] = [pair.said_a[k] for k in (sign_a * len(pair.bytes_a) + x.ids_a).tolist()]
    order[np.arange(len(x.ids_b)) + np.cumsum(p)[x.group_b]] = [pair.said_b[k] for k in (np.where(new_b, 2, 3) * len(pair.bytes_b) + x.ids_b).tolist()]
    out = [""] * x.texts
    for k, s in zip(np.unique(x.text_a).tolist(), "".join(order)[1:].split("\n"), strict=True):
        out[k] = s
    return out


def links(x: Aligned, size_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, a * size_b + b, how many) of all pairs of tokens in one group, in slices.

    Groups of more than LINKS pairs are reduced to their distinct ids first, whose pairs are at most those of the two
    vocabularies.
    """
    p, q = x.sizes
    first_a, first_b, text = np.cumsum(p) - p, np.cumsum(q) - q, x.text_of_group if len(p) else np.empty(0, np.int64)
    large = p * q > LINKS
    small = ~large[x.group_a]
    each = np.where(small, q[x.group_a], 0)
    upto = np.cumsum(each)
    cuts = np.searchsorted(upto, np.arange(0, int(upto[-1]) if len(upto) else 0, LINKS), side="right").tolist() + [len(each)]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        rep = each[s:e]
        own = np.repeat(np.arange(s, e), rep)
        k = np.arange(len(own)) - np.repeat(np.cumsum(rep) - rep, rep)
        yield x.text_a[own], x.ids_a[own] * size_b + x.ids_b[first_b[x.group_a[own]] + k], np.ones(len(own), np.int64)
    for g in np.flatnonzero(large).tolist():
        (ua, ca), (ub, cb) = (np.unique(i[f : f + n], return_counts=True) for i, f, n in ((x.ids_a, first_a[g], p[g]), (x.ids_b, first_b[g], q[g])))
        for s in range(0, len(ua), max(1, LINKS // len(ub))):
            part = slice(s, s + max(1, LINKS // len(ub)))
            yield np.full(len(ua[part]) * len(ub), text[g]), (ua[part, None] * size_b + ub).ravel(), (ca[part, None] * cb).ravel()


def summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their weights' sums."""
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    at = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.empty(0, np.int64)
    return key[at], np.add.reduceat(weight, at) if len(key) else weight


@dataclass
class Chunks:
    """What is known of the distinct chunks of a buffer; links are in rows by chunk, pairs by their place in `pairs`."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    said: list[str]
    pairs: np.ndarray
    starts: np.ndarray
    place: np.ndarray
    weight: np.ndarray


def _chunks(pair: Pair, chunks: list[str]) -> Chunks:
    counts, said, owner, code, weight = [], [], [], [], []
    size_b = len(pair.bytes_b)
    for at in range(0, len(chunks), 20_000):
        a, b = pair.encode(chunks[at : at + 20_000])
        x = align(pair, a, b)
        p, q = x.sizes
        per = lambda t, w=None: np.bincount(t, w, x.texts).astype(np.int64)
        of = x.text_of_group if len(p) else np.empty(0, np.int64)
        counts.append((per(x.text_a), per(x.text_b), per(of), np.array([0] * x.texts, np.int64)))
        np.add.at(counts[-1][3], of, p * q)
        said += written(pair, x)
        for t, c, w in links(x, size_b):
            owner.append(t + at)
            code.append(c)
            weight.append(w)
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    n_a, n_b, n_groups, n_links = (join([c[k] for c in counts]) for k in range(4))
    owner, code, weight = join(owner), join(code), join(weight)
    order = np.argsort(owner, kind="stable")
    pairs, place = np.unique(code[order], return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(chunks)))))
    return Chunks(n_a > 0, n_a, n_b, n_groups, n_links, said, pairs, starts, place, weight[order])


class Buffer:
    """Documents of about BUFFER bytes of text: their chunks as numbers, then their counts and links."""

    def __init__(self, pair: Pair):
        self.pair, self.docs, self.bytes = pair, [], 0
        self.chunk: dict[str, int] = defaultdict()
        self.chunk.default_factory = self.chunk.__len__

    def add(self, text: str | None) -> None:
        own = self.pair.chunks(text) if text else []
        self.docs.append(np.fromiter(map(self.chunk.__getitem__, own), np.int64, len(own)))
        self.bytes += len(text or "")

    def slices(self, c: Chunks) -> Iterator[tuple[int, int]]:
        """Ranges of documents whose chunks have about LINKS links."""
        at = total = 0
        n = np.diff(c.starts)
        for k, d in enumerate(self.docs):
            total += int(n[d].sum())
            if total >= LINKS:
                yield at, k + 1
                at, total = k + 1, 0
        if at < len(self.docs):
            yield at, len(self.docs)

    def aligned(self) -> tuple[Chunks, list[tuple], np.ndarray]:
        """The chunks; of each document (n_a, n_b, n_groups, n_links, groups' SHA-256, places of pairs, how many of each);
        and how many documents have each pair."""
        c = _chunks(self.pair, list(self.chunk))
        held, out = np.zeros(len(c.pairs), np.int64), []
        for s, e in self.slices(c):
            docs = [d if c.good[d].all() else d[:0] for d in self.docs[s:e]]
            flat, who = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
            per = [np.bincount(who, x[flat], len(docs)).astype(np.int64).tolist() for x in (c.n_a, c.n_b, c.n_groups, c.n_links)]
            # Each chunk of a document once, then its links, then each pair of the document once.
            both, times = np.unique(who * len(self.chunk) + flat, return_counts=True)
            who, flat = np.divmod(both, max(1, len(self.chunk)))
            n = c.starts[flat + 1] - c.starts[flat]
            at = np.repeat(c.starts[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            key, many = summed(np.repeat(who, n) * max(1, len(c.pairs)) + c.place[at], c.weight[at] * np.repeat(times, n))
            who, place = np.divmod(key, max(1, len(c.pairs)))
            held += np.bincount(place, minlength=len(c.pairs))
            ends = np.searchsorted(who, np.arange(len(docs) + 1)).tolist()
            for k, d in enumerate(docs):
                said = hashlib.sha256(";".join(map(c.said.__getitem__, d.tolist())).encode()).hexdigest() if len(d) else ""
                part = slice(ends[k], ends[k + 1])
                out.append((*(p[k] for p in per), said, place[part].astype("<i4").tobytes(), many[part].astype("<i8").tobytes()))
        return c, out, held


def _stored(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """A row a document (id, counts, places of its pairs in its buffer's list), and before them a row a buffer with the
    list (pairs, and how many of its documents have each). Buffers are numbered by partition, which holds once stored."""

    def run(batches):
        pair, number = pair_of(*paths), TaskContext.get().partitionId() << 32
        names = ["buffer", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "place", "many", "pairs", "held"]
        buffer, ids = Buffer(pair), []

        def rows():
            chunks, found, held = buffer.aligned()
            who = pa.concat_arrays(ids) if ids else pa.nulls(0)
            cols = [pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()], strict=True)]
            kinds = [pa.int64(), who.type, *[c.type for c in cols], pa.list_(pa.int64()), pa.list_(pa.int64())]
            head = [pa.array([number]), *[pa.nulls(1, t) for t in kinds[1:-2]], pa.array([chunks.pairs], kinds[-2]), pa.array([held], kinds[-1])]
            yield pa.RecordBatch.from_arrays(head, names)
            every = [pa.array(np.full(len(found), number)), who, *cols, *[pa.nulls(len(found), t) for t in kinds[-2:]]]
            for at in range(0, len(found), 2000):
                yield pa.RecordBatch.from_arrays([c.slice(at, 2000) for c in every], names)

        for b in batches:
            begun = 0
            for k, t in enumerate(b.column(1)):
                buffer.add(t.as_py())
                if buffer.bytes >= BUFFER:
                    ids.append(b.column(0).slice(begun, k + 1 - begun))
                    yield from rows()
                    buffer, ids, begun, number = Buffer(pair), [], k + 1, number + 1
            if begun < len(b):
                ids.append(b.column(0).slice(begun))
        if buffer.docs:
            yield from rows()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"buffer long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, place binary, many binary, pairs array<long>, held array<long>")


def _size_b(path_b: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path_b).get_piece_size()


def _counts(requests: DataFrame, size_b: int) -> DataFrame:
    """(pair, n_docs, best) of the buffers' lists."""
    counts = requests.groupBy("pair").agg(F.sum("held").alias("n_docs"))
    first = F.expr(f"pair div {size_b}")
    # One row an id of A: no more than its vocabulary.
    most = counts.groupBy(first.alias("a")).agg(F.max("n_docs").alias("most"))
    return counts.withColumn("a", first).join(F.broadcast(most), "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _requests(stored: DataFrame) -> DataFrame:
    lists = stored.filter("pairs is not null").select("buffer", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "p"))
    return lists.select("buffer", "at", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held")).filter("held > 0")


def link_counts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(a_id, b_id, n_docs, best): how many documents hold each pair of ids in one group, and whether no other id of B has
    more for that id of A. What align_documents() says of texts holds here."""
    paths = (path_a or _files()[0], path_b or _files()[1])
    size_b = _size_b(paths[1])
    counts = _counts(_requests(fold(spark, _stored(_plain(docs, id_col, text_col), paths), "aligned")), size_b)
    return counts.select(F.expr(f"pair div {size_b}").cast("int").alias("a_id"), (F.col("pair") % size_b).cast("int").alias("b_id"), "n_docs", "best")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """docs with a column aligned: array<struct<start, end, a_ids, b_ids>>, the byte ranges (of a blank and the text) that both
    tokenizers cut alike, in order. Texts without tokens (see align_documents) have an empty array."""
    paths, out = (path_a or _files()[0], path_b or _files()[1]), free_name(docs, "aligned")
    kinds = docs.schema
    text_at = docs.columns.index(text_col)

    def run(batches):
        pair = pair_of(*paths)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))]))
        for batch in batches:
            for at in range(0, len(batch), 16):
                part, found = batch.slice(at, 16), []
                for t in part.column(text_at).cast(pa.string()).to_pylist():
                    ab = pair.encode(pair.chunks(t)) if t else ([[]], [[]])
                    whole = [[i for x in side for i in x] for side in ab]
                    x = align(pair, [whole[0]], [whole[1]]) if all(ab[0]) and whole[0] else None
                    if x is None:
                        found.append([])
                        continue
                    p, q = (np.cumsum(s) for s in x.sizes)
                    ends = x.ends_a[p - 1].tolist()
                    cut = lambda ids, c: np.split(ids, c[:-1])
                    found.append([{"start": s, "end": e, "a_ids": i.tolist(), "b_ids": j.tolist()} for s, e, i, j in zip([0, *ends[:-1]], ends, cut(x.ids_a, p), cut(x.ids_b, q), strict=True)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*part.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    return docs.mapInArrow(run, f"{schema}, {out} array<struct<start:long,end:long,a_ids:array<int>,b_ids:array<int>>>")


def align_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row a document.

    Tasks align buffers of documents: distinct chunks are encoded and coalesced once, documents are sums over their
    chunks. A buffer asks for the corpus-wide counts of its distinct pairs only; these come back by one join on the pair
    and one grouping by buffer, so no document's links are shuffled one by one, and a pair that all documents hold is a
    row a buffer. Null and empty texts, and texts whose tokens' bytes differ from a blank and the text, have zeros and an
    empty string; rows with one id each get their line; an empty table gives an empty one.
    """
    paths = (path_a or _files()[0], path_b or _files()[1])
    size_b = _size_b(paths[1])
    stored = fold(spark, _stored(_plain(docs, id_col, text_col), paths), "aligned")
    requests = _requests(stored)
    answers = requests.select("buffer", "at", "pair").join(_counts(requests, size_b).hint("merge"), "pair").select(F.col("buffer").alias("owner"), F.col("at").alias("place"), "n_docs", "best")
    rows = stored.filter("pairs is null").drop("pairs", "held")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        n_docs, best = (np.zeros(int(place.max()) + 1 if len(place) else 1, np.int64) for _ in range(2))
        n_docs[place] = right.column("n_docs").to_numpy()
        best[place] = right.column("best").to_numpy(zero_copy_only=False)
        total, won = [], []
        for p, m in zip(left.column("place"), left.column("many"), strict=True):
            at, many = np.frombuffer(p.as_buffer(), "<i4"), np.frombuffer(m.as_buffer(), "<i8")
            total.append(int(n_docs[at] @ many))
            won.append(int(best[at] @ many))
        keep = left.select(["id", "n_a", "n_b", "n_groups", "n_links"])
        return keep.append_column("n_best", pa.array(won, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).append_column("groups_sha256", left.column("groups_sha256"))

    both = rows.groupBy("buffer").cogroup(answers.groupBy("owner"))
    return both.applyInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(spark, read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
