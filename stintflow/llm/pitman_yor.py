"""Hierarchical Pitman-Yor trigram model: counts, Gibbs seating and scores as Spark jobs.

Every word is a dish. The restaurant of a token's two words before it has the restaurant of the one word before it as its
parent, and these share the root, whose base is uniform; contexts are whole words, told apart by 64-bit hashes. All
restaurants that end in one word are dealt to one bucket, so they are seated and asked without any other data than the
root's probabilities; those of a word with very many tokens behind it are seated by joins instead, with the same draws. The
root's customers are the tables of the word restaurants, seated in a pass before.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stintflow.llm.common import fold, hash_words, lower_words, mix, partitions

END, BEGIN = b"", b" "
_FLUSH = 1_000_000
_WORDS = 1 << 19
_EXACT = 256
_UNIT = float(1 << 32)
_CHUNK = 1 << 14
_CELLS = 1 << 19


@dataclass(frozen=True)
class Settings:
    """Discount and strength by level (root, one word, two words), Gibbs sweeps, and sizes that say where work is done.

    head is the number of frequent words whose root probabilities are broadcast (20 bytes each); other words' come by a
    join. A bucket holds about `bucket` tokens. The restaurants of a word with at least `split` tokens behind it are seated
    by joins over all tasks, so that no group grows with the corpus. None of the three changes a draw.
    """

    discount: tuple[float, float, float] = (0.7, 0.8, 0.65)
    strength: tuple[float, float, float] = (10.0, 2.0, 0.1)
    burn_in: int = 2
    samples: int = 2
    head: int = 1 << 19
    bucket: int = 700_000
    split: int = 8_000_000
    seed: int = 5


def _crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def held_out(doc_id) -> bool:
    """The documents that nothing is learned from."""
    return _crc(doc_id) % 7 == 2


class _Numbers(dict):
    """Numbers for words, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Buffer:
    """The tokens of some texts as numbers of words: the end is 0, the begin before a text is 1."""

    def __init__(self):
        self.numbers = _Numbers({END: 0, BEGIN: 1})
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str | None) -> np.ndarray:
        ws = lower_words(text)
        own = np.zeros(len(ws) + 1, np.int32)
        own[:-1] = np.fromiter(map(self.numbers.__getitem__, ws), np.int32, len(ws))
        self.texts.append(own)
        self.size += len(own)
        return own

    @property
    def full(self) -> bool:
        return self.size >= _FLUSH or len(self.numbers) >= _WORDS // 2

    def hashes(self) -> np.ndarray:
        return hash_words(list(self.numbers), 9)

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word two before, word before, word, text) of every token."""
        sizes = np.array([len(t) for t in self.texts])
        first = np.cumsum(sizes) - sizes
        w = np.concatenate(self.texts)
        before = np.ones_like(w)
        before[1:] = w[:-1]
        before[first] = 1
        two = np.ones_like(w)
        two[1:] = before[:-1]
        two[first] = 1
        return two, before, w, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; the bytes of each are parted by their place, which compresses small numbers."""
    head = np.array([len(arrays), *(len(a) for a in arrays), *(ord(a.dtype.char) for a in arrays)], np.int64).tobytes()
    # Copied as arrays: tobytes() of a transposed one goes byte by byte.
    raw = b"".join([head, *(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).data for a in arrays)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def stretch(value: bytes) -> list[np.ndarray]:
    raw = pa.decompress(memoryview(value)[8:], decompressed_size=int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, kinds = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(2, n).tolist()
    at, out = 8 * (2 * n + 1), []
    for size, kind in zip(sizes, kinds, strict=True):
        dtype = np.dtype(chr(kind))
        width = dtype.itemsize
        part = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        out.append(np.ascontiguousarray(part).reshape(-1).view(dtype))
        at += size * width
    return out


class Head:
    """The frequent words by falling count: hashes, counts, root probabilities; and one for words that no draw asks."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, p: np.ndarray, other_p: float):
        order = np.lexsort((hashes, -counts))
        self.hashes, self.counts, self.p, self.other_p = hashes[order], counts[order], p[order], other_p
        self.place = np.argsort(self.hashes).astype(np.int32)
        self.ordered = self.hashes[self.place]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "ordered"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.ordered = self.hashes[self.place]

    def __len__(self) -> int:
        return len(self.hashes)

    def codes(self, h: np.ndarray) -> np.ndarray:
        """The rank of each word, -1 for others."""
        if not len(self):
            return np.full(len(h), -1)
        # Asked in order, neighbouring searches read the same lines of memory.
        order = np.argsort(h)
        at = np.empty(len(h), np.int64)
        at[order] = np.minimum(np.searchsorted(self.ordered, h[order]), len(self) - 1)
        return np.where(self.ordered[at] == h, self.place[at], -1)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new value of the (sorted) columns begins."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n): the training tokens of each word by its hash."""

    def run(batches):
        buffer = Buffer()

        def counted():
            n = np.bincount(np.concatenate(buffer.texts), minlength=len(buffer.numbers))
            return pa.RecordBatch.from_arrays([pa.array(buffer.hashes()[n > 0].view(np.int64)), pa.array(n[n > 0])], ["word", "n"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not held_out(i):
                    buffer.add(t.as_py())
                    if buffer.full:
                        yield counted()
                        buffer = Buffer()
        if buffer.size:
            yield counted()

    return rows.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def uniforms(key: np.ndarray, *salts: int) -> np.ndarray:
    """A number in (0, 1) for each key: draws belong to a restaurant and dish, not to a batch."""
    salt = np.uint64(0)
    for s in salts:
        salt = mix(np.array([salt + np.uint64(s + 1)], np.uint64))[0]
    return ((mix(mix(key ^ salt)) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def log_stirling(d: float, n: int = _EXACT) -> np.ndarray:
    """Logs of the generalised Stirling numbers: ways to seat c customers at t tables under discount d."""
    s = np.full((n + 1, n + 2), -np.inf)
    s[1, 1] = 0.0
    t = np.arange(n + 2)
    for c in range(1, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(c - d * t > 0, np.log(np.maximum(c - d * t, 1e-300)), -np.inf) + s[c]
            s[c + 1, 1:] = np.logaddexp(s[c, :-1], stay[1:])
    return s


def poisson_mean(c: np.ndarray, a: np.ndarray, d: float) -> np.ndarray:
    """How many tables beyond the first draw_tables opens on average past its exact range, from the generating function's
    mass at c."""
    c, a = np.asarray(c, float), np.maximum(np.asarray(a, float), 1e-12)
    low, high = np.zeros(len(c)), np.full(len(c), 60.0)  # x = 1 - exp(-y)
    for _ in range(50):
        y = (low + high) / 2
        more = a * (1 - np.exp(-y)) * np.exp(y * (1 - d)) < c
        low, high = np.where(more, y, low), np.where(more, high, y)
    return a * (1 - np.exp(-d * (low + high) / 2)) / d


def draw_tables(c: np.ndarray, a: np.ndarray, d: float, table: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Numbers of tables, drawn given c customers of one dish and the weight a of opening one more: P(t) ~ S_d(c, t) a^t.

    This is the conditional of a seating with its members summed out. u gives the draw. Up to 256 customers it is drawn
    exactly; beyond, t - 1 follows about a Poisson law, with less spread where t comes near c (the README states its error).
    """
    t = np.minimum(c, 1).astype(np.int64)
    log_a = np.log(np.maximum(a, 1e-300))
    for low, high in ((2, 4), (5, 16), (17, 64), (65, _EXACT)):
        at = np.flatnonzero((c >= low) & (c <= high))
        for k in range(0, len(at), _CELLS // high):
            part = at[k : k + _CELLS // high]
            logits = table[c[part], 1 : high + 1] + log_a[part, None] * np.arange(1, high + 1)
            p = np.cumsum(np.exp(logits - logits.max(axis=1, keepdims=True)), axis=1)
            t[part] = 1 + (p < u[part, None] * p[:, -1:]).sum(axis=1)
    at = np.flatnonzero(c > _EXACT)
    if len(at):
        m = np.maximum(poisson_mean(c[at], a[at], d), 1e-9)
        z = np.array([NormalDist().inv_cdf(x) for x in u[at].tolist()])
        spread = np.sqrt(m * (1 - np.minimum(m / c[at], 1) ** 2))
        t[at] = np.clip(1 + np.rint(m + z * spread + (z * z - 1) / 6), 1, c[at])
    return t


def _order(columns: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """The stable order of rows by columns of numbers below the given sizes."""
    room = 1
    for n in sizes:
        room *= max(1, n)
    if room >= 1 << 63:
        return np.lexsort(columns[::-1])
    key = columns[0].astype(np.int64)
    for c, n in zip(columns[1:], sizes[1:], strict=True):
        key *= n
        key += c
    return np.argsort(key, kind="stable")


def _dealt_order(bucket: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Numbers of contexts in order of their bucket and code, the head's first."""
    return np.lexsort((np.where(codes < 0, len(codes) + (1 << 40), codes), bucket))


def _blobs(bucket, columns, head: Head, hashes, codes, more):
    """(bucket, value) for rows in order of bucket and context. columns are numbers of words, that of the context first; a
    value holds the hashes of its words beyond the head, the steps between its contexts' codes, their numbers of rows, the
    other words' codes, and more.

    more: from a slice of the rows to further arrays of its value.
    """
    at = _starts(bucket)
    place = np.empty(len(codes), np.int64)
    for low, n in zip(at.tolist(), _sizes(at, len(bucket)).tolist(), strict=True):
        part = slice(low, low + n)
        runs = _starts(columns[0][part])
        own = [columns[0][part][runs], *(c[part] for c in columns[1:])]
        coded = [codes[c] for c in own]
        late = [np.flatnonzero(x < 0) for x in coded]
        other = np.unique(np.concatenate([c[k] for c, k in zip(own, late, strict=True)]))
        place[other] = np.arange(len(head), len(head) + len(other))
        for c, x, k in zip(own, coded, late, strict=True):
            x[k] = place[c[k]]
        steps = np.diff(coded[0], prepend=0).astype(np.int32)
        yield int(bucket[low]), squeeze(hashes[other], steps, _sizes(runs, n).astype(np.uint32), *(x.astype(np.uint32) for x in coded[1:]), *more(part))


class Contents:
    """Rows of one bucket from all its values, with words numbered alike: the head's by rank, others behind it."""

    def __init__(self, values: list[bytes], head: Head, n_words: int):
        parts = [stretch(v) for v in values]
        self.others, to = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        self.n_codes = len(head) + len(self.others)
        offset, contexts = 0, []

        def alike(x):
            x = x.astype(np.int32)
            late = x >= len(head)
            x[late] = len(head) + to[offset + x[late] - len(head)]
            return x

        for p in parts:
            contexts.append(alike(np.cumsum(p[1])))
            for k in range(3, 3 + n_words):
                p[k] = alike(p[k])
            offset += len(p[0])
        listed, at = np.unique(np.concatenate(contexts), return_inverse=True)
        self.contexts = self.hashes(head, listed)
        self.context = np.repeat(at.astype(np.int32), np.concatenate([p[2] for p in parts]))
        self.words = []
        for k in range(3, 3 + n_words):
            self.words.append(np.concatenate([p[k] for p in parts]))
            for p in parts:
                p[k] = None
        self.rest = [p[3 + n_words :] for p in parts]
        self.other_p = np.full(len(self.others), head.other_p)

    def learn(self, words: np.ndarray, p: np.ndarray) -> None:
        """Take root probabilities of words beyond the head, by their hashes."""
        at = np.minimum(np.searchsorted(self.others, words), max(0, len(self.others) - 1))
        met = self.others[at] == words if len(self.others) else np.zeros(len(words), bool)
        self.other_p[at[met]] = p[met]

    def hashes(self, head: Head, codes: np.ndarray) -> np.ndarray:
        if not len(self.others):
            return head.hashes[codes]
        own = np.minimum(codes, len(head) - 1)
        late = np.maximum(codes - len(head), 0)
        return np.where(codes < len(head), head.hashes[own] if len(head) else np.uint64(0), self.others[late])

    def root(self, head: Head, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([head.p, self.other_p])[codes]


def by_bucket(batches, work, word: str = "word", number: str = "x"):
    """work(bucket, values, words, numbers) for each bucket; rows come sorted by bucket, and one bucket is held at a time.

    Rows with a value bring it; the others bring a word and its number.
    """
    own, held, told = None, [], {}

    def done():
        got = told.pop(own, [])
        words = np.concatenate([np.empty(0, np.int64), *(g[0] for g in got)]).view(np.uint64)
        return work(own, held, words, np.concatenate([np.empty(0), *(g[1] for g in got)]))

    for b in batches:
        # Values are large: no batch of them is copied.
        lone = b.select(["bucket", word, number]).filter(b.column("value").is_null())
        if len(lone):
            of, ws, xs = (lone.column(c).to_numpy() for c in ("bucket", word, number))
            at = _starts(of)
            for low, n in zip(at.tolist(), _sizes(at, len(of)).tolist(), strict=True):
                told.setdefault(int(of[low]), []).append((ws[low : low + n], xs[low : low + n].astype(float)))
        for bucket, value in zip(b.column("bucket").to_pylist(), b.column("value"), strict=True):
            if not value.is_valid:
                continue
            if bucket != own and held:
                yield from done()
                held = []
            own = bucket
            held.append(value.as_py())
    if held:
        yield from done()


def _batch(kinds: dict, n: int, **columns) -> pa.RecordBatch:
    """A batch of n rows of these kinds; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()], list(kinds))


_LONG = pa.int64()
_TABLES = {"bucket": _LONG, "value": pa.binary(), "chunk": _LONG, "word": _LONG, "t": _LONG}
_TABLES_SCHEMA = "bucket long, value binary, chunk long, word long, t long"


def _totals(total: np.ndarray):
    """Sums by word of the head, in chunks."""
    if total.any():
        chunks = range(0, len(total), _CHUNK)
        yield _batch(_TABLES, len(chunks), chunk=[k // _CHUNK for k in chunks], value=[squeeze(total[k : k + _CHUNK].astype(np.int64)) for k in chunks])


def root_customers(spark: SparkSession, rows: DataFrame, counts: DataFrame, start: Root, head: Head, buckets: int, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(word, t): the tables of each dish in all restaurants of one word, seated over the pairs of words alone; and (bucket,
    word): the words beyond the head that occur twice behind one word of a bucket. Only these are drawn there, so only their
    root probabilities are sent to it; a pair that occurs once has one table whatever they are.
    """
    sent = spark.sparkContext.broadcast(head)

    def pairs(batches):
        head = sent.value
        buffer = Buffer()

        def counted():
            _, before, w, _ = buffer.columns()
            h = buffer.hashes()
            bucket = (mix(h) % np.uint64(buckets)).astype(np.int64)
            codes = head.codes(h)
            place = _dealt_order(bucket, codes)
            rank = np.empty(len(h), np.int64)
            rank[place] = np.arange(len(h))
            key = np.sort(rank[before] * len(h) + w)
            first = _starts(key)
            before, w = place[key[first] // len(h)], key[first] % len(h)
            n = _sizes(first, len(key)).astype(np.uint32)
            got = list(_blobs(bucket[before], [before, w], head, h, codes, lambda part: (n[part],)))
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], ["bucket", "value"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not held_out(i):
                    buffer.add(t.as_py())
                    if buffer.full:
                        yield counted()
                        buffer = Buffer()
        if buffer.size:
            yield counted()

    def gather(batches):
        """Pairs that occur once are seated; the others of a bucket are one value, with the words that it asks."""
        head = sent.value
        total = np.zeros(len(head), np.int64)

        def work(bucket, values, *_):
            own = Contents(values, head, 1)
            n = np.concatenate([r[0] for r in own.rest]).astype(np.int64)
            key = own.context.astype(np.int64) * own.n_codes + own.words[0]
            order = np.argsort(key)
            first = _starts(key[order])
            c = np.add.reduceat(n[order], first)
            key = key[order][first]
            context, word = key // own.n_codes, key % own.n_codes
            once, many = word[c == 1], np.flatnonzero(c > 1)
            total[:] += np.bincount(once[once < len(head)], minlength=len(head))
            sums = np.bincount(once[once >= len(head)] - len(head), minlength=len(own.others))
            at = np.flatnonzero(sums)
            yield _batch(_TABLES, len(at), word=own.others[at].view(np.int64), t=sums[at])
            if len(many):
                runs = _starts(context[many])
                held = context[many][runs]
                word = word[many]
                late = word >= len(head)
                asked, to = np.unique(word[late], return_inverse=True)
                word[late] = len(head) + to
                asked = own.others[asked - len(head)]
                alone = np.bincount(context[c == 1], minlength=len(own.contexts))[held]
                yield _batch(_TABLES, 1, bucket=[bucket], value=[squeeze(own.contexts[held], asked, alone, _sizes(runs, len(many)), word, c[many])])
                yield _batch(_TABLES, len(asked), bucket=np.full(len(asked), bucket), word=asked.view(np.int64))

        def with_words(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(len(b), _LONG), pa.nulls(len(b), pa.float64())], ["bucket", "value", "word", "x"])

        yield from by_bucket(with_words(batches), work)
        yield from _totals(total)

    def seat(batches):
        head = sent.value
        table = log_stirling(s.discount[1])
        total = np.zeros(len(head), np.int64)

        def work(bucket, values, words, n):
            contexts, asked, alone, sizes, word, c = stretch(values[0])
            late_p = np.full(len(asked), head.other_p)
            late_p[np.searchsorted(asked, words)] = start.probability(n, 1, s)
            p = np.concatenate([head.p, late_p])[word]
            context = np.repeat(np.arange(len(contexts)), sizes)
            draw = mix(contexts[context] + mix(np.concatenate([head.hashes, asked])[word]))
            t = np.ones(len(c), np.int64)
            for sweep in range(s.burn_in + 1):
                tables = (np.bincount(context, t, len(contexts)) + alone)[context] - t
                a = (s.strength[1] + s.discount[1] * tables) * p
                t = draw_tables(c, a, s.discount[1], table, uniforms(draw, s.seed, 1, sweep))
            known = word < len(head)
            total[:] += np.bincount(word[known], t[known], len(head)).astype(np.int64)
            sums = np.bincount(word[~known] - len(head), t[~known], len(asked)).astype(np.int64)
            yield _batch(_TABLES, len(sums), word=asked.view(np.int64), t=sums)

        yield from by_bucket(batches, work)
        yield from _totals(total)

    def add_up(batches):
        head = sent.value

        def words(at, t):
            return pa.RecordBatch.from_arrays([pa.array(head.hashes[at * _CHUNK : at * _CHUNK + len(t)].view(np.int64)), pa.array(t)], ["word", "t"])

        own, held = None, None
        for b in batches:
            for chunk, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if chunk != own and held is not None:
                    yield words(own, held)
                    held = None
                own, x = chunk, stretch(value.as_py())[0]
                held = x if held is None else held + x
        if held is not None:
            yield words(own, held)

    def by_bucket_order(df):
        return df.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")

    once = fold(spark, by_bucket_order(rows.mapInArrow(pairs, "bucket long, value binary")).mapInArrow(gather, _TABLES_SCHEMA), "pairs")
    asked = once.filter("bucket is not null and word is not null").select("bucket", "word")
    told = asked.join(counts.select("word", "n"), "word").select("bucket", F.lit(None).cast("binary").alias("value"), "word", F.col("n").cast("double").alias("x"))
    many = once.filter("bucket is not null and value is not null").select("bucket", "value", F.lit(None).cast("long").alias("word"), F.lit(None).cast("double").alias("x"))
    seated = once.filter("bucket is null").unionByName(fold(spark, by_bucket_order(many.unionByName(told)).mapInArrow(seat, _TABLES_SCHEMA), "tables"))
    frequent = seated.filter("chunk is not null").select("chunk", "value").repartition(partitions(spark), "chunk").sortWithinPartitions("chunk").mapInArrow(add_up, "word long, t long")
    return frequent.filter("t > 0").unionByName(seated.filter("word is not null").groupBy("word").agg(F.sum("t").alias("t"))), asked


@dataclass
class Root:
    """Totals of the root: training tokens and words, customers and tables."""

    tokens: int
    words: int
    customers: float
    tables: float

    def probability(self, c, t, s: Settings):
        """P(word) from the word's own customers and tables (0 for an unseen word)."""
        base = (s.strength[0] + s.discount[0] * self.tables) / (self.words + 1)
        return (c - s.discount[0] * t + base) / (s.strength[0] + self.customers)


def seat_root(spark: SparkSession, words: DataFrame, root: Root, s: Settings) -> DataFrame:
    """(word, n, c, t) of words (word, n, c): the root's tables of each dish, drawn from one table each as the start."""

    def run(batches):
        table = log_stirling(s.discount[0])
        a = (s.strength[0] + s.discount[0] * (root.tables - 1)) / (root.words + 1)
        for b in batches:
            c, key = b.column(2).to_numpy(), b.column(0).to_numpy().view(np.uint64)
            t = draw_tables(c, np.full(len(c), a), s.discount[0], table, uniforms(key, s.seed, 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(t)], ["word", "n", "c", "t"])

    return fold(spark, words.select("word", "n", "c").mapInArrow(run, "word long, n long, c long, t long"), "root")


def head_of(words: DataFrame, root: Root, s: Settings) -> Head:
    """The head of words (word, n, c, t): as many steps of the count, from the top, as have at most s.head words."""
    step = F.floor(F.log2("n") * 64)
    least, held = None, 0
    for b, m in sorted(tuple(r) for r in words.groupBy(step.alias("b")).agg(F.count("*")).collect())[::-1]:
        if held + m > s.head:
            break
        least, held = b, held + m
    other = root.probability(0, 0, s)
    got = words.filter(step >= F.lit(least)).select("word", "n", "c", "t").toArrow().combine_chunks() if held else None
    if got is None or not len(got):
        return Head(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0), other)
    word, n, c, t = (got.column(k).to_numpy() for k in range(4))
    return Head(word.view(np.uint64), n, root.probability(c, t, s), other)


def seat_bucket(own: Contents, head: Head, two, context, word, c3, s: Settings, tables):
    """(alpha, beta) of trigram types, sorted by context, word two before and word, that have c3 training tokens each: a
    token's probability is alpha + beta x the root's, on average over the samples of the seating.

    A sweep draws the tables of every dish in the two-word restaurants given the one-word restaurant without the dish's
    own share of it, then seats these tables as its customers and draws theirs given the root.
    """
    d2, d3, th2, th3 = *s.discount[1:], *s.strength[1:]
    guests = _sizes(_starts(context, two), len(c3))
    at3 = np.repeat(np.arange(len(guests), dtype=np.int32), guests)
    pair, at2 = np.unique(context.astype(np.int64) * own.n_codes + word, return_inverse=True)
    at2 = at2.astype(np.int32)
    ctx2, dish = (pair // own.n_codes).astype(np.int32), (pair % own.n_codes).astype(np.int32)
    n2 = len(pair)
    del pair
    p = own.root(head, dish)
    many3 = np.flatnonzero(c3 > 1)
    could2 = np.flatnonzero(np.bincount(at2, c3, n2) > 1)
    key2 = np.zeros(n2, np.uint64)
    key2[could2] = mix(own.contexts[ctx2[could2]] + mix(own.hashes(head, dish[could2])))
    key3 = mix(key2[at2[many3]] + mix(own.hashes(head, two[many3]) ^ np.uint64(0x5851F42D4C957F2D)))
    weight3 = th3 + np.bincount(at3, c3)
    t3 = np.minimum(c3, 1)
    c2 = np.bincount(at2, t3, n2).astype(np.int32)
    t2 = np.minimum(c2, 1)
    alpha, beta = np.zeros(len(c3)), np.zeros(len(c3))
    m2 = at2[many3]
    of2 = ctx2[m2]
    for sweep in range(s.burn_in + s.samples):
        open3 = np.bincount(at3, t3)
        all2, open2 = np.bincount(ctx2, c2), np.bincount(ctx2, t2)
        rest = c2[m2] - t3[many3]
        above = (np.maximum(rest - d2 * np.minimum(t2[m2], rest), 0) + (th2 + d2 * open2[of2]) * p[m2]) / (th2 + all2[of2])
        a = (th3 + d3 * (open3[at3[many3]] - t3[many3])) * above
        t3[many3] = draw_tables(c3[many3], a, d3, tables[2], uniforms(key3, s.seed, 3, sweep))
        c2 = np.bincount(at2, t3, n2).astype(np.int32)
        t2 = np.minimum(np.maximum(t2, np.minimum(c2, 1)), c2)
        many2 = could2[c2[could2] > 1]
        a = (th2 + d2 * (np.bincount(ctx2, t2)[ctx2[many2]] - t2[many2])) * p[many2]
        t2[many2] = draw_tables(c2[many2], a, d2, tables[1], uniforms(key2[many2], s.seed, 2, sweep))
        t2 = np.where(c2 == 1, 1, t2)
        if sweep >= s.burn_in:
            weight2 = th2 + np.bincount(ctx2, c2)
            own2 = (c2 - d2 * t2) / weight2[ctx2]
            back2 = ((th2 + d2 * np.bincount(ctx2, t2)) / weight2)[ctx2]
            share3 = (th3 + d3 * np.bincount(at3, t3)) / weight3
            for low in range(0, len(c3), _FLUSH):
                k = slice(low, low + _FLUSH)
                back3 = share3[at3[k]]
                alpha[k] += (c3[k] - d3 * t3[k]) / weight3[at3[k]] + back3 * own2[at2[k]]
                beta[k] += back3 * back2[at2[k]]
    return alpha / s.samples, beta / s.samples


def hot_types(spark: SparkSession, hot: DataFrame, own: DataFrame, unseen: float, s: Settings) -> DataFrame:
    """(v, u, w, p, alpha, beta) of the trigram types of tokens (v, u, w, trained): word before, word two before, word.

    seat_bucket() for words with too many tokens behind them for one task: the sums by restaurant and dish that a sweep
    reads come by joins. Draws belong to restaurant, dish and sweep, so they are those that one task would make.
    """
    d2, d3, th2, th3 = *s.discount[1:], *s.strength[1:]
    double, one = pa.float64(), "v long, u long, w long, c3 long, t3 long, alpha double, beta double"
    kinds = {"v": _LONG, "u": _LONG, "w": _LONG, "c3": _LONG, "t3": _LONG, "alpha": double, "beta": double}

    def unsigned(b, name):
        return b.column(name).to_numpy().view(np.uint64)

    def columns(b, *names):
        return (b.column(n).to_numpy() for n in names)

    def key2(b):
        return mix(unsigned(b, "v") + mix(unsigned(b, "w")))

    def step(sweep):
        """Adds the sample that the state is to alpha and beta, if it is one; then draws t3, if a sweep follows."""

        def run(batches):
            table = log_stirling(d3)
            for b in batches:
                c3, t3, n3, open3, c2, t2, p, all2, open2, alpha, beta = columns(b, "c3", "t3", "n3", "open3", "c2", "t2", "p", "all2", "open2", "alpha", "beta")
                weight3 = th3 + n3
                if sweep > s.burn_in:
                    weight2 = th2 + all2
                    back3 = (th3 + d3 * open3) / weight3
                    alpha = alpha + ((c3 - d3 * t3) / weight3 + back3 * ((c2 - d2 * t2) / weight2))
                    beta = beta + back3 * ((th2 + d2 * open2) / weight2)
                if sweep < s.burn_in + s.samples:
                    rest = c2 - t3
                    above = (np.maximum(rest - d2 * np.minimum(t2, rest), 0) + (th2 + d2 * open2) * p) / (th2 + all2)
                    a = (th3 + d3 * (open3 - t3)) * above
                    many = np.flatnonzero(c3 > 1)
                    key3 = mix(key2(b)[many] + mix(unsigned(b, "u")[many] ^ np.uint64(0x5851F42D4C957F2D)))
                    t3 = t3.copy()
                    t3[many] = draw_tables(c3[many], a[many], d3, table, uniforms(key3, s.seed, 3, sweep))
                yield _batch(kinds, len(b), v=b.column("v"), u=b.column("u"), w=b.column("w"), c3=c3, t3=t3, alpha=alpha, beta=beta)

        return run

    def dishes(sweep):
        def run(batches):
            table = log_stirling(d2)
            for b in batches:
                c2, t2, could, p, open2 = columns(b, "c2", "t2", "could", "p", "open2")
                many = np.flatnonzero((could > 1) & (c2 > 1))
                t2 = t2.copy()
                a = (th2 + d2 * (open2[many] - t2[many])) * p[many]
                t2[many] = draw_tables(c2[many], a, d2, table, uniforms(key2(b)[many], s.seed, 2, sweep))
                yield pa.RecordBatch.from_arrays([b.column("v"), b.column("w"), b.column("could"), pa.array(c2), pa.array(np.where(c2 == 1, 1, t2)), b.column("p")], ["v", "w", "could", "c2", "t2", "p"])

        return run

    count = F.sum(F.col("trained").cast("long"))
    types = fold(spark, hot.groupBy("v", "u", "w").agg(count.alias("c3")).selectExpr("v", "u", "w", "c3", "least(c3, 1) AS t3", "0D AS alpha", "0D AS beta"), "hot-types")
    found = types.groupBy("v", "w").agg(F.sum("c3").alias("could"), F.sum("t3").alias("c2")).withColumn("t2", F.least("c2", F.lit(1)).cast("long"))
    dish = fold(spark, found.join(own.select(F.col("word").alias("w"), F.col("p").alias("q")), "w", "left").select("v", "w", "could", "c2", "t2", F.coalesce("q", F.lit(unseen)).alias("p")), "hot-dishes")
    for sweep in range(s.burn_in + s.samples + 1):
        room = types.groupBy("v", "u").agg(F.sum("c3").alias("n3"), F.sum("t3").alias("open3"))
        all_of = dish.groupBy("v").agg(F.sum("c2").alias("all2"), F.sum("t2").alias("open2"))
        state = types.join(room, ["v", "u"]).join(dish, ["v", "w"]).join(F.broadcast(all_of), "v")
        types = fold(spark, state.mapInArrow(step(sweep), one), "hot-types")
        if sweep < s.burn_in + s.samples:
            c2 = types.groupBy("v", "w").agg(F.sum("t3").alias("c2"))
            moved = dish.drop("c2").join(c2, ["v", "w"]).withColumn("t2", F.least(F.greatest("t2", F.least("c2", F.lit(1))), "c2"))
            moved = fold(spark, moved.select("v", "w", "could", "c2", "t2", "p"), "hot-dishes")
            open2 = F.broadcast(moved.groupBy("v").agg(F.sum("t2").alias("open2")))
            dish = fold(spark, moved.join(open2, "v").mapInArrow(dishes(sweep), "v long, w long, could long, c2 long, t2 long, p double"), "hot-dishes")
    return types.join(dish.select("v", "w", "p"), ["v", "w"]).select("v", "u", "w", "p", (F.col("alpha") / s.samples).alias("alpha"), (F.col("beta") / s.samples).alias("beta"))


def score(spark: SparkSession, rows: DataFrame, words: DataFrame, asked_words: DataFrame, root: Root, head: Head, buckets: int, s: Settings) -> DataFrame:
    """(id, held_out, n_tokens, n_known, base_sum, score) of every row (id, text).

    Every token is dealt to the bucket of the word before it, where the restaurants are seated and the token is asked.
    Tokens of the head's words are summed by row there; those of others bring alpha and beta to the root's table by a
    join on the word. Sums are whole numbers of 2^-32, so they don't depend on their order. asked_words (bucket, word) are
    the words beyond the head that a bucket draws, and get their root probabilities there.
    """
    sent = spark.sparkContext.broadcast(head)
    kind = rows.schema["id"].dataType
    id_type = to_arrow_type(kind)
    # Begins are as many as ends, which are a word of the head like any other.
    any_hot = bool(len(head)) and int(head.counts.max()) >= s.split
    double = pa.float64()
    line_kinds = {"d": _LONG, "id": id_type, "held_out": pa.bool_(), "n_tokens": _LONG, "n_known": _LONG, "base": double} | ({"v": _LONG, "u": _LONG, "w": _LONG, "late": pa.bool_()} if any_hot else {})
    kinds = {"bucket": _LONG, "value": pa.binary()} | line_kinds
    out_kinds = line_kinds | {"score": _LONG, "word": _LONG, "alpha": double, "beta": double}

    def deal(batches):
        head = sent.value
        buffer, lines = Buffer(), []

        def dealt():
            two, before, w, text = buffer.columns()
            h = buffer.hashes()
            codes = head.codes(h)
            counts = np.where(codes >= 0, head.counts[codes], 0) if len(head) else np.zeros(len(h), np.int64)
            known = np.bincount(text, codes[w] >= 0, len(lines)).astype(np.int64)
            base = np.bincount(text, np.log10(counts + 1.0)[w], len(lines))
            ds = np.array([x[0] for x in lines], np.int64)
            crc = np.array([_crc(x[1]) for x in lines], np.uint64)
            n_tokens = np.array([len(t) for t in buffer.texts])
            spread = -1 - (mix(ds.view(np.uint64)) >> np.uint64(33)).astype(np.int64)
            trained = crc % np.uint64(7) != 2
            yield _batch(kinds, len(ds), bucket=spread, d=ds, id=[x[1] for x in lines], held_out=~trained, n_tokens=n_tokens, n_known=known, base=base)
            follows = counts.copy()
            follows[1] = counts[0]  # as many begins as ends
            hot = (follows >= s.split)[before]
            if hot.any():
                at = np.flatnonzero(hot)
                hs = h.view(np.int64)
                yield _batch(kinds, len(at), bucket=spread[text[at]], d=ds[text[at]], held_out=~trained[text[at]], v=hs[before[at]], u=hs[two[at]], w=hs[w[at]], late=codes[w[at]] < 0)
                two, before, w, text = two[~hot], before[~hot], w[~hot], text[~hot]
            bucket = (mix(h) % np.uint64(buckets)).astype(np.int64)
            rank = np.empty(len(h), np.int32)
            rank[_dealt_order(bucket, codes)] = np.arange(len(h))
            order = _order([rank[before], two, w], [len(h)] * 3)
            context, two, w, text = before[order], two[order], w[order], text[order]
            del order
            met, line = np.zeros(len(ds), bool), np.empty(len(ds), np.uint32)

            def lines_of(part):
                """A value names the texts that it has tokens of, and no others: its size follows its tokens."""
                met[text[part]] = True
                listed = np.flatnonzero(met)
                met[listed] = False
                line[listed] = np.arange(len(listed), dtype=np.uint32)
                return line[text[part]], ds[:1], np.diff(listed, prepend=0).astype(np.uint32), np.packbits(trained[listed])

            if len(w):
                got = list(_blobs(bucket[context], [context, two, w], head, h, codes, lines_of))
                yield _batch(kinds, len(got), bucket=[g[0] for g in got], value=[g[1] for g in got])

        for b in batches:
            for i, t, d in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if lines and d != lines[-1][0] + 1:
                    yield from dealt()
                    buffer, lines = Buffer(), []
                buffer.add(t.as_py())
                lines.append((d, i))
                if buffer.full:
                    yield from dealt()
                    buffer, lines = Buffer(), []
        if lines:
            yield from dealt()

    def ask(batches):
        head = sent.value
        tables = [log_stirling(d) for d in s.discount]

        def work(_, values, words, p):
            own = Contents(values, head, 2)
            own.learn(words, p)
            values.clear()
            text = np.concatenate([r[0].astype(np.int32) + k for r, k in zip(own.rest, np.cumsum([0, *(len(r[2]) for r in own.rest)]).tolist(), strict=False)])
            d = np.concatenate([r[1][0] + np.cumsum(r[2], dtype=np.int64) for r in own.rest])
            trained = np.concatenate([np.unpackbits(r[3], count=len(r[2])) for r in own.rest])
            del own.rest
            order = _order([own.context, *own.words], [len(own.contexts), own.n_codes, own.n_codes])
            context, two, word = own.context[order], own.words[0][order], own.words[1][order]
            text = text[order]
            del order, own.context, own.words
            first = _starts(context, two, word)
            c3 = np.add.reduceat(trained[text], first, dtype=np.int32)
            context, two, word = context[first], two[first], word[first]
            alpha, beta = seat_bucket(own, head, two, context, word, c3, s, tables)
            del context, two, c3
            bounds = np.append(first, len(text))
            sums, met = np.zeros(len(d)), np.zeros(len(d), bool)
            for low in range(0, len(word), _FLUSH):
                part = slice(low, low + _FLUSH)
                each = np.diff(bounds[low : low + _FLUSH + 1])
                asked = text[bounds[low] : bounds[low + len(each)]]
                known = word[part] < len(head)
                in_head = np.repeat(known, each)
                logs = np.repeat(np.log10(alpha[part] + beta[part] * own.root(head, word[part])), each)[in_head]
                sums += np.bincount(asked[in_head], logs, len(d))
                met[asked[in_head]] = True
                if not known.all():
                    late = ~in_head
                    which = low + np.repeat(np.arange(len(each)), each)[late]
                    yield _batch(out_kinds, len(which), d=d[asked[late]], word=own.hashes(head, word[which]).view(np.int64), alpha=alpha[which], beta=beta[which])
            at = np.flatnonzero(met)
            yield _batch(out_kinds, len(at), d=d[at], score=np.rint(sums[at] * _UNIT).astype(np.int64))

        # Lines come before all buckets, whose numbers aren't negative.
        for b in batches:
            n = int(np.searchsorted(b.column("bucket").to_numpy(), 0))
            if n:
                yield _batch(out_kinds, n, **{k: b.column(k).slice(0, n) for k in line_kinds})
            if n < len(b):
                yield from by_bucket(chain([b.slice(n)], batches), work, "d", "base")

    def spelled(kinds):
        names = {_LONG: "long", pa.binary(): "binary", double: "double", pa.bool_(): "boolean"}
        return ", ".join(f"{k} {kind.simpleString() if k == 'id' else names[t]}" for k, t in kinds.items())

    own = words.select("word", "n", root.probability(F.col("c"), F.col("t"), s).alias("p"))
    unseen = float(root.probability(0, 0, s))
    tokens = rows.withColumn("d", F.monotonically_increasing_id()).mapInArrow(deal, spelled(kinds))
    told = asked_words.join(own, "word").select("bucket", F.col("word").alias("d"), F.col("p").alias("base"))
    tokens = tokens.unionByName(told, allowMissingColumns=True)
    asked = tokens.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(ask, spelled(out_kinds))
    asked = fold(spark, asked, "asked")
    sums = asked.filter("score is not null").select("d", "score")
    met = asked.filter("word is not null").select("d", "word", "alpha", "beta")
    if any_hot:
        hot = asked.filter("v is not null").select("d", "v", "u", "w", "late", (~F.col("held_out")).alias("trained"))
        hot = fold(spark, hot.join(hot_types(spark, hot, own, unseen, s), ["v", "u", "w"]), "hot")
        met = met.unionByName(hot.filter("late").select("d", F.col("w").alias("word"), "alpha", "beta"))
        sums = sums.unionByName(hot.filter("not late").select("d", F.rint(F.log10(F.col("alpha") + F.col("beta") * F.col("p")) * _UNIT).cast("long").alias("score")))
    sums = sums.groupBy("d").agg(F.sum("score").alias("score"))
    met = met.join(own, "word", "left")
    p = F.coalesce("p", F.lit(unseen))
    others = met.groupBy("d").agg(F.count("n").alias("also_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("also_base"), F.sum(F.rint(F.log10(F.col("alpha") + F.col("beta") * p) * _UNIT).cast("long")).alias("also"))
    rows = asked.filter("n_tokens is not null").select("d", "id", "held_out", "n_tokens", "n_known", "base").join(sums, "d", "left").join(others, "d", "left")
    zero = F.lit(0)
    return rows.select("id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also_known", zero)).alias("n_known"), (F.col("base") + F.coalesce("also_base", F.lit(0.0))).alias("base_sum"), ((F.coalesce("score", zero) + F.coalesce("also", zero)) / F.lit(_UNIT)).alias("score"))


def model_scores(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows that held_out() leaves, all of them, and scores all rows. Null and empty texts are the end token
    alone; every row has its own line, repeated ones too; without training rows the model is the uniform base. Scores
    don't depend on the partitioning or the sizes in settings: a draw belongs to its restaurant, dish and sweep.
    """
    s = settings
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = fold(spark, word_counts(rows), "words")
    tokens, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    buckets = max(1, tokens // s.bucket)
    start = Root(tokens, n_words, float(tokens), float(n_words))
    first = counts.select("word", "n", F.col("n").alias("c"), F.lit(1).cast("long").alias("t"))
    customers, asked = root_customers(spark, rows, counts, start, head_of(first, start, s), buckets, s)
    words = seat_root(spark, counts.join(customers, "word", "left").select("word", "n", F.coalesce("t", F.lit(1)).cast("long").alias("c")), start, s)
    c, t = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    root = Root(tokens, n_words, float(c), float(t))
    found = score(spark, rows, words, asked, root, head_of(words, root, s), buckets, s)
    shift = F.col("n_tokens") * F.lit(float(np.log10(tokens + n_words + 1)))
    return found.select("id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base_sum") - shift).alias("base_score"), "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, n_tokens, perplexity, base_perplexity)."""
    n = F.sum("n_tokens")
    return scored.groupBy("held_out").agg(n.alias("n_tokens"), F.pow(F.lit(10.0), -F.sum("score") / n).alias("perplexity"), F.pow(F.lit(10.0), -F.sum("base_score") / n).alias("base_perplexity"))


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_scores(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
