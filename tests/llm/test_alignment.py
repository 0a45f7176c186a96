"""Alignment of two tokenizers against a plain version that encodes whole texts and lists every link."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from stintflow.llm import alignment

SCHEMA = "doc_id long, text string, id string, aligned int, buffer long, pairs string"


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    """Bytes by their characters in a byte-level vocabulary."""
    keep = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    chars = {chr(b): b for b in keep}
    k = 256
    for b in range(256):
        if b not in keep:
            chars[chr(k)] = b
            k += 1
    return chars


CHARS = byte_of()


def whole_groups(text, tokenizers):
    """[(start, end, A ids, B ids)] of a text by both sets of ends; [] without tokens."""
    if not text:
        return []
    a, b = tokenizers
    e, pieces = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    ids = e.ids
    ta = [bytes(CHARS[c] for c in t) for t in e.tokens]
    tb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in pieces)]
    if b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
        return []
    ends_a, ends_b = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
    out, start, i, j = [], 0, 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        out.append((start, end, ids[i:k], pieces[j:m]))
        start, i, j = end, k, m
    return out


def plain(docs, tokenizers):
    found = [(i, whole_groups(t, tokenizers)) for i, t in docs]
    linked = [Counter((x, y) for g in groups for x in g[2] for y in g[3]) for _, groups in found]
    counts = Counter(p for c in linked for p in c)
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for (i, groups), c in zip(found, linked, strict=True):
        said = ";".join(",".join(map(str, g[2])) + "|" + ",".join(map(str, g[3])) for g in groups)
        rows.append((i, sum(len(g[2]) for g in groups), sum(len(g[3]) for g in groups), len(groups), sum(c.values()), sum(m for p, m in c.items() if counts[p] == best[p[0]]), sum(m * counts[p] for p, m in c.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(rows, key=str), counts, best


TEXTS = [
    "Hello world, this isn't a test.", None, "", " ", "\n", "  two  blanks\tand\ttabs\n\n\nlines\r\n end ", "a\nb\n c \n d", "<|endoftext|> <s> </s> <unk> <0x41> <pad>", "a▁b is not a blank", "▁", "\x00nul\x01 \x1c \x85  wide  spaces   x",
    "日本語のテキスト と 中文 문장", "😀😃 👩‍👩‍👧 é ﬁ Ａ", "don't we'll I'VE 123456 3.14159 x=1;y=2", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "#$%&*|" * 9, "ǅ ŉ ß İ ﷺ", "᠎ x᠎ y ﻿ z", "trailing\n", "x \n", "x\n y",
]


def test_whole_texts_equal_the_plain_version(spark, tokenizers):
    long = " ".join(f"w{k % 997}x{k}" for k in range(3000)) + "\n" + "q" * 5000 + "7f3a" * 3000
    docs = [(k, t) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, TEXTS[0]), (None, None), (100, long), (101, long)]
    df = spark.createDataFrame([(i, t, "i", 1, 2, "p") for i, t in docs], SCHEMA)
    want, counts, best = plain(docs, tokenizers)
    assert sorted(map(tuple, alignment.align_documents(spark, df.repartition(3)).collect()), key=str) == want
    got = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in alignment.link_counts(spark, df).collect()}
    assert got == {p: (n, n == best[p[0]]) for p, n in counts.items()}
    assert sum(r[1] == 0 for r in want) == 5  # null twice, empty, and two with U+2581
    assert alignment.align_documents(spark, df.filter("false")).count() == 0


def test_groups_are_the_common_ends(spark, tokenizers):
    df = spark.createDataFrame([(k, t, "i", 1, 2, "p") for k, t in enumerate(TEXTS)], SCHEMA)
    out = alignment.groups(df)
    assert out.columns == [*df.columns, "aligned_"]
    for r in out.collect():
        assert [(g.start, g.end, g.a_ids, g.b_ids) for g in r.aligned_] == whole_groups(r.text, tokenizers)


def test_given_documents(spark, sf, tokenizers):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = plain([(r.doc_id, r.text) for r in df.collect()], tokenizers)[0]
    got = alignment.op11_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_small_buffers_and_slices_change_nothing(tokenizers, monkeypatch):
    pair = alignment.pair_of(*alignment._files())
    texts = [t for t in TEXTS if t] * 3

    def run():
        buffer = alignment.Buffer(pair)
        for t in texts:
            buffer.add(t)
        c, rows, held = buffer.aligned()
        return [(*r[:5], dict(zip(c.pairs[np.frombuffer(r[5], "<i4")].tolist(), np.frombuffer(r[6], "<i8").tolist(), strict=True))) for r in rows], dict(zip(c.pairs.tolist(), held.tolist(), strict=True))

    want = run()
    monkeypatch.setattr(alignment, "LINKS", 3)
    assert run() == want


def test_coalescing_of_random_intervals():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        ends = [np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n + 1)), n)) for _ in range(2)]
        starts = [np.concatenate(([0], e[:-1])) for e in ends]
        group = alignment.coalesced(np.concatenate(starts), np.concatenate(ends))
        common = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        assert group.tolist() == np.searchsorted(common, np.concatenate(ends)).tolist()
