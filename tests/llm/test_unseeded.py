"""The seeds of the decontamination lose nothing against alignment of every text with every item."""

from __future__ import annotations

import random

import numpy as np

from stintflow.llm import decontaminate


def test_edited_copies_are_found_as_by_unseeded_alignment(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    items = {k: [rng.choice(words) for _ in range(rng.randint(3, 24))] for k in range(12)}
    docs = {}
    for d in range(150):
        body = []
        for w in items[d % 12]:
            r, rate = rng.random(), (d // 12) / 20
            body += [] if r < rate / 3 else [f"x{d}"] if r < 2 * rate / 3 else [w, f"y{d}"] if r < rate else [w]
        docs[d] = " ".join([rng.choice(words) for _ in range(rng.randint(0, 30))] + body + [rng.choice(words) for _ in range(rng.randint(0, 30))])
    spaced = items[max(items, key=lambda k: len(items[k]))]
    docs[900] = " ".join(w if k % 2 == 0 else f"{w} new{k}" for k, w in enumerate(spaced))
    docs[901] = " ".join(f"{w} new{k}" for k, w in enumerate(spaced))
    code = {w: k for k, w in enumerate(words)}
    want = {}
    for d, t in docs.items():
        x = np.array([code.get(w, -1) for w in t.split()], np.int64)
        for i, ws in items.items():
            share = decontaminate.align(np.array([code[w] for w in ws]), x)[0] / (2 * len(ws)) if len(x) else 0
            if share >= 0.5:
                want[d, i] = share
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.id, r.item_id): r.score for r in decontaminate.leaks(rows, bench).collect()}
    assert got == want and {d for d, _ in want} >= {900, 901}
    kept = {r.doc_id for r in decontaminate.without_leaks(rows, bench).collect()}
    assert kept == set(docs) - {d for d, _ in want}


def test_rare_seeds_lose_nothing_among_many_items_of_common_words():
    """Items and texts of words by Zipf's law, with edited copies planted, against alignment of all texts with all items."""
    rng = np.random.default_rng(8)
    rates = 1 / np.arange(1, 401)
    rates /= rates.sum()

    def text(n):
        return [b"w%d" % k for k in rng.choice(400, n, p=rates)]

    items = [(k, text(int(rng.integers(3, 40)))) for k in range(80)]
    prepared = decontaminate._prepared(items, 3, 0.5)
    index, found = prepared[0], 0
    for k, ws in items:
        edited = [w if rng.random() > 0.2 else b"other" for w in ws for _ in range(int(rng.random() > 0.1))]
        body = text(25) + edited + text(25)
        x = np.array([index.get(w, -1) for w in body])
        want = {i: s for i, w in items if (s := decontaminate.align(np.array([index[v] for v in w]), x)[0] / (2 * len(w))) >= 0.5}
        assert {i: s for i, s, *_ in decontaminate._judge(b" ".join(body).decode(), prepared, 3, 0.5)} == want
        found += k in want
    assert found > 40


def test_common_pairs_are_not_looked_up():
    """A pair that all items share is no seed where an item has rarer ones, however many items there are."""
    for n in (10, 1000):
        items = [(k, ["of", "the", *(f"a{k}-{j}" for j in range(10)), "of", "the"]) for k in range(n)]
        index, _, _, (keys, who, _), _, base = decontaminate._prepared(items, 3, 0.5)
        common = decontaminate._pair_keys(np.array([index["of"]]), np.array([index["the"]]), base)[0]
        assert common not in keys and len(keys) <= 18 * n
