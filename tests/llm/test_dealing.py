"""Dealing of tokens to buckets in op9: values hold what they must, without a search a token."""

from __future__ import annotations

import pickle

import numpy as np

from stintflow.llm import pitman_yor as P


def _head(h: np.ndarray) -> P.Head:
    return P.Head(h, np.arange(len(h), 0, -1), np.full(len(h), 0.1), 0.01)


def test_values_come_back(monkeypatch):
    buffer = P.Buffer()
    for text in ["a b c a b", "c d a", "", "b b b e f"]:
        buffer.add(text)
    h = buffer.hashes()
    head = _head(h[[0, 2, 3]])
    _, before, w, text = buffer.columns()
    codes = head.codes(h)
    order = np.lexsort((w, before))
    before, w, text = before[order], w[order], text[order]
    with monkeypatch.context() as m:
        m.setattr(P.np, "searchsorted", lambda *a, **k: 1 / 0)
        got = list(P._blobs(np.zeros(len(w), np.int64), [before, w], head, h, codes, lambda part: (text[part].astype(np.uint32),)))
    assert [g[0] for g in got] == [0]
    own = P.Contents([got[0][1]], head, 1)
    back = zip(own.contexts[own.context].tolist(), own.hashes(head, own.words[0]).tolist(), own.rest[0][0].tolist(), strict=True)
    assert sorted(back) == sorted(zip(h[before].tolist(), h[w].tolist(), text.tolist(), strict=True))


def test_empty_arrays_are_squeezed():
    arrays = [np.empty(0, np.uint64), np.arange(-3, 4, dtype=np.int32), np.empty(0, np.uint8), np.arange(300, dtype=np.uint64) << np.uint64(50)]
    for a, b in zip(arrays, P.stretch(P.squeeze(*arrays)), strict=True):
        assert a.dtype == b.dtype and np.array_equal(a, b)


def test_codes_are_places_of_the_head_and_survive_the_broadcast():
    h = P.mix(np.arange(1000, dtype=np.uint64))
    head = pickle.loads(pickle.dumps(_head(h[:700])))
    asked = np.concatenate([h[::-1], h])
    assert head.codes(asked).tolist() == [k if k < 700 else -1 for k in [*range(999, -1, -1), *range(1000)]]
    assert P.Head(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0), 0.1).codes(h[:3]).tolist() == [-1, -1, -1]
