"""The filter audit against direct filtering in every order."""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pytest

from stintflow.llm import audit

SCHEMA = "doc_id long, text string, source string, mask int, n long, good boolean, digest string"


def plain(docs, labels):
    """Every row of the audit by removing rows filter by filter."""
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    rows = []
    for i, t, s in docs:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in docs)
        rows.append((s or "", i, {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": smaller}))
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if r[2][f]]
                left = [r for r in left if not r[2][f]]
                fails = sum(r[2][f] for r in own)
                only = sum(r[2][f] and sum(r[2].values()) == 1 for r in own)
                out[part, "".join(order), k + 1] = [len(left), len(gone), fails - len(gone), only, sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in audit.COUNTS) for r in df.collect()}


def test_audit_equals_filtering_in_every_order(spark):
    many = " ".join(f"w{k}" for k in range(60))
    texts = [many, many + " #", "one " * 60, "SHOUT " + many, "A" * 80, "", None, many, "one " * 60, " \t\n ", "x | y", many.upper(), " ".join(f"v{k % 1000}" for k in range(30_000)), "é\U0001f600 " * 55]
    docs = [(k if k % 5 else None, t, s) for k, (t, s) in enumerate(zip(texts * 3, ["a", "b", None, "", "c"] * 9, strict=False))] + [(1, many, "a"), (1, many, "a"), (2, many, "b")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (3, None, 1), (None, 1, 1), (6, 1, 1), (99, 1, 1), (7, 0, 0)]
    df = spark.createDataFrame([(i, t, s, 1, 2, True, "d") for i, t, s in docs], SCHEMA)
    out = audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got(out) == plain(docs, labels)
    assert audit.audit(df.filter("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_partitions_do_not_matter(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    assert got(audit.audit(docs, labels)) == got(audit.audit(docs.repartition(7, "n_chars"), labels.repartition(3)))


@pytest.mark.parametrize("filters", [1, 3, 5, 7])
def test_gray_code_walk_equals_sums_over_masks(filters):
    cell = np.random.default_rng(filters).integers(0, 50, (3, 1 << filters, 2))
    state = audit.survivors(cell)
    for subset in range(1 << filters):
        assert (state[:, subset] == cell[:, [m for m in range(1 << filters) if not m & subset]].sum(axis=1)).all()
