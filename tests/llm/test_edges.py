"""Nulls, blanks, long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stintflow.llm import decontaminate, gif, packing, pii, pitman_yor, quotes, resample, simhash, substrings, toxicity

DOCS = "doc_id long, text string, key string, id string, n int, fp long, word string, target boolean, body string"
LONG = " ".join(f"w{k % 977}" for k in range(30_000))
ROWS = [(1, "the quick brown fox jumps over the lazy dog and runs far away from it all", "k", "i", 1, 2, "w", True, "b"), (1, "the quick brown fox jumps over the lazy dog and runs far away from it all", "k", "i", 1, 2, "w", True, "b"), (2, None, None, None, None, None, None, None, None), (3, "", "k", "", 0, 0, "", False, ""), (None, "some text here", "k", "i", 1, 2, "w", True, "b"), (4, LONG, "k", "i", 1, 2, "w", True, "b"), (5, " \t\n ", "k", "i", 1, 2, "w", True, "b")]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (3, None, 1), (1, 1, 0)], LABELS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "brown fox jumps over the lazy dog and runs"), (2, None), (3, ""), (4, "x")], "item_id long, text string")


def test_decontaminate(spark, docs, none, bench):
    got = decontaminate.leaks(docs, bench).collect()
    assert [(r.id, r.item_id) for r in got] == [(1, 1), (1, 1)] and got[0].score == 1.0
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(docs, bench.filter("false")).count() == 0
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 5


def test_substrings(spark, docs, none):
    got = substrings.dedup_substrings(spark, docs).collect()
    assert sorted((r.id is None, r.id or 0, r.n_words, r.n_removed) for r in got) == [(False, 1, 16, 0), (False, 1, 16, 0), (False, 2, 0, 0), (False, 3, 0, 0), (False, 4, 30_000, 0), (False, 5, 0, 0), (True, 0, 3, 0)]
    assert substrings.dedup_substrings(spark, none).count() == 0
    more = docs.unionByName(docs.filter("doc_id = 1").limit(1).withColumn("doc_id", F.lit(9).cast("long")))
    assert [r.n_removed for r in substrings.dedup_substrings(spark, more).filter("id = 9").collect()] == [16]


def test_gif(spark, docs, none):
    got = {r.doc_id: r for r in gif.digests(gif.store_texts(docs)).collect()}
    assert got[2].payload_bytes == got[3].payload_bytes == 576 and got[2].payload_sha256 == got[3].payload_sha256 and got[2].n_bytes == 0
    assert got[4].payload_bytes % 576 == 0 and got[4].n_bytes == len(LONG)
    assert gif.digests(gif.store_texts(none)).count() == 0
    assert gif.timed_frames(spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "id long, gif binary")).count() == 0


def test_pii(spark, docs, none):
    assert pii.pseudonymise(docs, "k").exceptAll(docs).count() == 0 and pii.pseudonymise(docs, "k").columns == docs.columns
    assert pii.pseudonymise(none, "k", kinds_col="kinds").count() == 0


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(spark, docs).collect()
    assert len(got) == 7
    by = {(r.id, r.fp): r.component_id for r in got}
    assert by[(3, 0)] == 2 and by[(2, 0)] == 2 and by[(5, 0)] == 2
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 4), (True, 0)]
    assert simhash.near_duplicates(spark, none).count() == 0 and simhash.keep_one(spark, none).count() == 0


def test_resample(spark, docs, none, labels):
    w = resample.weights(docs, labels)
    assert w.count() == 7 and {r.n_features for r in w.filter("id in (2, 3, 5)").collect()} == {0}
    for k in range(8):
        assert resample.gumbel_top_k(spark, w, k).filter("selected").count() in (k, k + 1)  # rows of one id tie
    assert resample.gumbel_top_k(spark, resample.weights(none, labels)).count() == 0
    assert resample.gumbel_top_k(spark, resample.weights(docs, labels.filter("false"))).count() == 7


def test_packing(spark, docs, none):
    got = packing.pack_documents(spark, docs).collect()
    assert sum(r.doc_id == 1 for r in got) == 2 and {r.length for r in got if r.doc_id in (2, 3, 5)} == {1}
    assert packing.pack_documents(spark, none).count() == 0


def test_quotes(spark):
    t = "conv_id long, turn long, role string, text string, lines string, unit long"
    df = spark.createDataFrame([(1, 0, "user", "Hello.", "x", 1), (1, 0, "user", "Hello.", "x", 1), (1, None, "user", "> Hello.", "x", 1), (None, 1, None, None, None, None), (1, 2, "user", "> Hello.\n" + "long line\n" * 3000, "x", 1)], t)
    got = quotes.link_quotes(spark, df).collect()
    assert len(got) == 5 and [r.reply_to for r in got if r.turn == 2] == [0]
    assert quotes.link_quotes(spark, df.filter("false")).count() == 0


def test_language_model(spark, docs, none):
    got = pitman_yor.model_scores(spark, docs).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 4, 17, 17, 30_001]
    assert all(r.score < 0 for r in got)
    assert pitman_yor.model_scores(spark, none).count() == 0


def test_toxicity(spark, docs, none, labels):
    assert toxicity.toxicity(spark, docs, labels).count() == 7
    untouched = toxicity.without_toxic(spark, docs.withColumn("p_toxic", F.lit(1.0)), labels.filter("false"))
    assert untouched.count() == 7
    assert toxicity.toxicity(spark, none, labels).count() == 0
