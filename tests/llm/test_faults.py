"""Cases that once went wrong: reserved names, text ids, repeated ids, odd letters, large screens, passwords."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintflow.llm import decontaminate, gif, packing, pii, resample, simhash, substrings, toxicity
from stintflow.llm.common import fold, remove_folded

TEXT = "one two three four five six seven eight nine ten eleven twelve"


def test_names_of_columns_never_clash(spark):
    df = spark.createDataFrame([(1, f"{TEXT} call 555-123-4567", "a", "b", "c", "d", 0.5)], "doc_id long, text string, found string, replaced string, row_hash string, old_length string, p_toxic double")
    got = pii.pseudonymise(df, "k").first()
    assert got.asDict() | {"text": ""} == df.first().asDict() | {"text": ""} and got.text != df.first().text
    assert simhash.keep_one(spark, df).collect() == df.collect()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.without_toxic(spark, df, labels).collect() == df.collect()
    chain = toxicity.fit_chain(spark, toxicity.labelled_sample(df, labels, toxicity.CATEGORIES, 10), toxicity.CATEGORIES)
    assert toxicity.score(df, chain).columns.count("p_toxic") == 1
    with pytest.raises(ValueError):
        pii.pseudonymise(df, "k", kinds_col="Found")


def test_map_columns_and_equal_rows(spark):
    df = spark.sql("SELECT 1L AS doc_id, 'a b c d e' AS text, map('x', 1, 'y', 2) AS m UNION ALL SELECT 1L, 'a b c d e', map('y', 2, 'x', 1) UNION ALL SELECT 2L, 'a b c d e', map('x', 1)")
    assert [r.doc_id for r in simhash.keep_one(spark, df).collect()] == [1]


def test_text_ids(spark):
    df = spark.createDataFrame([(f"d{k % 30}", float(k % 3), 1.0) for k in range(90)], "id string, key double, log_weight double")
    for k in (1, 7, 31, 60, 89):
        got = resample.gumbel_top_k(spark, df, k, bins=4, most=3)
        kept, left = got.filter("selected"), got.filter("not selected")
        assert kept.count() == k and kept.agg(F.min("key")).first()[0] >= left.agg(F.max("key")).first()[0]
    docs = spark.createDataFrame([("a", TEXT)], "doc_id string, text string")
    with pytest.raises(ValueError):
        substrings.dedup_substrings(spark, docs)
    bench = spark.sql("SELECT CAST('2024-01-01' AS DATE) AS item_id, 'three four five six seven' AS text")
    assert [str(r.item_id) for r in decontaminate.leaks(docs, bench).collect()] == ["2024-01-01"]


def test_exactly_k_of_one_id(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0)] * 30 + [(None, 0.5, 1.0)] * 5, "id long, key double, log_weight double")
    for k in (1, 7, 30, 33):
        got = resample.gumbel_top_k(spark, df, k, bins=4, most=3).filter("selected")
        assert got.count() == k and got.filter("id is null").count() == max(0, k - 30)


def test_items_come_in_blocks(spark):
    docs = spark.createDataFrame([(k, f"pad pad alpha{k} beta{k} gamma{k} delta{k} pad") for k in range(40)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k} delta{k}") for k in range(0, 40, 2)], "item_id long, text string")
    assert sorted((r.id, r.item_id) for r in decontaminate.leaks(docs, bench, block=3).collect()) == [(k, k) for k in range(0, 40, 2)]
    assert decontaminate.without_leaks(docs, bench, block=3).count() == 20


def test_letters_whose_lower_case_has_marks():
    from tokenizers import Tokenizer

    path = packing._default_tokenizer()
    own, tok = packing.ChunkTokenizer(path), Tokenizer.from_file(path)
    odd = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (len(chr(c).lower()) != 1 or len(chr(c).upper()) != 1)]
    rng, symbols = random.Random(3), [*"aAbİIıΣσςǅßŉÅÉ.,;!?$#*%&0９中ﬁ- \t", "̇", "́", *odd]
    texts = ["ANKARAİ, İ. x", *(f"{a}{c}{m}" for c in odd for a in ("", "a", "Σ") for m in packing._MARKS), *("".join(rng.choices(symbols, k=rng.randint(1, 14))) for _ in range(20_000))]
    want = tok.encode_batch(texts, add_special_tokens=False)
    assert [t for t, g, w in zip(texts, own.encode(texts), want, strict=True) if np.frombuffer(g, "<u4").tolist() != w.ids] == []


def test_full_pieces_and_split_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "_GROUP", 20)
    rows = [(k, 0, 0, 100 if k % 3 == 0 else 10 + k % 2, 0) for k in range(600)]
    got = packing.pack(spark, spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long"), packing.Limits(tokens=100)).collect()
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 100
    assert len(got) == 600 and len(places) <= 200 + 43


def test_oversized_screens_have_no_rows(spark):
    head = b"GIF89a" + struct.pack("<HHBBB", 65_535, 65_535, 0x80, 0, 0) + bytes(6)
    image = b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00;"
    df = spark.createDataFrame([(1, bytearray(head + image)), (2, None)], "id long, gif binary")
    assert gif.timed_frames(df).count() == 0


def test_passwords_keep_case_and_never_collide(spark):
    rng, symbols = random.Random(5), "abcABC0123456789xyzXYZdef"
    values = sorted({"Secret1", "secret1", "SECRET1", *("".join(rng.choices(symbols, k=6)) for _ in range(3000))})
    df = spark.createDataFrame([(v, f"password={v}") for v in values], "v string, text string")
    got = {r.v: r.text.removeprefix("password=") for r in pii.pseudonymise(df, "key").collect()}
    shape = lambda s: "".join("0" if c.isdigit() else "a" if c.islower() else "A" for c in s)
    assert len(set(got.values())) == len(values) and all(shape(a) == shape(b) for a, b in got.items())


def test_session_key(spark):
    spark.conf.unset(pii.KEY_CONF)
    first = pii.session_key(spark)
    assert len(first) == 32 and pii.session_key(spark) == first
    with pytest.raises(ValueError):
        pii.pseudonymise(spark.createDataFrame([], "text string"), "")


def test_folded_tables_can_be_removed(spark):
    kept = fold(spark, spark.range(5))
    path = kept.inputFiles()[0].removeprefix("file:")
    assert kept.count() == 5 and remove_folded(spark) > 0
    with pytest.raises(FileNotFoundError):
        open(path)
