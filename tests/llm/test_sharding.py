"""The keyed permutation, row numbers, shards and slots against plain versions."""

from __future__ import annotations

import math
import zlib
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from stintflow.llm import sharding


def walked(x, n, key=sharding.KEY):
    """The place of a number by the rule of the module, in plain integers."""
    a = max(1, math.ceil(math.sqrt(max(n, 1))))
    b = max(1, -(-n // a))
    while True:
        l, r = divmod(x, b)
        for i in range(sharding.ROUNDS):
            noise = int(md5(f"{key}|{i}|{r if i % 2 == 0 else l}".encode()).hexdigest()[:12], 16)
            l, r = ((l + noise) % a, r) if i % 2 == 0 else (l, (r + noise) % b)
        x = l * b + r
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 8, 10, 63, 64, 65, 1000, 1025])
def test_permutation_is_one_to_one_and_has_an_inverse(spark, n):
    df = spark.range(n).withColumn("p", sharding.permuted(F.col("id"), n)).withColumn("back", sharding.permuted(F.col("p"), n, back=True))
    rows = df.collect()
    assert sorted(r.p for r in rows) == list(range(n))
    assert all(r.back == r.id and r.p == walked(r.id, n) for r in rows)


def test_grid_leaves_few_numbers_over():
    for n in [*range(1, 5000), 10**6 + 1, 10**12 + 7, 2**40 - 1]:
        a, b = sharding.grid(n)
        assert n <= a * b < n + a and (n > 4096 or a * b - n < sharding.WALK)


def test_large_numbers_walk_too(spark):
    n = 10**12 + 7
    some = spark.range(0, n, n // 50)
    rows = some.withColumn("p", sharding.permuted(F.col("id"), n)).withColumn("back", sharding.permuted(F.col("p"), n, back=True)).collect()
    assert all(r.back == r.id and r.p == walked(r.id, n) for r in rows)


def plain(docs):
    """(doc_id, size, crc, shard, slot) in the order of ids, nulls first; rows with one id in some order of their texts."""
    n = len(docs)
    return sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs), sorted((walked(k, n) % 8, walked(k, n) // 8) for k in range(n))


def test_query_equals_the_plain_version(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in sharding.op13_shards(spark, sf).collect()}
    assert len(got) == len(docs) == len({d for d, _ in docs})
    for k, (d, t) in enumerate(sorted(docs)):
        r, p = got[d], walked(k, len(docs))
        assert (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", p % 8, p // 8, None)


def test_place_tells_the_row_number(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    out = sharding.sharded(spark, docs)
    n = docs.count()
    assert out.filter(sharding.number_at(F.col("shard"), F.col("slot"), 8, n) != F.col("row_number")).count() == 0


def test_partitions_and_order_do_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = {tuple(r) for r in sharding.sharded(spark, docs).collect()}
    mixed = docs.repartition(13, "text").sortWithinPartitions(F.desc("doc_id"))
    assert {tuple(r) for r in sharding.sharded(spark, mixed).collect()} == want
    other = {tuple(r) for r in sharding.sharded(spark, docs, key="shuffle-2").collect()}
    assert other != want


def test_nulls_repeats_long_texts_clashes_and_empty_tables(spark):
    rows = [(1, "a", 3, 4), (1, "a", 3, 4), (1, "b", None, None), (None, None, 1, 1), (None, "x", 1, 1), (2, "", 1, 1), (3, "z" * 300_000, 1, 1)] + [(7, "same", 5, 5)] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, row_hash long")
    out = sharding.sharded(spark, df)
    assert out.columns == ["doc_id", "text", "shard", "row_hash", "row_number", "shard_", "slot"]
    got = out.collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.shard, r.row_hash) for r in got))) == sorted(map(str, rows))
    assert sorted(r.row_number for r in got) == list(range(len(rows)))
    assert sorted((r.shard_, r.slot) for r in got) == plain([r[:2] for r in rows if r[0] is not None] + [(0, "")] * 2)[1]
    assert {r.row_number for r in got if r.doc_id is None} == {0, 1} and {r.row_number for r in got if r.doc_id == 1} == {2, 3, 4}
    assert sharding.sharded(spark, df.filter("false")).count() == 0


def test_shards_are_written_in_slot_order(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    sharding.write_shards(sharding.sharded(spark, docs), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 8
    sizes = [r["count"] for r in back.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1
