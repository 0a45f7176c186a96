"""Nested coercion, layouts, observed counts and conservation on small planted cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stintflow.operators import profile as P
from stintflow.operators.keyed import conservation
from stintflow.sources import sinks as K


def test_nested_values_are_cast_in_place_and_counted_by_path(spark):
    rows = [(("7.9", [{"t": "1.5", "c": "SOFT"}, {"t": "None", "c": ""}], [["1", "x"], None]), 1), ((None, None, []), 2), (None, 3), (("inf", [{"t": None, "c": None}], [[]]), 4)]
    df = spark.createDataFrame(rows, "doc struct<lap:string, laps:array<struct<t:string, c:string>>, grid:array<array<string>>>, id long")
    cast, counts = P.coerce_nested(df, {"doc.lap": "int", "doc.laps.t": "double", "doc.laps.c": "string", "doc.grid": "double", "id": "int"})
    got = {r.id: r.doc for r in cast.collect()}
    assert got[1].lap == 7 and [(x.t, x.c) for x in got[1].laps] == [(1.5, "SOFT"), (None, None)]
    assert got[3] is None and got[4].lap is None and cast.schema["id"].dataType.simpleString() == "int"
    n = {(r.path, r.kind): r.n for r in counts.collect()}
    assert n == {("doc.lap", "string_to_int"): 1, ("doc.lap", "nonfinite_to_null"): 1, ("doc.laps.t", "string_to_double"): 1, ("doc.laps.t", "null_token"): 1, ("doc.laps.c", "kept"): 1, ("doc.laps.c", "null_token"): 1, ("doc.grid", "string_to_double"): 1, ("doc.grid", "lost"): 1, ("id", "bigint_to_int"): 4}
    with pytest.raises(ValueError):
        P.coerce_nested(df, {"doc.lap.x": "int"})


def test_range_buckets_are_bounded(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("k"))
    got = {(r.layout, r.bucket): r.n_rows for r in P.bucket_sizes(df, "k", 8).collect()}
    sizes = [n for (layout, _), n in got.items() if layout == "range"]
    assert sum(sizes) == 1000 and max(sizes) <= 1000 / 8 + 300 and got["single", 0] == 1000
    even = [r.n_rows for r in P.bucket_sizes(spark.range(1000).withColumnRenamed("id", "k"), "k", 8).filter("layout = 'range'").collect()]
    assert len(even) == 8 and max(even) <= 126


def test_step_counts_come_from_the_run_itself(spark):
    calls = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    steps = K.StepCounts()
    df = steps.watch("read", spark.range(100).mapInArrow(once, "id long"))
    df = steps.watch("kept", df.filter("id % 3 = 0").withColumn("x", F.lit(1)))
    df.write.format("noop").mode("overwrite").save()
    assert steps.rows() == [("read", 100, 1), ("kept", 34, 2)] and calls.value == 100


def test_a_key_in_two_partitions_is_found(spark):
    before = spark.range(40).select((F.col("id") % 4).alias("k"))
    whole = before.repartition(4, "k").groupBy("k").agg(F.count("*").alias("n"))
    r = conservation(before, whole, ["k"], "n").first()
    assert (r.emitted, r.received, r.keys_in_several_rows, r.keys_in_several_partitions) == (40, 40, 0, 0)
    parts = spark.range(0, 8, 1, 2).select((F.col("id") % 4).alias("k"), F.lit(5).cast("long").alias("n"))
    r = conservation(before, parts, ["k"], "n").first()
    assert (r.received, r.keys_in_several_rows, r.keys_in_several_partitions) == (40, 4, 4)
