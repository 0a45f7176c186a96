"""Scored laps, cluster profiles, observed levels and importances."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stintflow.operators import documents as D
from stintflow.operators import laps as L
from stintflow.operators import metrics as M
from stintflow.operators import ml
from stintflow.plans import registry


def test_scored_laps(spark, sf):
    got = registry.QUERIES["scored_laps"](spark, sf)
    assert {"target", "p_even", "p_late", "blend", "probability_cliff"} <= set(got.columns)
    rows = got.collect()
    assert rows and all(min(r.p_even, r.p_late) - 1e-4 <= r.blend <= max(r.p_even, r.p_late) + 1e-4 and 0 <= r.probability_cliff <= 1 for r in rows)


def test_cluster_profiles(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0), (1, 7.0)], "cluster int, x double")
    got = {r.cluster: (r.n, r.share, r.x_mean, round(r.x_z, 3)) for r in ml.cluster_profiles(df, "cluster", ["x"]).collect()}
    assert got == {0: (2, 0.5, 2.0, -0.775), 1: (2, 0.5, 6.0, 0.775)}


def test_importances_add_up(spark):
    class Model:
        class featureImportances:
            toArray = staticmethod(lambda: [0.25, 0.0, 0.75])

    got = ml.importances(spark, ["a", "b", "c"], Model).collect()
    assert [(r.feature, r.cumulative, r.unused, r.bottom_decile) for r in got] == [("c", 0.75, False, False), ("a", 1.0, False, False), ("b", 1.0, True, True)]


def test_observed_levels_are_bounded(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "x string")
    assert M.one_hot(df, "x").columns == ["x", "x_a", "x_b"] and M.one_hot(df, "x").agg(F.sum("x_a")).first()[0] == 1
    with pytest.raises(ValueError):
        M.one_hot(df, "x", most=1)


def test_sector_and_rate_guards(spark):
    df = spark.createDataFrame([(30.0, 25.0, None), (30.0, 60.0, 95.0)], "a double, b double, c double")
    assert [(r.s2, r.s3) for r in L.sector_times(df, ["a", "b", "c"], ["s1", "s2", "s3"]).collect()] == [(None, None), (30.0, 35.0)]
    one = spark.sql("SELECT 1 AS k, TIMESTAMP '2024-01-01 00:00:00' AS ts")
    assert L.sample_rate(one, ["k"], "ts").first().rate_hz is None


def test_unwound_counts(spark):
    df = spark.sql("SELECT array(named_struct('c', 'a', 'n', 1), named_struct('c', 'a', 'n', 5)) AS xs UNION ALL SELECT array(named_struct('c', 'a', 'n', 7), named_struct('c', 'b', 'n', 9)) UNION ALL SELECT null")
    assert sorted(tuple(r) for r in D.unwound_counts(df, "xs", lambda x: x["n"] > 2, ["c"]).collect()) == [("a", 2, 2), ("b", 1, 1)]
