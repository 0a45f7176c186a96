"""Small literal frames: hand-computed values, repartitioning and prefix invariance."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from stintflow.functions import scalars as S
from stintflow.operators import documents as D
from stintflow.operators import fits as T
from stintflow.operators import intervals as I
from stintflow.operators import labels as B
from stintflow.operators import laps as L
from stintflow.operators import metrics as M
from stintflow.operators import profile as P
from stintflow.operators import stints as W
from stintflow.operators import strategy as G

ST = W.Stint(("driver", "stint"), ("life",))


def stint(spark, paces, flags=None, driver="a"):
    rows = [(driver, 1, k + 1, k + 1, p, (flags or [0] * len(paces))[k]) for k, p in enumerate(paces)]
    return spark.createDataFrame(rows, "driver string, stint int, life int, lap int, pace double, flag int")


def test_normalisers(spark):
    df = spark.createDataFrame([("12.5",), ("None",), ("",), ("garbage",), ("7",), ("7.9",), (None,), ("inf",), ("nan",)], "v string")
    got = df.select(S.as_double(F.col("v")).alias("d"), S.as_int(F.col("v")).alias("i")).collect()
    assert [r.d for r in got] == [12.5, None, None, None, 7.0, 7.9, None, None, None]
    assert [r.i for r in got] == [12, None, None, None, 7, 7, None, None, None]


def test_fuel_correction_and_session_types(spark):
    df = spark.createDataFrame([("Race", 1), ("Sprint Qualifying", 10), ("Practice 2", 10), ("Sprint", 10), ("Day 1", 3)], "s string, lap int")
    kind = S.session_type(F.col("s"))
    got = df.select(kind.alias("k"), F.round(S.fuel_corrected(F.lit(100.0), F.col("lap"), kind), 2).alias("p")).collect()
    assert [(r.k, r.p) for r in got] == [("Race", 100.03), ("Sprint", 100.3), ("Practice", 100.0), ("Sprint", 100.3), ("Testing", 100.0)]


def test_control_messages(spark):
    rows = [("SafetyCar", None, True), ("Other", "SAFETY CAR DEPLOYED", True), ("Other", "VSC DEPLOYED", True), ("Other", "SAFETY CAR INFRINGEMENT NOTED", False), ("Other", "VSC TEST", False), ("Other", None, False), (None, "safety car in this lap", True)]
    df = spark.createDataFrame(rows, "cat string, msg string, want boolean")
    assert all(r.got == r.want for r in df.select("want", S.control_period(F.col("cat"), F.col("msg")).alias("got")).collect())


def test_plan_strings(spark):
    df = spark.createDataFrame([("SOFT->18,MEDIUM->end", True), ("SOFT->18,MEDIUM->10", False), ("HARD->end", False), ("SOFT->end", True), ("SOFT->18,PINK->end", False)], "p string, ok boolean")
    s = S.parse_plan(F.col("p"))
    got = df.select("ok", S.plan_is_valid(s, F.lit("SOFT"), F.lit(50), ["SOFT", "MEDIUM", "HARD"]).alias("v"), S.format_plan(s, F.lit(50)).alias("f")).collect()
    assert all(r.ok == r.v for r in got) and got[0].f == "SOFT->18 | MEDIUM->end"


def test_lap_statistics_with_nulls(spark):
    df = spark.createDataFrame([(1, 250.0, 10.0, 0.0, 0.0, 5.0, 1.0), (1, 260.0, None, 1.0, 8.0, None, 9.0)], "lap int, speed double, throttle double, brake double, drs double, gap double, distance double")
    r = L.lap_statistics(df, ["lap"]).first()
    assert (r.n_samples, r.speed_mean, r.throttle_share, r.brake_share, r.near_share, r.distance_max) == (2, 255.0, 0.5, 0.5, 0.5, 9.0)


def test_merged_partials_equal_direct(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 3), rng.randint(0, 4), None if rng.random() < 0.4 else rng.uniform(1e6, 1e6 + 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "lap int, batch int, x double")
    merged = L.finalise_partials(L.merge_partials(L.partials(df, ["lap"], F.col("batch"), ["x"]), ["lap"], ["x"]), ["lap"], ["x"])
    direct = df.groupBy("lap").agg(F.count("*").alias("n_samples"), F.avg("x").alias("x_mean"), F.stddev_samp("x").alias("x_std"), F.min("x").alias("x_min"), F.max("x").alias("x_max"))
    assert {r.differs + r.null_differs + r.only_a + r.only_b for r in P.reconcile(direct, merged, ["lap"], 1e-7).collect()} == {0}


def test_rising_edges(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([None, 1.0, 1.0, 0.0, 2.0, None, 3.0])], "lap int, t int, x double")
    assert [r.x_on for r in L.rising_edges(df, ["lap"], ["t"], ["x"]).orderBy("t").collect()] == [0, 1, 0, 0, 1, 0, 1]


def test_baseline_skips_the_opening_lap(spark):
    got = W.degradation(stint(spark, [105.0, 100.0, 103.0, None, 101.0]), ST, "pace").orderBy("life").collect()
    assert [r.delta_start for r in got] == [0.0, 0.0, 3.0, None, 1.0] and [r.cliff_count for r in got] == [0, 0, 1, 1, 1]


def test_features_of_a_prefix_are_a_prefix_of_the_features(spark):
    rng = random.Random(5)
    paces = [90 + rng.random() for _ in range(20)]
    flags = [int(k in (6, 7)) for k in range(20)]
    whole = W.green_features(stint(spark, paces, flags), ST, "pace", "flag").orderBy("life").collect()
    part = W.green_features(stint(spark, paces[:12], flags[:12]), ST, "pace", "flag").orderBy("life").collect()
    assert part == whole[:12]
    assert whole[6].roll_mean == whole[5].roll_mean == whole[7].roll_mean


def test_onset_needs_sustained_green_laps(spark):
    paces = [100.0, 90.0, 90.0, 90.0, 95.0, 95.0, 95.0, 95.0]
    r = B.remaining_life(stint(spark, paces), ST, "pace", "life", "flag", "driver", {"a": 3}).orderBy("life").collect()
    assert {x.onset for x in r} == {6} and [x.target_life for x in r] == [3, 3, 3, 2, 1, 0, 0, 0]
    flagged = B.onset(stint(spark, paces, [0, 0, 0, 0, 1, 1, 1, 1]), ST, "pace", "life", "flag").first()
    assert flagged.onset is None


def test_alert_rules(spark):
    s = stint(spark, [0.9, 0.9, 0.1, 0.9, 0.9, 0.9]).withColumn("life_left", F.when(F.col("lap") < 4, 20.0).otherwise(10.0))
    r = W.alerts(s, ST, "pace", "life_left", "lap", 0.5).first()
    assert (r.anomaly, r.trigger, r.imminent) == (2, 5, None)


def test_carry_over_fold(spark):
    df = spark.createDataFrame([("g", 1, 0.6, 10.0, False), ("g", 2, 1.0, 20.0, True), ("g", 3, 1.5, 5.0, False)], "g string, o int, w double, v double, wet boolean")
    got = [r.prior for r in W.carry_over(df, ["g"], "o", "w", "v", "wet").orderBy("o").collect()]
    assert got == pytest.approx([0.0, 6.0, 6.0 * 0.3 + 20 * 0.5])


def test_interval_matching(spark):
    e = spark.createDataFrame([("s", 1, 3, True), ("s", 2, 5, False), ("s", 3, 9, True), ("t", 1, 4, False)], "k string, rank int, lap int, start boolean")
    got = {(r.k, r.start_lap, r.end_lap) for r in I.match_periods(e.filter("start"), e.filter("not start"), ["k"]).collect()}
    assert got == {("s", 3, 5), ("s", 9, 9)}
    again = {(r.k, r.start_lap, r.end_lap) for r in I.match_rising(e, ["k"], F.col("start"), ~F.col("start"), ["rank"]).collect()}
    assert again == got


def test_slope_keeps_two_populations(spark):
    df = stint(spark, [90 + 0.2 * k for k in range(8)], [0] * 7 + [1])
    r = T.stint_slopes(df, ["driver", "stint"], "life", "lap", "pace", "flag").first()
    assert r.n == 4 and math.isclose(r.slope, 0.2, rel_tol=1e-9)
    holes = df.withColumn("pace", F.when(F.col("life") != 4, F.col("pace")))
    assert T.stint_slopes(holes, ["driver", "stint"], "life", "lap", "pace", "flag").first().slope < 0.2


def test_latest_before(spark):
    f = spark.createDataFrame([("a", 1, 10.0), ("a", 5, 50.0)], "k string, t int, v double")
    q = spark.createDataFrame([("a", 4), ("a", 5), ("a", 0), ("b", 9)], "k string, at int")
    got = {(r.k, r.at): r.latest_v for r in I.latest_before(q, f, ["k"], "at", "t", ["v"]).collect()}
    assert got == {("a", 4): 10.0, ("a", 5): 50.0, ("a", 0): None, ("b", 9): None}


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([("1", "a", 1.0), ("2", "b", 2.0)], "_id string, n string, v double")
    s = spark.createDataFrame([("2", 3.0), ("3", 4.0)], "_id string, v double")
    once = D.upsert(t, s)
    assert tuple(D.upsert_counts(once).first()) == (1, 1, 1)
    twice = D.upsert(once.drop("__state"), s)
    assert tuple(D.upsert_counts(twice).first()) == (2, 0, 0)
    assert P.multiset_difference(once.drop("__state"), twice.drop("__state")).first() == (0, 0)
    with pytest.raises(ValueError):
        D.prune(t, s, scoped=True)


def test_pages_cover_all_rows(spark):
    df = spark.range(23).withColumn("v", F.col("id") % 5)
    seen = [r.id for n in (1, 2, 3) for r in D.page(df, [F.col("v")], n, 10, "id").collect()]
    assert sorted(seen) == list(range(23))
    with pytest.raises(ValueError):
        D.page(df, [F.col("v")], 0, 10, "id")


def test_unique_right_side(spark):
    r = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="not unique"):
        P.checked_many_to_one(r, ["k"]).collect()


def test_quality(spark):
    assert P.drift(spark.range(1), {"id": "bigint", "x": "string"}) == [("x", "missing", "string")]
    assert P.leaking_columns(["pace", "onset", "onset_near"], {"onset"}) == ["onset", "onset_near"]
    a = P.content_hash(spark.range(100).repartition(7)).first()
    assert a == P.content_hash(spark.range(100).coalesce(1)).first()
    with pytest.raises(ValueError):
        P.require(spark.range(2), ["id"], 3)


def test_cost_closed_form_equals_loop(spark):
    rng = random.Random(7)
    rows = [(rng.uniform(80, 100), rng.uniform(0, 1), rng.uniform(0, 0.2), rng.randint(0, 40), rng.uniform(-5, 50)) for _ in range(60)]
    df = spark.createDataFrame(rows, "base double, pen double, beta double, n int, cliff double")
    got = [r.c for r in df.select(G.stint_cost(*[F.col(c) for c in ("base", "pen", "beta", "n", "cliff")]).alias("c")).collect()]
    for (b, p, be, n, c), g in zip(rows, got, strict=True):
        m = max(n - max(c, 0), 0)
        assert g == pytest.approx(sum(b + p + be * k for k in range(1, n + 1)) + 1.5 * m + 0.15 * m * (m + 1) / 2)


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(50)
    u = S.keyed_uniform(F.lit("k"), F.col("id"))
    assert sorted(df.repartition(7).select(u).collect()) == sorted(df.coalesce(1).select(u).collect())
    assert 0 < df.agg(F.min(u)).first()[0] and df.agg(F.max(u)).first()[0] < 1


def test_candidates_follow_the_two_compound_rule(spark):
    s = spark.createDataFrame([("a", 10, 30, "S", ["S"], False), ("b", 28, 30, "S", ["S"], False), ("w", 10, 30, "S", ["S"], True)], "driver string, cur_lap int, n_laps int, compound string, used array<string>, wet boolean")
    plans = G.listed(G.candidates(s, F.array(F.lit("S"), F.lit("M"))), ["driver"]).collect()
    by = {d: [p for p in plans if p.driver == d] for d in "abw"}
    assert all(len({x.compound for x in p.plan}) == 2 for p in by["a"])
    assert [len(p.plan) for p in by["b"]] == [1]
    assert any(p.stops == 0 for p in by["w"]) and len(by["w"]) > len(by["a"])


def test_metrics(spark):
    df = spark.createDataFrame([(5.0, 6.0), (20.0, 15.0), (None, 1.0), (1.0, float("nan"))], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert (r.n, r.mae, r.mae_critical) == (2, 3.0, 1.0)
    assert r.score == pytest.approx(math.exp(1 / 5) - 1 + math.exp(5 / 10) - 1)
    perfect = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.8), (0, 0.2)], "y int, p double")
    assert M.roc_auc(perfect, "y", "p").first().auc == 1.0
    assert M.classification_metrics(perfect, "y", "p", 0.5).first().f1 == 1.0


def test_standardisation_uses_train_only(spark):
    df = spark.createDataFrame([("train", 10.0), ("train", 30.0), ("test", 1000.0), ("train", None)], "fold string, x double")
    got = {(r.fold, r.x): r.z_x for r in M.standardised(df, ["x"]).collect()}
    assert got[("train", 10.0)] == pytest.approx((10 - 40 / 3) / 15.275252)


@pytest.mark.parametrize("n", [1, 7])
def test_results_do_not_depend_on_partitions(spark, sf, n):
    from stintflow.plans.roles import STINT, laps

    df = laps(spark, sf)
    key = lambda d: d.select(F.sum(F.xxhash64(*d.columns).cast("decimal(38,0)"))).first()
    f = lambda d: W.pace_features(d, STINT, "pace").select("driver", "season", "stint", "life", "best_so_far", "roll_range")
    assert key(f(df.repartition(n))) == key(f(df))
