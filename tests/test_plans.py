"""Plans, draws, control periods, costs and their evaluation against plain versions."""

from __future__ import annotations

import math
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintflow.operators import fits as T
from stintflow.operators import strategy as G

STATE = "driver string, cur_lap int, n_laps int, compound string, `into` int, base_pace double, in_cliff boolean, temp double, cluster int, used array<string>, wet boolean"
PAR = "compound string, beta double, sigma double, offset double, censor double, quantiles array<double>"
TYRES = [("A", 0.12, 0.05, -0.6, 0.2, [12.0, 14.0, 16.0]), ("N", 0.09, 0.03, 0.0, 0.3, [18.0, 20.0]), ("W", -0.2, 0.4, 3.0, 1.0, [20.0])]
POOL = ["A", "N", "W"]


def state(driver, cur, n, used=("N",), wet=False, into=5, cliff=False):
    return (driver, cur, n, "N", into, 90.0, cliff, 36.0, 1, list(used), wet)


def enumerated(s):
    """All legal plans of a state in order: one stop, two stops, none."""
    legal = lambda more: s.wet or len({*s.used, *more}) >= 2
    out = [[("N", p), (c, s.n)] for p in range(s.cur + 2, s.n - 2, 2) for c in POOL if legal([c])]
    out += [[("N", p), (a, q), (b, s.n)] for p in range(s.cur + 3, s.n - 10, 4) for q in range(p + 6, s.n - 2, 4) for a in POOL for b in POOL if legal([a, b])]
    return out + [[("N", s.n)]] if legal([]) or not out else out


def thinned(plans, most):
    return plans if len(plans) <= most else [plans[math.floor(j * ((len(plans) - 1) / (most - 1)))] for j in range(most)]


def planned(spark, states):
    plans = G.candidates(spark.createDataFrame(states, STATE), F.array(*[F.lit(x) for x in POOL]), 400)
    return G.with_parameters(plans, spark.createDataFrame(TYRES, PAR))


def test_candidates_equal_enumeration(spark):
    rng = random.Random(3)
    states = [state(f"d{k}", cur := rng.randint(0, 60), cur + rng.randint(0, 70), rng.choice([("N",), ("A", "N"), ()]), rng.random() < 0.3) for k in range(60)]
    got = {r.driver: [[(x.compound, x.end_lap) for x in p] for p in r.plans] for r in planned(spark, states).collect()}
    for s in states:
        want = enumerated(SimpleNamespace(cur=s[1], n=s[2], used=s[9], wet=s[10]))
        assert got[s[0]] == thinned(want, 400)
    assert max(map(len, got.values())) == 400 and min(map(len, got.values())) == 1


def test_candidates_of_a_very_long_race_are_arithmetic(spark):
    got = planned(spark, [state("d", 10, 200_000)]).select(F.size("plans").alias("n"), F.expr("plans[100]").alias("p"), F.expr("plans[399]").alias("last")).first()
    assert got.n == 400 and got.last[-1].end_lap == 200_000 and [x.end_lap for x in got.p] == sorted(x.end_lap for x in got.p)


def cost(s, plan, tyre, draw, jump=1.5, slope=0.15, window=None):
    """Seconds of a plan in one draw; tyre[compound, place]: slope and cliff."""
    k0, at, total = max(s.into - 1, 0), s.cur, 0.0
    offset = {t[0]: t[3] for t in TYRES}
    fresh = 90.0 - tyre["N", 0][0] * k0
    for i, (c, end) in enumerate(plan):
        n, (b, cliff) = max(end - at, 0), tyre[c, i]
        if i == 0:
            cliff = min(cliff - k0, -1) if s.cliff else cliff - k0
        at = end
        m = max(n - max(cliff, 0), 0)
        if n:
            total += n * (fresh + (offset[c] - offset["N"] if i else 0)) + b * n * (n + 1) / 2 + jump * m + slope * m * (m + 1) / 2 + (0 if i else b * k0 * n)
        if i < len(plan) - 1:
            total += 2 + (7 if window and window[0] <= end <= window[1] else 21)
    return total


@pytest.mark.parametrize("control", [False, True])
def test_costs_equal_a_loop_over_draws(spark, control):
    s = SimpleNamespace(cur=20, n=60, used=["N"], wet=True, into=6, cliff=control)
    df = planned(spark, [state("d", 20, 60, wet=True, into=6, cliff=control)])
    if control:
        df = G.with_control(df.withColumn("circuit", F.lit("x")), spark.createDataFrame([("x", k, 0.03) for k in range(1, 61)], "circuit string, lap int, hazard double"), spark.createDataFrame([(3,), (5,), (3,)], "laps int"), "circuit")
    got = {r.plan_id: r for r in G.ranked(G.costed(df, ["driver"], [], 40), ["driver"]).collect()}
    x = G.keyed_draws("s|d", 40, 3)
    by_lap = 1 - np.cumprod(np.full(60, 0.97))
    plans = thinned(enumerated(s), 400)
    means = []
    for k, plan in enumerate(plans):
        totals = []
        for d in range(40):
            tyre = {}
            for c, mu, sd, _, censor, qs in TYRES:
                for p in range(3):
                    b = min(max(mu + sd * x["z"][p, d], 0.005), min(max(mu, 0) * 4 + 0.15, 1.0))
                    tyre[c, p] = (b, 1e9 if x["u"][p, d] < censor else qs[int(x["q"][p, d] * len(qs))])
            begun = [i + 1 for i, y in enumerate(by_lap) if x["v"][d] < y]
            window = (begun[0], begun[0] + [3, 5][int(x["w"][d] * 2)] - 1) if control and begun else None
            totals.append(cost(s, plan, tyre, d, window=window))
        r = got[k + 1]
        assert (r.mean, r.std, r.p5, r.p95) == pytest.approx((np.mean(totals), np.std(totals), np.quantile(totals, 0.05), np.quantile(totals, 0.95)), abs=1e-6)
        means.append(np.mean(totals))
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1]["rank"])] == [k + 1 for k in sorted(range(len(plans)), key=lambda k: (round(means[k], 6), k))]


def test_expected_costs_equal_the_closed_form(spark):
    s = SimpleNamespace(cur=20, n=60, used=["N"], wet=True, into=6, cliff=False)
    scenarios = spark.createDataFrame([("clean", 1.0, 0.0, 21.0), ("slow", 1.0, 0.5, 21.0)], "scenario string, beta_mult double, penalty double, pit_loss double")
    got = {(r.scenario, r.plan_id): r.cost for r in G.expected_costs(planned(spark, [state("d", 20, 60, wet=True, into=6)]), ["driver"], scenarios).collect()}
    middle = {t[0]: (t[1], 1e9 if t[4] > 0.5 else t[5][(len(t[5]) - 1) // 2]) for t in TYRES}
    tyre = {(c, p): v for c, v in middle.items() for p in range(3)}
    for k, plan in enumerate(thinned(enumerated(s), 400)):
        assert got["clean", k + 1] == pytest.approx(cost(s, plan, tyre, 0), abs=1e-6)
        assert got["slow", k + 1] - got["clean", k + 1] == pytest.approx(0.5 * 40, abs=1e-6)


def test_a_plan_gains_nothing_over_itself(spark):
    df = planned(spark, [state("d", 20, 60)]).withColumn("plans", F.array(F.col("plans")[7], F.col("plans")[7])).withColumns({"rival": F.lit(1)})
    r = G.gains(G.costed(df, ["driver"], ["rival"]), ["driver"]).first()
    assert (r.gain, r.gain_low, r.gain_high, r.win_share) == (0.0, 0.0, 0.0, 0.0) and r.actual_mean == r.best_mean


def test_control_periods_begin_by_the_hazards(spark):
    hazard = {1: 0.1, 2: 0.2, 4: 0.5}
    rows = spark.createDataFrame([("x", k, h) for k, h in hazard.items()], "circuit string, lap int, hazard double")
    by_lap = np.array(G.onset_distributions(rows, "circuit").first().onset_by)
    v = np.concatenate([G.keyed_draws(f"k{i}", 250, 1)["v"] for i in range(80)])
    w = np.concatenate([G.keyed_draws(f"k{i}", 250, 1)["w"] for i in range(80)])
    first, last = G.control_window(v, w, by_lap, np.array([2, 3]))
    green = 1.0
    for lap in range(1, 5):
        h = hazard.get(lap, 0.0)
        assert (first == lap).sum() / max((first >= lap).sum(), 1) == pytest.approx(h, abs=4 * math.sqrt(0.25 / (20_000 * green)))
        green *= 1 - h
    assert np.isinf(first).mean() == pytest.approx(green, abs=0.015)
    assert set(last[np.isfinite(first)] - first[np.isfinite(first)]) == {1.0, 2.0}


def test_planted_drift_is_found_again(spark):
    rng = random.Random(1)
    rows = [(rng.gauss(4, 0.5) - 0.03 * w, w, 10 + k % 20, k % 50, "A") for k in range(400) for w in [rng.uniform(50, 900)]]
    df = spark.createDataFrame(rows, "residual double, weight double, length int, start_lap int, compound string")
    grid = G.drift_grid(df, [k / 100 for k in range(-8, 9)])
    r = G.best_drift(grid).first()
    assert r.drift == pytest.approx(0.03)
    b = {(x.dimension, x.bucket): x for x in G.residual_buckets(df, G.best_drift(grid)).collect()}
    assert abs(b["compound", "A"].after - 4) < 0.1 < abs(b["compound", "A"].before - 4)
    assert sum(x.n for (d, _), x in b.items() if d == "start") == 400


def test_decision_state_at_a_pit_entry_lap(spark):
    laps = [("a", lap, 1 if lap <= 6 else 2, lap if lap <= 6 else lap - 6, pace, above, "N" if lap <= 6 else "A", 30.0 + lap, 3, 0) for lap, pace, above in [(1, 95.0, 0.0), (2, 90.0, 0.0), (3, 90.5, 0.5), (4, None, None), (5, 92.5, 2.5), (6, 110.0, 20.0), (7, 100.0, 0.0), (8, 89.0, 0.0)]]
    laps += [("b", k, 1, k, 80.0 + k, 0.0, "W", None, None, 1) for k in range(1, 4)] + [("c", k, 1, k, None, None, None, 40.0, 1, None) for k in range(1, 4)]
    df = spark.createDataFrame(laps, "driver string, lap int, stint int, life int, pace double, above double, compound string, temp double, cluster int, rain int")
    at = lambda rows: {(r.driver, r.cur_lap): r for r in G.decision_state(df, spark.createDataFrame(rows, "driver string, cur_lap int, n_laps int"), ["driver"], "lap", "stint", "life", "pace", "above", "compound", "temp", "cluster", "rain", ["W"]).collect()}
    got = at([("a", 6, 8), ("b", 3, 3), ("c", 2, 3), ("z", 1, 1)])
    a, b, c = got["a", 6], got["b", 3], got["c", 2]
    assert (a.base_pace, a.in_cliff, a.into, a.compound, a.used, a.wet, a.temp) == (92.5, True, 6, "N", ["N"], False, 36.0)  # the lap before the stop
    assert (b.base_pace, b.in_cliff, b.wet, b.temp, b.cluster) == (83.0, False, True, 36.0, None)  # the last lap of the race is no pit entry
    assert (c.base_pace, c.into, c.used, c.wet) == (None, 2, [], False)
    assert len(got) == 3
    a = at([("a", 4, 8)])["a", 4]
    assert (a.base_pace, a.in_cliff, a.into) == (90.5, False, 4)  # an unknown pace falls back to the last known


@pytest.mark.parametrize("n", [1, 2, 7, 2500, 2501, 20_000])
def test_exact_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    x = np.concatenate([rng.normal(size=n - n // 3), np.full(n // 3, 0.25)])
    rng.shuffle(x)
    qs = [0.0, 0.05, 0.1, 0.5, 0.75, 0.999, 1.0]
    df = spark.createDataFrame([("k", float(v)) for v in x] + [("k", None), ("k", float("nan")), ("e", None), (None, 1.0)], "k string, v double").repartition(5)
    got = {r.k: r for r in T.exact_quantiles(df, ["k"], "v", qs, [0.25, 0.4]).collect()}
    assert set(got) == {"k"} and got["k"].n == n
    assert got["k"].quantiles == pytest.approx(np.quantile(x, qs).tolist())
    assert got["k"].nearest == [sorted(x)[math.floor((n - 1) * q + 0.5)] for q in (0.25, 0.4)]
    whole = T.exact_quantiles(df.filter("k = 'k'"), [], "v", qs).first()
    assert whole.quantiles == pytest.approx(np.quantile(x, qs).tolist())
    assert T.exact_quantiles(df.filter("false"), [], "v", qs).count() == 0


def test_small_categories_have_the_spread_of_all(spark):
    rows = [("A", k / 100) for k in range(20)] + [("R", 5.0), ("R", 7.0)]
    got = {r.c: r for r in T.category_slopes(spark.createDataFrame(rows, "c string, slope double"), "c").collect()}
    every = np.array([v for _, v in rows])
    assert (got["R"].beta, got["R"].sigma) == pytest.approx((np.median(every), every.std(ddof=1)))
    assert got["A"].beta == pytest.approx(0.095)


def test_ablation_without_cliffs_changes_only_plans_with_cliffs(spark):
    df = planned(spark, [state(f"d{k}", 10 + k, 60 + k) for k in range(6)]).withColumns({"rival": F.lit(0)})
    runs = [G.costed(df, ["driver"], ["rival"], **how).withColumn("variant", F.lit(v)) for v, how in (("whole", {}), ("same", {}), ("no_cliff", {"jump": 0.0, "slope": 0.0}))]
    got = {r.variant: r for r in G.changed_recommendations(runs[0].unionByName(runs[1]).unionByName(runs[2]), ["driver"], "whole").collect()}
    assert (got["same"].n, got["same"].changed) == (6, 0.0) and got["no_cliff"].mean_gain > got["same"].mean_gain


def test_response_has_r2_and_fallbacks(spark):
    rows = [(k / 400, 0.2 + 0.3 * k / 400) for k in range(400)]
    df = spark.createDataFrame(rows, "x double, y double")
    r = T.response(df, "x", "y").first()
    assert (r.n, r.fitted, r.slope, r.intercept, r.r2) == (400, True, pytest.approx(0.3), pytest.approx(0.2), pytest.approx(1.0))
    assert r.mult_near == pytest.approx((0.2 + 0.3 * np.quantile([x for x, _ in rows], 0.9)) / 0.2)
    few = T.response(df.limit(20), "x", "y").first()
    assert (few.n, few.fitted, few.mult_near, few.mult_far) == (20, False, 1.15, 1.25)
    none = T.response(df.filter("false"), "x", "y").first()
    assert (none.n, none.slope, none.fitted, none.mult_far) == (0, None, False, 1.25)


def test_thinning_and_codes_rank_by_ranges(spark):
    from stintflow.operators import documents as D
    from stintflow.operators import metrics as M

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(6)
    assert sorted(r.v for r in D.thin(df, [F.col("v")], 11).collect()) == [math.floor(j * 999 / 10) for j in range(11)]
    assert D.thin(df.filter("v < 5"), [F.col("v")], 11).count() == 5
    codes = M.category_codes(df.select(F.format_string("%04d", F.col("v")).alias("b")), "b")
    assert codes.filter(F.col("code") != F.col("b").cast("int")).count() == 0 and codes.count() == 1000


def test_equal_means_of_other_sums_share_a_bin(spark):
    rows = [(0.1, 0.1)] * 10 + [(0.1 + 0.2, 0.2)] * 15 + [(0.3, 0.4)] * 15 + [(0.5, 0.9)] * 10
    got = T.quantile_bins(spark.createDataFrame(rows, "x double, y double"), "x", "y", 8).collect()
    assert sorted((round(r.x_mean, 6), r.n) for r in got) == [(0.1, 10), (0.3, 30), (0.5, 10)]


def test_best_cost_is_not_rounded_before_it_is_compared(spark):
    df = spark.createDataFrame([("k", 2, 10.00000049, 1), ("k", 1, 10.0000004, 2), ("k", 3, 10.1, 1)], "k string, plan_id int, cost double, stops int")
    best = G.best_of(df, ["k"]).first()
    assert (best.plan_id, best.cost, best.stops) == (1, 10.0000004, 2)


def test_decisions_with_arrays_are_never_broadcast(spark):
    rows = [("d", 2, [("A", 2, True), ("N", 9, False)], [1.0, 2.0])]
    costs = spark.createDataFrame(rows, f"driver string, cur_lap int, rival_plan {G.PLAN}, parts array<double>")
    laps = spark.createDataFrame([("d", k, 90.0) for k in range(1, 10)], "driver string, lap int, pace double")
    out = G.stint_residuals(laps, costs, ["driver"], "lap", "pace")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 1


def test_races_are_sorted_once(spark, sf):
    from stintflow.plans.roles import races

    plan = races(spark, sf)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1


def test_variants_in_one_pass_equal_runs_by_themselves(spark):
    df = planned(spark, [state(f"d{k}", 10 + k, 60 + k) for k in range(4)]).withColumns({"rival": F.lit(2), "bare": F.transform("par", lambda p: p.withField("offset", F.lit(0.0)))})
    got = {(r.driver, r.variant): r for r in G.costed_variants(df, ["driver"], {"whole": ("par", 1.5, 0.15), "flat": ("par", 0.0, 0.0), "bare": ("bare", 1.5, 0.15)}, 30).collect()}
    for name, frame, how in (("whole", df, {}), ("flat", df, {"jump": 0.0, "slope": 0.0}), ("bare", df.withColumn("par", F.col("bare")), {})):
        for r in G.costed(frame, ["driver"], ["rival"], 30, **how).collect():
            v = got[r.driver, name]
            assert v.best == r.best and v.mean == pytest.approx(r.mean, abs=1e-7)
    assert len(got) == 12


def test_plans_are_dealt_by_their_number(spark, sf, monkeypatch):
    from stintflow.plans import strategy_queries as Q

    g = Q.Given(spark, sf)
    monkeypatch.setattr(Q, "DEALT", 2)
    assert g.candidates.rdd.getNumPartitions() == max(8, -(-g.states.count() // 2)) > 8


def test_exact_quantiles_send_the_bounds_and_never_the_values(spark):
    rows = spark.range(100).select(F.explode(F.sequence(F.lit(1), F.lit(17))).alias("k"), F.col("id").cast("double").alias("v"), F.lit("x" * 50).alias("other"))
    plan = T.exact_quantiles(rows, ["k"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_response_bins_values_as_they_are(spark):
    rows = [(0.1, 0.1)] * 10 + [(0.3, 0.2)] * 14 + [(0.1 + 0.2, 0.3)] * 15 + [(0.5, 0.9)] * 10
    r = T.response(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert (r.n, r.slope, r.intercept) == (49, pytest.approx(2.0), pytest.approx(-0.2))


def test_no_plan_is_left_out(spark, monkeypatch):
    states = [state("d0", 10, 90, wet=True), state("d1", 12, 60), state("d2", 30, 32)]
    monkeypatch.setattr(G, "BATCH", 1_000)
    df = spark.createDataFrame(states, STATE).withColumn("pool", F.array(*[F.lit(x) for x in POOL])).coalesce(1)
    listed = G.candidates(df, F.col("pool"))
    got = {r.driver: [[(x.compound, x.end_lap) for x in p] for p in r.plans] for r in listed.collect()}
    assert got == {s[0]: enumerated(SimpleNamespace(cur=s[1], n=s[2], used=s[9], wet=s[10])) for s in states}
    assert len(got["d0"]) > G.HELD > 400
    par = spark.createDataFrame(TYRES, PAR)
    by_list, made = ({(r.driver, r.plan_id): r for r in G.ranked(G.costed(G.with_parameters(x, par), ["driver"], [], 40), ["driver"]).collect()} for x in (listed, df))
    assert by_list == made and len(made) == sum(map(len, got.values()))


def test_a_rival_comes_after_all_candidates(spark):
    df = spark.createDataFrame([state("d", 20, 90, wet=True)], STATE).withColumn("pool", F.array(*[F.lit(x) for x in POOL]))
    rival = F.array(F.struct(F.lit("N").alias("compound"), F.lit(20).alias("end_lap"), F.lit(True).alias("is_current")), F.struct(F.lit("A").alias("compound"), F.lit(90).alias("end_lap"), F.lit(False).alias("is_current")))
    made = G.with_parameters(df.withColumn("rival_plan", rival), spark.createDataFrame(TYRES, PAR))
    plans = G.candidates(made, F.col("pool"))
    by_list = plans.withColumns({"rival": F.size("plans"), "plans": F.concat("plans", F.array("rival_plan"))}).drop("rival_plan")
    got, want = (G.costed(x, ["driver"], [], 30, spread=False).first() for x in (made, by_list))
    assert got == want and len(got.stops) == len(enumerated(SimpleNamespace(cur=20, n=90, used=["N"], wet=True))) + 1


@pytest.mark.parametrize("n", [1, 2, 5, 19, 20, 40, 250])
def test_tails_are_the_quantiles_of_sorted_rows(n):
    x = np.random.default_rng(n).normal(size=(30, n))
    low, high = G.tails(x.copy(), 0.05)
    assert np.allclose(low, np.quantile(x, 0.05, axis=1), atol=1e-12) and np.allclose(high, np.quantile(x, 0.95, axis=1), atol=1e-12)


def test_plan_queries_list_every_plan(spark, sf):
    from stintflow.plans import registry

    assert "400" not in registry.ORACLE_SQL["candidate_plans"]
    assert registry.QUERIES["candidate_plans"](spark, sf).groupBy("driver", "season").count().agg(F.max("count")).first()[0] > 400
