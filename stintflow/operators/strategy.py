"""Pit plans as tables. A decision is a row; its plans, draws and costs are arrays of that row, so that costing them
shuffles nothing and explodes no draws."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stintflow.operators.fits import exact_quantiles

#: Seconds of a stop, of a fresh start, of a cliff and of each lap beyond it, and the pace past the best
#: that counts as a cliff.
PIT_LOSS, WARM_UP = 21.0, 2.0
CLIFF_JUMP, CLIFF_SLOPE, CLIFF_PACE = 1.5, 0.15, 1.5
#: A cliff that never comes.
NEVER = 1e9
#: Plans whose draws are held at once, and plans of a batch, about: so much memory a task takes, however many a decision has.
HELD, BATCH = 512, 50_000
PLAN = "array<struct<compound:string,end_lap:int,is_current:boolean>>"


def let(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.transform(F.array(value), lambda v: f(v))[0]


def executed_stints(laps: DataFrame, keys: list[str], stint: str, category: str, lap: str) -> DataFrame:
    """(keys, stints): each run's stints in order as structs (first_lap, last_lap, category, length)."""
    s = laps.groupBy(*keys, stint).agg(F.min_by(category, lap).alias("c"), F.min(lap).alias("first"), F.max(lap).alias("last"), F.count("*").alias("n"))
    return s.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("first").alias("first_lap"), F.col("last").alias("last_lap"), F.col("c").alias("category"), F.col("n").alias("length")))).alias("stints"))


def decision_points(executed: DataFrame, n_laps: str, wet: list[str], include_wet: bool = False, least_first: int = 4, least_left: int = 8, finish_within: int = 3) -> DataFrame:
    """Adds decision_lap, the end of the first stint, and skipped: null, or why there is no decision."""
    s, n = F.col("stints"), F.col(n_laps)
    first = s[0]
    why = (
        F.when(F.size(s) < 2, "one stint")
        .when(first["last_lap"] - first["first_lap"] + 1 < least_first, "short first stint")
        .when(n - first["last_lap"] < least_left, "too late")
        .when(F.element_at(s, -1)["last_lap"] < n - finish_within, "not finished")
        .when(F.exists(s, lambda x: x["category"].isin(wet)) & F.lit(not include_wet), "wet")
    )
    return executed.withColumns({"decision_lap": first["last_lap"], "skipped": why})


def executed_plan(stints: Column, current: Column, cur_lap: Column, known: list[str]) -> Column:
    """What was driven from the decision on, as a plan: the stop at the decision, then the stints that followed on known
    compounds."""
    later = F.filter(F.slice(stints, 2, F.greatest(F.size(stints), F.lit(1))), lambda s: s["category"].isin(known))
    rest = F.transform(later, lambda s: F.struct(s["category"].alias("compound"), s["last_lap"].cast("int").alias("end_lap"), F.lit(False).alias("is_current")))
    return F.concat(F.array(F.struct(current.alias("compound"), cur_lap.cast("int").alias("end_lap"), F.lit(True).alias("is_current"))), rest)


def decision_state(laps: DataFrame, decisions: DataFrame, keys: list[str], lap: str, stint: str, life: str, pace: str, above_best: str, category: str, temp: str, cluster: str, rain: str, wet_categories: list[str], default_temp: float = 36.0) -> DataFrame:
    """decisions (keys, cur_lap) with the state at cur_lap: compound, stint_no, into (laps of the stint so far, this one
    included), base_pace, in_cliff, temp, cluster, used (compounds so far), wet.

    If the lap is the last of its stint and another stint follows, it is a pit-entry lap: pace and cliff flag are those
    of the stint's lap before it. An unknown pace falls back to the last known one. One shuffle by key: the window over
    a run's laps and the aggregate share it.
    """
    race, own = Window.partitionBy(*keys), Window.partitionBy(*keys, stint)
    cur = F.col("cur_lap")
    at = F.struct(F.col(stint).alias("stint"), F.col(category).alias("category"), F.col(pace).alias("pace"), F.col(above_best).alias("above"), F.col(temp).alias("temp"), F.col(cluster).alias("cluster"), F.max(lap).over(own).alias("ends"), F.max(stint).over(race).alias("last"))
    seen = laps.join(decisions.select(*keys, "cur_lap"), keys).withColumn("__at", at)
    seen = seen.withColumn("__now", F.max_by("__at", F.when(F.col(lap) == cur, F.col(life))).over(race)).filter((F.col(lap) <= cur) & F.col("__now").isNotNull())
    ours = F.col(stint) == F.col("__now.stint")
    prev = F.max_by(F.struct(F.col(pace).alias("pace"), F.col(above_best).alias("above")), F.when(ours & (F.col(lap) < cur), F.col(life)))
    s = seen.groupBy(*keys).agg(
        F.first("__now").alias("now"), F.sum(ours.cast("int")).alias("into"), prev.alias("prev"), F.max_by(pace, F.when(F.col(pace).isNotNull(), F.col(lap))).alias("known"),
        F.array_sort(F.collect_set(category)).alias("used"), F.max(F.coalesce(F.col(rain), F.lit(0))).alias("rain"),
    )
    j = decisions.join(s, keys)
    entry = (F.col("now.ends") == cur) & (F.col("now.last") > F.col("now.stint")) & F.col("prev").isNotNull()
    chosen = lambda c: F.when(entry, F.col(f"prev.{c}")).otherwise(F.col(f"now.{c}"))
    return j.select(
        *[F.col(c) for c in decisions.columns], F.col("now.category").alias("compound"), F.col("now.stint").alias("stint_no"), F.col("into").cast("int").alias("into"), F.coalesce(chosen("pace"), "known").alias("base_pace"),
        (F.coalesce(chosen("above"), F.lit(0.0)) > CLIFF_PACE).alias("in_cliff"), F.coalesce("now.temp", F.lit(default_temp)).alias("temp"), F.col("now.cluster").alias("cluster"), "used", ((F.col("rain") > 0) | F.coalesce(F.col("now.category").isin(wet_categories), F.lit(False))).alias("wet"),
    )


def allowed_compounds(wet: Column, dry_pool: list[str], wet_pool: list[str]) -> Column:
    """The compounds that a plan may use: in a dry race the dry ones, in a wet one all."""
    return F.when(wet, F.array(*[F.lit(c) for c in [*wet_pool, *dry_pool]])).otherwise(F.array(*[F.lit(c) for c in dry_pool]))


def prerace_state(priors: DataFrame, distances: DataFrame, event: list[str], driver: str, category: str, start: str) -> DataFrame:
    """Lap-zero states from practice priors (event, driver, category, prior, length) and distances (event, n_laps, temp):
    the base pace is the prior of the starting compound, and nothing has been used yet."""
    own = priors.filter(F.col(category) == start).select(*event, driver, F.col("prior").alias("base_pace"), F.col("length").alias("practice_laps"))
    return own.join(distances, event).withColumns({"cur_lap": F.lit(0), "into": F.lit(0), "compound": F.lit(start), "used": F.array(F.lit(start)), "wet": F.lit(False)})


def _stop_plans(state: dict, most: int | None = None, first_step: int = 2, second_step: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one state's plans in order: their numbers of stints, and of all stints the compounds (places in the pool, -1 for the
    current one) and ends. All of them, unless the caller wants `most` at even distances."""
    cur, n, pool, known = state["cur_lap"], state["n_laps"], state["pool"], state["used"]
    legal = lambda *more: bool(state["wet"]) or (known is not None and len({*known, *more}) >= 2)
    one = np.array([k for k, x in enumerate(pool) if legal(x)], np.int64)
    two = np.array([(j, k) for j, x in enumerate(pool) for k, y in enumerate(pool) if legal(x, y)], np.int64).reshape(-1, 2)
    steps = lambda a, b, step: max(-((a - b) // step), 0)  # noqa: E731  the length of range(a, b, step)
    # The first stop's i-th place leaves b - i places for the second.
    a, b = steps(cur + 3, n - 10, second_step), steps(cur + 9, n - 2, second_step)
    before = lambda i: i * b - i * (i - 1) // 2  # noqa: E731  pairs of places with an earlier first stop
    n1, n2 = steps(cur + 2, n - 2, first_step) * len(one), before(a) * len(two)
    total = n1 + n2 + int(legal() or n1 + n2 == 0)
    r = np.arange(total) if most is None or total <= most else np.floor(np.arange(most) * ((total - 1) / (most - 1))).astype(np.int64)
    k1, k2 = np.searchsorted(r, [n1, n1 + n2])
    sizes = np.concatenate((np.full(k1, 2), np.full(k2 - k1, 3), np.ones(len(r) - k2, np.int64)))
    compounds, ends = np.full((len(r), 3), -1), np.full((len(r), 3), n)
    if k1:
        ends[:k1, 0], compounds[:k1, 1] = cur + 2 + first_step * (r[:k1] // len(one)), one[r[:k1] % len(one)]
    if k2 > k1:
        place, own = np.divmod(r[k1:k2] - n1, len(two))
        i = np.floor((2 * b + 1 - np.sqrt(np.maximum((2 * b + 1) ** 2 - 8 * place, 0).astype(float))) / 2).astype(np.int64)
        i = np.where(before(i) > place, i - 1, np.where(before(i + 1) <= place, i + 1, i))
        ends[k1:k2, 0], ends[k1:k2, 1] = cur + 3 + second_step * i, cur + 9 + second_step * (place - before(i) + i)
        compounds[k1:k2, 1:] = two[own]
    real = np.arange(3) < sizes[:, None]
    return sizes, compounds[real], ends[real]


def _plan_lists(made: list[tuple[dict, tuple | None]]) -> pa.Array:
    """The plans of states, from _stop_plans(), as a column."""
    full = [(np.zeros(0, np.int64),) * 3 if m is None else m for _, m in made]
    sizes, own, ends = (np.concatenate([m[k] for m in full]) for k in range(3))
    texts = [x for r, _ in made for x in [*r["pool"], r["compound"]]]
    base = np.cumsum([0, *(len(r["pool"]) + 1 for r, _ in made)])
    n = np.array([len(m[1]) for m in full])
    own = np.where(own < 0, np.repeat(base[1:] - 1, n), np.repeat(base[:-1], n) + own)
    first = np.zeros(len(own), bool)
    first[np.cumsum(sizes) - sizes] = True
    stints = pa.StructArray.from_arrays([pa.array(texts, pa.string()).take(pa.array(own)), pa.array(ends, pa.int32()), pa.array(first)], ["compound", "end_lap", "is_current"])
    each = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), stints)
    offsets = np.cumsum([0, *(len(m[0]) for m in full)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each, mask=pa.array([m is None for _, m in made]))


def candidates(states: DataFrame, pool: Column, most: int | None = None, first_step: int = 2, second_step: int = 4) -> DataFrame:
    """states (cur_lap, n_laps, compound, used, wet) with plans: array of plans, in order, plan k at place k - 1.

    One stop every first_step laps, two stops every second_step with at least six laps between; a dry race needs two
    compounds in all; staying out is a plan if that is allowed or nothing else is. They are in the order of stops, laps
    and compounds. How many plans there are is arithmetic, and so is the plan at a place: they are made in NumPy where the
    row is. A state without laps has no plans (null). With `most`, only so many at even distances of the order are made.
    """
    c = F.col
    state = F.struct(c("cur_lap").cast("long").alias("cur_lap"), c("n_laps").cast("long").alias("n_laps"), c("compound").alias("compound"), c("used").alias("used"), c("wet").alias("wet"), pool.alias("pool"))
    schema = T.StructType([*states.schema.fields, *T._parse_datatype_string(f"plans array<{PLAN}>").fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 32):
                part = b.slice(at, 32)
                made, since = [], 0
                for k, r in enumerate(part.column(len(names) - 1).to_pylist()):
                    made.append((r, None if r["cur_lap"] is None or r["n_laps"] is None else _stop_plans(r, most, first_step, second_step)))
                    if k == len(part) - 1 or sum(len(m[0]) for _, m in made if m) >= BATCH:
                        yield pa.RecordBatch.from_arrays([*[part.column(j).slice(since, len(made)) for j in range(len(names) - 1)], _plan_lists(made)], names)
                        made, since = [], k + 1

    return states.withColumn("__s", state).mapInArrow(run, schema)


def listed(df: DataFrame, keys: list[str], values: dict[str, Column] | None = None) -> DataFrame:
    """(keys, plan_id, stops, values): one row a plan; values are arrays by plan, or `plan` where none are given."""
    zipped = F.arrays_zip(F.transform("plans", lambda p: F.size(p) - 1).alias("stops"), *[v.alias(k) for k, v in (values or {"plan": F.col("plans")}).items()])
    return df.select(*keys, F.posexplode(zipped).alias("__k", "__p")).select(*keys, (F.col("__k") + 1).alias("plan_id"), "__p.*")


def fitted_parameters(slopes: DataFrame, spread: DataFrame, onsets: DataFrame, offsets: DataFrame, category: str, pool: list[str], base: str, priors: dict[str, tuple[float, float, float]], least: int = 5) -> DataFrame:
    """(compound, n_stints, beta, sigma, offset, censor, quantiles): one row for each compound of the pool.

    slopes: category_slopes() by category; spread: one row (beta, sigma) of all stints, for compounds with fewer than
    `least` stints, which also have no cliff before lap 20; onsets: onset_distribution(); offsets: (category, offset) of
    paired_fit(). priors: by compound the least and largest offset and the one without a fit; the base has none. A table
    of the pool's size, whatever the laps.
    """
    spark = slopes.sparkSession
    rows = [(p, *((0.0, 0.0, 0.0) if p == base else priors[p])) for p in pool]
    known = spark.createDataFrame(rows, "compound string, __low double, __high double, __prior double")
    s = slopes.select(F.col(category).alias("compound"), "n_stints", F.col("beta").alias("__beta"), F.col("sigma").alias("__sigma"))
    o = onsets.select(F.col(category).alias("compound"), F.col("censored").alias("__censored"), F.col("quantiles").alias("__q"))
    g = offsets.select(F.col(category).alias("compound"), F.col("offset").alias("__offset"))
    j = known.join(s, "compound", "left").join(o, "compound", "left").join(g, "compound", "left").crossJoin(F.broadcast(spread.select(F.col("beta").alias("__all"), F.col("sigma").alias("__spread"))))
    big = F.coalesce(F.col("n_stints") >= least, F.lit(False))
    some = big & F.coalesce(F.size("__q") > 0, F.lit(False))
    none = F.array(F.lit(20.0))
    return j.select(
        "compound", F.coalesce("n_stints", F.lit(0)).cast("long").alias("n_stints"), F.coalesce(F.when(big, F.col("__beta")), "__all").alias("beta"), F.coalesce(F.when(big, F.col("__sigma")), "__spread", F.lit(0.05)).alias("sigma"),
        F.least(F.greatest(F.coalesce("__offset", "__prior"), "__low"), "__high").alias("offset"), F.when(big, F.coalesce("__censored", F.lit(1.0))).otherwise(1.0).alias("censor"), F.when(some, F.col("__q")).otherwise(none).alias("quantiles"),
    )


def scenario_table(response: DataFrame, penalties: dict[str, tuple[str | None, float]], pit_loss: float = PIT_LOSS) -> DataFrame:
    """(scenario, beta_mult, penalty, pit_loss): one row a scenario; penalties: by scenario the column of response (one
    row of fitted multipliers) or None, and the seconds a lap lost in traffic."""
    rows = F.array(*[F.struct(F.lit(k).alias("scenario"), (F.coalesce(F.col(col), F.lit(1.0)) if col else F.lit(1.0)).alias("beta_mult"), F.lit(p).alias("penalty"), F.lit(pit_loss).alias("pit_loss")) for k, (col, p) in penalties.items()])
    return response.select(F.inline(rows))


def with_parameters(states: DataFrame, parameters: DataFrame, clusters: DataFrame | None = None, temperature: DataFrame | None = None) -> DataFrame:
    """states with par: array of (compound, beta, sigma, offset, censor, quantiles), the compounds in order.

    Slopes are shifted by the offset of the state's cluster (clusters: cluster, offset) and by temperature's (effect,
    mean) times the distance of the state's temperature from the mean. The three tables have a row a compound, a row a
    cluster and one row; the first and the last are gathered into one row and sent to all tasks.
    """
    names = ["compound", "beta", "sigma", "offset", "censor", "quantiles"]
    df = states.crossJoin(F.broadcast(parameters.agg(F.sort_array(F.collect_list(F.struct(*names))).alias("par"))))
    shift = F.lit(0.0)
    if clusters is not None:
        df = df.join(clusters.select("cluster", F.col("offset").alias("__cluster")), "cluster", "left")
        shift = shift + F.coalesce("__cluster", F.lit(0.0))
    if temperature is not None:
        df = df.crossJoin(F.broadcast(temperature.select(F.col("effect").alias("__effect"), F.col("mean").alias("__mean"))))
        shift = shift + F.coalesce("__effect", F.lit(0.0)) * (F.col("temp") - F.coalesce("__mean", F.lit(0.0)))
    moved = df.withColumn("__shift", shift)
    moved = moved.withColumn("par", F.transform("par", lambda p: F.struct(p["compound"].alias("compound"), (p["beta"] + F.col("__shift")).alias("beta"), *[p[k].alias(k) for k in names[2:]])))
    return moved.drop("__shift", "__cluster", "__effect", "__mean")


def stint_cost(base: Column, penalty: Column, beta: Column, length: Column, cliff: Column, jump: float = CLIFF_JUMP, slope: float = CLIFF_SLOPE) -> Column:
    """L (base + penalty) + beta L (L + 1) / 2 + jump m + slope m (m + 1) / 2, m = the laps past the cliff."""
    m = F.greatest(length - F.greatest(cliff, F.lit(0.0)), F.lit(0.0))
    return length * (base + penalty) + beta * length * (length + 1) / 2 + jump * m + slope * m * (m + 1) / 2


def by_compound(par: Column, compound: Column) -> Column:
    return F.filter(par, lambda p: p["compound"] == compound)[0]


def best_of(costs: DataFrame, keys: list[str]) -> DataFrame:
    """The cheapest plan of each key, the smaller number on ties of six decimals; its cost is not rounded."""
    m = F.min_by(F.struct("cost", "plan_id", "stops"), F.struct(F.round("cost", 6), "plan_id"))
    return costs.groupBy(*keys).agg(m.alias("b")).select(*keys, "b.*")


def branch_summary(best: DataFrame, keys: list[str], green: str, neutral: str) -> DataFrame:
    """Best plan with and without a control period, by decision: best has (scenario, keys, plan_id, cost)."""
    g = lambda s, c: F.max(F.when(F.col("scenario") == s, F.col(c)))
    return best.groupBy(*keys).agg(g(green, "plan_id").alias("green_plan"), g(green, "cost").alias("green_cost"), g(neutral, "plan_id").alias("neutral_plan"), g(neutral, "cost").alias("neutral_cost")).withColumn("difference", F.col("neutral_cost") - F.col("green_cost"))


def degradation_profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, plan_id, place, compound, length, beta, loss): the slope of each stint of a plan and what it costs by its end."""

    def stints(row: dict, _: str) -> tuple:
        sizes, ends = row["sizes"], row["ends"]
        place = np.arange(len(ends)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        length = np.maximum(ends - np.where(place == 0, row["cur_lap"], np.concatenate(([0], ends[:-1]))), 0)
        beta = row["beta"][row["compounds"]]
        return np.repeat(np.arange(1, len(sizes) + 1), sizes), place, row["compounds"], length, beta, beta * length

    names = ["plan_id", "place", "compound", "length", "beta", "loss"]
    found = over_decisions(df.withColumn("__names", F.transform("par", lambda p: p["compound"])), [*keys, "__names"], {}, F.lit(""), stints, "plan_id array<int>, place array<int>, compound array<int>, length array<int>, beta array<double>, loss array<double>")
    return found.select(*keys, "__names", F.inline(F.arrays_zip(*names))).withColumn("compound", F.get("__names", F.col("compound"))).drop("__names")


@cache
def _draw_names(draws: int, places: int) -> list[bytes]:
    return [f"|{d}|{p}".encode() for p in [*range(places), "control"] for d in range(1, draws + 1)]


def keyed_draws(key: str, draws: int, places: int) -> dict[str, np.ndarray]:
    """z (normal), u and q (uniform) by stint of a plan and draw, v and w (uniform) by draw, from the MD5 of (key, draw, stint):
    functions of what is drawn, so all plans of a decision see the same draws, whatever the partitioning."""
    of, md5 = key.encode(), hashlib.md5
    raw = b"".join([md5(of + name).digest() for name in _draw_names(draws, places)])
    x = (np.frombuffer(raw, ">u4").reshape(places + 1, draws, 4) + 0.5) / 4294967296.0
    return {"z": np.sqrt(-2 * np.log(x[:-1, :, 0])) * np.cos(2 * np.pi * x[:-1, :, 1]), "u": x[:-1, :, 2], "q": x[:-1, :, 3], "v": x[-1, :, 0], "w": x[-1, :, 1]}


def onset_distributions(hazards: DataFrame, circuit: str) -> DataFrame:
    """(circuit, onset_by): by circuit the chance that a race's first control period has begun by lap 1, 2, ...: one minus
    the product of the laps' survival. hazards: (circuit, lap, hazard); a lap without a row has none.

    The hazards of a circuit are as many as the laps of its longest race.
    """
    h = hazards.groupBy(circuit).agg(F.map_from_entries(F.collect_list(F.struct(F.col("lap").cast("int"), "hazard"))).alias("h"), F.max("lap").cast("int").alias("n"))
    lap_hazard = lambda k: F.coalesce(F.try_element_at("h", k), F.lit(0.0))
    grown = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.array(F.lit(1.0)), lambda a, k: F.concat(a, F.array(F.element_at(a, -1) * (1 - lap_hazard(k)))))
    return h.select(circuit, F.transform(F.slice(grown, 2, F.col("n")), lambda s: 1 - s).alias("onset_by"))


def with_control(df: DataFrame, hazards: DataFrame, durations: DataFrame, circuit: str) -> DataFrame:
    """df with onset_by, of its circuit and cut to the race's laps, and lengths, the sorted distinct lengths of first
    control periods (durations: column laps; [1] if there are none), a list of small numbers."""
    lists = durations.agg(F.coalesce(F.array_sort(F.collect_set(F.col("laps").cast("int"))), F.array().cast("array<int>")).alias("lengths")).withColumn("lengths", F.when(F.size("lengths") > 0, F.col("lengths")).otherwise(F.array(F.lit(1))))
    j = df.join(onset_distributions(hazards, circuit), circuit, "left").crossJoin(F.broadcast(lists))
    return j.withColumn("onset_by", F.slice(F.coalesce("onset_by", F.array().cast("array<double>")), F.lit(1), F.greatest(F.col("n_laps").cast("int"), F.lit(1))))


def control_window(v: np.ndarray, w: np.ndarray, onset_by: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last lap of a draw's control period: v's place among the chances of an onset by lap 1, 2, ..., and w's
    length; past the last lap there is none."""
    start = np.searchsorted(onset_by, v, side="right").astype(float) + 1
    start[start > len(onset_by)] = np.inf
    return start, start + lengths[np.minimum((w * len(lengths)).astype(int), len(lengths) - 1)] - 1


def drawn_tyres(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and cliffs by compound, stint and draw: a clipped normal, and one of the compound's quantiles or none."""
    mean, spread = row["beta"][:, None, None], row["sigma"][:, None, None]
    beta = np.minimum(np.maximum(mean + spread * row["z"], 0.005), np.minimum(np.maximum(mean, 0.0) * 4 + 0.15, 1.0))
    of = lambda c, x: np.where(row["u"] < c, NEVER, x[np.minimum((row["q"] * len(x)).astype(int), len(x) - 1)])
    return beta, np.stack([of(c, x) for c, x in zip(row["censor"], row["quantiles"], strict=True)])


def mean_tyres(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The mean slope, and the middle quantile of the cliff or none where most stints have none, as a single draw."""
    places = int(row["sizes"].max())
    cliff = np.array([NEVER if c > 0.5 else x[(len(x) - 1) // 2] for c, x in zip(row["censor"], row["quantiles"], strict=True)])
    spread = lambda x: np.repeat(x[:, None, None], places, axis=1)
    return spread(row["beta"]), spread(cliff)


class Costing:
    """Costs of one decision's plans, from the numbers of its row."""

    def __init__(self, row: dict, beta: np.ndarray, cliff: np.ndarray, jump: float = CLIFF_JUMP, slope: float = CLIFF_SLOPE, drift: float = 0.0, laid: Layout | None = None):
        """beta and cliff by compound, stint and draw. A decision's plans are laid out once, for any number of scenarios."""
        self.row, self.beta, self.cliff, self.jump, self.slope, self.drift = row, beta, cliff, jump, slope, drift
        self.k0 = max(int(row["into"]) - 1, 0)
        self.fresh = row["base_pace"] - beta[row["now"], 0] * self.k0
        self.laid = laid or Layout(row["sizes"], row["compounds"], row["ends"], row["cur_lap"])

    def stints(self, place: np.ndarray, compound: np.ndarray, n: np.ndarray) -> np.ndarray:
        """cost[stint, draw]: seconds of stints of n laps in every draw, without their stops and the drift. Stints of one place and
        compound that follow each other are costed at once."""
        r, out = self.row, np.empty((len(n), self.beta.shape[2]))
        bounds = [0, *(np.flatnonzero((np.diff(place) != 0) | (np.diff(compound) != 0)) + 1).tolist(), len(n)]
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if low == high:
                continue
            p, c = place[low], compound[low]
            laps = n[low:high, None].astype(float)
            beta, cliff = self.beta[c, p] * r["beta_mult"], self.cliff[c, p]
            base, lengths = self.fresh + r["penalty"], laps * (laps + 1) / 2
            if p == 0:
                cliff = np.minimum(cliff - self.k0, -1.0 if r["in_cliff"] else NEVER)
                lengths = lengths + self.k0 * laps
            else:
                base = base + (r["offset"][c] - r["offset"][r["now"]])
            past = np.subtract(laps, np.maximum(cliff, 0.0))
            np.maximum(past, 0.0, out=past)
            cost = past * (self.slope / 2)
            cost += self.jump + self.slope / 2
            cost *= past
            np.multiply(laps, base, out=past)
            cost += past
            np.multiply(lengths, beta, out=past)
            np.add(cost, past, out=out[low:high])
        return out

    def drifted(self, n: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The drift's seconds by stint."""
        return self.drift * n * (0.5 * (start + 1 + end) - (self.row["cur_lap"] - 1))

    def parts(self, loss: float = PIT_LOSS) -> tuple[np.ndarray, np.ndarray]:
        """cost[stint, draw] of the different stints and cost[end, draw] of stops after the different ends."""
        at = self.laid
        stints = self.stints(at.place[at.first], at.compounds[at.first], at.n[at.first])
        stops = np.full((len(at.stop_ends), 1), loss + WARM_UP)
        if len(self.row["onset_by"]):
            first, last = control_window(self.row["v"], self.row["w"], self.row["onset_by"], self.row["lengths"])
            end = at.stop_ends[:, None]
            stops = np.where((end >= first) & (end <= last), self.row["pit_loss_control"], loss) + WARM_UP
        return stints, stops

    def means(self, parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Mean cost by plan: the mean of a sum is the sum of its parts' means, so no plan is drawn for it."""
        at = self.laid
        each = parts[0].mean(axis=1)[at.own]
        each[at.stops] += parts[1].mean(axis=1)[at.stop_own]
        if self.drift:
            each += self.drifted(at.n, at.starts, at.ends)
        return np.add.reduceat(each, at.begin)

    def plans(self, parts: tuple[np.ndarray, np.ndarray], chosen: np.ndarray | None = None, room: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """cost[plan, draw] of the chosen plans, or of all. What plans share up to their last stint is added up once. In `room`,
        two arrays of at least so many rows, if they are given: fresh memory for every call takes longer than the sums."""
        at = self.laid
        chosen = np.arange(len(at.sizes)) if chosen is None else chosen
        begin, sizes = at.begin[chosen], at.sizes[chosen]
        stop = np.cumsum(at.stops) - 1
        out, spare = (x[: len(chosen)] for x in room or np.empty((2, len(chosen), parts[0].shape[1])))
        rows, shared = None, np.zeros(len(chosen), np.int64)
        for p in range(int(sizes.max())):
            last = np.flatnonzero(sizes == p + 1)
            if len(last):
                together = last[-1] - last[0] + 1 == len(last)
                cost = np.take(parts[0], at.own[begin[last] + p], axis=0, out=out[last[0] : last[-1] + 1] if together else None, mode="clip")
                if rows is not None:
                    cost += np.take(rows, shared[last], axis=0, out=spare[: len(last)], mode="clip")
                if not together:
                    out[last] = cost
            on = np.flatnonzero(sizes > p + 1)
            if len(on):
                own, end = at.own[begin[on] + p], at.stop_own[stop[begin[on] + p]]
                _, first, now = np.unique((shared[on] * len(parts[0]) + own) * len(parts[1]) + end, return_index=True, return_inverse=True)
                cost = parts[0][own[first]] + parts[1][end[first]]
                if rows is not None:
                    cost += rows[shared[on[first]]]
                rows, shared[on] = cost, now
        if self.drift:
            out += np.add.reduceat(self.drifted(at.n, at.starts, at.ends), at.begin)[chosen][:, None]
        return out


class Layout:
    """Of all stints of a decision's plans their places, starts, lengths and whether they end in a stop; of the different ones
    (place, compound, length) the first, and which one each stint is; the same of the ends of those that end in a stop."""

    def __init__(self, sizes: np.ndarray, compounds: np.ndarray, ends: np.ndarray, cur_lap: int):
        self.sizes, self.compounds, self.ends, self.begin = sizes, compounds, ends, np.cumsum(sizes) - sizes
        self.place = np.arange(len(ends)) - np.repeat(self.begin, sizes)
        self.starts = np.where(self.place == 0, cur_lap, np.concatenate(([0], ends[:-1])))
        self.n = np.maximum(ends - self.starts, 0)
        key = (self.place * (int(compounds.max()) + 1) + compounds) * (int(self.n.max()) + 1) + self.n
        _, self.first, self.own = np.unique(key, return_index=True, return_inverse=True)
        self.stops = self.place < np.repeat(sizes, sizes) - 1
        self.stop_ends, self.stop_own = np.unique(ends[self.stops], return_inverse=True)


def quantile_of(sorted_rows: np.ndarray, q: float) -> np.ndarray:
    """Linear quantile of sorted rows."""
    at = q * (sorted_rows.shape[1] - 1)
    low = int(at)
    return sorted_rows[:, low] + (at - low) * (sorted_rows[:, min(low + 1, sorted_rows.shape[1] - 1)] - sorted_rows[:, low])


def tails(rows: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray]:
    """Linear quantiles q and 1 - q, for a small q, of rows, which are put in another order: only the places asked for are sought."""
    n = rows.shape[1]
    low, high = int(q * (n - 1)), int((1 - q) * (n - 1))
    if n < 20 or low + 1 >= high:
        rows.sort(axis=1)
        return quantile_of(rows, q), quantile_of(rows, 1 - q)
    rows.partition(low + 1, axis=1)
    rest = rows[:, low + 2 :]
    rest.partition(high - low - 2, axis=1)
    a, b, c, d = rows[:, : low + 1].max(axis=1), rows[:, low + 1], rows[:, high], rows[:, high + 1 :].min(axis=1)
    return a + (q * (n - 1) - low) * (b - a), c + ((1 - q) * (n - 1) - high) * (d - c)


def _listed(values: list, kind: pa.DataType) -> pa.Array:
    """A column of numbers, or of arrays of numbers."""
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    flat = [np.asarray(v, kind.value_type.to_pandas_dtype()) for v in values if v is not None]
    offsets = np.cumsum([0, *(0 if v is None else len(v) for v in values)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat) if flat else [], kind.value_type), mask=pa.array([v is None for v in values]))


def _with_candidates(row: dict, place: dict[str, int]) -> None:
    """Puts all candidates of a row's state before its plan, which is the rival's if there is one."""
    sizes, own, ends = _stop_plans(row["state"])
    rival = row["sizes"] > 0
    row["rival"] = len(sizes) if rival.any() else None
    # The pool's places, and the current compound's as the last.
    of = np.array([*(place.get(x, -1) for x in row["state"]["pool"]), row["now"]], np.int64)
    row["sizes"], row["ends"] = np.concatenate((sizes, row["sizes"][rival])), np.concatenate((ends, row["ends"]))
    row["compounds"] = np.concatenate((of[own], row["compounds"]))


def over_decisions(df: DataFrame, keep: list[str], more: dict[str, Column], key: Column, f: Callable[[dict, str], tuple], result: str) -> DataFrame:
    """Columns `keep` of df, a row a decision, and f(numbers, key) of each as columns `result`. The numbers are those of the
    state, the parameters (in the order of par) and the plans (sizes, and the compounds, as places in par, and ends of all
    their stints), and `more`. Rows are worked on where they are: nothing is shuffled.

    The plans are those of column plans. Without it they are all candidates() of the state (n_laps, used, wet, pool),
    made where they are costed, with rival_plan as the last one if there is such a column."""
    c = F.col
    names = F.transform("par", lambda p: p["compound"])
    of = lambda k: F.transform("par", lambda p: p[k])
    optional = lambda k, kind: (c(k) if k in df.columns else F.array()).cast(kind)
    made = "plans" not in df.columns
    state = F.struct(c("cur_lap").cast("long").alias("cur_lap"), c("n_laps").cast("long").alias("n_laps"), "used", "wet", "pool") if made else None
    plans = {"plans": c("plans")} if not made else {"plans": F.array(c("rival_plan") if "rival_plan" in df.columns else F.array().cast(PLAN)), "state": state}
    numbers = {
        "cur_lap": c("cur_lap").cast("int"), "into": c("into").cast("int"), "base_pace": c("base_pace").cast("double"), "in_cliff": F.coalesce("in_cliff", F.lit(False)), "now": (F.array_position(names, c("compound")) - 1).cast("int"), "key": key,
        "rival": (c("rival") if "rival" in df.columns else F.lit(None)).cast("int"), "names": names, **plans,
        "beta": of("beta"), "sigma": of("sigma"), "offset": of("offset"), "censor": of("censor"), "quantiles": of("quantiles"), "onset_by": optional("onset_by", "array<double>"), "lengths": optional("lengths", "array<int>"), **more,
    }
    schema = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keep], *T._parse_datatype_string(result).fields])
    kinds = to_arrow_schema(T._parse_datatype_string(result)).types
    scalars = ("cur_lap", "into", "base_pace", "in_cliff", "now", "rival", "key", "state")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 32):
                part = b.slice(at, 32)
                own = part.column(len(keep))
                columns = dict(zip([x.name for x in own.type], own.flatten(), strict=True))
                plans, names = columns.pop("plans"), columns.pop("names").to_pylist()
                sizes = plans.flatten().value_lengths().to_numpy()
                texts, ends, _ = plans.flatten().flatten().flatten()
                texts, ends = texts.dictionary_encode(), ends.to_numpy()
                which, known = texts.indices.to_numpy(), texts.dictionary.to_pylist()
                upto = np.cumsum([0, *plans.value_lengths().to_numpy()])
                begin = np.cumsum([0, *sizes])[upto]
                found, since, held = [], 0, 0
                for k in range(len(part)):
                    at_stint = slice(begin[k], begin[k + 1])
                    place = {x: p for p, x in enumerate(names[k])}
                    row = {"sizes": sizes[upto[k] : upto[k + 1]], "ends": ends[at_stint], "compounds": np.array([place.get(x, -1) for x in known], np.int64)[which[at_stint]]}
                    for name, col in columns.items():
                        value = col[k]
                        row[name] = value.as_py() if name in scalars else [x.values.to_numpy() for x in value] if name == "quantiles" else value.values.to_numpy(zero_copy_only=False)
                    if made:
                        _with_candidates(row, place)
                    if row["now"] < 0 or (row["compounds"] < 0).any():
                        raise ValueError("a plan has a compound without parameters")
                    found.append(f(row, row["key"]))
                    held += len(row["sizes"])
                    if k == len(part) - 1 or held >= BATCH:
                        results = [_listed(list(col), t) for col, t in zip(zip(*found, strict=True), kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays([*[part.column(j).slice(since, len(found)) for j in range(len(keep))], *results], schema.names)
                        found, since, held = [], k + 1, 0

    return df.select(*keep, F.struct(*[v.alias(k) for k, v in numbers.items()]).alias("__n")).mapInArrow(run, schema)


_STATS = "stops array<int>, mean array<double>, std array<double>, p5 array<double>, p95 array<double>, rank array<int>, best int, best_compounds array<int>, best_ends array<int>, gain_mean double, gain_low double, gain_high double, win_share double, parts array<double>"


def _by_mean(mean: np.ndarray, rival: int | None) -> np.ndarray:
    """The candidates' places from the cheapest on, by mean of six decimals, then place."""
    chosen = np.arange(len(mean)) if rival is None else np.delete(np.arange(len(mean)), rival)
    return chosen[np.lexsort((chosen, np.round(mean[chosen], 6)))]


@cache
def _room(rows: int, draws: int) -> tuple[np.ndarray, np.ndarray]:
    return np.empty((rows, draws)), np.empty((rows, draws))


def evaluated(row: dict, jump: float, slope: float, drift: float, spread: bool = True) -> tuple:
    """The columns of costed() for one decision."""
    costing, sizes, rival = Costing(row, *drawn_tyres(row), jump, slope, drift), row["sizes"], row["rival"]
    begin, parts = costing.laid.begin, costing.parts()
    mean = costing.means(parts)
    order = _by_mean(mean, rival)
    rank = np.zeros(len(sizes), np.int32)
    rank[order] = np.arange(1, len(order) + 1)
    of = lambda name, k: row[name][begin[k] : begin[k] + sizes[k]]
    if spread:
        (std, p5, p95), room = np.empty((3, len(sizes))), _room(HELD, parts[0].shape[1])
        for low in range(0, len(sizes), HELD):
            some = slice(low, min(low + HELD, len(sizes)))
            cost = costing.plans(parts, np.arange(some.start, some.stop), room)
            cost -= mean[some, None]
            std[some] = np.sqrt(np.einsum("ij,ij->i", cost, cost) / cost.shape[1])
            p5[some], p95[some] = (x + mean[some] for x in tails(cost, 0.05))
        out = [sizes - 1, mean, std, p5, p95, rank]
    else:
        out = [sizes - 1, mean, None, None, None, rank]
    if not len(order):
        return (*out, *[None] * 8)
    best = int(order[0])
    out += [best + 1, of("compounds", best), of("ends", best)]
    if rival is None:
        return (*out, *[None] * 5)
    both = costing.plans(parts, np.array([rival, best]))
    gain = np.sort(both[0] - both[1])[None, :]
    at, driven = costing.laid, slice(begin[rival], begin[rival] + sizes[rival])
    seconds = parts[0][at.own[driven]].mean(axis=1) + costing.drifted(at.n[driven], at.starts[driven], at.ends[driven])
    return (*out, float(gain.mean()), float(quantile_of(gain, 0.05)[0]), float(quantile_of(gain, 0.95)[0]), float((gain > 0).mean()), seconds)


def costed(df: DataFrame, keys: list[str], keep: list[str], draws: int = 250, seed: str = "s", jump: float = CLIFF_JUMP, slope: float = CLIFF_SLOPE, drift: float = 0.0, beta_mult: float = 1.0, penalty: float = 0.0, pit_loss_control: float = PIT_LOSS / 3, spread: bool = True) -> DataFrame:
    """The keys and columns `keep` of df, a row a decision (candidates(), with_parameters()), with arrays by plan: mean, std
    (population), p5, p95 of the costs over the draws, stops, and rank (by mean, then place; 0 for the rival), and best,
    the number of the cheapest plan, with its stints' compounds (places in par) and ends. Draws are made once a decision,
    from its keys. Without `spread`, std, p5 and p95 are null, and only the best plan and the rival are drawn as a whole.

    A slope is a clipped normal, a cliff one of the compound's quantiles or none; with with_control(), a stop within the
    draw's control period costs less. If there is a rival, a plan that isn't a candidate (column rival_plan, or column rival with
    its place from 0 in column plans), there also are the gain of the best plan over it on common draws (mean, 5 % and 95 %, share above 0) and parts, the mean
    seconds of the rival's stints. A task holds the draws of a decision's different stints, and of some thousand plans at once.
    """

    def stats(row: dict, key: str) -> tuple:
        row |= {"beta_mult": beta_mult, "penalty": penalty, "pit_loss_control": pit_loss_control, **keyed_draws(key, draws, int(row["sizes"].max()))}
        return evaluated(row, jump, slope, drift, spread)

    return over_decisions(df, [*keys, *keep], {}, _draw_key(seed, keys), stats, _STATS)


def _draw_key(seed: str, keys: list[str]) -> Column:
    return F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in keys])


def costed_variants(df: DataFrame, keys: list[str], variants: dict[str, tuple[str, float, float]], draws: int = 250, seed: str = "s") -> DataFrame:
    """(keys, variant, rival, best, mean) of costed(), with a row for each variant: by its name the column with its
    parameters (as par, the same compounds), and jump and slope of a cliff. All variants of a decision share one pass, its
    plans and its draws. Rival is the last plan where df has no column of that name."""
    of = lambda p, k: F.transform(p, lambda x: x[k])
    more = {f"{k}_{n}": of(p, k) for n, (p, _, _) in enumerate(variants.values()) for k in ("beta", "offset")}

    def means(row: dict, key: str) -> tuple:
        row |= {"beta_mult": 1.0, "penalty": 0.0, "pit_loss_control": PIT_LOSS / 3, **keyed_draws(key, draws, int(row["sizes"].max()))}
        laid, best, out = None, [], []
        for n, (_, jump, slope) in enumerate(variants.values()):
            own = row | {"beta": row[f"beta_{n}"], "offset": row[f"offset_{n}"]}
            costing = Costing(own, *drawn_tyres(own), jump, slope, laid=laid)
            laid = costing.laid
            out.append(costing.means(costing.parts()))
            order = _by_mean(out[-1], row["rival"])
            best.append(int(order[0]) + 1 if len(order) else None)
        return best, np.concatenate(out)

    own = ["rival"] if "rival" in df.columns else []
    found = over_decisions(df, [*keys, *own], more, _draw_key(seed, keys), means, "bests array<int>, means array<double>")
    n = F.try_divide(F.size("means"), F.lit(len(variants))).cast("int")
    found = found if own else found.withColumn("rival", n - 1)
    each = F.array(*[F.struct(F.lit(v).alias("variant"), F.get("bests", F.lit(k)).alias("best"), F.slice("means", F.lit(k) * n + 1, n).alias("mean")) for k, v in enumerate(variants)])
    return found.select(*keys, "rival", F.inline(each))


def expected_costs(df: DataFrame, keys: list[str], scenarios: DataFrame, drift: float = 0.0) -> DataFrame:
    """(scenario, keys, plan_id, stops, cost): closed-form cost at the mean slope and the middle quantile of the cliff, or
    no cliff where most stints have none; scenarios as of scenario_table(), a handful of rows that every row gets."""
    names = ["scenario", "beta_mult", "penalty", "pit_loss"]
    with_all = df.crossJoin(F.broadcast(scenarios.agg(F.sort_array(F.collect_list(F.struct(*names))).alias("__all"))))

    def costs(row: dict, _: str) -> tuple:
        costing = Costing(row, *mean_tyres(row), drift=drift)
        out = []
        for mult, penalty, loss in zip(row["beta_mults"], row["penalties"], row["pit_losses"], strict=True):
            row |= {"beta_mult": mult, "penalty": penalty}
            out.append(costing.means(costing.parts(loss)))
        return row["sizes"] - 1, np.concatenate(out)

    of = lambda k: F.transform("__all", lambda x: x[k])
    found = over_decisions(with_all, [*keys, "__all"], {"beta_mults": of("beta_mult"), "penalties": of("penalty"), "pit_losses": of("pit_loss")}, F.lit(""), costs, "stops array<int>, costs array<double>")
    n = F.size("stops")
    each = found.select(*keys, "stops", F.posexplode("__all").alias("__k", "__s"), "costs").select(F.col("__s.scenario").alias("scenario"), *keys, F.posexplode(F.arrays_zip("stops", F.slice("costs", F.col("__k") * n + 1, n).alias("cost"))).alias("__p", "__c"))
    return each.select("scenario", *keys, (F.col("__p") + 1).alias("plan_id"), "__c.stops", "__c.cost")


def ranked(costs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, plan_id, stops, mean, std, p5, p95, rank, delta_vs_best) of costed() rows."""
    zipped = F.arrays_zip(*[F.col(k) for k in ("stops", "mean", "std", "p5", "p95", "rank")], let(F.array_min("mean"), lambda best: F.transform("mean", lambda m: m - best)).alias("delta_vs_best"))
    return costs.select(*keys, F.posexplode(zipped).alias("__k", "__p")).select(*keys, (F.col("__k") + 1).alias("plan_id"), "__p.*")


def gains(costs: DataFrame, keys: list[str]) -> DataFrame:
    """One row a decision of costed() rows that kept a rival: both plans' stops and means, and the gain of the best one on
    common draws."""
    rival = F.col("rival")
    best = F.col("best") - 1
    return costs.filter("gain_mean is not null").select(
        *keys, F.get("stops", rival).alias("actual_stops"), F.get("stops", best).alias("best_stops"), F.get("mean", rival).alias("actual_mean"), F.get("mean", best).alias("best_mean"), F.col("gain_mean").alias("gain"), "gain_low", "gain_high", "win_share",
    )


def backtest_summary(df: DataFrame, gain: str, actual: str, best: str) -> DataFrame:
    """(part, n, win_share, mean_gain, median_gain, p10, p90, actual_stops, best_stops): over all decisions and by whether the
    stops agree."""
    rows = df.withColumn("part", F.explode(F.array(F.lit("all"), F.when(F.col(actual) == F.col(best), "same stops").otherwise("other stops"))))
    plain = rows.groupBy("part").agg(F.count("*").alias("n"), F.avg((F.col(gain) > 0).cast("int")).alias("win_share"), F.avg(gain).alias("mean_gain"), F.avg(actual).alias("actual_stops"), F.avg(best).alias("best_stops"))
    q = exact_quantiles(rows, ["part"], gain, [0.1, 0.5, 0.9]).drop("n")
    return plain.join(q, "part").select("part", "n", "win_share", "mean_gain", F.col("quantiles")[1].alias("median_gain"), F.col("quantiles")[0].alias("p10"), F.col("quantiles")[2].alias("p90"), "actual_stops", "best_stops")


def changed_recommendations(costs: DataFrame, keys: list[str], base: str) -> DataFrame:
    """(variant, n, changed, mean_gain): share of decisions whose best plan is another under a variant's parameters, and the
    mean gain of that plan over the base's rival; costs has (variant, keys, best, mean, rival) of costed() for the base and
    the variants."""
    own = costs.select(*keys, "variant", "best", F.get("mean", F.col("best") - 1).alias("best_mean"), F.get("mean", F.col("rival")).alias("rival_mean"))
    first = lambda c: F.max(F.when(F.col("variant") == base, F.col(c)))
    wide = own.groupBy(*keys).agg(first("best").alias("b"), first("rival_mean").alias("r"), F.collect_list(F.struct("variant", "best", "best_mean")).alias("all"))
    rows = wide.select("b", "r", F.inline("all")).filter(F.col("variant") != base)
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.avg((F.col("best") != F.col("b")).cast("int")).alias("changed"), F.avg(F.col("r") - F.col("best_mean")).alias("mean_gain"))


def stint_residuals(laps: DataFrame, costs: DataFrame, keys: list[str], lap: str, pace: str, least: int = 3) -> DataFrame:
    """(keys, position, compound, start_lap, length, simulated, realised, residual, weight): the rival's stints, simulated
    and as driven; weight is what a drift of one second a lap adds to the residual.

    costs: costed() rows that kept cur_lap and the rival's plan as rival_plan. Stints with fewer than `least` laps of known pace are
    left out.
    """
    c = F.col
    s = costs.filter("parts is not null").select(*keys, "cur_lap", c("rival_plan").alias("plan"), "parts")
    s = s.select(*keys, "cur_lap", "plan", F.posexplode(F.arrays_zip(c("plan").alias("s"), c("parts").alias("t"))).alias("position", "x"))
    start = F.when(c("position") == 0, c("cur_lap")).otherwise(F.get("plan", c("position") - 1)["end_lap"]).cast("int")
    s = s.select(*keys, "cur_lap", "position", c("x.s.compound").alias("compound"), start.alias("start_lap"), c("x.s.end_lap").alias("end_lap"), c("x.t").alias("simulated")).filter("end_lap > start_lap")
    driven = laps.filter(c(pace).isNotNull()).select(*keys, c(lap).alias("__lap"), c(pace).alias("__pace"))
    # Arrays make the planner think these rows small; as a broadcast they would pass whole through the driver.
    real = s.join(driven.hint("merge"), keys).filter((c("__lap") > c("start_lap")) & (c("__lap") <= c("end_lap")))
    real = real.groupBy(*keys, "cur_lap", "position", "compound", "start_lap", "end_lap", "simulated").agg(F.count("*").alias("n"), F.sum("__pace").alias("realised")).filter(c("n") >= least)
    n = c("end_lap") - c("start_lap")
    return real.select(*keys, "position", "compound", "start_lap", n.alias("length"), "simulated", "realised", (c("simulated") - c("realised")).alias("residual"), (n * (0.5 * (c("start_lap") + 1 + c("end_lap")) - (c("cur_lap") - 1))).alias("weight"))


def drift_grid(residuals: DataFrame, drifts: list[float]) -> DataFrame:
    """(drift, n, mean, median, mad) of residual + drift * weight for each drift of a grid; medians exact over any number of
    stints."""
    grid = residuals.select(F.explode(F.array(*[F.lit(d) for d in drifts])).alias("drift"), "residual", "weight").select("drift", (F.col("residual") + F.col("drift") * F.col("weight")).alias("x"))
    middle = exact_quantiles(grid, ["drift"], "x", [0.5]).select("drift", F.col("quantiles")[0].alias("median"))
    # One row a drift of the grid.
    away = grid.join(F.broadcast(middle), "drift").withColumn("d", F.abs(F.col("x") - F.col("median")))
    mad = exact_quantiles(away, ["drift"], "d", [0.5]).select("drift", F.col("quantiles")[0].alias("mad"))
    return grid.groupBy("drift").agg(F.count("*").alias("n"), F.avg("x").alias("mean")).join(middle, "drift").join(mad, "drift").select("drift", "n", "mean", "median", "mad")


def best_drift(grid: DataFrame) -> DataFrame:
    """(drift, mad): the drift of the least spread, 0 unless another is smaller in nine decimals; one row."""
    return grid.agg(F.min(F.struct(F.round("mad", 9).alias("mad"), F.abs("drift").alias("size"), F.col("drift"))).alias("b")).select("b.drift", "b.mad")


def residual_buckets(residuals: DataFrame, drift: DataFrame) -> DataFrame:
    """(dimension, bucket, n, mean_length, mean_start, before, after): mean residuals by length, compound and start lap,
    without and with the drift (one row)."""
    c = F.col
    length = F.when(c("length") <= 12, "a <=12").when(c("length") <= 20, "b 13-20").otherwise("c >20")
    start = F.when(c("start_lap") <= 18, "a <=18").when(c("start_lap") <= 30, "b 19-30").when(c("start_lap") <= 42, "c 31-42").otherwise("d >42")
    rows = residuals.crossJoin(F.broadcast(drift.select("drift"))).withColumn("after", c("residual") + c("drift") * c("weight"))
    rows = rows.select("length", "start_lap", "residual", "after", F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), b.alias("bucket")) for d, b in (("length", length), ("compound", c("compound")), ("start", start))])))
    return rows.groupBy("dimension", "bucket").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"), F.avg("start_lap").alias("mean_start"), F.avg("residual").alias("before"), F.avg("after").alias("after"))


def realised_pace(laps: DataFrame, costs: DataFrame, keys: list[str], lap: str, pace: str, category: str) -> DataFrame:
    """(keys, actual, recommended, gain, first_stop, n_after, actual_compound, best_compound): laps driven from the decision
    on, and the same with the laps from the recommended stop on moved by the offset between the two final compounds.

    costs: costed() rows that kept cur_lap and par. Decisions without laps from the stop on are left out; an
    actual compound without parameters counts as the recommended one.
    """
    c = F.col
    best = costs.select(*keys, "cur_lap", "par", c("best_ends")[0].alias("first_stop"), F.get("par", F.element_at("best_compounds", -1))["compound"].alias("best_compound"))
    j = laps.filter(c(pace).isNotNull()).select(*keys, c(lap).alias("__lap"), c(pace).alias("__pace"), c(category).alias("__category")).hint("merge").join(best, keys).filter(c("__lap") >= c("cur_lap"))
    after = c("__lap") >= c("first_stop")
    s = j.groupBy(*keys, "first_stop", "best_compound").agg(F.first("par").alias("par"), F.sum("__pace").alias("actual"), F.sum(after.cast("int")).alias("n_after"), F.max_by("__category", F.when(after, c("__lap"))).alias("last"))
    s = s.filter("n_after > 0").withColumn("actual_compound", F.when(by_compound(c("par"), c("last")).isNotNull(), c("last")).otherwise(c("best_compound")))
    moved = c("n_after") * (by_compound(c("par"), c("best_compound"))["offset"] - by_compound(c("par"), c("actual_compound"))["offset"])
    return s.select(*keys, "actual", (c("actual") + moved).alias("recommended"), (-moved).alias("gain"), "first_stop", c("n_after").cast("long").alias("n_after"), "actual_compound", "best_compound")


def realised_summary(df: DataFrame) -> DataFrame:
    """One row of realised_pace(): n, win_share, mean_gain, median_gain, p10, p90, agreement of the final compounds."""
    one = df.withColumn("part", F.lit(1))
    plain = one.groupBy("part").agg(F.count("*").alias("n"), F.avg((F.col("gain") > 0).cast("int")).alias("win_share"), F.avg("gain").alias("mean_gain"), F.avg((F.col("actual_compound") == F.col("best_compound")).cast("int")).alias("agreement"))
    q = exact_quantiles(one, ["part"], "gain", [0.1, 0.5, 0.9]).drop("n")
    return plain.join(q, "part").select("n", "win_share", "mean_gain", F.col("quantiles")[1].alias("median_gain"), F.col("quantiles")[0].alias("p10"), F.col("quantiles")[2].alias("p90"), "agreement")
