"""Plan costing over the race view: decisions at the end of a race's first stint, costed with parameters that are fitted to
all stints."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from stintflow.functions.scalars import format_plan
from stintflow.operators import fits as T
from stintflow.operators import intervals as I
from stintflow.operators import labels as B
from stintflow.operators import stints as W
from stintflow.operators import strategy as G
from stintflow.plans.registry import query
from stintflow.plans.roles import LAPS_SQL, RACES_SQL, STINT, laps, races
from stintflow.plans.stint_queries import _onset_sql
from stintflow.sources.tables import stored

K = ["driver", "season"]
DRY, WET, BASE = ["A", "N", "R"], ["W"], "N"
#: Least and largest offset of a compound against the base, and the one without a fit.
PRIORS = {"A": (-2.0, -0.01, -0.35), "R": (0.01, 2.0, 0.35), "W": (3.0, 3.0, 3.0)}
PENALTIES = {"clean": (None, 0.0), "train": ("mult_near", 0.25), "backmarker": ("mult_far", 0.5)}
DRAWS = 250
#: Decisions of a task, about.
DEALT = 500
DRIFTS = [k / 100 for k in range(-8, 9)]


def _decisions(df, include_wet=True):
    executed = G.executed_stints(df, K, "stint", "compound", "lap").join(df.groupBy(*K).agg(F.max("lap").alias("n_laps")), K)
    d = G.decision_points(executed, "n_laps", WET, include_wet).filter("skipped is null")
    return d.select(*K, F.col("decision_lap").alias("cur_lap"), "n_laps", "stints")


class Given:
    """What the plan queries start from. The race view, its stints' slopes, the decisions and the fits are read several
    times each and so stored once."""

    def __init__(self, spark, sf_dir):
        self.spark = spark
        self.races = stored(spark, races(spark, sf_dir), "races")

    @cached_property
    def states(self):
        """Decisions with a known pace; those without one can't be costed."""
        found = G.decision_state(self.races, _decisions(self.races), K, "lap", "stint", "life", "pace", "above_best", "compound", "temp", "cluster", "rain", WET)
        return stored(self.spark, found.filter("base_pace is not null"), "states")

    @cached_property
    def slopes(self):
        return stored(self.spark, T.stint_slopes(self.races, [*K, "stint"], "life", "lap", "pace", "control", means=["dirty", "temp"], firsts=["compound", "cluster"]), "slopes")

    @cached_property
    def parameters(self):
        of = lambda df: df.withColumnRenamed("compound", "compound_first")
        ends = B.onset(self.races, STINT, "pace", "life", "control").groupBy(*K, "stint").agg(F.min_by("compound", "life").alias("compound"), F.max("onset").alias("onset"))
        offsets = T.paired_fit(T.paired_gaps(self.races, K, "compound", BASE, [c for c in DRY if c != BASE], "pace", "temp"), "compound")
        fitted = G.fitted_parameters(T.category_slopes(self.slopes, "compound_first", "slope"), T.spread_of_all(self.slopes), of(T.onset_distribution(ends, "compound", "onset")), of(offsets), "compound_first", [*DRY, *WET], BASE, PRIORS)
        return stored(self.spark, fitted, "parameters")

    @cached_property
    def clusters(self):
        return stored(self.spark, T.group_offsets(self.slopes, "cluster_first").withColumnRenamed("cluster_first", "cluster"), "clusters")

    @cached_property
    def temperature(self):
        return T.temperature_effect(self.slopes, "temp_mean", "slope").crossJoin(F.broadcast(self.slopes.agg(F.avg("temp_mean").alias("mean"))))

    @property
    def scenarios(self):
        points = self.slopes.select(F.col("dirty_mean").alias("x"), (F.col("slope") + 0.3).alias("y"))
        return stored(self.spark, G.scenario_table(T.response(points, "x", "y"), PENALTIES), "scenarios")

    @property
    def hazards(self):
        """(season, lap, hazard) and the lengths of first control periods: a season stands for a circuit."""
        df = self.races
        firsts = W.runs(df.filter("control = 1"), K, "lap").groupBy(*K).agg(F.min(F.struct("first", "length")).alias("f")).select(*K, F.col("f.first").alias("onset"), F.col("f.length").alias("laps"))
        return I.hazards(df.groupBy(*K).agg(F.max("lap").alias("n_laps")), firsts, K, "season"), firsts.select("laps")

    @property
    def dealt(self):
        """States with their pool of compounds. A row becomes thousands of plans with hundreds of draws: dealt over all
        tasks, however few bytes they are, and over more tasks the more decisions there are."""
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.states.count() // DEALT))
        return self.states.repartition(n, *K).withColumn("pool", G.allowed_compounds(F.col("wet"), DRY, WET))

    @property
    def candidates(self):
        return G.candidates(self.dealt, F.col("pool"))

    @property
    def planned(self):
        """States with parameters: their plans are made where they are costed."""
        return G.with_parameters(self.dealt, self.parameters, self.clusters, self.temperature)

    def controlled(self, planned):
        hazards, durations = self.hazards
        return G.with_control(planned, hazards, durations, "season")

    def against_rival(self, control=False, keep=()):
        """Costs of all plans and of the executed one."""
        planned = _rivalled(self.planned)
        return G.costed(self.controlled(planned) if control else planned, K, list(keep), DRAWS, spread=False).withColumn("rival", F.size("stops") - 1)

    @property
    def residuals(self):
        return stored(self.spark, G.stint_residuals(self.races, self.against_rival(keep=["cur_lap", "rival_plan"]), K, "lap", "pace"), "residuals")


def _rivalled(planned):
    """The executed plan as one more plan after all candidates."""
    rival = G.executed_plan(F.col("stints"), F.col("compound"), F.col("cur_lap"), [*DRY, *WET])
    return planned.withColumn("rival_plan", rival).filter(F.size("rival_plan") > 1)


EXECUTED_SQL = """sx AS (SELECT driver, season, stint, arg_min(compound, lap) AS c, min(lap) AS f, max(lap) AS l FROM races GROUP BY 1, 2, 3), ex AS (SELECT driver, season, list({'f': f, 'l': l, 'c': c} ORDER BY f) AS s, max(l) AS n_laps FROM sx GROUP BY 1, 2),
dp AS (SELECT driver, season, n_laps::INT AS n_laps, s, s[1].l::INT AS cur_lap FROM ex WHERE len(s) >= 2 AND s[1].l - s[1].f + 1 >= 4 AND n_laps - s[1].l >= 8 AND s[-1].l >= n_laps - 3)"""
STATES_SQL = f"""{EXECUTED_SQL},
mm AS (SELECT r.*, d.cur_lap, d.n_laps, max(r.lap) OVER (PARTITION BY r.driver, r.season, r.stint) AS ends, max(r.stint) OVER (PARTITION BY r.driver, r.season) AS last FROM races r JOIN dp d USING (driver, season)),
nw AS (SELECT * FROM mm WHERE lap = cur_lap),
s0 AS (SELECT m.driver, m.season, any_value(m.n_laps) AS n_laps, any_value(m.cur_lap) AS cur_lap, any_value(n.compound) AS compound, any_value(n.stint) AS stint_no, (count(*) FILTER (m.stint = n.stint))::INT AS "into", bool_or(n.ends = m.cur_lap AND n.last > n.stint) AS entry, arg_max({{'p': m.pace, 'a': m.above_best}}, m.life) FILTER (m.stint = n.stint AND m.lap < m.cur_lap) AS prev,
  any_value(n.pace) AS pace, any_value(n.above_best) AS above, arg_max(m.pace, m.lap) AS known, coalesce(any_value(n.temp), 36.0) AS temp, any_value(n.cluster) AS cluster, list_sort(list_distinct(list(m.compound))) AS used, max(m.rain) > 0 AS wet FROM mm m JOIN nw n USING (driver, season) WHERE m.lap <= m.cur_lap GROUP BY 1, 2),
st AS (SELECT driver, season, n_laps, cur_lap, compound, stint_no, "into", coalesce(CASE WHEN entry AND prev IS NOT NULL THEN prev.p ELSE pace END, known) AS base_pace, coalesce(CASE WHEN entry AND prev IS NOT NULL THEN prev.a ELSE above END, 0) > 1.5 AS in_cliff, temp, cluster, used, wet FROM s0 WHERE coalesce(CASE WHEN entry AND prev IS NOT NULL THEN prev.p ELSE pace END, known) IS NOT NULL)"""
FITS_SQL = f"""n0 AS (SELECT *, row_number() OVER (PARTITION BY driver, season, stint ORDER BY life NULLS FIRST, lap NULLS FIRST) AS n FROM races),
sl AS (SELECT driver, season, stint, count(*) AS n, covar_samp(pace, CASE WHEN pace IS NOT NULL THEN life::DOUBLE END) / nullif(var_samp(life::DOUBLE), 0) AS slope, avg(dirty) AS dirty_mean, avg(temp) AS temp_mean, arg_min(compound, n) AS compound, arg_min(cluster, n) AS cluster FROM n0 WHERE n > 3 AND coalesce(control, 0) = 0 GROUP BY driver, season, stint HAVING count(*) >= 4),
laps AS (SELECT *, control AS flag FROM races), {_onset_sql()},
rk AS (SELECT compound, slope, row_number() OVER (PARTITION BY compound ORDER BY slope) - 1 AS k, count(*) OVER (PARTITION BY compound) AS m FROM sl WHERE slope IS NOT NULL), al AS (SELECT median(slope) AS med, stddev_samp(slope) AS sd FROM sl),
cs AS (SELECT compound, count(*) AS n, median(slope) AS med, (max(CASE WHEN k = floor((m - 1) * 0.75 + 0.5) THEN slope END) - max(CASE WHEN k = floor((m - 1) * 0.25 + 0.5) THEN slope END)) / 1.349 AS iqr FROM rk GROUP BY compound),
oe AS (SELECT driver, season, stint, arg_min(compound, life) AS compound, max(onset) AS onset FROM o GROUP BY 1, 2, 3),
oc AS (SELECT compound, avg((coalesce(onset, 0) < 3)::INT) AS censored, quantile_cont(CASE WHEN onset >= 3 THEN onset::DOUBLE END, [{", ".join(str(0.05 + 0.9 * k / 24) for k in range(25))}]) AS q FROM oe GROUP BY 1),
gb AS (SELECT driver, season, compound, min(pace) AS best, avg(temp) AS idx FROM races GROUP BY 1, 2, 3), gg AS (SELECT a.compound, a.best - b.best AS gap, a.idx - b.idx AS d FROM gb a JOIN gb b ON a.driver = b.driver AND a.season = b.season AND b.compound = 'N' WHERE a.compound <> 'N' AND a.best - b.best IS NOT NULL AND a.idx - b.idx IS NOT NULL),
pf AS (SELECT compound, least(greatest(CASE WHEN regr_count(gap, d) >= 20 THEN regr_intercept(gap, d) ELSE median(gap) END, -3), 3) AS off FROM gg GROUP BY 1),
par AS (SELECT p.compound, coalesce(cs.n, 0)::BIGINT AS n_stints, CASE WHEN cs.n >= 5 THEN cs.med ELSE al.med END AS beta, CASE WHEN cs.n >= 5 THEN least(greatest(cs.iqr, 0.02), 0.5) ELSE coalesce(al.sd, 0.05) END AS sigma, least(greatest(coalesce(pf.off, p.prior), p.low), p.high) AS off, CASE WHEN cs.n >= 5 THEN coalesce(oc.censored, 1.0) ELSE 1.0 END AS censor, CASE WHEN cs.n >= 5 AND len(oc.q) > 0 THEN oc.q ELSE [20.0::DOUBLE] END AS q
  FROM (VALUES ('A', -2.0::DOUBLE, -0.01::DOUBLE, -0.35::DOUBLE), ('N', 0.0, 0.0, 0.0), ('R', 0.01, 2.0, 0.35), ('W', 3.0, 3.0, 3.0)) p(compound, low, high, prior) LEFT JOIN cs USING (compound) LEFT JOIN oc USING (compound) LEFT JOIN pf USING (compound), al),
co AS (SELECT cluster, median(slope) - (SELECT med FROM al) AS off FROM sl GROUP BY 1 HAVING count(slope) >= 30),
te AS (SELECT coalesce(CASE WHEN count(*) > 50 THEN covar_samp(temp_mean, slope) / nullif(var_pop(temp_mean), 0) END, 0) AS effect FROM sl WHERE temp_mean IS NOT NULL AND slope IS NOT NULL), tm AS (SELECT avg(temp_mean) AS mean FROM sl),
sp AS (SELECT st.*, coalesce(co.off, 0) + te.effect * (temp - tm.mean) AS shift FROM st LEFT JOIN co USING (cluster), te, tm),
rx AS (SELECT dirty_mean AS x, slope + 0.3 AS y FROM sl WHERE slope + 0.3 > 0 AND slope + 0.3 < 1 AND dirty_mean IS NOT NULL), rq AS (SELECT quantile_cont(x, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]) AS e, quantile_cont(x, 0.9) AS near, quantile_cont(x, 0.99) AS far FROM rx),
rb AS (SELECT least(greatest(len(list_filter(e, lambda v: v <= x)) - 1, 0), 7) AS bin, avg(x) AS xm, median(y) AS ym FROM rx, rq GROUP BY 1 HAVING count(*) >= 3), rt AS (SELECT coalesce(median((q.ym - p.ym) / (q.xm - p.xm)), 0) AS slope FROM rb p JOIN rb q ON q.xm - p.xm > 1e-9),
ri AS (SELECT slope, median(ym - slope * xm) AS icpt FROM rb, rt GROUP BY slope), rm AS (SELECT least(greatest((slope * near + icpt) / greatest(icpt, 1e-6), 1.0), 2.5) AS near, least(greatest((slope * far + icpt) / greatest(icpt, 1e-6), 1.0), 2.5) AS far FROM ri, rq),
sce AS (SELECT 'clean' AS scenario, 1.0::DOUBLE AS mult, 0.0::DOUBLE AS pen FROM rm UNION ALL SELECT 'train', near, 0.25 FROM rm UNION ALL SELECT 'backmarker', far, 0.5 FROM rm)"""
PLANS_SQL = """pool AS (SELECT * FROM (VALUES ('A'), ('N'), ('R'), ('W')) t(c)), pl AS (SELECT driver, season, c, CASE c WHEN 'W' THEN 0 WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS i FROM st, pool WHERE wet OR c <> 'W'),
one AS (SELECT driver, season, 1 AS kind, p1, 0 AS p2, c AS c1, '' AS c2, i AS i1, 0 AS i2 FROM (SELECT *, unnest(generate_series(cur_lap + 2, n_laps - 3, 2)) AS p1 FROM st) JOIN pl USING (driver, season) WHERE wet OR len(list_distinct(list_append(used, c))) >= 2),
two AS (SELECT z.driver, z.season, 2 AS kind, p1, p2, a.c AS c1, b.c AS c2, a.i AS i1, b.i AS i2 FROM (SELECT *, unnest(generate_series(p1 + 6, n_laps - 3, 4)) AS p2 FROM (SELECT *, unnest(generate_series(cur_lap + 3, n_laps - 11, 4)) AS p1 FROM st)) z JOIN pl a USING (driver, season) JOIN pl b USING (driver, season) WHERE wet OR len(list_distinct(list_concat(used, [a.c, b.c]))) >= 2),
nz AS (SELECT driver, season FROM one UNION SELECT driver, season FROM two), zero AS (SELECT driver, season, 3 AS kind, 0 AS p1, 0 AS p2, '' AS c1, '' AS c2, 0 AS i1, 0 AS i2 FROM st WHERE wet OR len(used) >= 2 OR (driver, season) NOT IN (SELECT (driver, season) FROM nz)),
plans AS (SELECT driver, season, kind % 3 AS stops, p1, p2, c1, c2, row_number() OVER (PARTITION BY driver, season ORDER BY kind, p1, p2, i1, i2) AS plan_id FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM zero))"""
STINTS_SQL = """ps AS (SELECT driver, season, plan_id, stops, 0 AS place, st.compound AS own, CASE WHEN stops = 0 THEN n_laps ELSE p1 END AS e, cur_lap AS b FROM plans JOIN st USING (driver, season)
  UNION ALL SELECT driver, season, plan_id, stops, 1, c1, CASE WHEN stops = 1 THEN n_laps ELSE p2 END, p1 FROM plans JOIN st USING (driver, season) WHERE stops >= 1 UNION ALL SELECT driver, season, plan_id, stops, 2, c2, n_laps, p2 FROM plans JOIN st USING (driver, season) WHERE stops = 2)"""
EXPECTED_SQL = """pp AS (SELECT sp.driver, sp.season, par.compound, par.beta + sp.shift AS beta, par.sigma, par.off, par.censor, par.q FROM sp, par),
px AS (SELECT ps.*, sp.cur_lap, sp.n_laps, sp.in_cliff, sp.base_pace, ps.e - ps.b AS len, greatest(sp."into" - 1, 0) AS k0, o.beta AS ob, o.off AS oo, CASE WHEN o.censor > 0.5 THEN 1e9 ELSE o.q[(len(o.q) - 1) // 2 + 1] END AS ok, c.beta AS cb, c.off AS co FROM ps JOIN sp USING (driver, season) JOIN pp o ON o.driver = ps.driver AND o.season = ps.season AND o.compound = ps.own JOIN pp c ON c.driver = ps.driver AND c.season = ps.season AND c.compound = sp.compound),
py AS (SELECT *, ob * mult AS b1, base_pace - cb * k0 + CASE WHEN place = 0 THEN 0 ELSE oo - co END + pen AS base, CASE WHEN place = 0 AND in_cliff THEN least(ok - k0, -1) WHEN place = 0 THEN ok - k0 ELSE ok END AS cl FROM px, sce), pz AS (SELECT *, greatest(len - greatest(cl, 0), 0) AS m FROM py),
ec AS (SELECT scenario, driver, season, plan_id, stops, sum(CASE WHEN len > 0 THEN len * base + b1 * len * (len + 1) / 2 + 1.5::DOUBLE * m + 0.15::DOUBLE * m * (m + 1) / 2 + CASE WHEN place = 0 THEN b1 * k0 * len ELSE 0 END ELSE 0 END) + any_value(stops) * 23.0::DOUBLE AS cost FROM pz GROUP BY scenario, driver, season, plan_id, stops)"""


@query("decision_states", f"WITH {RACES_SQL}, {STATES_SQL} SELECT driver, season, n_laps::BIGINT AS n_laps, cur_lap::BIGINT AS cur_lap, compound, stint_no, \"into\"::BIGINT AS \"into\", round(base_pace, 5) AS base_pace, in_cliff::INT::BIGINT AS in_cliff, round(temp, 5) AS temp, cluster::BIGINT AS cluster, list_aggregate(used, 'string_agg', ',') AS used, wet::INT::BIGINT AS wet FROM st")
def decision_states(spark, sf_dir):
    return Given(spark, sf_dir).states.withColumn("used", F.array_join("used", ",")).withColumn("stint_no", F.col("stint_no").cast("long")).select(*K, "n_laps", "cur_lap", "compound", "stint_no", "into", "base_pace", "in_cliff", "temp", "cluster", "used", "wet")


@query("allowed_compounds", f"WITH {RACES_SQL}, {STATES_SQL} SELECT driver, season, n_laps::BIGINT AS n_laps, CASE WHEN wet THEN 'W,A,N,R' ELSE 'A,N,R' END AS pool FROM st")
def allowed_compounds(spark, sf_dir):
    return Given(spark, sf_dir).states.select(*K, "n_laps", F.array_join(G.allowed_compounds(F.col("wet"), DRY, WET), ",").alias("pool"))


@query("candidate_plans", f"""WITH {RACES_SQL}, {STATES_SQL}, {PLANS_SQL}
SELECT driver, season, plan_id, stops::BIGINT AS stops, st.compound || '->' || CASE stops WHEN 0 THEN 'end' WHEN 1 THEN p1 || ' | ' || c1 || '->end' ELSE p1 || ' | ' || c1 || '->' || p2 || ' | ' || c2 || '->end' END AS plan FROM plans JOIN st USING (driver, season)""")
def candidate_plans(spark, sf_dir):
    return G.listed(Given(spark, sf_dir).candidates, [*K, "n_laps"]).select(*K, "plan_id", "stops", format_plan(F.col("plan"), F.col("n_laps")).alias("plan"))


@query("fitted_parameters", f"WITH {RACES_SQL}, {STATES_SQL}, {FITS_SQL} SELECT compound, n_stints, round(beta, 4) + 0.0 AS beta, round(sigma, 4) AS sigma, round(off, 4) + 0.0 AS \"offset\", round(censor, 4) AS censor, round(q[1], 4) AS first, round(q[len(q)], 4) AS last, len(q)::BIGINT AS n_quantiles FROM par", 4)
def fitted_parameters(spark, sf_dir):
    return Given(spark, sf_dir).parameters.select("compound", "n_stints", "beta", "sigma", "offset", "censor", F.col("quantiles")[0].alias("first"), F.element_at("quantiles", -1).alias("last"), F.size("quantiles").alias("n_quantiles"))


@query("scenarios", f"WITH {RACES_SQL}, {STATES_SQL}, {FITS_SQL} SELECT scenario, round(mult, 4) AS beta_mult, round(pen, 4) AS penalty, 21.0::DOUBLE AS pit_loss FROM sce", 4)
def scenarios(spark, sf_dir):
    return Given(spark, sf_dir).scenarios


@query("expected_costs", f"WITH {RACES_SQL}, {STATES_SQL}, {FITS_SQL}, {PLANS_SQL}, {STINTS_SQL}, {EXPECTED_SQL} SELECT scenario, driver, season, plan_id, stops::BIGINT AS stops, round(cost, 3) AS cost FROM ec", 3)
def expected_costs(spark, sf_dir):
    g = Given(spark, sf_dir)
    return G.expected_costs(g.planned, K, g.scenarios)


@query("branch_summary", f"""WITH {RACES_SQL}, {STATES_SQL}, {FITS_SQL}, {PLANS_SQL}, {STINTS_SQL}, {EXPECTED_SQL}, be AS (SELECT * FROM ec QUALIFY row_number() OVER (PARTITION BY scenario, driver, season ORDER BY round(cost, 6), plan_id) = 1)
SELECT driver, season, g.plan_id AS green_plan, round(g.cost, 3) AS green_cost, c.plan_id AS neutral_plan, round(c.cost, 3) AS neutral_cost, round(c.cost - g.cost, 3) + 0.0 AS difference FROM be g JOIN be c USING (driver, season) WHERE g.scenario = 'clean' AND c.scenario = 'backmarker'""", 3)
def branch_summary(spark, sf_dir):
    return G.branch_summary(G.best_of(expected_costs(spark, sf_dir), ["scenario", *K]), K, "clean", "backmarker")


@query("degradation_profile", f"""WITH {RACES_SQL}, {STATES_SQL}, {FITS_SQL}, {PLANS_SQL}, {STINTS_SQL} SELECT driver, season, plan_id, place::BIGINT AS place, own AS compound, (e - b)::BIGINT AS length, round(par.beta + sp.shift, 4) + 0.0 AS beta, round((par.beta + sp.shift) * (e - b), 4) + 0.0 AS loss FROM ps JOIN sp USING (driver, season) JOIN par ON par.compound = ps.own""", 4)
def degradation_profile(spark, sf_dir):
    return G.degradation_profile(Given(spark, sf_dir).planned, K)


@query("executed_stints", f"""WITH {LAPS_SQL}, s AS (SELECT driver, season, stint, min(lap) AS f, max(lap) AS l, count(*) AS n FROM laps GROUP BY 1, 2, 3), e AS (SELECT driver, season, list({{'f': f, 'l': l, 'c': stint}} ORDER BY f) AS s, max(l) AS n_laps FROM s GROUP BY 1, 2)
SELECT driver, season, s[1].l::BIGINT AS decision_lap, len(s) AS n_stints, CASE WHEN len(s) < 2 THEN 'one stint' WHEN s[1].l - s[1].f + 1 < 4 THEN 'short first stint' WHEN n_laps - s[1].l < 8 THEN 'too late' WHEN s[-1].l < n_laps - 3 THEN 'not finished' END AS skipped FROM e""")
def executed_stints(spark, sf_dir):
    df = laps(spark, sf_dir)
    e = G.executed_stints(df, K, "stint", "stint", "lap").join(df.groupBy(*K).agg(F.max("lap").alias("n_laps")), K)
    return G.decision_points(e, "n_laps", ["WET"]).select(*K, "decision_lap", F.size("stints").alias("n_stints"), "skipped")


@query("prerace_states", f"""WITH {LAPS_SQL}, s AS (SELECT season, driver, stint, rain, count(*) AS length, median(pace) AS m FROM laps WHERE pace IS NOT NULL GROUP BY 1, 2, 3, 4), o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY season, driver, stint ORDER BY length DESC, m, rain) = 1),
f AS (SELECT season, stint, m AS field, length AS field_length FROM o QUALIFY row_number() OVER (PARTITION BY season, stint ORDER BY length DESC, m, driver) = 1), d AS (SELECT DISTINCT season, driver FROM laps), n AS (SELECT season, max(lap) AS n_laps, median(temp) AS temp FROM laps GROUP BY season)
SELECT d.season, d.driver, round(coalesce(o.m, f.field), 5) AS base_pace, coalesce(o.length, f.field_length) AS practice_laps, n.n_laps::BIGINT AS n_laps, round(n.temp, 5) AS temp FROM d JOIN f ON f.season = d.season AND f.stint = 'A' JOIN n ON n.season = d.season LEFT JOIN o ON o.season = d.season AND o.driver = d.driver AND o.stint = 'A'""")
def prerace_states(spark, sf_dir):
    df = laps(spark, sf_dir)
    priors = T.longest_stint_prior(df, ["season"], "driver", "stint", ["rain"], "pace")
    distances = df.groupBy("season").agg(F.max("lap").alias("n_laps"), F.median("temp").alias("temp"))
    return G.prerace_state(priors, distances, ["season"], "driver", "stint", "A").select("season", "driver", "base_pace", "practice_laps", "n_laps", "temp")


_HAZARDS_SQL = """ch AS (SELECT driver, season, lap, lap - row_number() OVER (PARTITION BY driver, season ORDER BY lap) AS g FROM races WHERE control = 1), cr AS (SELECT driver, season, min(lap) AS f, count(*) AS n FROM ch GROUP BY driver, season, g), cf AS (SELECT driver, season, min(f) AS onset, arg_min(n, f) AS laps FROM cr GROUP BY 1, 2),
le AS (SELECT list_sort(list_distinct(list(laps)))::INT[] AS lens FROM cf), hr AS (SELECT driver, season, max(lap) AS n FROM races GROUP BY 1, 2), hx AS (SELECT season, onset, unnest(generate_series(1, coalesce(onset, n))) AS lap FROM hr LEFT JOIN cf USING (driver, season)),
hz AS (SELECT season, lap, sum((coalesce(lap = onset, false))::INT) / count(*) AS h FROM hx GROUP BY 1, 2), hc AS (SELECT season, list(1 - s ORDER BY lap) AS cdf FROM (SELECT season, lap, product(1 - h) OVER (PARTITION BY season ORDER BY lap) AS s FROM hz) GROUP BY 1)"""


@query("control_onsets", f"WITH {RACES_SQL}, {_HAZARDS_SQL} SELECT season, unnest(range(1, len(cdf) + 1)) AS lap, round(unnest(cdf), 4) + 0.0 AS onset_by, (SELECT list_aggregate(lens, 'string_agg', ',') FROM le) AS lengths FROM hc", 4)
def control_onsets(spark, sf_dir):
    hazards, durations = Given(spark, sf_dir).hazards
    lists = durations.agg(F.array_join(F.array_sort(F.collect_set("laps")), ",").alias("lengths"))
    rows = G.onset_distributions(hazards, "season").select("season", F.posexplode("onset_by").alias("k", "onset_by"))
    return rows.crossJoin(F.broadcast(lists)).select("season", (F.col("k") + 1).cast("long").alias("lap"), "onset_by", "lengths")


def _part(k: int) -> str:
    return f"((('0x' || substr(h, {8 * k + 1}, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0)"


#: Draws by decision and stint; a stint of a decision is costed once, as a list over the draws, and plans add up lists.
_DRAWN_SQL = f"""dh AS (SELECT driver, season, place, draw, md5(concat_ws('|', 's', driver, season, draw, place)) AS h FROM (SELECT driver, season FROM st), range(0, 4) p(place), range(1, {DRAWS + 1}) t(draw)),
dz AS (SELECT driver, season, place, list(sqrt(-2 * ln({_part(0)})) * cos(2 * pi() * {_part(1)}) ORDER BY draw) AS z, list({_part(2)} ORDER BY draw) AS u, list({_part(3)} ORDER BY draw) AS q FROM dh GROUP BY 1, 2, 3),
dv AS (SELECT driver, season, list({_part(0)} ORDER BY draw) AS v, list({_part(1)} ORDER BY draw) AS w FROM (SELECT driver, season, draw, md5(concat_ws('|', 's', driver, season, draw, 'control')) AS h FROM (SELECT driver, season FROM st), range(1, {DRAWS + 1}) t(draw)) GROUP BY 1, 2),
db AS (SELECT pp.driver, pp.season, pp.compound, place, pp.off, list_transform(z, lambda x: least(greatest(beta + sigma * x, 0.005::DOUBLE), least(greatest(beta, 0) * 4 + 0.15::DOUBLE, 1.0))) AS bs, list_transform(list_zip(dz.u, dz.q), lambda x: CASE WHEN x[1] < censor THEN 1e9 ELSE pp.q[floor(x[2] * len(pp.q))::INT + 1] END) AS cs FROM pp JOIN dz USING (driver, season)),
ds AS (SELECT DISTINCT driver, season, place, own, b, e FROM ps),
dj AS (SELECT ds.driver, ds.season, ds.place, own, b, e, (e - b)::DOUBLE AS n, greatest("into" - 1, 0)::DOUBLE AS k0, base_pace AS pace, CASE WHEN ds.place = 0 THEN 0 ELSE o.off - c.off END AS d, CASE WHEN ds.place = 0 THEN greatest("into" - 1, 0) ELSE 0 END::DOUBLE AS k1, CASE WHEN ds.place = 0 AND in_cliff THEN -1 ELSE 1e9 END::DOUBLE AS most, list_zip(c.bs, o.bs, o.cs) AS x
  FROM ds JOIN st USING (driver, season) JOIN db o ON o.driver = ds.driver AND o.season = ds.season AND o.place = ds.place AND o.compound = own JOIN db c ON c.driver = ds.driver AND c.season = ds.season AND c.place = 0 AND c.compound = st.compound),
dm AS (SELECT * EXCLUDE (x), list_transform(x, lambda y: {{'a': y[1], 'b': y[2], 'm': greatest(n - greatest(least(y[3] - k1, most), 0), 0)}}) AS x FROM dj),
dc AS (SELECT driver, season, place, own, b, e, list_transform(x, lambda y: CASE WHEN n <= 0 THEN 0 ELSE n * (pace - y.a * k0 + d) + y.b * n * (n + 1) / 2 + y.b * k1 * n + 1.5::DOUBLE * y.m + 0.075::DOUBLE * y.m * (y.m + 1) END) AS costs FROM dm)"""
_CONTROL_SQL = """c0 AS (SELECT driver, season, v, w, cdf[1:n_laps] AS cdf, lens FROM dv JOIN st USING (driver, season) JOIN hc USING (season), le), cw AS (SELECT driver, season, list_transform(list_transform(v, lambda x: len(list_filter(cdf, lambda y: y <= x))), lambda x: CASE WHEN x >= len(cdf) THEN 1e9 ELSE x + 1 END) AS f, list_transform(w, lambda x: lens[floor(x * len(lens))::INT + 1]) AS k FROM c0)"""
_NO_CONTROL_SQL = f"cw AS (SELECT driver, season, list_transform(v, lambda x: 1e9) AS f, list_transform(v, lambda x: 1) AS k FROM dv)"
_TOTALS_SQL = f"""pc AS (SELECT p.driver, p.season, p.plan_id, p.stops, list_transform(list_zip(a.costs, b.costs, c.costs, d.costs, cw.f, cw.k), lambda x: x[1] + coalesce(x[2], 0) + coalesce(x[3], 0) + coalesce(x[4], 0) + {' + '.join(f'CASE WHEN p.stops >= {k} THEN 2 + CASE WHEN p.e{k} >= x[5] AND p.e{k} <= x[5] + x[6] - 1 THEN 7 ELSE 21 END ELSE 0 END' for k in (1, 2, 3))}) AS costs
  FROM (SELECT driver, season, plan_id, any_value(stops) AS stops, max(CASE WHEN place = 0 THEN own END) AS o0, max(CASE WHEN place = 1 THEN own END) AS o1, max(CASE WHEN place = 2 THEN own END) AS o2, max(CASE WHEN place = 3 THEN own END) AS o3, max(CASE WHEN place = 0 THEN b END) AS b0, max(CASE WHEN place = 0 THEN e END) AS e1, max(CASE WHEN place = 1 THEN e END) AS e2, max(CASE WHEN place = 2 THEN e END) AS e3, max(CASE WHEN place = 3 THEN e END) AS e4 FROM ps GROUP BY 1, 2, 3) p
  JOIN cw USING (driver, season) JOIN dc a ON a.driver = p.driver AND a.season = p.season AND a.place = 0 AND a.own = o0 AND a.b = b0 AND a.e = e1 LEFT JOIN dc b ON b.driver = p.driver AND b.season = p.season AND b.place = 1 AND b.own = o1 AND b.b = e1 AND b.e = e2
  LEFT JOIN dc c ON c.driver = p.driver AND c.season = p.season AND c.place = 2 AND c.own = o2 AND c.b = e2 AND c.e = e3 LEFT JOIN dc d ON d.driver = p.driver AND d.season = p.season AND d.place = 3 AND d.own = o3 AND d.b = e3 AND d.e = e4),
pk AS (SELECT driver, season, plan_id, stops, costs, list_avg(costs) AS mean, list_stddev_pop(costs) AS std, list_sort(costs) AS s FROM pc)"""


@query("ranked_plans", f"""WITH {RACES_SQL}, {STATES_SQL}, {FITS_SQL}, {PLANS_SQL}, {STINTS_SQL}, {EXPECTED_SQL}, {_HAZARDS_SQL}, {_DRAWN_SQL}, {_CONTROL_SQL}, {_TOTALS_SQL}
SELECT driver, season, plan_id, stops::BIGINT AS stops, round(mean, 3) AS mean, round(std, 3) AS std, round(s[13] + 0.45::DOUBLE * (s[14] - s[13]), 3) AS p5, round(s[237] + 0.55::DOUBLE * (s[238] - s[237]), 3) AS p95, row_number() OVER (PARTITION BY driver, season ORDER BY round(mean, 6), plan_id) AS rank, round(mean - min(mean) OVER (PARTITION BY driver, season), 3) + 0.0 AS delta_vs_best FROM pk""", 3)
def ranked_plans(spark, sf_dir):
    g = Given(spark, sf_dir)
    return G.ranked(G.costed(g.controlled(g.planned), K, [], DRAWS), K)


_RIVAL_SQL = """rp AS (SELECT driver, season, list_filter(s[2:], lambda x: x.c IN ('A', 'N', 'R', 'W')) AS s, st.compound, st.cur_lap FROM dp JOIN st USING (driver, season) WHERE len(list_filter(s[2:], lambda x: x.c IN ('A', 'N', 'R', 'W'))) > 0),
p0 AS (SELECT * FROM ps_plans JOIN (SELECT driver, season FROM rp) USING (driver, season) UNION ALL SELECT driver, season, 0, len(s), 0, compound, cur_lap, cur_lap FROM rp UNION ALL SELECT driver, season, 0, len(s), k, s[k].c, s[k].l::INT, CASE WHEN k = 1 THEN cur_lap ELSE s[k - 1].l::INT END FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM rp)), ps AS (SELECT * FROM p0)"""
_GAINS_SQL = """bp AS (SELECT * FROM pk WHERE plan_id > 0 QUALIFY row_number() OVER (PARTITION BY driver, season ORDER BY round(mean, 6), plan_id) = 1),
ga AS (SELECT b.driver, b.season, a.stops AS actual_stops, b.stops AS best_stops, a.mean AS actual_mean, b.mean AS best_mean, b.plan_id, list_sort(list_transform(list_zip(a.costs, b.costs), lambda x: x[1] - x[2])) AS g FROM bp b JOIN pk a ON a.driver = b.driver AND a.season = b.season AND a.plan_id = 0)"""


def _rival_sql(control: bool) -> str:
    return f"WITH {RACES_SQL}, {STATES_SQL}, {FITS_SQL}, {PLANS_SQL}, {STINTS_SQL.replace('ps AS', 'ps_plans AS', 1)}, {_RIVAL_SQL}, {EXPECTED_SQL}, {_HAZARDS_SQL}, {_DRAWN_SQL}, {_CONTROL_SQL if control else _NO_CONTROL_SQL}, {_TOTALS_SQL}, {_GAINS_SQL}"


@query("paired_plans", f"""{_rival_sql(True)} SELECT driver, season, actual_stops::BIGINT AS actual_stops, best_stops::BIGINT AS best_stops, round(actual_mean, 3) AS actual_mean, round(best_mean, 3) AS best_mean, round(list_avg(g), 3) + 0.0 AS gain, round(g[13] + 0.45::DOUBLE * (g[14] - g[13]), 3) + 0.0 AS gain_low, round(g[237] + 0.55::DOUBLE * (g[238] - g[237]), 3) + 0.0 AS gain_high, round(len(list_filter(g, lambda x: x > 0)) / 250, 3) AS win_share FROM ga""", 3)
def paired_plans(spark, sf_dir):
    return G.gains(Given(spark, sf_dir).against_rival(control=True), K)


def _backtest_sql(control: bool) -> str:
    return f"""{_rival_sql(control)}, bx AS (SELECT 'all' AS part, list_avg(g) AS gain, * FROM ga UNION ALL SELECT CASE WHEN actual_stops = best_stops THEN 'same stops' ELSE 'other stops' END, list_avg(g), * FROM ga)
SELECT part, count(*) AS n, round(avg((gain > 0)::INT), 4) AS win_share, round(avg(gain), 3) + 0.0 AS mean_gain, round(median(gain), 3) + 0.0 AS median_gain, round(quantile_cont(gain, 0.1), 3) + 0.0 AS p10, round(quantile_cont(gain, 0.9), 3) + 0.0 AS p90, round(avg(actual_stops), 3) AS actual_stops, round(avg(best_stops), 3) AS best_stops FROM bx GROUP BY part"""


@query("backtest", _backtest_sql(False).replace("(gain > 0)::INT), 4)", "(gain > 0)::INT), 3)"), 3)
def backtest(spark, sf_dir):
    return G.backtest_summary(stored(spark, G.gains(Given(spark, sf_dir).against_rival(), K), "gains"), "gain", "actual_stops", "best_stops")


@query("backtest_control", _backtest_sql(True).replace("(gain > 0)::INT), 4)", "(gain > 0)::INT), 3)"), 3)
def backtest_control(spark, sf_dir):
    return G.backtest_summary(stored(spark, G.gains(Given(spark, sf_dir).against_rival(control=True), K), "gains"), "gain", "actual_stops", "best_stops")


_RESIDUALS_SQL = f"""{_rival_sql(False)}, rr AS (SELECT ps.driver, ps.season, ps.place, own, b, e, list_avg(dc.costs) AS simulated FROM ps JOIN ga USING (driver, season) JOIN dc USING (driver, season, place, own, b, e) WHERE ps.plan_id = 0 AND e > b),
rz AS (SELECT rr.driver, rr.season, rr.place, own, b, e, any_value(simulated) AS simulated, sum(pace) AS realised, any_value(cur_lap) AS cur_lap FROM rr JOIN st USING (driver, season) JOIN races r ON r.driver = rr.driver AND r.season = rr.season AND r.lap > b AND r.lap <= e WHERE pace IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) >= 3),
rs AS (SELECT *, simulated - realised AS residual, (e - b) * (0.5 * (b + 1 + e) - (cur_lap - 1)) AS weight FROM rz)"""
_GRID_SQL = f"""gr AS (SELECT k / 100.0::DOUBLE AS drift, residual + k / 100.0::DOUBLE * weight AS x FROM rs, range(-8, 9) t(k)), gm AS (SELECT drift, count(*) AS n, avg(x) AS mean, median(x) AS med FROM gr GROUP BY 1), gd AS (SELECT drift, any_value(gm.n) AS n, any_value(gm.mean) AS mean, any_value(gm.med) AS med, median(abs(x - gm.med)) AS mad FROM gr JOIN gm USING (drift) GROUP BY 1)"""


@query("calibration", f"{_RESIDUALS_SQL}, {_GRID_SQL} SELECT drift, n, round(mean, 3) + 0.0 AS mean, round(med, 3) + 0.0 AS median, round(mad, 3) AS mad FROM gd", 3)
def calibration(spark, sf_dir):
    return G.drift_grid(Given(spark, sf_dir).residuals, DRIFTS)


@query("calibration_buckets", f"""{_RESIDUALS_SQL}, {_GRID_SQL}, bd AS (SELECT drift FROM gd ORDER BY round(mad, 9), abs(drift), drift LIMIT 1),
bk AS (SELECT e - b AS len, b AS start, residual, residual + drift * weight AS after, unnest(['length', 'compound', 'start']) AS dimension, unnest([CASE WHEN e - b <= 12 THEN 'a <=12' WHEN e - b <= 20 THEN 'b 13-20' ELSE 'c >20' END, own, CASE WHEN b <= 18 THEN 'a <=18' WHEN b <= 30 THEN 'b 19-30' WHEN b <= 42 THEN 'c 31-42' ELSE 'd >42' END]) AS bucket FROM rs, bd)
SELECT dimension, bucket, count(*) AS n, round(avg(len), 3) AS mean_length, round(avg(start), 3) AS mean_start, round(avg(residual), 3) + 0.0 AS before, round(avg(after), 3) + 0.0 AS after FROM bk GROUP BY 1, 2""", 3)
def calibration_buckets(spark, sf_dir):
    r = Given(spark, sf_dir).residuals
    return G.residual_buckets(r, G.best_drift(G.drift_grid(r, DRIFTS)))


_REALISED_SQL = f"""{_rival_sql(False)}, bl AS (SELECT bp.driver, bp.season, st.cur_lap, max(CASE WHEN place = 0 THEN e END) AS first, arg_max(own, place) AS rec FROM bp JOIN ps USING (driver, season, plan_id) JOIN st USING (driver, season) GROUP BY 1, 2, 3),
ra AS (SELECT driver, season, any_value(first) AS first, any_value(rec) AS rec, sum(pace) AS actual, count(*) FILTER (lap >= first) AS n_after, arg_max(compound, lap) FILTER (lap >= first) AS act FROM races JOIN bl USING (driver, season) WHERE lap >= cur_lap AND pace IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (lap >= first) > 0),
rg AS (SELECT ra.*, n_after * (p.off - q.off) AS moved FROM ra JOIN par p ON p.compound = rec JOIN par q ON q.compound = act)"""


def _realised(spark, sf_dir):
    g = Given(spark, sf_dir)
    return G.realised_pace(g.races, g.against_rival(keep=["cur_lap", "par"]), K, "lap", "pace", "compound")


@query("realised_pace", f"{_REALISED_SQL} SELECT driver, season, round(actual, 3) AS actual, round(actual + moved, 3) AS recommended, round(-moved, 3) + 0.0 AS gain, first::BIGINT AS first_stop, n_after, act AS actual_compound, rec AS best_compound FROM rg", 3)
def realised_pace(spark, sf_dir):
    return _realised(spark, sf_dir)


@query("realised_backtest", f"{_REALISED_SQL} SELECT count(*) AS n, round(avg((-moved > 0)::INT), 3) AS win_share, round(avg(-moved), 3) + 0.0 AS mean_gain, round(median(-moved), 3) + 0.0 AS median_gain, round(quantile_cont(-moved, 0.1), 3) + 0.0 AS p10, round(quantile_cont(-moved, 0.9), 3) + 0.0 AS p90, round(avg((act = rec)::INT), 3) AS agreement FROM rg", 3)
def realised_backtest(spark, sf_dir):
    return G.realised_summary(stored(spark, _realised(spark, sf_dir), "realised"))


@query("ablation", places=3)
def ablation(spark, sf_dir):
    """Without cliffs, without offsets of the compounds, and without those of the clusters, against the whole model."""
    g = Given(spark, sf_dir)
    plans = _rivalled(g.dealt)
    par, clusters, temp = g.parameters, g.clusters, g.temperature
    shifted = G.with_parameters(plans, par, clusters, temp)
    alone = G.with_parameters(shifted.withColumnRenamed("par", "whole"), par, None, temp).withColumnRenamed("par", "no_clusters")
    bare = F.transform("whole", lambda p: p.withField("offset", F.lit(0.0)))
    planned = alone.withColumns({"par": F.col("whole"), "no_offsets": bare})
    variants = {"whole": ("whole", G.CLIFF_JUMP, G.CLIFF_SLOPE), "no_cliff": ("whole", 0.0, 0.0), "no_offsets": ("no_offsets", G.CLIFF_JUMP, G.CLIFF_SLOPE), "no_clusters": ("no_clusters", G.CLIFF_JUMP, G.CLIFF_SLOPE)}
    return G.changed_recommendations(G.costed_variants(planned, K, variants, DRAWS), K, "whole")
