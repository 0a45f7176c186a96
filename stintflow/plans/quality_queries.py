"""Quality and reconciliation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintflow.operators import fits as T
from stintflow.operators import labels as B
from stintflow.operators import laps as L
from stintflow.operators import profile as P
from stintflow.plans.fit_queries import SLOPES_SQL, slopes
from stintflow.plans.registry import query
from stintflow.plans.roles import LAP_KEYS, LAPS_SQL, SAMPLES_SQL, STINT, laps, samples, table
from stintflow.sources import readers as R


@query("null_rates", f"""WITH {LAPS_SQL}, s AS (SELECT season, count(*) AS n, avg((pace IS NULL)::INT) AS pace, avg((dirty IS NULL)::INT) AS dirty FROM laps GROUP BY season)
SELECT season, n, 'pace' AS "column", round(pace, 5) AS null_rate FROM s UNION ALL SELECT season, n, 'dirty', round(dirty, 5) FROM s""")
def null_rates(spark, sf_dir):
    return P.null_rates(laps(spark, sf_dir), ["season"], ["pace", "dirty"])


@query("null_matrix", f"WITH {LAPS_SQL} SELECT season, round(avg((pace IS NULL)::INT), 5) AS pace, round(avg((flag IS NULL)::INT), 5) AS flag FROM laps GROUP BY season")
def null_matrix(spark, sf_dir):
    return P.null_matrix(laps(spark, sf_dir), "season", ["pace", "flag"])


_NAMES = {"customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey"}


@query("manifest", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", column_name AS \"column\", CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS type, (SELECT count(*) FROM {t}) AS rows FROM (DESCRIBE {t})" for t in _NAMES))
def manifest(spark, sf_dir):
    return P.manifest({t: table(spark, sf_dir, t) for t in _NAMES})


@query("coercion", """WITH r AS (SELECT CASE event_id % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'x' || event_id ELSE value::VARCHAR END AS a, CASE event_id % 4 WHEN 0 THEN NULL ELSE event_type END AS b FROM events)
SELECT 'a' AS "column", count(a) AS n_values, count(*) FILTER (a IS NOT NULL AND CASE WHEN a = 'None' THEN NULL ELSE try_cast(a AS DOUBLE) END IS NULL) AS n_lost FROM r UNION ALL SELECT 'b', count(b), count(*) FILTER (b IS NOT NULL AND try_cast(b AS DOUBLE) IS NULL) FROM r""")
def coercion(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.when(k % 5 == 0, "None").when(k % 5 == 1, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.col("value").cast("string")).alias("a"), F.when(k % 4 != 0, F.col("event_type")).alias("b"))
    return P.coerce(e, {"a": "double", "b": "double"})[1]


def _rules():
    return {"value": F.col("value").between(1, 200), "type": F.col("event_type").isin("click", "view", "purchase", "signup")}


@query("quarantine", "SELECT event_id, list_aggregate(list_filter([CASE WHEN NOT value BETWEEN 1 AND 200 THEN 'value' END, CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'type' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS problems FROM events WHERE NOT (value BETWEEN 1 AND 200 AND event_type IN ('click', 'view', 'purchase', 'signup'))")
def quarantine(spark, sf_dir):
    return P.quarantine(table(spark, sf_dir, "events"), _rules())[1].select("event_id", F.array_join("problems", ",").alias("problems"))


@query("quality_report", "SELECT count(*) AS rows, sum((NOT value BETWEEN 1 AND 200)::INT)::BIGINT AS breaks_value, sum((event_type NOT IN ('click', 'view', 'purchase', 'signup'))::INT)::BIGINT AS breaks_type, sum((props IS NULL)::INT)::BIGINT AS missing_props, sum((event_type IS NOT NULL)::INT)::BIGINT AS not_numeric_event_type FROM events")
def quality_report(spark, sf_dir):
    return P.quality_report(table(spark, sf_dir, "events"), _rules(), ["props"], ["event_type"])


@query("grain", "WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT sum(n)::BIGINT AS rows, count(*) AS unique_keys, 0::BIGINT AS null_keys, sum(n - 1)::BIGINT AS repeated FROM k")
def grain(spark, sf_dir):
    return P.grain(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("slope_reconciliation", f"""WITH {LAPS_SQL}, {SLOPES_SQL}, m AS (SELECT count(*) AS matched FROM slopes)
SELECT 'n' AS "column", matched, 0::BIGINT AS only_a, 0::BIGINT AS only_b, 0::BIGINT AS null_differs, 0::BIGINT AS differs, 0.0::DOUBLE AS max_abs FROM m UNION ALL SELECT 'slope', matched, 0, 0, 0, 0, 0.0::DOUBLE FROM m""")
def slope_reconciliation(spark, sf_dir):
    """The slope by sums against the slope by covariance."""
    df = laps(spark, sf_dir)
    a = slopes(spark, sf_dir).select("driver", "season", "stint", "n", "slope")
    from pyspark.sql import Window

    w = Window.partitionBy("driver", "season", "stint").orderBy("life", "lap")
    x, both = F.col("life").cast("double"), F.col("pace").isNotNull()
    xs, y = F.when(both, x), F.col("pace")
    g = df.withColumn("k", F.row_number().over(w)).filter("k > 3 and flag = 0").groupBy("driver", "season", "stint").agg(F.count("*").alias("n"), F.count(y).alias("m"), F.sum(xs * y).alias("xy"), F.sum(xs).alias("sx"), F.sum(y).alias("sy"), F.sum(x).alias("ax"), F.sum(x * x).alias("axx")).filter("n >= 4")
    cov = F.try_divide(F.col("xy") - F.col("sx") * F.col("sy") / F.col("m"), F.when(F.col("m") > 1, F.col("m") - 1))
    var = (F.col("axx") - F.col("ax") * F.col("ax") / F.col("n")) / (F.col("n") - 1)
    b = g.select("driver", "season", "stint", "n", F.try_divide(cov, var).alias("slope"))
    return P.reconcile(a, b, ["driver", "season", "stint"], 1e-6).withColumn("max_abs", F.round("max_abs", 3))


@query("partial_reconciliation", f"""WITH {SAMPLES_SQL}, k AS (SELECT count(*) AS matched FROM (SELECT DISTINCT driver, lap FROM samples)) SELECT c AS "column", matched, 0::BIGINT AS only_a, 0::BIGINT AS only_b, 0::BIGINT AS null_differs, 0::BIGINT AS differs, 0.0::DOUBLE AS max_abs FROM k, (VALUES ('n_samples'), ('speed_mean'), ('speed_max'), ('speed_min'), ('speed_std')) t(c)""")
def partial_reconciliation(spark, sf_dir):
    s = samples(spark, sf_dir)
    keys = ["driver", "lap"]
    direct = L.lap_statistics(s, keys, distance="position")
    merged = L.finalise_partials(L.merge_partials(L.partials(s, keys, F.pmod("event_id", F.lit(5)), ["speed"]), keys, ["speed"]), keys, ["speed"])
    return P.reconcile(direct, merged, keys, 1e-6).withColumn("max_abs", F.round("max_abs", 3))


@query("multiset_difference", "WITH a AS (SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_tax < 0.05::DOUBLE), b AS (SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_tax > 0.03::DOUBLE) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_b")
def multiset_difference(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return P.multiset_difference(li.filter("l_tax < 0.05D").select("l_returnflag", "l_linenumber"), li.filter("l_tax > 0.03D").select("l_returnflag", "l_linenumber"))


@query("content_hash")
def content_hash(spark, sf_dir):
    return P.content_hash(table(spark, sf_dir, "orders"))


@query("bucket_sizes", """WITH k AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)),
h AS (SELECT k, n, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(k::VARCHAR)), '..'), lambda y: ('0x' || y)::BIGINT)), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) % 8 AS b FROM k, t),
r AS (SELECT l_suppkey AS v, row_number() OVER (ORDER BY l_suppkey) - 1 AS i, count(*) OVER () AS n FROM lineitem), q AS (SELECT list(DISTINCT v) AS b FROM r WHERE i IN (SELECT floor((n - 1) * j / 8 + 0.5)::BIGINT FROM (SELECT count(*) AS n FROM lineitem), range(1, 8) t(j)))
SELECT 'hash' AS layout, b::BIGINT AS bucket, count(*) AS n_keys, sum(n)::BIGINT AS n_rows FROM h GROUP BY 2 UNION ALL SELECT 'range', len(list_filter(b, lambda x: x <= k))::BIGINT, count(*), sum(n)::BIGINT FROM k, q GROUP BY 2 UNION ALL SELECT 'single', 0, count(*), sum(n)::BIGINT FROM k""")
def bucket_sizes(spark, sf_dir):
    return P.bucket_sizes(table(spark, sf_dir, "lineitem"), "l_suppkey", 8)


@query("stale_values", "SELECT count(*) AS n, sum((CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE c_nationkey END <> CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey END)::INT)::BIGINT AS n_stale FROM customer")
def stale_values(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return P.stale(c.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("v")), c.filter("c_custkey % 5 <> 0").select("c_custkey", F.col("c_nationkey").alias("v")), ["c_custkey"], "v")


@query("category_counts", "SELECT l_returnflag, l_linestatus, year(l_shipdate) AS season, count(*) AS n, count(DISTINCT l_suppkey) AS n_drivers FROM lineitem GROUP BY 1, 2, 3")
def category_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("season")).agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("n_drivers"))


@query("json_profile", """SELECT event_type AS kind, key AS field, string_agg(DISTINCT year(ts)::VARCHAR, ',' ORDER BY year(ts)::VARCHAR) AS periods, count(*) AS n, count(*) FILTER (tok) AS n_null_tokens, 0::BIGINT AS n_enveloped, max(CASE WHEN try_cast(val AS DOUBLE) IS NOT NULL THEN 'number' ELSE 'string' END) AS type, min(CASE WHEN NOT tok THEN val END) AS example
FROM (SELECT event_type, ts, key, val, trim(val) IN ('', 'None', 'none', 'null', 'N/A', 'nan') AS tok FROM (SELECT event_type, ts, unnest(json_keys(props)) AS key, props->>unnest(json_keys(props)) AS val FROM events)) GROUP BY 1, 2""")
def json_profile(spark, sf_dir):
    return R.field_profile(table(spark, sf_dir, "events").withColumn("year", F.year("ts")), "event_type", "props", "year")


@query("nested_coercion", """WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'None' WHEN 1 THEN 'x' || event_id WHEN 2 THEN 'inf' WHEN 3 THEN NULL ELSE value::VARCHAR END AS a, unnest(range(0, event_id % 3)) AS i FROM events),
o AS (SELECT CASE event_id % 6 WHEN 0 THEN 'None' WHEN 1 THEN 'x' || event_id WHEN 2 THEN 'inf' WHEN 3 THEN NULL ELSE value::VARCHAR END AS a FROM events),
x AS (SELECT 'doc.value' AS path, a FROM o UNION ALL SELECT 'doc.items.a', a FROM r)
SELECT path, CASE WHEN a = 'None' THEN 'null_token' WHEN a = 'inf' THEN 'nonfinite_to_null' WHEN a LIKE 'x%' THEN 'lost' ELSE 'string_to_double' END AS kind, count(*) AS n FROM x WHERE a IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT 'doc.items.n', 'kept', count(*) FROM r""")
def nested_coercion(spark, sf_dir):
    k = F.col("event_id")
    a = F.when(k % 6 == 0, "None").when(k % 6 == 1, F.concat(F.lit("x"), k.cast("string"))).when(k % 6 == 2, "inf").when(k % 6 == 3, F.lit(None)).otherwise(F.col("value").cast("string"))
    items = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (k % 3).cast("int")), lambda i: F.struct(a.alias("a"), i.alias("n")))
    e = table(spark, sf_dir, "events").select(F.struct(a.alias("value"), items.alias("items")).alias("doc"))
    return P.coerce_nested(e, {"doc.value": "double", "doc.items.a": "double", "doc.items.n": "int"})[1]


def _files(spark, sf_dir):
    """The events of a user's day as a nested telemetry file, some of them broken, without envelope or without arrays."""
    u, day = F.col("user_id"), F.dayofyear("ts")
    e = table(spark, sf_dir, "events").groupBy("user_id", F.year("ts").alias("y"), day.alias("d")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    speed = F.transform("e", lambda x: x["value"])
    whole = F.when(u % 5 == 0, F.to_json(F.struct(speed.alias("speed")))).otherwise(F.to_json(F.struct(F.struct(speed.alias("speed"), F.lit("x").alias("dataKey")).alias("tel"))))
    content = F.when(u % 11 == 0, "{oops").when(u % 13 == 0, "[1]").when(u % 17 == 0, '{"tel": {"dataKey": "x"}}').otherwise(whole)
    path = F.concat(F.lit("/data/"), F.col("y"), F.lit("/Event "), u % 7, F.lit("/Race/D"), u, F.lit("/"), F.col("d"), F.lit("_tel.json"))
    return R.session_keys(e.select(path.alias("path"), content.alias("content")))


_FILES_SQL = """fi AS (SELECT user_id AS u, year(ts) AS y, dayofyear(ts) AS d, '/data/' || year(ts) || '/Event ' || user_id % 7 || '/Race/D' || user_id || '/' || dayofyear(ts) || '_tel.json' AS path FROM events GROUP BY 1, 2, 3),
fk AS (SELECT *, CASE WHEN u % 11 = 0 THEN 'not json' WHEN u % 13 = 0 THEN 'not an object' WHEN u % 17 = 0 THEN 'no arrays' END AS type FROM fi)"""


@query("telemetry_rows", """SELECT year(ts)::VARCHAR AS season, 'Event ' || user_id % 7 AS gp, 'Race' AS session, 'D' || user_id AS driver, dayofyear(ts) AS lap, row_number() OVER (PARTITION BY user_id, year(ts), dayofyear(ts) ORDER BY ts, event_id) - 1 AS place, round(value, 5) AS speed FROM events WHERE user_id % 11 <> 0 AND user_id % 13 <> 0 AND user_id % 17 <> 0""")
def telemetry_rows(spark, sf_dir):
    return R.telemetry(_files(spark, sf_dir)).select("season", "gp", "session", "driver", "lap", "place", "speed")


@query("file_problems", f"WITH {_FILES_SQL} SELECT CASE type WHEN 'no arrays' THEN 'fields' ELSE 'parse' END AS stage, type, count(*) AS n, min(path) AS example FROM fk WHERE type IS NOT NULL GROUP BY 1, 2")
def file_problems(spark, sf_dir):
    return R.problem_summary(R.bad_files(_files(spark, sf_dir).select("path", "content")))


@query("structure_counts", f"WITH {_FILES_SQL} SELECT y::VARCHAR AS season, count(DISTINCT u % 7) AS events, count(DISTINCT u % 7) AS sessions, count(DISTINCT u) AS drivers, count(*) AS telemetry, 0::BIGINT AS lap_times, count(*) FILTER (type = 'no arrays' OR (type IS NULL AND u % 5 <> 0)) AS enveloped FROM fk GROUP BY y")
def structure_counts(spark, sf_dir):
    return R.structure_counts(_files(spark, sf_dir))


@query("model_features", f"WITH {LAPS_SQL} SELECT driver, season, stint, life::BIGINT AS life, lap::BIGINT AS lap, round(pace, 5) AS pace FROM laps")
def model_features(spark, sf_dir):
    labelled = B.remaining_life(laps(spark, sf_dir), STINT, "pace", "life", "flag", "stint").select(*LAP_KEYS, "lap", "pace", "onset", "raw_life", "target_life", "onset_near")
    return P.features(labelled, LAP_KEYS, {"onset", "raw_life", "target_life"})


@query("salted_totals", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 4) AS most FROM events GROUP BY event_type", 4)
def salted_totals(spark, sf_dir):
    from stintflow.operators.keyed import combined

    return combined(table(spark, sf_dir, "events"), ["event_type"], [F.count("*").alias("c"), F.sum("value").alias("s"), F.max("value").alias("m")], [F.sum("c").alias("n"), F.sum("s").alias("total"), F.max("m").alias("most")])


@query("conservation", "SELECT count(*) AS emitted, count(*) AS received, 0::BIGINT AS keys_in_several_rows, 0::BIGINT AS keys_in_several_partitions FROM events")
def conservation(spark, sf_dir):
    from stintflow.operators.keyed import conservation as conserved

    e = table(spark, sf_dir, "events")
    return conserved(e, e.groupBy("user_id").agg(F.count("*").alias("n")), ["user_id"], "n")
