"""Document tables, sets, paging and JSON over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintflow.operators import documents as D
from stintflow.plans.registry import query
from stintflow.plans.roles import table


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


@query("session_documents", """WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS k, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)
SELECT 'C|' || c_custkey AS _id, coalesce(list_aggregate(list_transform(k, lambda x: x::VARCHAR), 'string_agg', ','), '') AS orders, coalesce(n, 0)::BIGINT AS n_orders, total FROM customer LEFT JOIN o ON o_custkey = c_custkey""", 2)
def session_documents(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumnRenamed("o_custkey", "c_custkey")
    base = D.with_id(table(spark, sf_dir, "customer").select("c_custkey", F.lit("C").alias("kind")), ["kind", "c_custkey"])
    docs = D.nested(base, ["c_custkey"], {"orders": (o, ["o_orderkey", "o_totalprice"], ["o_orderdate", "o_orderkey"])})
    docs = docs.join(o.groupBy("c_custkey").agg(F.sum("o_totalprice").alias("total")), "c_custkey", "left")
    return docs.select("_id", F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"), F.size("orders").alias("n_orders"), "total")


def _merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    target = c.filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("_id"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    source = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("_id"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).when(F.col("c_custkey") % 5 != 1, F.col("c_acctbal")).alias("balance"), F.col("c_mktsegment").alias("segment"))
    return target, source


_MERGE_SQL = """t AS (SELECT c_custkey AS _id, c_acctbal AS balance, c_name AS name FROM customer WHERE c_custkey % 4 <> 0), s AS (SELECT c_custkey AS _id, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 WHEN c_custkey % 5 <> 1 THEN c_acctbal END AS balance, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0),
m AS (SELECT coalesce(t._id, s._id) AS _id, coalesce(s.balance, t.balance) AS balance, t.name, s.segment, CASE WHEN s._id IS NULL THEN 'kept' WHEN t._id IS NULL THEN 'inserted' WHEN (s.balance IS NOT NULL AND s.balance IS DISTINCT FROM t.balance) OR s.segment IS NOT NULL THEN 'modified' ELSE 'matched' END AS state FROM t FULL JOIN s ON t._id = s._id)"""


@query("upsert", f"WITH {_MERGE_SQL} SELECT _id, round(balance, 2) AS balance, name, segment, state FROM m", 2)
def upsert(spark, sf_dir):
    return D.upsert(*_merge(spark, sf_dir)).withColumnRenamed("__state", "state")


@query("upsert_counts", f"WITH {_MERGE_SQL} SELECT count(*) FILTER (state IN ('matched', 'modified')) AS matched, count(*) FILTER (state = 'modified') AS modified, count(*) FILTER (state = 'inserted') AS inserted FROM m")
def upsert_counts(spark, sf_dir):
    return D.upsert_counts(D.upsert(*_merge(spark, sf_dir)))


@query("prune", "SELECT c_custkey AS _id, round(c_acctbal, 2) AS balance, c_name AS name FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 3 <> 0", 2)
def prune(spark, sf_dir):
    return D.prune(*_merge(spark, sf_dir))


@query("page", "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100", 2)
def page(spark, sf_dir):
    return D.page(_orders(spark, sf_dir).select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc()], 3, 50, "o_orderkey")


@query("top_laps", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_extendedprice, 2) AS l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25", 2)
def top_laps(spark, sf_dir):
    return D.top(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 25)


@query("first_by_group", "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2", 2)
def first_by_group(spark, sf_dir):
    return D.first_by(_orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2)


@query("thinned", """WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, o_orderkey FROM r WHERE n <= 40 OR r IN (SELECT floor(j * ((n - 1) / 39::DOUBLE))::BIGINT FROM generate_series(0, 39) t(j))""")
def thinned(spark, sf_dir):
    return D.thin_by(_orders(spark, sf_dir).select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority"], [F.col("o_totalprice"), F.col("o_orderkey")], 40).select("o_orderpriority", "o_orderkey")


@query("cookbook", """SELECT 'equal' AS name, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'range', count(*) FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 UNION ALL SELECT 'compound', count(*) FROM orders WHERE o_orderstatus = 'O' AND (o_totalprice > 100000 OR o_orderpriority = '1-URGENT')
UNION ALL SELECT 'member', count(*) FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') UNION ALL SELECT 'exists', count(*) FROM orders WHERE o_orderdate IS NOT NULL UNION ALL SELECT 'not_equal', count(*) FROM orders WHERE o_orderstatus <> 'F'""")
def cookbook(spark, sf_dir):
    c = F.col
    found = {"equal": c("o_orderstatus") == "F", "range": c("o_totalprice").between(1000, 50000), "compound": (c("o_orderstatus") == "O") & ((c("o_totalprice") > 100000) | (c("o_orderpriority") == "1-URGENT")), "member": c("o_orderpriority").isin("1-URGENT", "5-LOW"), "exists": c("o_orderdate").isNotNull(), "not_equal": c("o_orderstatus") != "F"}
    one = _orders(spark, sf_dir).agg(*[F.sum(F.coalesce(p, F.lit(False)).cast("long")).alias(k) for k, p in found.items()])
    return one.unpivot([], list(found), "name", "n")


@query("compounds_used", "SELECT l_suppkey, year(l_shipdate) AS season, list_aggregate(list_sort(list_distinct(list(l_returnflag))), 'string_agg', ',') AS used FROM lineitem WHERE month(l_shipdate) <= 6 AND l_returnflag <> 'N' GROUP BY 1, 2")
def compounds_used(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("season"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("UNKNOWN").alias("c"), F.month("l_shipdate").alias("lap"))
    return D.compounds_used(li, ["l_suppkey", "season"], "c", "lap", F.lit(6)).select("l_suppkey", "season", F.array_join("compounds_used", ",").alias("used")).filter("used <> ''")


@query("guarded_delete", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_totalprice < 5000)")
def guarded_delete(spark, sf_dir):
    return D.guarded_delete(_orders(spark, sf_dir), F.col("o_totalprice") < 5000)[0].select("o_orderkey", "o_orderstatus")


@query("facet_top", "SELECT o_orderkey, o_orderpriority, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5", 2)
def facet_top(spark, sf_dir):
    return D.facet(_orders(spark, sf_dir).filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice", 5)[0]


@query("facet_means", "SELECT o_orderpriority, round(avg(o_totalprice), 3) AS mean, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1", 3)
def facet_means(spark, sf_dir):
    return D.facet(_orders(spark, sf_dir).filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice", 5)[1]


@query("decisions", """WITH d AS (SELECT c_custkey AS _id, 'R' || c_nationkey AS driver, c_mktsegment AS scenario, CASE WHEN c_custkey % 2 = 0 THEN ['SOFT', 'HARD'] ELSE ['MEDIUM'] END AS compounds, c_acctbal AS delta FROM customer)
SELECT _id, driver, round(delta, 2) AS delta FROM d WHERE scenario = 'BUILDING' AND list_contains(compounds, 'SOFT')""", 2)
def decisions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_id"), F.concat(F.lit("R"), F.col("c_nationkey").cast("string")).alias("driver"), F.col("c_mktsegment").alias("scenario"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("SOFT"), F.lit("HARD"))).otherwise(F.array(F.lit("MEDIUM"))).alias("compounds"), F.col("c_acctbal").alias("delta"))
    return D.decision_filter(c, scenario="BUILDING", compound="SOFT").select("_id", "driver", "delta")


@query("props_rows", "SELECT event_type, (props->>'$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def props_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("hierarchy", """SELECT r_name, n_name, year(l_shipdate) AS season, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""", 2)
def hierarchy(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("season")).agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name", "season").agg(F.sum("n").alias("n"), F.sum("revenue").alias("revenue"))
