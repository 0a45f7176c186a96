"""The given tables in the roles that the operators need, for Spark and as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintflow.operators.stints import Stint

STINT = Stint(("driver", "season", "stint"), ("life",))
LAP_KEYS = ["driver", "season", "stint", "life"]
LAPS_A_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as laps: a supplier's year is a race, a return flag a stint; life and lap are running numbers.

    Races are dealt once, over more tasks the more laps there are: windows by stint or race need no further shuffle, and the
    rows that a task sorts don't grow with the table.
    """
    c = F.col
    df = table(spark, sf_dir, "lineitem")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // LAPS_A_TASK))
    df = df.select(
        c("l_suppkey").alias("driver"), F.year("l_shipdate").alias("season"), c("l_returnflag").alias("stint"), "l_shipdate", "l_orderkey", "l_linenumber",
        F.when(c("l_discount") != 0, F.lit(80.0) + F.lit(0.2) * c("l_quantity")).alias("pace"), (c("l_tax") >= 0.07).cast("int").alias("flag"), (c("l_linestatus") == "O").cast("int").alias("rain"), c("l_discount").alias("dirty"), c("l_tax").alias("temp"), c("l_extendedprice").alias("load"), c("l_partkey").alias("part"),
    ).repartition(n, "driver", "season")
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    df = df.withColumn("life", F.row_number().over(Window.partitionBy("driver", "season", "stint").orderBy(*order))).withColumn("lap", F.row_number().over(Window.partitionBy("driver", "season").orderBy(*order)))
    return df.drop("l_shipdate", "l_orderkey", "l_linenumber")


LAPS_SQL = """laps AS (
  SELECT l_suppkey AS driver, year(l_shipdate) AS season, l_returnflag AS stint,
         CASE WHEN l_discount <> 0 THEN 80.0::DOUBLE + 0.2::DOUBLE * l_quantity END AS pace,
         (l_tax >= 0.07::DOUBLE)::INT AS flag, (l_linestatus = 'O')::INT AS rain, l_discount AS dirty, l_tax AS temp,
         l_extendedprice AS load, l_partkey AS part,
         (row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate), l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber))::INT AS life,
         (row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber))::INT AS lap
  FROM lineitem)"""


def races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as races with contiguous stints: a supplier's year is a race, its quarters are the stints, whose compounds
    follow from supplier, year and quarter. A lap is under control if one of the last three sets off a period."""
    c = F.col
    race = Window.partitionBy("driver", "season")
    df = table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("driver"), F.year("l_shipdate").alias("season"), F.quarter("l_shipdate").alias("stint"), "l_shipdate", "l_orderkey", "l_linenumber", F.when(c("l_discount") != 0, F.lit(80.0) + F.lit(0.2) * c("l_quantity")).alias("pace"),
        (c("l_linestatus") == "O").cast("int").alias("rain"), c("l_discount").alias("dirty"), c("l_tax").alias("temp"), (c("l_suppkey") % 5).cast("int").alias("cluster"), ((c("l_tax") >= 0.08) & (c("l_discount") >= 0.1)).cast("int").alias("trigger"),
    )
    df = df.withColumn("compound", F.element_at(F.array(*[F.lit(x) for x in "ANR"]), ((c("driver") + c("season") + c("stint")) % 3 + 1).cast("int")))
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    # Quarters follow each other, so a race in this order is its stints in theirs: one sort serves all windows.
    raced, own = race.orderBy("stint", *order), Window.partitionBy("driver", "season", "stint").orderBy(*order)
    df = df.withColumns({"lap": F.row_number().over(raced), "life": F.row_number().over(own), "control": F.max("trigger").over(raced.rowsBetween(-2, 0))})
    best = F.min("pace").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("above_best", c("pace") - best).drop(*order, "trigger")


RACES_SQL = """r0 AS (
  SELECT l_suppkey AS driver, year(l_shipdate) AS season, quarter(l_shipdate) AS stint, CASE WHEN l_discount <> 0 THEN 80.0::DOUBLE + 0.2::DOUBLE * l_quantity END AS pace, (l_linestatus = 'O')::INT AS rain, l_discount AS dirty, l_tax AS temp,
         (l_suppkey % 5)::INT AS cluster, ['A', 'N', 'R'][(l_suppkey + year(l_shipdate) + quarter(l_shipdate)) % 3 + 1] AS compound,
         (row_number() OVER r)::INT AS lap, (row_number() OVER s)::INT AS life, max((l_tax >= 0.08 AND l_discount >= 0.1)::INT) OVER (PARTITION BY l_suppkey, year(l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS control
  FROM lineitem WINDOW r AS (PARTITION BY l_suppkey, year(l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber), s AS (PARTITION BY l_suppkey, year(l_shipdate), quarter(l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber)),
races AS (SELECT *, pace - min(pace) OVER (PARTITION BY driver, season, stint ORDER BY life) AS above_best FROM r0)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples: a user's six-day block is a lap; the event type says which channel a value belongs to."""
    c = F.col
    day = F.floor(F.unix_date(F.to_date("ts")) / 6).cast("int")
    return table(spark, sf_dir, "events").select(
        c("user_id").alias("driver"), day.alias("lap"), "ts", c("event_id"), c("value").alias("speed"),
        F.when(c("event_type").isin("click", "view"), c("value")).alias("throttle"), F.when(c("event_type") == "purchase", c("value")).otherwise(F.lit(0.0)).alias("brake"), F.when(c("event_type") == "error", 1.0).otherwise(0.0).alias("drs"),
        (c("value") / 10).alias("gap"), (c("value") - 50).alias("acc"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("position"), "event_type",
    )


SAMPLES_SQL = """samples AS (
  SELECT user_id AS driver, (date_diff('day', DATE '1970-01-01', ts::DATE) // 6)::INT AS lap, ts, event_id, value AS speed,
         CASE WHEN event_type IN ('click', 'view') THEN value END AS throttle,
         CASE WHEN event_type = 'purchase' THEN value ELSE 0.0::DOUBLE END AS brake,
         CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS drs,
         value / 10 AS gap, value - 50 AS acc, (props->>'$.k')::DOUBLE / 100 AS position, event_type
  FROM events)"""


def rounded(df: DataFrame, places: int = 5) -> DataFrame:
    """Doubles rounded for comparison between engines, with no negative zero; longs for all whole numbers.

    The factor moves exact halves, which engines round differently, off the middle."""
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append((F.round(c * F.lit(1.00000000001), places) + F.lit(0.0)).alias(f.name) if kind in ("double", "float") else c.cast("long").alias(f.name) if kind in ("int", "smallint", "tinyint") else c.cast("int").cast("long").alias(f.name) if kind == "boolean" else c)
    return df.select(*out)
