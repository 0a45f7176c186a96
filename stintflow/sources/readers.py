"""Readers of nested JSON files: dictionaries of parallel arrays become rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stintflow.functions.scalars import NULL_TOKENS, as_string, first_number, typed
from stintflow.sources import schemas


def raw_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, content) of whole files, one row each; Spark packs small files into tasks."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", recursive).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def session_keys(files: DataFrame, years: list[str] | None = None, sessions: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """files with season, gp, session, driver, lap and file from .../season/gp/session[/driver]/name.json.

    Paths that don't have a year where the season belongs are left out. limit keeps the first sessions by name.
    """
    p = F.split(F.url_decode(F.regexp_replace(F.col("path"), r"\+", "%2B")), "/")
    at = F.array_position(F.transform(p, lambda x: x.rlike("^(19|20)[0-9]{2}$")), True)
    df = files.withColumn("__p", p).withColumn("__at", at.cast("int")).filter(F.col("__at") > 0)
    part = lambda k: F.get(F.col("__p"), F.col("__at") - 1 + k)
    name = F.element_at("__p", -1)
    df = df.withColumns({"season": part(0), "gp": part(1), "session": part(2), "driver": F.when(F.size("__p") - F.col("__at") > 3, part(3)), "file": name, "lap": first_number(name)}).drop("__p", "__at")
    df = df.filter(~F.col("gp").rlike("^[._]") & ~F.lower("gp").contains("testing"))
    if years:
        df = df.filter(F.col("season").isin(years))
    if sessions:
        df = df.filter(F.col("session").isin(sessions))
    if limit is not None:
        first = df.select("season", "gp", "session").distinct().orderBy("season", "gp", "session").limit(limit)
        df = df.join(F.broadcast(first), ["season", "gp", "session"], "left_semi")
    return df


def columnar_rows(files: DataFrame, fields: dict[str, str], keys: list[str], envelope: str | None = None, content: str = "content") -> DataFrame:
    """(keys, fields): one row per place of the file's parallel arrays.

    The envelope, if there, is unwrapped; arrays are cut to the shortest that is there; fields that are missing, or no
    arrays, are typed nulls; fields that aren't listed fall away; values that don't fit become null.
    """
    arrays = T.StructType([T.StructField(f, T.ArrayType(T.StringType())) for f in fields])
    schema = T.StructType([*arrays.fields, *([T.StructField(envelope, arrays)] if envelope else [])])
    df = files.withColumn("__j", F.from_json(content, schema, {"mode": "PERMISSIVE"}))
    inner = F.when(F.col(f"__j.{envelope}").isNotNull(), F.col(f"__j.{envelope}")).otherwise(F.struct(*[F.col(f"__j.{f}").alias(f) for f in fields])) if envelope else F.struct(*[F.col(f"__j.{f}").alias(f) for f in fields])
    df = df.withColumn("__a", inner)
    shortest = F.array_min(F.filter(F.array(*[F.when(F.col(f"__a.{f}").isNotNull(), F.size(f"__a.{f}")) for f in fields]), lambda n: n.isNotNull()))
    cut = F.arrays_zip(*[F.slice(F.coalesce(F.col(f"__a.{f}"), F.array().cast("array<string>")), F.lit(1), F.coalesce(shortest, F.lit(0))).alias(f) for f in fields])
    rows = df.select(*keys, F.posexplode(cut).alias("place", "r"))
    return rows.select(*keys, "place", *[typed(F.col(f"r.{f}"), k).alias(f) for f, k in fields.items()])


def telemetry(files: DataFrame) -> DataFrame:
    """Samples of telemetry files (named with their lap), keys attached."""
    return columnar_rows(files.filter(F.col("file").rlike("_tel") & F.col("lap").isNotNull()).withColumnRenamed("lap", "file_lap"), schemas.TELEMETRY, ["season", "gp", "session", "driver", "file_lap"], "tel").withColumnRenamed("file_lap", "lap")


def lap_times(files: DataFrame) -> DataFrame:
    """Lap times of sessions: the session's own file where there is one, else the drivers' files together."""
    keys = ["season", "gp", "session"]
    whole = columnar_rows(files.filter("file = 'session_laptimes.json'").select(*keys, "content"), schemas.SESSION_LAP_TIMES, keys)
    whole = whole.select(*keys, F.col("drv").alias("driver"), "lap", F.col("time").alias("laptime"), "compound", "stint", "life", "s1", "s2", "s3")
    single = columnar_rows(files.filter("file = 'laptimes.json' and driver is not null").select(*keys, "driver", "content"), schemas.LAP_TIMES, [*keys, "driver"])
    single = single.select(*keys, "driver", "lap", F.col("time").alias("laptime"), "compound", "stint", "life", "s1", "s2", "s3")
    return whole.unionByName(single.join(whole.select(*keys).distinct(), keys, "left_anti"))


def session_events(files: DataFrame, kind: str) -> DataFrame:
    """Weather, corner or control rows of the sessions; kind: weather, corners or rcm."""
    fields = {"weather": schemas.WEATHER, "corners": schemas.CORNERS, "rcm": schemas.CONTROL}[kind]
    keys = ["season", "gp", "session"]
    return columnar_rows(files.filter(F.col("file") == f"{kind}.json").select(*keys, "content"), fields, keys)


def drivers(files: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("drivers", T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in schemas.DRIVERS])))])
    rows = files.filter("file = 'drivers.json'").select("season", "gp", "session", F.explode(F.from_json("content", schema)["drivers"]).alias("d"))
    return rows.select("season", "gp", "session", *[as_string(F.col(f"d.{f}")).alias(f) for f in schemas.DRIVERS])


def bad_files(files: DataFrame) -> DataFrame:
    """(path, season, gp, session, stage, type, message): what is wrong with files, and where. Stage parse: not JSON, or not an
    object; stage fields: telemetry without any array, by its envelope or without."""
    parsed = F.try_parse_json("content")
    inner = F.coalesce(F.try_variant_get(parsed, "$.tel", "variant"), parsed)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    arrays = F.coalesce(F.schema_of_variant(inner).contains("ARRAY<"), F.lit(False))
    start = F.substring(F.coalesce(F.col("content"), F.lit("")), 1, 40)
    what = lambda stage, kind: F.struct(F.lit(stage).alias("stage"), F.lit(kind).alias("type"), start.alias("message"))
    tel = F.element_at(F.split("path", "/"), -1).rlike("_tel")
    problem = F.when(parsed.isNull(), what("parse", "not json")).when(~is_object, what("parse", "not an object")).when(tel & ~arrays, what("fields", "no arrays"))
    p = F.split("path", "/")
    at = F.array_position(F.transform(p, lambda x: x.rlike("^(19|20)[0-9]{2}$")), True).cast("int")
    part = lambda k: F.when(at > 0, F.get(p, at - 1 + k))
    return files.select("path", part(0).alias("season"), part(1).alias("gp"), part(2).alias("session"), problem.alias("p")).filter("p is not null").select("path", "season", "gp", "session", "p.*")


def problem_summary(problems: DataFrame) -> DataFrame:
    return problems.groupBy("stage", "type").agg(F.count("*").alias("n"), F.min("path").alias("example"))


def field_profile(rows: DataFrame, kind: str, json: str, period: str | None = None, envelope: str | None = None) -> DataFrame:
    """(kind, field, periods, n, n_null_tokens, n_enveloped, type, example) of the fields of a JSON column, by kind.

    periods: the sorted distinct values of a column, such as the year, in which the field is there; the envelope, if a
    row's object has that key, is gone into. The example is the smallest value that isn't a null token.
    """
    t = T.MapType(T.StringType(), T.StringType())
    own = F.from_json(json, t)
    inner = F.coalesce(F.from_json(F.try_element_at(own, F.lit(envelope)), t), own) if envelope else own
    wrapped = F.coalesce(F.map_contains_key(own, envelope), F.lit(False)) if envelope else F.lit(False)
    m = rows.select(F.col(kind).alias("kind"), (F.col(period).cast("string") if period else F.lit(None).cast("string")).alias("period"), wrapped.alias("wrapped"), F.explode(inner).alias("field", "value"))
    number = F.col("value").try_cast("double").isNotNull()
    token = F.trim(F.coalesce("value", F.lit("null"))).isin(NULL_TOKENS)
    return m.groupBy("kind", "field").agg(
        F.array_join(F.array_sort(F.collect_set("period")), ",").alias("periods"), F.count("*").alias("n"), F.sum(token.cast("long")).alias("n_null_tokens"), F.sum(F.col("wrapped").cast("long")).alias("n_enveloped"),
        F.max(F.when(number, "number").otherwise("string")).alias("type"), F.min(F.when(~token, F.col("value"))).alias("example"),
    )


def structure_counts(files: DataFrame) -> DataFrame:
    """(season, events, sessions, drivers, telemetry, lap_times, enveloped) of session_keys() rows with their content: events,
    sessions and drivers' folders by season, and its files by kind."""
    distinct = lambda *c: F.countDistinct(*c)
    tel = F.col("file").rlike("_tel")
    wrapped = tel & F.coalesce(F.get_json_object("content", "$.tel").isNotNull(), F.lit(False))
    count = lambda c: F.sum(c.cast("long"))
    return files.groupBy("season").agg(distinct("gp").alias("events"), distinct("gp", "session").alias("sessions"), distinct("gp", "session", "driver").alias("drivers"), count(tel).alias("telemetry"), count(F.col("file") == "laptimes.json").alias("lap_times"), count(wrapped).alias("enveloped"))


def footprint(spark: SparkSession, path: str) -> DataFrame:
    """(n_files, bytes) below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def season_scan(spark: SparkSession, path: str, seasons: list[str] | None = None, keep: Column | None = None) -> DataFrame:
    """A season-partitioned table, its season a string; only the listed partitions are read."""
    df = spark.read.parquet(path)
    df = df.withColumn("season", F.col("season").cast("string"))
    if seasons:
        df = df.filter(F.col("season").isin([str(s) for s in seasons]))
    return df.filter(keep) if keep is not None else df


def views(spark: SparkSession, tables: dict[str, str]) -> None:
    for name, path in tables.items():
        spark.read.parquet(path).createOrReplaceTempView(name)


def bernoulli(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    return df.sample(False, fraction, seed)


def lap_feed(rows: DataFrame, default_compound: str = "MEDIUM") -> DataFrame:
    """Feed rows as laps, on a batch or a stream: those without a duration fall out, a missing compound gets a default."""
    return rows.filter(F.col("lap_duration").isNotNull() & F.col("lap_number").isNotNull()).select(F.col("driver_number").cast("string").alias("driver"), F.col("lap_number").cast("int").alias("lap"), F.col("lap_duration").cast("double").alias("laptime"), F.upper(F.coalesce(as_string(F.col("compound")), F.lit(default_compound))).alias("compound"), F.col("stint_number").cast("int").alias("stint"), F.col("track_temp").cast("double").alias("track_temp"))
