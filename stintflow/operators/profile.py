"""Data quality: drift, nulls, coercion, contracts, grain, reconciliation, hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import ArrayType, DataType, StructType

from stintflow.functions.scalars import NULL_TOKENS, typed
from stintflow.operators.fits import exact_quantiles


def null_rates(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(group, column, n, null_rate), long: one aggregate over all columns, then unpivoted."""
    one = df.groupBy(*group).agg(F.count("*").alias("n"), *[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return one.unpivot([*group, "n"], columns, "column", "null_rate")


def null_matrix(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """One row per group with the null rate of each column."""
    return df.groupBy(group).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])


def drift(df: DataFrame, manifest: dict[str, str]) -> list[tuple[str, str, str]]:
    """(column, problem, detail) of a schema against column -> type: missing, type or extra."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    out = [(c, "missing", t) for c, t in manifest.items() if c not in have]
    out += [(c, "type", f"{have[c]} instead of {t}") for c, t in manifest.items() if c in have and have[c] != t]
    return out + [(c, "extra", t) for c, t in have.items() if c not in manifest]


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type, rows) of each table."""
    spark = next(iter(tables.values())).sparkSession
    out = None
    for name, df in tables.items():
        columns = spark.createDataFrame([Row(table=name, column=f.name, type=f.dataType.simpleString()) for f in df.schema])
        one = columns.crossJoin(F.broadcast(df.agg(F.count("*").alias("rows"))))
        out = one if out is None else out.unionByName(one)
    return out


def coerce(df: DataFrame, targets: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(df with the columns cast, counts): values that don't fit become null. counts: column, n_values, n_lost."""
    cast = df.withColumns({c: typed(F.col(c), k) for c, k in targets.items()})
    checks = df.select(*[F.struct(F.col(c).isNotNull().alias("had"), typed(F.col(c), k).isNotNull().alias("has")).alias(c) for c, k in targets.items()])
    one = checks.agg(*[f(c).alias(f"{c}__{n}") for c in targets for n, f in (("n", lambda c: F.sum(F.col(c)["had"].cast("long"))), ("lost", lambda c: F.sum((F.col(c)["had"] & ~F.col(c)["has"]).cast("long"))))])
    counts = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("n_values"), F.col(f"{c}__lost").alias("n_lost")) for c in targets])).alias("x")).select("x.*")
    return cast, counts


def coerce_nested(df: DataFrame, targets: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(df with the leaves cast, counts (path, kind, n)) for dotted paths through structs and arrays of any depth.

    The schema is walked: a path's arrays are gone into, so `stints.laps.time` means every lap's time. Kinds: kept, of the
    type and value it had; a_to_b, another type; null_token; nonfinite_to_null; lost, a value that doesn't fit. Nulls
    count as nothing. Every row is read once for the counts.
    """
    paths = {tuple(p.split(".")): k for p, k in targets.items()}

    def cast(c: Column, t: DataType, at: tuple[str, ...]) -> Column:
        if at in paths:
            return F.transform(c, lambda x: typed(x, paths[at])) if isinstance(t, ArrayType) else typed(c, paths[at])
        if not any(p[: len(at)] == at for p in paths):
            return c
        if isinstance(t, ArrayType):
            return F.transform(c, lambda x: cast(x, t.elementType, at))
        if isinstance(t, StructType):
            return F.when(c.isNotNull(), F.struct(*[cast(c[f.name], f.dataType, (*at, f.name)).alias(f.name) for f in t]))
        raise ValueError(f"{'.'.join(at)} is neither a struct nor an array")

    def leaves(c: Column, t: DataType, rest: tuple[str, ...], own: str) -> tuple[Column, str]:
        """The values at a path below c as one array, and their type."""
        if isinstance(t, ArrayType):
            inner = leaves(F.lit(None), t.elementType, rest, own)[1]
            return F.flatten(F.transform(F.coalesce(c, F.array().cast(t)), lambda x: leaves(x, t.elementType, rest, own)[0])), inner
        if rest:
            if not isinstance(t, StructType):
                raise ValueError(f"{own} is not there")
            return leaves(c[rest[0]], t[rest[0]].dataType, rest[1:], own)
        return F.array(c), t.simpleString()

    def kind(v: Column, had: str, to: str) -> Column:
        text = F.trim(v.cast("string"))
        number = text.try_cast("double")
        lost = F.when(text.isin(NULL_TOKENS), "null_token").when(F.lit(to in ("double", "int")) & (F.isnan(number) | (F.abs(number) == float("inf"))), "nonfinite_to_null").otherwise("lost")
        return F.when(v.isNull(), F.lit(None)).when(typed(v, to).isNull(), lost).otherwise("kept" if had == to else f"{had}_to_{to}")

    def named(values: Column, path: tuple[str, ...], had: str, to: str) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(".".join(path)).alias("path"), kind(v, had, to).alias("kind")))

    found = []
    for path, to in paths.items():
        values, had = leaves(F.col(path[0]), df.schema[path[0]].dataType, path[1:], ".".join(path))
        found.append(named(values, path, had, to))
    counts = df.select(F.explode(F.concat(*found)).alias("x")).select("x.*").filter("kind is not null").groupBy("path", "kind").agg(F.count("*").alias("n"))
    return df.withColumns({p[0]: cast(F.col(p[0]), df.schema[p[0]].dataType, (p[0],)) for p in paths}), counts


def judged(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with problems: the names of the rules that a row breaks. A rule that is null counts as broken."""
    return df.withColumn("problems", F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull()))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rows that break one with their problems)."""
    j = judged(df, rules)
    return j.filter(F.size("problems") == 0).drop("problems"), j.filter(F.size("problems") > 0)


def quality_report(df: DataFrame, rules: dict[str, Column], optional: list[str] = (), numeric: list[str] = ()) -> DataFrame:
    """One row: rows, violations by rule, missing optional values, values that aren't numbers."""
    rule = [F.sum((~F.coalesce(c, F.lit(False))).cast("long")).alias(f"breaks_{n}") for n, c in rules.items()]
    lacking = [F.sum(F.col(c).isNull().cast("long")).alias(f"missing_{c}") for c in optional]
    odd = [F.sum((F.col(c).isNotNull() & typed(F.col(c), "double").isNull()).cast("long")).alias(f"not_numeric_{c}") for c in numeric]
    return df.agg(F.count("*").alias("rows"), *rule, *lacking, *odd)


def grain(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, distinct keys, rows with a null in the key, repeated rows. Counted by key first, so no row of the
    table and no set of keys has to fit anywhere."""
    by_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return by_key.agg(F.sum("n").alias("rows"), F.sum(F.when(~null, 1).otherwise(0)).cast("long").alias("unique_keys"), F.sum(F.when(null, F.col("n")).otherwise(0)).alias("null_keys"), F.sum(F.when(~null, F.col("n") - 1).otherwise(0)).alias("repeated"))


def checked_many_to_one(right: DataFrame, keys: list[str]) -> DataFrame:
    """right with a failure on evaluation if a key has more rows than one."""
    once = right.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in right.columns if c not in keys])
    return once.filter(F.when(F.col("__n") > 1, F.raise_error(F.lit("a key of the right side is not unique"))).otherwise(F.lit(True))).drop("__n")


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(column, matched, only_a, only_b, null_differs, differs, max_abs): all common columns in one full join and
    aggregate. Numbers agree within the tolerance, other values if they are equal."""
    common = [c for c in a.columns if c in b.columns and c not in keys]
    kinds = {f.name: f.dataType for f in a.schema}
    left = a.select(*[F.col(k).alias(f"a_{k}") for k in keys], *[F.col(c).alias(f"a__{c}") for c in common], F.lit(1).alias("in_a"))
    right = b.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(c).alias(f"b__{c}") for c in common], F.lit(1).alias("in_b"))
    j = left.join(right, reduce(lambda x, y: x & y, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys]), "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    out = [F.sum(both.cast("long")).alias("matched"), F.sum(F.col("in_b").isNull().cast("long")).alias("only_a"), F.sum(F.col("in_a").isNull().cast("long")).alias("only_b")]
    for c in common:
        x, y = F.col(f"a__{c}"), F.col(f"b__{c}")
        numeric = isinstance(kinds[c], T.NumericType)
        gap = F.abs(x.cast("double") - y.cast("double")) if numeric else None
        differs = (gap > tolerance) if numeric else (x != y)
        out += [F.sum((both & (x.isNull() != y.isNull())).cast("long")).alias(f"{c}__nulls"), F.sum(F.coalesce((both & differs).cast("long"), F.lit(0))).alias(f"{c}__differs"), (F.max(F.when(both, gap)) if numeric else F.lit(None).cast("double")).alias(f"{c}__max")]
    one = j.agg(*out)
    return one.select("matched", "only_a", "only_b", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__nulls").alias("null_differs"), F.col(f"{c}__differs").alias("differs"), F.col(f"{c}__max").alias("max_abs")) for c in common])).alias("x")).select("x.column", "matched", "only_a", "only_b", "x.null_differs", "x.differs", "x.max_abs")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b): rows counted with their repeats, from one grouping of both sides."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("__w")).unionByName(b.select(*cols, F.lit(-1).alias("__w")))
    return both.groupBy(*cols).agg(F.sum("__w").alias("__n")).agg(F.coalesce(F.sum(F.greatest("__n", F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("__n"), F.lit(0))), F.lit(0)).alias("only_b"))


def content_hash(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (n, digest): independent of the rows' order and partitions; equal tables have equal digests."""
    h = F.xxhash64(*[F.col(c) for c in columns or sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("digest"))


def bucket_sizes(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """(layout, bucket, n_keys, n_rows) of three layouts of a numeric key: hash, by the CRC of its text; range, with bounds at
    the exact quantiles of the rows' keys; single, one bucket. A range holds at most n / buckets rows and one key's more."""
    by_key = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    # One row of buckets - 1 bounds.
    bounds = exact_quantiles(df, [], key, [], [k / buckets for k in range(1, buckets)]).select(F.array_distinct("nearest").alias("__b"))
    crc = (F.crc32(F.col(key).cast("string").cast("binary")) % buckets).cast("int")
    place = F.size(F.filter("__b", lambda b: b <= F.col(key).cast("double")))
    rows = by_key.crossJoin(F.broadcast(bounds)).select(F.inline(F.array(*[F.struct(F.lit(name).alias("layout"), bucket.alias("bucket"), F.col("n").alias("n")) for name, bucket in (("hash", crc), ("range", place), ("single", F.lit(0)))])))
    return rows.groupBy("layout", "bucket").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_rows"))


def stale(exported: DataFrame, current: DataFrame, keys: list[str], value: str, missing: int = -1) -> DataFrame:
    """One row (n, n_stale): exported rows whose derived value isn't the current one (missing keys stand for -1)."""
    now = current.select(*keys, F.col(value).alias("__now"))
    j = exported.join(now, keys, "left").select(F.coalesce(value, F.lit(missing)).alias("a"), F.coalesce("__now", F.lit(missing)).alias("b"))
    return j.agg(F.count("*").alias("n"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("n_stale"))


def leaking_columns(columns: list[str], labels: set[str]) -> list[str]:
    """Feature columns that are labels or derived from them by name."""
    return sorted(c for c in columns if c in labels or any(c.startswith(f"{x}_") for x in labels))


def features(df: DataFrame, keys: list[str], labels: set[str]) -> DataFrame:
    """df without labels and what is derived from them by name, keys first: what a model may see."""
    leaking = set(leaking_columns(df.columns, labels))
    return df.select(*keys, *[F.col(f"`{c}`") for c in df.columns if c not in leaking and c not in keys])


def require(df: DataFrame, columns: list[str], rows: int | None = None) -> None:
    """Raise if a column is missing or the number of rows isn't the expected one."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{n} rows instead of {rows}")
