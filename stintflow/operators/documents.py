"""Nested document tables by natural key: building, upserts, pruning, queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintflow.operators.ranks import global_rank

from stintflow.functions.scalars import natural_key


def with_id(df: DataFrame, keys: list[str], out: str = "_id") -> DataFrame:
    return df.withColumn(out, natural_key(*[F.col(k) for k in keys]))


def nested(base: DataFrame, keys: list[str], parts: dict[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """base with an array column per part: name -> (rows, columns of the struct, order). Keys without rows get an empty
    array. The keys are sessions, whose samples are bounded by a session's length."""
    out = base
    for name, (rows, columns, order) in parts.items():
        grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in columns if c not in order]))).alias("__x"))
        kind = grouped.schema["__x"].dataType
        out = out.join(grouped.withColumnRenamed("__x", name), keys, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))
    return out


def upsert(target: DataFrame, source: DataFrame, key: str = "_id") -> DataFrame:
    """The target after setting the source's fields by key, with __state: kept, matched, modified or inserted.

    Fields that the source lacks, and nulls in it, keep their old value. Applying the same source again modifies nothing.
    """
    fields = [c for c in dict.fromkeys([*target.columns, *source.columns]) if c != key]
    t = target.select(F.col(key), F.struct(*[F.col(c) for c in target.columns if c != key]).alias("t"))
    s = source.select(F.col(key), F.struct(*[F.col(c) for c in source.columns if c != key]).alias("s"))
    j = t.join(s, key, "full")

    def value(c: str) -> Column:
        old, new = F.col(f"t.{c}") if c in target.columns else F.lit(None), F.col(f"s.{c}") if c in source.columns else F.lit(None)
        return F.coalesce(new, old).alias(c)

    changed = reduce(lambda a, b: a | b, [F.col(f"s.{c}").isNotNull() & ~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) if c in target.columns else F.col(f"s.{c}").isNotNull() for c in source.columns if c != key], F.lit(False))
    state = F.when(F.col("s").isNull(), "kept").when(F.col("t").isNull(), "inserted").when(changed, "modified").otherwise("matched")
    return j.select(key, *[value(c) for c in fields], state.alias("__state"))


def upsert_counts(merged: DataFrame) -> DataFrame:
    """(matched, modified, inserted) as a document store counts them: modified rows are also matched."""
    n = lambda *s: F.sum(F.col("__state").isin(*s).cast("long"))
    return merged.agg(n("matched", "modified").alias("matched"), n("modified").alias("modified"), n("inserted").alias("inserted"))


def prune(target: DataFrame, source: DataFrame, key: str = "_id", scoped: bool = False) -> DataFrame:
    """The target without rows that the source no longer has; a scoped run must not prune."""
    if scoped:
        raise ValueError("only a full run may prune")
    return target.join(source.select(key).distinct(), key, "left_semi")


def invalidate(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))


def page(df: DataFrame, order: list[Column], number: int, size: int, tie: str) -> DataFrame:
    """Page `number` (from 1) of a total order: the tie-break must be unique."""
    if number < 1 or not 1 <= size <= 1000:
        raise ValueError("pages are numbered from 1 and hold 1 to 1000 rows")
    return df.orderBy(*order, F.col(tie)).offset((number - 1) * size).limit(size)


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def first_by(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__r") <= k).drop("__r")


def thin(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """k rows of a ranked list at even distances, both ends included (all rows of a shorter list); the list is ranked by
    ranges and may be of any length."""
    ranked = global_rank(df, order, "__r")
    # The number of rows is one row.
    sized = ranked.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("__n"))))
    return sized.filter(_kept(k)).drop("__r", "__n")


def thin_by(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """thin() for each key's list; a key's list is ranked in one task."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"__r": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    return ranked.filter(_kept(k)).drop("__r", "__n")


def _kept(k: int) -> Column:
    """Whether rank __r of __n is floor(j * (n - 1) / (k - 1)) for some j. The first j at or past the rank is found with a margin
    for rounding, and its neighbour is tried as well."""
    step = (F.col("__n") - 1) / (k - 1)
    j = F.ceil(F.col("__r") / step - 1e-9)
    hit = (F.floor(j * step) == F.col("__r")) | (F.floor((j + 1) * step) == F.col("__r"))
    return (F.col("__n") <= k) | hit


def decision_filter(df: DataFrame, driver: str | None = None, scenario: str | None = None, compound: str | None = None) -> DataFrame:
    for c, v in (("driver", driver), ("scenario", scenario)):
        df = df.filter(F.col(c) == v) if v is not None else df
    return df.filter(F.array_contains("compounds", compound)) if compound is not None else df


def compounds_used(laps: DataFrame, keys: list[str], compound: str, lap: str, until: Column) -> DataFrame:
    """Sorted compounds that a key has run up to a lap; unknown ones fall out."""
    known = F.when(~F.upper(F.col(compound)).isin("UNKNOWN", "NONE", ""), F.upper(F.col(compound)))
    return laps.filter(F.col(lap) <= until).groupBy(*keys).agg(F.array_sort(F.collect_set(known)).alias("compounds_used"))


def guarded_delete(df: DataFrame, predicate: Column, most_share: float = 0.5) -> tuple[DataFrame, int]:
    """(rows that stay, number that would go); refuses a predicate that hits more than most_share of the rows."""
    n, hit = df.agg(F.count("*"), F.coalesce(F.sum(F.coalesce(predicate, F.lit(False)).cast("long")), F.lit(0))).first()
    if n and hit / n > most_share:
        raise ValueError(f"{hit} of {n} rows match: the filter is too wide")
    return df.filter(~F.coalesce(predicate, F.lit(False))), hit


def facet(df: DataFrame, group: str, value: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(the k largest, means by group) over one filtered input."""
    return top(df.filter(F.col(value).isNotNull()), [F.col(value).desc(), *[F.col(c) for c in df.columns if c != value]], k), df.groupBy(group).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def unwound_counts(docs: DataFrame, array: str, keep, by: list[str]) -> DataFrame:
    """(by, n, n_documents): elements of an array of structs that keep(element) takes, counted by fields of theirs.

    The array is filtered before it is unwound, so what falls out makes no row.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("__d"), F.explode(F.filter(array, keep)).alias("x"))
    each = rows.groupBy(*[F.col(f"x.{c}").alias(c) for c in by], "__d").agg(F.count("*").alias("n"))
    return each.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("n_documents"))
