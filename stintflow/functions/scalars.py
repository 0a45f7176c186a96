"""Column expressions used by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings that stand for no value (fixed values).
NULL_TOKENS = ["", "None", "none", "null", "N/A", "nan"]

#: Largest remaining life by category (fixed values), and that of any other.
LIFE_CAPS = {"SOFT": 15, "MEDIUM": 22, "HARD": 30, "INTERMEDIATE": 20, "WET": 20}
DEFAULT_LIFE_CAP = 20
FUEL_SECONDS_PER_LAP = 0.03


def as_string(c: Column) -> Column:
    """A raw value as a trimmed string, null for the null tokens."""
    s = F.trim(c.cast("string"))
    return F.when(~s.isin(NULL_TOKENS), s)


def as_double(c: Column) -> Column:
    """A raw value as a finite double; anything else is null."""
    d = as_string(c).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def as_int(c: Column) -> Column:
    """A raw value as an int, fractions cut off; anything else is null."""
    return as_double(c).try_cast("int")


def as_bool(c: Column) -> Column:
    return as_string(c).try_cast("boolean")


def typed(c: Column, kind: str) -> Column:
    """A raw value as one of double, int, boolean, string."""
    return {"double": as_double, "int": as_int, "boolean": as_bool, "string": as_string}[kind](c)


def clip(c: Column, low: float, high: float) -> Column:
    """c held between low and high; null stays null (least and greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def session_type(name: Column) -> Column:
    """The kind of a session by its name's beginning; the first rule that fits wins."""
    s = F.lower(name)
    return F.when(s.startswith("race"), "Race").when(s.startswith("sprint"), "Sprint").when(s.startswith("qualifying") | s.contains("shootout"), "Qualifying").when(s.startswith("practice"), "Practice").otherwise("Testing")


def fuel_corrected(pace: Column, lap: Column, kind: Column, per_lap: float = FUEL_SECONDS_PER_LAP) -> Column:
    return F.when(kind.isin("Race", "Sprint"), pace + per_lap * lap).otherwise(pace)


def looked_up(key: Column, table: dict, default) -> Column:
    """table[key], default for unknown or null keys."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def capped_life(life: Column, category: Column, caps: dict[str, int] | None = None, default: int = DEFAULT_LIFE_CAP) -> Column:
    """Remaining life at least 0 and at most the category's cap."""
    return F.when(life.isNotNull(), F.least(F.greatest(life, F.lit(0)), looked_up(category, caps or LIFE_CAPS, default)))


def circular(angle: Column, fallback: Column | None = None) -> tuple[Column, Column]:
    """Sine and cosine of degrees, of the fallback where the angle is null."""
    a = F.radians(F.coalesce(angle, fallback) if fallback is not None else angle)
    return F.sin(a), F.cos(a)


def blended(first: Column, second: Column, start: float = 12.0, width: float = 6.0) -> Column:
    """Two predictions, the second weighing more the smaller the first is: w = clip((start - first) / width, 0, 1)."""
    w = clip((F.lit(start) - first) / width, 0.0, 1.0)
    return w * second + (1 - w) * first


def natural_key(*cols: Column) -> Column:
    """Key columns joined by a bar; null keeps its place as None."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("None")) for c in cols])


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def first_number(c: Column) -> Column:
    return F.regexp_extract(c, "([0-9]+)", 1).try_cast("int")


def contains_any(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.upper(c).contains(p) for p in parts])


def control_period(category: Column, message: Column, guards: list[str] | None = None) -> Column:
    """Whether a control message speaks of a neutralised period: by its category, or by its words unless a guard word
    shows that it is about something else. A null message fails the words."""
    stop = guards or ["INFRINGEMENT", "PENALTY", "UNDER INVESTIGATION", "NOTED", "REVIEWED"]
    return F.coalesce(category.isin("SafetyCar", "VirtualSafetyCar", "VSC"), F.lit(False)) | F.coalesce((contains_any(message, ["SAFETY CAR"]) & ~contains_any(message, [*stop, "LIGHTS ON"])) | (contains_any(message, ["VIRTUAL SAFETY CAR", "VSC"]) & ~contains_any(message, [*stop, "TEST"])), F.lit(False))


def parse_plan(plan: Column) -> Column:
    """array<struct<compound, end_lap, is_current>> of 'SOFT->18,MEDIUM->end'; an end of 'end' is null."""
    parts = F.split(F.upper(F.regexp_replace(plan, r"\s+", "")), ",")
    return F.transform(parts, lambda p, i: F.struct(F.substring_index(p, "->", 1).alias("compound"), F.substring_index(p, "->", -1).try_cast("int").alias("end_lap"), (i == 0).alias("is_current")))


def plan_is_valid(stints: Column, current: Column, n_laps: Column, known: list[str]) -> Column:
    """Ends increase, the last reaches the race's length, all compounds are known, and the first is the current one."""
    ends = F.transform(stints, lambda s, i: F.coalesce(s["end_lap"], n_laps))
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(ends) - 1, F.lit(1))), lambda i: (F.size(ends) == 1) | (F.element_at(ends, F.least(i + 1, F.size(ends))) > F.element_at(ends, i)))
    return F.coalesce((F.size(stints) > 0) & rising & (F.element_at(ends, -1) == n_laps) & F.forall(stints, lambda s: s["compound"].isin(known)) & (stints[0]["compound"] == current), F.lit(False))


def format_plan(stints: Column, n_laps: Column) -> Column:
    return F.array_join(F.transform(stints, lambda s: F.concat(s["compound"], F.lit("->"), F.when(F.coalesce(s["end_lap"], n_laps) >= n_laps, F.lit("end")).otherwise(s["end_lap"].cast("string")))), " | ")


def keyed_uniform(*parts: Column) -> Column:
    """A uniform in (0, 1) from the MD5 of the key: the same in any partitioning and in any engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def keyed_normal(*parts: Column) -> Column:
    """A standard normal from two keyed uniforms (Box-Muller)."""
    return F.sqrt(-2 * F.log(keyed_uniform(*parts, F.lit("a")))) * F.cos(2 * F.pi() * keyed_uniform(*parts, F.lit("b")))


def all_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
