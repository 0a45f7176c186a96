"""Format-preserving Feistel pseudonyms for personal data in texts, in SQL expressions only."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintflow.llm.common import free_name

ROUNDS = 8
DIGITS, HEX, BASE36, UPPER36 = "0123456789", "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for the three alphabets 0-9, a-z and A-Z: each symbol stays within its own.
BY_CLASS = ""
KEY_CONF = "spark.stintflow.pii.key"

#: What a match may be, tried in this order at each place. Runs are taken whole (trailing digits are consumed), so that
#: a part of a longer number is never mistaken for a number; each match is then validated.
PATTERNS = {
    "email": r"[0-9A-Za-z._%+-]+@[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*\.[A-Za-z]{2,}",
    "phone": r"\+1 ?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4,}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4,}|[0-9]{3}-[0-9]{3}-[0-9]{4,}",
    "access_key": r"AKIA[0-9A-Z]{16,}",
    "password": r"(?:password|passwd|pwd|secret|api_key) ?[=:] ?\"?[0-9A-Za-z]{6,}",
    "hex": r"[0-9a-f]{32,}",
    "ip": r"[0-9]+(?:\.[0-9]+)+",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4,}",
    "iso_date": r"[0-9]{4}-[0-9]{2}-[0-9]{2,}",
    "day_date": r"[0-9]{2}/[0-9]{2}/[0-9]{4,}",
    "grouped_card": r"[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4,}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4,}",
    "number": r"[0-9]+",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _round(key: str, kind: str, r: int, other: Column) -> Column:
    """128 hexadecimal digits that depend on the key, the kind, the round and the other half."""
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|{r}|"), other), 512)


def _add_digits(half: Column, noise: Column, charset: str) -> Column:
    """The symbols of half, each moved within charset (or its own class) by its own four digits of noise."""
    if not charset:
        return _add_in_class(half, noise)
    base = len(charset)
    return F.when(F.length(half) == 0, F.lit("")).otherwise(
        F.array_join(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(half), F.lit(1))),
                lambda i: F.substr(F.lit(charset), ((F.instr(F.lit(charset), F.substr(half, i, F.lit(1))) - 1 + F.conv(F.substr(noise, ((i - 1) % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")) % base) + 1, F.lit(1)),
            ),
            "",
        )
    )


def _add_in_class(half: Column, noise: Column) -> Column:
    def moved(i: Column) -> Column:
        code = F.ascii(F.substr(half, i, F.lit(1)))
        first = F.when(code <= 57, 48).when(code <= 90, 65).otherwise(97)
        size = F.when(code <= 57, 10).otherwise(26)
        step = F.conv(F.substr(noise, ((i - 1) % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return F.char(first + (code - first + step) % size)

    return F.when(F.length(half) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(half), F.lit(1))), moved), ""))


def permute_symbols(value: Column, charset: str, key: str, kind: str) -> Column:
    """A keyed permutation of the strings over charset of value's length: an alternating Feistel network whose round
    adds digits modulo the size of the charset. Its inverse subtracts them in reverse order. With BY_CLASS, the strings
    with a digit, a small or a capital letter in the same places are permuted among themselves."""
    cut = F.floor(F.length(value) / 2).cast("int")
    state = F.struct(F.substr(value, F.lit(1), cut).alias("l"), F.substr(value, cut + 1, F.length(value)).alias("r"))
    # A lambda with a second parameter would get the place in the array for it, so rounds are bound by a function.
    def turn(r: int):
        if r % 2 == 0:
            return lambda s: F.struct(_add_digits(s["l"], _round(key, kind, r, s["r"]), charset).alias("l"), s["r"].alias("r"))
        return lambda s: F.struct(s["l"].alias("l"), _add_digits(s["r"], _round(key, kind, r, s["l"]), charset).alias("r"))

    for r in range(ROUNDS):
        state = _let(state, turn(r))
    return _let(state, lambda s: F.concat(s["l"], s["r"]))


def permute_number(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of the integers 0 to a*b-1: Feistel on value = left * b + right with sums modulo a and b."""
    state = F.struct(F.floor(value / b).cast("long").alias("l"), (value % b).cast("long").alias("r"))

    def noise(r: int, other: Column) -> Column:
        return F.conv(F.substr(_round(key, kind, r, other.cast("string")), F.lit(1), F.lit(12)), 16, 10).cast("long")

    def turn(r: int):
        if r % 2 == 0:
            return lambda s: F.struct(((s["l"] + noise(r, s["r"])) % a).alias("l"), s["r"].alias("r"))
        return lambda s: F.struct(s["l"].alias("l"), ((s["r"] + noise(r, s["l"])) % b).alias("r"))

    for r in range(ROUNDS):
        state = _let(state, turn(r))
    return _let(state, lambda s: s["l"] * b + s["r"])


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def remask(value: Column, symbols: Column, pattern: str) -> Column:
    """value with its characters that match pattern (a class) replaced by symbols in order."""
    return F.array_join(
        F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.when(F.substr(value, i, F.lit(1)).rlike(pattern), F.substr(symbols, F.length(F.regexp_replace(F.substr(value, F.lit(1), i), f"[^{pattern[1:]}", "")), F.lit(1))).otherwise(F.substr(value, i, F.lit(1)))),
        "",
    )


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum, the last digit counting once."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def kind_of(m: Column) -> Column:
    """The kind of a match, or null if it doesn't validate: Luhn sum, octets, calendar days, and issued number ranges."""
    digits = only_digits(m)
    card = F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0) & ~digits.rlike("^0+$")
    octets = F.split(m, r"\.")
    ip = (F.size(octets) == 4) & F.forall(octets, lambda o: (F.length(o) <= 3) & (o.try_cast("int") <= 255))
    year = lambda d: F.year(d).between(1800, 2199)
    iso, day = F.to_date(F.try_to_timestamp(m, F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(m, F.lit("dd/MM/yyyy")))
    ssn = m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~m.rlike("^(000|666|9)|-00-|-0000$")
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(m.startswith("AKIA"), F.when(F.length(m) == 20, F.lit("access_key")))
        .when(m.rlike("^(password|passwd|pwd|secret|api_key)"), F.lit("password"))
        .when(m.rlike("^[0-9]+$"), F.when(card, F.lit("card")))
        .when(m.rlike("^[0-9a-f]{32,64}$"), F.lit("hex"))
        .when(m.rlike(r"^[0-9]+(\.[0-9]+)+$"), F.when(ip, F.lit("ip")))
        .when(m.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.when(year(iso), F.lit("iso_date")))
        .when(m.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.when(year(day), F.lit("day_date")))
        .when(ssn, F.lit("ssn"))
        .when(m.rlike("^[0-9]{4}([ -])[0-9]{4}([ -])[0-9]{4}([ -])[0-9]{4}$"), F.when(card, F.lit("card")))
        .when(m.rlike(r"^(\+1.*|\([0-9]{3}\).*|[0-9]{3}-[0-9]{3}-[0-9]{4})$") & (F.length(digits) == F.when(m.startswith("+"), 11).otherwise(10)), F.lit("phone"))
    )


#: 400 Gregorian years have 146,097 = 189 x 773 days, the dates' Feistel halves.
_DATE_A, _DATE_B, _FIRST_DAY = 189, 773, "1800-01-01"
_SSN_A, _SSN_B = 898, 99 * 9999


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The keyed stand-in of a match of a kind, in the same format; m itself where kind is null."""
    digits = only_digits(m)

    def card() -> Column:
        body = permute_symbols(F.substr(digits, F.lit(1), F.length(digits) - 1), DIGITS, key, "card")
        whole = _let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return _let(whole, lambda w: remask(m, w, "[0-9]"))

    def date(pattern: str) -> Column:
        day = F.datediff(F.to_date(F.try_to_timestamp(m, F.lit(pattern))), F.lit(_FIRST_DAY).cast("date"))
        return F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), permute_number(day, _DATE_A, _DATE_B, key, "date").cast("int")), pattern)

    def ip() -> Column:
        packed = F.array_join(F.transform(F.split(m, r"\."), lambda o: F.lower(F.lpad(F.hex(o.cast("int")), 2, "0"))), "")
        return _let(permute_symbols(packed, HEX, key, "ip"), lambda p: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substr(p, i * 2 + 1, F.lit(2)), 16, 10)), "."))

    def ssn() -> Column:
        area = F.substr(digits, F.lit(1), F.lit(3)).cast("long")
        left = area - F.when(area > 666, 2).otherwise(1)
        right = (F.substr(digits, F.lit(4), F.lit(2)).cast("long") - 1) * 9999 + F.substr(digits, F.lit(6), F.lit(4)).cast("long") - 1
        return _let(permute_number(left * _SSN_B + right, _SSN_A, _SSN_B, key, "ssn"), lambda x: _let(F.floor(x / _SSN_B), lambda a: F.format_string("%03d-%02d-%04d", a + F.when(a >= 665, 2).otherwise(1), F.floor(x % _SSN_B / 9999) + 1, x % _SSN_B % 9999 + 1)))

    def phone() -> Column:
        lead = F.when(m.startswith("+1"), F.lit("+1")).otherwise(F.lit(""))
        rest = F.substr(m, F.length(lead) + 1, F.length(m))
        return F.concat(lead, _let(permute_symbols(only_digits(rest), DIGITS, key, "phone"), lambda p: remask(rest, p, "[0-9]")))

    def email() -> Column:
        local = F.lower(F.substring_index(m, "@", 1))
        return F.concat(_let(permute_symbols(F.regexp_replace(local, "[^0-9a-z]", ""), BASE36, key, "email"), lambda p: remask(local, p, "[0-9a-z]")), F.lit("@"), F.substring_index(m, "@", -1))

    def password() -> Column:
        value = F.regexp_extract(m, r"([0-9A-Za-z]+)$", 1)
        return F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(value)), permute_symbols(value, BY_CLASS, key, "secret"))

    return (
        F.when(kind == "card", card())
        .when(kind == "phone", phone())
        .when(kind == "ip", ip())
        .when(kind == "email", email())
        .when(kind == "hex", permute_symbols(m, HEX, key, "hex"))
        .when(kind == "password", password())
        .when(kind == "access_key", F.concat(F.lit("AKIA"), permute_symbols(F.substr(m, F.lit(5), F.lit(16)), UPPER36, key, "access_key")))
        .when(kind == "iso_date", date("yyyy-MM-dd"))
        .when(kind == "day_date", date("dd/MM/yyyy"))
        .when(kind == "ssn", ssn())
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", kinds_col: str | None = None) -> DataFrame:
    """docs with the personal data of text_col replaced; kinds_col, if given, gets the kinds found, in order.

    Every column but the text stays, whatever its name; kinds_col must be a new one. Every text is searched; a null text
    stays null and an empty one empty. Equal values get equal pseudonyms in all documents; different values of one format
    get different ones. Two rules are meant: e-mail addresses that differ only in case count as equal, and an address keeps
    its domain in clear text. Who knows the key can invert every pseudonym. The expressions are native; nothing is
    shuffled.
    """
    if not key:
        raise ValueError("a key is needed")
    if kinds_col and kinds_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is already a column {kinds_col}")
    found_col, text_out = free_name(docs, "found"), free_name(docs, "replaced")
    text = F.col(text_col)
    found = F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))
    judged = F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m).alias("k")))
    work = docs.withColumn(found_col, judged)
    hits = F.exists(found_col, lambda x: x["k"].isNotNull())
    replaced = F.transform(found_col, lambda x: F.when(x["k"].isNull(), x["m"]).otherwise(pseudonym(x["m"], x["k"], key)))
    gaps = F.split(text, PATTERN, -1)
    rebuilt = F.array_join(F.zip_with(gaps, replaced, lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")
    out = work.withColumn(text_out, F.when(hits, rebuilt).otherwise(text))
    if kinds_col:
        out = out.withColumn(kinds_col, F.transform(F.filter(found_col, lambda x: x["k"].isNotNull()), lambda x: x["k"]))
    order = [F.col(text_out).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*order, *([F.col(kinds_col)] if kinds_col else []))


def session_key(spark: SparkSession) -> str:
    """The key of the session's setting spark.stintflow.pii.key; where it is unset, a random one is made and set.

    Set it to link pseudonyms between sessions, and keep it as secret as the data.
    """
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_CONF, key)
    return key


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, session_key(spark), kinds_col="kinds").select("doc_id", "text", F.array_join("kinds", ",").alias("kinds"))
