"""Quotation linking: quoted passages are joined to the messages that they come from, and replies are put in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintflow.llm.common import fold, partitions

_PREFIX = r"^[ \t]*(?:>[ \t]?)+"


def normalised(c: Column) -> Column:
    """Lower case, and anything but letters and digits as single spaces: what a mail program changes falls away."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def parsed(text: Column) -> Column:
    """array<struct<level, content>> of a text's lines: level counts the leading '>' signs, 0 for the author's own."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _PREFIX, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, _PREFIX, "").alias("content")))


def _blank(line: Column) -> Column:
    return F.trim(line["content"]) == ""


def blocks(lines: Column) -> Column:
    """array<struct<level, lines>>: runs of lines of one level, also cut at blank lines.

    Starts are filtered from the line numbers and each block is a slice, so the work is linear in the text.
    """
    at = lambda i: F.element_at(lines, i.cast("int") + 1)
    n = F.size(lines)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~_blank(at(i)) & F.when(i == 0, True).otherwise((at(F.greatest(i - 1, F.lit(0)))["level"] != at(i)["level"]) | _blank(at(F.greatest(i - 1, F.lit(0))))))
    return F.transform(F.arrays_zip(starts.alias("s"), F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(n)).alias("e")), lambda x: F.struct(at(x["s"])["level"].alias("level"), F.transform(F.slice(lines, x["s"] + 1, x["e"] - x["s"]), lambda y: y["content"]).alias("lines")))


def units(block: Column) -> Column:
    """Hashes that a passage can be found by: of the whole block and of each of its lines, normalised; blanks have none."""
    texts = F.concat(F.array(F.array_join(block, " ")), block)
    return F.array_distinct(F.transform(F.filter(F.transform(texts, normalised), lambda x: x != ""), lambda x: F.xxhash64(x)))


def own_text(lines: Column) -> Column:
    """The author's own lines; a line 'X wrote:' right above a quote goes with it."""
    at = lambda i: F.element_at(lines, i.cast("int") + 1)
    n = F.size(lines)
    quoted_next = lambda i: F.when(i + 1 < n, at(F.least(i + 1, n - 1))["level"] > 0).otherwise(False) | F.when(i + 2 < n, _blank(at(F.least(i + 1, n - 1))) & (at(F.least(i + 2, n - 1))["level"] > 0)).otherwise(False)
    kept = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (at(i)["level"] == 0) & ~(at(i)["content"].rlike(r"(?i)\bwrote:[ \t]*$") & quoted_next(i)))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda i: at(i)["content"]), "\n"), r"^\n+|\n+$", "")


def link_quotes(spark: SparkSession, messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", max_rounds: int = 40) -> DataFrame:
    """One row per message: conv, turn, role, text without quotes, n_quoted, n_linked, reply_to, thread_root, depth, chat.

    A passage's original is the earliest message of its conversation whose own text has it, if that is before the quoting
    turn. A message replies to the latest original of its outermost quotes (any deeper ones only count as linked); its
    thread is followed to the first message by pointer doubling over replies alone. Ordering by (conv, thread_root, turn)
    puts every reply after what it answers; rows come out so, dealt by range, and a long conversation is spread over
    several tasks. Originals are reduced to one row per conversation and passage before the join, so a sentence that
    a third of all messages repeat costs a map-side minimum and no pairs.
    Null texts count as empty; messages without conversation or turn stay unlinked; rows with one (conv, turn) share
    their links; an empty table gives an empty one.
    """
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("raw")).withColumn("lines", parsed(F.col("raw")))
    # Messages are parsed once; passages, originals and the result read the stored blocks.
    own = fold(spark, rows.select("conv", "turn", "role", own_text(F.col("lines")).alias("text"), blocks(F.col("lines")).alias("parts")), "messages").withColumn("quotes", F.filter("parts", lambda b: b["level"] > 0))
    keyed = own.filter("conv is not null and turn is not null")
    passages = keyed.filter(F.size("quotes") > 0).select("conv", "turn", F.posexplode("quotes").alias("passage", "q")).select("conv", "turn", "passage", F.col("q.level").alias("level"), F.explode(units(F.col("q.lines"))).alias("unit"))
    passages = fold(spark, passages)
    originals = keyed.select("conv", "turn", F.explode(F.filter("parts", lambda b: b["level"] == 0)).alias("b")).select("conv", "turn", F.explode(units(F.col("b.lines"))).alias("unit"))
    # What nobody quotes need not be gathered: the quoted side's keys reduce the originals first.
    wanted = passages.select("conv", "unit").distinct()
    firsts = originals.join(wanted, ["conv", "unit"], "left_semi").groupBy("conv", "unit").agg(F.min("turn").alias("origin"))
    linked = passages.join(firsts, ["conv", "unit"]).filter("origin < turn").groupBy("conv", "turn", "passage").agg(F.min("level").alias("level"), F.max("origin").alias("origin"))
    replies = fold(spark, linked.groupBy("conv", "turn").agg(F.count("*").alias("n_linked"), F.max(F.struct(-F.col("level"), F.col("origin")))["origin"].alias("reply_to")))
    roots = replies.select("conv", "turn", F.col("reply_to").alias("root"), F.lit(1).alias("depth"))
    for _ in range(max_rounds):
        up = roots.select("conv", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        roots = fold(spark, roots.join(up, ["conv", "root"], "left").select("conv", "turn", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")))
        moved = roots.filter("moved").limit(1).count()
        roots = roots.drop("moved")
        if not moved:
            break
    out = own.select("conv", "turn", "role", "text", F.size("quotes").cast("long").alias("n_quoted")).join(replies, ["conv", "turn"], "left").join(roots, ["conv", "turn"], "left")
    out = out.select("conv", "turn", "role", "text", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", F.coalesce("root", "turn").alias("thread_root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("text"), F.lit("\n")).alias("chat"))
    return out.repartitionByRange(partitions(spark), "conv", "thread_root", "turn").sortWithinPartitions("conv", "thread_root", "turn")


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumnRenamed("conv", "conv_id")
