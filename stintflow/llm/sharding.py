"""Sharding by a keyed permutation of global row numbers: shard and slot are computed from a number, and back."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintflow.llm.common import fold, free_name, partitions, read

ROUNDS, WALK = 6, 64
KEY = "shuffle-1"


def grid(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n and fewer than a numbers beyond n."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def feistel(value: Column, n: int, key: str, back: bool = False) -> Column:
    """A keyed permutation of 0 to a * b - 1 of grid(n), or its inverse: value = left * b + right, and rounds in turn add
    to one half, modulo its size, a number that depends on the other half."""
    a, b = grid(n)

    def noise(i: Column, half: Column) -> Column:
        return F.conv(F.substr(F.md5(F.concat_ws("|", F.lit(key), i.cast("string"), half.cast("string"))), F.lit(1), F.lit(12)), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        add = lambda x, y, size: F.pmod(x - noise(i, y) if back else x + noise(i, y), F.lit(size).cast("long"))
        return F.struct(F.when(i % 2 == 0, add(s["l"], s["r"], a)).otherwise(s["l"]).alias("l"), F.when(i % 2 == 1, add(s["r"], s["l"], b)).otherwise(s["r"]).alias("r"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    x = value.cast("long")
    return F.aggregate(rounds, F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r")), turn, lambda s: s["l"] * b + s["r"])


def permuted(number: Column, n: int, key: str = KEY, back: bool = False) -> Column:
    """A keyed permutation of 0 to n - 1 or its inverse, by cycle walking: the network is applied until the value is below n.

    Up to n = 4096 fewer than 64 values lie beyond n, so 64 steps suffice; above, a step ends beyond n with a chance below
    1/64 that falls with n, and a row that is still there after 64 steps (a chance below n**-31) stops the job.
    """
    late = F.raise_error(F.lit("cycle walk too long")).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), feistel(number, n, key, back), lambda x, _: F.when(x < n, x).otherwise(feistel(x, n, key, back)), lambda x: F.when((x < n) | x.isNull(), x).otherwise(late))


def number_at(shard: Column, slot: Column, shards: int, n: int, key: str = KEY) -> Column:
    """The row number that lies at a shard and slot, from these alone."""
    return permuted(slot.cast("long") * shards + shard, n, key, back=True)


def numbered(spark: SparkSession, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their global number from 0 by `order`, then by a hash of all their columns, in column `name`.

    The rows are dealt by range, written, and counted by range; a number is the place in the range plus the rows of the
    ranges before. So it doesn't depend on the number of partitions, and no task holds more than a range. What ties in
    the order and the hash is dealt over ranges by its place in the input: equal rows are the same whichever comes first.
    """
    h, t, at = (free_name(rows, x) for x in ("row_hash", "row_place", "row_at"))
    plain = [F.col(f"`{f.name}`") if f.dataType.typeName() != "map" else F.sort_array(F.map_entries(f"`{f.name}`")) for f in rows.schema]
    keys = [*[F.col(f"`{c}`").asc_nulls_first() for c in order], F.col(h), F.col(t)]
    dealt = rows.withColumns({h: F.xxhash64(*plain), t: F.monotonically_increasing_id()})
    dealt = dealt.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).drop(h, t)
    kept = fold(spark, dealt.withColumn(at, F.monotonically_increasing_id()), "numbered")
    # The id of a row is its partition times 2**33 plus its place there.
    part, place = F.shiftright(F.col(at), 33), F.col(at).bitwiseAND((1 << 33) - 1)
    p, o = free_name(kept, "row_part"), free_name(kept, "row_offset")
    sizes = kept.groupBy(part.alias(p)).agg(F.count("*").alias(o))
    before = sizes.withColumn(o, F.sum(o).over(Window.orderBy(p)) - F.col(o))
    # One row a partition of the range shuffle, whatever the input: this may be sent to every task.
    return kept.withColumn(p, part).join(F.broadcast(before), p).withColumn(name, F.col(o) + place).drop(p, o, at)


def sharded(spark: SparkSession, rows: DataFrame, shards: int = 8, order: list[str] = ("doc_id",), key: str = KEY) -> DataFrame:
    """rows with columns row_number, shard and slot (named otherwise where rows have them): a keyed shuffle of the rows by number.

    The place of a number is its permuted value; the shard is the place modulo the shards and the slot the place divided
    by them. Shards differ by one row at most and slots have no gaps. A null in the order comes first; repeated rows get a
    place each; an empty table stays empty. The order of rows and the partitions of the input don't matter.
    """
    name, shard, slot = (free_name(rows, x) for x in ("row_number", "shard", "slot"))
    out = numbered(spark, rows, list(order), name)
    place = free_name(out, "row_place")
    out = out.withColumn(place, permuted(F.col(name), out.count(), key))
    return out.withColumns({shard: (F.col(place) % shards).cast("int"), slot: F.floor(F.col(place) / shards).cast("long")}).drop(place)


def write_shards(out: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder a shard, its rows in the order of their slots within files that are dealt by ranges of slots."""
    spark = out.sparkSession
    out.repartitionByRange(partitions(spark), shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    # Written before it is dealt by range, which reads its input twice: the texts are read once.
    placed = sharded(spark, fold(spark, rows, "sizes"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
