"""Sharding through a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (an
offset and a step from hashes of its name). Shards take turns; at its turn a
shard claims the first slot of its permutation that is still free, until the
table is full. A row's key is hashed to a slot, and the broadcast table gives
the shard: one hash lookup a row, no shuffle. Adding or removing a shard moves
few other keys, because most slots keep their first taker.

The table depends on the shard list alone (size: a parameter), never on data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table; a prime, at least a hundred times the shards keeps their shares within one per cent.
TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Index into ``shards`` per slot. Shard names must differ; ``size`` must be a prime of at least their number."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be a non-empty list of different names")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime, not below the number of shards")
    digests = [hashlib.md5(name.encode()).digest() for name in shards]
    place = [int.from_bytes(d[:8], "big") % size for d in digests]
    step = [int.from_bytes(d[8:], "big") % (size - 1) + 1 if size > 2 else 1 for d in digests]
    table = [-1] * size
    free = size
    while free:
        for shard in range(len(shards)):
            while table[place[shard]] >= 0:
                place[shard] = (place[shard] + step[shard]) % size
            table[place[shard]] = shard
            free -= 1
            if not free:
                break
    return table


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """The filled table as rows (slot int, shard_id int), one a slot, for a broadcast of known size."""
    literal = ",".join(map(str, fill_table(shards, size)))
    slots = spark.range(1).select(F.posexplode(F.split(F.lit(literal), ",")).alias("slot", "shard"))
    return slots.select("slot", F.col("shard").cast("int").alias("shard_id"))


def slot_of(keys: Sequence[Column], size: int = TABLE_SIZE) -> Column:
    """Slot of a key. Null parts count as a value of their own; parts are separated, so ('a', 'bc') is not ('ab', 'c')."""
    parts = [F.coalesce(F.concat(F.length(k.cast("string")).cast("string"), F.lit(":"), k.cast("string")), F.lit("~")) for k in keys]
    digits = F.substring(F.md5(F.concat(*parts)), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") % size).cast("int")


def assign(
    df: DataFrame,
    keys: Sequence[str],
    shards: Sequence[str],
    size: int = TABLE_SIZE,
    row_key: str | None = None,
    names: tuple[str, str] = ("slot", "shard_id"),
) -> DataFrame:
    """``df`` with the slot and the shard of each row.

    Rows with equal ``keys`` share a shard, nulls included. With ``row_key``,
    keys that own more rows than a mean shard does are spread: their rows are
    salted by ``row_key`` over as many sub-keys as mean shards they fill. There
    are fewer such keys than shards, so the table of them is small enough to
    broadcast. Empty input gives an empty result; input columns named like the
    two new ones are replaced.
    """
    slot, shard = names
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    key_columns = [F.col("row")[k] for k in keys]
    if row_key is not None:
        counts = rows.groupBy(*[c.alias(f"k{i}") for i, c in enumerate(key_columns)]).count()
        total = counts.agg(F.sum("count").alias("rows"))
        ways = F.ceil(F.col("count") * len(shards) / F.col("rows")).cast("int")
        hot = counts.join(F.broadcast(total), F.col("count") * len(shards) > F.col("rows")).withColumn("ways", ways).drop("count", "rows")
        same = F.lit(True)
        for i, c in enumerate(key_columns):
            same = same & c.eqNullSafe(F.col(f"k{i}"))
        rows = rows.join(F.broadcast(hot), same, "left").select("row", "ways")
        key_columns.append(F.when(F.col("ways").isNotNull(), F.pmod(F.xxhash64(F.col("row")[row_key]), F.col("ways"))))
    table = lookup_table(df.sparkSession, shards, size)
    placed = rows.select("row", slot_of(key_columns, size).alias("own_slot")).join(F.broadcast(table), F.col("own_slot") == F.col("slot"))
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in names]
    return placed.select(*kept, F.col("own_slot").alias(slot), F.col("shard_id").alias(shard))
