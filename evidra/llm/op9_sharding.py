"""Placement through a permutation-filled lookup table (native).

The shards take turns; at its turn a shard claims the first free slot in its
own order of preference, until every slot of the prime-sized table is taken.
Loads differ by one slot at most, and when a shard leaves, few keys of the
others move.  The table depends on the shard names alone and has ``slots``
rows, so it is broadcast whatever the data, and a key is placed by one lookup.

Defined cases: a null key is placed like the empty string; repeated keys share
a shard; an empty table gives an empty result; other columns pass through
``place`` unless they are named ``slot`` or ``shard``, which it replaces.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 4099
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """Slot -> index of its shard.  A pure function of the names; no data."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if not _prime(slots) or slots < len(shards):
        raise ValueError("the table's size must be a prime, and no fewer than the shards")
    start = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, at, left = [-1] * slots, start[:], slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                return table


def lookup(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot, shard), from literals."""
    filled = F.split(F.lit(",".join(map(str, fill_table(shards, slots)))), ",")
    return spark.range(1).select(F.posexplode(filled).alias("slot", "i")).select("slot", F.element_at(F.array(*[F.lit(s) for s in shards]), F.col("i").cast("int") + 1).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    number = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    return (number % slots).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with its slot and shard; no shuffle, no Python."""
    if key in ("slot", "shard"):
        raise ValueError("the key may not be named slot or shard")
    placed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return placed.join(F.broadcast(lookup(df.sparkSession, shards, slots)), "slot", "left")
