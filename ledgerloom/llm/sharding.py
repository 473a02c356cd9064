"""Sharding by a permutation-filled lookup table (DataFrame functions only on the data path).

Every shard has a preference order over the slots of a prime-sized table (offset and skip from its name's hash). Shards take turns
claiming their next free slot until the table is full, so slots are dealt out evenly to within one, and
adding or removing a shard moves few slots. Rows are hashed to a slot; the table, whose size is a parameter, is
broadcast, so a row's place takes constant time and no shuffle: keys that hold a third of all rows don't meet anywhere.

Defined results: null keys hash like any value, so equal keys (repeated rows too) share a shard; an empty table gives an
empty result; the key columns come back with slot and shard, other columns are dropped.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS, SHARDS = 65_537, 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard in each slot. Bounded by ``slots``, whatever the data."""
    if not is_prime(slots) or len(shards) > slots or not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, at least one and at most as many as slots, which must be prime")

    def number(name: str, what: str) -> int:
        return int.from_bytes(hashlib.sha256(f"{what}:{name}".encode()).digest()[:8], "big")

    at = [number(s, "offset") % slots for s in shards]
    skip = [1 + number(s, "skip") % (slots - 1) if slots > 2 else 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            at[i] = (at[i] + skip[i]) % slots
            free -= 1
            if not free:
                return table


def slot_table(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) as a table that SQL functions make from two literals: no rows pass through Python."""
    filled = ",".join(map(str, lookup_table(names, slots)))
    rows = spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "i"))
    return rows.select("slot", F.get(F.array(*[F.lit(n) for n in names]), F.col("i").cast("int")).alias("shard"))


def place(docs: DataFrame, keys: list[str] | str = "doc_id", shards: list[str] | int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(keys, slot, shard): one row for each input row."""
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    keys = [keys] if isinstance(keys, str) else list(keys)
    table = slot_table(docs.sparkSession, names, slots).select(F.col("slot").alias("_slot"), F.col("shard").alias("_shard"))
    # a null changes nothing in the hash; the flag tells (null, 1) from (1, null)
    slot = F.pmod(F.xxhash64(*[x for k in keys for x in (F.col(k), F.col(k).isNull())]), F.lit(slots)).cast("int")
    inner = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], slot.alias("s"))
    out = inner.join(F.broadcast(table), F.col("s") == F.col("_slot"))  # as many rows as slots, whatever the data
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.col("s").alias("slot"), F.col("_shard").alias("shard"))
