"""Sharding (operator 6): a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size
(an offset and a step derived from its name), and the shards take turns claiming
their next free slot until the table is full.  Every shard gets an equal part of the
slots, give or take one, and when a shard goes, few slots change hands besides its own.  A row's slot is a hash
of its id modulo the table's size.  The table has ``SLOTS`` entries whatever the
data's size, so it is broadcast, and placement is one lookup per row with no shuffle of
the rows.

A null id has the slot of the empty string; repeated rows share their slot; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65537


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in ``shards``) of every slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards have to be one or more different names")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("slots has to be a prime of at least the number of shards")
    at = [_number(s, "offset") % slots for s in shards]
    step = [_number(s, "skip") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 32 bits of the id's md5, modulo the table's size (so other engines can compute it too)."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """(__slot, shard): the filled table."""
    return spark.createDataFrame([(i, shards[s]) for i, s in enumerate(fill(shards, slots))], "__slot int, shard string")


def place(docs: DataFrame, shards: Sequence[str], id_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``docs`` with the columns ``slot`` and ``shard`` (which replace columns of these names)."""
    table = lookup_table(docs.sparkSession, shards, slots)
    kept = docs.drop("slot", "shard").withColumn("__slot", slot_of(F.col(id_col), slots))
    return kept.join(F.broadcast(table), "__slot").select(*docs.drop("slot", "shard").columns, F.col("__slot").alias("slot"), "shard")
