"""Sharding by a permutation-filled lookup table.

Method. Every shard has a preference order over the slots of a prime-sized table: offset + k * skip, a permutation
because the size is prime. Shards take turns; at its turn a shard claims the first slot of its order that is
free, until all slots are claimed. Shares differ by one slot at most, and a lost shard moves few other keys.
The table has a fixed number of slots, so it is broadcast whatever the data's size; a row's slot is a hash of
its key modulo the table's size, its shard one lookup.

Cases. A null key is hashed as a key of its own. Repeated rows go to the same shard. An empty table gives an empty
result. Only the key column is read; texts are not. Columns of the user's that are named slot or shard stay, and the new
ones get as many underscores behind their names as are needed.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import boxed

SLOTS = 65_537
SHARDS = 64


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """For each slot the number of its shard. Only names set a shard's order, their sequence its turn."""
    if slots < 2 or any(slots % x == 0 for x in range(2, isqrt(slots) + 1)):
        raise ValueError("the number of slots must be prime")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, one at least and no more than slots")
    table = np.full(slots, -1, np.int32)
    steps = np.arange(slots, dtype=np.int64)
    orders = [((_number(f"offset/{x}") % slots + steps * (_number(f"skip/{x}") % (slots - 1) + 1)) % slots).tolist() for x in shards]
    at = [0] * len(shards)
    claimed, taken = 0, bytearray(slots)
    while True:
        for shard, order in enumerate(orders):
            k = at[shard]
            while taken[order[k]]:
                k += 1
            slot, at[shard] = order[k], k + 1
            taken[slot] = 1
            table[slot] = shard
            claimed += 1
            if claimed == slots:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """XXH64 (seed 42) of the key's text, modulo the table's size."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\x00null"))), F.lit(slots)).cast("int")


def _free_name(name: str, rows: DataFrame) -> str:
    while name in {x.lower() for x in rows.columns}:
        name += "_"
    return name


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """`rows` with `slot` and `shard`: a broadcast of `slots` small rows, no shuffle."""
    slot, shard = (_free_name(x, rows) for x in ("slot", "shard"))
    table = lookup_table(shards, slots)
    lookup = rows.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(table.tolist())], "slot INT, shard STRING")
    placed = boxed(rows, slot=slot_of(F.col(f"`{key}`"), slots)).join(F.broadcast(lookup), "slot")
    return placed.select("row.*", F.col("slot").alias(slot), F.col("shard").alias(shard))


def default_shards(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]


def shard_documents(docs: DataFrame, shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """One row for each document: its slot and its shard."""
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return place(keys, "doc_id", shards or default_shards(), slots).select("doc_id", "slot", "shard")
