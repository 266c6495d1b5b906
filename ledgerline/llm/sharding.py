"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, made of an offset and a step; the
shards take turns to claim their next free preference until the table is full, so their slot counts
differ by one at most, and adding or losing a shard moves few keys. A document's slot is a hash of its
id modulo the table's size; the table has a fixed number of rows and is broadcast, so placement is one
lookup a row.

Defined results: a null doc_id is placed by the key 'null'; repeated ids share a shard; no shards is an
error; the size must be a prime larger than the number of shards; columns of docs that are named slot or
shard, in any case, give way to the operator's own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import common as C

#: Slots of the table: a prime, and the bound of what is broadcast.
SLOTS = 65_537


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard number of each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if slots <= len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime larger than the number of shards")
    start = [_number(s, "offset") % slots for s in shards]
    step = [_number(s, "step") % (slots - 1) + 1 for s in shards]
    table = np.full(slots, -1, np.int32)
    turn = list(start)
    left = slots
    while left:
        for k in range(len(shards)):
            while table[turn[k]] >= 0:
                turn[k] = (turn[k] + step[k]) % slots
            table[turn[k]] = k
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of its md5, modulo the table's size."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def placed(docs: DataFrame, shards: list[str], slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """docs with their slot and shard name."""
    names = np.array(shards, dtype=object)
    table = pd.DataFrame({"slot": np.arange(slots, dtype=np.int32), "shard": names[fill_table(shards, slots)]})
    spark: SparkSession = docs.sparkSession
    lookup = F.broadcast(spark.createDataFrame(table, "slot int, shard string"))
    own = slot_of(F.col(key), slots).alias("slot")
    rest = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in ("slot", "shard")))
    return docs.select(C.packed(rest), own).join(lookup, "slot", "left").select("doc.*", "slot", "shard")
