"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table (an offset
and a skip from its name) and the shards take turns claiming the next slot of
theirs that is still free.  All shards then own equally many slots but for one,
and adding or removing a shard moves little besides that shard's slots.  The
table has a fixed number of rows, so it is broadcast, and placing a key is one
hash and one lookup.

Defined cases: a null key is hashed as the empty text, repeated keys go to one
shard, an empty table gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Slots, a prime: about 1,000 for each of SHARDS, so shards' shares differ by a thousandth. The table of two numbers a slot has 1 MB.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def lookup_table(shards: tuple[str, ...] | list[str], slots: int = SLOTS) -> np.ndarray:
    """The index of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("give one or more different shard names, no more than slots")
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots has to be prime")
    digest = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "little") % slots for d in digest]
    skip = [int.from_bytes(d[8:16], "little") % (slots - 1) + 1 for d in digest]
    owner, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            j = at[i]
            while owner[j] >= 0:
                j = (j + skip[i]) % slots
            owner[j] = i
            at[i] = (j + skip[i]) % slots
            left -= 1
            if not left:
                return np.array(owner, dtype=np.int32)


def place(df: DataFrame, key: str = "doc_id", shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """key, slot and shard of each row of df."""
    owner = lookup_table(shards, slots)
    table = df.sparkSession.createDataFrame(pd.DataFrame({"slot": np.arange(slots, dtype=np.int64), "shard": owner}))
    keyed = df.select(key, F.pmod(F.xxhash64(common.id_text(key)), F.lit(slots)).alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select(key, "slot", "shard")


def op10_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(common.documents(spark, sf_dir))


QUERIES = {"op10_shard_placement": op10_shard_placement}
ORACLES: dict[str, str] = {}
