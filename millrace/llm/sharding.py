"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: it starts at one hash of its name and steps by
another. The shards take turns, each claiming the first slot in its order that is still free, until the table is full. So
shards differ by one slot at most, and a shard that comes or goes moves few slots of the others. The table has a fixed size
and is broadcast; a key's slot is its hash modulo that prime.

Edge cases: a null key has a slot of its own, as the empty string has; repeated keys go to one shard; an empty table gives
an empty result; columns of the input are not read except for the key, and of two columns of one name the added one stays.
"""

from __future__ import annotations

import hashlib
from array import array

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_hash

#: A prime; shards hold within 1 % of each other as long as there are fewer than a hundredth of it.
SLOTS = 65537


def lookup_table(shards: list[str], slots: int = SLOTS) -> array:
    """The shard's index for each slot."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and at most as many as slots")
    digests = [hashlib.sha256(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "little") % slots for d in digests]
    step = [int.from_bytes(d[8:16], "little") % (slots - 1) + 1 for d in digests]
    table = array("i", [-1]) * slots
    left = slots
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                return table


def place(df: DataFrame, key: Column, shards: list[str], slots: int = SLOTS, seed: int = 11, names: tuple[str, str] = ("slot", "shard")) -> DataFrame:
    """Adds slot (int) and shard (string) to df under these names; df's own columns of these names are replaced.

    The table that is broadcast has a row for each slot, whatever df's size.
    """
    table = [(i, shards[k]) for i, k in enumerate(lookup_table(shards, slots))]
    slot_of = df.sparkSession.createDataFrame(table, "__slot int, __shard string")
    rows = df.withColumn("__slot", (key_hash(key, seed=seed) % slots).cast("int")).drop(*names)
    return rows.join(F.broadcast(slot_of), "__slot").withColumnsRenamed({"__slot": names[0], "__shard": names[1]})


def write_shards(placed: DataFrame, path: str, tasks_per_shard: int = 4, names: tuple[str, str] = ("slot", "shard")) -> None:
    """Writes a folder for each shard; tasks_per_shard tasks share one, so that a hot key's rows don't meet in one task. names: as place gave them."""
    missing = [n for n in names if n not in placed.columns]
    if missing:
        raise ValueError(f"no columns {missing}: say which names place has given")
    rest = [F.col(f"`{c}`") for c in placed.columns if c not in names]
    if not rest:
        raise ValueError("no columns beside slot and shard: there is nothing to write")
    salt = F.pmod(F.xxhash64(*rest), F.lit(tasks_per_shard))
    placed.drop(names[0]).repartition(names[1], salt).write.partitionBy(names[1]).parquet(path)
