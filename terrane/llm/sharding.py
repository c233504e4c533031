"""Sharding with a permutation-filled lookup table, in DataFrame operations only.

Each shard walks the slots of a table of prime size in an order of its own, given by an offset and a skip.
The shards take turns; each claims the first slot in its order that is still free, until the table is
full. So all shards own nearly the same number of slots, and a shard that goes or comes moves few others'
slots. The table is a function of the parameters alone, so its size is known: it is broadcast, and a
document finds its shard by one look-up of a hash of its id.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import every, fresh

SHARDS = 16
SLOTS = 2039
MOST_SLOTS = 1_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: int = SHARDS, slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """The shard of each slot. slots must be prime; a shard of weight w claims w slots a turn (0: none)."""
    weights = weights or [1] * shards
    if len(weights) != shards or shards < 1 or max(weights) < 1 or min(weights) < 0:
        raise ValueError("a weight of 0 or more for each shard, and one of 1 or more, are needed")
    if not shards <= slots <= MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    at = [_number(f"offset-{s}") % slots for s in range(shards)]
    skip = [_number(f"skip-{s}") % (slots - 1) + 1 for s in range(shards)]
    table, free = [-1] * slots, slots
    while free:
        for s in range(shards):
            for _ in range(min(weights[s], free)):
                while table[at[s]] >= 0:
                    at[s] = (at[s] + skip[s]) % slots
                table[at[s]] = s
                free -= 1
    return table


def slot(key: Column, slots: int) -> Column:
    """A slot for a key: the first 60 bits of its MD5. Null has a slot as the string null."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots


def table_frame(spark: SparkSession, shards: int, slots: int, weights: list[int] | None = None) -> DataFrame:
    """(slot, shard): the table as a literal array, laid out by the JVM."""
    filled = ",".join(map(str, lookup_table(shards, slots, weights)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "shard")).select(
        F.col("slot").cast("long").alias("slot"), F.col("shard").cast("int").alias("shard")
    )


def sharded(docs: DataFrame, key_col: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """docs and a column shard from 0 to shards - 1 (named shard_ and so on if docs has one).

    Equal keys share a shard; the order and number of rows don't matter; a null key has a place of its own; an
    empty table stays empty. No shuffle: the only exchange is the broadcast of the table's `slots` rows.
    """
    name, at = fresh(docs.columns, "shard"), fresh(docs.columns, "slot")
    if name == at:
        at += "_at"
    table = table_frame(docs.sparkSession, shards, slots, weights).select(F.col("slot").alias(at), F.col("shard").alias(name))
    return docs.withColumn(at, slot(F.col(key_col), slots)).join(F.broadcast(table), at).select(*every(docs.columns), name)
