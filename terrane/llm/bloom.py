"""Bloom filters that DataFrame operations make and ask.

A filter is an array of 64-bit words in a table of one row. The executors combine the words; a query takes the
row as a scalar subquery, so the words go from the JVM's driver to the tasks with the stage, once for all the
places that ask, and neither Python nor the text of a plan holds them. Sizes are checked before one is made.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, in_parts

#: Bits a key and hashes of a filter: about one mistake in 50.
BITS = 8
HASHES = 5
#: Where a filter would be larger, joins take its place.
MOST_BYTES = 16_000_000
#: Words that one row of the first combining step holds.
BLOCK = 512
#: Bytes of a place and its bit, where sizes of tables are reckoned.
BIT_BYTES = 16


@dataclass(frozen=True)
class Filter:
    salt: int
    size: int  #: 64-bit words
    hashes: int
    table: DataFrame  #: one row, column words

    def places(self, key: Column) -> list[Column]:
        bits = F.lit(self.size * 64)
        one, two = (F.pmod(F.xxhash64(F.lit(x), key), bits) for x in (self.salt, -1 - self.salt))
        return [F.pmod(one + two * i, bits) for i in range(self.hashes)]

    def has(self, key: Column) -> Column:
        found, words = F.lit(True), self.table.scalar()
        for p in self.places(key):
            word = F.get(words, F.floor(p / 64).cast("int"))
            found = found & (F.getbit(word, (p % 64).cast("int")) == 1)
        return found


def make_filter(keys: DataFrame, count: int, salt: int, bits: float = BITS, hashes: int = HASHES) -> Filter:
    """A filter of the column key, with so many bits for each of count keys."""
    size = max(1, math.ceil(count * bits / 64))
    places = Filter(salt, size, hashes, keys).places(F.col("key"))
    ones = keys.select(F.explode(F.array(*places)).alias("p")).select(F.floor(F.col("p") / 64).alias("w"), F.expr("shiftleft(1L, cast(p % 64 AS int))").alias("b"))
    none = keys.sparkSession.range(size).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    most = (count * hashes + size) * BIT_BYTES
    words = in_parts(ones.union(none).groupBy("w").agg(F.bit_or("b").alias("b")), most)
    in_order = lambda: F.sort_array(F.collect_list(F.struct("w", "b")))
    blocks = words.groupBy(F.floor(F.col("w") / BLOCK).alias("block")).agg(F.transform(in_order(), lambda x: x["b"]).alias("b"))
    whole = in_parts(blocks, size * BIT_BYTES).withColumnRenamed("block", "w").agg(F.flatten(F.transform(in_order(), lambda x: x["b"])).alias("words"))
    return Filter(salt, size, hashes, checkpointed(whole))


def filter_of(keys: DataFrame, most_bytes: int | None = None) -> Filter | None:
    """A filter of the column key, or None if it would take more than most_bytes."""
    count = keys.count()
    return make_filter(keys, count, 0) if count * BITS <= (MOST_BYTES if most_bytes is None else most_bytes) * 8 else None


def split(df: DataFrame, key: Column, keys: DataFrame, most_bytes: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows that may have one of the keys, rows that surely have none). Without a filter all rows may: (df, None).

    A join with the keys then has to move the first part only. Null keys are in the second one.
    """
    known = filter_of(keys, most_bytes)
    if known is None:
        return df, None
    may = F.coalesce(known.has(key), F.lit(False))
    return df.filter(may), df.filter(~may)
