"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target over its size is how often each of its documents is wanted: a whole number of copies and
a fraction. Two documents with fractions at a time pass mass (fraction times words) to and fro, at random
and with unchanged expectation, until one of the fractions is 0 or 1. So the words taken stay the same at
each step. A bucket of a source is folded in this way down to one document that is still fractional, and
the buckets' residuals are folded again, level by level, as a tree. At the root of a source one document
is left and is rounded at random: a source misses its target by the words of one document at most.

Rows that are equal in all columns are decided as a group: of k rows with a fraction p, the whole part of k * p
takes one more copy in any case, and only what is left is rounded, as one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from . import bloom
from .common import BLANKS, SPACED_WORD, checkpointed, every, fresh, in_parts

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Documents that one fold takes on average. It bounds a group's rows at every level of the tree.
BUCKET = 512
SEED = 20240607
#: Rows that one task makes of one group of equal rows; a larger group is dealt to several.
CHUNK = 10_000
#: Sources of which the targets are broadcast; more are joined.
MOST_SOURCES = 100_000
#: Bytes of a row of numbers, and of a word with its blank, where sizes of tables are reckoned.
ROW_BYTES, WORD_BYTES = 64, 8


def words(text: Column) -> Column:
    """The number of words, counted in a text that has one letter for each: no array of words is made."""
    text = text.cast("string")
    letters = F.regexp_replace(text, rf"{BLANKS}*{SPACED_WORD}{BLANKS}*", "w")
    return F.when(F.regexp_like(text, F.lit(SPACED_WORD)), F.length(letters)).otherwise(0).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Of (source, source_size), one row a source: (source, source_size, target).

    Sources in code point order, null last, get the weights in turn and part share * all words by them. No
    target exceeds most * source_size: what is over goes to the others by weight until none is above.
    This has a closed form. With sources sorted by the level at which they are full, most * size / weight, a
    source is full if the level that is left for it and all later ones is higher than its own.
    The windows without a key run over one row a source.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    cap = F.col("source_size") * F.lit(float(most))
    t = sizes.withColumn("weight", weight).withColumn("cap", cap)
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    t = t.withColumn("level", left / F.sum("weight").over(after)).withColumn("nth", F.row_number().over(by_level))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))).over(W.partitionBy())
    t = t.withColumn("level", first["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return t.select("source", "source_size", target.alias("target"))


def _fold(items: Column) -> Column:
    """Of items (r, draw, key, mass, p), sorted by r: (done, rest), where rest is the one still fractional.

    mass is the words that the item stands for; p mass is passed between the item at hand and the one kept. The
    item's draw decides which way. It must not depend on r, or the draws would follow the order of the steps.
    """

    def settled(x: Column, extra: Column) -> Column:
        return F.array(F.struct(x["key"].alias("key"), extra.cast("int").alias("extra")))

    def kept(x: Column, p: Column) -> Column:
        return F.struct(*(x[c].alias(c) for c in ("r", "draw", "key", "mass")), p.alias("p"))

    def step(state: Column, x: Column) -> Column:
        a = state["rest"]
        up = F.least((1 - a["p"]) * a["mass"], x["p"] * x["mass"])  # what a can take from x
        down = F.least(a["p"] * a["mass"], (1 - x["p"]) * x["mass"])
        rises = x["draw"] * (up + down) < down
        a_full = rises & ((1 - a["p"]) * a["mass"] <= x["p"] * x["mass"])
        a_none = ~rises & (a["p"] * a["mass"] <= (1 - x["p"]) * x["mass"])
        x_p = F.when(rises, x["p"] - up / x["mass"]).otherwise(x["p"] + down / x["mass"])
        a_p = F.when(rises, a["p"] + up / a["mass"]).otherwise(a["p"] - down / a["mass"])
        done = F.when(a_full | a_none, settled(a, a_full)).otherwise(settled(x, ~rises))
        rest = F.when(a_full | a_none, kept(x, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x_p)))).otherwise(
            kept(a, F.greatest(F.lit(0.0), F.least(F.lit(1.0), a_p)))
        )
        return F.struct(F.concat(state["done"], done).alias("done"), rest.alias("rest"))

    begin = F.element_at(items, 1)
    first = F.struct(F.slice(settled(begin, F.lit(0)), 1, 0).alias("done"), begin.alias("rest"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), first, step)


def _random(seed: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def rounded(fractions: DataFrame, most: int, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """Of (source, ..., mass, p) with 0 < p < 1 and mass > 0: the columns without these two, and extra, 0 or 1.

    The columns without mass and p tell the rows apart. most: at least the number of rows of the largest source; it
    sets the number of levels. The rows of a level are dealt by a hash of their own, so a source with many documents
    has many buckets.
    """
    keys = [c for c in fractions.columns if c not in ("mass", "p")]
    now, done, level = fractions.select(F.struct(*keys).alias("key"), "mass", "p"), [], 0
    while True:
        parts = -(-most // bucket)
        part = F.pmod(F.xxhash64(F.lit(seed + level), "key"), F.lit(parts)) if parts > 1 else F.lit(0).cast("long")
        order, draw = (_random(seed + salt + level, "key") for salt in (100, 300))
        item = F.struct(order.alias("r"), draw.alias("draw"), "key", "mass", "p")
        folded = (
            now.groupBy(F.col("key.source").alias("source"), part.alias("part"))
            .agg(F.sort_array(F.collect_list(item)).alias("items"))
            .select(_fold(F.col("items")).alias("f"))
        )
        done.append(folded.select(F.explode("f.done").alias("d")).select("d.*"))
        now = folded.select("f.rest.*").drop("r", "draw")
        if parts == 1:
            break
        most, level = parts, level + 1
    last = now.select("key", (_random(seed + 200, "key") < F.col("p")).cast("int").alias("extra"))
    for d in done:
        last = last.union(d)
    return last.select("key.*", "extra")


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all of a row's columns, but for those of types that have none."""
    return F.xxhash64(*(c for c, f in zip(every(docs.columns), docs.schema.fields, strict=True) if _hashable(f.dataType)))


def _decided(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> tuple[DataFrame, DataFrame, dict]:
    """(groups, goals, facts). A group of equal rows: id, source, size, h, rows, source_size, target, whole, and extra, how
    many of the rows take one copy more than whole. Goals: source, source_size, target, whole. Facts: sums over all."""
    slim = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), _row_hash(docs).alias("h")
    )
    alike = checkpointed(slim.groupBy("id", "source", "size", "h").agg(F.count("*").alias("rows")), docs.count() * ROW_BYTES)
    sizes = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"), F.max("rows").alias("alike"))
    goals = targets(sizes.select("source", "source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    goals = goals.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("int")).withColumn("p", F.col("rate") - F.col("whole"))
    goals = checkpointed(goals.drop("rate"))
    facts = sizes.agg(F.max("n").alias("most"), F.max("alike").alias("alike"), F.sum("source_size").alias("words"), F.count("*").alias("sources")).first().asDict()
    # one row a source; AQE broadcasts it only if it is small
    units = F.col("rows") * F.col("p")
    with_goal = alike.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select(
        "d.*", "source_size", "target", "whole", F.floor(units).alias("sure"), (units - F.floor(units)).alias("p")
    )
    some = with_goal.filter("p > 0 and size > 0").select("id", "source", "size", "h", F.col("size").cast("double").alias("mass"), "p")
    extra = rounded(some, facts["most"] or 1, seed).alias("e")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("id", "source", "size", "h")]
    alone = F.when((F.col("w.size") == 0) & (_random(seed, "w.id", "w.source", "w.h") < F.col("p")), 1).otherwise(0)
    decided = with_goal.alias("w").join(extra, same[0] & same[1] & same[2] & same[3], "left")
    decided = decided.select("w.*", (F.col("sure") + F.coalesce("e.extra", alone)).alias("extra")).drop("sure", "p")
    return decided, goals, facts


def _repeated(df: DataFrame, times: str, nth: str, most: int, *spread: str) -> DataFrame:
    """Each row so often as a column says, numbered from 1. Rows of many copies, of which there are at most `most`, are dealt out first."""
    if most <= CHUNK:
        return df.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    few, many = df.filter(F.col(times) <= CHUNK), df.filter(F.col(times) > CHUNK)
    parts = many.withColumn(nth, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / CHUNK)))).repartition(*spread, nth)
    begin = F.col(nth) * CHUNK
    parts = parts.withColumn(nth, F.explode(F.sequence(begin + 1, F.least(begin + CHUNK, F.col(times)))))
    return _repeated(few, times, nth, 1).union(parts)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(id, size, source_size, target, copies, taken) for each row of docs; no Python runs on the executors.

    Words are runs of characters other than space and \t to \r. taken = copies * size. Defined results: null
    text has size 0, and a document without words takes none (its copies are those of the source, rounded
    by its own hash); of rows that are equal in all columns so many take a copy more as their fractions add up to;
    ids of any type, and a null id or source, are values like others; an empty table gives an empty one. Reruns agree.
    """
    decided, _, facts = _decided(docs, id_col, text_col, source_col, seed)
    decided = in_parts(decided, docs.count() * ROW_BYTES)
    copies = F.col("whole") + (F.col("nth") <= F.col("extra")).cast("int")
    return _repeated(decided, "rows", "nth", facts["alike"] or 1, "h").select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mixture takes it: not at all, once or twice. The columns stay.

    The whole copies of a source are made where its rows lie. Only rows that take one copy more are moved, to be joined
    with the decisions; which these may be a Bloom filter of a checked size says, and beyond it all rows may. Results
    for nulls, empty texts, repeated rows and empty tables are those of mixture.
    """
    n = {k: fresh(docs.columns, k) for k in ("g_source", "g_whole", "k_id", "k_h", "k_rows", "k_extra", "k_nth", "k_row")}
    decided, goals, facts = _decided(docs, id_col, text_col, source_col, seed)
    goals = goals.filter("whole > 0").select(F.col("source").alias(n["g_source"]), F.col("whole").alias(n["g_whole"]))
    goals = F.broadcast(goals) if facts["sources"] <= MOST_SOURCES else goals
    whole = docs.join(goals, F.col(source_col).cast("string").eqNullSafe(F.col(n["g_source"])))
    out = whole.withColumn(n["k_nth"], F.explode(F.sequence(F.lit(1), F.col(n["g_whole"])))).select(every(docs.columns))

    extras = checkpointed(decided.filter("extra > 0").select("id", "h", "rows", "extra"), docs.count() * ROW_BYTES)
    may, _ = bloom.split(docs.withColumn(n["k_h"], _row_hash(docs)), F.col(n["k_h"]), extras.select(F.col("h").alias("key")))

    def joined(wanted: DataFrame) -> DataFrame:
        keys = wanted.select(F.col("id").alias(n["k_id"]), F.col("h").alias("h_"), F.col("extra").alias(n["k_extra"]))
        return may.join(keys, F.col(id_col).eqNullSafe(F.col(n["k_id"])) & (F.col(n["k_h"]) == F.col("h_")))

    out = out.union(joined(extras.filter("extra = rows")).select(every(docs.columns)))
    if (facts["alike"] or 1) > 1:  # of equal rows some take one copy more: any of them may stand for these
        one = joined(extras.filter("extra < rows")).groupBy(n["k_id"], n["k_h"], n["k_extra"]).agg(F.first(F.struct(*every(docs.columns))).alias(n["k_row"]))
        one = _repeated(one, n["k_extra"], n["k_nth"], facts["alike"], n["k_h"])
        out = out.union(one.select(*(F.col(n["k_row"])[c].alias(c) for c in docs.columns)))
    return in_parts(out, int((facts["words"] or 0) * SHARE * WORD_BYTES))
