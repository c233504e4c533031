"""MinHash near-duplicate detection with odd sketches.

1. One pass over the texts makes, for each document, the size and a 128-bit fingerprint of its set of
   word shingles, the keys of its MinHash bands and its odd sketch: the MinHash samples folded into a
   parity bitmap.
2. Documents with the same set are one class. Only its smallest doc_id goes on.
3. In each bucket of a band, every class is paired with one centre, the class that shares most buckets, and
   not with all others. XOR population counts of the odd sketches estimate the similarity of a pair; pairs
   far below the threshold go. The rest is confirmed on full sets, read from the texts again, and linked
   classes are joined to components.
4. All classes that met in buckets of one centre are its ball: any two classes of a bucket are in one. A ball that
   still spans several components is looked through for links between them. A small one is compared within a
   task, by sketches first and then on full sets as a matrix product; only links that join components leave it.
5. Members of large balls, such as pages of one template, are joined on their rare shingles. With shingles in one
   order from rare to common, two sets that are similar enough share one of the first few, and a smaller set's share
   of them leaves out what a template has in common. Only members that share such a shingle are compared.

Nothing is capped: a centre with many partners is dealt to several tasks by the amount of text, and the holders of a
shingle that is rare nowhere are compared in blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import checkpointed, every, fresh, in_parts, slices
from .components import components

SHINGLE = 5
BANDS = 24
ROWS = 5
SKETCH_BITS = 256
#: A pair goes on to the full sets if its estimate is at most so far below the threshold: some six
#: standard deviations of an estimate from BANDS * ROWS samples at a similarity of 0.85.
MARGIN = 0.3
#: Shingles of partners that one task confirms against one centre.
TASK_SHINGLES = 2_000_000
#: Members of a ball, or holders of a shingle, and their shingles, that one task compares.
BLOCK = 500
BLOCK_SHINGLES = 500_000
#: Counters of the shingles of large balls' members; shingles that share one count as equally rare.
COUNTERS = 1 << 20
#: Bytes of a row of few numbers, of a class with its bands and sketch, and of a word with its blank, where sizes of tables are reckoned.
ROW_BYTES, CLASS_BYTES, WORD_BYTES = 64, 300, 8

U64 = np.uint64
_rng = np.random.RandomState(20240607)
_POWERS = (_rng.randint(0, 2**62, SHINGLE).astype(U64) << U64(1)) | U64(1)
_MULTIPLY = (_rng.randint(0, 2**31, (BANDS * ROWS, 1)).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_FLIP = _rng.randint(0, 2**32, (BANDS * ROWS, 1), dtype=np.uint64).astype(np.uint32)
_BAND = (_rng.randint(0, 2**62, (BANDS, ROWS)).astype(U64) << U64(1)) | U64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """For each UTF-8 text, the sorted distinct 64-bit hashes of its shingles.

    Words are what bytes.split() gives after lower(): runs of bytes other than space and \\t to \\r, with
    A-Z lowered. A text of fewer than SHINGLE words is one shingle; no word at all, none.
    """
    words = [t.lower().split() if t else [] for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    values = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()), U64, len(flat.dictionary))
    hashes = values[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, U64)
    n = max(0, len(hashes) - SHINGLE + 1)
    rolled = np.zeros(n, U64)
    for j in range(SHINGLE):
        rolled += hashes[j : j + n] * _POWERS[j]
    rolled = _mix(rolled)
    ends = np.cumsum(lengths)
    out = []
    for end, length in zip(ends.tolist(), lengths.tolist(), strict=True):
        begin = end - length
        if length >= SHINGLE:
            out.append(np.unique(rolled[begin : end - SHINGLE + 1]))
        elif length:
            out.append(_mix((hashes[begin:end] * _POWERS[:length]).sum(keepdims=True) + U64(length)))
        else:
            out.append(np.zeros(0, U64))
    return out


def _minhash(shingles: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    x = (shingles >> U64(32)).astype(np.uint32)
    for i in range(0, len(x), 1024):
        low = np.minimum(low, ((x[i : i + 1024] ^ _FLIP) * _MULTIPLY).min(axis=1))
    return low


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Rows of MinHash samples to rows of 64-bit words: each (place, sample) flips one bit."""
    n, k = samples.shape
    bit = _mix(samples.astype(U64) + (np.arange(k, dtype=U64) << U64(32))) % U64(SKETCH_BITS)
    at = np.arange(n)[:, None] * SKETCH_BITS + bit.astype(np.int64)
    odd = (np.bincount(at.ravel(), minlength=n * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(n, SKETCH_BITS // 64)


def most_differing(threshold: float) -> int:
    """The largest count of differing sketch bits at which the estimate is threshold - MARGIN or more."""
    apart = 1 - max(0.0, threshold - MARGIN)
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-4 * BANDS * ROWS * apart / SKETCH_BITS)))


SIGNED = "id long, n long, fp binary, bands array<long>, s0 long, s1 long, s2 long, s3 long"
SKETCH = ("s0", "s1", "s2", "s3")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for begin, end in slices(whole, "text"):
            batch = whole.slice(begin, end - begin)
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist())
            samples = np.stack([_minhash(s) for s in sets])
            keys = np.zeros((len(sets), BANDS), U64)
            for j in range(ROWS):
                keys += (samples[:, j * BANDS : (j + 1) * BANDS].astype(U64) + U64(1)) * _BAND[:, j]
            keys = _mix(keys + np.arange(BANDS, dtype=U64)).view(np.int64)
            sketch = odd_sketches(samples)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel()),
                    *(pa.array(sketch[:, i]) for i in range(len(SKETCH))),
                ],
                ["id", "n", "fp", "bands", *SKETCH],
            )


def _differing(a: str, b: str):
    return sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH), F.lit(0))


def _alike(a: str, b: str, percent: int):
    """What pairs of the given similarity meet: sizes are near enough and few sketch bits differ."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small * 100 >= large * percent) & (_differing(a, b) <= most_differing(percent / 100))


def _confirm(percent: int):
    def confirm(group: pa.Table) -> pa.Table:
        rows = group.select(["centre", "other", "text"]).to_pydict()
        centres, others = [], []
        for other, text in zip(rows["other"], rows["text"], strict=True):
            (centres if other is None else others).append((other, text.encode()))
        links = set()
        if centres and others:
            whole = shingle_sets([t for _, t in centres])
            for i in range(0, len(others), 64):
                part = others[i : i + 64]
                for (other, _), theirs in zip(part, shingle_sets([t for _, t in part]), strict=True):
                    for ours in whole:
                        both = len(np.intersect1d(ours, theirs, assume_unique=True))
                        if both and 100 * both >= percent * (len(ours) + len(theirs) - both):
                            links.add(other)
        centre = rows["centre"][0]
        return pa.table({"a": pa.array([centre] * len(links), pa.int64()), "b": pa.array(sorted(links), pa.int64())})

    return confirm


def _only(texts: DataFrame, ids: DataFrame, many: int) -> DataFrame:
    """The texts with the given ids, found once for all that follows. Most others are left out before any text is moved."""
    ids = checkpointed(ids, many // BANDS)
    may, _ = bloom.split(texts, F.col("id"), ids.select(F.col("id").alias("key")))
    return may.join(ids, "id", "left_semi")


def confirmed(texts: DataFrame, pairs: DataFrame, percent: int, size: int, many: int) -> DataFrame:
    """Of pairs (a, b, n): those whose full sets are similar. n is the size of b's set; size and many are bounds on the bytes
    of the texts and of a row of few numbers for each band of each of them.

    The texts of a centre's partners are dealt to as many tasks as they need, the centre's own text to
    each of these.
    """
    parts = pairs.groupBy("a").agg((F.floor(F.sum(F.col("n") + 64) / TASK_SHINGLES) + 1).cast("int").alias("parts"))
    parts = checkpointed(parts, many // BANDS)  # a table of its own: AQE splits a join's hot keys only between plain shuffles
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = checkpointed(_only(texts, needed, many), size)
    others = (
        pairs.join(parts, "a")
        .withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        .join(texts.withColumnRenamed("id", "b"), "b")
        .select(F.col("a").alias("centre"), "part", F.col("b").alias("other"), "text")
    )
    centres = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(
        texts.withColumnRenamed("id", "a"), "a"
    )
    rows = others.union(centres.select(F.col("a").alias("centre"), "part", F.lit(None).cast("long"), "text"))
    return rows.groupBy("centre", "part").applyInArrow(_confirm(percent), "a long, b long")


def _alike_members(percent: int):
    """Members of a block that look similar to one of another component: sizes near, few sketch bits apart."""
    most = most_differing(percent / 100)

    def alike(group: pa.Table) -> pa.Table:
        col = {c: group.column(c).to_numpy() for c in ("n", "component", "side", *SKETCH)}
        sketch = np.stack([col[s] for s in SKETCH], axis=1).view(U64)
        right = np.flatnonzero(col["side"] != 1)
        found = np.zeros(len(sketch), bool)
        for i in np.flatnonzero(col["side"] != 2).tolist():
            n = col["n"][right]
            near = right[
                (col["component"][right] != col["component"][i])
                & (np.minimum(n, col["n"][i]) * 100 >= np.maximum(n, col["n"][i]) * percent)
            ]
            near = near[np.bitwise_count(sketch[near] ^ sketch[i]).sum(axis=1) <= most]
            found[near] = True
            found[i] |= len(near) > 0
        return group.select(["centre", "x", "y", "id", "component"]).filter(pa.array(found))

    return alike


def common_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections, as products of a 0-1 matrix, some columns at a time."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[inverse] > 1
    row, place = row[shared], (np.cumsum(count > 1) - 1)[inverse[shared]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    cuts = np.searchsorted(place, np.arange(0, (place[-1] if len(place) else 0) + columns + 1, columns))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if b > a:
            part = np.zeros((len(sets), columns), np.float32)
            part[row[a:b], place[a:b] - k * columns] = 1
            out += part @ part.T
    return out.astype(np.int64)


def _joining_links(percent: int):
    """Links of a block between components, as few as join all that are linked."""

    def links(group: pa.Table) -> pa.Table:
        rows = group.select(["id", "component", "text"]).to_pydict()
        sets = shingle_sets([t.encode() for t in rows["text"]])
        size = np.array([len(s) for s in sets])
        both = common_counts(sets)
        component = np.array(rows["component"])
        linked = (both > 0) & (100 * both >= percent * (size[:, None] + size - both)) & (component[:, None] != component)
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        found = []
        for i, j in np.argwhere(np.triu(linked)).tolist():
            a, b = root(rows["component"][i]), root(rows["component"][j])
            if a != b:
                parent[a] = b
                found.append((rows["id"][i], rows["id"][j]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return links


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.int64)
    for whole in batches:
        for begin, end in slices(whole, "text"):
            for shingles in shingle_sets(whole.column("text").slice(begin, end - begin).cast(pa.binary()).to_pylist()):
                np.add.at(counts, (shingles % U64(COUNTERS)).astype(np.int64), 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["counter", "n"])


def prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """How many of a set's rarest shingles have one that a similar set has among its own: with a set that is no smaller,
    which shares 2 * percent / (100 + percent) of this one, and with any, which shares percent."""
    return n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1


def _prefixes(counts, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin, end in slices(whole, "text"):
                batch = whole.slice(begin, end - begin)
                tokens, at, low = [], [], []
                for i, s in enumerate(shingle_sets(batch.column("text").cast(pa.binary()).to_pylist())):
                    few, most = prefix_sizes(len(s), percent)
                    rare = s[np.lexsort((s, counts.value[(s % U64(COUNTERS)).astype(np.int64)]))[:most]]
                    tokens.append(rare.view(np.int64))
                    at.append(np.full(len(rare), i))
                    low.append(np.arange(len(rare)) < few)
                at = np.concatenate(at)
                columns = [batch.column(c).take(pa.array(at)) for c in ("id", "component", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), *columns, pa.array(np.concatenate(low))], ["token", "id", "component", "n", "low"])

    return run


def _candidates(percent: int):
    """Pairs of a shingle's holders that may be similar: of different components, near in size and sketch; the smaller
    one holds it among the few that it shares with a larger set."""
    most = most_differing(percent / 100)

    def pairs(group: pa.Table) -> pa.Table:
        col = {c: group.column(c).to_numpy() for c in ("id", "n", "component", *SKETCH)}
        low = group.column("low").to_numpy(zero_copy_only=False)
        sketch = np.stack([col[s] for s in SKETCH], axis=1).view(U64)
        a, b = [], []
        for i in np.flatnonzero(low).tolist():
            n = col["n"][i]
            near = np.flatnonzero((col["component"] != col["component"][i]) & (col["n"] >= n) & (n * 100 >= col["n"] * percent))
            near = near[np.bitwise_count(sketch[near] ^ sketch[i]).sum(axis=1) <= most]
            a.append(np.minimum(col["id"][near], col["id"][i]))
            b.append(np.maximum(col["id"][near], col["id"][i]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets.
    component_id is the smallest id reachable over links, itself included; kept says that it is the
    row's own id. Ids are whole numbers; TypeError for others. Defined results: null or wordless text has size 0 and no
    link; rows that share an id are one document with the links of each of them; a row with a null id keeps a null
    component, has no links and is kept; an empty table gives an empty one. Columns other than the two are not read.

    A pair just at a similarity of 0.85 is missed by all bands with a probability below 1e-6, one just at 0.8
    (with a percent of 80) with about 7e-5, and far less above it.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col}: near duplicates need ids that are whole numbers, not {docs.schema[id_col].dataType.simpleString()}")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = checkpointed(texts.mapInArrow(_sign, SIGNED))
    rows, words = signed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    size, many = words * WORD_BYTES, BANDS * rows * ROW_BYTES
    some = signed.filter("id is not null and n > 0")
    classes = some.groupBy("fp").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), *(F.first(s).alias(s) for s in SKETCH)
    )
    classes = checkpointed(classes, rows * CLASS_BYTES)
    slim = classes.select("id", "n", *SKETCH)
    known = texts.filter("id is not null and text is not null")

    balls = _balls(classes.select(F.explode("bands").alias("bucket"), "id"), many)
    own_class = classes.select("fp", F.col("id").alias("node"))
    links = checkpointed(confirmed(known, _estimated(balls, slim, percent, many), percent, size, many), many)
    links = links.union(_of_one_id(signed, own_class, rows))
    labels = components(links, "a", "b")
    more = checkpointed(_across(known, balls, labels, slim, percent, size, many), many)
    if not more.isEmpty():
        known_links = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = components(known_links.union(more), "a", "b")

    # a row without words goes by its id, which has links if another row of it has
    placed = (
        signed.select("id", "n", "fp")
        .join(own_class, "fp", "left")
        .withColumn("node", F.coalesce("node", "id"))
        .join(labels, "node", "left")
        .select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))
    )
    return in_parts(placed, rows * ROW_BYTES).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _balls(buckets: DataFrame, size: int) -> DataFrame:
    """(a, b): each class b of a bucket with the bucket's centre a, once.

    What is known of a bucket is a table of its own before it is joined, so both sides are plain shuffles and AQE
    can split a hot bucket.
    """
    shared = checkpointed(buckets.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"), size)
    members = checkpointed(buckets.join(shared, "bucket"), size)
    fame = members.groupBy("id").agg(F.sum("members").alias("fame"))
    centres = (
        members.join(fame, "id")
        .groupBy("bucket")
        .agg(F.max(F.struct("fame", (-F.col("id")).alias("other"))).alias("c"))
        .select("bucket", (-F.col("c.other")).alias("a"))
    )
    return checkpointed(members.join(checkpointed(centres, size), "bucket").filter("id != a").select("a", F.col("id").alias("b")).distinct(), size)


def _of_one_id(signed: DataFrame, own_class: DataFrame, rows: int) -> DataFrame:
    """Links (a, b) from an id to the nodes of its classes, for ids whose rows have different sets."""
    sets = signed.filter("id is not null").groupBy("id").agg(F.min("fp").alias("least"), F.max("fp").alias("most"))
    several = checkpointed(sets.filter("least != most").select("id"), rows * ROW_BYTES)
    own = signed.select("id", "fp").join(several, "id", "left_semi").join(own_class, "fp")
    return checkpointed(own.filter("id != node").select(F.col("id").alias("a"), F.col("node").alias("b")).distinct(), rows * ROW_BYTES)


def _across(texts: DataFrame, balls: DataFrame, labels: DataFrame, slim: DataFrame, percent: int, size: int, many: int) -> DataFrame:
    """Links (a, b) between members of a ball that are in different components. The centre's own pairs are known."""
    inside = (
        balls.select(F.col("a").alias("centre"), F.col("b").alias("id"))
        .join(labels.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
        .join(slim.select("id", "n"), "id")
    )
    inside = checkpointed(inside, many)
    mixed = (
        inside.groupBy("centre")
        .agg(
            ((F.count("*") > BLOCK) | (F.sum("n") > BLOCK_SHINGLES)).alias("large"),
            F.min("component").alias("least"),
            F.max("component").alias("most"),
        )
        .filter("least != most")
        .select("centre", "large")
    )
    inside = inside.join(checkpointed(mixed, many), "centre")
    small = inside.filter("not large").select("centre", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), "id", "n", "component")
    links = _linked_blocks(texts, small, slim, percent, size, many)
    large = checkpointed(inside.filter("large").select("id", "component", "n").distinct(), many)
    return links if large.isEmpty() else links.union(_by_rare_shingles(texts, large, slim, percent, size, many))


def _linked_blocks(texts: DataFrame, blocks: DataFrame, slim: DataFrame, percent: int, size: int, many: int) -> DataFrame:
    """Links that join components within blocks (centre, x, y, side, id, n, component); side 1 is compared with 2, 0 with all."""
    alike = blocks.join(slim.drop("n"), "id").groupBy("centre", "x", "y").applyInArrow(
        _alike_members(percent), "centre long, x int, y int, id long, component long"
    )
    alike = checkpointed(alike, many)
    needed = checkpointed(_only(texts, alike.select("id").distinct(), many), size)
    whole = alike.join(needed, "id").groupBy("centre", "x", "y")
    return whole.applyInArrow(_joining_links(percent), "a long, b long")


def _by_rare_shingles(texts: DataFrame, members: DataFrame, slim: DataFrame, percent: int, size: int, many: int) -> DataFrame:
    """Links between members (id, component, n) of different components: all of them between holders of a rare shingle, and as
    many as join the components between holders of one that is not rare."""
    texts = checkpointed(_only(texts, members.select("id"), many).join(members, "id"), size)
    found = texts.select("text").mapInArrow(_counted, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[found.column("counter").to_numpy()] = found.column("n").to_numpy()
    run = _prefixes(texts.sparkSession.sparkContext.broadcast(counts), percent)
    postings = checkpointed(texts.mapInArrow(run, "token long, id long, component long, n long, low boolean"))
    holders = postings.groupBy("token").agg(
        F.count("*").alias("holders"), F.min("component").alias("least"), F.max("component").alias("most"), F.bool_or("low").alias("any")
    )
    holders = checkpointed(holders.filter("least != most and any").select("token", "holders"), size)
    asked = checkpointed(postings.join(holders, "token"), size)

    few = asked.filter(F.col("holders") <= BLOCK).join(slim.drop("n"), "id")
    pairs = few.groupBy("token").applyInArrow(_candidates(percent), "a long, b long").distinct()
    pairs = checkpointed(pairs.join(slim.select(F.col("id").alias("b"), "n"), "b").select("a", "b", "n"), many)
    links = confirmed(texts.select("id", "text"), pairs, percent, size, many)

    crowd = asked.filter(F.col("holders") > BLOCK)
    if crowd.isEmpty():
        return links
    chunks = F.ceil(F.col("holders") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), chunks).cast("int")
    blocks = crowd.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1))).select(
        F.col("token").alias("centre"),
        F.least("own", "other").alias("x"),
        F.greatest("own", "other").alias("y"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
        "id",
        "n",
        "component",
    )
    return links.union(_linked_blocks(texts.select("id", "text"), blocks, slim, percent, size, many))


def _estimated(pairs: DataFrame, slim: DataFrame, percent: int, many: int) -> DataFrame:
    whole = F.struct("n", *SKETCH)
    one = slim.select(F.col("id").alias("a"), whole.alias("x"))
    two = slim.select(F.col("id").alias("b"), whole.alias("y"))
    near = pairs.join(one, "a").join(two, "b").filter(_alike("x", "y", percent))
    return checkpointed(near.select("a", "b", F.col("y.n").alias("n")), many)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """docs with one document of each group left; the columns stay.

    Rows with a null id all stay, and so do empty texts. Of rows that share an id, the one that comes first when its
    columns are compared in order stays. An empty table stays empty.
    """
    found = near_duplicates(docs, id_col, text_col, percent)
    kind = docs.schema[id_col].dataType
    ids = checkpointed(found.select(F.col(id_col).cast(kind).alias("key"), "kept", "n_shingles"))
    rows, words = ids.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    ids = ids.filter("key is not null")
    gone = checkpointed(ids.filter("not kept").select("key").distinct(), rows * ROW_BYTES)
    repeated = checkpointed(ids.filter("kept").groupBy("key").count().filter("count > 1").select("key"), rows * ROW_BYTES)
    key, row = fresh(docs.columns, "key"), fresh(docs.columns, "row")
    touched = gone.union(repeated)
    may, rest = bloom.split(docs, F.col(id_col), touched)
    left = may.join(gone.withColumnRenamed("key", key), F.col(id_col) == F.col(key), "left_anti")
    whole = F.struct(*every(docs.columns))
    once = left.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(key)).agg(F.min(whole).alias(row)).select(f"{row}.*")
    out = once.unionByName(left.filter(F.col(id_col).isNull()))
    return in_parts(out if rest is None else out.unionByName(rest), words * WORD_BYTES)
