"""Benchmark decontamination with suffix arrays over the training text.

The documents are cut into shards of a few megabytes where they lie, with no shuffle. Each shard gets a
suffix array over its words. Every suffix of the benchmark that is a window or more is binary-searched in it: the
range found is the list of all its verbatim occurrences. The training suffixes found in this way, and only they,
can hold a match; they and the benchmark's own suffixes are then ordered to their very end by prefix doubling, and
a suffix's longest verbatim match is with a neighbour in that order. The work grows with the words that match
times the logarithm of the longest match. Documents with an occurrence are removed.

The benchmark is the stated query set. It is sent to the tasks in blocks of a bounded size. A task makes a
shard's suffix array once and searches it for one block after the other, so the documents are read once; with
many blocks a task reads each from its machine's copy of the broadcast when its turn comes, and lets it go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fresh, plainly_named, slices

WINDOW = 10
#: Bytes of documents in a shard (one document is never cut) and of benchmark texts in a block.
SHARD_BYTES = 4_000_000
BLOCK_BYTES = 4_000_000
#: Blocks that a task keeps in memory; of more than that it has one at a time.
KEPT_BLOCKS = 4

#: Words are runs of digits, letters a-z (A-Z lowered) and all bytes from 128 up; every other byte parts them.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of t, in the order of the first `depth` values that follow; t is never negative.

    Ranks of ever longer prefixes: as many neighbouring ranks as fit into 62 bits make the next key.
    """
    rank, have = t.astype(np.int64), 1
    order = np.argsort(rank) if depth <= 1 else None
    while have < depth:
        bits = max(1, int(rank.max(initial=0) + 1).bit_length())
        take = max(2, min(62 // bits, -(-depth // have)))
        key = rank + 1
        for j in range(1, take):
            key <<= bits
            key[: len(rank) - j * have] |= rank[j * have :] + 1 if j * have < len(rank) else 0
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(len(t), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(t) else 0
        have *= take
    return order


def equal_range(t: np.ndarray, order: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of queries, the range of `order` whose suffixes begin with it, by binary search."""
    rows, width = queries.shape
    ends, at, padded = [], np.arange(width), np.concatenate([t, np.full(width, -1, t.dtype)])
    for upper in (False, True):
        lo, hi = np.zeros(rows, np.int64), np.full(rows, len(order), np.int64)
        while (active := np.flatnonzero(lo < hi)).size:
            mid = (lo[active] + hi[active]) >> 1
            theirs, ours = padded[order[mid][:, None] + at], queries[active]
            differs = theirs != ours
            first = differs.argmax(axis=1)
            pick = np.arange(len(active))
            below = np.where(differs[pick, first], theirs[pick, first] < ours[pick, first], upper)
            lo[active[below]] = mid[below] + 1
            hi[active[~below]] = mid[~below]
        ends.append(lo)
    return ends[0], ends[1]


@dataclass
class Windows:
    """The benchmark's windows of one width."""

    width: int
    at: np.ndarray  #: where in the block's words each window begins
    group: np.ndarray  #: which distinct window it is
    first: np.ndarray  #: where each distinct window begins first
    cuts: np.ndarray  #: where in `owners` the items of a distinct window begin
    owners: np.ndarray


@dataclass
class Block:
    """A bounded part of the benchmark, ready to be searched for."""

    words: list[bytes]
    t: np.ndarray  #: the items' words by number from 1, a 0 after each item
    item: np.ndarray  #: of each place in t
    place: np.ndarray  #: of each place in t, within its item
    ids: list[str]  #: of the items, in order
    windows: list[Windows]


def _numbered(words: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, all words by number from 1 with a 0 after each list, lengths, where the lists begin)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.int64)
    flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    t = np.zeros(begins[-1], np.int32)
    inside = np.ones(begins[-1], bool)
    inside[begins[1:] - 1] = False
    t[inside] = flat.indices.to_numpy(zero_copy_only=False) + 1
    return flat.dictionary.to_pylist(), t, lengths, begins


def make_block(items: list[tuple[str, bytes | None]], window: int = WINDOW) -> Block:
    split = [(i, w) for i, text in items if (w := split_words(text))]
    ids = sorted({i for i, _ in split})
    number = {i: k for k, i in enumerate(ids)}
    words, t, lengths, begins = _numbered([w for _, w in split])
    item = np.repeat(np.array([number[i] for i, _ in split], np.int32), lengths + 1)
    place = (np.arange(len(t)) - np.repeat(begins[:-1], lengths + 1)).astype(np.int32)
    widths = np.minimum(window, lengths)
    windows = []
    for width in np.unique(widths).tolist():
        mine = np.flatnonzero(widths == width)
        at = np.concatenate([np.arange(b, b + n - width + 1) for b, n in zip(begins[mine].tolist(), lengths[mine].tolist(), strict=True)])
        _, first, group = np.unique(t[at[:, None] + np.arange(width)], axis=0, return_index=True, return_inverse=True)
        group = group.ravel()
        both = np.unique(group * len(ids) + item[at])
        cuts = np.searchsorted(both, np.arange(len(first) + 1) * len(ids))
        windows.append(Windows(width, at.astype(np.int32), group.astype(np.int32), at[first].astype(np.int32), cuts, (both % len(ids)).astype(np.int32)))
    return Block(words, t, item, place, ids, windows)


#: (words, place in the document, item, place in the item); a longer one is better, then the least of the rest.
Match = tuple[int, int, str, int]


def better(a: Match | None, b: Match) -> Match:
    return b if a is None or (-b[0], *b[1:]) < (-a[0], *a[1:]) else a


class Suffixes:
    """All suffixes of some runs of numbers, ordered to their ends by prefix doubling.

    s: the numbers, 0 where no run is. A suffix ends with its run.
    """

    def __init__(self, s: np.ndarray):
        self.at = np.flatnonzero(s)
        self.slot = np.full(len(s) + 1, -1, np.int64)
        self.slot[self.at] = np.arange(len(self.at))
        gaps = np.flatnonzero(np.concatenate([s, [0]]) == 0)
        self.left = gaps[np.searchsorted(gaps, self.at)] - self.at
        rank = s[self.at].astype(np.int64)
        self.ranks, step = [rank], 1
        while (self.left > step).any():
            on = self.left > step
            after = np.zeros(len(rank), np.int64)
            after[on] = rank[self.slot[self.at[on] + step]]
            _, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
            rank = rank.ravel() + 1
            self.ranks.append(rank)
            step *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How long the suffixes in slots a and b agree, pair by pair."""
        agreed, most = np.zeros(len(a), np.int64), np.minimum(self.left[a], self.left[b])
        for k in range(len(self.ranks) - 1, -1, -1):
            on = np.flatnonzero(agreed < most)
            x, y = (self.slot[self.at[i[on]] + agreed[on]] for i in (a, b))
            same = on[self.ranks[k][x] == self.ranks[k][y]]
            agreed[same] = np.minimum(agreed[same] + 2**k, most[same])
        return agreed


class Shard:
    """Some documents, their suffix array, and what has been found in them."""

    def __init__(self, texts: list[bytes | None], window: int = WINDOW):
        self.window = window
        words, self.t, self.n_words, self.begins = _numbered([split_words(x) for x in texts])
        self.doc = np.repeat(np.arange(len(texts)), self.n_words + 1)
        self.number = {w: i for i, w in enumerate(words, 1)}
        self.order = suffix_order(self.t, window) if len(words) else None
        self.hit = np.zeros(len(self.t), bool)
        self.items: dict[int, set[str]] = {}
        self.longest: dict[int, Match] = {}

    def search(self, block: Block) -> None:
        if self.order is None or not block.words:
            return
        known = np.array([0] + [self.number.get(w, -1) for w in block.words], np.int32)
        change = np.zeros(len(self.t) + 1, np.int64)
        for w in block.windows:
            query = known[block.t[w.first[:, None] + np.arange(w.width)]]
            able = np.flatnonzero((query > 0).all(axis=1))
            lo, hi = equal_range(self.t, self.order, query[able])
            count = hi - lo
            if not count.any():
                continue
            which = np.repeat(able, count)
            place = self.order[np.repeat(hi - np.cumsum(count), count) + np.arange(count.sum())]
            np.add.at(change, place, 1)
            np.add.at(change, place + w.width, -1)
            both = np.unique(self.doc[place] * len(w.first) + which)
            doc, group = both // len(w.first), both % len(w.first)
            for d, g in zip(doc.tolist(), group.tolist(), strict=True):
                self.items.setdefault(d, set()).update(block.ids[i] for i in w.owners[w.cuts[g] : w.cuts[g + 1]].tolist())
            if w.width < self.window:
                self._whole_items(block, w, which, place)
            else:
                self._longest(block, w, which, place)
        self.hit |= np.cumsum(change[:-1]) > 0

    def _best(self, length: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of some matches: the index of each document's longest, the first of equally long ones."""
        best = np.lexsort((place, -length, self.doc[place]))
        return best[np.unique(self.doc[place[best]], return_index=True)[1]]

    def _take(self, place: int, length: int, item: str, item_place: int) -> None:
        d = int(self.doc[place])
        self.longest[d] = better(self.longest.get(d), (length, int(place - self.begins[d]), item, item_place))

    def _whole_items(self, block: Block, w: Windows, which: np.ndarray, place: np.ndarray) -> None:
        """Items shorter than a window match as a whole."""
        for i in self._best(np.full(len(place), w.width), place).tolist():
            self._take(place[i], w.width, block.ids[w.owners[w.cuts[which[i]]]], 0)

    def _longest(self, block: Block, w: Windows, which: np.ndarray, place: np.ndarray) -> None:
        """Follow runs of windows that are the same here and in the benchmark."""
        ours = np.zeros(len(self.t) + 1, np.int64)
        ours[place] = which + 1
        here = np.zeros(len(w.first), bool)
        here[which] = True
        theirs = np.zeros(len(block.t), np.int64)
        theirs[w.at] = np.where(here[w.group], w.group + 1, 0)
        whole = Suffixes(np.concatenate([ours, theirs]))
        rank, mine = whole.ranks[-1], whole.at < len(ours)
        a, b = np.flatnonzero(mine), np.flatnonzero(~mine)
        b = b[np.argsort(rank[b], kind="stable")]
        after = np.searchsorted(rank[b], rank[a])
        near = np.stack([np.maximum(after - 1, 0), np.minimum(after, len(b) - 1)])
        agreed = np.stack([whole.common(a, b[n]) for n in near])
        side = agreed.argmax(axis=0)
        length, nearest = agreed.max(axis=0), near[side, np.arange(len(a))]
        along = whole.common(b[:-1], b[1:])  # suffixes of the benchmark that agree stand side by side
        at = whole.at[b] - len(ours)
        item_place = block.item[at].astype(np.int64) << 32 | block.place[at]
        seen: dict[tuple[int, int], int] = {}
        for i in self._best(length, whole.at[a]).tolist():
            n, j = int(length[i]), int(nearest[i])
            if (j, n) not in seen:
                low = high = j
                while low and along[low - 1] >= n:
                    low -= 1
                while high < len(along) and along[high] >= n:
                    high += 1
                seen[j, n] = int(item_place[low : high + 1].min())
            found = seen[j, n]
            self._take(whole.at[a[i]], n + w.width - 1, block.ids[found >> 32], found & 0xFFFFFFFF)

    def found(self) -> pa.StructArray:
        """A row of STATE for each document."""
        edge = np.diff(np.concatenate([[0], self.hit.astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = self.doc[begin]
        spans = np.stack([begin - self.begins[doc], end - self.begins[doc]], axis=1).ravel()
        cuts = 2 * np.searchsorted(doc, np.arange(len(self.n_words) + 1))
        items = [sorted(self.items.get(d, ())) for d in range(len(self.n_words))]
        longest = [self.longest.get(d, (0, None, None, None)) for d in range(len(self.n_words))]
        columns = [
            pa.array(self.n_words),
            pa.ListArray.from_arrays(cuts.astype(np.int32), spans.astype(np.int64)),
            pa.array(items, pa.list_(pa.string())),
            *(pa.array([m[i] for m in longest], pa.string() if i == 2 else pa.int64()) for i in range(4)),
        ]
        return pa.StructArray.from_arrays(columns, [f.name for f in STATE.fields])


STATE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.LongType()),
        T.StructField("longest_start", T.LongType()),
        T.StructField("longest_item", T.StringType()),
        T.StructField("longest_item_start", T.LongType()),
    ]
)


def _searched(blocks: list[Broadcast], text: str, state: str, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin, end in slices(whole, text, SHARD_BYTES):
                batch = whole.slice(begin, end - begin)
                shard = Shard(batch.column(text).cast(pa.binary()).to_pylist(), window)
                for block in blocks:
                    shard.search(block.value)
                    if len(blocks) > KEPT_BLOCKS and getattr(block, "_path", None):
                        block.__dict__.pop("_value", None)  # the file of the broadcast stays
                yield pa.RecordBatch.from_arrays([*batch.columns, shard.found()], [*batch.schema.names, state])

    return run


def with_matches(
    docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, out: str, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """docs and a struct column `out`: n_words, spans of hit words (start, end, start, ...), items, the longest match.

    A word is hit if it lies in any occurrence of a window: `window` consecutive words of an item, or all
    words of a shorter one. The longest match is that of most words that stand in a row in the document and in one
    item, from a window up (or a whole shorter item); of equally long ones the first in the document, then the one of
    the least item, then the first in that. Without any its length is 0 and its places are null.

    Null and empty texts have no words. An item without words matches nothing; a null item id counts as the
    string null; repeated items count once. Rows, repeated ones too, are judged one by one, all columns pass
    through, and an empty table gives an empty one.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(item_text_col).cast("string").alias("t")
    ).distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    items = items if count == 1 else checkpointed(items, total)
    blocks = []
    for k in range(count):
        part = (items if count == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k)).toArrow()
        rows = list(zip(part["i"].to_pylist(), part["t"].cast(pa.binary()).to_pylist(), strict=True))
        blocks.append(spark.sparkContext.broadcast(make_block(rows, window)))
    plain, names = plainly_named(docs)
    schema = T.StructType([*plain.schema.fields, T.StructField("state", STATE)])
    return plain.mapInArrow(_searched(blocks, names[text_col], "state", window), schema).toDF(*docs.columns, out)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **more) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, longest match and its places) for each row, as with_matches has them."""
    slim = docs.select(id_col, F.col(text_col).cast("string").alias(text_col))
    m = with_matches(slim, benchmark, text_col, "item_id", "text", fresh([id_col, text_col], "m"), window, **more)
    m = m.withColumnRenamed(m.columns[-1], "m")
    spans = F.col("m.spans")
    n_hit = F.aggregate(
        F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return m.select(
        id_col,
        F.col("m.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("m.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("m.items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.col("m.longest").alias("longest_match"),
        F.col("m.longest_start").alias("longest_start"),
        F.col("m.longest_item").alias("longest_item"),
        F.col("m.longest_item_start").alias("longest_item_start"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without the rows in which a window of the benchmark occurs; the columns stay.

    Null and empty texts stay; repeated rows are judged one by one; without a benchmark all rows stay.
    """
    out = fresh(docs.columns, "matches")
    found = with_matches(docs, benchmark, text_col, "item_id", "text", out, window)
    return found.filter(F.size(f"{out}.items") == 0).drop(out)
