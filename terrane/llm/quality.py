"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The trees are grown on the driver from a bounded sample of labelled rows, then flattened into arrays:
all trees are complete, so that a node's children are found by arithmetic, and a batch of documents
goes down all trees at once, one numpy step a level.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, plainly_named, slices

#: Bound on the labelled documents that trees are grown from: the first ones by a hash of doc_id.
TRAIN_ROWS = 20_000
HASHES = 1 << 32
THRESHOLD = 0.3
FOLDS = 5

TREES = 80
DEPTH = 5
RATE = 0.15
BINS = 64
L2 = 1.0
LEAST_HESSIAN = 2.0

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "newline": b"\n",
    "stop": b".,;:'\"()-",
    "shout": b"!?",
    "mark": b"#$%&*@^~",
    "bar": b"|<>=+_/\\{}[]`",
    "wide": bytes(range(128, 256)),
}
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _members in enumerate(_CLASSES.values()):
    _CLASS[list(_members)] = _i
N_CLASS = len(_CLASSES) + 1
FEATURES = (
    *(f"share_{c}" for c in (*_CLASSES, "other")),
    "bytes",
    "words",
    "mean_word",
    "sd_word",
    "longest_word",
    "short_words",
    "long_words",
    "distinct_words",
    "distinct_pairs",
    "commonest_word",
    "lines",
    "repeated_lines",
    "bytes_a_line",
    "capital_words",
    "stopped_words",
)


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """A row of FEATURES for each UTF-8 text, over all of it; null counts as empty, and an empty text has zeros."""
    texts = [t or b"" for t in texts]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), len(FEATURES)))
    cls = _CLASS[np.frombuffer(b"".join(texts), np.uint8)]
    doc = np.repeat(np.arange(len(texts)) * N_CLASS, size)
    out[:, :N_CLASS] = np.bincount(doc + cls, minlength=len(texts) * N_CLASS).reshape(-1, N_CLASS) / np.maximum(size, 1)[:, None]
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            out[i, N_CLASS] = np.log1p(size[i])
            continue
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        lines = text.split(b"\n")
        counts = Counter(words)
        out[i, N_CLASS:] = (
            np.log1p(size[i]),
            np.log1p(n),
            length.mean(),
            length.std(),
            np.log1p(length.max()),
            (length <= 3).mean(),
            (length >= 12).mean(),
            len(counts) / n,
            len(set(zip(words, words[1:], strict=False))) / n,
            max(counts.values()) / n,
            np.log1p(len(lines)),
            1 - len(set(lines)) / len(lines),
            np.log1p(size[i] / len(lines)),
            sum(map(bytes.istitle, words)) / n,
            sum(w[-1] < 48 for w in words) / n,
        )
    return out


@dataclass
class Trees:
    """Complete trees as flat arrays: (tree, inner node) and (tree, leaf)."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of x, each of which takes all trees at once."""
        n, trees = len(x), len(self.feature)
        node, row, tree = np.zeros((n, trees), np.int64), np.arange(n)[:, None], np.arange(trees)
        for _ in range(DEPTH):
            right = x[row, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        margin = self.prior + self.leaf[tree, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost logistic trees on histograms. Without rows of both labels: no trees, and the share of 1 as score."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    prior = float(np.log(share / (1 - share)))
    inner = 2**DEPTH - 1
    if len(np.unique(y)) < 2:
        return Trees(prior, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(width) * BINS
    usable = np.zeros((width, BINS), bool)
    for f, e in enumerate(edges):
        usable[f, : len(e)] = True
    margin = np.full(n, prior)
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, count = 2**depth - 1, 2**depth
            at = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            total = count * width * BINS
            left_g, left_h = (
                np.bincount(at, np.repeat(v, width), total).reshape(count, width, BINS).cumsum(axis=2) for v in (g, h)
            )
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + L2) + right_g**2 / (right_h + L2) - all_g**2 / (all_h + L2)
            gain[~usable[None].repeat(count, 0) | (left_h < LEAST_HESSIAN) | (right_h < LEAST_HESSIAN)] = 0
            gain = gain.reshape(count, -1)
            best = gain.argmax(axis=1)
            for k in np.flatnonzero(gain[np.arange(count), best] > 1e-6).tolist():
                f, b = divmod(int(best[k]), BINS)
                feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + L2)
        margin += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(prior, np.stack(features), np.stack(thresholds), np.stack(leaves))


def held_out(id_col: str) -> Column:
    """Whether a row is kept from learning: crc32 of the id's text is divisible by FOLDS. Null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for begin, end in slices(whole, "text"):
            batch = whole.slice(begin, end - begin)
            x = statistics(batch.column("text").cast(pa.binary()).to_pylist())
            at = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(at, x.ravel())], ["id", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Grow trees from at most `rows` labelled documents that are not held out.

    Several labels of one id count as their mean, from 0.5 up as 1; null labels and ids teach nothing. Ids of any type
    are compared as text. Of rows that share an id, the one with the least statistics teaches. The result is the same at
    every run. Without labels or documents there are no trees, and all scores are 0.5.
    """
    usable = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).cast("string").alias("id"))
        .agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
        .withColumn("nth", F.pmod(F.xxhash64("id"), F.lit(HASHES)))
    )
    # the first rows by hash: a threshold that leaves some more of them keeps the sort small
    share = (rows + 10 * rows**0.5 + 50) / max(1, usable.count())
    chosen = usable.filter(F.col("nth") < min(HASHES, math.ceil(share * HASHES))).orderBy("nth", "id").limit(rows).select("id", "y")
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    taught = texts.join(F.broadcast(chosen), "id", "left_semi").mapInArrow(_measured, "id string, x array<double>")
    found = taught.groupBy("id").agg(F.min("x").alias("x")).join(F.broadcast(chosen), "id").toArrow().sort_by("id")
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return grow(x, found.column("y").to_numpy())


def _scored(trees, text: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin, end in slices(whole, text):
                batch = whole.slice(begin, end - begin)
                x = statistics(batch.column(text).cast(pa.binary()).to_pylist())
                score = np.concatenate([trees.value.score(x[i : i + 1024]) for i in range(0, len(x), 1024)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, out])

    return run


def with_score(docs: DataFrame, trees: Trees, text_col: str, out: str) -> DataFrame:
    """docs with a score from 0 to 1 in column `out`; all columns pass through. Null text is scored as empty."""
    plain, names = plainly_named(docs)
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])
    run = _scored(docs.sparkSession.sparkContext.broadcast(trees), names[text_col], "score")
    return plain.mapInArrow(run, schema).toDF(*docs.columns, out)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs, learned from labels.quality.

    Null text is scored as empty. Rows are scored one by one, those with a null or repeated id too; an empty table gives an empty one.
    """
    trees = fit(docs, labels, id_col, text_col)
    texts = docs.select(id_col, F.col(text_col).cast("string").alias(text_col))
    out = with_score(texts, trees, text_col, fresh([id_col, text_col], "score_"))
    score = F.col(out.columns[-1])
    return out.select(
        id_col, held_out(id_col).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those scored below the threshold; the columns stay.

    Null text is scored as empty; repeated rows are judged one by one; an empty table stays empty.
    """
    out = fresh(docs.columns, "score")
    return with_score(docs, fit(docs, labels, id_col, text_col), text_col, out).filter(F.col(out) >= threshold).drop(out)
