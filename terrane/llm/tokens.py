"""Token counts: the exact histogram of encoded lengths, and suffix sums that answer for any context limit.

Only numbers leave the encoding pass. Lengths are combined before the one shuffle, so a length that very
many documents share is one row a task.

The pattern that cuts a text before byte pairs are merged steps back over a run of blanks one by one, on a stack:
a run of a million ends the process. What it does with such a run is known, so long runs are cut out before.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are cut before byte pairs are merged: the public pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of so many blanks are cut out before. Blanks are the characters that \s means in the pattern.
LONG_RUN = 1024
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
#: Lengths in a block of the suffix sums.
BLOCK = 1024
_loaded: dict[tuple[str, str], object] = {}


def encoder(vocabulary: str, pattern: str = PATTERN):
    """The tokenizer of a rank file, read once a process."""
    if (vocabulary, pattern) not in _loaded:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[vocabulary, pattern] = tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[vocabulary, pattern]


def runs_apart(text: str) -> Iterator[tuple[str, bool]]:
    """The text in parts, and whether a part is a long run of blanks that is one piece to the pattern.

    Of a run before another character all blanks but the last are a piece, at the end of a text all of them. The
    last one stays with what follows, and no piece before a run reaches into it, so the parts' pieces are the text's.
    """
    at = 0
    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    yield text[at:], False


def token_count(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Tokens of a whole text; null and empty have 0."""
    if not text:
        return 0
    encode, whole = encoder(vocabulary).encode_ordinary, encoder(vocabulary, r"[\s\S]+").encode_ordinary
    return sum(len((whole if run else encode)(part)) for part, run in runs_apart(text))


def _encoded(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch, "text"):
                texts = batch.column("text").slice(begin, end - begin).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([token_count(t, vocabulary) for t in texts], pa.int64())], ["length"])

    return run


def lengths(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(length) in tokens of each whole text, row by row; null and empty texts have 0. The file must be on each executor."""
    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_encoded(vocabulary), "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(length, n_docs), one row for each length that occurs. Repeated rows count each; an empty table gives none."""
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length that occurs, what the corpus is at a context limit of that many tokens.

    (length, n_docs, docs_up_to, docs_longer, tokens_up_to, tokens_longer, truncated_tokens, share_whole):
    truncated_tokens sums min(length, limit) over all documents, share_whole is the part of documents that
    fit. The sums run within blocks of lengths, and over one row a block. An empty histogram gives no rows.
    """
    hist = checkpointed(hist.withColumn("block", F.floor(F.col("length") / BLOCK)))
    mass = F.col("n_docs") * F.col("length")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(mass).alias("t"))
    later = W.orderBy("block").rowsBetween(1, W.unboundedFollowing)
    everything = W.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    blocks = blocks.select(
        "block",
        zero(F.sum("d").over(later)).alias("d_later"),
        zero(F.sum("t").over(later)).alias("t_later"),
        F.sum("d").over(everything).alias("d_all"),
        F.sum("t").over(everything).alias("t_all"),
    )
    behind = W.partitionBy("block").orderBy("length").rowsBetween(1, W.unboundedFollowing)
    out = hist.join(blocks, "block").select(
        "length",
        "n_docs",
        (zero(F.sum("n_docs").over(behind)) + F.col("d_later")).alias("docs_longer"),
        (zero(F.sum(mass).over(behind)) + F.col("t_later")).alias("tokens_longer"),
        "d_all",
        "t_all",
    )
    return out.select(
        "length",
        "n_docs",
        (F.col("d_all") - F.col("docs_longer")).alias("docs_up_to"),
        "docs_longer",
        (F.col("t_all") - F.col("tokens_longer")).alias("tokens_up_to"),
        "tokens_longer",
        (F.col("t_all") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_tokens"),
        ((F.col("d_all") - F.col("docs_longer")) / F.col("d_all")).alias("share_whole"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_whole, docs_cut, truncated_tokens) for any context limits, whether or not such a length occurs."""
    out = []
    fits = lambda n: F.col("length") <= n
    for n in limits:
        docs, tokens = (F.coalesce(F.sum(F.when(fits(n), c)), F.lit(0)) for c in (F.col("n_docs"), F.col("n_docs") * F.col("length")))
        cut = F.coalesce(F.sum(F.when(~fits(n), F.col("n_docs"))), F.lit(0))
        out.append(F.struct(F.lit(n).alias("limit"), docs.alias("docs_whole"), cut.alias("docs_cut"), (tokens + cut * n).alias("truncated_tokens")))
    return sums.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def quantile(share: float) -> Column:
    """An aggregate over suffix_sums: the least length that the given part of documents does not exceed."""
    return F.min(F.when(F.col("share_whole") >= share, F.col("length")))
