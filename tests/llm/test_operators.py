"""The operators against brute force, on the driver's small tables and on rows made to be awkward."""

import glob
import hashlib
import io
import math
import os
import random
import re
import struct
import time
import wave
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import bloom, chat, common, components, decontaminate, media, mixing, near_dedup, quality, queries, secrets, sharding, tokens, urls

BASE = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BENCH_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED_WORD = re.compile("[^\x20\x09-\x0d]+")
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{BASE}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and blank texts, ties, repeated rows, a long text, and columns that clash."""
    long_text = "Wort " * 30_000
    rows = [
        (1, "alpha beta", "en", "a", 3), (1, "alpha beta", "en", "a", 3), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n", "en", "b", 3),
        (5, long_text, "de", "b", None), (6, long_text + "x", "de", None, 1), (None, "alpha beta", "en", "a", 1), (None, None, None, None, None),
        (7, f"so {PASSAGE.upper()}!", "en", "c", 1), (8, "ALPHA\tbeta", "en", "a", 1), (9, "x" * 200_000, "en", "a", 1), (10, "\U0001f600 é\u0000 \ud7ff", "en", "c", 1),
    ]
    clash = ("score", "shard", "slot", "matches", "copies", "host", "a.b", "secrets", "media", "key", "id")
    return spark.createDataFrame(rows, DOCS).select("*", *(F.lit(i).alias(c) for i, c in enumerate(clash)))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 ------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    found = quality.quality(docs, labels).toPandas()
    again = quality.quality(docs.repartition(7), labels.repartition(3)).toPandas()
    assert found.sort_values("doc_id").score.tolist() == again.sort_values("doc_id").score.tolist()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(found.doc_id, found.held_out, strict=True))
    assert ((found.score >= 0.3).astype(int) == found.predicted).all()
    both = found[found.held_out].merge(labels.toPandas(), on="doc_id")
    assert (both.predicted == both.quality).mean() >= 0.95


def test_quality_learns_from_allowed_rows_only(spark, documents):
    labels = spark.read.parquet(f"{BASE}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.quality(documents, x).orderBy("doc_id").collect() for x in (labels, flipped))
    assert one == two


def test_quality_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    some = spark.createDataFrame([(1, 1), (1, None), (None, 0), (3, 0), (99, 1)], "doc_id long, quality int")
    for labels in (none, some):
        rows = quality.quality(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert quality.quality(empty, labels).isEmpty()
    assert {r.score for r in quality.quality(odd, none).collect()} == {0.5}
    kept = quality.good_documents(odd, none)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def slow_score(trees, row):
    margin = trees.prior
    for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        node = 0
        for _ in range(quality.DEPTH):
            node = 2 * node + 1 + int(row[f[node]] > t[node])
        margin += leaf[node - (2**quality.DEPTH - 1)]
    return 1 / (1 + np.exp(-margin))


def test_trees_are_walked_as_grown():
    rng = np.random.RandomState(1)
    x = rng.rand(500, len(quality.FEATURES))
    y = (x[:, 0] + x[:, 1] > 1).astype(float)
    trees = quality.grow(x, y)

    assert np.allclose(trees.score(x[:50]), [slow_score(trees, r) for r in x[:50]])
    assert ((trees.score(x) > 0.5) == (y == 1)).mean() > 0.97


def test_statistics_against_a_slow_version():
    texts = ["", None, "one", "The cat's  hat.\nThe cat's hat.\n\tÜber 12345 {x} #tag!", " \n ", "a " * 50 + "longerthantwelve", "x\x00y \x7f" * 3]
    marks = {".,;:'\"()-": "stop", "!?": "shout", "#$%&*@^~": "mark", "|<>=+_/\\{}[]`": "bar", " \t\r\x0b\x0c": "blank", "\n": "newline"}

    def kind(b):
        c = chr(b)
        named = [n for chars, n in marks.items() if c in chars]
        return "wide" if b >= 128 else named[0] if named else "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "other"

    for text, row in zip(texts, quality.statistics([None if t is None else t.encode() for t in texts]), strict=True):
        data = (text or "").encode()
        words, lines, kinds = data.split(), data.split(b"\n"), Counter(map(kind, data))
        mean = sum(map(len, words)) / len(words) if words else 0
        n = len(words)
        slow = {f"share_{k}": v / len(data) for k, v in kinds.items()} | {"bytes": math.log1p(len(data))}
        if words:
            slow |= {
                "words": math.log1p(n), "mean_word": mean, "sd_word": math.sqrt(sum((len(w) - mean) ** 2 for w in words) / n), "longest_word": math.log1p(max(map(len, words))),
                "short_words": sum(len(w) <= 3 for w in words) / n, "long_words": sum(len(w) >= 12 for w in words) / n, "distinct_words": len(set(words)) / n,
                "distinct_pairs": len({(a, b) for a, b in zip(words, words[1:], strict=False)}) / n, "commonest_word": max(words.count(w) for w in words) / n, "lines": math.log1p(len(lines)),
                "repeated_lines": 1 - len(set(lines)) / len(lines), "bytes_a_line": math.log1p(len(data) / len(lines)), "capital_words": sum(w.istitle() for w in words) / n,
                "stopped_words": sum(w[-1:] < b"0" for w in words) / n,
            }
        assert row == pytest.approx([slow.get(f, 0) for f in quality.FEATURES])


def test_splits_are_the_best_ones(monkeypatch):
    """The first tree's splits against a search over all thresholds, rows and features."""
    rng = np.random.RandomState(4)
    x = np.round(rng.rand(120, 4), 1)
    y = ((x[:, 1] > 0.4) ^ (x[:, 2] > 0.7)).astype(float)
    monkeypatch.setattr(quality, "TREES", 1)
    trees = quality.grow(x, y)
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))
    rows = {0: np.arange(len(y))}
    for node in range(2**quality.DEPTH - 1):
        mine = rows[node]
        best, score = (0, np.inf), 1e-6
        for f in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS)[1:-1])):
                left, right = (mine[x[mine, f] <= cut], mine[x[mine, f] > cut])
                if h[left].sum() < quality.LEAST_HESSIAN or h[right].sum() < quality.LEAST_HESSIAN:
                    continue
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + quality.L2) * sign for s, sign in ((left, 1), (right, 1), (mine, -1)))
                if gain > score + 1e-9:
                    best, score = (f, cut), gain
        assert (trees.feature[0, node], trees.threshold[0, node]) == best
        rows[2 * node + 1], rows[2 * node + 2] = mine[x[mine, best[0]] <= best[1]], mine[x[mine, best[0]] > best[1]]


def test_quality_with_ids_of_text(spark, documents):
    """Scores don't depend on how ids are written, but for the sample's order; a bound on rows takes exactly so many."""
    labels = spark.read.parquet(f"{BASE}/labels.parquet")
    text = lambda df: df.withColumn("doc_id", F.col("doc_id").cast("string"))
    one = {str(r.doc_id): r.score for r in quality.quality(documents, labels).collect()}
    assert one == {r.doc_id: r.score for r in quality.quality(text(documents), text(labels)).collect()}
    named = lambda df: df.withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id"))
    assert quality.quality(named(documents), named(labels)).count() == documents.count()
    seen = []
    grow = quality.grow
    quality.grow = lambda x, y: seen.append(len(y)) or grow(x, y)
    try:
        quality.fit(documents, labels, rows=7)
    finally:
        quality.grow = grow
    assert seen == [7]


# --- 2 ------------------------------------------------------------------------------------------------


def brute_hits(texts, items, width=10):
    split = lambda text: BENCH_WORD.findall((text or "").translate(LOWER))
    whole = [("null" if item is None else str(item), split(text)) for item, text in items]
    windows = defaultdict(list)
    for item, w in whole:
        for i in range(max(1, len(w) - width + 1)):
            if w[i : i + width]:
                windows[tuple(w[i : i + width])].append((item, w, i))
    sizes = {len(x) for x in windows}
    out = []
    for text in texts:
        w = split(text)
        hit, found, best = [False] * len(w), set(), (0, None, None, None)
        for n in sizes:
            for i in range(len(w) - n + 1):
                for item, theirs, j in windows.get(tuple(w[i : i + n]), ()):
                    found.add(item)
                    hit[i : i + n] = [True] * n
                    if i and j and w[i - 1] == theirs[j - 1]:
                        continue  # the match that began earlier goes on here
                    while n < len(w) - i and n < len(theirs) - j and w[i + n] == theirs[j + n]:
                        n += 1
                    if not best[0] or (-n, i, item, j) < (-best[0], *best[1:]):
                        best = (n, i, item, j)
                    n = min(width, len(theirs))
        out.append((len(w), sum(hit), len(found), sha(",".join(sorted(found))), any(hit), *best))
    return out


def check_hits(docs, bench, **more):
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_start", "longest_item", "longest_item_start")
    found = decontaminate.contamination(docs, bench, **more).collect()
    rows = docs.select("doc_id", "text").collect()
    expected = brute_hits([r.text for r in rows], [(r.item_id, r.text) for r in bench.collect()])
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in found) == Counter((r.doc_id, *e) for r, e in zip(rows, expected, strict=True))
    return found


def test_decontamination(spark, documents):
    bench = spark.read.parquet(f"{BASE}/benchmark.parquet")
    assert any(r.contaminated for r in check_hits(documents, bench))


@pytest.fixture(scope="module")
def odd_bench(spark):
    rows = [(1, PASSAGE), (1, PASSAGE), (2, "alpha BETA"), (3, None), (4, ""), (5, "..."), (None, "wort " * 12), (10, "zwei wort"), (11, PASSAGE + " thirteen"), (12, "nowhere " * 15)]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination_odd(spark, odd, empty, odd_bench):
    found = {r.doc_id: r for r in check_hits(odd, odd_bench) if r.doc_id}
    assert (found[7].longest_match, found[7].longest_start, found[7].longest_item_start) == (12, 1, 0)
    assert found[5].longest_match == 12
    assert decontaminate.contamination(empty, odd_bench).isEmpty()
    none = spark.createDataFrame([], "item_id long, text string")
    check_hits(odd, none)
    left = decontaminate.decontaminated(odd, odd_bench)
    assert left.columns == odd.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == [2, 3, 4, 9, 10]


def test_decontamination_in_blocks(spark, odd, odd_bench, monkeypatch):
    """Ten blocks and more in one pass over the documents, with the same matches as one block."""
    monkeypatch.setattr(decontaminate, "KEPT_BLOCKS", 3)
    check_hits(odd, odd_bench, block_bytes=30)
    many = decontaminate.with_matches(odd, odd_bench, "text", "item_id", "text", "m", block_bytes=30)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and odd_bench.selectExpr("sum(octet_length(text))").first()[0] > 300


def test_matches_of_few_words(spark):
    """Texts over three words have matches of all lengths, overlaps and ties."""
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("abc" if rng.random() < 0.9 else "xyz") for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.choice([0, 3, 12, 40, 200]))) for i in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame([(i % 9, text(rng.choice([1, 2, 4, 9, 10, 11, 30, 120]))) for i in range(25)], "item_id long, text string")
    for window in (3, 10):
        found = decontaminate.contamination(docs, bench, window=window).collect()
        expected = brute_hits([r.text for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()], window)
        assert {r.doc_id: tuple(r)[1:] for r in found} == dict(enumerate(expected))


@pytest.mark.parametrize("words", [[f"w{i}" for i in range(20_000)], ["same"] * 20_000], ids=["copy", "one word"])
def test_long_matches_take_no_longer_than_their_length(words):
    """A document of 20,000 words that is an item: followed a word at a time for each of its words, this took minutes."""
    text = " ".join(words).encode()
    block = decontaminate.make_block([("1", text), ("2", " ".join(words[:9_000]).encode())])
    began = time.process_time()
    shard = decontaminate.Shard([b"one", text, None, b"x " + text + b" y", " ".join(words[6_000:]).encode()])
    shard.search(block)
    assert time.process_time() - began < 5
    assert shard.longest[1] == (20_000, 0, "1", 0) and shard.longest[3] == (20_000, 1, "1", 0)
    assert shard.hit.sum() == shard.n_words.sum() - 3 and 0 not in shard.longest


def test_suffix_order():
    rng = random.Random(3)
    for size in (0, 1, 7, 200):
        t = np.array([rng.randint(0, 3) for _ in range(size)])
        for depth in (1, 3, 10):
            order = decontaminate.suffix_order(t, depth).tolist() if size else []
            keys = [tuple(t[i : i + depth].tolist()) for i in order]
            assert keys == sorted(keys) and sorted(order) == list(range(size))


# --- 3 ------------------------------------------------------------------------------------------------


def brute_groups(rows, percent=85):
    """Ids, sizes and smallest linked ids. rows: (id, text)."""
    sets = []
    for _, text in rows:
        w = SPACED_WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b, both = rows[j][0], len(sets[i] & sets[j])
            if a is not None and b is not None and both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for (i, _), s in zip(rows, sets, strict=True)]


def check_groups(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = [tuple(r) for r in near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert Counter(found) == Counter(brute_groups(rows))


def test_near_dedup(documents):
    check_groups(documents)


def test_near_dedup_odd(odd, empty, spark):
    check_groups(odd)
    assert near_dedup.near_duplicates(empty).isEmpty()
    left = near_dedup.deduplicated(odd)
    assert left.columns == odd.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == [1, 2, 3, 4, 5, 6, 7, 9, 10]
    assert left.filter("doc_id is null").count() == 2


def test_near_dedup_of_a_large_group(spark, monkeypatch):
    """Copies with edits of all degrees, some linked only through others, in several blocks."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(12)}"
        rows.append((i * 3 % 263, " ".join(w)))
    monkeypatch.setattr(near_dedup, "BLOCK", 50)
    monkeypatch.setattr(near_dedup, "TASK_SHINGLES", 3_000)
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"))


def test_near_dedup_of_ids_with_several_texts(spark):
    """An id's rows are one document: it joins the groups of all of its texts, in any order of ids."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (7, b), (7, b + " more"), (20, c), (21, d), (22, c), (22, d), (22, ""), (30, d + " more"), (30, None), (40, "x"), (40, "")]
    rows += [(50, ""), (50, None), (None, a), (None, ""), (61, a + " one"), (60, b + " one"), (9, "y"), (9, "z"), (8, "z")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    check_groups(docs)
    left = near_dedup.deduplicated(docs)
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == [3, 8, 20, 40, 50]


def test_near_dedup_of_template_pages(spark, monkeypatch):
    """Pages of one template at 0.6 to 0.8 with few real copies: all links are found and few rows are compared."""
    rng = random.Random(9)
    template, rows = [f"t{i}" for i in range(100)], []
    for i in range(400):
        words = template + [f"o{i}-{rng.randint(0, 10**6) if rng.random() < 0.8 else rng.randint(0, 9)}" for _ in range(rng.randint(14, 35))]
        rows.append((i, " ".join(words)))
        if i % 40 == 0:
            words[-3] = "edited"
            rows.append((1000 + i, " ".join(words)))
            words[-2] = "again"
            rows.append((2000 + i, " ".join(words)))
    compared = []
    candidates = near_dedup._candidates

    def counted(percent):
        compared.append(percent)
        return candidates(percent)

    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    monkeypatch.setattr(near_dedup, "_candidates", counted)
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert compared


def test_near_dedup_of_shingles_that_are_rare_nowhere(spark, monkeypatch):
    """Sets that are nearly all template, with more holders of each shingle than a block takes."""
    rng = random.Random(10)
    rows = []
    for i in range(150):
        words = [f"t{k}" for k in range(60)]
        at = rng.randrange(0, 50)
        words[at : at + rng.randint(1, 9)] = [f"{rng.choice('abc')}{k}" for k in range(rng.randint(0, 9))]
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(near_dedup, "BLOCK", 12)
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"))


def test_prefixes_hold_a_common_shingle():
    """Of two similar sets, in any order of shingles: the smaller one's short prefix meets the larger one's long one."""
    rng = random.Random(12)
    for percent in (80, 85):
        met = 0
        for _ in range(4000):
            x = set(rng.sample(range(40), rng.randint(1, 30)))
            y = {v for v in x if rng.random() < 0.93} | set(rng.sample(range(40), rng.randint(0, 3)))
            if not y or 100 * len(x & y) < percent * len(x | y):
                continue
            small, large = sorted((x, y), key=len)
            few, most = near_dedup.prefix_sizes(len(small), percent)[0], near_dedup.prefix_sizes(len(large), percent)[1]
            assert set(sorted(small)[:few]) & set(sorted(large)[:most])
            met += 1
        assert met > 300


def test_hot_keys_are_split(spark):
    """A star of edges and a bucket with a third of all classes: AQE splits their joins, whatever one task could hold."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        edges = spark.range(0, 120_000, 1, 8).select(F.when(F.col("id") < 60_000, F.lit(0).cast("long")).otherwise(F.col("id") - 1).alias("v"), (F.col("id") + 1).alias("u"))
        below = spark.range(0, 120_000, 1, 8).select(F.col("id").alias("v"), F.when(F.col("id") < 60_000, 200_000).otherwise(F.col("id") + 200_001).alias("u"))
        for large in (True, False):
            out = components._star(edges if large else below, large, 10**7)
            out.collect()
            assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
        members = spark.range(0, 90_000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("id")).alias("bucket"), "id")
        shared = components.checkpointed(members.groupBy("bucket").agg(F.count("*").alias("members")))
        joined = members.join(shared, "bucket")
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        balls = near_dedup._balls(members, 10**7)
        assert balls.count() == 29_999 and balls.select("a").distinct().count() == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ids_of_near_duplicates_are_whole_numbers(spark):
    docs = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    for call in (near_dedup.near_duplicates, near_dedup.deduplicated):
        with pytest.raises(TypeError, match="doc_id"):
            call(docs)
    few = docs.select(F.lit(7).cast("short").alias("doc_id"), "text")
    assert near_dedup.deduplicated(few).collect() == few.collect()


def test_sketches_estimate():
    rng = np.random.RandomState(2)
    whole = rng.randint(0, 2**63, 3000).astype(np.uint64)
    for share in (0.95, 0.85, 0.7):
        n = round(2000 * share * 2 / (1 + share))
        a, b = np.unique(whole[:2000]), np.unique(np.concatenate([whole[:n], whole[2000 : 4000 - n]]))
        s = near_dedup.odd_sketches(np.stack([near_dedup._minhash(a), near_dedup._minhash(b)])).view(np.uint64)
        z = int(np.bitwise_count(s[0] ^ s[1]).sum())
        estimate = 1 + near_dedup.SKETCH_BITS / (4 * near_dedup.BANDS * near_dedup.ROWS) * np.log(1 - 2 * z / near_dedup.SKETCH_BITS)
        assert abs(estimate - share) < 0.15
        assert share < 0.85 or z <= near_dedup.most_differing(0.85)


def test_common_counts():
    rng = np.random.RandomState(4)
    sets = [np.unique(rng.randint(0, 60, rng.randint(0, 40)).astype(np.uint64)) for _ in range(30)]
    expected = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = near_dedup.common_counts(sets, columns=7)
    assert all(got[i][j] == expected[i][j] for i in range(30) for j in range(30) if i != j)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(80)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").isEmpty()


def test_small_tables_take_few_tasks(spark):
    """The driver keeps an account of every task: steps over few bytes don't take one for each shuffle partition, nor run twice."""
    many = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()

    def tasks(group, run):
        sc.setJobGroup(group, group)
        out = run()
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        return out, sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x)

    chains = spark.createDataFrame([(i, i + 1) for i in range(200) if i % 20], "a long, b long").coalesce(1)
    keys = spark.range(0, 3000, 7, 1).withColumnRenamed("id", "key")
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        found, of_chains = tasks("few-chains", lambda: components.components(chains, "a", "b"))
        assert {(r.node, r.component) for r in found.collect()} == {(i, (i - 1) // 20 * 20 + 1) for i in range(1, 201)}
        stars = found.filter("node != component").coalesce(1)
        again, of_stars = tasks("few-stars", lambda: components.components(stars, "node", "component"))
        assert sorted(again.collect()) == sorted(found.collect())
        known, of_filter = tasks("few-keys", lambda: bloom.filter_of(keys))
        assert keys.filter(known.has(F.col("key"))).count() == keys.count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert of_chains < 1_000 and of_stars < 60 and of_filter < 60


# --- 4 ------------------------------------------------------------------------------------------------


def test_lookup_table():
    table = sharding.lookup_table(16, 2039)
    counts = Counter(table)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(15, 2039)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 15)
    assert moved < 0.25 * 2039
    weighted = Counter(sharding.lookup_table(3, 1009, [2, 1, 0]))
    assert weighted[2] == 0 and abs(weighted[0] - 2 * weighted[1]) <= 3
    for bad in ((16, 2040, None), (3, 2, None), (2, 7, [0, 0]), (2, 7, [1])):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_sharding(odd, empty, documents):
    table = sharding.lookup_table()
    for r in sharding.sharded(documents).select("doc_id", "shard").collect():
        assert r.shard == table[int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS]
    out = sharding.sharded(odd)
    assert out.columns == [*odd.columns, "shard_"] and out.count() == odd.count()
    assert out.filter("doc_id = 1").select("shard_").distinct().count() == 1
    assert sharding.sharded(empty).isEmpty()


# --- 5 ------------------------------------------------------------------------------------------------


def test_token_counts(documents):
    encode = tokens.encoder(tokens.VOCABULARY).encode_ordinary
    n = [len(encode(r.text or "")) for r in documents.select("text").collect()]
    sums = tokens.suffix_sums(tokens.histogram(tokens.lengths(documents)))
    rows = sums.collect()
    assert {r.length: r.n_docs for r in rows} == Counter(n)
    for r in rows:
        assert (r.docs_up_to, r.docs_longer) == (sum(x <= r.length for x in n), sum(x > r.length for x in n))
        assert (r.tokens_up_to, r.tokens_longer) == (sum(x for x in n if x <= r.length), sum(x for x in n if x > r.length))
        assert r.truncated_tokens == sum(min(x, r.length) for x in n)
    for r in tokens.at_limits(sums, [0, 10, 300, 10**6]).collect():
        assert (r.docs_whole, r.docs_cut, r.truncated_tokens) == (sum(x <= r.limit for x in n), sum(x > r.limit for x in n), sum(min(x, r.limit) for x in n))
    assert sums.agg(tokens.quantile(0.5).alias("q")).first().q == sorted(n)[(len(n) + 1) // 2 - 1]


def test_token_counts_odd(odd, empty):
    rows = tokens.suffix_sums(tokens.histogram(tokens.lengths(odd))).collect()
    assert sum(r.n_docs for r in rows) == odd.count() and {r.n_docs for r in rows if r.length == 0} == {3}
    assert tokens.suffix_sums(tokens.histogram(tokens.lengths(empty))).isEmpty()


def test_tokens_of_long_runs(spark, monkeypatch):
    """Blanks are counted as the pattern would, at any length; lengths at which it can do that itself are compared with it."""
    encode = tokens.encoder(tokens.VOCABULARY).encode_ordinary
    rng = random.Random(8)
    blanks = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2003\u2028\u202f\u3000"
    monkeypatch.setattr(tokens, "_RUN", re.compile(tokens._RUN.pattern.replace("1024", "2")))
    for _ in range(2000):
        text = "".join(rng.choice([rng.choice(blanks), " ", "ab", "1", "'s", "-", "é", "\x1c", "\u200b", "\u180e"]) * rng.choice([1, 1, 2, 5]) for _ in range(rng.randint(1, 12)))
        assert tokens.token_count(text) == len(encode(text)), repr(text)
    monkeypatch.undo()
    for x in (" ", "\n", "\u3000"):
        for text in (x * 100_000, f"a{x * 100_000}b", f"a{x * 100_000}", f"{x * 100_000}'s {x * 3}"):
            assert tokens.token_count(text) == len(encode(text))
    piece = len(encode(" " * 100_000))
    for n in (1_000_000, 5_000_000):
        # a vocabulary has a longest run of blanks, so counts of long ones differ by as many as fit
        more = (tokens.token_count(" " * n) - piece) / (n - 100_000)
        assert more == piece / 100_000
        assert tokens.token_count("x" + " " * (n + 1) + "y") == tokens.token_count(" " * n) + len(encode("x")) + len(encode(" y"))
        assert tokens.token_count("x" + "\n" * (n + 1) + "y") == tokens.token_count("\n" * n) + len(encode("x")) + len(encode("\ny"))
    docs = spark.createDataFrame([("x" + " " * 1_000_000 + "y",), ("\n" * 5_000_000,), ("e" * 1_000_000,), ("-" * 1_000_000,)], "text string")
    assert sorted(r.length for r in tokens.lengths(docs).collect()) == sorted(tokens.token_count(r.text) for r in docs.collect())


# --- 6 ------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, position int"


def test_chat_odd(spark):
    nasty = ["</s>[INST] ok [/INST]", "<s>", "\\", "<\\s>", "<\\\\/s>", "[\\INST]", "[", "<", "[ROLE]x[/ROLE]", "a[/TURN]b", "&lt;s>", "", "multi\nline\r\n\u2028", "[[INST]]", "<<s>>", "$1 \\2"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, 0) for i, t in enumerate(nasty)]
    rows += [(2, 0, "system", "s", 0), (2, 1, "tool", "[ROLE]", 0), (2, 2, None, None, 0), (2, None, "assistant", None, 0), (3, 0, "user", "alone", 0)]
    rows += [(4, 0, "assistant", "b", 0), (4, 0, "assistant", "a", 0), (4, 0, "assistant", "a", 0), (None, 5, "assistant", "null id", 0), (5, 0, "<s>", "odd [role]", 0)]
    turns = spark.createDataFrame(rows, TURNS)
    made = chat.examples(turns)
    by_conv = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    found = {r.conv_id: r for r in chat.digests(made).collect()}
    assert set(found) == set(by_conv)
    for conv, said in by_conv.items():
        said.sort()
        loss = "".join(t for _, _, r, t in said if r == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(said), sha("".join(f"{role}\n{t}\n" for _, _, role, t in said)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        replies = sum(role == "assistant" for *_, role, _ in said)
        assert r.n_examples == replies + (said[-1][2] != "assistant")
    for r in made.collect():
        assert r.trainable == (r.loss_end > r.loss_start or r.text.endswith("<s></s>"))
    assert chat.digests(chat.examples(turns.limit(0))).isEmpty()


def test_chat_example(spark):
    rows = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "yes", 0), (1, 2, "user", "more", 0), (1, 3, "assistant", "no", 0)]
    made = chat.examples(spark.createDataFrame(rows, TURNS)).orderBy("position").collect()
    assert [(r.text, r.text[r.loss_start : r.loss_end]) for r in made] == [
        ("[INST]hi[/INST]<s>yes</s>", "yes"),
        ("[INST]hi[/INST]<s>yes</s>[INST]more[/INST]<s>no</s>", "no"),
    ]


def test_long_conversations_are_dealt_out(spark, monkeypatch):
    """One conversation with most of the characters: its examples come from many tasks and stay the same."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i} " * 5, 0) for i in range(120)] + [(2, 0, "user", "hi", 0), (2, 1, "assistant", "yes", 0)]
    turns = spark.createDataFrame(rows, TURNS)
    whole, said = (sorted(map(tuple, f(chat.examples(turns)).collect())) for f in (lambda d: d, chat.digests))
    monkeypatch.setattr(chat, "BLOCK_CHARS", 20_000)
    made = chat.examples(turns)
    assert sorted(map(tuple, made.collect())) == whole and sorted(map(tuple, chat.digests(made).collect())) == said
    assert made.filter("conv = 1").select(F.spark_partition_id()).distinct().count() > 1


# --- 7 ------------------------------------------------------------------------------------------------

RULES = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def brute_secrets(text):
    spans = []
    for rank, (kind, pattern, group, least) in enumerate(RULES):
        spans += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [s for *_, s in sorted(spans)]


def check_secrets(docs):
    rows = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    expected = Counter((i, *(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")), sha(",".join(spans))) for i, spans in ((i, brute_secrets(t)) for i, t in rows))
    found = secrets.report(docs).collect()
    assert set(expected) == {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found}
    assert len(found) == docs.count()
    return found


def test_secrets(spark):
    assert any(r.n_assign for r in check_secrets(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


def test_secrets_odd(spark, odd, empty):
    made = [
        "é password: 'abcdefgh' secret=token :abcdefg", "PassWord=\"12345\" api_key=1234567 ApiKey : x.y-z_9=", "AKIA" + "A" * 15, "AKIA" + "B" * 16 + "é" + "AKIAAKIA" + "0" * 14,
        "deadbeef" * 3 + "x" + "deadbeef" * 2, "token = " + "0f" * 30, "😀" * 5 + "secret='" + "a" * 6 + "' 😀 passwd=zzzzzz", "-----BEGIN RSA PRIVATE KEY-----",
        "ghp_" + "a1" * 18, " ".join(f"{i:032x}" for i in range(300)), None, "ſecret=abcdefgh paſſword=abcdefg toKen=abcdefg",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string")
    found = {r.doc_id: r for r in check_secrets(docs)}
    assert found[7].spans == "pem:0:31" and found[8].spans.startswith("hub:0:40") and found[9].n_hex == 300
    check_secrets(odd)
    assert secrets.report(empty).isEmpty()
    one, two = (secrets.scanned(docs, most_bytes=b).orderBy("doc_id").collect() for b in (10**6, 0))
    assert one == two
    clean = secrets.redacted(docs.withColumn("secrets", F.lit(1)))
    assert clean.columns == ["doc_id", "text", "secrets"]
    assert clean.filter("doc_id = 8").first().text.startswith("*" * 40)


def test_trigram_queries():
    q = secrets.trigram_query("(abcd|xyz)[0-9]+(foo)?end")
    assert q == [[{"abc", "bcd"}, {"xyz"}], [{"end"}, {"foo", "ooe", "oen", "end"}]] or q == [[{"abc", "bcd"}, {"xyz"}], [{"end"}, {"end", "foo", "oen", "ooe"}]]
    assert secrets.trigram_query("[0-9a-f]{24,}") == []
    assert secrets.trigram_query("ab|abcd") == []


@pytest.mark.parametrize(
    ("pattern", "strings"),
    [
        ("ab.cde", [{"ab"}, None, {"cde"}]), (r"a\.b\x20\dc", [{"a.b "}, None, {"c"}]), ("(?i:Ab|c)d", [{"abd", "cd"}]), ("x(?:yz){2}w", [{"xyzyzw"}]), ("(?P<n>ab)+c", [{"ab"}, None, {"c"}]),
        ("a[bc]?d", [{"ad", "abd", "acd"}]), ("a[]x]b", [{"a]b", "axb"}]), ("[^a]b", [None, {"b"}]), ("[a-c]b", [None, {"b"}]), (r"[\]-]a", [{"]a", "-a"}]), ("a{2,3}b", [{"aa"}, None, {"b"}]),
        ("a*b", [None, {"b"}]), ("(?=xyz)ab$", [{"ab"}]), (r"\bab\b", [{"ab"}]), ("(?i)AB", [{"ab"}]), ("ab|c.d", [None]), ("a{70}", [{"a" * 64}, None]), ("[a[bc]]d", [None, {"]d"}]), ("|ab", [{"", "ab"}]),
    ],
)
def test_patterns_as_strings(pattern, strings):
    assert secrets._joined(secrets._Reader(pattern).branches()) == strings


def test_no_match_without_its_trigrams():
    """What matches a regex meets its query, for regexes put together at random."""
    rng = random.Random(21)

    def made(depth):
        kind = rng.randrange(9 if depth else 5)
        if kind < 3:
            return "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
        if kind == 3:
            return rng.choice(["[ab]", "[^a]", ".", "[a-c]", "\\w", "\\."])
        if kind == 4:
            return rng.choice("ab") + rng.choice(["?", "*", "+", "{2}", "{1,2}", "+?"])
        if kind < 7:
            return made(depth - 1) + made(depth - 1)
        return "(" + rng.choice(["", "?:"]) + made(depth - 1) + "|" * (kind == 7) + made(depth - 1) + ")" + rng.choice(["", "", "?", "{2}", "+"])

    met = 0
    for _ in range(20_000):
        pattern = made(3)
        text = "".join(rng.choice("abc.") for _ in range(rng.randint(3, 14)))
        if re.search(pattern, text):
            for clause in secrets.trigram_query(pattern):
                met += 1
                assert any(all(t in text for t in a) for a in clause), (pattern, text)
    assert met > 200


def test_kept_index_serves_new_rules(spark):
    docs = spark.createDataFrame([(1, "password: abcdefgh"), (2, "AKIA" + "A" * 16), (3, "sk_live_0123456789"), (4, "nothing")], "doc_id long, text string")
    trigrams = secrets.trigrams_of(secrets.RULES)
    kept = (secrets.index(docs, trigrams, "doc_id", "text"), trigrams)
    new = (secrets.Rule("live", "sk_live_[0-9]+"), secrets.Rule("word", "pass[a-z]+"))
    for rules in (secrets.RULES, new, secrets.RULES + new):
        assert sorted(map(str, secrets.scanned(docs, rules, kept=kept).collect())) == sorted(map(str, secrets.scanned(docs, rules).collect()))


# --- 8 ------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    """Targets by resharing what is over until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, full = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        over = False
        for s in free:
            target[s] = left * weight[s] / sum(weight[x] for x in free)
            over |= target[s] > 2 * sizes[s]
        if not over:
            return target
        for s in free:
            if target[s] > 2 * sizes[s]:
                target[s] = 2.0 * sizes[s]
                full.add(s)


def check_mix(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(SPACED_WORD.findall(t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    target = brute_targets(sizes) if rows else {}
    found = mixing.mixture(docs).collect()
    key = lambda x: tuple((v is None, v if v is not None else 0) for v in x)
    assert sorted([(r.doc_id, r["size"]) for r in found], key=key) == sorted([(r.doc_id, size(r.text)) for r in rows], key=key)
    taken, largest = Counter(), Counter()
    for r in found:
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] + 1e-6
    return found


def test_mixing(documents, monkeypatch):
    one = check_mix(documents)
    assert sorted(one) == sorted(mixing.mixture(documents.repartition(5)).collect())
    monkeypatch.setattr(mixing, "BUCKET", 3)
    monkeypatch.setattr(mixing.rounded, "__defaults__", (mixing.SEED, 3))
    check_mix(documents)


def test_mixing_odd(odd, empty, spark):
    check_mix(odd)
    assert mixing.mixture(empty).isEmpty() and mixing.mixed(empty).isEmpty()
    wordless = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mixture(wordless).collect()] == [0, 0]
    check_mixed(odd)


def check_mixed(docs):
    """The rows that the mixture takes, as often as it says."""
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    names = docs.columns
    at = names.index("doc_id"), names.index("source"), names.index("text")
    key = lambda r: (r[at[0]], r[at[1]], len(SPACED_WORD.findall(r[at[2]] or "")))
    copies = Counter()
    for r in mixing.mixture(docs).collect():
        copies[r.doc_id, r.source, r["size"]] += r.copies
    rows = out.collect()
    assert Counter(key(r) for r in rows) == +copies
    assert {repr(r) for r in rows} <= {repr(r) for r in docs.collect()}


def test_mixing_of_repeated_rows(spark, monkeypatch):
    """20,000 rows without an id: all equal, or of few kinds; the target is met to the words of one of them."""
    monkeypatch.setattr(mixing, "CHUNK", 700)
    text = F.when(F.col("id") < 12_000, "four words in it").otherwise(F.concat(F.lit("more words, nearly the same "), F.col("id") % 5))
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"), F.element_at(F.array(*map(F.lit, "aab")), (F.col("id") % 3 + 1).cast("int")).alias("source"), (F.col("id") % 2).alias("n"))
    check_mix(docs)
    check_mixed(docs)
    equal = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("four words in it").alias("text"), F.when(F.col("id") < 3_000, "x").otherwise("y").alias("source"))
    check_mix(equal)
    check_mixed(equal)


def test_mixing_with_ids_of_text(spark):
    docs = spark.createDataFrame([(f"id-{i % 50}", "w " * (i % 7), "abc"[i % 3], {"a": i}) for i in range(120)], "doc_id string, text string, source string, more map<string, int>")
    check_mix(docs)
    check_mixed(docs)


def test_mixing_does_not_move_all_texts(spark, documents):
    """Whole copies stay where they are; the texts that are joined are filtered before."""
    plan = mixing.mixed(documents)._jdf.queryExecution().executedPlan().toString()
    assert "getbit(Subquery" in plan and "Generate explode(sequence(1, g_whole" in plan


def test_rounding_keeps_expectation(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    seen = Counter()
    for seed in range(12):
        for r in mixing.mixture(docs, seed=seed).collect():
            seen[r.doc_id] += r.copies
    assert abs(sum(seen.values()) / 12 / 60 - 1.5) < 0.1
    assert len({seen[i] for i in range(60)}) > 1


def test_rounding_keeps_expectation_in_each_size_class(spark):
    """Few items of a bucket are large; they must be taken as often as the small ones."""
    items = spark.range(60 * 512).select(
        "id",
        F.concat(F.lit("s"), F.col("id") % 60).alias("source"),
        F.expr("CASE WHEN crc32(cast(cast(id AS string) AS binary)) % 40 = 0 THEN 3000 WHEN id % 7 < 2 THEN 600 ELSE 150 END").cast("long").alias("size"),
    )
    items = items.select("*", F.col("size").cast("double").alias("mass"), F.lit(0.861).alias("p"))
    for most in (512, 2 * 512):  # one level, and two
        share = {r["size"]: r.taken for r in mixing.rounded(items, most).groupBy("size").agg(F.avg("extra").alias("taken")).collect()}
        assert set(share) == {150, 600, 3000}
        assert all(abs(taken - 0.861) < 0.04 for taken in share.values()), share


# --- 9 ------------------------------------------------------------------------------------------------


def brute_url(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
    best = None
    for r in urls.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
            best = r
    verdict = best.verdict if best else "block" if host in listed else "allow"
    return host, path, best.name if best else None, verdict


def test_urls(spark):
    given = ["http://A.Example.NET/en/1?x#y", "https://example.net", "https://example.net/", "x://net/a", "http://example.com/de/", "http://example.com/den", "//example.com/", None, "", "a://b://c/d",
             "http://bad.org/fr/1", "http://bad.org/en", "http://É.com/de/", "http://h?://x/", "http://h\n.org/fr/\n2", "http://notexample.net/en/", "http://bad.org#/fr/"]
    pages = spark.createDataFrame([(i, u, 0, 0) for i, u in enumerate(given)], "page_id int, url string, host int, listed int")
    listed = spark.createDataFrame([("bad.org",), ("h",), (None,), ("bad.org",), ("elsewhere",)], "key string")
    for most in (urls.MOST_BYTES, 0):
        out = urls.judged(pages, listed, most_bytes=most)
        assert out.columns[:4] == pages.columns and "host_" in out.columns and "listed_" in out.columns
        got = {r.page_id: (r["host_"], r.path, r.rule, r.verdict) for r in out.collect()}
        assert got == {i: brute_url(u, {"bad.org", "h"}) for i, u in enumerate(given)}
    assert urls.judged(pages.limit(0), listed).isEmpty()
    assert urls.judged(pages, listed.limit(0)).count() == len(given)


def test_cascade_is_exact(spark):
    universe = spark.range(4000).select(F.concat(F.lit("host"), "id").alias("key"))
    listed = universe.filter("crc32(cast(key as binary)) % 7 = 0")
    levels = urls.cascade(listed, universe)
    assert len(levels) > 1
    wrong = universe.withColumn("found", urls.listed_in(F.col("key"), levels)).filter("found != (crc32(cast(key as binary)) % 7 = 0)")
    assert wrong.count() == 0


def test_every_level_of_the_cascade_has_a_checked_size(spark):
    """The sizes add up to what is allowed or the list is joined; they follow the list, not the hosts."""
    host = lambda c: F.concat(F.lit("host"), c, F.lit(".test"))
    hosts = spark.range(20_000).select(host("id").alias("key"))
    listed = spark.range(0, 20_000, 500).select(host("id").alias("key"))
    levels = urls.cascade(listed, hosts)
    stored = [len(x.table.first().words) for x in levels]
    assert stored == [x.size for x in levels] and len(levels) > 1
    size = 8 * sum(stored)
    assert size < 40 * (1.44 * 9 + 11) / 8 + 8 * len(levels)
    assert urls.cascade(listed, hosts, size - 1) is None and len(urls.cascade(listed, hosts, size)) == len(levels)
    pages = hosts.select(F.concat(F.lit("x://"), "key", F.lit("/")).alias("url"))
    for most, joins in ((size - 1, True), (size, False)):
        out = urls.judged(pages, listed, most_bytes=most)
        assert ("Join" in out._jdf.queryExecution().optimizedPlan().toString()) == joins
        blocked = {r.host for r in out.filter("verdict = 'block'").collect()}
        assert blocked == {r.key for r in listed.collect()}


def test_split_by_filter(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("k"))
    keys = spark.range(0, 2000, 7).select(F.col("id").alias("key"))
    may, rest = bloom.split(df, F.col("k"), keys)
    assert may.count() + rest.count() == 2000 and may.count() < 500
    assert rest.join(keys, F.col("k") == F.col("key"), "left_semi").isEmpty()
    assert rest.filter("k is null").count() == 40
    whole, none = bloom.split(df, F.col("k"), keys, most_bytes=10)
    assert whole.count() == 2000 and none is None


# --- 10 -----------------------------------------------------------------------------------------------


def slow_table(coding):
    """Values of the codes as the rules say: sign, exponent and mantissa, sample by sample."""
    out = []
    for code in range(256):
        x = code ^ (0xFF if coding == "mulaw" else 0x55)
        part, low = x >> 4 & 7, x & 15
        if coding == "mulaw":
            size = (2 * low + 33 << part) * 4 - 132
        else:
            size = (2 * low + 1 if part == 0 else 2 * low + 33 << part - 1) * 8
        out.append(-size if bool(x & 128) == (coding == "mulaw") else size)
    return out


def slow_resampled(samples, rate, target):
    """A sum over neighbours for each output sample, in plain arithmetic."""
    cut = min(1, target / rate)
    half = math.ceil(8 / cut)
    up, down = target // math.gcd(rate, target), rate // math.gcd(rate, target)
    out = []
    for n in range(-(-len(samples) * up // down)):
        base, f = divmod(n * down, up)
        weight = []
        for j in range(1 - half, half + 1):
            u = f / up - j
            sinc = 1.0 if u == 0 else math.sin(math.pi * cut * u) / (math.pi * cut * u)
            weight.append(cut * sinc * math.cos(math.pi * max(-1.0, min(1.0, u / half)) / 2) ** 2)
        taps = [round(w / sum(weight) * 16384) for w in weight]
        taps[max(range(2 * half), key=lambda i: abs(taps[i]))] += 16384 - sum(taps)
        total = sum(t * samples[base + j] for t, j in zip(taps, range(1 - half, half + 1), strict=True) if 0 <= base + j < len(samples))
        out.append(max(-32768, min(32767, total + 8192 >> 14)))
    return out


def slow_report(text, rate=16_000):
    """(media bytes, media digest, feature, PCM bytes, PCM digest) of a text, with no code of the operator."""
    data = (text or "").encode()
    data += b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
    coding = ("mulaw", "alaw", "adpcm")[zlib.crc32(data) % 3]
    if coding == "adpcm":
        samples = [x for i in range(0, len(data), 36) for x in slow_adpcm(data[i : i + 36])]
        form = struct.pack("<HHIIHHHH", 17, 1, 8000, 8000 * 36 // 65, 36, 4, 2, 65)
    else:
        table = slow_table(coding)
        samples = [table[c] for c in data]
        form = struct.pack("<HHIIHHH", 7 if coding == "mulaw" else 6, 1, 8000, 8000, 1, 8, 0)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, len(samples)) + b"data" + struct.pack("<I", len(data)) + data
    media_file = b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks
    pcm = b"".join(struct.pack("<h", x) for x in slow_resampled(samples, 8000, rate))
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(pcm)
    rms = math.sqrt(sum(x * x for x in samples) / len(samples))
    crossings = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:], strict=False))
    feature = f"{coding} ms={1000 * len(samples) // 8000} rms={rms:.2f} peak={max(map(abs, samples))} crossings={crossings} pcm{rate}={zlib.crc32(pcm):08x}"
    sha256 = lambda x: hashlib.sha256(x).hexdigest()
    return len(media_file), sha256(media_file), feature, len(buffer.getvalue()), sha256(buffer.getvalue())


def check_audio(docs, most=3_000):
    """All columns against a slow version; those that take it long for texts of up to `most` bytes."""
    found, expected = media.audio_report(docs).collect(), []
    for r in docs.select("doc_id", "text").collect():
        data = (r.text or "").encode()
        whole = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        expected.append((r.doc_id, len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]), slow_report(r.text) if len(data) <= most else None))
    names = ("media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256")
    got = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, tuple(r[n] for n in names) if r.n_bytes <= most else None) for r in found]
    assert Counter(got) == Counter(expected)


def test_audio(documents, odd, empty):
    check_audio(documents.limit(60))
    check_audio(odd)
    assert media.audio_report(empty).isEmpty()


@pytest.mark.parametrize(("rate", "target"), [(8000, 16000), (8000, 11025), (16000, 8000), (11025, 8000), (8000, 8000), (8000, 48000), (44100, 8000)])
def test_resampling(rate, target):
    rng = random.Random(3)
    for n in (0, 1, 2, 37, 400):
        x = [rng.choice([-32768, 32767, 0, rng.randint(-3000, 3000)]) for _ in range(n)]
        assert media.resampled(np.array(x, np.int16), rate, target).tolist() == (slow_resampled(x, rate, target) if rate != target else x)
    tone = np.round(10_000 * np.sin(2 * np.pi * 440 * np.arange(rate) / rate)).astype(np.int16)
    out = media.resampled(tone, rate, target)
    ideal = 10_000 * np.sin(2 * np.pi * 440 * np.arange(len(out)) / target)
    assert len(out) == target and np.abs(out - ideal)[200:-200].max() < 60
    if target < rate:  # what the lower rate can't hold is taken out
        high = np.round(10_000 * np.sin(2 * np.pi * 0.95 * rate / 2 * np.arange(rate) / rate)).astype(np.int16)
        assert np.abs(media.resampled(high, rate, target)[200:-200].astype(int)).max() < (1500 if rate < 1.5 * target else 300)


def test_audio_at_another_rate(spark):
    docs = spark.createDataFrame([(1, "tone " * 50), (2, None), (3, "x" * 900)], "doc_id long, text string")
    names = ("media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256")
    for r in media.audio_report(docs, rate=11025).collect():
        assert tuple(r[n] for n in names) == slow_report({1: "tone " * 50, 3: "x" * 900}.get(r.doc_id), 11025)


@pytest.mark.parametrize("coding", ["mulaw", "alaw", "adpcm"])
def test_audio_columns(spark, coding):
    docs = spark.createDataFrame([(1, "a" * 600, 5), (2, None, 6)], "doc_id long, text string, media int")
    stored = media.with_audio(docs, "text", "media", coding)
    assert stored.columns == ["doc_id", "text", "media", "media_"]
    out = media.decoded(stored, "media_").orderBy("doc_id").collect()
    for r, text in zip(out, ("a" * 600, None), strict=True):
        which, rate, data = media.read_wav(bytes(r.audio.pcm))
        assert (which, rate) == (media.PCM, 16_000) and r.audio.n_samples == len(data) // 4
        assert r.audio.payload_sha256 == hashlib.sha256(media.payload(text)).hexdigest()


def slow_adpcm(block):
    now, step = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [now]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            size = int(media.STEPS[step])
            change = size >> 3
            change += size if code & 4 else 0
            change += size >> 1 if code & 2 else 0
            change += size >> 2 if code & 1 else 0
            now = max(-32768, min(32767, now - change if code & 8 else now + change))
            step = max(0, min(88, step + int(media.CHANGES[code & 7])))
            out.append(now)
    return out


def test_decoders():
    assert media.TABLES[media.MU_LAW][[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert media.TABLES[media.A_LAW][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert len(set(media.TABLES[media.A_LAW].tolist())) == 256
    data = np.random.RandomState(0).randint(0, 256, (50, media.BLOCK)).astype(np.uint8)
    assert media.decode_adpcm(data).tolist() == [slow_adpcm(bytes(b)) for b in data]
    for coding in (media.MU_LAW, media.A_LAW):
        assert media.TABLES[coding].tolist() == slow_table(media.CODINGS[coding])
    for bad in (b"", b"RIFF0000WAVE", media.wav(b"12", 7).replace(b"fmt ", b"xxxx"), b"RIFF0000WAVEfmt \x04\0\0\0\x07\0\x02\0\0\0\0\0"):
        with pytest.raises(ValueError):
            media.read_wav(bad)


# --- queries ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in os.listdir(BASE):
        db.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{BASE}/{t}'")
    df = queries.QUERIES[name](spark, BASE)
    columns = sorted(df.columns)
    expected = db.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert Counter(tuple(r) for r in df.select(columns).collect()) == Counter(expected)


@pytest.mark.parametrize("name", ["op4_sharding", "op6_chat_formatting", "op7_secret_scan", "op8_source_mixing", "op9_url_filter"])
def test_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, BASE)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|InArrow|CartesianProduct|NestedLoop", plan)


def test_no_pair_joins(spark):
    for name in ("op1_quality_classifier", "op2_decontamination", "op3_near_dedup", "op10_media_columns"):
        plan = queries.QUERIES[name](spark, BASE)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("CartesianProduct|NestedLoop", plan)


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, before, BASE).cache()
        assert kept.columns == columns + (["shard"] if name == "sharding" else [])
        ids, had = [r.doc_id for r in kept.select("doc_id").collect()], {r.doc_id for r in before.select("doc_id").collect()}
        assert set(ids) <= had
        if name in ("quality", "near_dedup", "decontamination"):
            assert len(ids) == len(set(ids))
        if name == "quality":
            trees = quality.fit(before, spark.read.parquet(f"{BASE}/labels.parquet"))
            texts = [(r.doc_id, r.text.encode() if r.text else None) for r in before.collect()]
            assert set(ids) == {i for i, t in texts if slow_score(trees, quality.statistics([t])[0]) >= 0.3}
        if name == "mixing":
            check_mix(before)
            check_mixed(before)
        if name == "sharding":
            shards = sharding.lookup_table()
            assert all(r.shard == shards[int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS] for r in kept.collect())
            assert Counter(ids) == Counter(r.doc_id for r in before.collect())
        if name == "near_dedup":
            assert all(k for *_, k in brute_groups([(r.doc_id, r.text) for r in kept.collect()]))
        if name == "decontamination":
            bench = spark.read.parquet(f"{BASE}/benchmark.parquet").collect()
            assert not any(x[-1] for x in brute_hits([r.text for r in kept.collect()], [(r.item_id, r.text) for r in bench]))
    assert corpus_pipeline.run(spark, BASE).count() == kept.count()


def test_pipeline_drops_copies_at_four_fifths(spark):
    """The first two texts share 50 of 60 shingles, 0.83; the third shares 45 of 65 with the first, 0.69."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"w{i}" for i in range(59)]
    edited = {1: [], 2: [20], 3: [10, 30]}
    rows = [(i, " ".join(f"x{i}" if n in at else w for n, w in enumerate(words)), "en", "a", 1) for i, at in edited.items()]
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, DOCS), BASE)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_pipeline_on_odd_tables(spark, odd, empty):
    """Every stage takes nulls, empty and long texts, repeated rows, more columns and no rows at all."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for docs in (odd, empty):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, BASE).cache()
            assert kept.columns[: len(docs.columns)] == docs.columns and len(kept.columns) == len(docs.columns) + (name == "sharding")
            assert {r.doc_id for r in kept.collect()} <= {r.doc_id for r in docs.collect()}
        assert kept.isEmpty() == docs.isEmpty()


def test_stage_tables_go(spark):
    """Of the stages' tables only the one that the result reads is left."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folders = lambda: set(glob.glob(f"{common.shared_folder(spark).removeprefix('file:')}/pipeline-*"))
    before = folders()
    assert not corpus_pipeline.run(spark, BASE).isEmpty()
    (folder,) = folders() - before
    assert os.listdir(folder) == ["mixing"]


def test_shared_folder_on_a_cluster(monkeypatch):
    """Without spark.checkpoint.dir only a session of one process makes a folder of its own."""

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        Context.master = master
        with pytest.raises(RuntimeError):
            common.shared_folder(Session())
    Context.master = "local[4]"
    assert os.path.isdir(common.shared_folder(Session()))
    Session.conf.get = staticmethod(lambda k, d=None: "hdfs://shared/")
    Context.master = "yarn"
    assert common.shared_folder(Session()) == "hdfs://shared"
