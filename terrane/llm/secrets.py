"""Secret scans with a trigram inverted index, in DataFrame operations only.

From each rule's regex a Boolean query over trigrams is derived: a list of clauses, all of which must hold;
a clause is a list of alternatives, each a set of trigrams that must all occur. The index has the postings
(trigram, document) of the trigrams that any rule asks for. Intersecting them gives the candidates of each
rule, and only these texts are searched with its regex. No text leaves its place for that: the candidates come
to the texts, as a Bloom filter of a checked size. A rule without a mandatory trigram is searched for
in every text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import checkpointed, every, fresh


@dataclass(frozen=True)
class Rule:
    """A match counts if its group has at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs are whole, so asking for 24 in the pattern finds the runs that have as many
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)
BASE = ("assign", "access", "hex")

Query = list[list[frozenset[str]]]
_MOST_STRINGS = 8


#: A regex's pieces in a row: the strings a piece can be, in lower case, or None where that is open.
Pieces = list[set[str] | None]


class _Reader:
    """Reads a regex as pieces. What it doesn't know stays open, which costs candidates but never loses a match."""

    def __init__(self, pattern: str):
        self.p, self.at = pattern, 0

    def next(self, m: str = "") -> str:
        """The rest's beginning that matches m, taken; one character without m."""
        found = re.compile(m or ".", re.DOTALL).match(self.p, self.at)
        self.at = found.end() if found else self.at
        return found[0] if found else ""

    def branches(self) -> Pieces:
        """Alternatives, up to a closing bracket or the end."""
        all_ = [self.row()]
        while self.next(r"\|"):
            all_.append(self.row())
        if len(all_) == 1:
            return all_[0]
        whole = [_joined(x) for x in all_]
        if any(len(x) > 1 or None in x for x in whole):
            return [None]
        return [set().union(*(x[0] if x else {""} for x in whole))]

    def row(self) -> Pieces:
        out: Pieces = []
        while self.at < len(self.p) and self.p[self.at] not in "|)":
            out += self.times(self.atom())
        return out

    def atom(self) -> Pieces:
        if group := self.next(r"\((?:\?(?:P?<\w+>|[a-zA-Z-]*[:)]|[=!>]|<[=!])|)"):
            if re.fullmatch(r"\(\?[a-zA-Z-]*\)", group):  # flags for the rest: case is ignored here at any rate
                return []
            inner = self.branches()
            self.next(r"\)")
            return [] if group in ("(?=", "(?!", "(?<=", "(?<!") else inner
        if self.next(r"\["):
            return self.members()
        if escape := self.next(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[\s\S])"):
            return self.escaped(escape)
        c = self.next()
        return [None] if c == "." else [] if c in "^$" else [{c.lower()}]

    def escaped(self, escape: str) -> Pieces:
        if escape[1] in "xu" and len(escape) > 2:
            return [{chr(int(escape[2:], 16)).lower()}]
        if escape[1] in "bBAzZG":
            return []
        return [None] if escape[1].isalnum() else [{escape[1].lower()}]

    def members(self) -> Pieces:
        """A class in square brackets: its characters if they are few."""
        negated, found = self.next(r"\^"), set()
        first = True
        while first or not self.next(r"\]"):
            first, x = False, self.next(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[\s\S])|\[|&&") or self.next()
            if not x:
                return [None]
            if x in ("[", "&&"):  # classes within classes
                negated = "nested"
            one = self.escaped(x) if x[0] == "\\" else [{x.lower()}]
            if not one or one[0] is None or self.next(r"-(?!\])"):
                negated = negated or "open"
            else:
                found |= one[0]
        return [None if negated or len(found) > _MOST_STRINGS else found]

    def times(self, pieces: Pieces) -> Pieces:
        """The pieces as often as the quantifier behind them says."""
        q = self.next(r"(?:[?*+]|\{\d+(?:,\d*)?\})[?+]?")
        if not q:
            return pieces
        if q[0] == "?":
            strings = _joined(pieces)
            return [{""} | strings[0]] if len(strings) == 1 and strings[0] is not None else [None]
        if q[0] == "*":
            return [None]
        low, _, high = q.strip("{}?+").partition(",") if q[0] == "{" else ("1", ",", "")
        exact = q[0] == "{" and "," not in q
        return pieces * min(int(low), 64) + ([] if exact and int(low) <= 64 else [None])


def _joined(pieces: Pieces) -> Pieces:
    """Neighbouring pieces put together while they stand for few strings."""
    out: Pieces = []
    for p in pieces:
        last = out[-1] if out else None
        if p is not None and last is not None and len(p) * len(last) <= _MOST_STRINGS:
            out[-1] = {a + b for a in last for b in p}
        else:
            out.append(p)
    return out


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text of a match must have; an empty list: nothing can be said."""
    clauses = []
    for strings in _joined(_Reader(pattern).branches()):
        if strings and min(map(len, strings)) >= 3:
            clauses.append([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)])
    return clauses


def trigrams_of(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that an index needs for these rules."""
    return sorted({t for r in rules for c in trigram_query(r.pattern) for a in c for t in a})


def _narrowed(query: Query, trigrams: list[str]) -> Query:
    """What an index of some trigrams can say of a query: clauses with an alternative of which it has none say nothing."""
    return [clause for q in query if all(clause := [a & set(trigrams) for a in q])]


def index(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str) -> DataFrame:
    """Postings (trigram, id) of the given trigrams in the lower-cased texts, each once a row of docs.

    A search of bytes for each trigram: for the 52 of RULES that takes less than half the time of one regex with all
    of them, and far less than to cut each text into trigrams.
    """
    present = F.array_compact(F.array(*(F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams)))
    # lower() may add trigrams of letters outside ASCII, but it loses none
    low = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("low"))
    return low.select("id", F.explode(present).alias("trigram")).select("trigram", "id")


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(id, kinds): the documents that are in the intersected postings of a rule, and of which rules.

    Postings are combined before they are shuffled, to at most one row for each trigram asked for.
    """
    have = postings.groupBy("id").agg(F.collect_set("trigram").alias("have"))

    def meets(query: Query) -> Column:
        clauses = []
        for clause in query:
            alternatives = [reduce(Column.__and__, (F.array_contains("have", t) for t in sorted(a))) for a in clause]
            clauses.append(reduce(Column.__or__, alternatives))
        return reduce(Column.__and__, clauses)

    kinds = F.array_compact(F.array(*(F.when(meets(q), F.lit(k)) for k, q in queries.items())))
    return have.select("id", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once. What a lambda refers to outside of it, it computes again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _prefix_sums(x: Column) -> Column:
    """For each place of an array of numbers, the sum up to it. Blocks keep it well below quadratic."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)

    def summed(x: Column, block: Column) -> Column:
        numbers = F.sequence(F.lit(0), ((F.size(x) - 1) / block).cast("int"))
        blocks = F.transform(numbers, lambda b: total(F.slice(x, b * block + 1, block)))
        before = _let(blocks, lambda blocks: F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b))))
        return _let(
            before,
            lambda before: F.transform(
                x,
                lambda _, i: F.element_at(before, (i / block).cast("int") + 1)
                + total(F.slice(x, (i / block).cast("int") * block + 1, i % block + 1)),
            ),
        )

    return _let(x, lambda x: _let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int")), lambda block: summed(x, block)))


def matches(text: Column, rule: Rule) -> Column:
    """All leftmost, non-overlapping matches that count, as an array of (start, end) in code points.

    The text is cut at the matches: lengths of pieces and matches add up to the places.
    """
    pattern = F.lit(rule.pattern)
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else found
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.filter(F.arrays_zip(found.alias("size"), counted.alias("n"), pieces.alias("piece")), lambda m: m["size"].isNotNull())

    def placed(m: Column) -> Column:
        ends = _prefix_sums(F.transform(m, lambda x: x["size"] + x["piece"]))
        both = F.zip_with(m, ends, lambda x, e: F.struct((e - x["size"]).alias("start"), e.alias("end"), x["n"].alias("n")))
        kept = F.filter(both, lambda x: x["n"] >= rule.least)
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    none = F.array().cast("array<struct<start: int, end: int>>")
    return F.when(F.regexp_like(text, pattern), _let(whole, placed)).otherwise(none)


def _tagged(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], s["end"], F.lit(rank).alias("rank"), F.lit(kind).alias("kind")))


def _key(kind: str | Column, identity: Column) -> Column:
    return F.concat(kind if isinstance(kind, Column) else F.lit(kind), F.lit(":"), F.coalesce(identity.cast("string"), F.lit("null")))


def scanned(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_bytes: int = bloom.MOST_BYTES,
    kept: tuple[DataFrame, list[str]] | None = None,
) -> DataFrame:
    """docs with a column secrets: an array of (start, end, rank, kind), by start, then as the rules are listed.

    Candidates only say which texts are searched, so a Bloom filter of them will do where it takes at most
    most_bytes: then no text is shuffled, and a text that passes by mistake is searched in vain. More candidates are
    joined to the texts. All columns and rows stay. Null text counts as empty. Rows that share an id share their
    candidates, and each is searched by itself; null ids count as one id. An empty table stays empty.

    kept: postings of these documents and the trigrams that they were made for, if there are some from before. Rules
    may be new; of a rule's trigrams those that the index has are used.
    """
    none = F.array().cast("array<struct<start: int, end: int>>")
    trigrams = kept[1] if kept else trigrams_of(rules)
    queries = {r.kind: q for r in rules if (q := _narrowed(trigram_query(r.pattern), trigrams))}
    key, kinds = fresh(docs.columns, "key"), fresh(docs.columns, "kinds")
    seen, may, flags = docs, {}, {}
    if queries:
        found = checkpointed(candidates(kept[0] if kept else index(docs, trigrams, id_col, text_col), queries))
        pairs = found.select(F.explode("kinds").alias("kind"), "id").select(_key(F.col("kind"), F.col("id")).alias("key"))
        known = bloom.filter_of(pairs, most_bytes)
        if known:
            flags = {k: fresh(docs.columns, f"may_{i}") for i, k in enumerate(queries)}
            seen = docs.withColumns({flag: known.has(_key(k, F.col(id_col))) for k, flag in flags.items()})
            may = {k: F.col(flag) for k, flag in flags.items()}
        else:
            found = found.select(F.col("id").alias(key), F.col("kinds").alias(kinds))
            seen = docs.join(found, F.col(id_col).eqNullSafe(F.col(key)), "left").drop(key)
            may = {k: F.array_contains(kinds, k) for k in queries}
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = []
    for rank, rule in enumerate(rules):
        of = matches(text, rule)
        spans.append(_tagged(F.when(may[rule.kind], of).otherwise(none) if rule.kind in may else of, rank, rule.kind))
    by_start = F.array_sort(
        F.concat(*spans),
        lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["rank"] - b["rank"]),
    )
    return seen.withColumn(fresh(docs.columns, "secrets"), by_start).drop(kinds, *flags.values())


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each secret's characters replaced by * in the text; lengths and columns stay."""
    name = fresh(docs.columns, "secrets")
    return scanned(docs, rules, id_col, text_col).select(
        *(
            F.aggregate(
                name,
                F.col(text_col),
                lambda t, s: F.overlay(t, F.repeat(F.lit("*"), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"]),
            ).alias(c)
            if c == text_col
            else every([c])[0]
            for c in docs.columns
        )
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs."""
    found = scanned(docs.select(id_col, text_col), RULES, id_col, text_col).withColumnRenamed("secrets", "s_")
    count = lambda k: F.size(F.filter("s_", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("s_", lambda s: s["kind"].isin(*BASE))
    return found.select(id_col, *map(count, BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("s_")).alias("spans"))
