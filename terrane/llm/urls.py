"""URL filters: rules on host and path, and a Bloom filter cascade of listed hosts, in DataFrame operations only.

The first filter holds the listed hosts. All other hosts of the corpus that pass it by mistake are put
into a second one, the listed hosts that pass that by mistake into a third, and so on until no mistake is
left. The corpus's hosts are all that can be asked for, so the cascade answers exactly. The first filter's
rate of mistakes is the ratio of listed to other hosts: the second one then has about as many keys as the
first, however many hosts the corpus has. All sizes are checked; pages are judged where they lie, without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import MOST_BYTES, Filter, make_filter
from .common import ascii_lower, checkpointed, fresh

#: Bits a key and hashes of the levels behind the first: about one mistake in 7.
LATER_BITS = 4
LATER_HASHES = 3


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, with A-Z lowered; empty without a ://, or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(name, verdict) of the longest rule that fits host and path, the first of equally long ones; else null."""
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")),
        )
        for r in sorted(rules, key=lambda r: -len(r.name))
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<name: string, verdict: string>"))


def cascade(listed: DataFrame, universe: DataFrame, most_bytes: int = MOST_BYTES) -> list[Filter] | None:
    """Filters for the listed keys among all keys of universe (each with a column key, without repeats).

    None if they would take more than most_bytes together. A first level of n keys among m others takes about
    1.44 * log2(m / n) bits a key, all later ones about 6 more.
    """
    inside = checkpointed(universe.join(listed, "key", "left_semi"))
    outside = checkpointed(universe.join(listed, "key", "left_anti"))
    levels: list[Filter] = []
    left, others = most_bytes, outside.count()
    while count := inside.count():
        bits, hashes = LATER_BITS, LATER_HASHES
        if not levels and others > count:
            doublings = math.log2(others / count)
            bits, hashes = max(bits, math.ceil(1.44 * doublings)), max(hashes, round(doublings))
        left -= math.ceil(count * bits / 64) * 8
        if left < 0:
            return None
        levels.append(make_filter(inside, count, len(levels), bits, hashes))
        wrong = checkpointed(outside.filter(levels[-1].has(F.col("key"))))
        inside, outside = wrong, inside
    return levels


def listed_in(key: Column, levels: list[Filter]) -> Column:
    found = F.lit(False)
    for level in reversed(levels):
        found = level.has(key) & ~found
    return found


def judged(
    pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url", most_bytes: int = MOST_BYTES
) -> DataFrame:
    """pages with columns host, path, rule, verdict and listed (a name that pages has gets a _ more).

    The verdict is that of the longest rule that fits; without one it is block if the host is listed
    (column key of `listed`), else allow. A null url, or one without ://, has an empty host and path. Rows are
    judged one by one; a null key in the list is nothing's host. Where the cascade would take more than
    most_bytes, the hosts are joined with the list instead.
    """
    names = [fresh(pages.columns, c) for c in ("host", "path", "rule", "verdict", "listed")]
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    universe = checkpointed(pages.select(host.alias("key")).distinct())
    keys = listed.select("key").filter("key is not null").distinct()
    if (levels := cascade(keys, universe, most_bytes)) is not None:
        seen = pages.withColumn(names[4], listed_in(host, levels))
    else:
        key = fresh(pages.columns, "key")
        flags = keys.select(F.col("key").alias(key), F.lit(True).alias(names[4]))
        seen = pages.join(flags, host == F.col(key), "left").drop(key).fillna(False, [names[4]])
    rule = rule_of(F.col(names[0]), F.col(names[1]), rules)
    out = seen.withColumn(names[0], host).withColumn(names[1], path).withColumn(names[2], rule)
    verdict = F.coalesce(F.col(names[2])["verdict"], F.when(F.col(names[4]), "block").otherwise("allow"))
    return out.withColumn(names[3], verdict).withColumn(names[2], F.col(names[2])["name"])
