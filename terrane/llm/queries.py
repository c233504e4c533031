"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, media, mixing, near_dedup, quality, secrets, sharding, tokens, urls
from .common import table

#: Names of hosts on the list that op9 filters by, with the prefixes and zones they come with.
LISTED_NAMES = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track")
LISTED_PREFIXES = ("", "www.", "m.", "blog.")
LISTED_ZONES = ("com", "net", "org")
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents").select("doc_id"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.suffix_sums(tokens.histogram(tokens.lengths(table(spark, sf_dir, "documents"))))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    two = F.array(*(F.struct(F.lit(-1).cast("long"), F.lit(i).cast("long"), F.lit(r), F.lit(CONTROL_TEXT)) for i, r in enumerate(("user", "assistant"))))
    more = spark.range(1).select(F.inline(two)).toDF("conv_id", "turn", "role", "text")
    return chat.digests(chat.examples(turns.union(more))).drop("n_examples")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    array = lambda values: F.explode(F.array(*map(F.lit, values)))
    names = spark.range(1).select(array(LISTED_NAMES).alias("n")).select("n", array(LISTED_PREFIXES).alias("p"))
    listed = names.select("n", "p", array(LISTED_ZONES).alias("z")).select(F.concat("p", "n", F.lit(".example."), "z").alias("key"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_decontamination,
        op3_near_dedup,
        op4_sharding,
        op5_token_counts,
        op6_chat_formatting,
        op7_secret_scan,
        op8_source_mixing,
        op9_url_filter,
        op10_media_columns,
    )
}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def _lower(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
b AS (SELECT row_number() OVER () AS b, * FROM (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_lower("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark)),
bw AS (SELECT b, item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT b, item, i AS ip, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n FROM bw),
widths AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, widths WHERE len(w) >= n),
hits AS (SELECT dp.doc_id, dp.i, dp.n, win.item, b, ip FROM dp JOIN win ON win.n = dp.n AND win.win = array_to_string(dp.w[dp.i:dp.i + dp.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
runs AS (SELECT doc_id, min(i) AS i, item, min(ip) AS ip, count(*) + n - 1 AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, b, n, i - ip ORDER BY i) AS run FROM hits) GROUP BY doc_id, b, item, n, i - ip, run),
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, i, item, ip) = 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(longest.length, 0) AS longest_match, longest.i - 1 AS longest_start, longest.item AS longest_item, longest.ip - 1 AS longest_item_start
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

_OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_SPACED}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) AS s FROM d WHERE len(w) > 0),
n AS (SELECT d.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n FROM d LEFT JOIN s USING (doc_id)),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM n JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

#: The table is filled turn by turn: the state is the slots claimed so far, in order, with the shards' next steps.
_OP4 = f"""
WITH RECURSIVE p AS (
  SELECT s, ('0x' || substr(md5('offset-' || s), 1, 15))::BIGINT % {sharding.SLOTS} AS o,
         ('0x' || substr(md5('skip-' || s), 1, 15))::BIGINT % ({sharding.SLOTS} - 1) + 1 AS k FROM range(0, {sharding.SHARDS}) r(s)),
orders AS (SELECT list([CAST((o + k * j) % {sharding.SLOTS} AS INTEGER) FOR j IN range(0, {sharding.SLOTS})] ORDER BY s) AS orders FROM p),
t AS (SELECT 0 AS turn, CAST([] AS INTEGER[]) AS claimed
  UNION ALL
  SELECT turn + 1, list_append(claimed, list_filter(orders[turn % {sharding.SHARDS} + 1], lambda x: NOT list_contains(claimed, x))[1])
  FROM t, orders WHERE turn < {sharding.SLOTS}),
final AS (SELECT claimed FROM t WHERE turn = {sharding.SLOTS}),
slots AS (SELECT unnest(claimed) AS slot, unnest(range(0, {sharding.SLOTS})) % {sharding.SHARDS} AS shard FROM final)
SELECT doc_id, CAST(shard AS INTEGER) AS shard
FROM documents JOIN slots ON slot = ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT % {sharding.SLOTS}
"""

_OP6 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
f AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*/?(s>|INST\]|SYS\]|ROLE\]|TURN\])'))
    + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 7
      ELSE 20 + length(role) + len(regexp_extract_all(role, '[<\[]\\*/?(s>|INST\]|SYS\]|ROLE\]|TURN\])')) END AS n FROM c),
r AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS so_far,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (role = 'assistant' OR from_end = 1) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""


def _op7() -> str:
    found = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        found.append(
            f"SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, regexp_extract_all(text, '{pattern}') AS m, "
            f"regexp_extract_all(text, '{pattern}', {rule.group}) AS g, string_split_regex(text, '{pattern}') AS p, {rule.least} AS least FROM d"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(found)}),
x AS (SELECT doc_id, rank, kind, unnest(range(1, len(m) + 1)) AS i, m, g, p, least FROM f WHERE len(m) > 0),
y AS (SELECT doc_id, rank, kind, length(g[i]) AS n, least,
  CAST(list_sum([length(z) FOR z IN p[1:i]]) + list_sum([length(z) FOR z IN m[1:i]]) AS BIGINT) AS e, length(m[i]) AS size FROM x),
s AS (SELECT doc_id, rank, kind, e - size AS b, kind || ':' || (e - size) || ':' || e AS said FROM y WHERE n >= least),
t AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(said, ',' ORDER BY b, rank) FILTER (rank < 3) AS base, string_agg(said, ',' ORDER BY b, rank) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (doc_id)
"""


def _op9() -> str:
    fits = "".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}' "
        for r in sorted(urls.RULES, key=lambda r: -len(r.name))
    )
    verdicts = "".join(f"WHEN '{r.name}' THEN '{r.verdict}' " for r in urls.RULES)
    listed = ", ".join(f"'{p}{n}.example.{z}'" for n in LISTED_NAMES for p in LISTED_PREFIXES for z in LISTED_ZONES)
    host = _lower(r"coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')")
    return rf"""
WITH u AS (SELECT page_id, {host} AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {fits}END AS rule FROM u)
SELECT page_id, host, path, rule, CASE rule {verdicts}ELSE CASE WHEN host IN ({listed}) THEN 'block' ELSE 'allow' END END AS verdict FROM r
"""


ORACLES: dict[str, str] = {
    "op2_decontamination": _OP2,
    "op3_near_dedup": _OP3,
    "op4_sharding": _OP4,
    "op6_chat_formatting": _OP6,
    "op7_secret_scan": _op7(),
    "op9_url_filter": _op9(),
}
