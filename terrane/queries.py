"""The queries of __spark_entry__.py over the driver's tables, each with SQL that says the same."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .functions import crs, spatial, transformers
from .functions.geometry import Geometry, box, write_wkb
from .functions.spatial import project_columns
from .operators import metadata
from .operators.joins import MANY_TO_MANY, Join
from .plans import filters as fl
from .plans import paging, params
from .plans.catalog import Catalog, Collection, static_filter
from .plans.engine import Engine
from .plans.properties import Composite, Property, static
from .sinks import files, text
from .sources.config import check, load
from .sources.readers import empty, geopackage, jdbc, parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def catalog(base: str) -> Catalog:
    """Collections over the driver's tables."""
    reader = lambda t: parquet(f"{base}/{t}.parquet")
    p = Property

    def of(table: str, *columns: tuple[str, str], **more) -> list[Property]:
        return [p(n, n, k, table, **more) for n, k in columns]

    orders = Collection(
        "orders",
        "orders",
        {"orders": reader("orders")},
        p("o_orderkey", "o_orderkey", "long", "orders", nullable=False),
        of("orders", ("o_custkey", "long"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string"))
        + [
            static("source", "'order desk'"),
            static("version", "'7'"),
            p("no_p", "o_orderstatus", "string", "orders", transformer=transformers.NullIf("string", "P")),
            p("no_p_dash", "o_orderstatus", "string", "orders", transformer=transformers.Chain("string", "NullIf(P) | IfNull(-)")),
            p("gap_dash", "nullif(o_orderstatus, 'P')", "string", transformer=transformers.IfNull("string", "-")),
            p("gap_code", "nullif(o_orderstatus, 'P')", "string", transformer=transformers.CodeList("string", {"F": "done", "O": "open", "$null": "none"})),
            p("key_text", "o_orderkey", "long", "orders", transformer=transformers.Prefix("long", "order.")),
            p("key_fixed", "o_orderkey", "long", "orders", transformer=transformers.FixedLength("long", "9")),
            p("status", "o_orderstatus", "string", "orders", transformer=transformers.CodeList("string", {"F": "done", "O": "open", "P": "open", "$null": "none"})),
            p("day", "o_orderdate", "timestamp", "orders", transformer=transformers.TimestampToDate("timestamp")),
            p("chained", "o_custkey", "long", "orders", transformer=transformers.Chain("long", "LongToString() | Prefix(c-)")),
            p("priority_lower", "lower(o_orderpriority)", "string"),
        ],
        title="Orders",
        times=[("o_orderdate", True)],
        strategy="hybrid",
    )
    orders.queryables = [x.name for x in orders.properties] + ["o_orderkey"]
    orders.params = {
        "status": params.values("status"),
        "priority": params.values("o_orderpriority", params.like()),
        "not_status": params.values("o_orderstatus", params.differs),
        "dated": params.values("o_orderdate", params.datetime_range(True, False)),
        "on": params.values("day", params.date_range(True, True)),
    }

    customers = Collection(
        "customers",
        "customer",
        {t: reader(t) for t in ("customer", "nation", "region", "orders", "lineitem", "part")},
        p("c_custkey", "c_custkey", "long", "customer", nullable=False),
        of("customer", ("c_name", "string"), ("c_acctbal", "double"), ("c_mktsegment", "string"))
        + of("nation", ("n_name", "string"))
        + of("region", ("r_name", "string")),
        joins=[Join("customer", "c_nationkey", "nation", "n_nationkey"), Join("nation", "n_regionkey::bigint", "region", "r_regionkey::bigint")],
        geometry=p("position", "", "geometry", "customer", xy=("c_nationkey", "c_acctbal"), srid=3067, geometry_type="POINT"),
    )
    customers.queryables = [x.name for x in customers.properties] + ["c_custkey"]

    bought = replace(
        customers,
        name="bought",
        table="orders",
        id=p("o_orderkey", "o_orderkey", "long", "orders", nullable=False),
        properties=of("part", ("p_partkey", "long"), ("p_brand", "string")),
        joins=[Join("orders", "o_orderkey", "part", "p_partkey", MANY_TO_MANY, ("lineitem", "l_orderkey", "l_partkey"))],
        geometry=None,
        queryables=["p_brand", "o_orderkey"],
    )

    lineitems = Collection(
        "lineitems",
        "lineitem",
        {"lineitem": reader("lineitem")},
        Composite(
            "id", kind="string", table="lineitem", joiner=transformers.Joiner("string", "-"),
            parts=(p("l_orderkey", "l_orderkey", "long", "lineitem"), p("l_linenumber", "l_linenumber", "int", "lineitem")),
        ),
        of("lineitem", ("l_orderkey", "long"), ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_returnflag", "string"), ("l_shipdate", "timestamp")),
        order=[("l_orderkey", True), ("l_linenumber", True)],
    )
    lineitems.queryables = ["l_quantity", "l_returnflag", "l_shipdate", "l_extendedprice", "l_linenumber"]

    events = Collection(
        "events",
        "events",
        {"events": reader("events")},
        p("event_id", "event_id", "long", "events", nullable=False),
        of("events", ("user_id", "long"), ("event_type", "string"), ("value", "double"), ("ts", "timestamp"), ("props", "json"))
        + [p("k", "cast(get_json_object(props, '$.k') as bigint)", "long"), p("ends", "ts + interval 1 hour", "timestamp")],
        geometry=p("position", "", "geometry", "events", xy=("cast(user_id * 7 % 360 as double) - 180", "cast(value % 90 as double)"), srid=84, geometry_type="POINT"),
        times=[("ts", False), ("ends", False)],
        order=[("ts", False)],
    )
    events.queryables = [x.name for x in events.properties] + ["event_id", "position"]
    events.params = {"valid": params.valid_at("ts", "ends"), "near": params.meets_wkt("position")}

    parts = Collection(
        "parts",
        "part",
        {"part": reader("part")},
        p("p_partkey", "p_partkey", "long", "part", nullable=False),
        of("part", ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double"))
        + [
            p("words", "split(p_name, ' ')", "array", element="string"),
            p("brand_digits", "lpad(regexp_replace(p_brand, '[^0-9]', ''), 6, '0')", "string", transformer=transformers.Slices("string", "'B-',%d[0:4],'-',%d[4:6]")),
        ],
        order=[("p_retailprice", False)],
        strategy="offset",
    )
    parts.queryables = [x.name for x in parts.properties] + ["p_partkey"]
    parts.params = {"words": params.shares_element("words")}
    parts.properties.append(p("use", "lpad(cast(p_size as string), 2, '0')", "string", transformer=transformers.BuildingFunction()))
    parts.params["use"] = params.values("use", params.building_function)
    events.properties.append(p("local_day", "cast(concat(cast(ts as string), 'Z') as timestamp)", "timestamptz", transformer=transformers.TimestamptzToDate("timestamptz", "Asia/Tokyo")))
    events.queryables.append("local_day")
    segments = Collection(
        "segments",
        "segments",
        {"segments": lambda spark: _segments(spark.read.parquet(f"{base}/events.parquet"))},
        p("event_id", "event_id", "long", "segments", nullable=False),
        of("segments", ("user_id", "long")),
        geometry=p("line", "line", "geometry", "segments", geometry_type="LINESTRING"),
        queryables=["line"],
    )
    indexed = replace(segments, name="indexed", geometry=replace(segments.geometry, bounds=("segments.x", "segments.y", "segments.x2", "segments.y")))
    large = replace(parts, name="large_parts", order=None)
    config = {"or": {"type": "OR", "value": ["big", "small"]}, "big": {"type": "BETWEEN", "prop": "p_size", "value": ["40", "50"]}, "small": {"type": "IN", "prop": "p_size", "value": ["1", "2"]}}
    large.static_filter = static_filter(large, config, "or")
    return Catalog().add(orders, customers, bought, lineitems, events, parts, large, segments, indexed)


def _segments(events: DataFrame) -> DataFrame:
    """Level lines of 20 units as WKB, with the columns of their envelopes."""

    @pandas_udf("binary")
    def line(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([write_wkb(Geometry("LINESTRING", ((a, b), (a + 20, b)))) for a, b in zip(x, y, strict=True)])

    at = events.select("event_id", "user_id", (F.col("user_id") * 7 % 360 - 180).cast("double").alias("x"), (F.col("value") % 90).alias("y"))
    return at.select("*", (F.col("x") + 20).alias("x2"), line("x", "y").alias("line"))


def engine(spark: SparkSession, base: str) -> Engine:
    return Engine(spark, catalog(base))


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def items(name: str, collection: str, parameters: dict[str, str], sql: str) -> None:
    """A query that is one request."""
    QUERIES[name] = lambda spark, base: engine(spark, base).items(collection, {"limit": "-1", **parameters})
    SQL[name] = sql


_O = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE "
_OP = {"properties": "o_orderstatus,o_totalprice"}


def _orders(name: str, cql: str, where: str) -> None:
    items(name, "orders", {**_OP, "filter": cql}, _O + where)


items("scan_properties", "orders", {"properties": "o_totalprice,nothing,o_orderstatus"}, "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
items("static_columns", "orders", {"properties": "source,version,priority_lower"}, "SELECT o_orderkey, 'order desk' AS source, 7 AS version, lower(o_orderpriority) AS priority_lower FROM orders")
items("composite_id", "lineitems", {"properties": "l_quantity"}, "SELECT l_orderkey || '-' || l_linenumber AS id, l_quantity FROM lineitem")
_orders("eq", "o_orderstatus = 'F'", "o_orderstatus = 'F'")
_orders("neq", "o_orderstatus <> 'F'", "o_orderstatus <> 'F'")
_orders("lt", "o_totalprice < 50000", "o_totalprice < 50000")
_orders("lte", "o_totalprice <= 50000.5", "o_totalprice <= 50000.5")
_orders("gt", "o_totalprice > 1e5", "o_totalprice > 1e5")
_orders("gte", "o_totalprice >= 150000", "o_totalprice >= 150000")
_orders("like", "o_orderpriority LIKE '%URG%'", "o_orderpriority LIKE '%URG%'")
_orders("not_like", "o_orderpriority NOT LIKE '1-%' AND NOT o_orderpriority LIKE '_-HIGH'", "o_orderpriority NOT LIKE '1-%' AND o_orderpriority NOT LIKE '_-HIGH'")
_orders("like_casei", "CASEI(o_orderpriority) LIKE '%uRg%'", "lower(o_orderpriority) LIKE '%urg%'")
items("like_star_dialect", "orders", {**_OP, "priority": "*urgent,5-*,?-HIGH"}, _O + "o_orderpriority LIKE '%urgent' OR o_orderpriority LIKE '5-%' OR o_orderpriority LIKE '_-HIGH'")
_orders("between", "o_totalprice BETWEEN 1000 AND 90000", "o_totalprice BETWEEN 1000 AND 90000")
_orders("not_between", "o_totalprice NOT BETWEEN 1000 AND 90000", "o_totalprice NOT BETWEEN 1000 AND 90000")
_orders("in_list", "o_orderstatus IN ('F','O')", "o_orderstatus IN ('F','O')")
_orders("not_in", "o_orderkey NOT IN (1, 2, 3)", "o_orderkey NOT IN (1, 2, 3)")
_orders("in_casei", "CASEI(o_orderstatus) IN (CASEI('f'),'p')", "lower(o_orderstatus) IN ('f','p')")
_orders("is_null", "no_p IS NULL", "nullif(o_orderstatus, 'P') IS NULL")
_orders("is_not_null", "no_p IS NOT NULL", "nullif(o_orderstatus, 'P') IS NOT NULL")
_orders("and_or_not", "NOT (o_orderstatus = 'F' AND o_totalprice > 1000 OR o_custkey < 100)", "NOT (o_orderstatus = 'F' AND o_totalprice > 1000 OR o_custkey < 100)")
_orders("big_number_literal", "o_orderkey < 10000000 AND o_custkey > 100.0", "o_orderkey < 10000000 AND o_custkey > 100")
_orders("unknown_literal", "o_custkey = 100.5 OR o_custkey <> 100.5 AND o_orderstatus = 'O'", "o_orderstatus = 'O'")
_orders("boolean_literals", "TRUE AND NOT FALSE AND o_orderstatus = 'F'", "o_orderstatus = 'F'")
_orders("pass_filter", "   ", "true")
_orders("deny_filter", "o_custkey = 100.5", "false")
items("int_decimal_literal", "parts", {"properties": "p_size", "filter": "p_size = 15.000 OR p_size = 7."}, "SELECT p_partkey, p_size FROM part WHERE p_size IN (15, 7)")
items("sql_expression_column", "orders", {"properties": "priority_lower", "filter": "priority_lower = '1-urgent'"}, "SELECT o_orderkey, lower(o_orderpriority) AS priority_lower FROM orders WHERE lower(o_orderpriority) = '1-urgent'")
_TR = {"properties": "no_p,no_p_dash,key_text,key_fixed,status,day,chained"}
_TR_SQL = """SELECT o_orderkey, nullif(o_orderstatus, 'P') AS no_p, coalesce(nullif(o_orderstatus, 'P'), '-') AS no_p_dash, 'order.' || o_orderkey AS key_text,
  lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS key_fixed, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END AS status,
  CAST(o_orderdate AS DATE) AS day, 'c-' || o_custkey AS chained FROM orders WHERE """
items("tr_output", "orders", _TR, _TR_SQL + "true")
items("tr_nullif", "orders", {**_TR, "filter": "no_p = 'null'"}, _TR_SQL + "o_orderstatus = 'P'")
items("tr_ifnull", "orders", {**_TR, "filter": "no_p_dash = 'F'"}, _TR_SQL + "o_orderstatus = 'F'")
_GAP = {"properties": "gap_dash,gap_code"}
_GAP_SQL = "SELECT o_orderkey, coalesce(s, '-') AS gap_dash, CASE s WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'none' END AS gap_code FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders) WHERE "
items("ifnull_equal_null", "orders", {**_GAP, "filter": "gap_dash = '-'"}, _GAP_SQL + "s IS NULL")
items("ifnull_not_equal", "orders", {**_GAP, "filter": "gap_dash <> '-'"}, _GAP_SQL + "s IS NOT NULL")
items("ifnull_in", "orders", {**_GAP, "filter": "gap_dash IN ('-', 'F')"}, _GAP_SQL + "s IS NULL OR s = 'F'")
items("codelist_null_equal", "orders", {**_GAP, "filter": "gap_code = 'none'"}, _GAP_SQL + "s IS NULL")
items("codelist_null_not_equal", "orders", {**_GAP, "filter": "gap_code <> 'none'"}, _GAP_SQL + "s IS NOT NULL")
items("ifnull_is_null", "orders", {**_GAP, "filter": "gap_dash IS NULL OR gap_code IS NULL"}, _GAP_SQL + "false")
items("chain_null_equal", "orders", {"properties": "no_p_dash", "filter": "no_p_dash = '-'"}, "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '-') AS no_p_dash FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus = 'P'")
items("tr_prefix", "orders", {**_TR, "filter": "key_text = 'order.7' OR key_text = 'nothing'"}, _TR_SQL + "o_orderkey = 7")
items("tr_fixedlen", "orders", {**_TR, "filter": "key_fixed IN ('000000007','000000032')"}, _TR_SQL + "o_orderkey IN (7, 32)")
items("tr_codelist", "orders", {**_TR, "filter": "status = 'done'"}, _TR_SQL + "o_orderstatus = 'F'")
items("codelist_reverse_many", "orders", {**_TR, "filter": "status = 'open'"}, _TR_SQL + "o_orderstatus IN ('O','P')")
items("codelist_not_equal_many", "orders", {**_TR, "filter": "status <> 'open'"}, _TR_SQL + "o_orderstatus NOT IN ('O','P')")
items("tr_ts_to_date", "orders", {**_TR, "filter": "day > DATE('1995-01-01') AND day <= DATE('1995-03-31') AND day <> DATE('1995-02-02')"}, _TR_SQL + "CAST(o_orderdate AS DATE) > DATE '1995-01-01' AND CAST(o_orderdate AS DATE) <= DATE '1995-03-31' AND CAST(o_orderdate AS DATE) <> DATE '1995-02-02'")
items("tr_chain", "orders", {**_TR, "filter": "chained = 'c-17'"}, _TR_SQL + "o_custkey = 17")
items("tr_string_slice", "parts", {"properties": "brand_digits"}, "SELECT p_partkey, 'B-' || CAST(CAST(substr(d, 1, 4) AS INT) AS VARCHAR) || '-' || CAST(CAST(substr(d, 5, 2) AS INT) AS VARCHAR) AS brand_digits FROM (SELECT p_partkey, lpad(regexp_replace(p_brand, '[^0-9]', '', 'g'), 6, '0') AS d FROM part)")
items("static_filter_in_between", "large_parts", {"properties": "p_size"}, "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 40 AND 50 OR p_size IN (1, 2)")
items("array_overlaps", "parts", {"properties": "p_name", "words": "red,ring"}, "SELECT p_partkey, p_name FROM part WHERE list_has_any(string_split(p_name, ' '), ['red','ring'])")
items("array_column", "parts", {"properties": "words"}, "SELECT p_partkey, string_split(p_name, ' ') AS words FROM part")
_D = "SELECT o_orderkey, o_orderdate FROM orders WHERE "
_DP = {"properties": "o_orderdate"}
items("datetime_instant", "orders", {**_DP, "datetime": "1995-06-17T00:00:00Z"}, _D + "o_orderdate = TIMESTAMP '1995-06-17 00:00:00'")
items("datetime_closed", "orders", {**_DP, "datetime": "1995-01-01T00:00:00Z/1995-06-30T02:00:00+02:00"}, _D + "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30'")
items("datetime_open_start", "orders", {**_DP, "datetime": "../1996-01-01T00:00:00Z"}, _D + "o_orderdate <= TIMESTAMP '1996-01-01'")
items("datetime_open_both", "orders", {**_DP, "datetime": "../.."}, _D + "true")
items("datetime_range_param", "orders", {**_DP, "dated": "1995-01-01T00:00:00Z/1995-02-01T00:00:00Z"}, _D + "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-02-01'")
items("date_range_mapper", "orders", {**_DP, "on": "1995-01-01/1995-01-31"}, _D + "CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-01-31'")
items("cql2_timestamp", "orders", {**_DP, "filter": "o_orderdate >= TIMESTAMP('1998-01-01T00:00:00Z')"}, _D + "o_orderdate >= TIMESTAMP '1998-01-01'")
items("param_values", "orders", {**_OP, "status": "done,open", "not_status": "F"}, _O + "o_orderstatus <> 'F'")
_E = "SELECT event_id, ts, {x} AS position_x, {y} AS position_y FROM events WHERE "
_EX, _EY = "(user_id * 7 % 360) - 180", "fmod(value, 90)"


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({"position_x": F.col("position.x"), "position_y": F.col("position.y")}).drop("position")


def _events(name: str, parameters: dict[str, str], where: str) -> None:
    QUERIES[name] = lambda spark, base: _flat(engine(spark, base).items("events", {"limit": "-1", "properties": "ts", **parameters}))
    SQL[name] = _E.format(x=f"CAST({_EX} AS DOUBLE)", y=_EY) + where


_events("datetime_multi_prop", {"datetime": "2024-01-02T00:00:00Z/2024-01-03T00:00:00Z"}, "ts > TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03' OR ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-02' AND ts + INTERVAL 1 HOUR < TIMESTAMP '2024-01-03'")
_events("datetime_exclusive", {"datetime": "2024-01-05T00:00:00Z/.."}, "ts > TIMESTAMP '2024-01-05' OR ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-05'")
_events("valid_at", {"valid": "2024-01-04T06:00:00Z"}, "ts <= TIMESTAMP '2024-01-04 06:00:00' AND (ts + INTERVAL 1 HOUR IS NULL OR ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-04 06:00:00')")
_events("bbox_points", {"bbox": "-20,10,60,50"}, f"({_EX}) BETWEEN -20 AND 60 AND {_EY} BETWEEN 10 AND 50")
_events("bbox_antimeridian", {"bbox": "160.6,10,-170,50"}, f"(({_EX}) BETWEEN 160.6 AND 180 OR ({_EX}) BETWEEN -180 AND -170) AND {_EY} BETWEEN 10 AND 50")
_events("bbox_latlon_swap", {"bbox": "10,-20,50,60", "bbox-crs": "http://www.opengis.net/def/crs/EPSG/0/4326"}, f"({_EX}) BETWEEN -20 AND 60 AND {_EY} BETWEEN 10 AND 50")
_events("bbox_six_numbers", {"bbox": "-20,10,0,60,50,9"}, f"({_EX}) BETWEEN -20 AND 60 AND {_EY} BETWEEN 10 AND 50")
_TRI = f"({_EX}) > -100 AND {_EY} > 0 AND ({_EX}) + 2 * {_EY} < 100"
_events("s_within_polygon", {"filter": "S_WITHIN(position, POLYGON((-100 0, 100 0, -100 100, -100 0)))"}, _TRI)
_events("s_intersects_polygon", {"filter": "S_INTERSECTS(position, POLYGON((-100 0, 100 0, -100 100)))"}, f"({_EX}) >= -100 AND {_EY} >= 0 AND ({_EX}) + 2 * {_EY} <= 100")
_events("s_disjoint", {"filter": "S_DISJOINT(position, BBOX(-20, 10, 60, 50))"}, f"NOT (({_EX}) BETWEEN -20 AND 60 AND {_EY} BETWEEN 10 AND 50)")
_events("s_touches", {"filter": "S_TOUCHES(position, BBOX(-19, -1, 60, 50))"}, f"(({_EX}) IN (-19, 60) AND {_EY} BETWEEN -1 AND 50) OR (({_EX}) BETWEEN -19 AND 60 AND {_EY} IN (-1, 50))")
_events("s_not_equals", {"filter": "NOT S_EQUALS(position, POINT(0 0)) AND NOT S_CROSSES(position, LINESTRING(0 0, 1 1)) AND NOT S_OVERLAPS(position, POINT(1 1))"}, f"NOT (({_EX}) = 0 AND {_EY} = 0)")
_events("s_contains", {"filter": "S_CONTAINS(position, POINT(6 4.08)) OR S_INTERSECTS(position, MULTIPOINT((1 1), (6 4.08)))"}, f"(({_EX}) = 6 AND {_EY} = 4.08) OR (({_EX}) = 1 AND {_EY} = 1)")
_events("s_intersects_hole", {"filter": "S_INTERSECTS(position, POLYGON((-100 0, 100 0, 100 80, -100 80, -100 0), (-50 20, 50 20, 50 60, -50 60, -50 20)))"}, f"({_EX}) BETWEEN -100 AND 100 AND {_EY} BETWEEN 0 AND 80 AND NOT (({_EX}) > -50 AND ({_EX}) < 50 AND {_EY} > 20 AND {_EY} < 60)")
_events("wkt_param", {"near": "SRID=4326;POLYGON((-20 10, 60 10, 60 50, -20 50))"}, f"({_EX}) BETWEEN -20 AND 60 AND {_EY} BETWEEN 10 AND 50")
_events("json_property", {"filter": "k >= 50"}, "CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")

_OCTAGON = [(3 * math.cos(-i * math.pi / 16), 3 * math.sin(-i * math.pi / 16)) for i in range(32)]


def _buffer_sql() -> str:
    """The circle's polygon of 32 sides, as half-planes."""
    out = []
    for (x1, y1), (x2, y2) in zip(_OCTAGON, _OCTAGON[1:] + _OCTAGON[:1], strict=True):
        out.append(f"({_EX} - 10 - ({x1!r})) * ({y2!r} - ({y1!r})) - ({_EY} - 20 - ({y1!r})) * ({x2!r} - ({x1!r})) >= 0")
    return " AND ".join(out)


_events("function_buffer", {"filter": "S_INTERSECTS(position, BUFFER(POINT(10 20), 3))"}, _buffer_sql())


_events("function_st_buffer", {"filter": "S_INTERSECTS(position, ST_BUFFER(LINESTRING(0 20, 40 20, 40 60), 2.9951, 'join=mitre endcap=square'))"}, f"({_EX}) BETWEEN -2.9951 AND 42.9951 AND {_EY} BETWEEN 17.0049 AND 22.9951 OR ({_EX}) BETWEEN 37.0049 AND 42.9951 AND {_EY} BETWEEN 17.0049 AND 62.9951")


@query("intersects_index", _E.format(x=f"CAST({_EX} AS DOUBLE)", y=_EY) + f"({_EX}) BETWEEN -20 AND 60 AND {_EY} BETWEEN 10 AND 50")
def intersects_index(spark: SparkSession, base: str) -> DataFrame:
    e = engine(spark, base)
    r = e.bind("events", {"limit": "-1", "properties": "ts"})
    r.filter = fl.Spatial(op="INTERSECTS_INDEX", prop=r.collection.geometry, geometry=box(-20, 10, 60, 50))
    return _flat(e.plan(r))


_J = "SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _customers(name: str, parameters: dict[str, str], tail: str) -> None:
    QUERIES[name] = lambda spark, base: engine(spark, base).items("customers", {"limit": "-1", "properties": "c_name,n_name,r_name", **parameters}).drop("position")
    SQL[name] = _J + tail


_customers("join_path", {}, "")
_customers("join_filter", {"filter": "r_name = 'ASIA' AND c_acctbal > 0"}, " WHERE r_name = 'ASIA' AND c_acctbal > 0")


@query("join_pruned", "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE ends_with(n_name, '_1')")
def join_pruned(spark: SparkSession, base: str) -> DataFrame:
    e = engine(spark, base)
    e.catalog.collections["customers"] = replace(e.catalog.collection("customers"), prune=True)
    return e.items("customers", {"limit": "-1", "properties": "c_name,n_name", "filter": "n_name LIKE '%\\_1'"}).drop("position")


items("join_many_to_many", "bought", {"filter": "p_brand = 'Brand#13'"}, "SELECT o_orderkey, p_partkey, p_brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#13'")


@query("count_matched", "SELECT count(*) AS number_matched FROM orders WHERE o_orderstatus = 'F'")
def count_matched(spark: SparkSession, base: str) -> DataFrame:
    return engine(spark, base).count("orders", {"filter": "o_orderstatus = 'F'"})


@query("count_with_join", "SELECT count(*) AS number_matched FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
def count_with_join(spark: SparkSession, base: str) -> DataFrame:
    return engine(spark, base).count("customers", {"filter": "r_name = 'EUROPE'"})


@query("count_collections", "SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM part) AS number_matched")
def count_collections(spark: SparkSession, base: str) -> DataFrame:
    return engine(spark, base).count_multi(["orders", "parts"])


items("order_limit", "orders", {**_OP, "limit": "25"}, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
items("limit_clamped", "orders", {**_OP, "limit": "0"}, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1")
items("offset_page", "orders", {**_OP, "limit": "25", "offset": "50"}, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")


@query("order_desc", "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id LIMIT 30")
def order_desc(spark: SparkSession, base: str) -> DataFrame:
    return engine(spark, base).items("events", {"properties": "ts,value", "limit": "30"}).drop("position")




@query("order_desc_nulls", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS no_p FROM orders ORDER BY no_p DESC NULLS FIRST, o_orderkey LIMIT 40")
def order_desc_nulls(spark: SparkSession, base: str) -> DataFrame:
    e = engine(spark, base)
    nullable = Property("no_p", "nullif(o_orderstatus, 'P')", "string")
    c = e.catalog.collection("orders")
    e.catalog.add(replace(c, properties=[nullable], order=[("no_p", False)], queryables=[]))
    return e.items("orders", {"limit": "40"})


def _next(name: str, collection: str, parameters: dict[str, str], values: tuple[str, ...], sql: str) -> None:
    def run(spark: SparkSession, base: str) -> DataFrame:
        return engine(spark, base).items(collection, {**parameters, "next": paging.Cursor(values).wire()})

    QUERIES[name], SQL[name] = run, sql


_next("cursor_page", "orders", {**_OP, "limit": "20"}, ("1000",), "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey >= 1000 ORDER BY o_orderkey LIMIT 20")
_next(
    "cursor_page_multikey",
    "lineitems",
    {"properties": "l_orderkey,l_linenumber", "limit": "50"},
    ("77", "2", "77-2"),
    "SELECT l_orderkey || '-' || l_linenumber AS id, l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) >= (77, 2) ORDER BY l_orderkey, l_linenumber LIMIT 50",
)


@query("page_next", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 20")
def page_next(spark: SparkSession, base: str) -> DataFrame:
    """The second page by following the first one's cursor."""
    e = engine(spark, base)
    first = e.page("orders", {**_OP, "limit": "20"})
    return e.items("orders", {**_OP, "limit": "20", "next": first.next})


@query("by_id", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def by_id(spark: SparkSession, base: str) -> DataFrame:
    return engine(spark, base).by_id("orders", "7", _OP)


@query("by_composite_id", "SELECT l_orderkey || '-' || l_linenumber AS id, l_quantity FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 2 LIMIT 1")
def by_composite_id(spark: SparkSession, base: str) -> DataFrame:
    return engine(spark, base).by_id("lineitems", "7-2", {"properties": "l_quantity"})


@query(
    "multi_collection",
    """SELECT 0 AS _collection, 'large_parts' AS collection, p_partkey, p_name, NULL AS o_orderkey FROM part WHERE p_size BETWEEN 40 AND 50 OR p_size IN (1, 2)
  UNION ALL SELECT * FROM (SELECT 1, 'orders', NULL, NULL, o_orderkey FROM orders ORDER BY o_orderkey
    LIMIT (SELECT greatest(0, 1000 - count(*)) FROM part WHERE p_size BETWEEN 40 AND 50 OR p_size IN (1, 2)))""",
)
def multi_collection(spark: SparkSession, base: str) -> DataFrame:
    return engine(spark, base).multi(["large_parts", "orders"], {"properties": "p_name", "limit": "1000"})


@query(
    "reproject_webmercator",
    f"SELECT event_id, round(CAST({_EX} AS DOUBLE) * pi() / 180 * 6378137.0, 3) AS x, round(ln(tan(pi() / 4 + {_EY} * pi() / 360)) * 6378137.0, 3) AS y FROM events WHERE {_EY} BETWEEN -80 AND 80",
)
def reproject_webmercator(spark: SparkSession, base: str) -> DataFrame:
    e = engine(spark, base)
    e.catalog.collections["events"] = replace(e.catalog.collection("events"), srids=[84, 3857])
    df = e.items("events", {"limit": "-1", "bbox": "-180,-80,180,80", "crs": crs.to_uri(3857), "properties": ""})
    return df.select("event_id", F.round("position.x", 3).alias("x"), F.round("position.y", 3).alias("y"))


@query("reproject_tm35", f"SELECT event_id, CAST({_EX} AS DOUBLE) AS x, round({_EY}, 6) AS y FROM events WHERE ({_EX}) BETWEEN 20 AND 32 AND {_EY} BETWEEN 1 AND 75")
def reproject_tm35(spark: SparkSession, base: str) -> DataFrame:
    """There and back: the projection's own inverse."""
    df = engine(spark, base).items("events", {"limit": "-1", "bbox": "20,1,32,75"})
    there = project_columns(F.col("position.x"), F.col("position.y"), 84, 3067)
    moved = df.select("event_id", there[0].alias("x"), there[1].alias("y"))
    back = project_columns(F.col("x"), F.col("y"), 3067, 84)
    return moved.select("event_id", F.round(back[0], 6).alias("x"), F.round(back[1], 6).alias("y"))


@query(
    "geojson_rows",
    """SELECT '{"type":"Feature","id":' || o_orderkey || ',"geometry":null,"properties":{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus
  || '","o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '"}}' AS feature FROM orders""",
)
def geojson_rows(spark: SparkSession, base: str) -> DataFrame:
    e = engine(spark, base)
    return text.geojson(e.catalog.collection("orders"), e.items("orders", {"limit": "-1", "properties": "o_custkey,o_orderstatus,o_orderdate"}))


_GJ = f"""'{{"type":"Point","coordinates":[' || ({_EX}) || ',' || rtrim(rtrim(printf('%.7f', {_EY}), '0'), '.') || ']}}'"""


@query("geojson_points", f"""SELECT '{{"type":"Feature","id":' || event_id || ',"geometry":' || {_GJ} || ',"properties":{{"user_id":' || user_id || ',"props":' || props || '}}}}' AS feature FROM events""")
def geojson_points(spark: SparkSession, base: str) -> DataFrame:
    e = engine(spark, base)
    return text.geojson(e.catalog.collection("events"), e.items("events", {"limit": "-1", "properties": "user_id,props"}))


@query("csv_wkt_rows", f"""SELECT event_id || ',"POINT (' || ({_EX}) || ' ' || rtrim(rtrim(printf('%.7f', {_EY}), '0'), '.') || ')",' || user_id || ',"' || event_type || '"' AS line FROM events""")
def csv_wkt_rows(spark: SparkSession, base: str) -> DataFrame:
    e = engine(spark, base)
    return text.csv(e.catalog.collection("events"), e.items("events", {"limit": "-1", "properties": "user_id,event_type,props"}))


@query(
    "esbulk_rows",
    """SELECT unnest(['{"index":{"_index":"orders"}}', '{"id":' || o_orderkey || ',"o_custkey":' || o_custkey || coalesce(',"no_p":"' || nullif(o_orderstatus, 'P') || '"', '') || '}']) AS line FROM orders""",
)
def esbulk_rows(spark: SparkSession, base: str) -> DataFrame:
    e = engine(spark, base)
    return text.bulk(e.catalog.collection("orders"), e.items("orders", {"limit": "-1", "properties": "o_custkey,no_p"}))


@query("geojson_seq_rows", """SELECT chr(30) || '{"type":"Feature","id":' || o_orderkey || ',"geometry":null,"properties":{"o_custkey":' || o_custkey || '}}' AS feature FROM orders""")
def geojson_seq_rows(spark: SparkSession, base: str) -> DataFrame:
    e = engine(spark, base)
    return text.geojson_seq(e.catalog.collection("orders"), e.items("orders", {"limit": "-1", "properties": "o_custkey"}))


@query(
    "jsonfg_rows",
    """SELECT '{"type":"Feature","id":' || o_orderkey || ',"properties":{"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '"},"time":{"timestamp":"'
  || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '"}}' AS feature FROM orders""",
)
def jsonfg_rows(spark: SparkSession, base: str) -> DataFrame:
    e = engine(spark, base)
    return text.jsonfg(e.catalog.collection("orders"), e.items("orders", {"limit": "-1", "properties": "o_orderdate"}))


@query("gml_rows", """SELECT '<gml:featureMember><app:orders gml:id="orders.' || o_orderkey || '"><app:o_orderstatus>' || o_orderstatus || '</app:o_orderstatus></app:orders></gml:featureMember>' AS member FROM orders""")
def gml_rows(spark: SparkSession, base: str) -> DataFrame:
    e = engine(spark, base)
    return text.gml(e.catalog.collection("orders"), e.items("orders", {"limit": "-1", "properties": "o_orderstatus"}))


@query("functions_meta", "SELECT * FROM (VALUES ('Buffer', 'geometry'), ('ST_Buffer', 'geometry')) t(name, returns)")
def functions_meta(spark: SparkSession, base: str) -> DataFrame:
    return metadata.functions(spark, catalog(base)).select("name", "returns")


@query("queryables_meta", "SELECT * FROM (VALUES ('l_quantity', 'number'), ('l_returnflag', 'string'), ('l_shipdate', 'string'), ('l_extendedprice', 'number'), ('l_linenumber', 'integer')) t(name, type)")
def queryables_meta(spark: SparkSession, base: str) -> DataFrame:
    return metadata.queryables(spark, catalog(base).collection("lineitems")).select("name", "type")


@query("collections_meta", "SELECT unnest(['orders', 'customers', 'bought', 'lineitems', 'events', 'parts', 'large_parts', 'segments', 'indexed']) AS id")
def collections_meta(spark: SparkSession, base: str) -> DataFrame:
    return metadata.collections(spark, catalog(base)).select("id")


@query("schema_meta", "SELECT * FROM (VALUES ('event_id', true), ('position', false), ('user_id', false), ('event_type', false), ('value', false), ('ts', false), ('props', false), ('k', false), ('ends', false), ('local_day', false)) t(name, required)")
def schema_meta(spark: SparkSession, base: str) -> DataFrame:
    return metadata.schema(spark, catalog(base).collection("events")).select("name", "required")


_USE = "CASE WHEN substr(lpad(CAST(p_size AS VARCHAR), 2, '0'), 1, 1) IN ('0','1') THEN lpad(CAST(p_size AS VARCHAR), 2, '0') ELSE substr(CAST(p_size AS VARCHAR), 1, 1) END"
items("tr_building", "parts", {"properties": "use", "use": "07,19,99"}, f"SELECT p_partkey, {_USE} AS use FROM part WHERE p_size IN (7, 19)")
items("tr_building_output", "parts", {"properties": "use"}, f"SELECT p_partkey, {_USE} AS use FROM part")
_LOCAL = "CAST(ts + INTERVAL 9 HOUR AS DATE)"
QUERIES["tr_tz_to_date"] = lambda spark, base: engine(spark, base).items(
    "events", {"limit": "-1", "properties": "local_day", "filter": "local_day >= DATE('2024-01-05') AND local_day < DATE('2024-01-08') AND local_day <> DATE('2024-01-06')"}
).drop("position")
SQL["tr_tz_to_date"] = f"SELECT event_id, {_LOCAL} AS local_day FROM events WHERE {_LOCAL} IN (DATE '2024-01-05', DATE '2024-01-07')"


def _lines(name: str, cql: str, where: str, collection: str = "segments") -> None:
    """A request over WKB lines from (x, y) to (x + 20, y)."""
    QUERIES[name] = lambda spark, base: engine(spark, base).items(collection, {"limit": "-1", "filter": cql}).drop("line")
    SQL[name] = f"SELECT event_id, user_id FROM (SELECT event_id, user_id, {_EX} AS x, {_EY} AS y FROM events) WHERE {where}"


_BOX, _IN = "BBOX(0, 10, 60, 50)", "y BETWEEN 10 AND 50 AND x + 20 >= 0 AND x <= 60"
_lines("wkb_intersects", f"S_INTERSECTS(line, {_BOX})", _IN)
_lines("wkb_intersects_indexed", f"S_INTERSECTS(line, {_BOX})", _IN, "indexed")
_lines("wkb_disjoint", f"S_DISJOINT(line, {_BOX})", f"NOT ({_IN})")
_lines("wkb_within", f"S_WITHIN(line, {_BOX})", "y > 10 AND y < 50 AND x >= 0 AND x + 20 <= 60")
_lines("wkb_crosses", f"S_CROSSES(line, {_BOX})", "y > 10 AND y < 50 AND (x < 0 AND x + 20 > 0 OR x < 60 AND x + 20 > 60)")
_lines("wkb_touches", "S_TOUCHES(line, BBOX(3, 10, 60, 50))", "y BETWEEN 10 AND 50 AND (x + 20 = 3 OR x = 60) OR y IN (10, 50) AND x + 20 >= 3 AND x <= 60")
_lines("wkb_contains", "S_CONTAINS(line, POINT(10 4.08))", "y = 4.08 AND x < 10 AND x + 20 > 10")
_lines("wkb_overlaps", "S_OVERLAPS(line, LINESTRING(0 4.08, 12 4.08)) OR S_EQUALS(line, LINESTRING(6 4.08, 26 4.08))", "y = 4.08 AND (x < 0 AND x + 20 > 0 AND x + 20 < 12 OR x > 0 AND x < 12 AND x + 20 > 12 OR x = 6)")
_LINE = "rtrim(rtrim(printf('%.7f', y), '0'), '.')"


@query("wkb_geojson", f"""SELECT '{{"type":"Feature","id":' || event_id || ',"geometry":{{"type":"LineString","coordinates":[[' || x || ',' || {_LINE} || '],[' || (x + 20) || ',' || {_LINE} || ']]}},"properties":{{"user_id":' || user_id || '}}}}' AS feature FROM (SELECT event_id, user_id, {_EX} AS x, {_EY} AS y FROM events)""")
def wkb_geojson(spark: SparkSession, base: str) -> DataFrame:
    e = engine(spark, base)
    return text.geojson(e.catalog.collection("segments"), e.items("segments", {"limit": "-1"}))


@query("wkb_envelopes", f"SELECT event_id, CAST(x AS DOUBLE) AS minx, CAST(x + 20 AS DOUBLE) AS maxx, y AS miny, y AS maxy, false AS empty FROM (SELECT event_id, {_EX} AS x, {_EY} AS y FROM events)")
def wkb_envelopes(spark: SparkSession, base: str) -> DataFrame:
    df = engine(spark, base).items("segments", {"limit": "-1"})
    f = {"minx": spatial.st_min_x, "maxx": spatial.st_max_x, "miny": spatial.st_min_y, "maxy": spatial.st_max_y, "empty": spatial.st_is_empty}
    return df.select("event_id", *(g(F.col("line")).alias(n) for n, g in f.items()))


_lines("wkb_equals", "S_EQUALS(line, LINESTRING(6 4.08, 26 4.08)) OR S_EQUALS(line, LINESTRING(10 7.5, -10 7.5))", "y = 4.08 AND x = 6 OR y = 7.5 AND x = -10")


@query("filter_crs", _E.format(x=f"CAST({_EX} AS DOUBLE)", y=_EY) + f"({_EX}) BETWEEN 25 AND 50 AND {_EY} BETWEEN 10 AND 50")
def filter_crs(spark: SparkSession, base: str) -> DataFrame:
    """A filter's box in metres of Web Mercator, a little larger than the degrees it stands for."""
    e = engine(spark, base)
    e.catalog.collections["events"] = replace(e.catalog.collection("events"), srids=[84, 3857])
    metres = "S_INTERSECTS(position, BBOX(2782987.26, 1118889.97, 5565974.55, 6446275.85))"
    return _flat(e.items("events", {"limit": "-1", "properties": "ts", "filter": metres, "filter-crs": crs.to_uri(3857)}))


items("sortby_is_default_order", "orders", {**_OP, "limit": "15", "sortby": "-o_totalprice"}, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 15")
_GML = f"""'<gml:featureMember><app:{{0}} gml:id="{{0}}.' || event_id || '"><app:{{1}}>{{2}}</app:{{1}}><app:user_id>' || user_id || '</app:user_id></app:{{0}}></gml:featureMember>'"""
_POS = f"rtrim(rtrim(printf('%.7f', {_EY}), '0'), '.')"


@query("gml_lines", "SELECT " + _GML.format("segments", "line", f"""<gml:LineString srsName="urn:ogc:def:crs:OGC:1.3:CRS84"><gml:posList>' || ({_EX}) || ' ' || {_POS} || ' ' || ({_EX} + 20) || ' ' || {_POS} || '</gml:posList></gml:LineString>""") + " AS member FROM events")
def gml_lines(spark: SparkSession, base: str) -> DataFrame:
    e = engine(spark, base)
    return text.gml(e.catalog.collection("segments"), e.items("segments", {"limit": "-1"}))


@query("gml_points_latlon", "SELECT " + _GML.format("events", "position", f"""<gml:Point srsName="urn:ogc:def:crs:EPSG::4326"><gml:pos>' || {_POS} || ' ' || ({_EX}) || '</gml:pos></gml:Point>""") + " AS member FROM events")
def gml_points_latlon(spark: SparkSession, base: str) -> DataFrame:
    e = engine(spark, base)
    return text.gml(e.catalog.collection("events"), e.items("events", {"limit": "-1", "properties": "user_id", "crs": crs.to_uri(4326)}), 4326)


@query("geojson_latlon", f"""SELECT '{{{{"type":"Feature","id":' || event_id || ',"geometry":{{{{"type":"Point","coordinates":[' || {_POS} || ',' || ({_EX}) || ']}}}},"properties":{{{{"user_id":' || user_id || '}}}}}}}}' AS feature FROM events""".replace("{{", "{").replace("}}", "}"))
def geojson_latlon(spark: SparkSession, base: str) -> DataFrame:
    e = engine(spark, base)
    return text.geojson(e.catalog.collection("events"), e.items("events", {"limit": "-1", "properties": "user_id", "crs": crs.to_uri(4326)}), 4326)


@query("geojson_arrays", """SELECT '{"type":"Feature","id":' || p_partkey || ',"geometry":null,"properties":{"words":["' || replace(p_name, ' ', '","') || '"]}}' AS feature FROM part""")
def geojson_arrays(spark: SparkSession, base: str) -> DataFrame:
    e = engine(spark, base)
    return text.geojson(e.catalog.collection("parts"), e.items("parts", {"limit": "-1", "properties": "words"}))


@query("geopackage_there_and_back", f"SELECT event_id, CAST({_EX} AS DOUBLE) AS x, {_EY} AS y, user_id, event_type, value, ts FROM events WHERE ({_EX}) BETWEEN 20 AND 32")
def geopackage_there_and_back(spark: SparkSession, base: str) -> DataFrame:
    """Written to a GeoPackage file and scanned from it. Both are done by the driver, so its own folder will do."""
    e = engine(spark, base)
    found = e.items("events", {"limit": "-1", "bbox": "20,-90,32,90", "properties": "user_id,event_type,value,ts"})
    with tempfile.TemporaryDirectory() as folder:
        files.write_geopackage(f"{folder}/e.gpkg", [(e.catalog.collection("events"), found)])
        read = geopackage(f"{folder}/e.gpkg", "events")(spark)
    at = {"x": spatial.st_min_x(F.col("position")), "y": spatial.st_max_y(F.col("position"))}
    return read.select("event_id", *(c.alias(n) for n, c in at.items()), "user_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("jdbc_scan", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 1000 AND s_nationkey IN (3, 4, 5)")
def jdbc_scan(spark: SparkSession, base: str) -> DataFrame:
    """A collection over a database table, read in ranges of its key; filters and columns go to the database."""
    table, rows = "SUPPLIER", spark.read.parquet(f"{base}/supplier.parquet")
    low, high = rows.agg(F.min("s_suppkey"), F.max("s_suppkey")).first()
    ranges = {} if low is None else {"column": "s_suppkey", "low": str(low), "high": str(high), "parts": 3}
    read = jdbc(files.write_derby(files.shared_path(spark), table, rows), table, driver=_DERBY, **ranges)
    p = Property
    suppliers = Collection(
        "suppliers", table, {table: read}, p("s_suppkey", "s_suppkey", "long", table, nullable=False),
        [p("s_name", "s_name", "string", table), p("s_acctbal", "s_acctbal", "double", table), p("s_nationkey", "s_nationkey", "int", table)],
        queryables=["s_acctbal", "s_nationkey"],
    )
    return Engine(spark, Catalog().add(suppliers)).items("suppliers", {"limit": "-1", "properties": "s_name,s_acctbal", "filter": "s_acctbal > 1000 AND s_nationkey IN (3, 4, 5)"})


_DERBY = "org.apache.derby.jdbc.EmbeddedDriver"


@query("uuid_equal", "SELECT o_orderkey, '00000000-0000-4000-a000-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS uid FROM orders WHERE o_orderkey IN (7, 32)")
def uuid_equal(spark: SparkSession, base: str) -> DataFrame:
    e = engine(spark, base)
    c = e.catalog.collection("orders")
    uid = Property("uid", "concat('00000000-0000-4000-a000-', lpad(cast(o_orderkey as string), 12, '0'))", "uuid")
    e.catalog.add(replace(c, properties=[uid], queryables=["uid"]))
    return e.items("orders", {"limit": "-1", "filter": "uid IN ('00000000-0000-4000-A000-000000000007', '00000000-0000-4000-a000-000000000032')"})


@query("bbox_on_two_geometries", f"SELECT event_id FROM events WHERE ({_EX}) BETWEEN -20 AND 60 AND {_EY} BETWEEN 10 AND 50 AND {_EY} BETWEEN -20 AND 60 AND ({_EX}) BETWEEN 10 AND 50")
def bbox_on_two_geometries(spark: SparkSession, base: str) -> DataFrame:
    """The request's box on the position, and on another geometry that has x and y changed."""
    e = engine(spark, base)
    c = e.catalog.collection("events")
    turned = replace(c.geometry, name="turned", xy=c.geometry.xy[::-1])
    e.catalog.add(replace(c, properties=[turned], params={"both": params.SameBbox("turned")}))
    return e.items("events", {"limit": "-1", "bbox": "-20,10,60,50", "both": "true"}).select("event_id")


@query("inverse_filter", _O + "o_totalprice > 100000 AND NOT (o_orderkey <= 50)")
def inverse_filter(spark: SparkSession, base: str) -> DataFrame:
    """Literals on the left: 100000 < price, and not 50 >= key."""
    e = engine(spark, base)
    r = e.bind("orders", {**_OP, "limit": "-1"})
    by_name = r.collection.queryable()
    r.filter = fl.conjunction(fl.inverse(fl.ordered("<", by_name["o_totalprice"], "100000")), fl.negated(fl.inverse(fl.ordered(">=", by_name["o_orderkey"], "50"))))
    return e.plan(r)


@query("number_returned", "SELECT count(*) AS number_returned FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1000)")
def number_returned(spark: SparkSession, base: str) -> DataFrame:
    df, seen = engine(spark, base).observed("orders", {**_OP, "filter": "o_orderstatus = 'F'"})
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["number_returned"],)], "number_returned long")


_CONFIG = """
collections=shops,lines
srid=3857,990033
srid.990033.proj4=+proj=tmerc +lat_0=0 +lon_0=-82 +k=0.9996 +x_0=500000 +ellps=GRS80 +units=m
collections.shops.table=customer
collections.shops.id.mapping=c_custkey
collections.shops.id.alias=shop
collections.shops.properties=c_name,balance,country,kind,code
collections.shops.properties.balance.mapping=c_acctbal
collections.shops.properties.country.mapping=nation.n_name
collections.shops.properties.kind.mapping='shop'
collections.shops.properties.code.mapping=c_mktsegment
collections.shops.properties.code.transformer=Prefix
collections.shops.properties.code.transformer.arg=seg-
collections.shops.joins=n
collections.shops.joins.n.left=customer.c_nationkey
collections.shops.joins.n.right=nation.n_nationkey
collections.shops.parameters=code,country
collections.shops.parameters.country.mapper=like
collections.shops.filters=f
collections.shops.filters.f.type=>
collections.shops.filters.f.prop=balance
collections.shops.filters.f.value=0
collections.shops.pagination=balance
collections.shops.pagination.order=DESC
collections.shops.pagination.strategy=offset
collections.lines.table=lineitem
collections.lines.id.mapping=l_orderkey,l_linenumber
collections.lines.properties=l_quantity
"""


@query(
    "configured_collection",
    """SELECT c_custkey AS shop, c_name, c_acctbal AS balance, n_name AS country, 'shop' AS kind, 'seg-' || c_mktsegment AS code FROM customer JOIN nation ON c_nationkey = n_nationkey
  WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING' AND (n_name LIKE 'NATION_1%' OR n_name LIKE '%_7') ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10""",
)
def configured_collection(spark: SparkSession, base: str) -> DataFrame:
    """Aliases, a joined and a static column, a transformer, parameters, a fixed filter, the order and paging from configuration."""
    e = Engine(spark, load(spark, _CONFIG, base))
    return e.items("shops", {"code": "seg-BUILDING", "country": "NATION_1*,*_7", "limit": "20", "next": paging.Cursor(("",), 10).wire()})


@query("config_check", "SELECT 'a: a: id.mapping is needed' AS problem")
def config_check(spark: SparkSession, base: str) -> DataFrame:
    broken = "collections=a,lines\ncollections.a.type=test\n" + _CONFIG.split("\n", 2)[2]
    return spark.createDataFrame([(x,) for x in check(spark, broken, base=base)], "problem string")


#: Helmert's series for the length of the meridian, in powers of the third flattening, times the scale of the zone.
_N3 = "(1 / 298.257222101) / (2 - 1 / 298.257222101)"
_ARC = """0.9996 * 6378137.0 / (1 + n) * ((1 + n * n / 4 + n ** 4 / 64) * p - 1.5 * (n - n ** 3 / 8) * sin(2 * p) + 15.0 / 16 * (n * n - n ** 4 / 4) * sin(4 * p)
  - 35.0 / 48 * n ** 3 * sin(6 * p) + 315.0 / 512 * n ** 4 * sin(8 * p))"""


@query("configured_srid", f"SELECT event_id, 500000.0::DOUBLE AS x, round({_ARC}, 2) AS y FROM (SELECT event_id, radians({_EY}) AS p, {_N3} AS n FROM events WHERE ({_EX}) = -82 AND {_EY} BETWEEN 1 AND 80)")
def configured_srid(spark: SparkSession, base: str) -> DataFrame:
    """Positions on the meridian of a zone that the configuration adds: there x is fixed and y the meridian's length."""
    load(spark, _CONFIG, base)
    found = engine(spark, base).items("events", {"limit": "-1", "bbox": "-82,1,-82,80"})
    x, y = project_columns(F.col("position.x"), F.col("position.y"), 84, 990033)
    return found.select("event_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


_IN_MEMORY = """
collections=piers
collections.piers.type=test
collections.piers.id.mapping=id
collections.piers.geometry.mapping=spot
collections.piers.geometry.type=POINT
collections.piers.properties=wood,built
collections.piers.properties.wood.enum=oak,pine
collections.piers.parameters=wood
collections.piers.testdata.1=p1;POINT(2 3);oak;1950
collections.piers.testdata.2=p2;POINT(4 5);pine;null
collections.piers.testdata.3=p3;POINT(6 7);oak;1970
"""


@query("in_memory_collection", """SELECT unnest(['{"type":"Feature","id":"p1","geometry":{"type":"Point","coordinates":[2,3]},"properties":{"wood":"oak","built":"1950"}}',
  '{"type":"Feature","id":"p3","geometry":{"type":"Point","coordinates":[6,7]},"properties":{"wood":"oak","built":"1970"}}']) AS feature""")
def in_memory_collection(spark: SparkSession, base: str) -> DataFrame:
    e = Engine(spark, load(spark, _IN_MEMORY))
    return text.geojson(e.catalog.collection("piers"), e.items("piers", {"wood": "oak"}))


@query("empty_source", "SELECT o_orderkey, o_orderstatus FROM orders WHERE false")
def empty_source(spark: SparkSession, base: str) -> DataFrame:
    c = Collection("none", "none", {"none": empty("o_orderkey long, o_orderstatus string")}, Property("o_orderkey", "o_orderkey", "long", "none"), [Property("o_orderstatus", "o_orderstatus", "string", "none")])
    return Engine(spark, Catalog().add(c)).items("none", {"limit": "-1"})


@query("negotiated_formats", "SELECT * FROM (VALUES ('text/html,*/*;q=0.1', 'json'), ('text/csv;q=0.9', 'csv'), ('image/png, text/html', 'html'), ('', 'json'), ('image/png', NULL)) t(accept, format)")
def negotiated_formats(spark: SparkSession, base: str) -> DataFrame:
    def chosen(accept: str) -> str | None:
        try:
            return files.negotiate(None, accept)
        except ValueError:
            return None

    given = ("text/html,*/*;q=0.1", "text/csv;q=0.9", "image/png, text/html", "", "image/png")
    return spark.createDataFrame([(a, chosen(a)) for a in given], "accept string, format string")


@query("landing_links", "SELECT * FROM (VALUES ('self', '/'), ('service-desc', '/api'), ('conformance', '/conformance'), ('data', '/collections')) t(rel, href)")
def landing_links(spark: SparkSession, base: str) -> DataFrame:
    return spark.createDataFrame([(x["rel"], x["href"]) for x in metadata.landing(catalog(base))["links"]], "rel string, href string")


@query(
    "openapi_parameters",
    """SELECT * FROM (VALUES ('f', 'string'), ('limit', 'integer'), ('offset', 'integer'), ('next', 'string'), ('bbox', 'array'), ('bbox-crs', 'string'), ('datetime', 'string'), ('crs', 'string'),
  ('properties', 'array'), ('filter', 'string'), ('filter-lang', 'string'), ('filter-crs', 'string'), ('valid', 'string'), ('near', 'string')) t(name, type)""",
)
def openapi_parameters(spark: SparkSession, base: str) -> DataFrame:
    given = metadata.openapi(catalog(base))["paths"]["/collections/events/items"]["get"]["parameters"]
    return spark.createDataFrame([(p["name"], p["schema"]["type"]) for p in given], "name string, type string")


@query("renamed_layers", """SELECT 0 AS _collection, 'sizes' AS collection, p_partkey, NULL AS o_orderkey FROM part WHERE p_size BETWEEN 40 AND 50 OR p_size IN (1, 2)
  UNION ALL SELECT 1, 'sales', NULL, o_orderkey FROM orders""")
def renamed_layers(spark: SparkSession, base: str) -> DataFrame:
    return engine(spark, base).multi(["large_parts", "orders"], {"properties": "none", "limit": "-1", "layernames": "sizes,sales"}).select("_collection", "collection", "p_partkey", "o_orderkey")


@query("telemetry", """SELECT '{"collection":"orders","numberReturned":' || count(*) || ',"limit":"7"}' AS line FROM (SELECT * FROM orders LIMIT 7)""")
def telemetry(spark: SparkSession, base: str) -> DataFrame:
    page = engine(spark, base).page("orders", {**_OP, "limit": "7"})
    return spark.createDataFrame([(metadata.telemetry_line("orders", page.number_returned, limit="7"),)], "line string")


def flagship(spark: SparkSession, base: str) -> DataFrame:
    """A filter, an order and a page over orders."""
    return engine(spark, base).items(
        "orders", {"filter": "o_totalprice > 100000 AND o_orderstatus IN ('F','O')", "properties": "o_custkey,o_orderstatus,o_totalprice,o_orderdate", "limit": "10"}
    )


QUERIES["flagship"] = flagship
SQL["flagship"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F','O') ORDER BY o_orderkey LIMIT 10"
