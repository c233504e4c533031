"""From a request to one DataFrame plan: filters, columns, order and page."""

from __future__ import annotations

import logging
import threading
import time
from collections import OrderedDict
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, spatial
from . import cql2, paging, params
from . import filters as fl
from .catalog import Catalog, Collection
from .properties import Property

KNOWN = ("f", "collections", "limit", "offset", "next", "bbox", "bbox-crs", "datetime", "crs", "properties", "filter", "filter-lang", "filter-crs", "sortby", "layernames")


@dataclass
class Request:
    """A collection's part of a request, bound and ready to be planned."""

    collection: Collection
    filter: fl.Filter
    properties: list[Property]
    order: list[tuple[Property, bool]]
    limit: int | None
    offset: int = 0
    cursor: paging.Cursor | None = None
    crs: int = 84

    @property
    def tables(self) -> set[str]:
        c = self.collection
        used = {p.table for p in [c.id, *self.properties, *(p for p, _ in self.order)]}
        used |= {c.prop(n).table for n in fl.properties_of(self.filter) | fl.properties_of(c.static_filter)}
        used |= {x.table for p in [c.id, *self.properties] for x in getattr(p, "parts", ())}
        return used | ({c.geometry.table} if c.geometry else set())


@dataclass
class Page:
    rows: list[Row]
    next: str | None
    number_returned: int
    next_param: str = "next"


@dataclass
class MultiPage:
    """Rows with their collection's name; the collections that the next page goes on with, and a cursor in the first."""

    rows: list[tuple[str, Row]]
    remaining: list[str]
    next: str | None


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog, cache_size: int = 0, cache_seconds: float = 120, cache_refresh: float = 60):
        self.spark, self.catalog = spark, catalog
        self.cache = Cache(cache_size, cache_seconds, cache_refresh)

    # --- binding ---------------------------------------------------------------------------------------

    def bind(self, name: str, query: dict[str, str] | None = None) -> Request:
        """Parameters of a request on one collection. ValueError for unknown names and bad values."""
        query, c = {k: str(v) for k, v in (query or {}).items()}, self.catalog.collection(name)
        unknown = [k for k, v in query.items() if v != "" and k not in KNOWN and k not in c.params]
        if unknown:
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        if query.get("filter-lang", "cql2-text") != "cql2-text":
            raise ValueError("'filter-lang' must be cql2-text")
        codes = {k: crs.parse_uri(query.get(k), k) for k in ("bbox-crs", "filter-crs", "crs")}
        for k, code in codes.items():
            if code not in (84, *c.srids):
                raise ValueError(f"'{k}': {name} doesn't support this system")
        found: list[fl.Filter | None] = []
        if query.get("bbox") and c.geometry:
            found.append(params.bbox_filter(c.geometry, query["bbox"], codes["bbox-crs"]))
        if query.get("datetime"):
            found.append(params.datetime_filter([(c.prop(n), i) for n, i in c.times], query["datetime"]))
        later = []
        for key, param in c.params.items():
            if query.get(key):
                if isinstance(param, params.SameBbox):
                    later.append(param)
                else:
                    found.append(param(c, query[key]))
        if query.get("filter"):
            lowering = cql2.Lowering(c.queryable(), self.catalog.functions, codes["filter-crs"])
            found.append(lowering.filter(cql2.parse(query["filter"])))
        whole = fl.conjunction(*found)
        whole = fl.conjunction(whole, *(p(c, whole) for p in later))
        wanted = [p for p in c.properties if not p.hidden]
        if query.get("properties"):
            by_name = {p.name: p for p in wanted}
            wanted = [by_name[n] for n in query["properties"].split(",") if n in by_name]
        limit = params.limit(query.get("limit"), self.catalog.limit_default, self.catalog.limit_max)
        out = Request(c, whole, wanted, c.ordering if limit is not None else [], limit, crs=codes["crs"])
        if out.order and c.strategy != "offset" and c.id.name not in {p.name for p, _ in out.order}:
            out.order = [*out.order, (c.id, True)]  # so that no two rows have the same keys
        if query.get("next"):
            if c.strategy == "offset":
                out.offset = paging.read_cursor(query["next"], 1).offset
            else:
                out.cursor = paging.read_cursor(query["next"], len(out.order))
                out.offset = out.cursor.offset
        elif query.get("offset") and c.strategy != "cursor":
            out.offset = params.offset(query["offset"])
        return out

    # --- planning --------------------------------------------------------------------------------------

    def matched(self, r: Request) -> DataFrame:
        """The collection's rows that the filter lets through. A filter that nothing can meet reads nothing."""
        df = r.collection.frame(self.spark, r.tables)
        return df if isinstance(r.filter, fl.Pass) else df.filter(fl.to_column(r.filter, r.collection.fold))

    def columns(self, r: Request) -> list[Column]:
        c = r.collection
        out = [c.id.public.alias(c.id.name)]
        if c.geometry:
            out.append(geometry_column(c.geometry, r.crs).alias(c.geometry.name))
        shown = {c.id.name, c.geometry.name if c.geometry else ""}
        out += [geometry_column(p, r.crs).alias(p.name) if p.kind == "geometry" else p.public.alias(p.name) for p in r.properties if p.name not in shown]
        return out

    def plan(self, r: Request, look_ahead: bool = False) -> DataFrame:
        """Filter, order, page and select, in this order. look_ahead: one row more, and the keys as _key0, _key1, ..."""
        df, nulls = self.matched(r), r.collection.sql_nulls
        if r.cursor:
            df = df.filter(paging.from_cursor(r.order, r.cursor, nulls))
        if r.limit is not None:
            if r.order:
                df = df.orderBy(*paging.sort_columns(r.order, nulls))
            if r.offset:
                df = df.offset(r.offset)
            df = df.limit(r.limit + bool(look_ahead))
        keys = [p.stored.alias(f"_key{i}") for i, (p, _) in enumerate(r.order)] if look_ahead else []
        return df.select(*self.columns(r), *keys)

    def items(self, name: str, query: dict[str, str] | None = None) -> DataFrame:
        return self.plan(self.bind(name, query))

    def page(self, name: str, query: dict[str, str] | None = None) -> Page:
        """A page of at most `limit` rows, and where the next begins. limit=-1 is for items(), which doesn't collect."""
        key = (name, tuple(sorted((query or {}).items())))
        return self.cache.through(key, lambda: self._page(name, query))

    def _page(self, name: str, query: dict[str, str] | None) -> Page:
        r = self.bind(name, query)
        if r.limit is None:
            raise ValueError("a page needs a limit")
        rows = self.plan(r, look_ahead=True).collect()
        following = None
        if len(rows) > r.limit:
            if r.collection.strategy == "offset" or not r.order:
                following = paging.Cursor(("",), r.offset + r.limit)
            else:
                following = paging.Cursor(tuple(paging.as_text(rows[-1][f"_key{i}"]) for i in range(len(r.order))))
            rows = rows[: r.limit]
        shown = len(rows[0]) - len(r.order) if rows else 0
        named = [Row(**dict(list(x.asDict().items())[:shown])) for x in rows]
        return Page(named, following.wire() if following else None, len(named))

    def count(self, name: str, query: dict[str, str] | None = None) -> DataFrame:
        """numberMatched: rows that meet the filters, whatever the page."""
        return self.matched(self.bind(name, query)).agg(F.count("*").alias("number_matched"))

    def by_id(self, name: str, value: str, query: dict[str, str] | None = None) -> DataFrame:
        """The feature with an id; no rows if there is none."""
        r = self.bind(name, query)
        r.filter, r.order, r.limit = fl.equal(r.collection.id, value), [], 1
        return self.plan(r)

    def multi(self, names: list[str] | None = None, query: dict[str, str] | None = None) -> DataFrame:
        """Rows of several collections in order, up to one common limit.

        Columns: position of the collection, its name, rank in it, then the union of all columns. Each
        collection gives its own first rows; only these meet.
        """
        out = []
        limit = None
        names = names or list(self.catalog.collections)
        shown = str((query or {}).get("layernames") or ",".join(names)).split(",")
        if len(shown) != len(names):
            raise ValueError("'layernames' must name each collection")
        for i, name in enumerate(names):
            r = self.bind(name, query)
            limit = r.limit
            df = self.plan(r)
            head = [F.lit(i).alias("_collection"), F.lit(shown[i]).alias("collection")]
            if limit is not None:
                df = df.withColumn("_rank", F.monotonically_increasing_id())
            else:
                df = df.withColumn("_rank", F.lit(None).cast("long"))
            out.append(df.select(*head, *(F.col(f"`{c}`") for c in df.columns)))
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)
        if limit is not None:
            whole = whole.orderBy("_collection", "_rank").limit(limit)
        return whole.drop("_rank")

    def multi_page(self, names: list[str] | None = None, query: dict[str, str] | None = None) -> MultiPage:
        """A page over several collections, one after the other, and where the next page begins.

        A cursor in the query belongs to the first collection. At most limit + 1 rows of each are collected.
        """
        names, query = list(names or self.catalog.collections), dict(query or {})
        left, rows = self.bind(names[0], query).limit, []
        if left is None:
            raise ValueError("a page needs a limit")
        for i, name in enumerate(names):
            page = self.page(name, {**query, "limit": str(left)})
            query.pop("next", None)
            rows += [(name, r) for r in page.rows]
            left -= page.number_returned
            if page.next:
                return MultiPage(rows, names[i:], page.next)
            if not left:
                more = [n for n in names[i + 1 :] if self.page(n, {**query, "limit": "1"}).rows]
                return MultiPage(rows, names[names.index(more[0]) :] if more else [], None)
        return MultiPage(rows, [], None)

    def count_multi(self, names: list[str] | None = None, query: dict[str, str] | None = None) -> DataFrame:
        counts = [self.count(n, query) for n in names or list(self.catalog.collections)]
        return reduce(DataFrame.union, counts).agg(F.sum("number_matched").alias("number_matched"))

    def observed(self, name: str, query: dict[str, str] | None = None) -> tuple[DataFrame, Observation]:
        """items(), and an observation that has the number of rows once they have been used."""
        o = Observation(f"items-{name}")
        return self.items(name, query).observe(o, F.count(F.lit(1)).alias("number_returned")), o


def geometry_column(p: Property, target: int) -> Column:
    """A geometry in the system asked for: a struct of x and y for points in two columns, else WKB."""
    if p.xy:
        x, y = spatial.project_columns(p.x, p.y, p.srid, target)
        return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))
    return spatial.reproject_wkb(p.stored, p.srid, target)


@dataclass
class Cache:
    """Pages by request, the oldest of `size` first to go, each for some seconds.

    A page older than `refresh` seconds is still given, while it is made again in a thread.
    """

    size: int = 0
    seconds: float = 120
    refresh: float = 60
    held: OrderedDict[Any, tuple[float, Any]] = field(default_factory=OrderedDict)
    busy: dict[Any, threading.Thread] = field(default_factory=dict)

    def through(self, key, make):
        """What is held for the key, else what make() gives."""
        found = self.held.get(key)
        age = time.monotonic() - found[0] if found else 0
        if found and age <= self.seconds:
            if age > self.refresh and key not in self.busy:
                self.busy[key] = threading.Thread(target=self._again, args=(key, make), daemon=True)
                self.busy[key].start()
            return found[1]
        made = make()
        self.put(key, made)
        return made

    def _again(self, key, make) -> None:
        try:
            self.put(key, make())
        except Exception:  # the held page goes on until its time is over
            logging.getLogger(__name__).warning("a page was not made again", exc_info=True)
        finally:
            self.busy.pop(key, None)

    def put(self, key, value) -> None:
        if self.size:
            self.held.pop(key, None)
            self.held[key] = (time.monotonic(), value)
            while len(self.held) > self.size:
                self.held.popitem(last=False)
