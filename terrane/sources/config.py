"""A catalog from a configuration in key=value lines."""

from __future__ import annotations

import importlib
import os
import re
from dataclasses import replace

from pyspark.sql import SparkSession

from ..functions import transformers
from ..functions.crs import SRIDS, Srid, register
from ..operators.joins import MANY_TO_MANY, MANY_TO_ONE, ONE_TO_MANY, ONE_TO_ONE, Join
from ..plans import params
from ..plans.catalog import Catalog, Collection, discover, static_filter
from ..plans.filters import conjunction
from ..plans.properties import Composite, Property, static, type_of, with_schema
from .readers import Reader, memory, parquet


def read(text: str) -> dict[str, str]:
    """key=value or key:value lines; # and ! start comments, a backslash at the end goes on in the next line.

    ${X} stands for an environment variable, and stays if there is none.
    """
    out: dict[str, str] = {}
    for line in re.sub(r"\\\r?\n\s*", "", text).splitlines():
        line = line.strip()
        if line and line[0] not in "#!" and (m := re.match(r"([^=:\s]+)\s*[=:]?\s*(.*)", line)):
            out[m[1]] = re.sub(r"\$\{([^}]+)\}", lambda x: os.environ.get(x[1], x[0]), m[2])
    return out


def _list(value: str) -> list[str]:
    return [x.strip() for x in value.split(",") if x.strip()]


_KINDS = {"OneToOne": ONE_TO_ONE, "OneToMany": ONE_TO_MANY, "ManyToOne": MANY_TO_ONE, "ManyToMany": MANY_TO_MANY}
_MAPPERS = {
    "equal": lambda arg: params.equals,
    "notEqual": lambda arg: params.differs,
    "like": lambda arg: params.like(arg.lower() == "casei"),
    "datetimeRange": lambda arg: params.datetime_range(*_ends(arg)),
    "dateRange": lambda arg: params.date_range(*_ends(arg)),
    "building": lambda arg: params.building_function,
}


def _ends(arg: str) -> tuple[bool, bool]:
    """gte,lte or 0 to 3: whether a range has its ends; none by default."""
    if arg.isdigit():
        return bool(int(arg) & 1), bool(int(arg) & 2)
    words = {w.upper() for w in _list(arg)}
    if words - {"GT", "GTE", "LT", "LTE"}:
        raise ValueError(f"not ends of a range: {arg!r}")
    return "GTE" in words, "LTE" in words


class Loader:
    """Builds the catalog. readers: named tables that configurations refer to, beside Parquet below `base`."""

    def __init__(self, spark: SparkSession, config: dict[str, str], base: str = "", readers: dict[str, Reader] | None = None, schema: dict | None = None):
        self.spark, self.config, self.base, self.readers, self.schema = spark, config, base, readers or {}, schema or {}
        self.types: dict[str, dict] = {}

    def reader(self, table: str) -> Reader:
        return self.readers.get(table) or parquet(f"{self.base}/{table}.parquet")

    def type_of(self, table: str, column: str) -> tuple[str, bool, str]:
        """(type, nullable, element type) of a column or SQL expression, from the table's schema."""
        frame = self.reader(table)(self.spark)
        field = frame.selectExpr(f"{column} AS c" if "(" in column else f"`{column}` AS c").schema["c"]
        kind = type_of(field.dataType)
        return kind, field.nullable, type_of(field.dataType.elementType) if kind == "array" else "string"

    def catalog(self) -> Catalog:
        c = self.config
        for code in map(int, _list(c.get("srid", ""))):
            known = SRIDS.get(code, Srid(code))
            flag = lambda k, d, code=code: c[f"srid.{code}.{k}"].lower() == "true" if f"srid.{code}.{k}" in c else d
            wrap = tuple(float(c[f"srid.{code}.{k}"]) for k in ("wrapXMin", "wrapXMax") if f"srid.{code}.{k}" in c)
            if len(wrap) == 1:
                raise ValueError(f"srid {code}: both wrap bounds or none are needed")
            if f"srid.{code}.proj4" in c:
                known = register(code, c[f"srid.{code}.proj4"])
            SRIDS[code] = replace(known, lat_lon=flag("latLon", known.lat_lon), degrees=flag("degrees", known.degrees), wrap=wrap or known.wrap)
        out = Catalog(
            title=c.get("api.title", "Features"),
            description=c.get("api.description", ""),
            version=c.get("api.version", "0.1.0"),
            limit_default=int(c.get("getfeatures.limit.default", 1000)),
            limit_max=int(c.get("getfeatures.limit.max", 10_000)),
        )
        for name in _list(c.get("functions", "")):
            module, _, attribute = name.rpartition(".")
            out.functions.register(getattr(importlib.import_module(module), attribute))
        return out.add(*map(self.collection, _list(c["collections"])))

    def collection(self, name: str) -> Collection:
        p = f"collections.{name}."
        own = {k[len(p) :]: v for k, v in self.config.items() if k.startswith(p)}
        table = own.get("table", name)
        joins = self.joins(own, table)
        if "id.mapping" not in own:
            raise ValueError(f"{name}: id.mapping is needed")
        names = _list(own.get("properties", "*"))
        in_memory = own.get("type") == "test"
        rows = [own[k] for k in sorted((k for k in own if k.startswith("testdata.")), key=lambda k: int(k[9:]))]
        if in_memory:
            props = [Property(n, own.get(f"properties.{n}.mapping", n), "string", table) for n in names]
            key = Property(own["id.mapping"], own["id.mapping"], "string", table)
            shape = Property(own["geometry.mapping"], own["geometry.mapping"], "geometry", table) if "geometry.mapping" in own else None
            self.readers[table] = memory([key, *([shape] if shape else []), *props], rows)
        else:
            key = replace(self.property("id", own, "id", table), hidden=False)
            key = replace(key, name=own.get("id.alias", own["id.mapping"].replace(",", "_")))
            shape = self.geometry(own, table)
            if names == ["*"] or any(n.startswith("~") for n in names):
                skip = {key.column, *((shape.column, *(shape.xy or ())) if shape else ()), *(n[1:] for n in names if n[0] == "~")}
                props = [replace(x, table=table) for x in discover(self.spark, self.reader(table), tuple(skip))]
            else:
                props = [self.property(n, own, f"properties.{n}", table) for n in names]
        if shape and own.get("geometry.type"):
            shape = replace(shape, geometry_type=own["geometry.type"].upper())
        props = [self.enumerated(x, own) for x in props]
        described = self.schema.get(name, {}).get("properties", {})
        props = [with_schema(x, described[x.name]) if x.name in described else x for x in props]
        extent = own.get("extent.spatial.crs84") or own.get("extent.spatial")
        out = Collection(
            name=name,
            table=table,
            readers={t: self.reader(t) for t in {table} | {t for j in joins for t in (j.left, j.right, *(j.bridge[:1] if j.bridge else ()))}},
            id=key,
            properties=props,
            geometry=shape,
            title=own.get("title", name),
            description=own.get("description", ""),
            joins=joins,
            casei=own.get("casei", "lower"),
            strategy=own.get("pagination.strategy", "cursor"),
            write_nulls=own.get("writeNulls", "true").lower() == "true",
            srids=[84, 4326, *(int(x) for x in _list(own.get("srid", "")) if int(x) not in (84, 4326))],
            spatial_extent=tuple(map(float, extent.split(","))) if extent else None,
            temporal_extent=tuple(own["extent.temporal"].split("/")) if "extent.temporal" in own else None,
        )
        exclusive = own.get("time.exclusive", "false").lower() == "true"
        out.times = [(n, not exclusive) for n in _list(own.get("time", ""))]
        keys = _list(own.get("pagination", ""))
        ups = [x.strip().upper() != "DESC" for x in own.get("pagination.order", "").split(",")] if "pagination.order" in own else []
        if own.get("pagination.unordered", "false").lower() == "true":
            out.order = []
        elif keys:
            out.order = [(k, ups[i] if i < len(ups) else True) for i, k in enumerate(keys)]
        for n in _list(own.get("parameters", "")):
            prop = own.get(f"parameters.{n}.prop", n)
            out.queryables.append(prop)
            mapper = _MAPPERS[own.get(f"parameters.{n}.mapper", "equal")](own.get(f"parameters.{n}.mapper.arg", ""))
            out.params[n] = params.values(prop, mapper)
        filters = {n: {"type": own[f"filters.{n}.type"], "prop": own.get(f"filters.{n}.prop", ""), "value": _list(own.get(f"filters.{n}.value", ""))} for n in {k.split(".")[1] for k in own if k.startswith("filters.")}}
        named = _list(own.get("filters", ""))
        if named:
            out.static_filter = conjunction(*(static_filter(out, filters, n) for n in named))
        return out

    def property(self, name: str, own: dict[str, str], at: str, table: str) -> Property:
        mapping = own.get(f"{at}.mapping", name)
        if mapping[:1] == "'" and mapping[-1:] == "'":
            return static(name, mapping)
        change, arg = own.get(f"{at}.transformer"), own.get(f"{at}.transformer.arg", "")
        columns = [mapping] if "(" in mapping else _list(mapping)
        if len(columns) > 1:
            each = [self.property(c.strip("'"), {f"{at}.mapping": c}, at, table) for c in columns]
            return Composite(name, kind="string", table=table, parts=tuple(each), joiner=transformers.Joiner("string", arg or "-"))
        column, of = columns[0], table
        if "(" not in column and "." in column:
            of, column = column.rsplit(".", 1)
        kind, nullable, element = self.type_of(of, column)
        made = transformers.make(change, kind, arg) if change else None
        return Property(name, column, kind, "" if "(" in column else of, nullable, element=element, transformer=made)

    def geometry(self, own: dict[str, str], table: str) -> Property | None:
        mapping = own.get("geometry.mapping")
        if not mapping:
            return None
        code = int(own.get("geometry.srid", 84))
        name = own.get("geometry.alias", "geometry")
        columns = _list(mapping)
        if len(columns) == 2:
            return Property(name, "", "geometry", table, xy=(columns[0], columns[1]), srid=code, geometry_type="POINT")
        return Property(own.get("geometry.alias", mapping), mapping, "geometry", table, srid=code)

    def enumerated(self, p: Property, own: dict[str, str]) -> Property:
        values = own.get(f"properties.{p.name}.enum")
        return replace(p, enum=tuple(_list(values))) if values else p

    def joins(self, own: dict[str, str], table: str) -> list[Join]:
        out = []
        for n in _list(own.get("joins", "")):
            at = f"joins.{n}."
            kind = own.get(at + "type", "OneToOne")
            left, left_column = own[at + "left"].rsplit(".", 1)
            right, right_column = own[at + "right"].rsplit(".", 1)
            bridge = tuple(_list(own[at + "bridge"])) if at + "bridge" in own else None
            out.append(Join(left, left_column, right, right_column, _KINDS[kind], bridge))
        return out


def load(spark: SparkSession, text: str, base: str = "", readers: dict[str, Reader] | None = None, schema: dict | None = None) -> Catalog:
    return Loader(spark, read(text), base, readers, schema).catalog()


def check(spark: SparkSession, text: str, **options) -> list[str]:
    """What is wrong with a configuration, collection by collection; nothing if it can be loaded."""
    config, found = read(text), []
    for name in _list(config.get("collections", "")):
        try:
            Loader(spark, config, **options).collection(name)
        except Exception as e:  # noqa: BLE001  each message is the result
            found.append(f"{name}: {e}")
    return found or ([] if config.get("collections") else ["no collections"])
