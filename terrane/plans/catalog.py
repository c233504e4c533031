"""Collections and the catalog that holds them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import Functions
from ..operators.joins import Join, joined, needed, reachable
from ..sources.readers import Reader
from . import filters as fl
from .properties import Property, type_of

ID, GEOMETRY = "$id", ("$geometry", "$geom")


@dataclass
class Collection:
    """A table, or several joined ones, as features.

    order: (property, ascending) pairs; None: by id; empty: unordered. prune: join only the tables that a request
    uses; without it all reachable tables are joined, so that inner joins filter whatever is selected.
    """

    name: str
    table: str
    readers: dict[str, Reader]
    id: Property
    properties: list[Property]
    geometry: Property | None = None
    title: str = ""
    description: str = ""
    queryables: list[str] = field(default_factory=list)
    params: dict[str, Callable] = field(default_factory=dict)
    times: list[tuple[str, bool]] = field(default_factory=list)
    static_filter: fl.Filter = fl.PASS
    joins: list[Join] = field(default_factory=list)
    prune: bool = False
    order: list[tuple[str, bool]] | None = None
    strategy: str = "cursor"
    casei: str = "lower"
    srids: list[int] = field(default_factory=lambda: [84, 4326])
    spatial_extent: tuple[float, float, float, float] | None = None
    temporal_extent: tuple[str, str] | None = None
    write_nulls: bool = True
    sql_nulls: str = "postgres"

    def prop(self, name: str) -> Property:
        if name in (ID, self.id.name):
            return self.id
        if self.geometry and name in (*GEOMETRY, self.geometry.name):
            return self.geometry
        for p in self.properties:
            if p.name == name:
                return p
        raise ValueError(f"{self.name} has no property {name}")

    def queryable(self) -> dict[str, Property]:
        return {n: self.prop(n) for n in self.queryables}

    @property
    def ordering(self) -> list[tuple[Property, bool]]:
        order = [(self.id.name, True)] if self.order is None else self.order
        return [(self.prop(n), up) for n, up in order]

    @property
    def fold(self):
        return F.upper if self.casei == "upper" else F.lower

    def frame(self, spark: SparkSession, used: set[str] | None = None) -> DataFrame:
        """The joined tables, with the collection's own filter. used: tables that a request refers to."""
        tables = reachable(self.joins, self.table) if not self.prune or used is None else {self.table} | {t for t in used if t}
        joins = needed(self.joins, self.table, tables)
        names = {self.table} | {j.right for j in joins} | {j.bridge[0] for j in joins if j.bridge}
        frames = {n: self.readers[n](spark) for n in names}
        out = joined(frames, joins, self.table)
        return out if isinstance(self.static_filter, fl.Pass) else out.filter(fl.to_column(self.static_filter, self.fold))


@dataclass
class Catalog:
    collections: dict[str, Collection] = field(default_factory=dict)
    functions: Functions = field(default_factory=Functions)
    title: str = "Features"
    description: str = ""
    version: str = "0.1.0"
    limit_default: int = 1000
    limit_max: int = 10_000

    def add(self, *collections: Collection) -> Catalog:
        for c in collections:
            self.collections[c.name] = c
        return self

    def collection(self, name: str) -> Collection:
        if name not in self.collections:
            raise KeyError(f"no such collection: {name}")
        return self.collections[name]


def discover(spark: SparkSession, reader: Reader, without: tuple[str, ...] = ()) -> list[Property]:
    """A property for each column whose type has a name, but for those left out."""
    out = []
    for f in reader(spark).schema.fields:
        if f.name in without:
            continue
        kind = type_of(f.dataType)
        element = type_of(f.dataType.elementType) if kind == "array" else "string"
        out.append(Property(f.name, f.name, kind, nullable=f.nullable, element=element))
    return out


def static_filter(collection: Collection, config: dict[str, dict], name: str) -> fl.Filter:
    """A filter from configuration: {name: {type, prop, value}}; AND and OR list names as values. Enums don't bind it."""
    c = config[name]
    kind, value = c["type"].upper(), c.get("value", [])
    values = [value] if isinstance(value, str) else list(value)
    if kind in ("AND", "OR"):
        return (fl.conjunction if kind == "AND" else fl.disjunction)(*(static_filter(collection, config, v) for v in values))
    prop = collection.prop(c["prop"])
    prop = replace(prop, enum=None) if prop.enum else prop
    if kind in ("IS NULL", "IS NOT NULL"):
        return fl.IsNull(prop=prop, negated=kind == "IS NOT NULL")
    if not values:
        raise ValueError(f"{name}: a value is needed")
    if kind in ("=", "IN"):
        return fl.disjunction(*(fl.equal(prop, v) for v in values))
    if kind in ("!=", "<>", "NOT IN"):
        return fl.conjunction(*(fl.not_equal(prop, v) for v in values))
    if kind == "BETWEEN" and len(values) == 2:
        return fl.conjunction(fl.ordered(">=", prop, values[0]), fl.ordered("<=", prop, values[1]))
    if kind in ("<", "<=", ">", ">=") and len(values) == 1:
        return fl.ordered(kind, prop, values[0])
    raise ValueError(f"{name}: {kind} doesn't take {len(values)} values")
