"""The filter algebra: nodes that are folded while they are built, then turned into one Column.

The factories take a property and a literal's text. What the text means to the store decides: NULL, a value,
several values, or UNKNOWN, which nothing equals.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import spatial
from ..functions.geometry import Geometry
from ..functions.transformers import UNKNOWN, DayRange
from .properties import TYPES, Composite, Property, Static


@dataclass(frozen=True)
class Filter:
    tag: str = ""


@dataclass(frozen=True)
class Pass(Filter):
    pass


@dataclass(frozen=True)
class Deny(Filter):
    pass


@dataclass(frozen=True)
class Compare(Filter):
    op: str = "="
    prop: Property = None
    value: Any = None
    casei: bool = False


@dataclass(frozen=True)
class Like(Filter):
    """pattern: with % and _ as wildcards and a backslash to take them literally."""

    prop: Property = None
    pattern: str = ""
    casei: bool = False
    negated: bool = False


@dataclass(frozen=True)
class IsNull(Filter):
    """What a request calls null is the public value. stored: the column itself, for a literal that stands for a stored null."""

    prop: Property = None
    negated: bool = False
    stored: bool = False


@dataclass(frozen=True)
class Spatial(Filter):
    op: str = "INTERSECTS"
    prop: Property = None
    geometry: Geometry = None


@dataclass(frozen=True)
class Overlaps(Filter):
    prop: Property = None
    values: tuple = ()


@dataclass(frozen=True)
class Not(Filter):
    inner: Filter = None


@dataclass(frozen=True)
class And(Filter):
    of: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Or(Filter):
    of: tuple[Filter, ...] = ()


PASS, DENY = Pass(), Deny()
_SWAPPED = {"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
_INVERSE = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def conjunction(*filters: Filter | None) -> Filter:
    flat: list[Filter] = []
    for f in filters:
        if isinstance(f, Deny):
            return DENY
        if isinstance(f, And) and not f.tag:
            flat.extend(f.of)
        elif f is not None and not isinstance(f, Pass):
            flat.append(f)
    return PASS if not flat else flat[0] if len(flat) == 1 else And(of=tuple(flat))


def disjunction(*filters: Filter | None) -> Filter:
    flat: list[Filter] = []
    some = [f for f in filters if f is not None]
    for f in some:
        if isinstance(f, Pass):
            return PASS
        if isinstance(f, Or) and not f.tag:
            flat.extend(f.of)
        elif not isinstance(f, Deny):
            flat.append(f)
    return (DENY if some else PASS) if not flat else flat[0] if len(flat) == 1 else Or(of=tuple(flat))


def tagged(f: Filter, tag: str) -> Filter:
    return replace(f, tag=tag)


def find(f: Filter, tag: str) -> Filter | None:
    """The node with a tag, in an algebra of ands and ors."""
    if f.tag == tag:
        return f
    for x in getattr(f, "of", ()):
        if found := find(x, tag):
            return found
    return None


def properties_of(f: Filter | None) -> set[str]:
    """The names of all properties that a filter asks about."""
    if f is None:
        return set()
    own = {f.prop.name} if getattr(f, "prop", None) else set()
    inner = [*getattr(f, "of", ()), *([f.inner] if isinstance(f, Not) else [])]
    return own.union(*map(properties_of, inner)) if inner else own


def equal(prop: Property, text: str | None, casei: bool = False) -> Filter:
    if isinstance(prop, Composite):
        texts = prop.split(text)
        if len(texts) != len(prop.parts):
            return DENY
        return conjunction(*map(equal, prop.parts, texts))
    if isinstance(prop, Static):
        return PASS if prop.matches(text) else DENY
    return _equal_stored(prop, prop.to_inner(text), casei)


def _equal_stored(prop: Property, value: Any, casei: bool) -> Filter:
    if value is UNKNOWN:
        return DENY
    if value is None:
        return IsNull(prop=prop, stored=True)
    if isinstance(value, DayRange):
        return And(of=(Compare(op=">=", prop=prop, value=value[0]), Compare(op="<", prop=prop, value=value[1])))
    if isinstance(value, list):
        return disjunction(*(_equal_stored(prop, v, casei) for v in value))
    return Compare(op="=", prop=prop, value=value, casei=casei)


def not_equal(prop: Property, text: str | None, casei: bool = False) -> Filter:
    if isinstance(prop, (Composite, Static)):
        return negated(equal(prop, text))
    value = prop.to_inner(text)
    if value is UNKNOWN:
        return PASS
    if value is None:
        return IsNull(prop=prop, negated=True, stored=True)
    if isinstance(value, (DayRange, list)):
        return negated(_equal_stored(prop, value, casei))
    return Compare(op="<>", prop=prop, value=value, casei=casei)


def ordered(op: str, prop: Property, text: str | None) -> Filter:
    """<, <=, > or >=. Of several stored values the one that lets most through counts; a day is a range."""
    if isinstance(prop, Composite):
        raise ValueError(f"{prop.name} has no order")
    value = prop.to_inner(text)
    if value is None or value is UNKNOWN:
        return DENY
    if isinstance(value, DayRange):
        # before the day, up to its end, from its beginning, after it
        value, op = {"<": (value[0], "<"), "<=": (value[1], "<"), ">=": (value[0], ">="), ">": (value[1], ">=")}[op]
    elif isinstance(value, list):
        some = [v for v in value if v is not None]
        if not some:
            return DENY
        value = min(some) if op[0] == ">" else max(some)
    return Compare(op=op, prop=prop, value=value)


def compare(op: str, prop: Property, text: str | None, casei: bool = False) -> Filter:
    if op == "=":
        return equal(prop, text, casei)
    if op == "<>":
        return not_equal(prop, text, casei)
    return ordered(op, prop, text)


def sql_pattern(pattern: str, wild: str = "%", single: str = "_", escape: str = "\\") -> str:
    """A pattern with other wildcards as one with % and _; what these mean is escaped where they were text.

    An escape at the end, with nothing to escape, is dropped.
    """
    if len({wild, single, escape}) < 3:
        raise ValueError("wildcards and escape must differ")
    out, chars = [], iter(pattern)
    for c in chars:
        plain = c
        if c == escape:
            plain = next(chars, None)
            if plain is None:
                break
        elif c in (wild, single):
            out.append("%" if c == wild else "_")
            continue
        out.append("\\" + plain if plain in "%_\\" else plain)
    return "".join(out)


def like(prop: Property, pattern: str, casei: bool = False, wild: str = "%", single: str = "_", escape: str = "\\") -> Filter:
    if prop.public_kind != "string":
        raise ValueError(f"{prop.name} is no string")
    value = prop.to_inner(pattern) if prop.transformer else pattern
    if value is None or value is UNKNOWN:
        return DENY
    values = value if isinstance(value, list) else [value]
    return disjunction(*(Like(prop=prop, pattern=sql_pattern(v, wild, single, escape), casei=casei) for v in values if v is not None))


def is_null(prop: Property) -> Filter:
    return IsNull(prop=prop)


def spatially(op: str, prop: Property, geometry: Geometry) -> Filter:
    if prop.kind != "geometry":
        raise ValueError(f"{prop.name} is no geometry")
    return Spatial(op=op, prop=prop, geometry=geometry)


def array_overlaps(prop: Property, texts: list[str]) -> Filter:
    if prop.kind != "array":
        raise ValueError(f"{prop.name} is no array")
    values = [v for v in map(prop.to_inner, texts) if v is not UNKNOWN and v is not None]
    return Overlaps(prop=prop, values=tuple(values)) if values else DENY


def negated(f: Filter) -> Filter:
    """Not, pushed down to the leaves."""
    if isinstance(f, Pass):
        return DENY
    if isinstance(f, Deny):
        return PASS
    if isinstance(f, And):
        return disjunction(*map(negated, f.of))
    if isinstance(f, Or):
        return conjunction(*map(negated, f.of))
    if isinstance(f, Not):
        return f.inner
    if isinstance(f, Compare):
        return replace(f, op=_SWAPPED[f.op])
    if isinstance(f, (Like, IsNull)):
        return replace(f, negated=not f.negated)
    if isinstance(f, Spatial) and f.op in ("INTERSECTS", "DISJOINT"):
        return replace(f, op="DISJOINT" if f.op == "INTERSECTS" else "INTERSECTS")
    return Not(inner=f)


def inverse(f: Filter) -> Filter:
    """The same with sides changed: a < b as b > a, within as contains."""
    if isinstance(f, Compare):
        return replace(f, op=_INVERSE[f.op])
    if isinstance(f, Spatial):
        return replace(f, op={"WITHIN": "CONTAINS", "CONTAINS": "WITHIN"}.get(f.op, f.op))
    return f


def _value(v: Any, kind: str) -> Column:
    if isinstance(v, dt.datetime) and kind == "timestamp":
        return F.lit(v.replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz")
    if isinstance(v, dt.datetime):
        return F.lit(v.astimezone(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%fZ")).cast("timestamp")
    return F.lit(v).cast(TYPES[kind])


def to_column(f: Filter, fold=F.lower) -> Column:
    """The filter as one Column over the collection's tables. fold: what ignores case, lower or upper.

    Only stored columns and literals are compared, so that filters reach the scan.
    """
    if isinstance(f, (Pass, Deny)):
        return F.lit(isinstance(f, Pass))
    if isinstance(f, (And, Or)):
        columns = [to_column(x, fold) for x in f.of]
        return reduce(Column.__and__ if isinstance(f, And) else Column.__or__, columns)
    if isinstance(f, Not):
        return ~to_column(f.inner, fold)
    if isinstance(f, IsNull):
        value = f.prop.stored if f.stored else f.prop.public
        return value.isNotNull() if f.negated else value.isNull()
    if isinstance(f, Compare):
        a, b = f.prop.stored, _value(f.value, f.prop.kind)
        if f.casei and f.prop.kind == "string":
            a, b = fold(a), fold(b)
        return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[f.op]
    if isinstance(f, Like):
        a, b = f.prop.stored, F.lit(f.pattern)
        if f.casei:
            a, b = fold(a), fold(b)
        found = F.like(a, b)
        return ~found if f.negated else found
    if isinstance(f, Overlaps):
        shared = F.arrays_overlap(f.prop.stored, F.array(*(_value(v, f.prop.element) for v in f.values)))
        return F.when(f.prop.stored.isNull(), None).otherwise(F.coalesce(shared, F.lit(False)))
    if isinstance(f, Spatial):
        return spatial.predicate(f.op, f.prop, f.geometry)
    raise TypeError(f"no such filter: {f!r}")
