"""Request parameters, as functions from a value to filters, and mappers for parameters of single properties."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from ..functions import crs
from ..functions.geometry import Geometry, box, read_wkt
from . import filters as fl
from .cql2 import split_wrapped
from .properties import Property, parse_instant

BBOX_TAG, DATETIME_TAG = "bbox", "datetime"
Mapper = Callable[[Property, str], fl.Filter | None]
Param = Callable[[object, str], fl.Filter | None]


def limit(value: str | None, default: int, most: int) -> int | None:
    """None for no limit (-1), else a number from 1 to most."""
    if value is None or value == "":
        return default
    n = int(value)
    return None if n == -1 else max(1, min(n, most))


def offset(value: str | None) -> int:
    n = int(value or 0)
    if n < 0:
        raise ValueError("'offset' must not be negative")
    return n


def instants(value: str, name: str = "datetime") -> tuple[dt.datetime | None, dt.datetime | None] | None:
    """(from, to) of an instant or an interval with .. or nothing for an open end; None if both are open."""

    def one(text: str) -> dt.datetime | None:
        if text in ("", ".."):
            return None
        try:
            return parse_instant(text)
        except ValueError:
            raise ValueError(f"'{name}' value could not be parsed") from None

    if "/" in value:
        begin, end = map(one, value.split("/", 1))
    else:
        begin = end = one(value)
    return None if begin is None and end is None else (begin, end)


def _text(t: dt.datetime) -> str:
    return t.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def datetime_filter(times: list[tuple[Property, bool]], value: str) -> fl.Filter:
    """Rows of which any time property, inclusive of ends or not, lies in the interval."""
    found = instants(value) if value else None
    if found is None or not times:
        return fl.PASS
    begin, end = found
    out = []
    for prop, inclusive in times:
        low, high = (">=", "<=") if inclusive else (">", "<")
        if begin is not None and begin == end:
            if inclusive:
                out.append(fl.equal(prop, _text(begin)))
            continue
        ends = [fl.ordered(low, prop, _text(begin))] if begin else []
        ends += [fl.ordered(high, prop, _text(end))] if end else []
        out.append(fl.conjunction(*ends))
    return fl.tagged(fl.disjunction(*out), DATETIME_TAG) if out else fl.PASS


def bbox_geometry(value: str, code: int) -> Geometry:
    """Four or six numbers as a box in a system, with latitude first where that is its order, cut at its wrap line."""
    n = [float(x) for x in value.split(",")]
    if len(n) not in (4, 6):
        raise ValueError("'bbox' must have four or six numbers")
    x1, y1, x2, y2 = n[0], n[1], n[len(n) // 2], n[len(n) // 2 + 1]
    if crs.SRIDS[code].lat_lon:
        x1, y1, x2, y2 = y1, x1, y2, x2
    if x1 > x2 and not crs.SRIDS[code].wrap:
        raise ValueError("'bbox': the western edge is east of the eastern edge, and this system has no wrap line")
    return split_wrapped(box(x1, y1, x2, y2, code), code)


def merged(g: Geometry) -> Geometry:
    """Two boxes that share an edge as one: what a cut box may become in a system without a wrap line."""
    if g.kind != "MULTIPOLYGON" or len(g.coords) != 2:
        return g
    a, b = (Geometry("POLYGON", c, g.srid) for c in g.coords)
    ea, eb = a.envelope, b.envelope
    near = lambda p, q: abs(p - q) <= 1e-6 * max(1.0, abs(p))
    if near(ea[1], eb[1]) and near(ea[3], eb[3]) and (near(ea[2], eb[0]) or near(eb[2], ea[0])):
        return box(min(ea[0], eb[0]), ea[1], max(ea[2], eb[2]), ea[3], g.srid)
    return g


def bbox_filter(prop: Property, value: str, code: int) -> fl.Filter:
    g = crs.reproject(bbox_geometry(value, code), prop.srid)
    return fl.tagged(fl.spatially("INTERSECTS", prop, merged(g)), BBOX_TAG)


# --- mappers of one value ------------------------------------------------------------------------------


def equals(prop: Property, value: str) -> fl.Filter:
    return fl.equal(prop, value)


def differs(prop: Property, value: str) -> fl.Filter:
    return fl.not_equal(prop, value)


def like(casei: bool = False, wild: str = "*", single: str = "?", escape: str = "\\") -> Mapper:
    return lambda prop, value: fl.like(prop, value, casei, wild, single, escape)


def _range(prop: Property, begin: str | None, end: str | None, same: bool, low: bool, high: bool) -> fl.Filter:
    if same:
        return fl.equal(prop, begin)
    ends = [fl.ordered(">=" if low else ">", prop, begin)] if begin else []
    ends += [fl.ordered("<=" if high else "<", prop, end)] if end else []
    return fl.conjunction(*ends)


def datetime_range(low: bool = False, high: bool = False) -> Mapper:
    """null, an instant, or a range; low and high: whether its ends belong to it."""

    def run(prop: Property, value: str) -> fl.Filter | None:
        if value.lower() == "null":
            return fl.is_null(prop)
        found = instants(value, prop.name)
        if found is None:
            return None
        begin, end = found
        if begin and end and begin > end:
            raise ValueError(f"{prop.name}: the start must not be after the end")
        return _range(prop, begin and _text(begin), end and _text(end), begin == end, low, high)

    return run


def date_range(low: bool = False, high: bool = False) -> Mapper:
    """null, a date, or a range of dates."""

    def run(prop: Property, value: str) -> fl.Filter | None:
        if value.lower() == "null":
            return fl.is_null(prop)
        begin, end = value.split("/", 1) if "/" in value else (value, value)
        days = [None if x in ("", "..") else dt.date.fromisoformat(x) for x in (begin, end)]
        if days == [None, None]:
            return None
        if None not in days and days[0] > days[1]:
            raise ValueError(f"{prop.name}: the start must not be after the end")
        return _range(prop, days[0] and days[0].isoformat(), days[1] and days[1].isoformat(), days[0] == days[1], low, high)

    return run


def building_function(prop: Property, value: str) -> fl.Filter:
    """A building class or number; wildcards in the value match nothing."""
    return fl.DENY if set(value) & set("%_*?") else fl.like(prop, value)


# --- parameters ---------------------------------------------------------------------------------------


def values(name: str, mapper: Mapper = equals) -> Param:
    """Comma-separated values of a property, any of which may hold; all of an enumeration are no condition."""

    def run(collection, value: str) -> fl.Filter | None:
        prop = collection.prop(name)
        given = value.split(",")
        if prop.enum and {str(v) for v in prop.enum} <= set(given):
            return None
        return fl.disjunction(*(mapper(prop, v) for v in given))

    return run


def valid_at(start: str, end: str | None = None) -> Param:
    """Rows valid at an instant: started by then, and not ended before or then. Without an end: started just then."""

    def run(collection, value: str) -> fl.Filter:
        at = _text(parse_instant(value))
        begin = collection.prop(start)
        if end is None:
            return fl.equal(begin, at)
        last = collection.prop(end)
        return fl.conjunction(
            fl.IsNull(prop=begin, negated=True), fl.ordered("<=", begin, at), fl.disjunction(fl.is_null(last), fl.ordered(">", last, at))
        )

    return run


def shares_element(name: str) -> Param:
    return lambda collection, value: fl.array_overlaps(collection.prop(name), value.split(","))


def meets_wkt(name: str) -> Param:
    """WKT or EWKT, in CRS84 unless it says otherwise."""

    def run(collection, value: str) -> fl.Filter:
        prop = collection.prop(name)
        return fl.spatially("INTERSECTS", prop, crs.reproject(read_wkt(value), prop.srid))

    return run


@dataclass(frozen=True)
class SameBbox:
    """The request's bbox, on the envelope of another geometry too. It needs the filter so far, not a value."""

    name: str

    def __call__(self, collection, so_far: fl.Filter) -> fl.Filter | None:
        box_filter = fl.find(so_far, BBOX_TAG)
        if not box_filter:
            return None
        prop = collection.prop(self.name)
        return fl.Spatial(op="INTERSECTS_INDEX", prop=prop, geometry=crs.reproject(box_filter.geometry, prop.srid))
