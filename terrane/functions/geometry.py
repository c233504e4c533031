"""Geometries on the driver and in Arrow functions: WKT, WKB, envelopes, topological relations, buffers.

A geometry is a kind and nested coordinate tuples. Relations come from one construction: the segments of
both geometries are cut at their common points; the cut points, the middles of the pieces and, next to
these, points to the left and right are located in both geometries. Each location gives one cell of the
nine-intersection matrix and a lower bound for its dimension; together they give the matrix.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass, field, replace
from itertools import repeat

KINDS = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION")
SPATIAL_OPERATORS = ("INTERSECTS", "EQUALS", "DISJOINT", "TOUCHES", "WITHIN", "OVERLAPS", "CROSSES", "CONTAINS")


@dataclass(frozen=True)
class Geometry:
    """coords: a position, a list of positions, rings and so on by kind; a collection has geometries.

    united: the parts of a MULTIPOLYGON may overlap and stand for their union (as buffers do).
    about: of the circle around a point, (centre, vertices as seen from it), since coords round the vertices to the centre's
    size; of a MULTIPOLYGON, one such pair or None for each part. It is lost where positions are moved.
    """

    kind: str
    coords: tuple
    srid: int = 84
    united: bool = False
    about: tuple | None = field(default=None, compare=False)

    @property
    def dimension(self) -> int:
        return max((_DIMENSION[g.kind] for g in parts(self)), default=-1)

    def positions(self):
        for g in parts(self):
            if g.kind == "POINT":
                yield g.coords
            elif g.kind == "LINESTRING":
                yield from g.coords
            else:
                for ring in g.coords:
                    yield from ring

    @property
    def envelope(self) -> tuple[float, float, float, float] | None:
        xs, ys = [], []
        for p in self.positions():
            xs.append(p[0])
            ys.append(p[1])
        return (min(xs), min(ys), max(xs), max(ys)) if xs else None

    def mapped(self, f) -> Geometry:
        """With each position put through f(x, y); further ordinates stay."""

        def walk(c, depth):
            return (*f(c[0], c[1]), *c[2:]) if depth == 0 else tuple(walk(x, depth - 1) for x in c)

        if self.kind == "GEOMETRYCOLLECTION":
            return replace(self, coords=tuple(g.mapped(f) for g in self.coords), about=None)
        return replace(self, coords=walk(self.coords, _DEPTH[self.kind]), about=None)


_DIMENSION = {"POINT": 0, "LINESTRING": 1, "POLYGON": 2}
_DEPTH = {"POINT": 0, "LINESTRING": 1, "POLYGON": 2, "MULTIPOINT": 1, "MULTILINESTRING": 2, "MULTIPOLYGON": 3}


def point(x: float, y: float, srid: int = 84) -> Geometry:
    return Geometry("POINT", (x, y), srid)


def box(x1: float, y1: float, x2: float, y2: float, srid: int = 84) -> Geometry:
    return Geometry("POLYGON", (((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)),), srid)


def parts(g: Geometry) -> list[Geometry]:
    """Points, lines and polygons that make up a geometry."""
    if g.kind in _DIMENSION:
        return [g] if g.coords else []
    if g.kind == "GEOMETRYCOLLECTION":
        return [p for x in g.coords for p in parts(x)]
    return [Geometry(g.kind[5:], c, g.srid, about=a) for c, a in zip(g.coords, g.about or repeat(None), strict=False)]


# --- text ---------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


def read_wkt(text: str, srid: int = 84) -> Geometry:
    """WKT or EWKT (SRID=n;...). Rings that aren't closed are closed. Raises ValueError for anything else."""
    if m := re.match(r"\s*SRID=(\d+);", text, re.IGNORECASE):
        srid, text = int(m[1]), text[m.end() :]
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not WKT at {text[at : at + 20]!r}")
        tokens.append(m[1])
        at = m.end()
    g, rest = wkt_tokens(tokens, srid)
    if rest:
        raise ValueError("text behind the geometry")
    return g


def wkt_tokens(tokens: list[str], srid: int) -> tuple[Geometry, list[str]]:
    """A geometry from the head of a token list, and the tokens left."""
    tokens = list(tokens)

    def take(expected: str | None = None) -> str:
        if not tokens or expected is not None and tokens[0] != expected:
            raise ValueError(f"expected {expected or 'more'} before {tokens[:1]}")
        return tokens.pop(0)

    def listed(read) -> tuple:
        if tokens and tokens[0].upper() == "EMPTY":
            tokens.pop(0)
            return ()
        take("(")
        out = [read()]
        while take_comma():
            out.append(read())
        take(")")
        return tuple(out)

    def take_comma() -> bool:
        if tokens and tokens[0] == ",":
            tokens.pop(0)
            return True
        return False

    def position() -> tuple[float, ...]:
        out = []
        while tokens and tokens[0] not in "(),":
            out.append(float(take()))
        if not 2 <= len(out) <= 4:
            raise ValueError("a position needs two to four numbers")
        return tuple(out)

    def ring() -> tuple:
        c = listed(position)
        c = c if c and c[0] == c[-1] else (*c, *c[:1])
        if len(c) < 4:
            raise ValueError("a ring needs four positions")
        return c

    def in_multipoint():
        return listed(position)[0] if tokens and tokens[0] == "(" else position()

    def geometry() -> Geometry:
        kind = take().upper()
        if kind not in KINDS:
            raise ValueError(f"no such geometry: {kind}")
        if tokens and tokens[0].upper() in ("Z", "M", "ZM"):
            tokens.pop(0)
        if kind == "POINT":
            got = listed(position)
            if len(got) > 1:
                raise ValueError("a point has one position")
            return Geometry(kind, got[0] if got else (), srid)
        read = {
            "LINESTRING": position,
            "POLYGON": ring,
            "MULTIPOINT": in_multipoint,
            "MULTILINESTRING": lambda: listed(position),
            "MULTIPOLYGON": lambda: listed(ring),
            "GEOMETRYCOLLECTION": geometry,
        }[kind]
        coords = listed(read)
        if kind == "LINESTRING" and len(coords) == 1:
            raise ValueError("a line needs two positions")
        return Geometry(kind, coords, srid)

    return geometry(), tokens


def plain(v: float) -> str:
    """Without exponent and needless zeros."""
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(float(v))


def write_wkt(g: Geometry, number=plain) -> str:
    def walk(c, depth):
        if depth == 0:
            return " ".join(map(number, c))
        return "(" + ", ".join(walk(x, depth - 1) for x in c) + ")"

    if not g.coords:
        return f"{g.kind} EMPTY"
    if g.kind == "GEOMETRYCOLLECTION":
        return f"{g.kind} ({', '.join(write_wkt(x, number) for x in g.coords)})"
    if g.kind == "POINT":
        return f"POINT ({walk(g.coords, 0)})"
    if g.kind == "MULTIPOINT":
        return "MULTIPOINT (" + ", ".join(f"({walk(c, 0)})" for c in g.coords) + ")"
    return f"{g.kind} {walk(g.coords, _DEPTH[g.kind])}"


# --- binary -------------------------------------------------------------------------------------------


def write_wkb(g: Geometry) -> bytes:
    """Little-endian ISO WKB; Z and ZM by the number of ordinates."""
    n = len(next(iter(g.positions()), (0, 0)))
    more = {2: 0, 3: 1000, 4: 3000}[n]

    def positions(c):
        return struct.pack("<I", len(c)) + b"".join(struct.pack(f"<{n}d", *p) for p in c)

    def walk(kind, c):
        head = struct.pack("<BI", 1, KINDS.index(kind) + 1 + more)
        if kind == "POINT":
            return head + struct.pack(f"<{n}d", *(c or (math.nan,) * n))
        if kind == "LINESTRING":
            return head + positions(c)
        if kind == "POLYGON":
            return head + struct.pack("<I", len(c)) + b"".join(map(positions, c))
        if kind == "GEOMETRYCOLLECTION":
            return head + struct.pack("<I", len(c)) + b"".join(walk(x.kind, x.coords) for x in c)
        return head + struct.pack("<I", len(c)) + b"".join(walk(kind[5:], x) for x in c)

    return walk(g.kind, g.coords)


def read_wkb(data: bytes, srid: int = 84) -> Geometry:
    """WKB (ISO or EWKB, either byte order) or a GeoPackage blob."""
    at = 0
    if data[:2] == b"GP":
        order = "<" if data[3] & 1 else ">"
        srid = struct.unpack_from(order + "i", data, 4)[0]
        at = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[data[3] >> 1 & 7]

    def read() -> Geometry:
        nonlocal at, srid
        order = "<" if data[at] else ">"
        code = struct.unpack_from(order + "I", data, at + 1)[0]
        at += 5
        if code & 0x20000000:
            srid = struct.unpack_from(order + "I", data, at)[0]
            at += 4
        n = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        code &= 0xFFFFFFF
        n += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
        kind = KINDS[code % 1000 - 1]

        def count() -> int:
            nonlocal at
            at += 4
            return struct.unpack_from(order + "I", data, at - 4)[0]

        def position() -> tuple[float, ...]:
            nonlocal at
            at += 8 * n
            return struct.unpack_from(f"{order}{n}d", data, at - 8 * n)

        def positions() -> tuple:
            return tuple(position() for _ in range(count()))

        if kind == "POINT":
            c = position()
            return Geometry(kind, () if math.isnan(c[0]) else c, srid)
        if kind == "LINESTRING":
            return Geometry(kind, positions(), srid)
        if kind == "POLYGON":
            return Geometry(kind, tuple(positions() for _ in range(count())), srid)
        inner = tuple(read() for _ in range(count()))
        return Geometry(kind, inner if kind == "GEOMETRYCOLLECTION" else tuple(g.coords for g in inner), srid)

    return read()


def write_gpkg(g: Geometry, srid: int) -> bytes:
    """A GeoPackage blob with an XY envelope; empty geometries have the flag and no envelope."""
    e = g.envelope
    flags = 1 | (2 if e else 16)
    head = b"GP" + bytes([0, flags]) + struct.pack("<i", srid)
    return head + (struct.pack("<4d", e[0], e[2], e[1], e[3]) if e else b"") + write_wkb(g)


# --- relations ----------------------------------------------------------------------------------------


def _on_segment(p, a, b) -> bool:
    cross = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    reach = max(abs(b[0] - a[0]), abs(b[1] - a[1]), 1e-300)
    if abs(cross) > 1e-12 * reach * max(reach, abs(p[0]), abs(p[1]), 1e-300):
        return False
    slack = 1e-12 * max(abs(p[0]), abs(p[1]), reach)
    return (
        min(a[0], b[0]) - slack <= p[0] <= max(a[0], b[0]) + slack and min(a[1], b[1]) - slack <= p[1] <= max(a[1], b[1]) + slack
    )


def _in_polygon(p, rings) -> str:
    inside = False
    for ring in rings:
        for a, b in zip(ring, ring[1:], strict=False):
            if _on_segment(p, a, b):
                return "B"
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
                inside = not inside
    return "I" if inside else "E"


def locate(p, g: Geometry) -> str:
    """I, B or E: where p is in g. A line's ends are boundary if an odd number of lines end there."""
    found, ends = "E", 0
    for part in parts(g):
        if part.kind == "POINT":
            if part.coords[0] == p[0] and part.coords[1] == p[1]:
                return "I"
        elif part.kind == "LINESTRING":
            c = part.coords
            if any(_on_segment(p, a, b) for a, b in zip(c, c[1:], strict=False)):
                closed = c[0][:2] == c[-1][:2]
                at_end = not closed and sum(_on_segment(p, e, e) for e in (c[0], c[-1]))
                if not at_end:
                    return "I"
                ends += at_end
        else:
            where = _in_polygon(p, part.coords)
            if where == "I":
                return "I"
            found = "B" if where == "B" else found
    if ends:
        return "B" if ends % 2 else "I"
    return found


def _segments(g: Geometry):
    for part in parts(g):
        lines = [part.coords] if part.kind == "LINESTRING" else part.coords if part.kind == "POLYGON" else []
        for c in lines:
            for a, b in zip(c, c[1:], strict=False):
                if a[:2] != b[:2]:
                    yield a[:2], b[:2]


def _cuts(a, b, others) -> list[tuple[float, float]]:
    """Points of the segment a-b where other segments or points meet it."""
    out = []
    for c, d in others:
        if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]):
            continue
        if max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
            continue
        out.extend(p for p in (c, d) if _on_segment(p, a, b))
        w = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
        if w:
            t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / w
            u = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / w
            if 0 < t < 1 and 0 <= u <= 1:
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    return out


def relate(a: Geometry, b: Geometry) -> dict[str, int]:
    """Cells such as "IB" (interior of a, boundary of b) that aren't empty, with their dimension."""
    matrix: dict[str, int] = {}

    def see(p, dimension: int) -> None:
        cell = locate(p, a) + locate(p, b)
        matrix[cell] = max(matrix.get(cell, -1), dimension)

    segments = [*_segments(a), *_segments(b)]
    single = [(p.coords[:2], p.coords[:2]) for g in (a, b) for p in parts(g) if p.kind == "POINT"]
    for p, _ in single:
        see(p, 0)
    areas = 2 in (a.dimension, b.dimension)
    for p, q in segments:
        length = math.hypot(q[0] - p[0], q[1] - p[1])
        cuts = sorted({p, q, *_cuts(p, q, [s for s in segments + single if s != (p, q)])}, key=lambda c: math.hypot(c[0] - p[0], c[1] - p[1]))
        for c in cuts:
            see(c, 0)
        for c, d in zip(cuts, cuts[1:], strict=False):
            m = ((c[0] + d[0]) / 2, (c[1] + d[1]) / 2)
            see(m, 1)
            if areas:
                away = 1e-6 * math.hypot(d[0] - c[0], d[1] - c[1]) / length
                for side in (away, -away):
                    see((m[0] - side * (q[1] - p[1]), m[1] + side * (q[0] - p[0])), 2)
    return matrix


def holds(operator: str, a: Geometry, b: Geometry) -> bool:
    """Whether a stands to b as the operator says."""
    ea, eb = a.envelope, b.envelope
    if ea is None or eb is None:
        return operator == "DISJOINT" or operator == "EQUALS" and ea is None and eb is None
    apart = ea[2] < eb[0] or eb[2] < ea[0] or ea[3] < eb[1] or eb[3] < ea[1]
    if apart:
        return operator == "DISJOINT"
    m = relate(a, b)
    meet = any(c in m for c in ("II", "IB", "BI", "BB"))
    da, db = a.dimension, b.dimension
    if operator == "INTERSECTS":
        return meet
    if operator == "DISJOINT":
        return not meet
    if operator == "TOUCHES":
        return meet and "II" not in m
    if operator == "WITHIN":
        return "II" in m and "IE" not in m and "BE" not in m
    if operator == "CONTAINS":
        return "II" in m and "EI" not in m and "EB" not in m
    if operator == "EQUALS":
        return "II" in m and not {"IE", "BE", "EI", "EB"} & m.keys()
    if operator == "CROSSES":
        if da == db:
            return da == 1 and m.get("II") == 0
        return "II" in m and ("IE" in m if da < db else "EI" in m)
    if operator == "OVERLAPS":
        return da == db and "IE" in m and "EI" in m and ("II" in m if da != 1 else m.get("II") == 1)
    raise ValueError(f"no such spatial operator: {operator}")


# --- buffers ------------------------------------------------------------------------------------------


def _around(p, radius: float, quarter: int, first: float = 0.0, count: int | None = None):
    count = 4 * quarter if count is None else count
    step = math.pi / 2 / quarter
    return [(p[0] + radius * math.cos(first - i * step), p[1] + radius * math.sin(first - i * step)) for i in range(count + 1)]


#: How many radii the tip of a mitred join may be away from its vertex; a longer one is cut off.
MITRE_LIMIT = 5.0


def _join(p, q, r, radius: float, quarter: int, style: str) -> list:
    """The polygon that fills the outer side of the turn at q, if there is one."""
    one, two = (math.atan2(b[1] - a[1], b[0] - a[0]) for a, b in ((p, q), (q, r)))
    turn = math.sin(two - one)
    if style == "round":
        return _around(q, radius, quarter)
    side = -math.pi / 2 if turn > 0 else math.pi / 2
    (x1, y1), (x2, y2) = ((math.cos(t + side), math.sin(t + side)) for t in (one, two))
    along = 1 + x1 * x2 + y1 * y2  # twice the square of the cosine of half the turn
    ring = [(q[0], q[1]), (q[0] + radius * x1, q[1] + radius * y1)]
    if style == "mitre" and along * MITRE_LIMIT**2 >= 2:
        ring.append((q[0] + radius * (x1 + x2) / along, q[1] + radius * (y1 + y2) / along))
    ring.append((q[0] + radius * x2, q[1] + radius * y2))
    return ring if abs(turn) > 1e-12 else []


def _strip(a, b, radius: float, before: float, behind: float) -> list:
    """A rectangle around a segment, longer at its ends by so much."""
    t = math.atan2(b[1] - a[1], b[0] - a[0])
    (ax, ay), (nx, ny) = (math.cos(t), math.sin(t)), (-radius * math.sin(t), radius * math.cos(t))
    a, b = (a[0] - before * ax, a[1] - before * ay), (b[0] + behind * ax, b[1] + behind * ay)
    return [(a[0] + nx, a[1] + ny), (b[0] + nx, b[1] + ny), (b[0] - nx, b[1] - ny), (a[0] - nx, a[1] - ny)]


def buffer(g: Geometry, radius: float, quarter: int = 8, join: str = "round", cap: str = "round") -> Geometry:
    """All within radius: a polygon for a point, else a union of a polygon for each segment, join and end and the areas.

    quarter: segments in a quarter of a circle. join: round, mitre or bevel; cap (ends of lines, and points): round,
    square or flat. A negative radius shrinks, which is not supported: ValueError.
    """
    if radius < 0 or quarter < 1:
        raise ValueError("a buffer needs a radius of 0 or more and a segment for a quarter of a circle")
    if join not in ("round", "mitre", "bevel") or cap not in ("round", "square", "flat"):
        raise ValueError(f"not a join and end of buffers: {join}, {cap}")
    if radius == 0:
        return g
    out, about = [], {}

    def add(ring: list) -> None:
        if ring:
            out.append(((*ring, ring[0]),) if ring[0] != ring[-1] else (tuple(ring),))

    for part in parts(g):
        if part.kind == "POINT":
            x, y = part.coords[:2]
            if cap == "round":
                about[len(out)] = ((x, y), tuple(_around((0.0, 0.0), radius, quarter)[:-1]))
            add(_around(part.coords, radius, quarter)[:-1] if cap == "round" else _strip((x, y), (x, y), radius, radius, radius) if cap == "square" else [])
            continue
        if part.kind == "POLYGON":
            out.append(part.coords)
        if join == cap == "round":
            for a, b in _segments(part):
                left = math.atan2(b[1] - a[1], b[0] - a[0]) + math.pi / 2
                add([*_around(b, radius, quarter, left, 2 * quarter), *_around(a, radius, quarter, left + math.pi, 2 * quarter)])
            continue
        for ring in part.coords if part.kind == "POLYGON" else [part.coords]:
            line = [p for i, p in enumerate(ring) if not i or p[:2] != ring[i - 1][:2]]
            closed = len(line) > 2 and line[0][:2] == line[-1][:2]
            more = radius if cap == "square" and not closed else 0.0
            for i, (a, b) in enumerate(zip(line, line[1:], strict=False)):
                add(_strip(a, b, radius, more if i == 0 else 0.0, more if i == len(line) - 2 else 0.0))
            for p, q, r in zip(line, line[1:], line[2:] + (line[1:2] if closed else []), strict=False):
                add(_join(p, q, r, radius, quarter, join))
            if cap == "round" and not closed:
                for end in (line[0], line[-1]):
                    add(_around(end, radius, quarter)[:-1])
    if len(out) == 1:
        return Geometry("POLYGON", out[0], g.srid, about=about.get(0))
    return Geometry("MULTIPOLYGON", tuple(out), g.srid, united=True, about=tuple(about.get(i) for i in range(len(out))))
