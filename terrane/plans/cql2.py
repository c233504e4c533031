"""CQL2-Text: a scanner, a recursive-descent parser to a small syntax tree, and its lowering to filters."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from ..functions import crs, geometry
from ..functions.geometry import Geometry, box
from ..functions.registry import Functions
from . import filters as fl
from .properties import Property, parse_instant

# Ranges of the characters that CQL2-Text allows in names, beside A-Z, a-z, : and _.
_LETTERS = (
    (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2FF), (0x370, 0x37D), (0x37F, 0x1FFE), (0x200C, 0x200D), (0x2070, 0x218F),
    (0x2C00, 0x2FEF), (0x3001, 0xD7FF), (0xF900, 0xFDCF), (0xFDF0, 0xFFFD), (0x10000, 0xEFFFF),
)
_MARKS = ((0x300, 0x36F), (0x203F, 0x2040))
_START = ":_A-Za-z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _LETTERS)
_MORE = _START + ".0-9" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _MARKS)
_TOKENS = re.compile(
    rf"""\s*(?:
      (?P<string>'(?:''|\\'|[^'])*')
    | (?P<number>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)
    | (?P<quoted>"[{_START}][{_MORE}]*")
    | (?P<name>[{_START}][{_MORE}]*)
    | (?P<op><>|<=|>=|[=<>(),])
    )""",
    re.VERBOSE,
)
_KEYWORDS = {"AND", "OR", "NOT", "LIKE", "BETWEEN", "IN", "IS", "NULL", "CASEI", "DATE", "TIMESTAMP", "BBOX", "TRUE", "FALSE"}
_SPATIAL = {f"S_{op}" for op in geometry.SPATIAL_OPERATORS}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


def scan(text: str) -> list[Token]:
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        m = _TOKENS.match(text, at)
        if not m:
            raise ValueError(f"filter: unexpected {text[at : at + 10].strip()!r} at {at}")
        kind = m.lastgroup
        out.append(Token(kind, m[kind], m.start(kind)))
        at = m.end()
    return out


# --- syntax tree --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Lit:
    """kind: string, number, boolean, date, timestamp or geometry; numbers and temporal values keep their text."""

    kind: str
    value: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Binary:
    op: str
    prop: Name
    value: Any
    casei: bool = False


@dataclass(frozen=True)
class LikeOf:
    prop: Name
    pattern: str
    casei: bool = False
    negated: bool = False


@dataclass(frozen=True)
class NullOf:
    prop: Name
    negated: bool = False


@dataclass(frozen=True)
class SpatialOf:
    op: str
    prop: Name
    value: Any


@dataclass(frozen=True)
class Logic:
    op: str
    of: tuple


@dataclass(frozen=True)
class Empty:
    pass


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = scan(text), 0

    def peek(self, ahead: int = 0) -> Token:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else Token("end", "", -1)

    def is_(self, *words: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t.word in words or t.kind == "op" and t.text in words

    def take(self, *words: str) -> Token:
        t = self.peek()
        if words and not self.is_(*words):
            raise ValueError(f"filter: expected {' or '.join(words)} instead of {t.text or 'the end'!r}")
        self.at += 1
        return t

    def taken(self, *words: str) -> bool:
        if self.is_(*words):
            self.at += 1
            return True
        return False

    def expression(self):
        terms = [self.term()]
        while self.taken("OR"):
            terms.append(self.term())
        return terms[0] if len(terms) == 1 else Logic("OR", tuple(terms))

    def term(self):
        factors = [self.factor()]
        while self.taken("AND"):
            factors.append(self.factor())
        return factors[0] if len(factors) == 1 else Logic("AND", tuple(factors))

    def factor(self):
        return Logic("NOT", (self.primary(),)) if self.taken("NOT") else self.primary()

    def primary(self):
        if self.taken("("):
            inner = self.expression()
            self.take(")")
            return inner
        t = self.peek()
        if t.word in _SPATIAL:
            return self.spatial()
        if t.word in ("TRUE", "FALSE"):
            return Lit("boolean", self.take().word == "TRUE")
        if t.kind == "name" and t.word not in _KEYWORDS and self.is_("(", ahead=1):
            return self.call()
        return self.predicate()

    def name(self) -> Name:
        t = self.peek()
        if t.kind == "quoted":
            self.at += 1
            return Name(t.text[1:-1])
        if t.kind != "name" or t.word in _KEYWORDS:
            raise ValueError(f"filter: expected a property instead of {t.text or 'the end'!r}")
        self.at += 1
        return Name(t.text)

    def maybe_casei(self, read: Callable):
        if self.taken("CASEI"):
            self.take("(")
            inner = read()
            self.take(")")
            return inner, True
        return read(), False

    def predicate(self):
        prop, folded = self.maybe_casei(self.name)
        t = self.peek()
        if t.kind == "op" and t.text in ("=", "<>", "<", "<=", ">", ">="):
            self.at += 1
            value, too = self.scalar()
            return Binary(t.text, prop, value, folded or too)
        if self.is_("IS") and not folded:
            self.take()
            negated = self.taken("NOT")
            self.take("NULL")
            return NullOf(prop, negated)
        negated = self.taken("NOT")
        if self.taken("LIKE"):
            value, too = self.maybe_casei(self.string)
            return LikeOf(prop, value.value, folded or too, negated)
        if self.is_("BETWEEN") and not folded:
            self.take()
            low = self.number()
            self.take("AND")
            high = self.number()
            ops = ("<", ">") if negated else (">=", "<=")
            return Logic("OR" if negated else "AND", (Binary(ops[0], prop, low), Binary(ops[1], prop, high)))
        if self.taken("IN"):
            self.take("(")
            items = [self.scalar()]
            while self.taken(","):
                items.append(self.scalar())
            self.take(")")
            op = "<>" if negated else "="
            each = tuple(Binary(op, prop, v, folded or too) for v, too in items)
            return each[0] if len(each) == 1 else Logic("AND" if negated else "OR", each)
        raise ValueError(f"filter: expected a comparison instead of {t.text or 'the end'!r}")

    def scalar(self):
        t = self.peek()
        if t.kind == "name" and t.word not in _KEYWORDS and self.is_("(", ahead=1):
            return self.call(), False
        if t.kind == "number":
            return self.number(), False
        if t.word in ("TRUE", "FALSE"):
            return Lit("boolean", self.take().word == "TRUE"), False
        if t.word in ("DATE", "TIMESTAMP"):
            return self.temporal(), False
        return self.maybe_casei(self.string)

    def number(self) -> Lit:
        t = self.peek()
        if t.kind != "number":
            raise ValueError(f"filter: expected a number instead of {t.text or 'the end'!r}")
        self.at += 1
        return Lit("number", t.text)

    def string(self) -> Lit:
        t = self.peek()
        if t.kind != "string":
            raise ValueError(f"filter: expected a string instead of {t.text or 'the end'!r}")
        self.at += 1
        return Lit("string", re.sub(r"''|\\'", "'", t.text[1:-1]))

    def temporal(self) -> Lit:
        kind = self.take("DATE", "TIMESTAMP").word.lower()
        self.take("(")
        text = self.string().value
        self.take(")")
        if kind == "date":
            dt.date.fromisoformat(text)
        elif not text.upper().endswith("Z") or not parse_instant(text):
            raise ValueError(f"filter: a timestamp ends with Z, not {text!r}")
        return Lit(kind, text)

    def call(self) -> Call:
        name = self.name().name
        self.take("(")
        args = []
        if not self.is_(")"):
            args.append(self.argument())
            while self.taken(","):
                args.append(self.argument())
        self.take(")")
        return Call(name, tuple(args))

    def argument(self):
        t = self.peek()
        if t.word in geometry.KINDS or t.word == "BBOX":
            return self.geometry()
        if t.kind in ("number", "string") or t.word in ("TRUE", "FALSE", "DATE", "TIMESTAMP") or self.is_("(", ahead=1):
            return self.scalar()[0]
        return self.name()

    def spatial(self) -> SpatialOf:
        op = self.take(*_SPATIAL).word[2:]
        self.take("(")
        prop = self.name()
        self.take(",")
        t = self.peek()
        value = self.geometry() if t.word in geometry.KINDS or t.word == "BBOX" else self.call()
        self.take(")")
        return SpatialOf(op, prop, value)

    def geometry(self) -> Lit:
        if self.taken("BBOX"):
            self.take("(")
            n = [float(self.number().value)]
            while self.taken(","):
                n.append(float(self.number().value))
            self.take(")")
            if len(n) not in (4, 6):
                raise ValueError("filter: a bbox has four or six numbers")
            return Lit("geometry", box(n[0], n[1], n[len(n) // 2], n[len(n) // 2 + 1]))
        found, rest = geometry.wkt_tokens([t.text for t in self.tokens[self.at :]], 84)
        self.at = len(self.tokens) - len(rest)
        return Lit("geometry", found)


def parse(text: str | None):
    """The syntax tree of a filter. Blank text is Empty. ValueError if it isn't CQL2-Text."""
    if not text or not text.strip():
        return Empty()
    p = _Parser(text)
    out = p.expression()
    if p.peek().kind != "end":
        raise ValueError(f"filter: unexpected {p.peek().text!r}")
    return out


# --- lowering -----------------------------------------------------------------------------------------


def split_wrapped(g: Geometry, code: int) -> Geometry:
    """A box whose first x is the greater one, cut at the system's wrap line; other geometries stay."""
    ring = g.coords[0] if g.kind == "POLYGON" and len(g.coords) == 1 else ()
    xs = list(dict.fromkeys(p[0] for p in ring[:-1]))
    ys = list(dict.fromkeys(p[1] for p in ring[:-1]))
    wrap = crs.SRIDS[code].wrap if code in crs.SRIDS else None
    if len(ring) != 5 or len(xs) != 2 or len(ys) != 2 or xs[0] <= xs[1] or not wrap:
        return g
    low, high = sorted(ys)
    return Geometry("MULTIPOLYGON", (box(xs[0], low, wrap[1], high).coords, box(wrap[0], low, xs[1], high).coords), g.srid)


class Lowering:
    """Turns a tree into a filter, for the queryable properties of a collection."""

    def __init__(self, queryables: dict[str, Property], functions: Functions | None = None, srid: int = 84, swap_lat_lon: bool = False):
        self.queryables, self.functions, self.srid, self.swap = queryables, functions or Functions(), srid, swap_lat_lon

    def prop(self, name: Name) -> Property:
        if name.name not in self.queryables:
            raise ValueError(f"filter: {name.name} can't be queried")
        return self.queryables[name.name]

    def filter(self, e) -> fl.Filter:
        if isinstance(e, Empty):
            return fl.PASS
        if isinstance(e, Logic):
            inner = [self.filter(x) for x in e.of]
            return fl.negated(inner[0]) if e.op == "NOT" else (fl.conjunction if e.op == "AND" else fl.disjunction)(*inner)
        if isinstance(e, Binary):
            prop, text = self.prop(e.prop), self.text(e.value)
            return fl.compare(e.op, prop, text, e.casei and e.op in ("=", "<>"))
        if isinstance(e, LikeOf):
            f = fl.like(self.prop(e.prop), e.pattern, e.casei)
            return fl.negated(f) if e.negated else f
        if isinstance(e, NullOf):
            return fl.IsNull(prop=self.prop(e.prop), negated=e.negated)
        if isinstance(e, SpatialOf):
            prop, value = self.prop(e.prop), self.value(e.value)
            if not isinstance(value, Geometry):
                raise ValueError("filter: a spatial operator needs a geometry")
            if self.swap and self.srid in crs.SRIDS and crs.SRIDS[self.srid].lat_lon:
                value = value.mapped(lambda x, y: (y, x))
            whole = replace(value, srid=self.srid)
            return fl.spatially(e.op, prop, crs.reproject(split_wrapped(whole, self.srid), prop.srid))
        if isinstance(e, Call):
            e = Lit("boolean", self.value(e))
        if isinstance(e, Lit) and isinstance(e.value, bool):
            return fl.PASS if e.value else fl.DENY
        raise ValueError("filter: a condition is needed")

    def value(self, e) -> Any:
        if isinstance(e, Call):
            return self.functions.call(e.name, [self.value(a) for a in e.args])
        if isinstance(e, Name):
            raise ValueError("filter: functions take literals")
        return float(e.value) if e.kind == "number" else e.value

    def text(self, e) -> str:
        if isinstance(e, Lit) and e.kind == "number":
            return e.value
        v = self.value(e)
        return ("true" if v else "false") if isinstance(v, bool) else str(v)
