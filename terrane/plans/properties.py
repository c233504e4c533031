"""Properties: what a collection shows of its tables, and how a literal of a query becomes a stored value."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from dataclasses import dataclass, replace
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.transformers import UNKNOWN, Joiner, Transformer

#: Type names and how Spark holds them.
TYPES: dict[str, str] = {
    "boolean": "boolean",
    "int": "int",
    "long": "bigint",
    "float": "float",
    "double": "double",
    "string": "string",
    "date": "date",
    "timestamp": "timestamp_ntz",
    "timestamptz": "timestamp",
    "uuid": "string",
    "array": "array<string>",
    "json": "string",
    "geometry": "binary",
}


def type_of(spark_type: T.DataType) -> str:
    """The type name for a Spark type. Decimals count as double; anything else is not supported."""
    for name, kinds in (
        ("boolean", T.BooleanType),
        ("int", (T.ByteType, T.ShortType, T.IntegerType)),
        ("long", T.LongType),
        ("float", T.FloatType),
        ("double", (T.DoubleType, T.DecimalType)),
        ("string", (T.StringType, T.VarcharType, T.CharType)),
        ("date", T.DateType),
        ("timestamp", T.TimestampNTZType),
        ("timestamptz", T.TimestampType),
        ("array", T.ArrayType),
        ("geometry", T.BinaryType),
    ):
        if isinstance(spark_type, kinds):
            return name
    raise ValueError(f"no property type for {spark_type.simpleString()}")


_INSTANT = re.compile(r"(\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d(?:\.\d{1,9})?)?)(Z|[+-]\d\d:\d\d)", re.IGNORECASE)


def parse_instant(text: str) -> dt.datetime:
    """An RFC 3339 date-time with Z or an offset of hours and minutes; digits beyond microseconds are cut."""
    m = _INSTANT.fullmatch(text)
    if not m:
        raise ValueError(f"not a date-time: {text!r}")
    local = re.sub(r"(\.\d{6})\d+", r"\1", m[1].upper())
    return dt.datetime.fromisoformat(local + ("+00:00" if m[2] in "Zz" else m[2])).astimezone(dt.timezone.utc)


def _whole(text: str, bits: int) -> Any:
    try:
        number = Decimal(text)
    except InvalidOperation:
        raise ValueError(f"not a number: {text!r}") from None
    if number != number.to_integral_value() or not -(1 << bits - 1) <= number < 1 << bits - 1:
        return UNKNOWN
    return int(number)


def coerce(kind: str, text: str | None, nullable: bool = True) -> Any:
    """A literal's text as a stored value of a type: None, UNKNOWN or the value. ValueError if it can't be read."""
    if text is None or nullable and text == "null":
        return None
    if kind == "int":
        return _whole(text, 32)
    if kind == "long":
        return _whole(text, 64)
    if kind in ("float", "double"):
        return float(text)
    if kind == "boolean":
        return text.lower() == "true"
    if kind == "date":
        return dt.date.fromisoformat(text) if re.fullmatch(r"\d{4}-\d\d-\d\d", text) else parse_instant(text).date()
    if kind == "timestamp":
        if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?", text):
            return dt.datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text))
        return parse_instant(text).replace(tzinfo=None)
    if kind == "timestamptz":
        return parse_instant(text)
    if kind == "uuid":
        return str(uuid.UUID(text))
    if kind == "geometry":
        return None
    return text


def literal(value: Any, kind: str) -> Column:
    return F.lit(value).cast(TYPES[kind]) if kind in TYPES and kind not in ("array",) else F.lit(value)


@dataclass(frozen=True)
class Property:
    """A public attribute over one stored column (or SQL expression) of a table.

    kind: the stored type. element: of an array. enum: the only literals that queries may use.
    """

    name: str
    column: str = ""
    kind: str = "string"
    table: str = ""
    nullable: bool = True
    hidden: bool = False
    element: str = "string"
    enum: tuple | None = None
    transformer: Transformer | None = None
    title: str = ""
    description: str = ""
    geometry_type: str = "GEOMETRY"
    srid: int = 84
    xy: tuple[str, str] | None = None
    bounds: tuple[str, str, str, str] | None = None

    @property
    def public_kind(self) -> str:
        return self.transformer.public if self.transformer else self.kind

    @property
    def stored(self) -> Column:
        return self._at(self.column or self.name)

    def _at(self, mapping: str) -> Column:
        if "(" in mapping or not re.fullmatch(r"[\w.$]+", mapping):
            return F.expr(mapping)
        return F.col(f"{self.table}.{mapping}" if self.table else mapping)

    @property
    def public(self) -> Column:
        return self.transformer.out(self.stored) if self.transformer else self.stored

    @property
    def x(self) -> Column:
        return self._at(self.xy[0]).cast("double")

    @property
    def y(self) -> Column:
        return self._at(self.xy[1]).cast("double")

    def to_inner(self, text: str | None) -> Any:
        if self.enum is not None and text not in {str(v) for v in self.enum}:
            raise ValueError(f"{self.name}: {text!r} is none of its values")
        if self.transformer:
            return self.transformer.into(text)
        return coerce(self.element if self.kind == "array" else self.kind, text, self.nullable)


@dataclass(frozen=True)
class Static(Property):
    """A literal as a column: value, typed by guess or as null$TYPE."""

    value: Any = None

    @property
    def stored(self) -> Column:
        return literal(self.value, self.kind)

    @property
    def public(self) -> Column:
        return self.stored

    def matches(self, text: str) -> bool:
        return text == ("null" if self.value is None else str(self.value))


def static(name: str, mapping: str) -> Static:
    """From a quoted mapping: int, long, double, boolean or string, by what fits first."""
    text = mapping[1:-1]
    if text.lower().startswith("null$"):
        return Static(name, kind=text[5:].lower(), value=None)
    for kind, read in (("int", _strict_int(32)), ("long", _strict_int(64)), ("double", float)):
        try:
            return Static(name, kind=kind, value=read(text), nullable=False)
        except ValueError:
            pass
    if text.lower() in ("true", "false"):
        return Static(name, kind="boolean", value=text.lower() == "true", nullable=False)
    return Static(name, kind="string", value=text, nullable=False)


def _strict_int(bits: int):
    def read(text: str) -> int:
        value = int(text)
        if not -(1 << bits - 1) <= value < 1 << bits - 1:
            raise ValueError
        return value

    return read


@dataclass(frozen=True)
class Composite(Property):
    """Several properties as one string; a literal falls apart into one for each."""

    parts: tuple[Property, ...] = ()
    joiner: Joiner | None = None

    @property
    def public_kind(self) -> str:
        return "string"

    @property
    def stored(self) -> Column:
        return self.joiner.out(*(p.public for p in self.parts))

    @property
    def public(self) -> Column:
        return self.stored

    def split(self, text: str) -> list[str]:
        return self.joiner.into(text)


def with_schema(prop: Property, schema: dict, language: str = "") -> Property:
    """A property with title, description and geometry type of a JSON schema; texts may be given by language."""

    def said(value) -> str:
        return value.get(language) or next(iter(value.values()), "") if isinstance(value, dict) else value or ""

    narrowed = schema.get("format", "").removeprefix("geometry-").replace("-any", "").replace("any", "").upper() or prop.geometry_type
    if prop.kind == "geometry" and prop.geometry_type not in ("GEOMETRY", narrowed):
        raise ValueError(f"{prop.name}: {narrowed} does not fit {prop.geometry_type}")
    enum = tuple(schema["enum"]) if "enum" in schema else prop.enum
    return replace(prop, title=said(schema.get("title")), description=said(schema.get("description")), geometry_type=narrowed, enum=enum)
