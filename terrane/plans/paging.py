"""Order and pages: explicit null order, keyset cursors that compare keys as a tuple, offsets, and both."""

from __future__ import annotations

import base64
import datetime as dt
import json
from dataclasses import dataclass
from typing import Any

from urllib.parse import urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F

from .filters import _value
from .properties import Property, coerce

STRATEGIES = ("cursor", "offset", "hybrid")


def sort_columns(order: list[tuple[Property, bool]], nulls: str = "postgres") -> list[Column]:
    """Keys with nulls where the store has them: last when rising and first when falling, or (sqlite) the other way."""
    out = []
    for prop, up in order:
        c = prop.stored
        if nulls == "sqlite":
            out.append(c.asc_nulls_first() if up else c.desc_nulls_last())
        else:
            out.append(c.asc_nulls_last() if up else c.desc_nulls_first())
    return out


@dataclass(frozen=True)
class Cursor:
    """What the first row of the next page has as keys, and an offset from there."""

    values: tuple[str | None, ...]
    offset: int = 0

    def wire(self) -> str:
        text = self.values[0] if len(self.values) == 1 and self.values[0] is not None else json.dumps(self.values)
        return base64.b64encode(f"{self.offset}:{text}".encode()).decode()


def read_cursor(wire: str, keys: int) -> Cursor:
    """ValueError if the text isn't a cursor for so many keys."""
    try:
        offset, _, text = base64.b64decode(wire, validate=True).decode().partition(":")
        values = [text] if keys == 1 and text != "[null]" else json.loads(text)
        if not isinstance(values, list) or len(values) != keys:
            raise ValueError
        return Cursor(tuple(values), int(offset))
    except (ValueError, UnicodeDecodeError):
        raise ValueError("invalid next cursor") from None


def as_text(value: Any) -> str | None:
    if isinstance(value, dt.datetime):
        return value.isoformat() + ("Z" if value.tzinfo is None else "")
    if isinstance(value, bool):
        return "true" if value else "false"
    return None if value is None else str(value)


def from_cursor(order: list[tuple[Property, bool]], cursor: Cursor, nulls: str = "postgres") -> Column:
    """Rows at or behind a cursor: a first key that lies behind, or an equal one and so on with the next."""
    found = F.lit(True)
    for (prop, up), text in reversed(list(zip(order, cursor.values, strict=True))):
        c = prop.stored
        nulls_last = up if nulls != "sqlite" else not up
        if text is None:
            same, behind = c.isNull(), F.lit(False) if nulls_last else c.isNotNull()
        else:
            value = _value(coerce(prop.kind, text, nullable=False), prop.kind)
            same = F.coalesce(c == value, F.lit(False))
            behind = F.coalesce(c > value if up else c < value, F.lit(False))
            if nulls_last and prop.nullable:
                behind = behind | c.isNull()
        found = behind | (same & found)
    first, up = order[0]
    if cursor.values[0] is not None and not (first.nullable and (up if nulls != "sqlite" else not up)):
        # what every such row has: a plain comparison that reaches the scan
        value = _value(coerce(first.kind, cursor.values[0], nullable=False), first.kind)
        found = (first.stored >= value if up else first.stored <= value) & found
    return found


def next_link(path: str, query: dict[str, str], cursor: str | None, param: str = "next") -> str | None:
    """The request again, with the next page's cursor instead of its own and of an offset; None behind the last page."""
    kept = {k: v for k, v in query.items() if k not in (param, "offset")}
    return f"{path}?{urlencode(kept | {param: cursor})}" if cursor else None
