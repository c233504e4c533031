"""Value transformers: pairs of a way out (stored value to public value, as a Column) and a way in.

The way in rewrites a literal of a query: to None (compare with NULL), UNKNOWN (no stored value fits), one
stored value, or a list of them, in which None stands for NULL.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable
from functools import reduce
from itertools import chain
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


class _Unknown:
    def __repr__(self) -> str:
        return "UNKNOWN"


#: No stored value stands for the literal.
UNKNOWN = _Unknown()


def integer(text: str) -> int:
    """Digits with an optional sign, and nothing else. ValueError otherwise."""
    if not re.fullmatch(r"[-+]?\d+", text):
        raise ValueError(f"not an integer: {text!r}")
    return int(text)


class Transformer:
    """inner: the stored type. public: the type that queries see."""

    def __init__(self, inner: str, public: str | None = None):
        self.inner, self.public = inner, public or inner

    def out(self, c: Column) -> Column:
        raise NotImplementedError

    def into(self, literal: str | None) -> Any:
        raise NotImplementedError

    def nulls(self) -> list:
        """The values that go in and come out as null."""
        return [None]

    def _stored(self, text: str) -> Any:
        return integer(text) if self.inner in ("int", "long") else text


class NullIf(Transformer):
    """A stored value that stands for null."""

    def __init__(self, inner: str, arg: str):
        super().__init__(inner)
        self.value = self._stored(arg)

    def out(self, c: Column) -> Column:
        return F.nullif(c, F.lit(self.value))

    def into(self, literal: str | None) -> Any:
        return self.value if literal == "null" else None if literal is None else self._stored(literal)

    def nulls(self) -> list:
        return [None, self.value]


class IfNull(Transformer):
    """A public value that stands for a stored null."""

    def __init__(self, inner: str, arg: str):
        super().__init__(inner)
        self.value = self._stored(arg)

    def out(self, c: Column) -> Column:
        return F.coalesce(c, F.lit(self.value))

    def into(self, literal: str | None) -> Any:
        stored = None if literal is None else self._stored(literal)
        return None if stored == self.value else stored

    def nulls(self) -> list:
        return []


class Prefix(Transformer):
    def __init__(self, inner: str, arg: str):
        super().__init__(inner, "string")
        self.prefix = arg

    def out(self, c: Column) -> Column:
        return F.concat(F.lit(self.prefix), c.cast("string"))

    def into(self, literal: str | None) -> Any:
        if literal is None:
            return None
        if not literal.startswith(self.prefix):
            return UNKNOWN
        try:
            return self._stored(literal[len(self.prefix) :])
        except ValueError:
            return UNKNOWN


class LongToString(Transformer):
    def __init__(self, inner: str = "long", arg: str = ""):
        super().__init__(inner, "string")

    def out(self, c: Column) -> Column:
        return c.cast("string")

    def into(self, literal: str | None) -> Any:
        return None if literal is None else integer(literal)


class FixedLength(Transformer):
    """An integer as digits of a fixed number, with leading zeros; a sign takes a place, high digits are cut."""

    def __init__(self, inner: str, arg: str):
        super().__init__(inner, "string")
        self.n = int(arg)

    def out(self, c: Column) -> Column:
        digits = F.regexp_replace(c.cast("string"), "^-", "")
        padded = lambda n: F.substring(F.concat(F.lit("0" * n), digits), F.length(digits) + 1, F.lit(n))
        return F.when(c < 0, F.concat(F.lit("-"), padded(self.n - 1))).otherwise(padded(self.n))

    def into(self, literal: str | None) -> Any:
        if literal is None:
            return None
        if len(literal) != self.n:
            raise ValueError(f"a string of {self.n} characters is needed, not {literal!r}")
        return integer(literal)


class Slices(Transformer):
    """Comma-separated parts: 'text' as it is, %d[from:to] for a slice of the stored digits without leading zeros."""

    def __init__(self, inner: str, arg: str):
        super().__init__("string", "string")
        self.parts: list[str | tuple[int, int]] = []
        for part in arg.split(","):
            if part[:1] in "'\"" and part:
                self.parts.append(part[1:-1])
            elif m := re.fullmatch(r"%d\[(\d+):(\d+)\]", part):
                self.parts.append((int(m[1]), int(m[2])))
            else:
                raise ValueError(f"not a part of a pattern: {part!r}")

    def out(self, c: Column) -> Column:
        slices = [
            F.lit(p) if isinstance(p, str) else F.regexp_replace(F.substring(c, p[0] + 1, p[1] - p[0]), r"^0+(?=.)", "") for p in self.parts
        ]
        return F.concat(*slices)

    def into(self, literal: str | None) -> Any:
        if literal is None:
            return None
        stored = ""
        for p in self.parts:
            if isinstance(p, str):
                if not literal.startswith(p):
                    return UNKNOWN
                literal = literal[len(p) :]
            else:
                width = p[1] - p[0]
                digits = re.match(rf"\d{{0,{width}}}", literal)[0]
                if not digits:
                    return UNKNOWN
                stored += str(int(digits)).zfill(width)
                literal = literal[len(digits) :]
        return stored


class Joiner(Transformer):
    """Several stored columns as one string. The way in gives a list with a value for each, or None."""

    def __init__(self, inner: str, arg: str):
        super().__init__(inner, "string")
        self.separator = arg

    def out(self, *c: Column) -> Column:
        return F.concat(*chain.from_iterable((F.lit(self.separator), x.cast("string")) if i else (x.cast("string"),) for i, x in enumerate(c)))

    def into(self, literal: str | None) -> Any:
        return None if literal is None else literal.split(self.separator)


class CodeList(Transformer):
    """A JSON object from stored codes to public values. The key $null maps a stored null."""

    def __init__(self, inner: str, arg: str | dict):
        codes = json.loads(arg) if isinstance(arg, str) else arg
        some = next((v for v in codes.values() if v is not None), "")
        super().__init__(inner, "int" if isinstance(some, int) else "string")
        self.codes = {None if k.lower() == "$null" else self._stored(k): v for k, v in codes.items()}

    def out(self, c: Column) -> Column:
        pairs = [(k, v) for k, v in self.codes.items() if k is not None and v is not None]
        mapped = F.lit(None).cast(self.public)
        if pairs:
            mapped = F.try_element_at(F.create_map(*(F.lit(x) for p in pairs for x in p)), c)
        null = self.codes.get(None)
        return mapped if null is None else F.when(c.isNull(), F.lit(null)).otherwise(mapped)

    def into(self, literal: str | None) -> Any:
        wanted = None if literal is None else integer(literal) if self.public == "int" else literal
        stored = [k for k, v in self.codes.items() if v == wanted and type(v) is type(wanted)]
        if not stored:
            return None if wanted is None else UNKNOWN
        return stored[0] if len(stored) == 1 else stored

    def nulls(self) -> list:
        """Of the codes that the list has; others have no public value either."""
        return [k for k, v in self.codes.items() if v is None] + ([] if None in self.codes else [None])


class DayRange(tuple):
    """A stored timestamp on a day: from the first moment to before the second."""


class TimestampToDate(Transformer):
    """The day of a local timestamp."""

    def __init__(self, inner: str = "timestamp", arg: str = ""):
        super().__init__(inner, "date")
        self.zone = ZoneInfo(arg or "UTC")

    def out(self, c: Column) -> Column:
        return c.cast("date")

    def into(self, literal: str | None) -> Any:
        if literal is None:
            return None
        day = dt.date.fromisoformat(literal)
        begin, end = (dt.datetime.combine(d, dt.time()) for d in (day, day + dt.timedelta(1)))
        return DayRange(self._moment(x) for x in (begin, end))

    def _moment(self, local: dt.datetime) -> dt.datetime:
        return local


class TimestamptzToDate(TimestampToDate):
    """The day of an instant in a time zone."""

    def __init__(self, inner: str = "timestamptz", arg: str = ""):
        super().__init__(inner, arg)

    def out(self, c: Column) -> Column:
        return F.convert_timezone(F.lit("UTC"), F.lit(str(self.zone)), F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz")).cast("date")

    def _moment(self, local: dt.datetime) -> dt.datetime:
        return local.replace(tzinfo=self.zone)


class BuildingFunction(Transformer):
    """Building use codes: -99 as it is, class L counts as N, else the first character, or two of a number."""

    def __init__(self, inner: str = "string", arg: str = ""):
        super().__init__("string", "string")

    def out(self, c: Column) -> Column:
        two = F.substring(c, 1, 1).isin("0", "1")
        return F.when(c == "-99", c).when(c.startswith("L"), F.lit("N")).when(two, F.substring(c, 1, 2)).otherwise(F.substring(c, 1, 1))

    def into(self, literal: str | None) -> Any:
        if not literal:
            return literal
        if re.fullmatch(r"[-+]?\d{1,9}", literal):
            return literal if int(literal) == -99 or 1 <= int(literal) <= 19 else UNKNOWN
        if not re.fullmatch(r"[A-KMN]", literal):
            return UNKNOWN
        return ["N%", "L%"] if literal == "N" else literal + "%"


class Chain(Transformer):
    """Transformers in a row: name(arg) | name(arg). Out from left to right, in from right to left."""

    def __init__(self, inner: str, arg: str | list[Transformer]):
        steps = arg
        if isinstance(arg, str):
            steps, kind = [], inner
            for step in arg.split("|"):
                m = re.fullmatch(r"\s*(\w+)\((.*)\)\s*", step, re.DOTALL)
                if not m:
                    raise ValueError(f"not a transformer: {step!r}")
                steps.append(make(m[1], kind, m[2].strip()))
                kind = steps[-1].public
        super().__init__(inner, steps[-1].public)
        self.steps = steps

    def out(self, c: Column) -> Column:
        return reduce(lambda x, t: t.out(x), self.steps, c)

    def into(self, literal: str | None) -> Any:
        """What a step knows as several values, each of them goes on; a null goes on as all that the next step makes null."""
        found = self._back(literal)
        return None if literal is None else UNKNOWN if not found else found[0] if len(found) == 1 else found

    def nulls(self) -> list:
        return self._back(None)

    def _back(self, value: str | None) -> list:
        found: list = [value]
        for step in reversed(self.steps):
            now: list = []
            for x in found:
                got = step.nulls() if x is None else step.into(x if isinstance(x, str) else str(x))
                now += got if isinstance(got, list) else [got]
            found = [x for i, x in enumerate(now) if x is not UNKNOWN and x not in now[:i]]
        return found


REGISTRY: dict[str, Callable[..., Transformer]] = {
    c.__name__: c
    for c in (
        NullIf,
        IfNull,
        Prefix,
        LongToString,
        FixedLength,
        Slices,
        Joiner,
        CodeList,
        TimestampToDate,
        TimestamptzToDate,
        BuildingFunction,
        Chain,
    )
}


def make(name: str, inner: str, arg: str = "") -> Transformer:
    if name not in REGISTRY:
        raise ValueError(f"no such transformer: {name}")
    return REGISTRY[name](inner, arg)
