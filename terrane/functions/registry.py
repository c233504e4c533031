"""Functions that filters may call. They run on literals, once, on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .geometry import Geometry, buffer


@dataclass(frozen=True)
class Function:
    """args: (name, type) pairs; types are geometry, number, string, boolean. required: how many are needed."""

    name: str
    run: Callable[..., Any]
    args: tuple[tuple[str, str], ...] = ()
    returns: str = "string"
    description: str = ""
    hidden: bool = False
    required: int | None = None


_TYPES: dict[str, tuple[type, ...]] = {"geometry": (Geometry,), "number": (int, float), "string": (str,), "boolean": (bool,)}


def _st_buffer(geometry: Geometry, radius: float, style: str = "") -> Geometry:
    """Styles: quad_segs=n, join=round, mitre (or miter) or bevel, endcap=round, flat (or butt) or square."""
    quarter, chosen = 8, {"join": "round", "endcap": "round"}
    for part in style.split():
        key, _, value = part.partition("=")
        if key == "quad_segs":
            quarter = int(value)
        elif key in chosen:
            chosen[key] = {"miter": "mitre", "butt": "flat"}.get(value, value)
        else:
            raise ValueError(f"not a supported buffer style: {part!r}")
    return buffer(geometry, radius, quarter, chosen["join"], chosen["endcap"])


BUILT_IN = (
    Function("Buffer", buffer, (("geometry", "geometry"), ("radius", "number")), "geometry", "All points within a distance"),
    Function(
        "ST_Buffer",
        _st_buffer,
        (("geometry", "geometry"), ("radius", "number"), ("style", "string")),
        "geometry",
        "All points within a distance, with a style",
        required=2,
    ),
)


@dataclass
class Functions:
    """Tables of functions; the first with a name wins, whatever its case."""

    tables: list[tuple[Function, ...]] = field(default_factory=lambda: [BUILT_IN])

    def register(self, *functions: Function) -> Functions:
        self.tables.append(functions)
        return self

    def find(self, name: str) -> Function:
        for table in self.tables:
            for f in table:
                if f.name.lower() == name.lower():
                    return f
        raise ValueError(f"no such function: {name}")

    def call(self, name: str, args: list[Any]) -> Any:
        f = self.find(name)
        least = len(f.args) if f.required is None else f.required
        if not least <= len(args) <= len(f.args):
            raise ValueError(f"{f.name} takes {len(f.args)} arguments, not {len(args)}")
        for (arg, kind), value in zip(f.args, args, strict=False):
            if kind in _TYPES and not isinstance(value, _TYPES[kind]):
                raise ValueError(f"{f.name}: {arg} must be a {kind}")
        return f.run(*args)

    def listed(self) -> list[Function]:
        seen: dict[str, Function] = {}
        for table in self.tables:
            for f in table:
                seen.setdefault(f.name.lower(), f)
        return [f for f in seen.values() if not f.hidden]
