"""Joins of a collection's tables: an undirected graph of equi-joins, and the frames that it leads to."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE_TO_ONE, ONE_TO_MANY, MANY_TO_ONE, MANY_TO_MANY = "one_to_one", "one_to_many", "many_to_one", "many_to_many"


@dataclass(frozen=True)
class Join:
    """left.left_column = right.right_column, either with ::type behind it. bridge: (table, its left column, its right column)."""

    left: str
    left_column: str
    right: str
    right_column: str
    kind: str = ONE_TO_ONE
    bridge: tuple[str, str, str] | None = None

    def swapped(self) -> Join:
        kind = {ONE_TO_MANY: MANY_TO_ONE, MANY_TO_ONE: ONE_TO_MANY}.get(self.kind, self.kind)
        bridge = self.bridge and (self.bridge[0], self.bridge[2], self.bridge[1])
        return Join(self.right, self.right_column, self.left, self.left_column, kind, bridge)


def _column(table: str, column: str) -> Column:
    name, _, cast = column.partition("::")
    return F.col(f"{table}.{name}").cast(cast) if cast else F.col(f"{table}.{name}")


def path(joins: list[Join], start: str, end: str) -> list[Join] | None:
    """The fewest joins from one table to another, each from left to right; None if there is no way."""
    both = [*joins, *(j.swapped() for j in joins)]
    came: dict[str, Join | None] = {start: None}
    queue = deque([start])
    while queue:
        at = queue.popleft()
        if at == end:
            out: list[Join] = []
            while came[at]:
                out.append(came[at])
                at = came[at].left
            return out[::-1]
        for j in both:
            if j.left == at and j.right not in came:
                came[j.right] = j
                queue.append(j.right)
    return None


def needed(joins: list[Join], start: str, tables: set[str]) -> list[Join]:
    """The joins on the paths from a table to others, each once, in an order that can be run."""
    out: list[Join] = []
    for table in sorted(tables - {start}):
        found = path(joins, start, table)
        if found is None:
            raise ValueError(f"no join leads from {start} to {table}")
        out.extend(j for j in found if j not in out)
    return out


def reachable(joins: list[Join], start: str) -> set[str]:
    tables = {start} | {t for j in joins for t in (j.left, j.right)}
    return {t for t in tables if path(joins, start, t) is not None}


def joined(frames: dict[str, DataFrame], joins: list[Join], start: str) -> DataFrame:
    """The tables under their names. The way of each join is left to Catalyst and AQE, which know the sizes."""
    out = frames[start].alias(start)
    for j in joins:
        if j.bridge:
            b = f"{j.bridge[0]}"
            out = out.join(frames[b].alias(b), _column(j.left, j.left_column) == _column(b, j.bridge[1]))
            out = out.join(frames[j.right].alias(j.right), _column(b, j.bridge[2]) == _column(j.right, j.right_column))
        else:
            out = out.join(frames[j.right].alias(j.right), _column(j.left, j.left_column) == _column(j.right, j.right_column))
    return out
