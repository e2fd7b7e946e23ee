"""Scan positions, their order, and the predicates that a scan between two of them needs."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scalar = None | bool | int | float | str
_RANK = {"null": 0, "boolean": 1, "integer": 2, "number": 3, "string": 4}


def kind_of(x: Scalar) -> str:
    if x is None:
        return "null"
    for kind, of in (("boolean", bool), ("integer", int), ("number", float), ("string", str)):
        if isinstance(x, of):
            if kind == "number" and not math.isfinite(x):
                raise ValueError("positions hold finite numbers")
            return kind
    raise TypeError(f"no position value: {x!r}")


def scalar_key(x: Scalar) -> tuple:
    kind = kind_of(x)
    return _RANK[kind], 0 if x is None else x


def parsed(text: str | None, kind: str) -> Scalar:
    """A checkpoint value from its text."""
    if text is None:
        return None
    if kind == "boolean":
        if text.lower() not in ("true", "false"):
            raise ValueError(f"no boolean: {text!r}")
        return text.lower() == "true"
    return {"integer": int, "number": float, "string": str}[kind](text)


@dataclass(frozen=True)
class WorkPosition:
    """Of ordered state work."""

    collect_id: str
    sequence_order: int
    family = "ordered_work"

    @property
    def key(self) -> tuple:
        return self.collect_id, self.sequence_order


@dataclass(frozen=True)
class CurrentPosition:
    """Of a scan of the current state."""

    identity_json: str
    family = "current"

    @property
    def key(self) -> tuple:
        return (scalar_key(self.identity_json),)


@dataclass(frozen=True)
class EventPosition:
    cursor: Scalar
    primary_key: Scalar
    family = "event"

    @property
    def key(self) -> tuple:
        return scalar_key(self.cursor), scalar_key(self.primary_key)


Position = WorkPosition | CurrentPosition | EventPosition
_FAMILIES = {c.family: c for c in (WorkPosition, CurrentPosition, EventPosition)}


def compare(a: Position, b: Position) -> int:
    """-1, 0 or 1; positions of different families have no order."""
    if a.family != b.family:
        raise ValueError(f"positions of {a.family} and {b.family} have no order")
    return (a.key > b.key) - (a.key < b.key)


def stored(p: Position) -> str:
    return json.dumps({"family": p.family, **vars(p)}, sort_keys=True, separators=(",", ":"))


def restored(text: str) -> Position:
    values = json.loads(text)
    return _FAMILIES[values.pop("family")](**values)


@dataclass(frozen=True)
class Range:
    """(lower, upper]; lower is None at the beginning."""

    lower: Position | None
    first: Position
    last: Position
    upper: Position

    def __post_init__(self) -> None:
        if compare(self.first, self.last) > 0 or compare(self.last, self.upper) > 0 or (self.lower is not None and compare(self.lower, self.first) >= 0):
            raise ValueError("a range needs lower < first <= last <= upper")


def after(columns: list[str], values: list) -> Column:
    """Lexicographically greater than the values."""
    a, b = (F.col(c) for c in columns)
    x, y = (F.lit(v) for v in values)
    return (a > x) | ((a == x) & (b > y))


def before(columns: list[str], values: list) -> Column:
    """Lexicographically less than the values."""
    a, b = (F.col(c) for c in columns)
    x, y = (F.lit(v) for v in values)
    return (a < x) | ((a == x) & (b < y))


def through(columns: list[str], values: list) -> Column:
    """Lexicographically not greater than the values."""
    a, b = (F.col(c) for c in columns)
    x, y = (F.lit(v) for v in values)
    return (a < x) | ((a == x) & (b <= y))


def between(columns: list[str], first: list, last: list) -> Column:
    """From first to last, both included."""
    a, b = (F.col(c) for c in columns)
    x, y = (F.lit(v) for v in first)
    return ((a > x) | ((a == x) & (b >= y))) & through(columns, last)


def window(df: DataFrame, cursor: str, primary_key: str, scan_after: list | None = None, scan_through: list | None = None, limit: int | None = None) -> DataFrame:
    """Rows in (scan_after, scan_through] by cursor and primary key, neither null; ordered if limited.

    The predicates are plain comparisons, so Parquet scans push them down; order with a limit is a top-k.
    """
    columns = [cursor, primary_key]
    conditions = [F.col(c).isNotNull() for c in columns]
    if scan_after is not None:
        conditions.append(after(columns, scan_after))
    if scan_through is not None:
        conditions.append(through(columns, scan_through))
    rows = df.filter(reduce(lambda a, b: a & b, conditions))
    return rows if limit is None else rows.orderBy(*[F.col(c).asc_nulls_last() for c in columns]).limit(limit)


def upper_bound(rows: DataFrame, cursor: str, primary_key: str) -> DataFrame:
    """The greatest (cursor, primary key), as one row; combined before the shuffle."""
    most = rows.filter(F.col(cursor).isNotNull() & F.col(primary_key).isNotNull()).agg(F.max(F.struct(F.col(cursor).alias("c"), F.col(primary_key).alias("p"))).alias("m"))
    return most.filter("m is not null").select(F.col("m.c").alias("cursor"), F.col("m.p").alias("primary_key"))
