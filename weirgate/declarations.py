"""What an author declares: sources, states, events and their syncs. Plain frozen values, checked when made."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
CHECKPOINT_KINDS = ("boolean", "integer", "number", "string")
OPERATIONS = ("upsert", "remove")
FAILURE_MODES = ("stop_on_terminal", "stop_on_any", "continue_on_any")


class DeclarationError(ValueError):
    """A declaration that cannot mean anything."""


def named(value: object, what: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise DeclarationError(f"{what} must be a non-empty string")
    return value


def column(value: object, what: str) -> str:
    if not IDENTIFIER.fullmatch(named(value, what)):
        raise DeclarationError(f"{what} must name a column: {value!r}")
    return value


def normalized_query(query: str) -> str:
    """Without outer white space, common indentation and a closing semicolon."""
    import textwrap

    text = textwrap.dedent(named(query, "query")).strip().rstrip(";").strip()
    if not text:
        raise DeclarationError("query must not be empty")
    return text


@dataclass(frozen=True)
class Checkpoint:
    cursor: str
    primary_key: str
    cursor_type: str = "string"
    primary_key_type: str = "string"

    def __post_init__(self) -> None:
        column(self.cursor, "checkpoint cursor")
        column(self.primary_key, "checkpoint primary key")
        for kind in (self.cursor_type, self.primary_key_type):
            if kind not in CHECKPOINT_KINDS:
                raise DeclarationError(f"unsupported checkpoint kind: {kind!r}")


@dataclass(frozen=True)
class Source:
    name: str
    query: str
    checkpoint: Checkpoint | None = None

    def __post_init__(self) -> None:
        named(self.name, "source name")
        object.__setattr__(self, "query", normalized_query(self.query))

    @property
    def mode(self) -> str:
        return "checkpointed" if self.checkpoint else "snapshot"

    @property
    def identity(self) -> str:
        """Equal for sources that may share one read."""
        check = None if self.checkpoint is None else vars(self.checkpoint)
        return digest({"name": self.name, "query": self.query, "checkpoint": check})


@dataclass(frozen=True)
class StaticTarget:
    value: str

    def __post_init__(self) -> None:
        named(self.value, "static target")


@dataclass(frozen=True)
class Identifier:
    """One column (value) or a list column (values) of partner identifiers of a type."""

    type: str
    value: str | None = None
    values: str | None = None

    def __post_init__(self) -> None:
        named(self.type, "identifier type")
        if (self.value is None) == (self.values is None):
            raise DeclarationError("an identifier takes exactly one of value and values")
        column(self.value or self.values, "identifier")


def _mapping(fields: Mapping[str, str], what: str, required: bool) -> tuple[tuple[str, str], ...]:
    if required and not fields:
        raise DeclarationError(f"{what} must not be empty")
    return tuple(sorted((named(k, what), column(v, what)) for k, v in fields.items()))


@dataclass(frozen=True)
class State:
    """Desired current facts. target is None, a column's name or a StaticTarget."""

    name: str
    source: Source
    key: Mapping[str, str]
    payload: Mapping[str, str] = field(default_factory=dict)
    identifiers: Sequence[Identifier] = ()
    target: str | StaticTarget | None = None

    def __post_init__(self) -> None:
        named(self.name, "state name")
        if self.source.mode != "snapshot":
            raise DeclarationError("a state reads a snapshot source")
        if isinstance(self.target, str):
            column(self.target, "target")
        object.__setattr__(self, "key", dict(_mapping(self.key, "key", True)))
        object.__setattr__(self, "payload", dict(_mapping(self.payload, "payload", False)))


@dataclass(frozen=True)
class Event:
    """Facts that occurred, read in the order of the source's checkpoint."""

    name: str
    source: Source
    key: Mapping[str, str]
    occurred_at: str
    payload: Mapping[str, str] = field(default_factory=dict)
    identifiers: Sequence[Identifier] = ()

    def __post_init__(self) -> None:
        named(self.name, "event name")
        if self.source.checkpoint is None:
            raise DeclarationError("an event reads a checkpointed source")
        column(self.occurred_at, "occurred_at")
        object.__setattr__(self, "key", dict(_mapping(self.key, "key", True)))
        object.__setattr__(self, "payload", dict(_mapping(self.payload, "payload", False)))


@dataclass(frozen=True)
class Sync:
    name: str
    declaration: State | Event
    destination: str
    surface: str
    operations: Sequence[str] = OPERATIONS
    on_failure: str = "stop_on_terminal"

    def __post_init__(self) -> None:
        for x, what in ((self.name, "sync name"), (self.destination, "destination"), (self.surface, "surface")):
            named(x, what)
        if not self.operations or set(self.operations) - set(OPERATIONS):
            raise DeclarationError(f"operations must be some of {OPERATIONS}")
        if self.on_failure not in FAILURE_MODES:
            raise DeclarationError(f"on_failure must be one of {FAILURE_MODES}")

    @property
    def family(self) -> str:
        return "state" if isinstance(self.declaration, State) else "event"

    @property
    def scope(self) -> tuple[str, str, str, str, str]:
        return self.name, self.destination, self.surface, self.family, self.declaration.name


def digest(value: object) -> str:
    """sha256 of the compact JSON text with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def version_of(declaration: State | Event) -> str:
    """An id that changes with anything declared; the query enters as its hash alone."""
    plain = {k: v for k, v in vars(declaration).items() if k != "source"}
    plain["identifiers"] = [vars(i) for i in declaration.identifiers]
    plain["target"] = vars(declaration.target) if isinstance(getattr(declaration, "target", None), StaticTarget) else getattr(declaration, "target", None)
    return digest(plain | {"source": declaration.source.name, "query": hashlib.sha256(declaration.source.query.encode()).hexdigest()})
