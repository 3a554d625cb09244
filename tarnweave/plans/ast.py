"""Stored queries: the expression tree and its JSON form."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from .regex import to_java


class QueryError(ValueError):
    """A stored query that can't be decoded."""


@dataclass(frozen=True)
class Text:
    """The literal as a whole word; case-sensitive, on text that is lower-cased."""

    text: str

    def to_dict(self) -> dict[str, Any]:
        return {"type": "text", "text": self.text}

    def __str__(self) -> str:
        return f'"{self.text}"'


@dataclass(frozen=True)
class AnyOf:
    """The first literal of the list, in its order, that matches as a whole word."""

    items: tuple[str, ...]

    def to_dict(self) -> dict[str, Any]:
        return {"type": "list", "list": list(self.items)}

    def __str__(self) -> str:
        return f"List[{len(self.items)}]"


@dataclass(frozen=True)
class Regexp:
    """An unanchored, case-insensitive pattern in RE2 syntax; one match counts."""

    pattern: str

    def __post_init__(self) -> None:
        if not self.pattern:
            raise QueryError("an empty regexp isn't allowed")
        to_java(self.pattern)

    def to_dict(self) -> dict[str, Any]:
        return {"type": "regexp", "regexp": self.pattern}

    def __str__(self) -> str:
        return "(?i)" + self.pattern


@dataclass(frozen=True)
class Operator:
    """AND or OR of two expressions, evaluated left to right."""

    operator: str
    first: Expression
    last: Expression

    def __post_init__(self) -> None:
        if self.operator not in ("AND", "OR"):
            raise QueryError(f"invalid operator {self.operator!r}")

    def to_dict(self) -> dict[str, Any]:
        return {"type": "operator", "operator": self.operator, "first": self.first.to_dict(), "last": self.last.to_dict()}

    def __str__(self) -> str:
        return f"({self.first} {self.operator} {self.last})"


Expression = Text | AnyOf | Regexp | Operator


@dataclass(frozen=True)
class Query:
    name: str
    root: Expression
    id: str | None = None
    created_on: datetime = field(default_factory=lambda: datetime.now(UTC))

    def to_json(self) -> str:
        out: dict[str, Any] = {"name": self.name, "createdOn": self.created_on.isoformat(), "root": self.root.to_dict()}
        if self.id:
            out["_id"] = self.id
        return json.dumps(out, ensure_ascii=False)

    def __str__(self) -> str:
        return str(self.root)


def both(first: Expression, last: Expression) -> Operator:
    return Operator("AND", first, last)


def either(first: Expression, last: Expression) -> Operator:
    return Operator("OR", first, last)


def _need(raw: Any, kind: type, what: str) -> Any:
    if not isinstance(raw, kind):
        raise QueryError(f"{what} must be a {kind.__name__}")
    return raw


def expression(raw: Any) -> Expression:
    """Decode an expression; objects without a known ``type`` are refused."""
    raw = _need(raw, dict, "an expression")
    kind = raw.get("type")
    if kind == "text":
        return Text(_need(raw.get("text", ""), str, "text"))
    if kind == "list":
        return AnyOf(tuple(_need(x, str, "a list item") for x in _need(raw.get("list") or [], list, "list")))
    if kind == "regexp":
        return Regexp(_need(raw.get("regexp", ""), str, "regexp"))
    if kind == "operator":
        if any(raw.get(k) is None for k in ("operator", "first", "last")):
            raise QueryError("operator, first and last must be set")
        return Operator(_need(raw["operator"], str, "operator"), expression(raw["first"]), expression(raw["last"]))
    raise QueryError("missing type" if kind is None else f"invalid type {kind!r}")


def query(raw: Any) -> Query:
    """Decode a stored query: name and root are mandatory, _id (24 hex digits) and createdOn optional."""
    raw = _need(raw, dict, "a query")
    if raw.get("name") is None or raw.get("root") is None:
        raise QueryError("name and root must be set")
    ident = raw.get("_id")
    if ident is not None and not re.fullmatch("[0-9a-fA-F]{24}", _need(ident, str, "_id")):
        raise QueryError("_id must be 24 hex digits")
    more = {"created_on": datetime.fromisoformat(raw["createdOn"])} if raw.get("createdOn") is not None else {}
    return Query(_need(raw["name"], str, "name"), expression(raw["root"]), ident, **more)


def query_set(text: str) -> list[Query]:
    """Decode a JSON array of stored queries."""
    return [query(x) for x in _need(json.loads(text), list, "a query set")]
