"""Column roles: what a column means to a feature pipeline."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from typing import Any


@dataclass(frozen=True)
class Role:
    """``name`` and the attributes that operators read; attributes that don't apply stay at their defaults."""

    name: str
    dtype: str = "double"
    prob: bool = False
    discretization: bool = False
    force_input: bool = False
    unknown: int = 5
    encoding: str = "auto"
    ordinal: bool = False
    label_encoded: bool = False
    max_score_loss: float = 0.0
    format: str | None = None
    unit: str | None = None
    origin: str | None = None
    seasonality: tuple[str, ...] = ("y", "m", "wd")
    base_date: bool = False
    country: str | None = None
    lang: str = "en"
    seq_name: str | None = None
    extra: dict[str, Any] = field(default_factory=dict, compare=False, hash=False)

    def with_(self, **changes: Any) -> Role:
        return replace(self, **changes)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def numeric(**k: Any) -> Role:
    return Role("numeric", **k)


def category(**k: Any) -> Role:
    return Role("category", **({"dtype": "string"} | k))


def text(**k: Any) -> Role:
    return Role("text", **({"dtype": "string"} | k))


def datetime(**k: Any) -> Role:
    return Role("datetime", **({"dtype": "timestamp"} | k))


#: role names and their short forms, by which a declaration may call them (fixed values)
NAMES = {
    "target": "target", "numeric": "numeric", "category": "category", "datetime": "datetime", "text": "text", "path": "path", "group": "group",
    "drop": "drop", "id": "id", "folds": "folds", "weights": "weights", "treatment": "treatment", "array": "array",
    "n": "numeric", "c": "category", "d": "datetime", "t": "text",
}
DTYPES = {"category": "string", "text": "string", "path": "string", "datetime": "timestamp"}


def make(role: str | Role) -> Role:
    if isinstance(role, Role):
        return role
    name = NAMES[role.lower()]
    return Role(name, dtype=DTYPES.get(name, "double"))


def parse(declared: dict) -> dict[str, Role]:
    """column -> role, from {column: role} or {role: column or columns}, in any mixture."""
    found: dict[str, Role] = {}
    for key, value in declared.items():
        if isinstance(key, Role) or (isinstance(key, str) and key.lower() in NAMES and not isinstance(value, Role) and not (isinstance(value, str) and value.lower() in NAMES)):
            for column in [value] if isinstance(value, str) else value:
                found[column] = make(key)
        else:
            found[key] = make(value)
    return found


def columns(roles: dict[str, Role], name: str, **attributes: Any) -> list[str]:
    """Columns of a role whose attributes have the values given, sorted by name."""
    return sorted(c for c, r in roles.items() if r.name == name and all(getattr(r, k) == v for k, v in attributes.items()))
