"""Settings: defaults, then a file, then the environment, then arguments."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from typing import Any

PREFIX = "QUILLFRAME_"


@dataclass(frozen=True)
class Field:
    name: str
    default: Any = None
    required: bool = False
    choices: tuple = ()
    low: float | None = None
    high: float | None = None

    def check(self, value: Any) -> None:
        if value is None:
            if self.required:
                raise ValueError(f"{self.name} is required")
            return
        if self.choices and value not in self.choices:
            raise ValueError(f"{self.name} must be one of {self.choices}")
        if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
            raise ValueError(f"{self.name} must be from {self.low} to {self.high}")


FIELDS = (
    Field("locale", "es_ES"), Field("threshold", 0.85, low=0, high=1), Field("strategy", "redact", choices=tuple("mask replace hash redact generalize pseudonymize suppress".split())),
    Field("seed", 0), Field("format", "parquet", choices=("parquet", "csv", "json", "text", "orc")), Field("min_confidence", 0.0, low=0, high=1),
)


def flat(tree: dict, prefix: str = "") -> dict[str, Any]:
    """Nested keys joined by dots."""
    out: dict[str, Any] = {}
    for k, v in tree.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def read_file(path: str) -> dict[str, Any]:
    """JSON, TOML or (where the library is there) YAML. Files that can't be read are an error."""
    with open(path, "rb") as f:
        if path.endswith(".toml"):
            import tomllib

            return flat(tomllib.load(f))
        if path.endswith((".yml", ".yaml")):
            import yaml

            return flat(yaml.safe_load(f) or {})
        return flat(json.load(f))


def typed(text: str) -> Any:
    """What a text from the environment stands for."""
    low = text.strip().lower()
    if low in ("true", "yes", "on"):
        return True
    if low in ("false", "no", "off"):
        return False
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return json.loads(text) if text[:1] in "[{" else text


class Config:
    def __init__(self, fields: tuple[Field, ...] = FIELDS, file: str | None = None, environment: dict[str, str] | None = None, **arguments):
        env = os.environ if environment is None else environment
        self.fields = {f.name: f for f in fields}
        self._values = {f.name: f.default for f in fields}
        if file:
            self._values |= read_file(file)
        self._values |= {k[len(PREFIX) :].lower().replace("__", "."): typed(v) for k, v in env.items() if k.startswith(PREFIX)}
        self._values |= {k: v for k, v in arguments.items() if v is not None}

    def get(self, name: str, default: Any = None) -> Any:
        v = self._values.get(name)
        return default if v is None else v

    def set(self, name: str, value: Any) -> None:
        self._values[name] = value

    def require(self, name: str) -> Any:
        if self._values.get(name) is None:
            raise KeyError(name)
        return self._values[name]

    def all(self) -> dict[str, Any]:
        return dict(self._values)

    def validate(self) -> "Config":
        for f in self.fields.values():
            f.check(self._values.get(f.name))
        return self

    def copy(self) -> "Config":
        return Config(tuple(self.fields.values()), environment={}, **self._values)


def sample() -> str:
    """A file with all settings at their defaults."""
    return json.dumps({f.name: f.default for f in FIELDS}, indent=2)
