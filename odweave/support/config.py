"""Configuration records as pydantic models, kept in YAML files."""

from __future__ import annotations

import os
from datetime import datetime
from pathlib import Path
from typing import Self

import yaml
from pydantic import BaseModel


def _pruned(value):
    """A value without Nones, and without collections that are empty then."""
    if isinstance(value, dict):
        items = {k: _pruned(v) for k, v in value.items()}
        return {k: v for k, v in items.items() if v is not None} or None
    if isinstance(value, (list, tuple, set)):
        return [v for v in map(_pruned, value) if v is not None] or None
    return value


class Config(BaseModel):
    """A record that is read from YAML, checked, and written back."""

    @classmethod
    def from_yaml(cls, text: str) -> Self:
        """From YAML text, whose scalars are read as strings and converted by the model."""
        return cls.model_validate(yaml.load(text, Loader=yaml.BaseLoader) or {})

    @classmethod
    def load(cls, path: str | Path) -> Self:
        """From a YAML file."""
        return cls.from_yaml(Path(path).read_text(encoding="utf-8"))

    def to_yaml(self) -> str:
        """As YAML, without values that are unset or None."""
        return yaml.safe_dump(_pruned(self.model_dump(mode="json", exclude_unset=True)) or {}, sort_keys=False)

    def save(self, path: str | Path, comment: str | None = None, dated: bool = True) -> None:
        """Into a file, under a comment."""
        lines = [f"# Written {datetime.now():%Y-%m-%d %H:%M}"] if dated else []
        lines += [f"# {x}" for x in (comment or "").splitlines()]
        Path(path).write_text("\n".join([*lines, self.to_yaml()]), encoding="utf-8")

    @classmethod
    def example(cls, path: str | Path, **values) -> None:
        """A file of all fields: given values, defaults, or whether one is required."""
        rows = {}
        for name, f in cls.model_fields.items():
            default = None if f.is_required() else f.get_default(call_default_factory=True)
            rows[name] = values.get(name, "REQUIRED" if f.is_required() else "OPTIONAL" if default is None else str(default) if isinstance(default, Path) else default)
        Path(path).write_text(yaml.safe_dump(rows, sort_keys=False), encoding="utf-8")


def env_flag(name: str, default: bool) -> bool:
    """An environment variable as true or false; the default if unset or empty."""
    text = os.environ.get(name, "").strip().lower()
    if not text:
        return default
    if text in ("true", "yes", "y", "1"):
        return True
    if text in ("false", "no", "n", "0"):
        return False
    raise ValueError(f"{name} is neither true nor false: {text!r}")
