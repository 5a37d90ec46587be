"""Settings, read on the driver when a plan is built.

One table says for each setting where it stands in the TOML file, what it becomes, and what
it is otherwise; objects are built from the table.
"""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path
from typing import Any, NamedTuple

from umbra.operators.redact import TEMPLATE

CONFIG_NAMES = ("umbra.toml", ".umbra.toml")
REQUIRED = object()


class Option(NamedTuple):
    """``place``: dotted place in the file. ``convert`` is applied to what stands there, not to the default."""

    name: str
    place: str
    convert: Callable[[Any], Any]
    default: Any = REQUIRED


def _look_up(table: Mapping, place: str) -> Any:
    """What stands at a dotted place, or ``REQUIRED`` where nothing does."""
    for step in place.split("."):
        if not isinstance(table, Mapping) or step not in table:
            return REQUIRED
        table = table[step]
    return table


class Settings:
    """Immutable values of the options of a class; equal if all values are."""

    OPTIONS: tuple[Option, ...] = ()

    def __init__(self, *values: Any, **named: Any):
        named |= dict(zip((o.name for o in self.OPTIONS), values, strict=False))
        unknown = named.keys() - {o.name for o in self.OPTIONS}
        if unknown:
            raise TypeError(f"no such settings: {sorted(unknown)}")
        for o in self.OPTIONS:
            value = named.get(o.name, o.default)
            if value is REQUIRED:
                raise KeyError(o.name)
            object.__setattr__(self, o.name, value)

    def __setattr__(self, name: str, value: Any) -> None:
        raise AttributeError("settings do not change; see but()")

    def _values(self) -> tuple:
        return tuple(getattr(self, o.name) for o in self.OPTIONS)

    def __eq__(self, other: object) -> bool:
        return type(other) is type(self) and other._values() == self._values()

    def __hash__(self) -> int:
        return hash(self._values())

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{o.name}={v!r}' for o, v in zip(self.OPTIONS, self._values(), strict=True))})"

    def __reduce__(self):
        return type(self), self._values()

    def but(self, **changes: Any):
        """The same with some values changed."""
        return type(self)(**{o.name: v for o, v in zip(self.OPTIONS, self._values(), strict=True)} | changes)

    @classmethod
    def from_dict(cls, table: Mapping):
        """From parsed TOML; keys that no option names are ignored, a missing one without a default is a KeyError."""
        found = {o.name: (o, _look_up(table, o.place)) for o in cls.OPTIONS}
        return cls(**{name: o.convert(value) for name, (o, value) in found.items() if value is not REQUIRED})


class CustomRule(Settings):
    """A user's regex rule, in Python's dialect."""

    OPTIONS = (
        Option("name", "name", str), Option("label", "label", str), Option("pattern", "pattern", str),
        Option("confidence", "confidence", float, 0.9), Option("group", "group", int, 0),
    )


class ModelConfig(Settings):
    """An optional model on this machine that proposes spans."""

    OPTIONS = (
        Option("enabled", "enabled", bool, False), Option("model", "model", str, "qwen2.5:3b"),
        Option("host", "host", str, "http://127.0.0.1:11434"), Option("timeout", "timeout", float, 30.0),
    )


class Config(Settings):
    """What to detect, what to leave, and how to write placeholders."""

    OPTIONS = (
        Option("redact_pii", "redact_pii", bool, False),
        Option("enabled_detectors", "enabled_detectors", frozenset, frozenset()),
        Option("disabled_detectors", "disabled_detectors", frozenset, frozenset()),
        Option("allowlist_patterns", "allowlist.patterns", tuple, ()),
        Option("placeholder_template", "placeholder_template", str, TEMPLATE),
        Option("stable_numbering", "stable_numbering", bool, True),
        Option("custom_rules", "rules", lambda rules: tuple(map(CustomRule.from_dict, rules)), ()),
        Option("llm", "llm", ModelConfig.from_dict, ModelConfig()),
    )

    @classmethod
    def load(cls, path: str | Path | None = None, start: str | Path = ".") -> Config:
        """From ``path``, or the nearest file of ``CONFIG_NAMES`` from ``start`` upwards, or the defaults."""
        chosen = Path(path) if path else next(filter(Path.is_file, _candidates(Path(start).resolve())), None)
        return cls.from_dict(tomllib.loads(chosen.read_text(encoding="utf-8"))) if chosen else cls()


def _candidates(folder: Path) -> Iterator[Path]:
    yield from (folder / name for name in CONFIG_NAMES)
    if folder != folder.parent:
        yield from _candidates(folder.parent)
