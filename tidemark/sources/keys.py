"""Keys: frozen dataclasses of int and str fields that name datasets, and their strings and paths.

Fields of a level are joined by the level's separator; a last field may be a key of the next level, which in a path is a
folder below and in a string follows after the separator.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, fields
from typing import get_type_hints

_MARK = "__key_level__"
SEPARATOR = "-"


def _is_level(kind) -> bool:
    return isinstance(kind, type) and getattr(kind, _MARK, None) is not None


def is_toplevel(x) -> bool:
    """Whether a class, or the class of an object, is a top-level key."""
    return getattr(x if isinstance(x, type) else type(x), _MARK, None) == "top"


def _spec(cls) -> list[tuple[str, type]]:
    hints = get_type_hints(cls, localns=_SEEN)
    return [(f.name, hints[f.name]) for f in fields(cls)]


_SEEN: dict[str, type] = {}


def _check_class(cls) -> None:
    spec = _spec(cls)
    for i, (name, kind) in enumerate(spec):
        if _is_level(kind):
            if i != len(spec) - 1:
                raise TypeError(f"the sub-level {name!r} of {cls.__name__} must be its last field")
            if len(spec) == 1:
                raise TypeError(f"{cls.__name__} needs a field besides its sub-level {name!r}")
            if getattr(kind, _MARK) == "top":
                raise TypeError(f"{name!r} must be a sub-level, not a top level")
        elif kind not in (int, str):
            raise TypeError(f"field {name!r} of {cls.__name__} must be int, str or a sub-level")


def _check_value(key, separator: str) -> None:
    for name, kind in _spec(type(key)):
        value = getattr(key, name)
        if not isinstance(value, kind) or isinstance(value, bool):
            raise TypeError(f"{name} must be {kind.__name__}, not {type(value).__name__}")
        if _is_level(kind):
            _check_value(value, separator)
        elif any(c in str(value) for c in {separator, ".", "/"}):
            raise ValueError(f"{name} must not contain {separator!r}, '.' or '/': {value!r}")


def _parts(key) -> list[list[str]]:
    """The fields as strings, a list for each level."""
    own, rest = [], []
    for name, kind in _spec(type(key)):
        value = getattr(key, name)
        if _is_level(kind):
            rest = _parts(value)
        else:
            own.append(str(value))
    return [own, *rest]


def _build(cls, parts: list[list[str]]):
    """A key from its parts; None if they don't fit."""
    spec = _spec(cls)
    nested = spec and _is_level(spec[-1][1])
    plain = spec[:-1] if nested else spec
    if not parts or len(parts[0]) != len(plain) or (len(parts) > 1) != bool(nested):
        return None
    values = []
    for (_, kind), text in zip(plain, parts[0], strict=True):
        try:
            values.append(kind(text))
        except ValueError:
            return None
    if nested:
        below = _build(spec[-1][1], parts[1:])
        if below is None:
            return None
        values.append(below)
    try:
        return cls(*values)
    except (TypeError, ValueError):
        return None


def _widths(cls) -> list[int]:
    spec = _spec(cls)
    if spec and _is_level(spec[-1][1]):
        return [len(spec) - 1, *_widths(spec[-1][1])]
    return [len(spec)]


def sublevel(cls):
    """Makes a class a level below others."""
    own = dataclass(order=True, frozen=True)(cls)
    setattr(own, _MARK, "sub")
    _SEEN[own.__name__] = own
    _check_class(own)
    return own


class _Top:
    """What top-level keys can do."""

    def __str__(self) -> str:
        return self.field_sep.join(p for level in _parts(self) for p in level)

    def to_path(self) -> str:
        return "/".join(self.field_sep.join(level) for level in _parts(self))

    @classmethod
    def from_path(cls, path: str):
        """The key of a path, or None where it is none."""
        return _build(cls, [level.split(cls.field_sep) for level in str(path).strip("/").split("/")])

    @classmethod
    def from_str(cls, text: str):
        """The key of a string, or None where it is none."""
        parts, levels = text.split(cls.field_sep), []
        for width in _widths(cls):
            levels.append(parts[:width])
            parts = parts[width:]
        return None if parts else _build(cls, levels)

    def __reduce__(self):
        return type(self), tuple(getattr(self, f.name) for f in dataclasses.fields(self))


def toplevel(cls=None, *, field_sep: str = SEPARATOR):
    """Makes a class a key: frozen, ordered, hashable, with str(), to_path(), from_str(), from_path(), depth and field_sep."""

    def made(own):
        own = dataclass(order=True, frozen=True)(own)
        for name, value in vars(_Top).items():
            if name in ("__str__", "to_path", "from_path", "from_str", "__reduce__"):
                setattr(own, name, value)
        own.field_sep = field_sep
        setattr(own, _MARK, "top")
        _SEEN[own.__name__] = own
        _check_class(own)
        own.depth = len(_widths(own))
        first = own.__init__

        def init(self, *args, **kwargs):
            first(self, *args, **kwargs)
            _check_value(self, field_sep)

        own.__init__ = init
        return own

    if len(field_sep) != 1 or field_sep in "/":
        raise ValueError("the field separator is one character, not '/'")
    return made if cls is None else made(cls)
