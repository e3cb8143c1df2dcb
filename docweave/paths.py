"""Paths name tables. A path is a tuple of segments: ``.name``, ``[]`` or ``{}``.

Segments are compared one by one, never as printed text, so a member called
``a.b`` and the member ``b`` of ``a`` are two paths.
"""

from __future__ import annotations

from .errors import Refused

ELEMENT, ENTRY = "[]", "{}"
Path = tuple[str, ...]
ROOT: Path = ()


def member(name: str) -> str:
    return f".{name}"


def shown(path: Path) -> str:
    return "".join(path) or "."


def parsed(text: str) -> Path:
    """The path that a configuration writes as ``.runs[].jobs[]``; a member name ends at ``.``, ``[`` or ``{``."""
    out, at = [], 0
    if text == ".":
        return ROOT
    while at < len(text):
        if text[at:at + 2] in (ELEMENT, ENTRY):
            out.append(text[at:at + 2])
            at += 2
            continue
        end = min((i for c in ".[{" if (i := text.find(c, at + 1)) > 0), default=len(text))
        if text[at] != "." or end == at + 1:
            raise Refused("configuration", text, "not a path")
        out.append(text[at:end])
        at = end
    return tuple(out)


def owner(path: Path) -> Path:
    """The table whose rows hold this one."""
    return path[:-2] if path[-1] in (ELEMENT, ENTRY) else path[:-1]


def holder(path: Path) -> str:
    """The member of the owner that this table comes from."""
    return (path[-2] if path[-1] in (ELEMENT, ENTRY) else path[-1])[1:]


def kind(path: Path) -> str:
    return "root" if not path else {ELEMENT: "element", ENTRY: "entry"}.get(path[-1], "reference")


def order(path: Path) -> tuple:
    """Members before elements before entries, members by name, a prefix first."""
    return tuple((1, "") if s == ELEMENT else (2, "") if s == ENTRY else (0, s) for s in path)
