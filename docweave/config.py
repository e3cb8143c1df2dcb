"""What cannot be inferred: which objects are maps, and names of tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import Refused
from .paths import Path, parsed


@dataclass(frozen=True)
class Config:
    maps: tuple[Path, ...] = ()
    root: str = "root"
    names: dict[Path, str] = field(default_factory=dict)

    @classmethod
    def of(cls, given: dict | None) -> Config:
        given = given or {}
        for key in given:
            if key not in ("maps", "root", "names"):
                raise Refused("configuration", key, "recursive tables are not supported" if key == "recursive" else "unknown key")
        root = given.get("root", "root")
        if not isinstance(root, str) or not root:
            raise Refused("configuration", "root", "a name is needed")
        maps, names = given.get("maps", []), given.get("names", {})
        if not isinstance(maps, (list, tuple)) or not all(isinstance(m, str) for m in maps):
            raise Refused("configuration", "maps", "a list of paths is needed")
        if not isinstance(names, dict) or not all(isinstance(n, str) and n for n in names.values()):
            raise Refused("configuration", "names", "names by path are needed")
        return cls(tuple(parsed(m) for m in maps), root, {parsed(p): n for p, n in names.items()})
