"""The relational layout of a schema: names, keys, columns, DDL, order."""

from __future__ import annotations

import graphlib
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import types as T

from ..errors import Refused
from ..lattice import SPARK, SQL
from ..paths import ELEMENT, ENTRY, Path, kind, owner, shown
from .infer import Inference

#: Words that cannot be names in a strict target language.
KEYWORDS = frozenset("and as assert begin class constraint do done downto else end exception external false for fun function functor if in include inherit initializer lazy let match method module mutable new nonrec object of open or private rec sig struct then to true try type val virtual when while with".split())


def mangled(name: str, fold: bool = False) -> str:
    """A name of letters, digits and ``'`` that starts in lower case, is no keyword, and differs for different names; with ``fold`` also without regard to case."""
    out = "".join(chr(b) if chr(b).isalnum() and b < 128 and not (fold and 65 <= b <= 90) or b == 39 else f"_{b:02x}" for b in name.encode())
    if not re.match("[a-z]", out):
        out = f"f__{out}"
    return f"{out}_" if out in KEYWORDS else out


@dataclass(frozen=True)
class Field:
    name: str
    type: str  # storage tag
    nullable: bool
    role: str  # key, parent, position or member
    source: str | None = None  # the member it holds
    refers: Path | None = None


@dataclass(frozen=True)
class TableLayout:
    path: Path
    name: str
    fields: tuple[Field, ...]
    minted: bool

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, SPARK[f.type], f.nullable, {"role": f.role} | ({"refers": shown(f.refers)} if f.refers is not None else {}) | ({"semantic": "uuid"} if f.type == "uuid" else {})) for f in self.fields])


@dataclass(frozen=True)
class Layout:
    tables: dict[Path, TableLayout]
    inference: Inference

    def by_name(self) -> dict[str, TableLayout]:
        return {t.name: t for t in self.tables.values()}

    def ordered(self) -> list[TableLayout]:
        """Tables after those that they refer to; ties by name."""
        sorter = graphlib.TopologicalSorter({t.path: sorted({f.refers for f in t.fields if f.refers is not None}) for t in self.tables.values()})
        sorter.prepare()
        out = []
        while sorter.is_active():
            ready = sorted(sorter.get_ready(), key=lambda p: self.tables[p].name)
            out += [self.tables[p] for p in ready]
            sorter.done(*ready)
        return out

    def ddl(self) -> str:
        def column(f: Field) -> str:
            return f'  "{f.name}" {SQL[f.type]}' + ("" if f.nullable else " not null") + (" primary key" if f.role == "key" else "")
        return "\n".join(f'create table "{t.name}" (\n' + ",\n".join(map(column, t.fields)) + "\n);" for t in self.ordered())

    def constraints(self) -> str:
        return "\n".join(f'alter table "{t.name}" add foreign key ("{f.name}") references "{self.tables[f.refers].name}" ("id");\ncreate index on "{t.name}" ("{f.name}");'
                         for t in self.ordered() for f in t.fields if f.refers is not None)

    def described(self) -> str:
        return "\n".join(f"{t.name}: " + ", ".join(f"{f.name} {f.type}{'?' * f.nullable}" + (f" -> {self.tables[f.refers].name}" if f.refers is not None else "") for f in t.fields) for t in self.ordered())

    def schema_json(self) -> dict[str, str]:
        return {t.name: t.struct().json() for t in self.ordered()}


def names_of(inference: Inference) -> dict[Path, str]:
    """A given name (one for ``.runs`` holds for ``.runs[]`` too), or else the member names on the way."""
    given = inference.config.names
    out = {}
    for p in inference.tables:
        bare = p[:-1] if p and p[-1] in (ELEMENT, ENTRY) else p
        out[p] = given.get(p) or given.get(bare) or ("_".join(s[1:] for s in p if s[0] == ".") if p else inference.config.root)
    seen: dict[str, Path] = {}
    for p, n in out.items():
        if n.lower() in seen:  # Spark resolves names without regard to case
            raise Refused("tableNameClash", shown(p), n)
        seen[n.lower()] = p
    return out


def laid_out(inference: Inference) -> Layout:
    names = names_of(inference)
    keys: dict[Path, tuple[str, bool]] = {}
    for p, columns in inference.tables.items():
        own = next((c for c in columns if c.name == "id"), None)
        if own is not None and (own.nullable or own.type in ("ref", "coll", "bot")):
            raise Refused("unusableKey", shown(p), f"{own.type}, {own.nulls} null, {own.absent} absent")
        keys[p] = (own.type, False) if own else ("uuid", True)
    tables = {}
    for p, columns in inference.tables.items():
        fields = [Field("id", keys[p][0], False, "key", None if keys[p][1] else "id")]
        if kind(p) in ("element", "entry"):
            fields.append(Field(f"{names[owner(p)]}_id", keys[owner(p)][0], False, "parent", None, owner(p)))
            fields.append(Field("key", "str", False, "position") if kind(p) == "entry" else Field("idx", "int", False, "position"))
        taken = {f.name.lower() for f in fields}
        held = [c for c in columns if c.name != "id" and c.type != "coll"]
        alike = Counter(c.name.lower() for c in held)
        for c in held:
            # Spark and SQL know names without regard to case: of members that differ in nothing else, those with capitals are spelled out
            name = mangled(c.name, fold=True) if alike[c.name.lower()] > 1 and c.name != c.name.lower() else c.name
            if name.lower() in taken:
                raise Refused("reservedColumnName", shown(p), c.name)
            taken.add(name.lower())
            target = (*p, f".{c.name}") if c.type == "ref" else None
            fields.append(Field(name, keys[target][0] if target else c.type, c.nullable, "member", c.name, target))
        tables[p] = TableLayout(p, names[p], tuple(fields), keys[p][1])
    layout = Layout(tables, inference)
    validated(layout)
    return layout


def validated(layout: Layout) -> None:
    """Parents and targets exist, every table is reached from the root, and none refers to a table that holds it."""
    for t in layout.tables.values():
        above, at = [], t.path
        while at:
            at = owner(at)
            above.append(at)
            if at not in layout.tables:
                raise Refused("invalidSchema", shown(t.path), "a table without its parent")
        for f in t.fields:
            if f.refers is not None and f.refers not in layout.tables:
                raise Refused("invalidSchema", f"{t.name}.{f.name}", "a reference to no table")
            if f.role == "member" and f.refers in above:
                raise Refused("invalidSchema", f"{t.name}.{f.name}", "contained by and referring to one table")
