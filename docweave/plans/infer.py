"""From observations to a schema: collapse, refusals, nullability, report."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..errors import Refused
from ..lattice import join_all
from ..operators.observe import Observation, Table, Tables, merged, observed
from ..paths import ELEMENT, ENTRY, Path, member, order, shown


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool
    values: int
    nulls: int
    absent: int
    big: bool
    widened: bool

    @property
    def never_typed(self) -> bool:
        return self.type == "bot"


@dataclass(frozen=True)
class Inference:
    tables: dict[Path, tuple[Column, ...]]
    visits: dict[Path, int]
    config: Config
    collapsed: frozenset[Path]

    def columns_frame(self, spark: SparkSession) -> DataFrame:
        """The report as rows: one a column."""
        rows = [(shown(p), c.name, c.type, c.nullable, self.visits[p], c.values, c.nulls, c.absent, c.widened, c.big) for p, cs in self.tables.items() for c in cs]
        return spark.createDataFrame(rows, "table_path string, column_name string, type string, nullable boolean, visits long, n_values long, nulls long, absent long, widened boolean, big boolean")


def collapse_points(tables: Tables) -> list[Path]:
    """Members that are an object in some documents and an array of objects in others."""
    return sorted((p for p in tables if p and p[-1] not in (ELEMENT, ENTRY) and (many := tables.get((*p, ELEMENT))) and many.objects and not many.scalars), key=order)


def moved(path: Path, point: Path) -> Path:
    """A path after what stood at ``point`` became its elements."""
    if path[:len(point)] == point and path[len(point):len(point) + 1] not in ((ELEMENT,), (ENTRY,)):
        return (*point, ELEMENT, *path[len(point):])
    return path


def collapsed(tables: Tables, maps: tuple[Path, ...]) -> tuple[Tables, tuple[Path, ...], frozenset[Path]]:
    """A lone object is an array of one: rewritten until nothing is left to, shallow points first."""
    done: set[Path] = set()
    while points := collapse_points(tables):
        point = min(points, key=len)
        out: Tables = {}
        for path, table in tables.items():
            to = moved(path, point)
            out[to] = out[to].merged(table) if to in out else table
        up, name = point[:-1], point[-1][1:]
        held = out[up].members[name]
        out[up] = replace(out[up], members=out[up].members | {name: Observation(held.types - {"ref"} | {"coll"}, held.values, held.nulls, held.big)})
        many = out[(*point, ELEMENT)]
        out[(*point, ELEMENT)] = replace(many, objects=True)
        tables, maps = out, tuple(moved(m, point) for m in maps)
        done = {moved(d, point) for d in done} | {point}
    return tables, maps, frozenset(done)


def settled(tables: Tables, config: Config = Config()) -> Inference:  # noqa: B008
    """Refusals are raised in a fixed order: conflicts, mixed elements, markings without a match."""
    tables, maps, points = collapsed(tables, config.maps)
    paths = sorted(tables, key=order)
    for p in paths:
        for name, o in sorted(tables[p].members.items()):
            if join_all(o.types) is None:
                raise Refused("typeConflict", shown((*p, member(name))), ", ".join(sorted(o.types)))
            if o.types == {"coll"} and (*p, member(name), ELEMENT) in tables and (*p, member(name), ENTRY) in tables:
                raise Refused("typeConflict", shown((*p, member(name))), "map, array")
    for p in paths:
        if tables[p].objects and tables[p].scalars:
            raise Refused("mixedElements", shown(p))
    for m in maps:
        if (*m, ENTRY) not in tables:
            raise Refused("markingMatchedNothing", shown(m))
    out = {}
    for p in paths:
        t = tables[p]
        columns = []
        for name, o in sorted(t.members.items()):
            absent = t.visits - o.values - o.nulls
            if absent < 0:
                raise AssertionError(f"{shown(p)}: {name} was seen more often than its table")
            columns.append(Column(name, join_all(o.types) or "bot", o.nulls + absent > 0, o.values, o.nulls, absent, o.big, {"int", "float"} <= o.types))
        out[p] = tuple(columns)
    by_depth = sorted(out, key=lambda p: (-len(p), shown(p)))
    return Inference({p: out[p] for p in by_depth}, {p: tables[p].visits for p in by_depth}, replace(config, maps=maps), points)


def infer(corpus: DataFrame, config: dict | Config | None = None) -> Inference:
    """The schema of a corpus, from every document of it."""
    config = config if isinstance(config, Config) else Config.of(config)
    tables = observed(corpus, config.maps)
    return settled(tables or {(): Table()}, config)


def infer_parts(parts: list[Tables], config: dict | None = None) -> Inference:
    """The schema of a corpus that was observed in parts, in any order."""
    out: Tables = {}
    for t in parts:
        out = merged(out, t)
    return settled(out, Config.of(config))
