"""What every document says about every table and column, counted.

One pass, whatever the depth: each task walks its documents and counts by
(path, member); the counts, as many rows as the schema has columns, are summed
across tasks - a commutative merge - and only these sums reach the driver. The
JVM parses and refuses. Documents of one form are read into Arrow columns and
counted by these; where columns cannot tell what a document says, it is walked.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from itertools import chain
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..lattice import INT_BOUND
from ..paths import ELEMENT, ENTRY, Path, shown

UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


@dataclass
class Observation:
    types: set[str] = field(default_factory=set)
    values: int = 0
    nulls: int = 0
    big: bool = False

    def merged(self, other: Observation) -> Observation:
        return Observation(self.types | other.types, self.values + other.values, self.nulls + other.nulls, self.big or other.big)


@dataclass
class Table:
    visits: int = 0
    objects: bool = False  # elements or entries that are objects
    scalars: bool = False
    members: dict[str, Observation] = field(default_factory=dict)

    def merged(self, other: Table) -> Table:
        names = {*self.members, *other.members}
        none = Observation()
        return Table(self.visits + other.visits, self.objects or other.objects, self.scalars or other.scalars,
                     {n: self.members.get(n, none).merged(other.members.get(n, none)) for n in sorted(names)})


Tables = dict[Path, Table]


def merged(a: Tables, b: Tables) -> Tables:
    """The observations of two sets of documents together; order does not matter."""
    return {p: a.get(p, Table()).merged(b.get(p, Table())) for p in {*a, *b}}


def tag_of(value: object) -> str:
    """The type of a scalar."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, str):
        return "uuid" if len(value) == 36 and UUID.fullmatch(value) else "str"
    return "int" if isinstance(value, int) and -INT_BOUND <= value <= INT_BOUND else "float"


class Seen:
    """What a task has seen of one table: visits, elements or entries that are objects or scalars, members as [n, nulls, tags, big], and the tables below."""

    def __init__(self, path: Path) -> None:
        self.path, self.visits, self.objects, self.scalars, self.refused = path, 0, False, False, set()
        self.members: dict[str, list] = {}
        self.below: dict[tuple, Seen] = {}

    def under(self, *segments: str) -> Seen:
        found = self.below.get(segments)
        if found is None:
            found = self.below[segments] = Seen((*self.path, *segments))
        return found

    def nodes(self, nodes: list, inner: bool, maps: set[Path], todo: list) -> None:
        """Counts nodes of this table; what lies in them goes to ``todo``, one list a table. Objects of the same members are counted together, member by member."""
        self.visits += len(nodes)
        alike: dict[tuple | None, list] = {}  # objects by their members; other values under None
        for node in nodes:
            shape = tuple(node) if isinstance(node, dict) else None
            if shape in alike:
                alike[shape].append(node)
            else:
                alike[shape] = [node]
        below: dict[tuple, tuple] = {}
        for shape, same in alike.items():
            if shape is None:
                if any(isinstance(x, list) for x in same):
                    self.refused.add("mapEntryNotSupported" if self.path and self.path[-1] == ENTRY else "nestedArray")
                    same = [x for x in same if not isinstance(x, list)]
                if same:
                    self.scalars |= inner
                    self.member("value", same, maps, below)
                continue
            self.objects |= inner
            for name in shape:
                self.member(name, list(map(itemgetter(name), same)), maps, below)
        todo.extend((self.under(*segments), held, deeper) for segments, (held, deeper) in below.items())

    def member(self, name: str, values: list, maps: set[Path], below: dict[tuple, tuple]) -> None:
        """Counts values of one member."""
        said = self.members.get(name)
        if said is None:
            said = self.members[name] = [0, 0, set(), False]
        said[0] += len(values)
        kinds = set(map(type, values))
        for kind in kinds:
            own = values if len(kinds) == 1 else [v for v in values if type(v) is kind]
            if kind is list:
                said[2].add("coll")
                below.setdefault((f".{name}", ELEMENT), ([], True))[0].extend(chain.from_iterable(own))
            elif kind is dict and maps and (*self.path, f".{name}") in maps:
                said[2].add("coll")
                below.setdefault((f".{name}", ENTRY), ([], True))[0].extend(chain.from_iterable(map(dict.values, own)))
            elif kind is dict:
                said[2].add("ref")
                below.setdefault((f".{name}",), ([], False))[0].extend(own)
            else:
                # integers may be too large, and strings of 36 characters uuids; all else has the type of its kind
                apart = min(own) < -INT_BOUND or max(own) > INT_BOUND if kind is int else kind is str and 36 in set(map(len, own))
                tags = set(map(tag_of, own)) if apart else {tag_of(own[0])}
                said[1] += len(own) if kind is type(None) else 0
                said[2] |= tags
                said[3] |= kind is int and "float" in tags and any(INT_BOUND < abs(v) < 10**38 for v in own)  # more digits are a double

    def rows(self) -> Iterator[tuple]:
        """All counts: path, member, n, objects, scalars, nulls, tags, big."""
        todo = [self]
        while todo:
            t = todo.pop()
            todo.extend(t.below.values())
            yield list(t.path), None, t.visits, t.objects, t.scalars, 0, sorted(t.refused), False
            for name, (n, nulls, tags, big) in t.members.items():
                yield list(t.path), name, n, False, False, nulls, sorted(tags), big


#: Characters of documents that are walked together.
CHARS = 1 << 20


def together(texts: list[str]) -> Iterator[list[str]]:
    """Lists of texts of about CHARS characters, or of one longer text."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


class Unusual(Exception):
    """Documents that columns cannot count: they are walked."""


def counts_of(array: pa.Array, path: tuple, inner: bool) -> Iterator[tuple]:
    """(path, member, n, objects, scalars, tags) of objects without nulls, as ``Seen`` counts them; what the reader does not tell apart is unusual."""
    yield path, None, len(array), inner and len(array) > 0, False, ()
    for i, f in enumerate(array.type):
        if (values := array.field(i).drop_null()):
            yield from member_counts(values, path, f.name)


def member_counts(values: pa.Array, path: tuple, name: str) -> Iterator[tuple]:
    type_, n, tags = values.type, len(values), ()
    if pa.types.is_struct(type_):
        tags = ("ref",)
        yield from counts_of(values, (*path, (f".{name}",)), False)
    elif pa.types.is_list(type_):
        tags, held, below = ("coll",), values.flatten(), (*path, (f".{name}", ELEMENT))
        if pa.types.is_struct(held.type):
            yield from counts_of(held, below, True)
        elif pa.types.is_list(held.type) or held.null_count:
            raise Unusual
        else:
            yield below, None, len(held), False, len(held) > 0, ()
            if len(held):
                yield from member_counts(held, below, "value")
    elif pa.types.is_int64(type_):
        ends = pc.min_max(values).as_py()
        if ends["min"] < -INT_BOUND or ends["max"] > INT_BOUND:
            raise Unusual
        tags = ("int",)
    elif pa.types.is_boolean(type_):
        tags = ("bool",)
    elif pa.types.is_string(type_):
        long = values.filter(pc.equal(pc.utf8_length(values), 36)).to_pylist()
        tags = {*map(tag_of, long), *(("str",) if len(long) < n else ())}
    elif pa.types.is_timestamp(type_):  # a string in such a form
        tags = ("str",)
    else:
        raise Unusual
    yield path, name, n, False, False, tags


def by_columns(root: Seen, texts: list[str]) -> bool:
    """Counts documents read into columns. False, with nothing counted, where these cannot tell what a walk can: nulls from absent members, fractions, values of several types."""
    data = "\n".join(texts).encode("utf-8", "surrogatepass")
    if b"null" in data or len(data) >= 1 << 30:
        return False
    try:
        read = pj.read_json(pa.BufferReader(data), pj.ReadOptions(use_threads=False, block_size=len(data) + 1))
        if read.num_rows != len(texts) or not read.num_columns:
            return False
        found = [c for b in read.to_batches() for c in counts_of(pa.StructArray.from_arrays(b.columns, fields=list(b.schema)), (), False)]
    except (pa.ArrowException, Unusual):
        return False
    for path, member, n, objects, scalars, tags in found:
        table = root
        for segments in path:
            table = table.under(*segments)
        if member is None:
            table.visits += n
            table.objects |= objects
            table.scalars |= scalars
        else:
            said = table.members.setdefault(member, [0, 0, set(), False])
            said[0] += n
            said[2].update(tags)
    return True


def number(text: str) -> int | float:
    """A number with a fraction or exponent as Spark's parser knows it: up to 38 digits without an exponent it is a decimal, and an integer if nothing follows the point."""
    if "e" not in text and "E" not in text:
        _, digits, exponent = (d := Decimal(text)).as_tuple()
        if len(digits) <= 38 and -exponent <= 38 and d == d.to_integral_value():
            return int(d)
    return float(text)


def value_of(text: str) -> object:
    """The value of a document's own text, with numbers as Spark's parser knows them."""
    return json.loads(text, parse_float=number)


def counted(corpus: DataFrame, maps: tuple[Path, ...]) -> DataFrame:
    """path, member, n, objects, scalars, nulls, tags, big: what each task has seen, as many rows as the schema has columns.

    Documents come as their own texts once these are parsed, or else, as with escapes by number, as what the parser writes.
    """
    schema = "path array<string>, member string, n long, objects boolean, scalars boolean, nulls long, tags array<string>, big boolean"
    types = [pa.list_(pa.string()), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.bool_()]

    def walk(root: Seen, values: list, marked: set[Path]) -> None:
        todo: list = [(root, values, False)]
        while todo:
            table, nodes, inner = todo.pop()
            table.nodes(nodes, inner, marked, todo)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, marked = Seen(()), set(maps)
        for b in batches:
            for column, load in ((b.column(0), value_of), (b.column(1), json.loads)):
                for some in together(column.drop_null().to_pylist()):
                    if marked or not by_columns(root, some):
                        walk(root, list(map(load, some)), marked)
        if root.visits:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*root.rows(), strict=True), types, strict=True)], names=["path", "member", "n", "objects", "scalars", "nulls", "tags", "big"])

    text = F.col("text") if "text" in corpus.columns else F.lit(None).cast("string")
    own = F.when(F.col("doc").isNotNull() & ~F.contains(text, F.lit("\\u")), text)
    return corpus.select("doc", own.alias("own")).select("own", F.when(F.col("own").isNull(), F.to_json("doc")).alias("written")).mapInArrow(walked, schema)


def gathered(rows: DataFrame) -> Tables:
    """The observations in rows of ``counted``, which may come from several runs of it."""
    sums = rows.groupBy("path", "member").agg(F.sum("n").alias("n"), F.max("objects").alias("objects"), F.max("scalars").alias("scalars"), F.sum("nulls").alias("nulls"), F.array_distinct(F.flatten(F.collect_set("tags"))).alias("tags"), F.max("big").alias("big"))
    out: Tables = {}
    for r in sorted(sums.collect(), key=lambda r: (r["path"], r["member"] or "")):  # a row for each column of the schema
        path, tags = tuple(r["path"]), set(r["tags"])
        for refused in ("nestedArray", "mapEntryNotSupported"):
            if refused in tags:
                raise Refused(refused, shown(path))
        table = out.setdefault(path, Table())
        if r["member"] is None:
            table.visits += r["n"]
            table.objects |= r["objects"]
            table.scalars |= r["scalars"]
        else:
            table.members[r["member"]] = Observation(tags - {"null"}, r["n"] - r["nulls"], r["nulls"], r["big"])
    return out


def observed(corpus: DataFrame, maps: tuple[Path, ...] = ()) -> Tables:
    """Observations of all documents, in one job."""
    return gathered(counted(corpus, maps))
