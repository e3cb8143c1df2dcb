"""One workload over three forms of a corpus: raw text, nested records, flat tables.

The corpus has four levels: roots hold collections, these hold collections, and
these hold leaves with a measure and a rate. All three stores answer the same
questions as DataFrames of the same columns, and must agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Levels:
    """Names of a corpus' four levels and of the members that the workload reads."""

    tables: tuple[str, str, str, str]
    members: tuple[str, str, str]  # the collection of each of the first three
    org: str
    group: str
    measure: str
    rate: str
    root_id: str = "id"
    key: str = "bigint"  # type of the root's id

    def record(self, *leaf: str) -> str:
        """The nested type of a document, of what the workload reads, or of these members of its leaves."""
        types = {self.group: "string", self.measure: "bigint", self.rate: "double"}
        leaf = "struct<" + ",".join(f"{n}:{types[n]}" for n in leaf or types) + ">"
        c1, c2, c3 = self.members
        return f"struct<{self.root_id}:{self.key},{self.org}:string,{c1}:array<struct<{c2}:array<struct<{c3}:array<{leaf}>>>>>>"


class Store(Protocol):
    """The plug-in point: whatever answers these can take part."""

    def document(self, id_: object) -> DataFrame: ...
    def scan(self, over: int) -> DataFrame: ...
    def computed(self, over: int) -> DataFrame: ...
    def by_name(self) -> DataFrame: ...
    def three_hop(self, org: str) -> DataFrame: ...


def counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


class Nested:
    """Documents as nested records; leaves are reached by exploding, and counts by sizes."""

    def __init__(self, records: DataFrame, levels: Levels) -> None:
        self.records, self.levels = records, levels

    def many(self, value: Column, member: str) -> Column:
        """A collection's items; absent or null is empty."""
        return F.coalesce(value[member], F.array())

    def leaves(self, records: DataFrame | None = None) -> DataFrame:
        c1, c2, c3 = self.levels.members
        df = (self.records if records is None else records).select(F.explode(f"d.{c1}").alias("a"))
        return df.select(F.explode(f"a.{c2}").alias("b")).select(F.explode(f"b.{c3}").alias("leaf")).select("leaf.*")

    def document(self, id_: object) -> DataFrame:
        c1, c2, c3 = self.levels.members
        one = self.records.where(F.col(f"d.{self.levels.root_id}") == F.lit(id_))
        first = self.many(F.col("d"), c1)
        second = F.flatten(F.transform(first, lambda x: self.many(x, c2)))
        third = F.flatten(F.transform(second, lambda x: self.many(x, c3)))
        total = F.aggregate(third, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[self.levels.measure], F.lit(0).cast("long")))
        return one.select(*[F.size(c).cast("long").alias(f"n{i + 1}") for i, c in enumerate((first, second, third))], total.alias("total"))

    def scan(self, over: int) -> DataFrame:
        return counted(self.leaves().where(F.col(self.levels.measure) > over))

    def computed(self, over: int) -> DataFrame:
        return computed(self.leaves(), self.levels, over)

    def by_name(self) -> DataFrame:
        return by_name(self.leaves(), self.levels)

    def three_hop(self, org: str) -> DataFrame:
        return total(self.leaves(self.records.where(F.col(f"d.{self.levels.org}") == org)), self.levels)


class Raw:
    """Documents as text, parsed again by every query, which reads only the members it asks for.

    A text that is not JSON, or has other types, fails the query. What follows a value, and repeated
    members, are for inference to refuse.
    """

    def __init__(self, texts: DataFrame, levels: Levels, column: str = "value") -> None:
        self.texts, self.levels, self.column = texts, levels, column

    def nested(self, *leaf: str) -> Nested:
        record = F.from_json(self.column, self.levels.record(*leaf), {"mode": "FAILFAST"})
        return Nested(self.texts.select(record.alias("d")), self.levels)

    def document(self, id_: object) -> DataFrame:
        return self.nested(self.levels.measure).document(id_)

    def scan(self, over: int) -> DataFrame:
        return self.nested(self.levels.measure).scan(over)

    def computed(self, over: int) -> DataFrame:
        return self.nested(self.levels.measure, self.levels.rate).computed(over)

    def by_name(self) -> DataFrame:
        return self.nested(self.levels.group, self.levels.measure).by_name()

    def three_hop(self, org: str) -> DataFrame:
        return self.nested(self.levels.measure).three_hop(org)


class Flat:
    """One table a level, joined by keys."""

    def __init__(self, tables: dict[str, DataFrame], levels: Levels) -> None:
        self.levels = levels
        self.root, self.first, self.second, self.leaf = (tables[t] for t in levels.tables)

    def up(self, level: int) -> str:
        return f"{self.levels.tables[level - 1]}_id"

    def document(self, id_: object) -> DataFrame:
        r = self.root.where(F.col("id") == F.lit(id_)).select(F.col("id").alias("r"))
        # what one document holds is broadcast from level to level, so the tables below are read and not shuffled
        a = self.first.where(F.col(self.up(1)) == F.lit(id_)).select(F.col("id").alias("a"), F.col(self.up(1)).alias("r1"))
        b = self.below(self.second, self.up(2), a.select(F.col("a").alias("id")), few=True).select(F.col("id").alias("b"), F.col(self.up(2)).alias("a1"))
        c = self.below(self.leaf, self.up(3), b.select(F.col("b").alias("id")), few=True).select(F.col("id").alias("c"), F.col(self.up(3)).alias("b1"), F.col(self.levels.measure).alias("m"))
        df = r.join(a, F.col("r") == F.col("r1"), "left").join(b, F.col("a") == F.col("a1"), "left").join(c, F.col("b") == F.col("b1"), "left")
        return df.groupBy("r").agg(F.countDistinct("a").alias("n1"), F.countDistinct("b").alias("n2"), F.count("c").alias("n3"), F.coalesce(F.sum("m"), F.lit(0)).alias("total")).drop("r")

    def scan(self, over: int) -> DataFrame:
        return counted(self.leaf.where(F.col(self.levels.measure) > over))

    def computed(self, over: int) -> DataFrame:
        return computed(self.leaf, self.levels, over)

    def by_name(self) -> DataFrame:
        return by_name(self.leaf, self.levels)

    def three_hop(self, org: str) -> DataFrame:
        r = self.root.where(F.col(self.levels.org) == org).select(F.col("id").alias("r"))
        a = self.first.join(r, F.col(self.up(1)) == F.col("r")).select(F.col("id").alias("a"))
        b = self.second.join(a, F.col(self.up(2)) == F.col("a")).select(F.col("id").alias("b"))
        return total(self.leaf.join(b, F.col(self.up(3)) == F.col("b")), self.levels)

    def below(self, table: DataFrame, parent: str, ids: DataFrame, few: bool = False) -> DataFrame:
        """Rows whose parent is among ``ids`` (column id); few: ids of one document, which are broadcast."""
        ids = ids.select(F.col("id").alias("_p"))
        return table.join(F.broadcast(ids) if few else ids, F.col(parent) == F.col("_p"), "left_semi")

    def descendants(self, roots: DataFrame, few: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Distinct ids of the first two levels below ``roots``, and the leaves."""
        a = self.below(self.first, self.up(1), roots, few).select("id").distinct()
        b = self.below(self.second, self.up(2), a, few).select("id").distinct()
        return a, b, self.below(self.leaf, self.up(3), b, few)

    def document_semi(self, id_: object) -> DataFrame:
        """``document`` by sets of ids; an unknown id gives no row."""
        root = self.root.where(F.col("id") == F.lit(id_)).select("id")
        a, b, leaf = self.descendants(root, few=True)
        leaf = leaf.agg(F.count("*").alias("n3"), F.coalesce(F.sum(self.levels.measure), F.lit(0)).alias("total"))
        one = root.agg(F.count("*").alias("known"))
        return one.join(a.agg(F.count("*").alias("n1"))).join(b.agg(F.count("*").alias("n2"))).join(leaf).where("known > 0").drop("known")

    def three_hop_semi(self, org: str) -> DataFrame:
        return total(self.descendants(self.root.where(F.col(self.levels.org) == org).select("id"))[2], self.levels)


def computed(leaves: DataFrame, levels: Levels, over: int) -> DataFrame:
    kept = leaves.where(F.col(levels.measure) > over)
    return kept.agg(F.coalesce(F.sum(F.col(levels.measure) * F.col(levels.rate).cast("double")), F.lit(0.0)).alias("total"))


def by_name(leaves: DataFrame, levels: Levels) -> DataFrame:
    """The largest measure of each name; a name whose measures are all at most 0 has no row."""
    return leaves.groupBy(F.col(levels.group).alias("name")).agg(F.max(levels.measure).alias("largest")).where("largest > 0")


def total(leaves: DataFrame, levels: Levels) -> DataFrame:
    return leaves.agg(F.coalesce(F.sum(levels.measure), F.lit(0)).cast("long").alias("total"))


def sweep(leaves: DataFrame, levels: Levels, thresholds: list[int]) -> DataFrame:
    """over, kept, share for every threshold, in one pass over the leaves."""
    sums = leaves.agg(F.count("*").alias("_all"), *[F.sum((F.col(levels.measure) > t).cast("long")).alias(f"t{i}") for i, t in enumerate(thresholds)])
    each = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("over"), F.coalesce(f"t{i}", F.lit(0)).alias("kept")) for i, t in enumerate(thresholds)])).alias("e")
    return sums.select("_all", each).select("e.over", "e.kept", (100.0 * F.col("e.kept") / F.col("_all")).alias("percent"))


def agree(a: DataFrame, b: DataFrame) -> bool:
    """Equal answers: floats within a billionth of their size, all else exactly. Answers are small."""
    def same(x: object, y: object) -> bool:
        return abs(x - y) <= 1e-9 * max(1.0, abs(x)) if isinstance(x, float) and isinstance(y, float) else x == y
    key = lambda r: tuple((v is None, str(v)) for v in r if not isinstance(v, float))
    left, right = (sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=key) for df in (a, b))
    return sorted(a.columns) == sorted(b.columns) and len(left) == len(right) and all(same(x, y) for r, s in zip(left, right, strict=True) for x, y in zip(r, s, strict=True))


def disagreements(stores: dict[str, Store], questions: dict[str, Callable[[Store], DataFrame]]) -> list[tuple[str, str]]:
    """(question, store) wherever a store differs from the first."""
    first = next(iter(stores))
    return [(q, s) for q, ask in questions.items() for s in stores if s != first and not agree(ask(stores[first]), ask(stores[s]))]


def shown(row: tuple | None) -> str:
    """An answer as text."""
    return "missing" if row is None else ", ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in row)


def break_even(load_a: float, load_b: float, query_a: float, query_b: float, noise: float = 1.3) -> str:
    """How many queries pay for the slower load of b; within ``noise`` neither is faster."""
    if max(query_a, query_b) < noise * min(query_a, query_b):
        return "neither"
    if query_b > query_a:
        return "a is faster" if load_a <= load_b else f"a after {(load_a - load_b) / (query_b - query_a):.0f} queries"
    return "b is faster" if load_b <= load_a else f"b after {(load_b - load_a) / (query_a - query_b):.0f} queries"
