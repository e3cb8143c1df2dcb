"""Tables back to nested documents."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..paths import Path, holder, kind, owner
from ..plans.layout import Layout, TableLayout

#: Keys as ``shred.minted`` makes them.
MINTED = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def packed(key: Column, table: TableLayout) -> Column:
    """A table's key to group and join by: minted ones as the 16 bytes that their digits say, others as they are."""
    if not table.minted:
        return key
    return F.when(key.rlike(MINTED), F.unhex(F.replace(key, F.lit("-"), F.lit("")))).otherwise(F.encode(key, "UTF-8"))


def bodied(inner: DataFrame, child: TableLayout, members: dict[str, Collection[str]] | None) -> list[str]:
    """What a row of a built table brings into its parent's."""
    names = [n for n in inner.columns if n not in [f.name for f in child.fields if f.role in ("parent", "position")]]
    wanted = None if members is None else members.get(child.name)
    return names if wanted is None or "id" in wanted else [n for n in names if n != "id"] or names


def nested(tables: dict[str, DataFrame], layout: Layout, members: dict[str, Collection[str]] | None = None) -> DataFrame:
    """The root table with every child table inside it, in order: collections as arrays by ``idx`` or maps by ``key``, references as structs.

    Children are grouped by parent once each, bottom up, and left-joined, so a
    parent without children has an empty collection. Of a table that ``members``
    names only these columns are taken, beside what lies in it: what nobody reads is not moved level by level.
    """
    built: dict[Path, DataFrame] = {}
    for p in sorted(layout.tables, key=len, reverse=True):
        t = layout.tables[p]
        wanted = None if members is None else members.get(t.name)
        inside = [c for c in layout.tables if c and owner(c) == p]
        referring = {holder(c) for c in inside if kind(c) == "reference"}
        needed = [f.name for f in t.fields if wanted is None or f.role != "member" or f.name in wanted or f.source in referring]
        df = tables[t.name].select(*[F.col(f"`{n}`") for n in needed])
        for c in inside:
            child, name = layout.tables[c], holder(c)
            inner = built[c]
            if kind(c) == "reference":
                one = inner.select(packed(F.col("id"), child).alias("_id"), F.struct(*[F.col(f"`{n}`") for n in bodied(inner, child, members)]).alias("_one"))
                df = df.join(one, packed(df[f"`{name}`"], child) == one["_id"], "left").drop("_id").withColumn(name, F.col("_one")).drop("_one")
                continue
            parent, position = child.fields[1].name, child.fields[2].name
            held = bodied(inner, child, members)
            scalar = child.minted and [f.name for f in child.fields if f.role == "member"] == ["value"] and set(held) <= {"id", "value"} and "value" in held
            body = F.col("value") if scalar else F.struct(*[F.col(f"`{n}`") for n in held])
            grouped = inner.groupBy(packed(F.col(f"`{parent}`"), t).alias("_parent")).agg(F.array_sort(F.collect_list(F.struct(F.col(f"`{position}`").alias("at"), body.alias("it")))).alias("_many"))
            many = F.map_from_entries("_many") if position == "key" else F.transform("_many", lambda e: e["it"])
            df = df.join(grouped, packed(df["id"], t) == grouped["_parent"], "left")
            empty = F.map_from_entries(F.slice("_many", 1, 0)) if position == "key" else F.array()
            df = df.withColumn(name, F.coalesce(many, empty) if position != "key" else many).drop("_parent", "_many")
        built[p] = df
    return built[()]
