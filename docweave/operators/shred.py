"""Documents to tables: one DataFrame a table, each from its parent's rows.

A document is read once into a typed record, as deep as the layout knows it;
tables are then taken out of the record. Members that the type of a record
cannot tell apart stay variants: what is an object here and an array there,
elements that are scalars, names that differ in case only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..expressions import kind_of, members
from ..lattice import SPARK
from ..paths import ELEMENT, ENTRY, Path, holder, kind, owner
from ..plans.layout import Field, Layout, TableLayout


def got(node: Column, name: str, type_: str) -> Column:
    """Member ``name`` of an object, as a type; null where it is absent or null."""
    if '"' in name or "\\" in name:
        return F.try_variant_get(members(node)[name], "$", type_)
    return F.try_variant_get(node, f'$["{name}"]', type_)


def minted(chain: Column) -> Column:
    """A key in the form of a uuid that depends only on where the row stands."""
    h = F.md5(chain)
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_typed(layout: Layout, path: Path) -> bool:
    """Whether the nodes of a table are read as structs."""
    names = [c.name.lower() for c in layout.inference.tables[path]]
    return len(set(names)) == len(names) and "" not in names and names != ["value"] and names != []


def type_of(layout: Layout, path: Path) -> str:
    """The type that a node of this table is read as."""
    if not is_typed(layout, path):
        return "variant"
    return "struct<" + ",".join(f"{quoted(c.name)}:{member_type(layout, path, c.name, c.type)}" for c in layout.inference.tables[path]) + ">"


def member_type(layout: Layout, path: Path, name: str, tag: str) -> str:
    here = (*path, f".{name}")
    if tag == "ref":
        return type_of(layout, here)
    if tag != "coll":
        return SPARK[tag].simpleString()
    if here in layout.inference.collapsed:
        return "variant"
    if (*here, ENTRY) in layout.tables:
        return f"map<string,{type_of(layout, (*here, ENTRY))}>"
    return f"array<{type_of(layout, (*here, ELEMENT))}>"


def records(corpus: DataFrame, layout: Layout) -> DataFrame:
    """doc_ord and the typed record of each document: what ``shredded`` takes too. Persist or write it when several tables are asked for."""
    return corpus.select("doc_ord", F.variant_get("doc", "$", type_of(layout, ())).alias("record"))


def records_of_texts(texts: DataFrame, layout: Layout, text: str = "value") -> DataFrame:
    """``records`` of texts that inference has read, and so refused what is no document. They are read straight into the record's type; a text that does not go into it so is parsed to a variant, which says more."""
    type_ = type_of(layout, ())
    parsed = F.variant_get(F.parse_json(text), "$", type_)
    rows = texts.select(F.col("doc_ord").cast("long").alias("doc_ord"), F.col(text))
    if "variant" in type_ or not type_.startswith("struct<"):
        return rows.select("doc_ord", parsed.alias("record"))
    names = [c.name for c in layout.inference.tables[()]]
    left = "_left"
    while left.lower() in {n.lower() for n in names}:
        left = f"_{left}"
    read = F.from_json(text, f"{type_[:-1]},{left}:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": left})
    record = F.struct(*[F.col("_read")[n].alias(n) for n in names])
    return rows.withColumn("_read", read).select("doc_ord", F.when(F.col("_read").isNotNull() & F.col("_read")[left].isNull(), record).otherwise(parsed).alias("record"))


def member_of(layout: Layout, path: Path, name: str, type_: str) -> Column:
    """A member of a node of this table, null where it is absent or null."""
    return F.col("node")[name] if is_typed(layout, path) else got(F.col("node"), name, type_)


def key_of(layout: Layout, t: TableLayout, node: Column, chain: Column) -> Column:
    if t.minted:
        return minted(chain)
    return node["id"] if is_typed(layout, t.path) else got(node, "id", SPARK[t.fields[0].type].simpleString())


def there(value: Column, is_variant: bool) -> Column:
    return value.isNotNull() & ~F.is_variant_null(value) if is_variant else value.isNotNull()


def nodes(corpus: DataFrame, layout: Layout) -> dict[Path, DataFrame]:
    """For each table its rows before columns are taken: node, chain (where it stands), id, parent, position."""
    out: dict[Path, DataFrame] = {}
    rows = corpus if "record" in corpus.columns else records(corpus, layout)
    for p in sorted(layout.tables, key=len):
        t = layout.tables[p]
        if not p:
            rows = rows.select(F.col("record").alias("node"), F.concat(F.lit("/"), F.col("doc_ord").cast("string")).alias("chain"), F.lit(None).alias("parent"), F.lit(None).alias("position"))
        else:
            up, name, lone = owner(p), holder(p), p[:-1] in layout.inference.collapsed and kind(p) == "element"
            held = "variant" if lone else type_of(layout, p) if kind(p) == "reference" else f"map<string,{type_of(layout, p)}>" if kind(p) == "entry" else f"array<{type_of(layout, p)}>"
            value = member_of(layout, up, name, held)
            some = out[up].select("id", "chain", value.alias("value")).where(there(F.col("value"), held == "variant"))
            if kind(p) == "reference":
                rows = some.select(F.col("value").alias("node"), F.concat("chain", F.lit(f"/{name}")).alias("chain"), F.lit(None).alias("parent"), F.lit(None).alias("position"))
            elif kind(p) == "entry":
                rows = some.select("id", "chain", F.explode(F.map_entries("value")).alias("e"))
                rows = rows.select(F.col("e.value").alias("node"), F.concat("chain", F.lit(f"/{name}/"), F.col("e.key")).alias("chain"), F.col("id").alias("parent"), F.col("e.key").alias("position"))
            else:
                many = F.col("value")
                if lone:  # an object where others have an array is an array of one
                    many = F.when(kind_of(many) == "A", F.try_variant_get(many, "$", f"array<{type_of(layout, p)}>")).otherwise(F.array(F.try_variant_get(many, "$", type_of(layout, p))))
                rows = some.select("id", "chain", F.posexplode(many).alias("position", "node"))
                rows = rows.select("node", F.concat("chain", F.lit(f"/{name}/"), F.col("position").cast("string")).alias("chain"), F.col("id").alias("parent"), F.col("position").cast("long").alias("position"))
        out[p] = rows.withColumn("id", key_of(layout, t, F.col("node"), F.col("chain")))
    return out


def column(t: TableLayout, f: Field, layout: Layout) -> Column:
    node = F.col("node")
    if f.role in ("key", "parent", "position"):
        return F.col({"key": "id"}.get(f.role, f.role))
    if f.refers is not None:
        target = member_of(layout, t.path, f.source, type_of(layout, f.refers))
        key = key_of(layout, layout.tables[f.refers], target, F.concat("chain", F.lit(f"/{f.source}")))
        return F.when(there(target, not is_typed(layout, f.refers)), key)
    type_ = SPARK[f.type].simpleString()
    own = member_of(layout, t.path, f.source, type_)
    if kind(t.path) in ("element", "entry") and f.source == "value" and not is_typed(layout, t.path):
        return F.when(kind_of(node) == "O", own).otherwise(F.try_variant_get(node, "$", type_))
    return own


def shredded(corpus: DataFrame, layout: Layout) -> dict[str, DataFrame]:
    """A DataFrame for each table, by name, with the layout's columns; corpus: documents, or ``records`` of them."""
    rows = nodes(corpus, layout)
    return {t.name: rows[p].select(*[column(t, f, layout).cast(SPARK[f.type]).alias(f.name) for f in t.fields]) for p, t in layout.tables.items()}
