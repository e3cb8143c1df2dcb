"""What there is to say about a corpus: the schema, a sample, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..operators.shred import shredded
from ..paths import shown
from ..sources.corpus import refusal
from .infer import infer
from .layout import laid_out


def report(corpus: DataFrame, config: dict | None = None) -> dict:
    """The outcome as plain data: either the tables, layout and DDL, or the refusal."""
    try:
        found = infer(corpus, config)
        layout = laid_out(found)
    except Exception as e:  # a refusal, or one that Spark wrapped
        why = e if isinstance(e, Refused) else refusal(e)
        if why is None:
            raise
        return {"ok": False, "error": {"code": why.code, "path": why.path, "message": str(why)}}
    tables = [{"path": shown(p), "visits": found.visits[p], "columns": [{"name": c.name, "type": c.type, "nullable": c.nullable, "values": c.values, "nulls": c.nulls, "absent": c.absent, "widened": c.widened, "big": c.big, "never_typed": c.never_typed} for c in cs]} for p, cs in found.tables.items()]
    return {"ok": True, "documents": found.visits[()], "tables": tables, "ddl": layout.ddl(), "constraints": layout.constraints(),
            "layout": [{"name": t.name, "minted": t.minted, "columns": [{"name": f.name, "type": f.type, "nullable": f.nullable, "role": f.role} for f in t.fields]} for t in layout.ordered()]}


def translated(text: str, spark, config: dict | None = None) -> dict:
    """``report`` of a corpus given as a string."""
    from ..sources.corpus import text as corpus_of

    return report(corpus_of(spark, text), config)


def sample(corpus: DataFrame, config: dict | None = None) -> dict:
    """The first document beside the rows that it becomes."""
    first = corpus.orderBy("doc_ord").limit(1)
    layout = laid_out(infer(corpus, config))
    return {"document": first.select(F.to_json("doc").alias("d")).first()["d"], "tables": {n: [r.asDict() for r in df.collect()] for n, df in shredded(first, layout).items()}}


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n for every table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


#: Ids that are sorted at once, and ids that the place of the middle is guessed from, at most.
TOGETHER, GUESSES = 1 << 17, 1 << 12


def middle_id(root: DataFrame) -> object:
    """The id in the middle of the roots, by id, exactly: a parameter for point queries. None if there is no root.

    Ids are counted, not sorted, until few are left between two bounds: the bounds are taken around the middle from
    the ids of the smallest hashes, and the counts below and between them say which side the middle is on.
    """
    ids = root.select("id")
    n, known = ids.agg(F.count("*"), F.count("id")).first()
    skip = n // 2 - (n - known)  # nulls come first
    if skip < 0 or not known:
        return None
    ids, n, at = ids.where("id is not null"), known, F.col("id")
    while n > TOGETHER:
        some = [r["id"] for r in ids.orderBy(F.xxhash64("id")).limit(GUESSES).orderBy("id").collect()]
        k, wide = skip * len(some) // n, 2 * int(len(some) ** 0.5)
        lo, hi = some[max(0, k - wide)], some[min(len(some) - 1, k + wide)]
        below, to_lo, between, to_hi = ids.agg(*[F.count(F.when(c, 1)) for c in (at < F.lit(lo), at <= F.lit(lo), at < F.lit(hi), at <= F.lit(hi))]).first()
        if skip < below:
            ids, n = ids.where(at < F.lit(lo)), below
        elif skip < to_lo:
            return lo
        elif skip < between:
            ids, n, skip = ids.where((at > F.lit(lo)) & (at < F.lit(hi))), between - to_lo, skip - to_lo
        elif skip < to_hi:
            return hi
        else:
            ids, n, skip = ids.where(at > F.lit(hi)), n - to_hi, skip - to_hi
    return ids.orderBy("id").offset(skip).limit(1).first()["id"]
