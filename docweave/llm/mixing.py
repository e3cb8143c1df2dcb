"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of ``block`` words each. Slot i has the golden-ratio
point frac(i * phi); the point falls into one source's stretch of the
cumulative target shares. The slots of a source are ranked, and rank r takes
block r of that source's shuffled documents, cut into blocks of equal size;
the stream of a source starts again when it ends, at most three times over.
The last slot of a source is cut short so that its words meet the target.

Ranks and word offsets are prefix sums in two steps (over chunks, then within
a chunk), so that no source is ever ordered in one task. Only tables of one row
a source pass through one task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, small, stored, text_of, unused, words_of

BLOCK = 256
REPEATS = 3
#: Rows that a task orders at once: slots of a chunk, documents of a bucket.
CHUNK = 1 << 16
#: Multiples of 1 / (golden ratio), less their whole parts, are the golden-ratio points.
GOLDEN = Decimal("0.61803398874989484820")
#: Cells over the cumulative weights; a point meets the few sources that reach into its cell.
CELLS = 1024


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size in words, copies: equal rows are one row that says how many they are; null text has no words."""
    rows = docs.select("doc_id", "source", F.size(words_of(text_of(text))).cast("long").alias("size"))
    return rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))


def targets(sized: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """source, weight, source_size, target: one row a source.

    Sources by code point, null last, weigh 1, 2, 3 and again. A source is full
    when its share by weight would pass ``repeats`` times its size; sorted by
    that size per weight the full ones come first, and the level at which the
    rest share what remains is the first that no later source exceeds.
    """
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    everything = Window.partitionBy(F.lit(1))
    by_level = everything.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "_total": F.sum("source_size").over(everything),
        "_full": F.coalesce(F.sum(repeats * F.col("source_size")).over(before), F.lit(0)),
        "_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # the level if all before this source are full and this one is not
    per = per.withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_left"))
    fits = repeats * F.col("source_size") >= F.col("_level") * F.col("weight")
    per = per.withColumn("_level", F.min_by("_level", F.when(fits, F.struct(F.col("source_size") / F.col("weight"), F.coalesce("source", F.lit(""))))).over(everything))
    capped = F.least((repeats * F.col("source_size")).cast("double"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("weight"))
    return per.select("source", "weight", F.col("source_size").cast("long").alias("source_size"), F.round(capped, 6).alias("target"))


def placed(sized: DataFrame, seed: str) -> DataFrame:
    """``sized`` with start: the words of the source before the row's first copy, in the order of md5(seed:doc_id)."""
    rows = sized.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    bits = max(0, (rows.count() // CHUNK).bit_length())
    rows = rows.withColumn("_bucket", F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), 32 - min(32, bits + 4)))
    words = F.sum(F.col("size") * F.col("copies"))
    part = rows.groupBy("source", "_bucket").agg(words.alias("_words"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(words.over(within), F.lit(0)))
    rows = rows.join(part, rows["source"].eqNullSafe(part["_s"]) & (rows["_bucket"] == part["_b"]))
    return rows.select("doc_id", "source", "size", "copies", (F.col("_before") + F.col("_within")).cast("long").alias("start"))


def schedule(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, source, rank, words: which block of which source each slot takes; goals is the result of ``targets``, stored.

    A source has ceil(target / block) ranks. Golden-ratio slots beyond that are
    dropped; ranks that the points leave open, a few a source, follow at the end.
    """
    spark = goals.sparkSession
    everything = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    goals = goals.withColumn("_goal", F.round("target").cast("long")).withColumn("_ranks", F.ceil(F.col("_goal") / block).cast("long"))
    goals = goals.withColumn("_hi", F.sum("_ranks").over(everything)).withColumn("_lo", F.col("_hi") - F.col("_ranks"))
    n = goals.agg(F.max("_hi")).first()[0] or 0
    goals = goals.where("_ranks > 0").select(F.col("source").alias("source"), "_goal", "_ranks", "_lo", "_hi")
    # the point of slot i, scaled to the n slots that the cumulative weights share
    point = F.pmod(F.col("id").cast("decimal(14,0)") * F.lit(GOLDEN), F.lit(1)).cast("double") * n
    cell = lambda at: F.floor(at * CELLS / F.lit(max(n, 1))).cast("int")
    slots = spark.range(0, n).select("id", F.least(F.floor(point).cast("long"), F.lit(n - 1)).alias("_at"), F.floor(F.col("id") / CHUNK).alias("_chunk"))
    in_cells = goals.withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi") - 1))))
    slots = slots.withColumn("_cell", cell(F.col("_at"))).join(small(in_cells), "_cell")
    slots = slots.where((F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")))
    part = slots.groupBy("source", "_chunk").count()
    earlier = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(F.col("source").alias("_s"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("source", "_chunk").orderBy("id")
    ranked = slots.withColumn("_within", F.row_number().over(within) - 1).join(part, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    ranked = ranked.select(F.col("id").alias("slot"), "source", (F.col("_before") + F.col("_within")).cast("long").alias("rank"), "_goal", "_ranks")
    drawn = slots.groupBy("source").agg(F.count("*").alias("_drawn")).withColumnRenamed("source", "_s")
    open_ranks = goals.join(drawn, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("_drawn", F.coalesce("_drawn", F.lit(0))).where("_drawn < _ranks")
    tail = open_ranks.select((F.lit(n) + F.col("_lo")).alias("slot"), "source", F.explode(F.sequence(F.col("_drawn"), F.col("_ranks") - 1)).alias("rank"), "_goal", "_ranks")
    all_slots = ranked.where("rank < _ranks").unionByName(tail.select(F.col("slot") + F.col("rank"), "source", F.col("rank").cast("long").alias("rank"), "_goal", "_ranks").toDF(*ranked.columns))
    return all_slots.select("slot", "source", "rank", F.least(F.lit(block), F.col("_goal") - F.col("rank") * block).cast("long").alias("words"))


def mixed(docs: DataFrame, text: str = "text", block: int = BLOCK, repeats: int = REPEATS, seed: str = "mix", sized: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces, documents, goals).

    pieces: slot, rank, source, doc_id, size, copy, from_word, n_words - what each
    slot takes of each document. documents: doc_id, source, size, copies, start.
    Null sources are a source of their own, null ids ids like others; null and
    empty texts have size 0 and are never taken, long ones are cut into as many
    blocks as they fill; rows equal in id, source and size are copies that each
    take their place, one after another. An empty table gives empty results.
    """
    sized = stored(sizes(docs, text) if sized is None else sized, "sizes")
    goals = stored(targets(sized, repeats), "targets")
    rows = stored(placed(sized, seed), "placed")
    of = goals.select(F.col("source").alias("_s"), "source_size", F.round("target").cast("long").alias("_goal"))
    runs = rows.where("size > 0").join(small(of), F.col("source").eqNullSafe(F.col("_s")))
    runs = runs.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    runs = runs.withColumn("_again", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    runs = runs.withColumn("_from", F.col("start") + F.col("copy") * F.col("size") + F.col("_again") * F.col("source_size")).withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("_goal"))).where("_from < _to")
    runs = runs.withColumn("rank", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
    slots = schedule(goals, block).withColumnRenamed("source", "_s2").withColumnRenamed("rank", "_r2")
    pieces = runs.join(slots, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("rank") == F.col("_r2")))
    lo = F.greatest(F.col("_from"), F.col("rank") * block)
    hi = F.least(F.col("_to"), F.col("rank") * block + F.col("words"))
    pieces = pieces.where(lo < hi).select("slot", "rank", "source", "doc_id", "size", "copy", (lo - F.col("_from")).cast("long").alias("from_word"), (hi - lo).cast("long").alias("n_words"))
    return pieces, rows, goals


def taken(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words that the mix takes of it, repeats counted).

    Ties in the order of md5(doc_id) fall by doc_id and size; the cases of
    ``mixed`` hold, and other columns are ignored whatever their names.
    """
    pieces, rows, goals = mixed(docs, text, **options)
    per = pieces.groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"), F.col("copy").alias("_c")).agg(F.sum("n_words").alias("taken"))
    of = goals.select(F.col("source").alias("_t"), "source_size", "target")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    out = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n")) & (F.col("copy") == F.col("_c")), "left")
    out = out.join(small(of), F.col("source").eqNullSafe(F.col("_t")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def named(docs: DataFrame) -> Column:
    """128 bits that name a row by all its columns."""
    columns = [column(c) for c in docs.columns]
    return F.concat(F.hex(F.xxhash64(F.lit("a"), *columns)), F.lit("-"), F.hex(F.xxhash64(F.lit("b"), *columns)))


def mix_documents(docs: DataFrame, text: str = "text", repeats: int = REPEATS, **options) -> DataFrame:
    """The mix as rows of ``docs``: a document as often as the mix takes it whole, and once more, cut after the words taken, where a target ends within it.

    Columns and their names stay. Rows equal in every column are combined before
    any shuffle, and what the mix takes of all of them is given by one. The cases
    of ``mixed`` hold.
    """
    key, got, words, copies, out = unused(docs, "_key", "_got", "_words", "_copies", "_out")
    own = [column(c) for c in docs.columns]
    keyed = docs.withColumn(key, named(docs))
    sized = keyed.groupBy(F.col(key).alias("doc_id"), F.col("source").alias("source"), F.size(words_of(text_of(text))).cast("long").alias("size")).agg(F.count("*").alias("copies"))
    pieces, rows, _ = mixed(docs, text, repeats=repeats, sized=sized, **options)
    per = pieces.groupBy(F.col("doc_id").alias("_d")).agg(F.sum("n_words").alias(got))
    per = stored(per.join(rows.select("doc_id", F.col("size").alias(words), F.col("copies").alias(copies)), F.col("_d") == F.col("doc_id")).drop("_d"), "shares").withColumnRenamed("doc_id", f"_{key}")
    keyed = keyed.join(per, F.col(key) == F.col(f"_{key}")).drop(f"_{key}")
    if per.where(F.col(copies) > 1).limit(1).count():
        same = keyed.where(F.col(copies) > 1).groupBy(key).agg(*[F.first(c).alias(name) for c, name in zip(own, docs.columns, strict=True)], *[F.first(c).alias(c) for c in (got, words, copies)])
        keyed = keyed.where(F.col(copies) == 1).unionByName(same.select(keyed.columns))
    whole, rest = F.floor(F.col(got) / F.col(words)).cast("int"), (F.col(got) % F.col(words)).cast("int")
    cut = F.array_join(F.slice(words_of(text_of(text)), 1, F.greatest(rest, F.lit(1))), " ")
    texts = F.concat(F.array_repeat(column(text), whole), F.when(rest > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    return keyed.withColumn(out, F.explode(texts)).select(*[F.col(out).alias(text) if c == text else column(c) for c in docs.columns])
