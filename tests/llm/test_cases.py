"""Every operator and stage on the cases that its docstring defines: nulls, empty and very long texts, ties and repeated rows, empty tables, clashing names."""

import collections

import corpus_pipeline
import pytest
from docweave.llm import exact_dedup, html_extract, langid, mixing, ngram_join, packing, pii, quality_rules, suffix_dedup, toxicity
from docweave.llm.queries import tokenizer_file
from pyspark.sql import functions as F

CLASHES = ["_text", "_lang", "_d", "_q", "_words", "_found", "_new", "_key", "_got", "_copies", "_out", "_body", "_gone", "_digest", "_keep_id", "_drawn", "_share", "_s", "digest", "keep_id", "n", "size", "start", "bucket", "node", "label", "share", "copy", "usable"]
LONG = " ".join(f"word{i % 9973} and{i % 89}." for i in range(90_000))
PLAIN = "The council met on Tuesday to discuss the new bridge over the river and its cost, said Mary Jones of ann@mail.example."
ROWS = [(None, PLAIN, "a"), (None, "another text without an id, of some words more than ten to be kept here", None), (1, PLAIN, "a"), (1, PLAIN, "a"), (2, None, "b"), (3, "", None), (4, " \n\t ", "b"), (5, LONG, "c"), (6, PLAIN + " Yes", "a"), (7, LONG, "c"),
        (8, "ein Text der nicht sehr lang ist aber doch genug Worte hat um zu bleiben", "b")]
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def table(spark):
    def make(rows):
        df = spark.createDataFrame([(d, t, "en" if s == "a" else "de", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return df.withColumns({c: F.lit(f"mine {c}") for c in CLASHES}).repartition(3)

    return make


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 0), (6, 0), (8, 0), (None, 1), (5, None)], "doc_id long, toxic int").withColumn("label", F.lit("mine"))


OPERATORS = {
    "op1": lambda docs, labels: toxicity.toxicity(docs, labels),
    "op2": lambda docs, labels: ngram_join.near_components(docs),
    "op3": lambda docs, labels: suffix_dedup.deduplicated(docs),
    "op4": lambda docs, labels: langid.languages(docs),
    "op5": lambda docs, labels: packing.packed(docs, tokenizer_file()),
    "op6": lambda docs, labels: pii.surrogates(docs, "k"),
    "op7": lambda docs, labels: quality_rules.quality(docs),
    "op8": lambda docs, labels: mixing.taken(docs),
    "op9": lambda docs, labels: exact_dedup.exact_duplicates(docs),
    "op10": lambda docs, labels: html_extract.extracted(docs.withColumns({"page_id": F.col("doc_id"), "url": F.col("source"), "html": F.concat(F.lit("<p>"), "text")})),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(table, labels, name):
    got = OPERATORS[name](table(ROWS), labels)
    id_ = "page_id" if name == "op10" else "doc_id"
    ids = collections.Counter(r[0] for r in got.select(id_).collect())
    want = collections.Counter(d for d, _, _ in ROWS)
    assert (set(ids) == set(want)) if name == "op5" else (ids == want)
    if name in ("op6", "op7"):
        assert {c: got.agg(F.min(c), F.max(c)).first()[:] for c in CLASHES} == {c: (f"mine {c}",) * 2 for c in CLASHES}
    assert OPERATORS[name](table([]), labels).count() == 0


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage(spark, table, name, stage):
    docs = table(ROWS)
    got = stage(spark, docs, "")
    ids = collections.Counter(r["doc_id"] for r in got.select("doc_id").collect())
    if name != "packing":
        assert got.columns == docs.columns and {r["_text"] for r in got.select("_text").distinct().collect()} == {"mine _text"}
    if name == "quality rules":
        assert ids == {None: 2, 1: 2, 5: 1, 6: 1, 7: 1, 8: 1} or ids == {None: 2, 1: 2, 6: 1, 8: 1}
    elif name == "exact dedup":
        assert ids == {None: 1, 1: 2, 4: 1, 3: 1, 6: 1, 7: 1, 8: 1}
    elif name == "n-gram join":
        assert ids[1] == 2 and ids[None] == 2 and ids[5] == 1 and 7 not in ids
    elif name == "mixing":
        assert not {2, 3, 4} & set(ids)
    assert stage(spark, table([]), "").count() == 0
