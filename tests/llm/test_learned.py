"""Operators that learn, held to accuracy on rows they never saw, and to edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from docweave.llm import langid, toxicity
from docweave.llm.queries import queries


def test_forward_backward_in_blocks():
    rng = np.random.default_rng(1)
    size = np.array([1, 5, 64, 65, 300, 0, 128])
    score, transitions = rng.normal(0, 2, (size.sum(), 3)), rng.normal(0, 1, (3, 3))
    first = np.cumsum(size) - size
    got = langid.chain_marginals(score, first, size, transitions)
    for lo, n in zip(first, size, strict=True):
        if n:
            want, _ = langid.forward_backward(score[None, lo:lo + n], np.array([n]), transitions)
            assert np.allclose(want[0], got[lo:lo + n])


def test_words_of_two_languages_are_told_apart():
    rng = random.Random(1)
    of = {"aa": ["kata", "pako", "tipa", "kopi"], "bb": ["zuru", "muzo", "rumo", "zomu"]}
    texts, labels = [], []
    for i in range(80):
        lang = "ab"[i % 2] * 2
        texts.append(" ".join(rng.choice(of[lang]) + rng.choice(["", "s", "n"]) for _ in range(40)).encode())
        labels.append(lang)
    model = langid.trained(texts, labels)
    mixed = [rng.choice(of["aa"]) for _ in range(15)] + [rng.choice(of["bb"]) for _ in range(15)]
    marginals, _ = model.word_marginals([" ".join(mixed).encode()])
    assert [model.languages[k] for k in marginals.argmax(1)] == ["aa"] * 15 + ["bb"] * 15
    assert model.transitions[0, 0] > model.transitions[0, 1]
    assert model.predicted([b"", b"12 34 !!", "…".encode(), b"kata"])[:3] == [("und", 0.0)] * 3


def test_languages_held_out(spark):
    got = queries()["op4_languages"](spark, "/root/testdata/sf0.01").withColumnRenamed("doc_id", "d")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = got.where("held_out").join(docs, F.col("d") == F.col("doc_id")).select("lang", "lang_pred").collect()
    assert len(rows) > 250 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98


def test_language_edges(documents):
    rows = [(1, None), (2, ""), (3, "12 ... 34"), (4, "a"), (5, "the word " * 3000), (5, "the word " * 3000)]
    got = {r["doc_id"]: r for r in langid.languages(documents(rows)).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"] and got[5]["lang_pred"] == "en"
    assert langid.languages(documents([])).count() == 0
    nothing = documents(rows).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.languages(nothing).collect()} == {"und"}


def test_toxicity_learns(documents, spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["zzrotten", "qqfilth"]) + rng.choice(["", "!", "ly"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad), 7))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int, score int")
    got = toxicity.toxicity(documents(rows), labels, sample=300).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 80 and np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_toxicity_learns_from_all_labels(documents, spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    words = [word() for _ in range(300)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    rows = [(i, " ".join(some(20) + (["zzrotten", "qqfilth"] if i % 4 == 0 else []) + some(10))) for i in range(2000)]
    rows.append((2000, " ".join(some(4000))))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    docs = documents(rows)
    kept = toxicity.labelled(docs, labels, usable, "toxic", "text", 250)
    assert kept.count() == labels.where(usable).count() and kept.select("part").distinct().count() == 4
    got = [[r["score"] for r in toxicity.toxicity(d, labels, sample=250).orderBy("doc_id").collect()] for d in (docs, docs.repartition(7))]
    assert np.allclose(*got, atol=1e-4)
    assert np.mean([(s >= 0.5) == (i % 4 == 0) for i, s in enumerate(got[0])]) > 0.9


def test_toxicity_edges(documents, spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "one"), (5, "two words " * 40000), (5, "two words " * 40000)]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(documents(rows), none).collect()
    assert len(got) == 6 and len({r["score"] for r in got}) == 1
    one = spark.createDataFrame([(i, 0) for i in range(6)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(documents(rows), one).collect()} == {0}
    assert toxicity.toxicity(documents([]), one).count() == 0


def test_places_are_scored_in_chunks(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aa", "bb", "zz", "dd"]) for _ in range(rng.randint(0, 50))).encode() for _ in range(30)]
    hashes = [toxicity.word_pieces([t])[0] for t in texts]
    model = toxicity.trained(hashes, np.array([float(b"zz" in t) for t in texts]))
    at_once = model.scores(texts, model.table(), toxicity.language_table())
    monkeypatch.setattr(toxicity, "PLACES", 7)
    assert np.allclose(at_once, model.scores(texts, model.table(), toxicity.language_table()), atol=1e-5)
    alone = [model.scores([t], model.table(), toxicity.language_table())[0] for t in texts]
    assert np.allclose(at_once, alone, atol=1e-5)
