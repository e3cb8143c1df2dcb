"""The pipeline's stages against plain Python, each on what the stage before kept."""

import collections

import corpus_pipeline
from docweave.llm.common import read, stored

from test_exact import WORD, plain_components, plain_quality, plain_targets


def test_stages(spark, folder):
    docs = stored(read(spark, folder, "documents"), "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, folder), "stage")
        after = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = sorted(r["doc_id"] for r in after)
        if name == "quality rules":
            kept = {r["doc_id"] for r in before if not plain_quality(r["text"])[5] and 10 * plain_quality(r["text"])[2] <= 3 * plain_quality(r["text"])[0]}
            assert set(ids) <= kept and len(ids) > 0.9 * len(kept)
        elif name == "exact dedup":
            last = {}
            for r in before:
                last[r["text"]] = max(last.get(r["text"], 0), r["doc_id"])
            assert ids == sorted(last.values())
        elif name == "n-gram join":
            assert ids == sorted(d for d, (_, c) in plain_components([(r["doc_id"], r["text"]) for r in before], 5, 80).items() if d == c)
        elif name == "mixing":
            sizes, took = collections.Counter(), collections.Counter()
            for r in before:
                sizes[r["source"]] += len(WORD.findall(r["text"]))
            for r in after:
                took[r["source"]] += len(WORD.findall(r["text"]))
            assert all(abs(took[s] - t) <= 1 for s, t in plain_targets(sizes).items())
        else:
            tokens = collections.Counter()
            for r in after:
                tokens[r["sequence_id"]] += r["length"]
            assert all(n == 2048 or n & (n - 1) == 0 for n in tokens.values()) and {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    assert corpus_pipeline.ORACLE_SQL is None
