"""Quality rules as a short-circuit cascade.

A rule is a Column of a text and its words that is true where a document fails;
it computes what it needs itself. On a sample each rule's selectivity (share
rejected) and cost (seconds, of the rule with its features) are estimated, and
the rules are tried by rejections per second, the best first. A document leaves
at the first rule that rejects it, before the features of later rules are
computed. The order changes how fast a verdict is found, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, let, text_of, unused, words_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``failed`` takes a text and its words; null counts as not failed."""

    name: str
    failed: Callable[[Column, Column], Column]


def long_size(c: Column) -> Column:
    return F.size(c).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def windows_of(words: Column) -> Column:
    """A 64-bit hash of every window of five words, in order; ``words`` is a plain column."""
    return F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))


def n_repeat_words(windows: Column) -> Column:
    """Words in windows found twice or more. Sorting (hash, place) puts equal windows side by side; places then say how many words are covered."""
    def places(pairs: Column) -> Column:
        marked = F.transform(pairs, lambda e, j: F.when((F.get(pairs, j - 1)["h"] == e["h"]) | (F.get(pairs, j + 1)["h"] == e["h"]), e["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
                           lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).cast("long").alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])

    return let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda pairs: let(places(pairs), covered))


def repeat_words(words: Column) -> Column:
    """Words in five-word windows found twice or more; only a text in which two windows' hashes are equal is sorted."""
    def found(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), n_repeat_words(windows)).otherwise(F.lit(0).cast("long"))

    return let(windows_of(words), found)


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_dup_lines(lines: Column) -> Column:
    return long_size(lines) - long_size(F.array_distinct(lines))


def few(words: Column) -> Column:
    return F.size(words) < 10


def repeats(n: Column, words: Column) -> Column:
    return 100 * n > 20 * F.size(words)


#: The base, as two rules.
BASE = (
    Rule("few_words", lambda text, words: few(words)),
    Rule("repeats", lambda text, words: repeats(repeat_words(words), words)),
)
#: The method's own rules, beside the base.
RULES = (
    Rule("symbols", lambda text, words: 10 * n_symbols(text) > 3 * F.size(words)),
    Rule("word_length", lambda text, words: let(word_chars(words), lambda n: (n < 2 * F.size(words)) | (n > 20 * F.size(words)))),
    Rule("dup_lines", lambda text, words: let(lines_of(text), lambda lines: 10 * n_dup_lines(lines) > 3 * F.size(lines))),
    Rule("letters", lambda text, words: 10 * F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))) < 6 * F.size(words)),
    Rule("capitals", lambda text, words: 10 * F.size(F.filter(words, lambda w: w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}"))) > 7 * F.size(words)),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float


def estimates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 500, text: str = "text", sample_chars: int = 20_000, copies: int = 4, repeats: int = 3) -> list[Estimate]:
    """Cost and selectivity of each rule over at most ``sample_rows`` texts of at most ``sample_chars`` characters.

    The texts are every eighth of the first rows, by a hash, so that no more of
    the table is read than they need; they are held while the rules are timed. Each rule
    runs ``repeats`` times over ``copies`` of them, and its least time counts, less that of splitting alone.
    """
    body = docs.select(text_of(text).alias("text"))
    short = body.where(F.length("text") <= sample_chars)
    rows = short.where(F.pmod(F.xxhash64("text"), F.lit(8)) == 0).take(sample_rows) or short.take(sample_rows)
    if not rows:
        return [Estimate(r.name, 0.0, 0.0) for r in rules]
    sample = docs.sparkSession.createDataFrame([(r["text"],) for r in rows], "text string").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).cache()

    def timed(rule: Rule) -> tuple[float, float]:
        hit = let(words_of(F.col("text")), lambda words: F.coalesce(rule.failed(F.col("text"), words), F.lit(False)))
        job, least = sample.agg(F.count(F.when(hit, 1)).alias("n")), float("inf")
        for _ in range(1 + repeats):  # the first compiles
            began = time.perf_counter()
            n = job.first()["n"]
            least = min(least, time.perf_counter() - began)
        return least, n / (copies * len(rows))

    try:
        bare, _ = timed(Rule("none", lambda text, words: F.size(words) < 0))
        return [Estimate(r.name, max(0.0, seconds - bare), rejected) for r in rules for seconds, rejected in [timed(r)]]
    finally:
        sample.unpersist()


def ordered(rules: tuple[Rule, ...], found: list[Estimate]) -> list[Rule]:
    """The rules by rejections per second, the most first; rules that rejected nothing last, the cheapest first; ties in their order."""
    by = {e.name: e for e in found}
    return sorted(rules, key=lambda r: (-by[r.name].rejected / max(by[r.name].seconds, 1e-6), by[r.name].seconds))


def cascade(rules: list[Rule], text: Column, words: Column) -> Column:
    """True where no rule rejects; CASE computes no branch after the one that holds."""
    verdict = None
    for rule in rules:
        failed = F.coalesce(rule.failed(text, words), F.lit(False))
        verdict = F.when(failed, F.lit(False)) if verdict is None else verdict.when(failed, F.lit(False))
    return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 500) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    Null and empty texts have no words, fail the base and are not kept; texts of
    any length are read whole. Columns of the names above are replaced, all
    others stay; repeated rows each get the same verdict; an empty table gives an
    empty table. The features of the base are asked for and so computed for all;
    the method's rules cascade over what the base keeps. Windows are compared by
    64-bit hashes.
    """
    order = ordered(rules, estimates(docs, rules, sample_rows, text))
    body, found = unused(docs, "_body", "_found")

    def features(words: Column) -> Column:
        own = F.struct(long_size(words).alias("n_words"), word_chars(words).alias("word_chars"), n_symbols(F.col(body)).alias("n_symbols"), n_dup_lines(lines_of(F.col(body))).alias("n_dup_lines"), repeat_words(words).alias("n_repeat_words"))
        def judged(q: Column) -> Column:
            failed = few(words) | repeats(q["n_repeat_words"], words)
            return F.struct(*[q[n].alias(n) for n in FEATURES], failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(cascade(order, F.col(body), words)).alias("kept"))
        return let(own, judged)

    out = docs.withColumn(body, text_of(text)).withColumn(found, let(words_of(F.col(body)), features))
    return out.withColumns({n: F.col(found)[n] for n in (*FEATURES, "base_failed", "kept")}).drop(body, found)


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 500) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only; ``quality`` gives the same verdicts.

    The base's rules take part in the order. One predicate holds the whole
    cascade, so that a rejected text costs no rule beyond its own.
    """
    every = (*BASE, *rules)
    order = ordered(every, estimates(docs, every, sample_rows, text))
    verdict = let(text_of(text), lambda body: let(words_of(body), lambda words: cascade(order, body, words)))
    return docs.where(verdict).select(*[column(c) for c in docs.columns])
