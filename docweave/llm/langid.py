"""Language identification by a linear-chain conditional random field.

Every word of a text is a place of the chain and every learned language a
state. A word's evidence is a sum of weights of its hashed affixes, byte n-grams
and itself (the lexicon); learned transitions say how likely the language stays
or switches from word to word. Forward-backward gives each word a distribution
over languages; a text is in the language that its words expect most.

Training texts have one language each, so code-switched chains are made of runs
of their words. Fitting runs on the driver over a bounded sample; labelling runs
over whole texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, small, text_of
from .shingles import mixed, prefix_hashes, substring_hashes

BUCKETS = 1 << 18
AFFIXES = (1, 2, 3, 4)
GRAMS = (2, 3)
#: Sampled texts a language, about.
SAMPLE = 400
#: Longer texts are labelled, but not learned from.
SAMPLE_CHARS = 50_000
#: Places of a training chain, and words of a run of one language on average.
CHAIN, RUN = 60, 20
EPOCHS = 3
#: Places of a chain that are worked through before the next block.
BLOCK = 64


@dataclass
class Words:
    """Words of some texts: pieces of each, n-grams of all, and where they end."""

    pieces: np.ndarray  # (words, pieces) buckets
    grams: list[np.ndarray]  # for each length the buckets of all n-grams, word after word
    gram_word: list[np.ndarray]  # the word of each
    ends: np.ndarray  # by text


def bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (mixed(h + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15 >> 8)) >> np.uint64(46)).astype(np.int32)


def words_of(texts: list[bytes]) -> Words:
    """Words with a letter; letters are a-z, A-Z in lower case, and all bytes beyond ASCII."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    edge = np.diff(np.concatenate(([1], blank.view(np.int8), [1])))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    before = np.concatenate(([0], np.cumsum(letter)))
    some = before[end] > before[start]
    lo, hi = before[start][some], before[end][some]
    prefix = prefix_hashes(data[letter])
    pieces = [bucket(substring_hashes(prefix, lo, hi), 0)]
    for k in AFFIXES:
        pieces.append(bucket(substring_hashes(prefix, lo, np.minimum(lo + k, hi)), k))
        pieces.append(bucket(substring_hashes(prefix, np.maximum(hi - k, lo), hi), 10 + k))
    word = np.repeat(np.arange(len(lo)), hi - lo)
    grams, of = [], []
    for k in GRAMS:
        at = np.flatnonzero(word[:len(word) - k + 1] == word[k - 1:]) if len(word) >= k else np.zeros(0, np.int64)
        grams.append(bucket(substring_hashes(prefix, at, at + k), 20 + k))
        of.append(word[at])
    return Words(np.stack(pieces, 1), grams, of, np.searchsorted(start[some], np.cumsum([len(t) + 1 for t in texts])))


def evidence(weights: np.ndarray, w: Words) -> np.ndarray:
    out = weights[w.pieces[:, 0]]
    for k in range(1, w.pieces.shape[1]):
        out += weights[w.pieces[:, k]]
    for grams, word in zip(w.grams, w.gram_word, strict=True):
        if len(word):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out[word[first]] += np.add.reduceat(weights[grams], first, axis=0)
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(marginals, expected transitions) of chains (chain, place, state), padded at the end."""
    n, t, s = scores.shape
    here = np.exp(scores - scores.max(2, keepdims=True))
    step = np.exp(transitions - transitions.max())
    alpha, beta = np.empty((t, n, s)), np.ones((t, n, s))
    alpha[0] = here[:, 0] / here[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        a = (alpha[i - 1] @ step) * here[:, i]
        alpha[i] = a / a.sum(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        b = (beta[i + 1] * here[:, i + 1]) @ step.T
        b /= b.sum(1, keepdims=True)
        beta[i] = np.where((lengths > i + 1)[:, None], b, 1.0)
    out = alpha * beta
    out /= out.sum(2, keepdims=True)
    moved = np.zeros((s, s))
    if pairs:
        for i in range(1, t):
            p = alpha[i - 1][:, :, None] * step[None] * (here[:, i] * beta[i])[:, None, :]
            p /= p.sum((1, 2), keepdims=True)
            moved += p[lengths > i].sum(0)
    return out.transpose(1, 0, 2), moved


def scaled(a: np.ndarray) -> np.ndarray:
    return a / a.max(tuple(range(1, a.ndim)), keepdims=True)


def chain_marginals(score: np.ndarray, first: np.ndarray, size: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward over chains of any length, place after place for many at once.

    Chains are cut into blocks of BLOCK places. What a block does to a forward or
    backward vector is a matrix; with the matrices of all blocks, vectors pass
    from block to block, and then all blocks are worked through side by side.
    """
    s = score.shape[1]
    if not len(score):
        return np.zeros((0, s))
    step = np.exp(transitions - transitions.max())
    blocks = -(-size // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    own = np.repeat(np.arange(len(size)), blocks)
    nth = np.arange(len(own)) - first_block[own]
    start = first[own] + nth * BLOCK
    length = np.minimum(size[own] - nth * BLOCK, BLOCK)
    here = np.ones((BLOCK, len(own), s))
    for i in range(BLOCK):
        at = np.flatnonzero(length > i)
        e = score[start[at] + i].astype(np.float64)
        here[i, at] = np.exp(e - e.max(1, keepdims=True))
    whole = np.broadcast_to(np.eye(s), (len(own), s, s)).copy()
    for i in range(BLOCK):
        at = np.flatnonzero(length > i)
        m = whole[at] @ step
        if i == 0:
            m[nth[at] == 0] = np.eye(s)  # a chain's first place follows nothing
        whole[at] = scaled(m * here[i, at][:, None, :])
    before, after = np.ones((len(own), s)), np.ones((len(own), s))
    for k in range(1, int(blocks.max())):
        at = np.flatnonzero(nth == k)
        before[at] = scaled((before[at - 1][:, None, :] @ whole[at - 1])[:, 0])
    for k in range(int(blocks.max()) - 2, -1, -1):
        at = np.flatnonzero((nth == k) & (blocks[own] > k + 1))
        after[at] = scaled((whole[at + 1] @ after[at + 1][:, :, None])[:, :, 0])
    forward = np.empty((BLOCK, len(own), s))
    a = before
    for i in range(BLOCK):
        moved = a @ step
        if i == 0:
            moved[nth == 0] = 1.0
        a = np.where((length > i)[:, None], scaled(moved * here[i]), a)
        forward[i] = a
    out = np.empty((len(score), s))
    b = after
    for i in range(BLOCK - 1, -1, -1):
        at = np.flatnonzero(length > i)
        p = forward[i, at] * b[at]
        out[start[at] + i] = p / p.sum(1, keepdims=True)
        b[at] = scaled((b[at] * here[i, at]) @ step.T)
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages)
    transitions: np.ndarray

    def word_marginals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(distribution of every word with a letter, where each text's words end)."""
        w = words_of(texts)
        score = evidence(self.weights.astype(np.float32), w)
        size = np.diff(np.concatenate(([0], w.ends)))
        return chain_marginals(score, w.ends - size, size, self.transitions), w.ends

    def predicted(self, texts: list[bytes]) -> list[tuple[str, float]]:
        marginals, ends = self.word_marginals(texts)
        out, lo = [], 0
        for text, hi in zip(texts, ends.tolist(), strict=True):
            if hi > lo and has_letter(text):
                share = marginals[lo:hi].mean(0)
                out.append((self.languages[int(share.argmax())], float(min(1.0, share.max()))))
            else:
                out.append(("und", 0.0))
            lo = hi
        return out


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text[:64].decode("utf-8", "ignore")) or any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def chains(sizes: np.ndarray, language: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(place -> word, place -> language): every word once, in runs of one text's words, shuffled and cut into chains."""
    runs: list[np.ndarray] = []
    first = np.cumsum(sizes) - sizes
    for lo, n in zip(first.tolist(), sizes.tolist(), strict=True):
        cuts = np.flatnonzero(rng.random(max(0, n - 1)) < 1 / RUN) + 1
        runs += np.split(np.arange(lo, lo + n), cuts)
    runs = [runs[i] for i in rng.permutation(len(runs)) if len(runs[i])]
    word = np.concatenate(runs)
    word = word[:max(CHAIN, len(word) // CHAIN * CHAIN)]
    if len(word) % CHAIN:
        word = np.resize(word, CHAIN)
    word = word.reshape(-1, CHAIN)
    return word, np.repeat(language, sizes)[word]


def trained(texts: list[bytes], labels: list[str], seed: int = 3, epochs: int = EPOCHS) -> Model:
    languages = sorted(set(labels))
    s = max(1, len(languages))
    model = Model(languages or ["und"], np.zeros((BUCKETS, s)), np.zeros((s, s)))
    if len(languages) < 2:
        return model
    rng = np.random.default_rng(seed)
    w = words_of(texts)
    sizes = np.diff(np.concatenate(([0], w.ends)))
    if not len(w.pieces):
        return model
    language = np.array([languages.index(x) for x in labels])
    balance = np.bincount(language, sizes, minlength=s)
    balance = balance.sum() / (s * np.maximum(balance, 1))  # all languages weigh the same
    gram_first = [np.searchsorted(word, np.arange(len(w.pieces) + 1)) for word in w.gram_word]
    seen, seen_t = np.full((BUCKETS, s), 1e-2), np.full((s, s), 1.0)
    for _ in range(epochs):
        word, truth = chains(sizes, language, rng)
        for part in np.array_split(rng.permutation(len(word)), max(1, len(word) // 64)):
            flat = word[part].reshape(-1)
            grams, of = [], []
            for first, all_grams in zip(gram_first, w.grams, strict=True):
                n = first[flat + 1] - first[flat]
                grams.append(all_grams[np.repeat(first[flat] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
                of.append(np.repeat(np.arange(len(flat)), n))
            own = Words(w.pieces[flat], grams, of, np.array([len(flat)]))
            score = evidence(model.weights, own).reshape(len(part), CHAIN, s)
            marginal, moved = forward_backward(score, np.full(len(part), CHAIN), model.transitions, True)
            y = truth[part]
            error = marginal.copy()
            np.put_along_axis(error, y[:, :, None], np.take_along_axis(error, y[:, :, None], 2) - 1, 2)
            error = (error * balance[y][:, :, None]).reshape(-1, s) / len(flat)
            rows = np.concatenate((own.pieces.reshape(-1), *own.grams))
            source = np.concatenate((np.repeat(np.arange(len(flat)), own.pieces.shape[1]), *own.gram_word))
            used, to = np.unique(rows, return_inverse=True)
            grad = np.stack([np.bincount(to, error[source, k], minlength=len(used)) for k in range(s)], 1)
            seen[used] += (grad * 100) ** 2
            model.weights[used] -= 0.3 * grad * 100 / np.sqrt(seen[used]) * 0.3
            real = np.zeros((s, s))
            np.add.at(real, (y[:, :-1].reshape(-1), y[:, 1:].reshape(-1)), 1)
            grad_t = (moved - real) / len(flat)
            seen_t += (grad_t * 10) ** 2
            model.transitions -= grad_t * 10 / np.sqrt(seen_t)
    return model


def fitted(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learns from usable documents of at most ``sample_chars`` characters that have an id and a language: all of a language's, or a share of about ``sample`` by a hash of doc_id.

    Of texts that repeat a doc_id and language the first in order counts. The
    model has a weight a feature for each language.
    """
    rows = docs.select(F.col("doc_id").alias("id"), column(lang).alias("lang"), text_of(text).alias("text"), usable.alias("usable")).where("usable and id is not null and lang is not null")
    # as many rows as languages; each row says which share of its language is taken
    share = rows.groupBy("lang").agg(F.count("*").alias("n")).select(F.col("lang").alias("of"), F.least(F.lit(1.0), sample / F.col("n")).alias("share"))
    point = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(small(share), F.col("lang") == F.col("of")).where((point < F.col("share")) & (F.length("text") <= sample_chars)).groupBy("id", "lang").agg(F.min("text").alias("text")).collect()
    picked = sorted(picked, key=lambda r: (r["id"], r["lang"]))
    return trained([r["text"].encode() for r in picked], [r["lang"] for r in picked])


def labelled(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row: the language that most words are expected in, and their share."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                rows = b.slice(lo, 256)
                out = model.predicted([t or b"" for t in rows.column(1).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "lang_pred": pa.array([x for x, _ in out], pa.string()), "score": pa.array([x for _, x in out], pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(label, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame, text: str = "text", sample: int = SAMPLE, folds: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    Rows whose crc32(doc_id as text) mod ``folds`` is 1 are held out. Null texts
    and texts without a letter are ``und`` with score 0, as is everything when no
    row can be learned from. Texts of any length are read whole; of languages that
    are expected equally often (a tie) the first by name is given. A null doc_id
    is not held out, and nothing is learned from it; repeated rows are labelled
    alike; an empty table gives no rows; extra columns are ignored, whatever their names.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    model = fitted(docs, F.coalesce(fold != 1, F.lit(True)), text, sample=sample)
    return labelled(docs, model, text).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
