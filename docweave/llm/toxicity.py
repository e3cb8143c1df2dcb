"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of those of its hashed pieces, the whole word and
its first bytes, so inflected and made-up forms share what they share; filters of several widths slide over a text, each
keeps its largest response over the whole text, and a logistic layer weighs
these. All labelled rows are learned from, in parts of about the same number by a
hash of doc_id: in each epoch every part goes on from the same model in one task, and
the models of the parts are averaged. Few labelled rows are one part. Scoring
runs over all rows in Arrow batches. A filter's response to a place is a sum of
one table entry for each word under it, so scoring is gathers and maxima.

Decision thresholds are calibrated by language, guessed from function words in
the text alone, and folded into the score: 0.5 is the threshold everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forgotten, partitions, small, stored, text_of
from .shingles import mixed, prefix_hashes, substring_hashes

BUCKETS = 1 << 15
DIMENSIONS = 16
FILTERS = 12
WIDTHS = (1, 2, 3)
#: First bytes of a word that are pieces of it, beside the whole word.
PREFIXES = (4, 5, 6, 7)
#: Places of a text that are scored at once.
PLACES = 1 << 16
EPOCHS = 8
#: Half the labelled rows of a part, about; all parts are learned from.
SAMPLE = 3000
#: Tasks that parts are dealt to, at most: each sends one model to the driver.
TASKS = 32
#: Texts, and bytes of them, that are shuffled in memory at most.
WINDOW, WINDOW_BYTES = 1 << 12, 1 << 25
#: Steps a unit of logits that thresholds are told apart by.
STEPS = 1024
#: Words of fewer texts than this are one unknown word.
RARE = 3
#: Function words by language.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine in im mit von zu den dem auf für auch",
    "en": "the and of to in is it that was for on with as at by this are be from",
    "es": "el la los las de que y en un una es por con no se del para lo al",
    "fr": "le la les de et un une des du que qui est dans pour en sur pas par au avec",
}


def word_pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of every word and of its prefixes, where each text's words end): letters only, A-Z in lower case; words without letters hash alike."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    edge = np.diff(np.concatenate(([1], blank.view(np.int8), [1])))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    before = np.concatenate(([0], np.cumsum(letter)))
    lo, hi, prefix = before[start], before[end], prefix_hashes(data[letter])
    hashes = [mixed(substring_hashes(prefix, lo, hi))]
    hashes += [mixed(substring_hashes(prefix, lo, np.minimum(hi, lo + k)) + np.uint64(k)) for k in PREFIXES]
    return np.stack(hashes, 1), np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))


def hash_of(words: str) -> np.ndarray:
    return np.array([word_pieces([w.encode()])[0][0, 0] for w in words.split()], np.uint64)


LANGUAGES = sorted(FUNCTION_WORDS)


def language_table() -> tuple[np.ndarray, np.ndarray]:
    hashes = np.concatenate([hash_of(FUNCTION_WORDS[x]) for x in LANGUAGES])
    of = np.concatenate([np.full(len(FUNCTION_WORDS[x].split()), i) for i, x in enumerate(LANGUAGES)])
    by = np.argsort(hashes, kind="stable")
    return hashes[by], of[by]


def guessed(words: np.ndarray, ends: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each text the language with the most function words, or one more than the last language if there are none."""
    hashes, of = table
    doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
    votes = np.zeros((len(ends), len(LANGUAGES)), np.int64)
    lo, hi = np.searchsorted(hashes, words), np.searchsorted(hashes, words, "right")
    for k in range(int((hi - lo).max()) if len(words) else 0):
        some = lo + k < hi
        np.add.at(votes, (doc[some], of[lo[some] + k]), 1)
    return np.where(votes.sum(1) > 0, votes.argmax(1), len(LANGUAGES))


@dataclass
class Model:
    known: np.ndarray  # bool by bucket
    embedding: np.ndarray
    filters: list[np.ndarray]  # by width: (width, DIMENSIONS, FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    intercept: float
    thresholds: np.ndarray  # logits, by guessed language

    def buckets(self, words: np.ndarray) -> np.ndarray:
        at = (words % np.uint64(BUCKETS - 2)).astype(np.int32) + np.int32(2)  # 0 pads, 1 is unknown
        return np.where(self.known[at], at, np.int32(1))

    def table(self) -> np.ndarray:
        """What each piece adds under each place of each filter: one row a piece."""
        return np.concatenate([self.embedding @ place for f in self.filters for place in f], 1).astype(np.float32)

    def logits(self, pieces: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
        """One logit a text; texts stand one after another, each followed by padding as wide as the widest filter."""
        n, pad = len(ends), max(WIDTHS)
        size = np.diff(np.concatenate(([0], ends))) + pad
        padded = np.zeros((int(size.sum()) + pad, pieces.shape[1]), np.int32)
        padded[np.arange(len(pieces)) + np.repeat(np.arange(n) * pad, size - pad)] = pieces
        text = np.repeat(np.arange(n), size)
        # a place is a word; a text without words has one, of padding
        place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
        beyond = place >= np.repeat(np.maximum(size - pad, 1), size)
        pooled = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        for lo in range(0, len(text), PLACES):
            hi = min(lo + PLACES, len(text))
            near = padded[lo:hi + pad]
            each = table[near[:, 0]]
            for k in range(1, near.shape[1]):
                each += table[near[:, k]]
            own = text[lo:hi]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            column = 0
            for w, width in enumerate(WIDTHS):
                part = slice(w * FILTERS, (w + 1) * FILTERS)
                response = sum(each[j:hi - lo + j, (column + j) * FILTERS:(column + j + 1) * FILTERS] for j in range(width))
                column += width
                response[beyond[lo:hi]] = -np.inf
                best = np.maximum.reduceat(response, first, axis=0)
                pooled[own[first], part] = np.maximum(pooled[own[first], part], best)
        return np.maximum(pooled + self.bias, 0) @ self.weights + self.intercept

    def scores(self, texts: list[bytes], table: np.ndarray, languages: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        pieces, ends = word_pieces(texts)
        shift = self.thresholds[guessed(pieces[:, 0], ends, languages)]
        return 1 / (1 + np.exp(-np.clip(self.logits(self.buckets(pieces), ends, table) - shift, -50, 50).astype(np.float64)))


def initial(known: np.ndarray, n: int, positive: int, rng: np.random.Generator) -> Model:
    """A model that has learned nothing. Without both classes it scores everything by their share."""
    model = Model(known, rng.normal(0, 0.3, (BUCKETS, DIMENSIONS)).astype(np.float32), [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
                  np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0, np.zeros(len(LANGUAGES) + 1))
    model.embedding[0] = 0
    if 0 < positive < n:
        model.intercept = float(np.log(positive / (n - positive)))
    else:
        model.weights[:] = 0
        model.intercept = 0.0 if not n else 4.0 if positive else -4.0
    return model


class Learner:
    """A model with the sums of squared gradients (Adagrad) of its parameters."""

    def __init__(self, model: Model, totals: dict[str, np.ndarray] | None = None) -> None:
        self.model = model
        self.held = {"e": model.embedding, "b": model.bias, "u": model.weights, "c": np.array([model.intercept])} | {f"f{w}": f for w, f in enumerate(model.filters)}
        self.totals = totals or {k: np.full(v.shape, 1e-3, v.dtype) for k, v in self.held.items()}

    def copy(self) -> Learner:
        m = self.model
        return Learner(Model(m.known, m.embedding.copy(), [f.copy() for f in m.filters], m.bias.copy(), m.weights.copy(), m.intercept, m.thresholds), {k: v.copy() for k, v in self.totals.items()})

    def step(self, name: str, grad: np.ndarray, rows=slice(None), rate: float = 0.05) -> None:
        value, total = self.held[name], self.totals[name]
        total[rows] += grad ** 2
        value[rows] -= rate * grad / np.sqrt(total[rows])

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> None:
        """One batch of texts, as buckets of word pieces followed by padding."""
        model, pad, wide = self.model, max(WIDTHS), len(WIDTHS) * FILTERS
        back = np.concatenate(texts)
        ends = np.cumsum([len(t) for t in texts]).tolist()
        words = model.embedding[back[:, 0]]
        for k in range(1, back.shape[1]):
            words += model.embedding[back[:, k]]
        pooled, places = np.empty((len(texts), wide), np.float32), np.empty((len(texts), wide), np.int64)
        for w, f in enumerate(model.filters):
            response = words @ f[0]
            for j in range(1, len(f)):
                response[:len(back) - j] += words[j:] @ f[j]
            lo = 0
            for d, hi in enumerate(ends):
                span = response[lo:max(lo + 1, hi - pad)]
                best = span.argmax(0)
                places[d, w * FILTERS:(w + 1) * FILTERS] = lo + best
                pooled[d, w * FILTERS:(w + 1) * FILTERS] = span[best, np.arange(FILTERS)]
                lo = hi
        hidden = np.maximum(pooled + model.bias, 0)
        keep = ((rng.random(hidden.shape) > 0.3) / 0.7).astype(np.float32)  # dropout
        logit = (hidden * keep) @ model.weights + model.intercept
        error = ((1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels) / len(texts)).astype(np.float32)
        down = error[:, None] * model.weights * keep * (hidden > 0)
        rows, grads = [], []
        for w, f in enumerate(model.filters):
            part = slice(w * FILTERS, (w + 1) * FILTERS)
            grad_f = np.zeros_like(f)
            for j in range(len(f)):
                word = np.minimum(places[:, part] + j, len(back) - 1)  # (texts, FILTERS)
                grad_f[j] = np.einsum("df,dfk->kf", down[:, part], words[word])
                rows.append(back[word].reshape(-1, back.shape[1]))
                grads.append((down[:, part, None] * f[j].T[None]).reshape(-1, DIMENSIONS))
            self.step(f"f{w}", grad_f + np.float32(1e-5) * f)
        rows = np.concatenate(rows)
        used, to = np.unique(rows, return_inverse=True)
        grad_e = np.zeros((len(used), DIMENSIONS), np.float32)
        np.add.at(grad_e, to.reshape(rows.shape), np.concatenate(grads)[:, None, :])
        grad_e[used == 0] = 0
        self.step("e", grad_e, used)
        self.step("b", down.sum(0))
        self.step("u", (hidden * keep).T @ error + np.float32(1e-4) * model.weights)
        model.intercept -= 0.1 * float(error.sum())

    def pass_over(self, pieces: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> None:
        """Once over texts given as hashes of word pieces, in an order by chance."""
        padding = lambda t: np.zeros((max(WIDTHS), t.shape[1]), np.int32)
        for batch in np.array_split(rng.permutation(len(pieces)), max(1, len(pieces) // 32)):
            self.learn([np.concatenate((self.model.buckets(pieces[i]), padding(pieces[i]))) for i in batch], labels[batch], rng)

    def sums(self, before: Learner, n: int) -> list[np.ndarray]:
        """What is added over parts, each by its rows: parameters and totals, and of embeddings only those that the part moved."""
        moved = (self.totals["e"] != before.totals["e"]).any(1)
        self.held["c"][0] = self.model.intercept
        out = [np.array([n], np.float64), n * moved.astype(np.float64)]
        for k in sorted(self.held):
            some = moved[:, None] if k == "e" else 1.0
            out += [n * some * self.held[k].astype(np.float64), n * some * self.totals[k].astype(np.float64)]
        return out

    def averaged(self, sums: list[np.ndarray]) -> Learner:
        """The parts' learners as one; embeddings that none moved stay."""
        (n,), moved, *rest = sums
        out = self.copy()
        for k, value, total in zip(sorted(self.held), rest[::2], rest[1::2], strict=True):
            if k == "e":
                some = moved > 0
                out.held[k][some] = value.reshape(out.held[k].shape)[some] / moved[some, None]
                out.totals[k][some] = total.reshape(out.held[k].shape)[some] / moved[some, None]
            else:
                out.held[k][...] = value.reshape(out.held[k].shape) / n
                out.totals[k][...] = total.reshape(out.held[k].shape) / n
        out.model.intercept = float(out.held["c"][0])
        return out


def buckets_seen(pieces: np.ndarray) -> np.ndarray:
    return np.unique((pieces % np.uint64(BUCKETS - 2)).astype(np.int64)) + 2


def known_of(seen: np.ndarray) -> np.ndarray:
    known = seen >= RARE
    known[:2] = True
    return known


def trained(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """A model of texts in memory, given as hashes of word pieces: one part."""
    rng = np.random.default_rng(seed)
    seen = np.zeros(BUCKETS, np.int64)
    for t in texts:
        seen[buckets_seen(t)] += 1
    learner = Learner(initial(known_of(seen), len(labels), int(labels.sum()), rng))
    if 0 < labels.sum() < len(labels):
        for _ in range(epochs):
            learner.pass_over(texts, labels, rng)
    return learner.model


def calibrated(model: Model, logits: np.ndarray, language: np.ndarray, hits: np.ndarray, rows: np.ndarray, least: int = 20) -> Model:
    """Sets each language's threshold where F1 over texts not trained on is best; a language with fewer than ``least`` of a class takes that of all.

    For each logit and language: positive rows, and all rows.
    """
    def best(mask: np.ndarray) -> float | None:
        z, at = np.unique(logits[mask], return_inverse=True)
        hit, out = np.bincount(at, hits[mask], len(z))[::-1], np.bincount(at, rows[mask], len(z))[::-1]
        z, positive = z[::-1], hits[mask].sum()
        if min(positive, rows[mask].sum() - positive) < least:
            return None
        f1 = 2 * np.cumsum(hit) / (np.cumsum(out) + positive)
        # the middle of the best stretch
        k = np.flatnonzero(f1 >= f1.max() - 1e-12)
        k = int(k[len(k) // 2])
        return float((z[k] + z[min(k + 1, len(z) - 1)]) / 2)

    everything = best(np.ones(len(logits), bool))
    if everything is not None:
        model.thresholds[:] = everything
        for i in range(len(LANGUAGES)):
            own = best(language == i)
            if own is not None:
                model.thresholds[i] = own
    return model


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, label: str, text: str, sample: int) -> DataFrame:
    """part, aside (whether it calibrates), label, text of every labelled document, parts together and in an order by a hash of doc_id.

    Of labels that contradict one another the largest counts, of texts that repeat a doc_id the first in order.
    """
    known = labels.where(usable & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))
    parts = max(1, -(-known.count() // (2 * sample)))
    texts = docs.select("doc_id", text_of(text).alias("text"))
    again = texts.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("again"))
    rows = texts.join(small(known.join(small(again), "doc_id", "left")), "doc_id")
    once = rows.where("again is null").select("doc_id", "label", "text")
    rows = once.unionByName(rows.where("again").groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    place = F.xxhash64("doc_id")
    rows = rows.select((F.pmod(place, F.lit(parts))).cast("int").alias("part"), (F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(4)) == 3).alias("aside"), F.xxhash64(F.lit("order"), "doc_id").alias("at"), "doc_id", "label", "text")
    rows = rows.repartition(min(parts, partitions(docs.sparkSession)), "part").sortWithinPartitions("part", "at", "doc_id").select("part", "aside", "label", "text")
    return stored(rows, "labelled", compression="zstd")


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(part, texts, labels): rows of one part that fit in memory together, in order; columns part, label, text."""
    part, texts, labels, size = None, [], [], 0
    for b in batches:
        for p, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
            if texts and (p != part or len(texts) >= WINDOW or size >= WINDOW_BYTES):
                yield part, texts, np.array(labels, np.float64)
                texts, labels, size = [], [], 0
            part = p
            texts.append(t)
            labels.append(y)
            size += len(t)
    if texts:
        yield part, texts, np.array(labels, np.float64)


def summed(rows: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], list[np.ndarray] | None]) -> list[np.ndarray] | None:
    """The sum of what each task returns: arrays of the same sizes, added up on the driver as they are, one set a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = task(batches)
        if arrays is not None:
            yield pa.RecordBatch.from_pydict({"sizes": pa.array([[a.size for a in arrays]], pa.list_(pa.int64())), "data": pa.array([np.concatenate([a.ravel() for a in arrays]).astype(np.float32).tobytes()], pa.binary())})

    found, sizes = None, None
    for r in rows.mapInArrow(run, "sizes array<long>, data binary").collect():
        one = np.frombuffer(r["data"], np.float32).astype(np.float64)
        found, sizes = one if found is None else found + one, r["sizes"]
    return None if found is None else np.split(found, np.cumsum(sizes)[:-1])


def fitted(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", text: str = "text", sample: int = SAMPLE, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """A model of all labelled rows."""
    spark = docs.sparkSession
    rows = labelled(docs, labels, usable, label, text, sample)
    learned = rows.where("not aside").select("part", "label", "text").coalesce(TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
        seen, n = np.zeros(BUCKETS), np.zeros(2)
        for _, texts, y in windows(batches):
            n += len(y), y.sum()
            for t in texts:
                seen[buckets_seen(word_pieces([t])[0])] += 1
        return [n, seen] if n[0] else None

    (n, positive), seen = summed(learned, count) or (np.zeros(2), np.zeros(BUCKETS))
    learner = Learner(initial(known_of(seen), int(n), int(positive), np.random.default_rng(seed)))
    for epoch in range(epochs if 0 < positive < n else 0):
        shared = spark.sparkContext.broadcast(learner)

        def train(batches: Iterator[pa.RecordBatch], shared=shared, epoch=epoch) -> list[np.ndarray] | None:
            before, total, part, own, size, rng = shared.value, None, None, None, 0, None
            def done(total: list[np.ndarray] | None) -> list[np.ndarray] | None:
                one = own.sums(before, size)
                return one if total is None else [a + b for a, b in zip(total, one, strict=True)]

            for p, texts, y in windows(batches):
                if p != part:
                    total = total if own is None else done(total)
                    part, own, size, rng = p, before.copy(), 0, np.random.default_rng((seed, epoch, p))
                own.pass_over([word_pieces([t])[0] for t in texts], y, rng)
                size += len(texts)
            return None if own is None else done(total)

        learner = learner.averaged(summed(learned, train))
        shared.unpersist()
    model, shared = learner.model, spark.sparkContext.broadcast(learner.model)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table, languages = model.table(), language_table()
        for _, texts, y in windows(batches):
            for lo in range(0, len(texts), 256):
                pieces, ends = word_pieces(texts[lo:lo + 256])
                z = np.rint(model.logits(model.buckets(pieces), ends, table).astype(np.float64) * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"language": pa.array(guessed(pieces[:, 0], ends, languages), pa.int64()), "z": pa.array(z), "hit": pa.array(y[lo:lo + 256].astype(np.int64))})

    held = rows.where("aside").select("part", "label", "text").mapInArrow(logits, "language long, z long, hit long")
    at = np.array(held.groupBy("language", "z").agg(F.sum("hit"), F.count("*")).collect(), np.float64).reshape(-1, 4)
    forgotten(rows)
    return calibrated(model, at[:, 1] / STEPS, at[:, 0], at[:, 2], at[:, 3])


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, score for every row; null and empty texts score as texts of no words, repeated rows alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table, languages = model.table(), language_table()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                rows = b.slice(lo, 256)
                texts = [t or b"" for t in rows.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "score": pa.array(model.scores(texts, table, languages))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(score, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    All other labelled rows are learned from, in parts of about 2 * ``sample`` rows.
    Rows whose crc32(doc_id as text) mod ``folds`` is 0 are held out of training
    and calibration. With no labels, or of one class only, all scores are equal.
    A null doc_id is not held out, and nothing is learned from it. Null and empty
    texts get the score of no words, texts of any length are scored whole, repeated
    rows are scored alike, and equal scores (a tie) are left as they are. An
    empty table gives no rows; extra columns are ignored, whatever their names.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    model = fitted(docs, labels, fold != 0, text=text, sample=sample)
    out = scored(docs, model, text)
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
