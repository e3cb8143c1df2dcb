"""Packing token sequences with sources in target proportions.

Every source is a queue of tokens. A window of ``window_sequences`` sequences
gives each queue a quantum, its share of all tokens; a queue is served the
whole tokens of its credit, what rounding leaves goes round the queues to the
largest deficits, and the deficits, positive or negative, are carried on. As
credits grow by a fixed quantum, what a queue has been served before window w
follows from w alone (``served``); so every partition starts at its own first
window with the deficits that all windows before it leave.

Within a window the queues follow one another, cut at sequence ends. The last
tokens, fewer than a sequence, fill sequences of powers of two, without padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, count, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LENGTH = 2048
WINDOW_SEQUENCES = 32
#: Sources at most, as each task holds a number for each; more are refused.
SOURCES = 1 << 16
#: Words that a Python worker remembers the ids of, before those that it has not met again go: twice as many at most.
REMEMBERED = 1 << 19
#: ASCII marks that end words; one run of them is one pre-token.
MARKS = ".,!?;:%$&*#|"
#: A word of Latin-1 letters.
LATIN = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch

LETTERS = list(filter(LATIN, map(chr, range(256))))


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file, with words remembered.

    Only for tokenizers whose words are split at white space, which is dropped.
    """

    def __init__(self, path: str, remembered: int | None = None) -> None:
        from tokenizers import Tokenizer

        self.remembered = remembered or REMEMBERED
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        # whether a word of Latin-1 letters has the ids of the same word in lower case
        self.lowers = all(self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str(w) == self.tokenizer.normalizer.normalize_str(w.lower()) for w in LETTERS)
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """Remember the ids of new words; of a word that ends in marks, those of the word without them."""
        known, before = self.words, self.before
        new, split = [], []
        for w in words:
            core = w.rstrip(MARKS)
            # a last letter beyond Latin-1 may turn into a letter and a mark in lower case
            if len(core) < len(w) and core and core[-1] < "\u0100" and core.isalpha():
                split.append((w, core, w[len(core):]))
            else:
                new.append(w)
        # a difference from a dict looks up the set's members only
        parts = {c for _, c, _ in split}.union(m for _, _, m in split).difference(words).difference(known)
        for w in parts:
            if w in before:
                known[w] = before[w]
            else:
                new.append(w)
        self.remember(new)
        for w, core, marks in split:  # marks may be among the words, and split from none
            known[w] = known[core] + known[marks]

    def remember(self, words: list[str]) -> None:
        """Words of Latin-1 letters are one pre-token each, so many are encoded at a time, in lower case and once, and told apart by their word ends."""
        known, before = self.words, self.before
        plain = list(filter(LATIN, words))
        lower = list(map(str.lower, plain)) if self.lowers else plain
        # small words that are not met themselves are not remembered
        ids_of = {w: known.get(w) or before.get(w) for w in lower}
        new = [w for w, x in ids_of.items() if x is None]
        if new:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(new):
                flat = ids.tobytes()
                at = (at * ids.itemsize).tolist()
                ids_of.update(zip(new, map(flat.__getitem__, map(slice, [0, *at], at)), strict=True))
        known.update((w, ids_of[x]) for w, x in zip(plain, lower, strict=True) if ids_of[x] is not None)
        rest = [w for w in words if w not in known]
        known.update(zip(rest, self.whole(rest), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed."""
        # these are white space to Python and not to the tokenizer
        split = [None if "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t else t.split() for t in texts]
        # every word is looked up once; only those without ids are gathered, by where they stand
        found = [list(map(self.words.get, s or ())) for s in split]
        gaps = [list(compress(count(), map(is_, ids, repeat(None)))) for ids in found]
        new = {s[k] for s, at in zip(split, gaps, strict=True) for k in at}
        if len(self.words) + len(new) > self.remembered:  # what is not met again before the next time is forgotten then
            self.before, self.words = self.words, {}
            for s, ids in zip(split, found, strict=True):
                self.words.update((w, x) for w, x in zip(s or (), ids, strict=True) if x is not None)
        known, before = self.words, self.before
        unmet = new.difference(before)
        for w in new.difference(unmet):
            known[w] = before[w]
        if unmet:
            self.learn(unmet)
        for s, ids, at in zip(split, found, gaps, strict=True):
            for k in at:
                ids[k] = known[s[k]]
        return [b"".join(ids) if s is not None else self.whole([t])[0] for t, s, ids in zip(texts, split, found, strict=True)]


@lru_cache(maxsize=1)
def encoder(path: str, remembered: int | None) -> Encoder:
    return Encoder(path, remembered)


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = 1, text: str = "text", remembered: int | None = None) -> DataFrame:
    """part, source, doc_id, before (tokens of the source earlier in the part), n_tokens, ids; every document ends with ``end_id``."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # of what this worker ran before
        encode, part, before = encoder(tokenizer, remembered), TaskContext.get().partitionId(), {}
        end = encode.dtype(end_id).tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                rows = b.slice(lo, 256)
                ids = [x + end for x in encode.encode([t or "" for t in rows.column(2).to_pylist()])]
                starts = []
                for s, x in zip(rows.column(1).to_pylist(), ids, strict=True):
                    starts.append(before.get(s, 0))
                    before[s] = starts[-1] + len(x) // len(end)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * len(ids), pa.int32()), "source": rows.column(1), "doc_id": rows.column(0), "before": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array([len(x) // len(end) for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tokens, "part int, source string, doc_id long, before long, n_tokens long, ids binary")


class Layout:
    """Which queue's tokens stand where; ``totals`` are the tokens of each queue."""

    def __init__(self, totals: list[int], length: int = LENGTH, window: int = WINDOW_SEQUENCES * LENGTH) -> None:
        self.totals, self.length, self.window = np.array(totals, np.int64), length, window
        self.all = int(self.totals.sum())
        self.full = self.all // length * length
        # after the last whole sequence: sequences of powers of two, the largest first
        self.tail, at = [], self.full
        while at < self.all:
            size = 1 << ((self.all - at).bit_length() - 1)
            self.tail.append((at, size))
            at += size
        self.served = lru_cache(maxsize=max(16, (1 << 22) // max(1, len(totals))))(self._served)

    def _served(self, w: int) -> np.ndarray:
        """Tokens that each queue has been served before window ``w``; they sum to the tokens of all windows before."""
        due = min(w * self.window, self.all)
        if due == self.all:
            return self.totals
        credit = self.totals * (due / self.all)
        served = np.clip(np.floor(credit + 0.5).astype(np.int64), 0, self.totals)
        share = np.maximum(self.totals, 1)
        more = lambda: np.where(served < self.totals, (served + 0.5) / share, np.inf)  # noqa: E731  when each queue's next token is due
        last = lambda: np.where(served > 0, (served - 0.5) / share, -np.inf)
        for _ in range(int(served.sum()) - due):
            served[len(served) - 1 - np.argmax(last()[::-1])] -= 1
        for _ in range(due - int(served.sum())):
            served[np.argmin(more())] += 1
        while (late := last()).max() > (early := more()).min():
            served[len(served) - 1 - np.argmax(late[::-1])] -= 1
            served[np.argmin(early)] += 1
        return served

    def pieces(self, queue: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(sequence, offset, start in the document, length) of the queue's tokens start .. start + n."""
        w = int(start * self.all / max(1, int(self.totals[queue])) / self.window)
        while w and self.served(w)[queue] > start:
            w -= 1
        at, end = start, start + n
        while at < end:
            lo, hi = self.served(w), self.served(w + 1)
            if hi[queue] > at:
                g = w * self.window + int((hi[:queue] - lo[:queue]).sum()) + at - int(lo[queue])
                upto = min(end, int(hi[queue]))
                while at < upto:
                    seq, offset, room = self.place(g)
                    take = min(room, upto - at)
                    yield seq, offset, at - start, take
                    at, g = at + take, g + take
            w += 1

    def place(self, g: int) -> tuple[int, int, int]:
        if g < self.full:
            return g // self.length, g % self.length, self.length - g % self.length
        for k, (at, size) in enumerate(self.tail):
            if g < at + size:
                return self.full // self.length + k, g - at, at + size - g
        raise IndexError(g)


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, text: str = "text", length: int = LENGTH, window_sequences: int = WINDOW_SEQUENCES, with_ids: bool = True, remembered: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, and, if ``with_ids``, ids.

    remembered: words that a Python worker keeps the ids of, REMEMBERED if not given; fewer take less memory and more time, and change no row.

    Null text is empty and gives the end id alone; texts of any length are read
    whole and cut where sequences end; null ids are ids like others; null sources
    share a queue; repeated rows are packed each; queues whose tokens are due at
    the same time (a tie) are served in the order of their names, null last. An
    empty table gives no pieces; other columns are ignored, whatever their
    names. More than SOURCES sources are refused with a ValueError.
    """
    rows = stored(tokenised(docs, tokenizer, end_id, text, remembered), "tokens")
    by_source = rows.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    totals = by_source.orderBy(F.col("source").asc_nulls_last()).limit(SOURCES + 1).collect()
    if len(totals) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    queues = F.broadcast(rows.sparkSession.createDataFrame([(r["source"], i) for i, r in enumerate(totals)], "_source string, queue int"))
    rows = rows.join(queues, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # where each part's tokens of a source begin in the queue
    parts = rows.groupBy("queue", "part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("queue").alias("_q"), F.col("part").alias("_p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    layout_of = ([r["n"] for r in totals], length, window_sequences * length)
    rows = rows.join(parts, (F.col("queue") == F.col("_q")) & (F.col("part") == F.col("_p")))
    rows = rows.select("doc_id", "source", "queue", (F.col("_before") + F.col("before")).alias("at"), "n_tokens", "ids")

    n_columns = len(PIECE_NAMES) - (not with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(*layout_of)
        for b in (whole.slice(lo, 256) for whole in batches for lo in range(0, whole.num_rows, 256)):
            out: list[tuple] = []
            for doc, source, queue, at, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                whole = np.frombuffer(ids, np.uint16 if len(ids) == 2 * n else np.uint32).astype("<u4")
                for seq, offset, start, take in layout.pieces(queue, at, n):
                    piece = whole[start:start + take].tobytes()
                    out.append((doc, start, take, zlib.crc32(piece), n, seq, offset, source, *((piece,) if with_ids else ())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PIECE_TYPES[:n_columns], strict=True)], names=PIECE_NAMES[:n_columns])

    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + (", ids binary" if with_ids else ""))


PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"]
PIECE_TYPES = [pa.int64()] * 7 + [pa.string(), pa.binary()]
