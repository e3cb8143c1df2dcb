"""Self-join of documents on the Jaccard similarity of their word shingles.

Tokens are hashed shingles in one global order, rare ones before frequent ones.
Two sets as similar as asked share at least g + 1 tokens within prefixes that are
extended by g. Either one of these is rare, and is a key by itself, or all are
frequent; then two of them are in one of g classes of tokens, and every two
tokens of a class are a key. With g about the number of members that may differ,
keys stay in proportion to the set, and no list of the index is as long as a
frequent token is common, unless two of one class meet in the prefixes of as
many documents.

A small sketch tells large sets apart no more. So sets of a band of sizes beyond
``told`` are cut by a hash of their members into 2 ** fold parts: two similar sets
have a part in which they differ in no more members than an equal share of what
they may differ in, and what was said of sets holds of their parts. Keys of such
sets are a part's, and an entry holds the sketch of the part.

Documents of equal sets are one from the start, named by a 128-bit digest; the index
uses its first half, where a false match costs time only. Most
keys are one document's alone; a first pass over their names alone finds the
others, and only those are listed. Buckets of lists that grow too large are dealt
to blocks, and every two blocks meet in a task. Lists are pruned by length and by parity sketches, which never overcount a difference, and give edges that
keep every true link connected. The components of these edges are then verified
with whole sets, in units of bounded rows and bytes, and the verified links give the
components that are returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, forgotten, partitions, small, stored, text_of, unused
from .components import components
from .shingles import ODD, mixed, shingle_sets, sketches

WORDS = 4
PERCENT = 85
#: Frequent tokens that are told apart; all others are rare.
FREQUENT = 1 << 18
#: A token counts as frequent from so many documents on, and is named by a task from SOME on.
OFTEN, SOME = 32, 3
SKETCH = 256
#: Sets up to this size at most are told apart by a sketch of SKETCH bits; see ``told``.
TOLD = 800
#: Sets whose sketches differ in no more bits than this, and than half of what similar ones may, are taken as linked in the index: such pairs give a spanning forest.
SURE = SKETCH // 4
#: Of lists longer than this, all pairs of sets that the sketch tells apart give a spanning forest, and of those longer than LONG_LIST all pairs that it allows. Other pairs are given all, for a larger sketch to settle, unless the forest connects them.
LIST, LONG_LIST = 32, 512
#: Bits of the filter of keys that stand in two places or more; more keys than it can tell apart cost shuffled bytes, never links.
SHARED_BITS = 1 << 27
#: Size of the Bloom filters of document ids.
BLOOM_BITS = 1 << 23
#: Sets of a verification unit's chunk, and bytes of them.
CHUNK, CHUNK_BYTES = 2048, 16 << 20
#: Bytes of listed entries from which a bucket is dealt to blocks of about that size.
BLOCK_BYTES = 64 << 20
#: An entry of a list; s is the sketch of one of 2 ** fold parts of a set of n.
ENTRY = np.dtype([("key", "<u8"), ("id", "<i8"), ("n", "<u4"), ("fold", "u1"), ("s", "<u8", SKETCH // 64)])
#: Bytes of texts that are taken at a time, unless a single one has more.
ROOM = 1 << 19
#: Ranges of tokens that are counted one after another.
RANGES = 8


def overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap of a set of n with one that is similar enough."""
    return -(-n * percent // 100)


def difference(total: np.ndarray, percent: int) -> np.ndarray:
    """The most members in just one of two similar sets of ``total`` members together."""
    return total * (100 - percent) // (100 + percent)


def told(percent: int) -> int:
    """Sets up to this size are told apart by a sketch of SKETCH bits: two such may differ in a third of its bits, and unrelated sets differ in about half."""
    return min(TOLD, SKETCH // 3 * (100 + percent) // (2 * max(1, 100 - percent)))


def digest_of(s: np.ndarray) -> bytes:
    """The name of a set: 128 bits."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def node_of(digest: bytes) -> int:
    """The first half of a name, which the index uses."""
    return int.from_bytes(digest[:8], "little", signed=True)


def texts_of(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256, room: int = ROOM) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, and of at most ``room`` bytes of text or a single row."""
    for b in batches:
        size = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        upto, lo = np.cumsum(size), 0
        while lo < b.num_rows:
            hi = int(np.searchsorted(upto, upto[lo] - size[lo] + room, "right"))
            hi = min(lo + rows, max(lo + 1, hi), b.num_rows)
            yield b.slice(lo, hi - lo)
            lo = hi


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, digest of the set, node for each document."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            sets = shingle_sets(texts_of(b, 1), words)
            digests = [digest_of(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n": pa.array([len(s) for s in sets], pa.int64()), "digest": pa.array(digests, pa.binary()),
                                               "node": pa.array([d and node_of(d) for d in digests], pa.int64())})

    return docs.mapInArrow(profile, "doc_id long, n long, digest binary, node long")


def probed(docs: DataFrame) -> DataFrame:
    """``docs`` with the places that a Bloom filter has for doc_id."""
    return docs.select("doc_id", "text", *[F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(BLOOM_BITS)).alias(f"h{k}") for k in range(3)])


def among(batches: Iterator[pa.RecordBatch], bloom: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``probed`` that the filter holds."""
    for b in in_slices(batches):
        hit = np.ones(b.num_rows, bool)
        for h in b.columns[2:]:
            at = h.to_numpy()
            hit &= (bloom[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        b = b.filter(pa.array(hit))
        if b.num_rows:
            yield b


def recounted(tokens: np.ndarray, counts: np.ndarray, new: np.ndarray, n: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The Misra-Gries summary of (tokens, counts) and (new, n): sums, less the first count that has no place among ``keep``."""
    tokens, counts = np.concatenate((tokens, new)), np.concatenate((counts, n))
    by = np.argsort(tokens, kind="stable")
    tokens, counts = tokens[by], counts[by]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(tokens)), bool), tokens[1:] != tokens[:-1])))
    tokens, counts = tokens[first], np.add.reduceat(counts, first) if len(first) else counts
    if len(counts) > keep:
        counts = counts - np.partition(counts, -keep - 1)[-keep - 1]
        tokens, counts = tokens[counts > 0], counts[counts > 0]
    return tokens, counts


def frequent_tokens(docs: DataFrame, reps: DataFrame, words: int, keep: int, often: int) -> np.ndarray:
    """At most ``keep`` tokens that many documents of different sets hold, the rarest first: Misra-Gries in every task, then sums.

    Which tokens are found has no effect on the links, only on the lists' lengths.
    """
    bloom = docs.sparkSession.sparkContext.broadcast(present(reps.select(F.col("rep").alias("id"))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, total = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * RANGES, 0
        held: list[np.ndarray] = []

        def settle() -> None:
            new, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            # one range of tokens after another, so that little is held twice
            ends = [0, *np.searchsorted(new, (np.arange(1, RANGES, dtype=np.uint64) * np.uint64((1 << 64) // RANGES))).tolist(), len(new)]
            for k in range(RANGES):
                part = slice(ends[k], ends[k + 1])
                tables[k] = recounted(*tables[k], new[part], n[part], 8 * keep // RANGES)

        for b in among(batches, bloom.value):
            sets = shingle_sets(texts_of(b, 1), words)
            held += sets
            total += sum(map(len, sets))
            if sum(map(len, held)) > 1 << 19:
                settle()
        if held:
            settle()
        for tokens, counts in tables:
            some = counts >= max(SOME, total // (8 * keep))
            yield pa.RecordBatch.from_pydict({"token": pa.array(tokens[some].view(np.int64)), "n": pa.array(counts[some])})

    found = probed(docs).mapInArrow(count, "token long, n long")
    rows = found.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= often).orderBy(F.desc("n"), "token").limit(keep).toPandas()
    return rows["token"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def bands(n: int, percent: int) -> set[int]:
    """Bands of sizes, by powers of two, that the larger of a similar pair with a set of n may be in."""
    return set(range(n.bit_length(), (100 * n // percent).bit_length() + 1))


def fold_in(band: int, percent: int) -> int:
    """Sets of a band are cut to 2 ** this parts, so that a sketch of SKETCH bits tells parts apart."""
    return max(0, (((1 << band) - 1) // (told(percent) + 1)).bit_length())


def classes_in(band: int, percent: int, fold: int = 0) -> int:
    """How many classes frequent tokens are dealt to for pairs of sets, or of their parts, in a band: about as many as members may differ, fewer than must be shared."""
    least = 1 << band >> 1 + fold
    return min(max(1, least * (100 - percent) * 3 // 200), least * percent * percent // 10_000 - 1)


def combinations(common: np.ndarray, classes: int, band: int) -> np.ndarray:
    """A key for every two tokens of one class; ``common`` is in the global order."""
    cls = mixed(common + ODD[1]) % np.uint64(classes)
    by = np.argsort(cls, kind="stable")
    tokens, cls = common[by], cls[by]
    keys, apart = [np.zeros(0, np.uint64)], 1
    while apart < len(tokens) and (same := cls[apart:] == cls[:-apart]).any():
        keys.append(mixed(tokens[:-apart][same] * ODD[2] + tokens[apart:][same] * ODD[3] + np.uint64(band)))
        apart += 1
    return np.concatenate(keys)


@dataclass
class Keys:
    """Keys of one set, part by part."""

    keys: list[np.ndarray]
    counts: list[np.ndarray]  # keys of each part
    folds: list[np.ndarray]  # of each part
    marks: list[np.ndarray]  # sketch of each part

    def add(self, keys: np.ndarray, counts: np.ndarray, fold: int, marks: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts.astype(np.uint32))
        self.folds.append(np.full(len(counts), fold, np.uint8))
        self.marks.append(marks)


def parted(s: np.ndarray, is_frequent: np.ndarray, rank: np.ndarray, percent: int, band: int, fold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, how many of each part, sketch of each part) of a set for pairs of a band whose sets are cut to 2 ** fold parts; rank: of frequent tokens.

    Of two similar sets there is a part in which no more than ``most`` members are in
    one of them only. There they share a token of the first ``most`` + 1; with
    ``classes`` more, they share ``classes`` + 1, if they have as many in
    common. If not, both have few members there, and a key of their own for that.
    """
    n, parts = len(s), 1 << fold
    most = int(difference(n + min(100 * n // percent, (1 << band) - 1), percent)) >> fold
    classes = max(0, classes_in(band, percent, fold))
    part = (s * ODD[1] >> np.uint64(64 - fold)).astype(np.int64)
    marks = np.bincount(part * SKETCH + (s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=parts * SKETCH) & 1
    marks = np.packbits(marks.astype(np.uint8), bitorder="little").view(np.uint64).reshape(parts, -1)
    ordered = np.concatenate((np.flatnonzero(~is_frequent), np.flatnonzero(is_frequent)[np.argsort(rank)]))
    by = ordered[np.argsort(part[ordered], kind="stable")]
    tokens, of = s[by], part[by]
    size, rares = np.bincount(of, minlength=parts), np.bincount(of[~is_frequent[by]], minlength=parts)
    first = np.cumsum(size) - size
    named = lambda tokens: mixed(tokens * ODD[3] + np.uint64(band))
    taken = ~is_frequent[by] & (np.arange(n) - first[of] <= most)
    keys, places = [named(tokens[taken])], [of[taken]]
    for k in np.flatnonzero(rares <= most).tolist():
        left, lo = most + 1 - int(rares[k]), int(first[k] + rares[k])
        common = tokens[lo:min(lo + left + classes, int(first[k] + size[k]))]
        more = [combinations(common, classes, band) if classes else named(common)]
        if size[k] <= most + classes:
            more.append(mixed(np.array([k + 1], np.uint64) * ODD[4] + np.uint64(band)))
        keys += more
        places += [np.full(len(x), k) for x in more]
    keys, places = np.concatenate(keys), np.concatenate(places)
    return keys[np.argsort(places, kind="stable")], np.bincount(places, minlength=parts), marks


def keyed(s: np.ndarray, frequent: np.ndarray, order: np.ndarray, percent: int) -> Keys:
    """The keys of one set. frequent: sorted; order: the rank of each, by how rare it is.

    Two similar sets share a rare token of their prefixes, or prefixes of both
    reach into the frequent tokens. Then prefixes extended by g share g + 1
    tokens: a rare one, or frequent ones only, two of which are in one of g classes.
    """
    n, out = len(s), Keys([], [], [], [])
    if overlap(n, percent) == n == 100 * n // percent:
        return out  # similar only to an equal set
    at = np.minimum(np.searchsorted(frequent, s), max(0, len(frequent) - 1))
    is_frequent = frequent[at] == s if len(frequent) else np.zeros(n, bool)
    rank = order[at[is_frequent]]
    folds = {band: fold_in(band, percent) for band in sorted(bands(n, percent))}
    if 0 in folds.values():
        prefix = n - overlap(n, percent) + 1
        rare = s[~is_frequent][:prefix]
        left, keys = prefix - len(rare), [rare]
        if left > 0 and is_frequent.any():
            common = s[is_frequent][np.argsort(rank)]
            for band in (b for b, fold in folds.items() if not fold):
                classes = classes_in(band, percent)
                # sets that may share a single token have no two to combine
                keys.append(combinations(common[:left + classes], classes, band) if classes > 0 else common[:left])
        keys = np.concatenate(keys)
        out.add(keys, np.array([len(keys)]), 0, sketches([s], SKETCH))
    for band, fold in folds.items():
        if fold:
            keys, counts, marks = parted(s, is_frequent, rank, percent, band, fold)
            out.add(keys, counts, fold, marks)
    return out


def index_keys(s: np.ndarray, frequent: np.ndarray, order: np.ndarray, percent: int) -> np.ndarray:
    """All keys of one set."""
    return np.concatenate((np.zeros(0, np.uint64), *keyed(s, frequent, order, percent).keys))


def bytes_of(arrays: list[np.ndarray]) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


def in_buckets(bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """One payload a bucket: its rows, one after another."""
    by = np.argsort(bucket, kind="stable")
    at, first = np.unique(bucket[by], return_index=True)
    rows, ends = rows[by], np.append(first[1:], len(by))
    return pa.RecordBatch.from_pydict({"bucket": pa.array(at.astype(np.int64)), "payload": pa.array([rows[lo:hi].tobytes() for lo, hi in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())})


def places(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment of the filter of shared keys, 32 bits that name the key in it)."""
    h = mixed(keys + ODD[4])
    return (h >> np.uint64(32)) % np.uint64(segments), h.astype(np.uint32)


def shared_keys(indexed: DataFrame, segments: int) -> np.ndarray:
    """A filter of SHARED_BITS in all, whatever the input, of the keys that two rows or more hold: one row of bytes a segment."""
    bits = max(64, SHARED_BITS // segments // 64 * 64)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 2048, 8 * ROOM):
            keys = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)
            if len(keys):
                yield in_buckets(*places(keys, segments))

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, bucket = [], None
        for b in batches:
            bucket = b.column("bucket")[0].as_py()
            found += [np.frombuffer(p, np.uint32) for p in b.column("payload").to_pylist()]
        names = np.sort(np.concatenate(found))
        out = np.zeros(bits, np.uint8)
        out[names[1:][names[1:] == names[:-1]].astype(np.uint64) * np.uint64(bits) >> np.uint64(32)] = 1
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "segment": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((segments, bits // 8), np.uint8)
    for r in indexed.select("keys").mapInArrow(named, "bucket long, payload binary").groupBy("bucket").applyInArrow(segment, "bucket long, segment binary").toLocalIterator():
        out[r["bucket"]] = np.frombuffer(r["segment"], np.uint8)
    return out


def held(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys the filter of shared keys holds."""
    at, name = places(keys, len(known))
    bit = name.astype(np.uint64) * np.uint64(8 * known.shape[1]) >> np.uint64(32)
    return known[at, bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1


def sure(apart: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether sketches that differ in ``apart`` bits, where ``most`` are allowed, leave no doubt."""
    return apart <= np.minimum(most // 2, SURE)


def spanning(n: np.ndarray, s: np.ndarray, percent: int, fold: int = 0) -> list[tuple[int, int, int]]:
    """(i, j, forest): pairs of one list, sorted by n, that length and sketch, of one of 2 ** fold parts, allow. Pairs left out are connected by forest pairs."""
    out: list[tuple[int, int, int]] = []
    open_pairs: list[tuple[int, int]] = []
    root = np.arange(len(n))
    m, told_apart = len(n), told(percent)
    for i in range(1, m):
        lo = int(np.searchsorted(n[:i], overlap(int(n[i]), percent)))
        apart = np.bitwise_count(s[lo:i] ^ s[i]).sum(1, dtype=np.int64)
        most = difference(n[lo:i].astype(np.int64) + int(n[i]), percent) >> fold
        near = lo + np.flatnonzero(apart <= most)
        if m <= LIST or m <= LONG_LIST and n[i] >> fold > told_apart:
            linked = sure(apart[near - lo], most[near - lo])
            open_pairs.extend((j, i) for j in near[~linked].tolist())
            near = near[linked]
        if len(near):
            roots, first = np.unique(root[near], return_index=True)
            out.extend((j, i, 1) for j in near[first].tolist())
            root[np.isin(root, roots)] = roots[0]
            root[i] = roots[0]
    return out + [(j, i, 0) for j, i in open_pairs if root[j] != root[i]]


def connecting(edges: np.ndarray) -> np.ndarray:
    """``edges`` (a, b, forest) without those whose ends other forest edges connect."""
    ids, at = np.unique(edges[:, :2], return_inverse=True)
    at, root = at.reshape(-1, 2), list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    keep = np.zeros(len(edges), bool)
    forest = edges[:, 2] == 1
    for k, (x, y) in zip(np.flatnonzero(forest).tolist(), at[forest].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep[k] = True
    of = np.array([find(x) for x in range(len(ids))], np.int64)
    return edges[keep | ~forest & (of[at[:, 0]] != of[at[:, 1]])]


def folded(sketch: bytes, bits: int) -> np.ndarray:
    """A sketch as one of fewer bits."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, bits // 64), axis=0)


def bits_for(n: int) -> int:
    return max(SKETCH, 1 << max(0, n - 1).bit_length())


def told_apart(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, na, sa, nb, sb) those that the smaller of their sketches allows."""
    for batch in batches:
        keep = []
        for na, sa, nb, sb in zip(*(batch.column(c).to_pylist() for c in ("na", "sa", "nb", "sb")), strict=True):
            bits = 8 * min(len(sa), len(sb))
            keep.append(int(np.bitwise_count(folded(sa, bits) ^ folded(sb, bits)).sum()) <= (na + nb) * (100 - percent) // (100 + percent))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def list_edges(payloads: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, forest) of all lists in a bucket."""
    rows = np.concatenate([np.frombuffer(p, ENTRY) for p in payloads])
    rows = rows[np.lexsort((rows["id"], rows["n"], rows["fold"], rows["key"]))]
    # copies in other tasks; sets of one node differ in size or sketch, as far as it matters
    new = np.concatenate(([True], (rows["key"][1:] != rows["key"][:-1]) | (rows["fold"][1:] != rows["fold"][:-1])))
    same = ~new[1:] & (rows["id"][1:] == rows["id"][:-1]) & (rows["n"][1:] == rows["n"][:-1]) & (rows["s"][1:] == rows["s"][:-1]).all(1)
    keep = np.concatenate(([True], ~same))
    rows, first = rows[keep], np.flatnonzero(new[keep])
    size = np.diff(np.append(first, len(rows)))
    out: list[np.ndarray] = []
    two = first[size == 2]  # most lists: at once
    if len(two):
        x, y = rows[two], rows[two + 1]
        apart, most = np.bitwise_count(x["s"] ^ y["s"]).sum(1, dtype=np.int64), difference(x["n"].astype(np.int64) + y["n"], percent) >> x["fold"]
        near = (x["n"] >= overlap(y["n"].astype(np.int64), percent)) & (apart <= most)
        out.append(np.stack((x["id"][near], y["id"][near], sure(apart, most)[near].astype(np.int64)), 1))
    for lo, m in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        one = rows[lo:lo + m]
        pairs = spanning(one["n"], one["s"], percent, int(one["fold"][0]))
        if pairs:
            at = np.array(pairs)
            out.append(np.stack((one["id"][at[:, 0]], one["id"][at[:, 1]], at[:, 2]), 1))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    edges = np.concatenate(out)
    edges[:, :2].sort(1)
    edges = connecting(np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0))
    return edges[:, 0], edges[:, 1], edges[:, 2]


def verified(ids: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """(smallest, other) for the sets of a unit that true links connect."""
    n = np.array([len(s) for s in sets], np.int64)
    by = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, n, sets = [ids[i] for i in by], n[by], [sets[i] for i in by]
    bits = 1 << max(8, int(n.max() if len(n) else 1).bit_length())
    marks = sketches(sets, bits)
    root = np.arange(len(ids))
    for i in range(1, len(ids)):
        lo = int(np.searchsorted(n[:i], overlap(int(n[i]), percent)))
        apart = np.bitwise_count(marks[lo:i] ^ marks[i]).sum(1, dtype=np.int64)
        near = lo + np.flatnonzero(apart <= difference(n[lo:i] + n[i], percent))
        near = near[np.argsort(apart[near - lo], kind="stable")]
        for j in near.tolist():
            if root[j] != root[i]:
                both = np.concatenate((sets[j], sets[i]))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    root[root == root[i]] = root[j]
    least: dict[int, bytes] = {}
    for r, d in zip(root.tolist(), ids, strict=True):
        least[r] = min(least.get(r, d), d)
    return [(least[r], d) for r, d in zip(root.tolist(), ids, strict=True) if least[r] != d]


def paired(df: DataFrame, key: str, chunk, chunks) -> DataFrame:
    """``df`` with i and j: each row in every unit of its chunk and another of ``chunks``, so that every two rows of a key meet in one; a lone chunk is a unit."""
    df = df.withColumn("_chunk", chunk).withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1))).where((chunks == 1) | (F.col("_chunk") != F.col("_other")))
    return df.withColumns({"i": F.least("_chunk", "_other"), "j": F.greatest("_chunk", "_other")}).drop("_chunk", "_other")


def present(ids: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of ``ids`` (column id), of fixed size."""
    at = F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(bits)) for k in range(3)]))
    words = ids.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def near_components(docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Null and empty texts, and texts of white space, have no shingles and link
    with nothing. Texts of any length are read whole. Every row is judged by its
    own text, also where rows repeat a doc_id, and a component is called by its
    smallest doc_id, or null where all its ids are null. An empty table gives no
    rows; other columns are ignored. Shingles are compared by 64-bit hashes, and
    sets are equal by a 128-bit digest of these.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows = stored(profiles(docs, words), "profiles")
    reps = stored(rows.where("n > 0").groupBy("digest", "node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "reps")
    frequent = frequent_tokens(docs, reps, words, FREQUENT, OFTEN)
    at = np.argsort(frequent)
    shared = spark.sparkContext.broadcast((frequent[at], at))
    weight = reps.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * partitions(spark), weight * (100 - percent) // 100 * ENTRY.itemsize >> 24)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, order = shared.value
        seen: set[bytes] = set()
        for b in in_slices(batches):
            new: dict[bytes, np.ndarray] = {}
            for x in shingle_sets(texts_of(b, 1), words):
                d = digest_of(x)
                if len(x) and d not in seen:  # copies in one task give their keys once
                    new[d] = x
            if len(seen) < 1 << 20:
                seen.update(new)
            found = [keyed(x, frequent, order, percent) for x in new.values()]
            yield pa.RecordBatch.from_pydict({
                "node": pa.array([node_of(d) for d in new], pa.int64()), "size": pa.array([len(x) for x in new.values()], pa.int64()),
                **{c: pa.array([bytes_of(getattr(k, c)) for k in found], pa.binary()) for c in ("keys", "counts", "folds", "marks")},
                "sketch": pa.array([sketches([x], bits_for(len(x))).tobytes() for x in new.values()], pa.binary())})

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = often.value
        for b in in_slices(batches, 2048, 8 * ROOM):
            keys, counts, folds, marks = (np.frombuffer(b"".join(b.column(c).to_pylist()), d) for c, d in (("keys", np.uint64), ("counts", np.uint32), ("folds", np.uint8), ("marks", np.uint64)))
            hit = held(keys, known)
            part = np.repeat(np.arange(len(counts)), counts)[hit]
            if not len(part):
                continue
            row = np.repeat(np.arange(b.num_rows), pc.binary_length(b.column("folds")).to_numpy())[part]
            out = np.zeros(len(part), ENTRY)
            out["key"], out["id"], out["n"], out["fold"] = keys[hit], b.column("node").to_numpy()[row], b.column("size").to_numpy()[row], folds[part]
            out["s"] = marks.reshape(len(folds), -1)[part]
            yield in_buckets((out["key"] >> np.uint64(20)) % np.uint64(buckets), out)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads: list[bytes] = []
        for b in batches:
            payloads += b.column("payload").to_pylist()
        a, b, forest = list_edges(payloads, percent)
        yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b), "forest": pa.array(forest)})

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in entries(batches):
            yield pa.RecordBatch.from_pydict({"bucket": b.column(0), "bytes": pc.binary_length(b.column(1)).cast(pa.int64())})

    indexed = stored(docs.mapInArrow(keys, "node long, size long, keys binary, counts binary, folds binary, marks binary, sketch binary"), "index")
    often = spark.sparkContext.broadcast(shared_keys(indexed, max(partitions(spark), weight * (100 - percent) // 100 * 4 >> 24)))
    # hot lists: how many blocks each bucket is dealt to, if more than one; no more rows than BLOCK_BYTES go into the listed bytes
    hot = indexed.mapInArrow(weights, "bucket long, bytes long").groupBy("bucket").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > BLOCK_BYTES)
    hot = stored(hot.select("bucket", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("chunks")), "hot")
    by_bucket = indexed.mapInArrow(entries, "bucket long, payload binary").join(small(hot), "bucket", "left")
    by_bucket = paired(by_bucket, "bucket", F.pmod(F.xxhash64("payload"), F.coalesce("chunks", F.lit(1))).cast("int"), F.coalesce("chunks", F.lit(1))).select("bucket", "i", "j", "payload")
    candidates = stored(by_bucket.groupBy("bucket", "i", "j").applyInArrow(edges, "a long, b long, forest long").groupBy("a", "b").agg(F.max("forest").alias("forest")), "candidates")
    named = indexed.select("node", "size", "sketch").distinct()
    sketch = lambda x: named.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    open_pairs = candidates.where("forest = 0").select("a", "b").join(sketch("a"), "a").join(sketch("b"), "b")
    settled = open_pairs.mapInArrow(lambda it: told_apart(it, percent), "a long, b long")
    near_ids = stored(components(candidates.where("forest = 1").select("a", "b").unionByName(settled)), "near")

    forgotten(candidates)

    # units of at most two chunks each, so that a component of any size is spread
    size = reps.groupBy(F.col("node").alias("id")).agg(F.sum("n").alias("size"))
    near = near_ids.join(size, "id")
    sizes = near.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(8 * F.sum("size") / CHUNK_BYTES)).cast("int").alias("chunks"))
    units = paired(near.join(sizes, "component"), "component", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"), F.col("chunks")).select("id", "component", "i", "j")
    wanted = rows.join(near.select(F.col("id").alias("node")), "node", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("id"))
    bloom = spark.sparkContext.broadcast(present(wanted.select("id")))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in among(batches, bloom.value):
            sets = shingle_sets(texts_of(b, 1), words)
            digests = [digest_of(x) for x in sets]
            yield pa.RecordBatch.from_pydict({"node": pa.array([node_of(d) for d in digests], pa.int64()), "digest": pa.array(digests, pa.binary()), "members": pa.array([x.tobytes() for x in sets], pa.binary())})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, bytes] = {}
        for b in batches:
            found |= dict(zip(b.column("digest").to_pylist(), b.column("members").to_pylist(), strict=True))
        links = verified(list(found), [np.frombuffer(m, np.uint64) for m in found.values()], percent)
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    members = probed(docs).mapInArrow(sets_of, "node long, digest binary, members binary")
    full = units.join(members, units["id"] == members["node"]).select("component", "i", "j", "digest", "members")
    links = full.groupBy("component", "i", "j").applyInArrow(verify, "a binary, b binary")
    linked = stored(components(links), "linked")

    # a component is called by the smallest document of all its sets
    in_group = reps.join(linked, reps["digest"] == linked["id"], "left").select("digest", "rep", F.coalesce("component", "digest").alias("component"))
    least = in_group.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = stored(in_group.join(least, "component").select("digest", "component_id"), "of")
    forgotten(linked)
    some = rows.where("n > 0").join(of, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, with all their columns.

    The cases of ``near_components`` hold. Rows without a doc_id stay; rows that
    repeat one stay together, if one of them is its component's smallest. Only the ids that go are
    joined back, by broadcast if they are few.
    """
    (gone_id,) = unused(docs, "_gone")
    found = near_components(docs, text, words, percent).groupBy(F.col("doc_id").alias(gone_id)).agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    gone = stored(found.where(F.col(gone_id).isNotNull() & ~F.col("stays")).select(gone_id), "gone")
    return docs.join(small(gone), column("doc_id") == F.col(gone_id), "left_anti")
