"""Removal of byte strings that an earlier document holds, by sorted suffixes.

Every string of ``length`` bytes has one anchor, its leftmost smallest K-byte
hash, so equal strings have equal anchors at equal places. A first pass finds
which anchors stand in two documents or more and keeps them as a filter of fixed
size. A second pass sends, for these anchors only, the bytes around them to the
anchor's bucket. There the suffixes that start at an anchor, and the reversed
prefixes that end there, are mergesorted; two are compared by binary search over
polynomial prefix hashes for their common extension, and the order is verified
on the bytes. Neighbours' common extensions then say which strings are equal,
and the smallest document of each class keeps them.

Of copies of a text that is very common only the smallest is searched; the
others lose all by it. Only texts that lose bytes are brought together with what they lose; the others
are given where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored, text_of
from .exact_dedup import heavy_digests
from .shingles import ODD, mixed, powers, prefix_hashes, substring_hashes

LENGTH = 50
K = 20
#: Bits of the filter of shared anchors; more anchors than it can tell apart cost time, never results.
FILTER_BITS = 1 << 27
#: Parts of the filter at most.
PARTS = 1 << 15
#: Bits of the filter of documents that lose bytes; more than it can tell apart are shuffled for nothing, never wrong.
TOUCHED_BITS = 1 << 26
#: Bytes of text whose anchors a bucket is meant to hold, and that a slice is meant to hold.
BUCKET, SLICE = 4 << 20, 8 << 20


def in_slices(batches: Iterator[pa.RecordBatch], upto: int = 2 << 20) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, texts) of about ``upto`` bytes; a longer text comes alone."""
    for b in batches:
        ids, texts, lo, size = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist(), 0, 0
        for hi, t in enumerate(texts):
            if size and size + len(t) > upto:
                yield ids[lo:hi], texts[lo:hi]
                lo, size = hi, 0
            size += len(t)
        if lo < len(texts):
            yield ids[lo:], texts[lo:]


def sliding(f: np.ufunc, a: np.ndarray, width: int) -> np.ndarray:
    """f over every ``width`` neighbours."""
    out, span = a, 1
    while 2 * span <= width:
        out = f(out[:len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return f(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first string, last string) of a text's anchors: an anchor serves the strings that start from first to last."""
    n = len(text) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    at = np.arange(len(text) - K + 1)
    h = mixed(substring_hashes(prefix_hashes(text), at, at + K))
    width = length - K + 1
    least = sliding(np.minimum, h, width)
    # a place is an anchor if the largest of the least values around it is its own
    rim = np.zeros(width - 1, np.uint64)
    place = np.flatnonzero(h == sliding(np.maximum, np.concatenate((rim, least, rim)), width))
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.append(first[1:], n) - 1
    # stretches of one least value and their anchors come in the same order; of equal anchors the leftmost serves
    h = h[place]
    same = np.concatenate(([False], h[1:] == h[:-1]))
    run = np.cumsum(~same) - 1
    first = np.where(same, np.maximum(first[run], np.concatenate(([0], place[:-1] + 1))), first[run])
    last = np.minimum(last[run], place)
    some = first <= last
    return h[some], place[some], first[some], last[some]


def all_anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """anchors() of texts that stand one after another, with the text of each; strings over a boundary are left out."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0] + [len(t) for t in texts])
    h, p, f, e = anchors(data, length)
    text = np.searchsorted(bounds, f, "right") - 1
    out = []
    # a run of strings may reach over boundaries: the part within each text counts
    for _ in range(2):
        stop = np.minimum(e, bounds[text + 1] - length)
        keep = stop >= f
        out.append((h[keep], p[keep], f[keep], stop[keep], text[keep]))
        more = bounds[text + 1] <= e
        h, p, e = h[more], p[more], e[more]
        f = bounds[text[more] + 1]
        text = np.searchsorted(bounds, f, "right") - 1
        if not len(f):
            break
    else:
        for x in zip(h, p, f, e, strict=True):  # over several short texts
            lo, last = int(x[2]), int(x[3])
            while lo <= last:
                t = int(np.searchsorted(bounds, lo, "right")) - 1
                stop = min(last, int(bounds[t + 1]) - length)
                if stop >= lo:
                    out.append((np.array([x[0]]), np.array([x[1]]), np.array([lo]), np.array([stop]), np.array([t])))
                lo = int(bounds[t + 1])
    h, p, f, e, text = (np.concatenate(x) for x in zip(*out, strict=True))
    return h, p, f, e, text, data, bounds


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    by = np.argsort(bucket, kind="stable")
    at, first = np.unique(bucket[by], return_index=True)
    rows, ends = rows[by], np.append(first[1:], len(by))
    return pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "payload": pa.array([rows[lo:hi].tobytes() for lo, hi in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())})


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of a hash in its bucket's segment of the filter."""
    return [(mixed(h + ODD[k]) % np.uint64(bits)).astype(np.int64) for k in range(3)]


def prefix_table(rows: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of each row's bytes."""
    up = powers(np.uint64(0x9E3779B97F4A7C15), rows.shape[1])
    out = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
    np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * up, axis=1, out=out[:, 1:])
    return out


def whole_hashes(rows: np.ndarray) -> np.ndarray:
    """The last column of ``prefix_table``, without the others."""
    up = powers(np.uint64(0x9E3779B97F4A7C15), rows.shape[1])
    out = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        out += (rows[:, i].astype(np.uint64) + np.uint64(1)) * up[i]
    return out


def extension(table: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many first bytes rows x and y have in common: a binary search over equal prefix hashes."""
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), table.shape[1] - 1)
    for _ in range(int(table.shape[1]).bit_length()):
        mid = (lo + hi + 1) >> 1
        same = table[x, mid] == table[y, mid]
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def suffix_sorted(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows sorted within groups, and each one's common extension with the one before it in its group.

    ``group`` is sorted. A mergesort of all groups at once: runs double, and each
    row finds its rank in the neighbouring run by binary search.
    """
    n, width = rows.shape
    table = prefix_table(rows)
    order = np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    start = np.repeat(first, size)
    end = np.repeat(first + size, size)
    place = np.arange(n) - start
    run = 1
    while n and run < int(size.max()):
        mine = place // run
        other = start + (mine ^ 1) * run  # the run to merge with
        has = other < end
        lo, hi = np.minimum(other, end), np.minimum(other + run, end)
        base = lo.copy()
        while True:
            active = np.flatnonzero(has & (lo < hi))
            if not len(active):
                break
            mid = (lo[active] + hi[active]) >> 1
            x, y = order[active], order[mid]
            common = extension(table, x, y)
            col = np.minimum(common, width - 1)
            bx, by = rows[x, col], rows[y, col]
            # rows of the right run go after equal rows of the left
            after = (by < bx) | ((common == width) & (mine[active] % 2 == 1))
            lo[active] = np.where(after, mid + 1, lo[active])
            hi[active] = np.where(after, hi[active], mid)
        to = start + np.minimum(mine & ~1, mine) * run + place % run + (lo - base)
        merged = np.empty_like(order)
        merged[to] = order
        order = merged
        run *= 2
    common = np.zeros(n, np.int64)
    if n > 1:
        inner = place[1:] > 0
        common[1:] = np.where(inner, extension(table, order[:-1], order[1:]), 0)
        # verified on the bytes: a false common extension or a wrong order sends all rows through a plain sort
        a, b = rows[order[:-1]], rows[order[1:]]
        true = np.where((a != b).any(1), (a != b).argmax(1), width)
        col = np.minimum(true, width - 1)
        at = np.arange(n - 1)
        if (inner & ((true != common[1:]) | ((true < width) & (a[at, col] > b[at, col])))).any():
            order = np.lexsort((*rows.T[::-1], group))
            a, b = rows[order[:-1]], rows[order[1:]]
            common[1:] = np.where(inner, np.where((a != b).any(1), (a != b).argmax(1), width), 0)
    return order, common


def classes(order: np.ndarray, common: np.ndarray, group: np.ndarray, upto: int) -> np.ndarray:
    """A number for each row, equal for rows of a group whose first ``upto`` bytes are equal."""
    new = np.concatenate(([True], (common[1:] < upto) | (group[1:] != group[:-1])))
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def record(length: int) -> np.dtype:
    """One anchor of one document: bytes around it, of the strings first .. last that it serves, relative to ``around``."""
    return np.dtype([("h", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("first", "u1"), ("last", "u1"), ("bytes", "u1", 2 * length - K)])


def removed_strings(rows: np.ndarray, length: int) -> np.ndarray:
    """(doc, start, end) of removed stretches, from all records of some anchors."""
    reach = length - K
    rows = rows[np.lexsort((rows["doc"], rows["h"]))]
    group = np.cumsum(np.concatenate(([False], rows["h"][1:] != rows["h"][:-1])))
    # equal surroundings are one record, of the smallest document
    key = mixed((whole_hashes(rows["bytes"]) + rows["first"].astype(np.uint64) * ODD[0] + rows["last"].astype(np.uint64) * ODD[1]) ^ rows["h"])
    _, one, of = np.unique(key, return_index=True, return_inverse=True)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, of, rows["doc"])
    again = rows[one][of]
    if not (np.array_equal(again["bytes"], rows["bytes"]) and np.array_equal(again["h"], rows["h"])):  # a collision: keep all
        one, of, least = np.arange(len(rows)), np.arange(len(rows)), rows["doc"].copy()
    sub_group = group[one]
    by = np.argsort(sub_group, kind="stable")
    inverse = np.empty_like(by)
    inverse[by] = np.arange(len(by))
    one, of, least, sub_group = one[by], inverse[of], least[by], sub_group[by]
    distinct = rows[one]
    window = np.full((len(one), reach + 1), np.iinfo(np.int64).max)
    places = np.arange(reach + 1)
    inside = (places >= distinct["first"][:, None]) & (places <= distinct["last"][:, None])
    window[inside] = np.broadcast_to(least[:, None], window.shape)[inside]
    several = np.flatnonzero(np.bincount(sub_group, minlength=int(group[-1]) + 1 if len(group) else 0)[sub_group] > 1)
    if len(several):
        text, g = distinct["bytes"][several], sub_group[several]
        right, left = suffix_sorted(text[:, reach:], g), suffix_sorted(text[:, :reach][:, ::-1], g)
        for c in range(reach + 1):
            here = np.flatnonzero(inside[several, c])
            if not len(here):
                continue
            r, lft = classes(*right, g, c + length - reach)[here], classes(*left, g, reach - c)[here]
            _, cls = np.unique(r * (len(several) + 1) + lft, return_inverse=True)
            low = np.full(int(cls.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, cls, least[several[here]])
            window[several[here], c] = low[cls]
    out = []
    for lo in range(0, len(rows), 1 << 18):
        part, span = rows[lo:lo + (1 << 18)], window[of[lo:lo + (1 << 18)]]
        gone = (span < part["doc"][:, None]) & (places >= part["first"][:, None]) & (places <= part["last"][:, None])
        edge = np.diff(np.pad(gone.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        r, c = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        at = part["at"][r].astype(np.int64)
        out.append(np.rec.fromarrays((part["doc"][r], at - reach + c, at - reach + stop - 1 + length), dtype=STRETCH))
    return np.concatenate(out) if out else np.zeros(0, STRETCH)


STRETCH = np.dtype([("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches of overlapping or touching ones."""
    out: list[list[int]] = []
    for k in np.argsort(start, kind="stable").tolist():
        if out and start[k] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(end[k]))
        else:
            out.append([int(start[k]), int(end[k])])
    return [(a, b) for a, b in out]


def deduplicated(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start, end), kept (the remaining bytes).

    Null text is empty; a text shorter than ``length`` bytes loses nothing; texts
    of any length are read whole. Rows that repeat a doc_id are one document (a
    tie: neither is smaller) and must repeat its text. Rows with a null doc_id
    are neither searched nor shortened. An empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    heavy = copied(docs)
    if heavy is not None:
        docs = docs.withColumn("digest", F.sha2("text", 256)).join(F.broadcast(heavy), "digest", "left")
        others = docs.where("doc_id > keep_id").select("doc_id", "text")
        docs = docs.where("not coalesce(doc_id > keep_id, false)").select("doc_id", "text")
    searched = docs.where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, slices = max(partitions(spark), size // BUCKET), max(partitions(spark), size // SLICE)
    parts = min(buckets, PARTS)
    bits = FILTER_BITS // parts // 64 * 64
    reach = length - K
    layout = record(length)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_slices(batches):
            h, _, _, _, t, _, _ = all_anchors(texts, length)
            if len(h):
                doc = ids[t]
                by = np.lexsort((doc, h))
                h, doc = h[by], doc[by]
                new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                last = np.append(new[1:], len(h)) - 1
                shared = doc[new] != doc[last]  # one bit of the hash says so
                yield by_bucket(bucket_of(h[new], buckets), h[new] >> np.uint64(1) << np.uint64(1) | shared.astype(np.uint64))

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, bucket = [], None
        for b in batches:
            bucket = b.column("bucket")[0].as_py()
            found += [np.frombuffer(p, np.uint64) for p in b.column("payload").to_pylist()]
        h = np.sort(np.concatenate(found))
        bare = h >> np.uint64(1)
        often = np.concatenate((bare[1:] == bare[:-1], [False])) | (h & np.uint64(1) == 1)
        out = np.zeros(bits, np.uint8)
        for at in probes(np.unique(bare[often]), bits):
            out[at] = 1
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "segment": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    segments = searched.mapInArrow(hashes, "bucket long, payload binary").groupBy("bucket").applyInArrow(segment, "bucket long, segment binary")
    if buckets > parts:  # several buckets share a part
        segments = segments.select((F.col("bucket") % parts).alias("bucket"), "segment").groupBy("bucket").applyInArrow(either, "bucket long, segment binary")
    filter_ = np.zeros((parts, bits // 8), np.uint8)  # FILTER_BITS in all, whatever the input
    for r in segments.toLocalIterator():
        filter_[r["bucket"]] = np.frombuffer(r["segment"], np.uint8)
    shared = spark.sparkContext.broadcast(filter_)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        around = np.arange(2 * length - K)
        for ids, texts in in_slices(batches):
            h, p, f, e, t, data, bounds = all_anchors(texts, length)
            bucket = bucket_of(h, buckets)
            hit = np.ones(len(h), bool)
            for at in probes(h >> np.uint64(1), bits):
                hit &= known[bucket % parts, at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
            if not hit.any():
                continue
            h, p, f, e, t, bucket = h[hit], p[hit], f[hit], e[hit], t[hit], bucket[hit]
            out = np.zeros(len(h), layout)
            out["h"], out["doc"], out["at"] = h, ids[t], p - bounds[t]
            out["first"], out["last"] = f - p + reach, e - p + reach
            at = p[:, None] - reach + around[None]
            used = (at >= f[:, None]) & (at < e[:, None] + length)
            out["bytes"] = np.where(used, data[np.clip(at, 0, len(data) - 1)], 0)
            yield by_bucket(bucket, out)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.frombuffer(p, layout) for b in batches for p in b.column("payload").to_pylist()]
        gone = removed_strings(np.concatenate(found), length)
        if len(gone):
            yield by_bucket(bucket_of(mixed(gone["doc"].astype(np.uint64)), slices), gone)

    stretches = stored(searched.mapInArrow(records, "bucket long, payload binary").groupBy("bucket").applyInArrow(resolve, "bucket long, payload binary"), "stretches")
    shared.unpersist()

    # a filter of the documents that lose bytes: TOUCHED_BITS in all, whatever the input
    segments_touched = min(slices, PARTS)
    touched_bits = max(64, TOUCHED_BITS // segments_touched // 64 * 64)

    def losing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(p, STRETCH)["doc"] for p in b.column("payload").to_pylist())])).astype(np.uint64)
            if len(ids):
                yield by_bucket(bucket_of(mixed(ids), slices) % segments_touched, ids)

    def touched_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, bucket = np.zeros(touched_bits, np.uint8), None
        for b in batches:
            bucket = b.column("bucket")[0].as_py()
            for p in b.column("payload").to_pylist():
                for at in probes(mixed(np.frombuffer(p, np.uint64)), touched_bits):
                    out[at] = 1
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "segment": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    touched = np.zeros((segments_touched, touched_bits // 8), np.uint8)
    for r in stretches.mapInArrow(losing, "bucket long, payload binary").groupBy("bucket").applyInArrow(touched_segment, "bucket long, segment binary").toLocalIterator():
        touched[r["bucket"]] = np.frombuffer(r["segment"], np.uint8)
    losers = spark.sparkContext.broadcast(touched)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """(rows, slice, whether the document may lose bytes); rows without an id lose none."""
        known = losers.value
        for b in batches:
            ids = mixed(b.column(0).fill_null(0).to_numpy().astype(np.uint64))
            at_slice = bucket_of(ids, slices)
            hit = b.column(0).is_valid().to_numpy(zero_copy_only=False).astype(bool)
            for at in probes(ids, touched_bits):
                hit &= known[at_slice % segments_touched, at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
            yield b, at_slice, hit

    def slice_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at_slice, hit in dealt(batches):
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(at_slice), b.column(0), b.column(1)], ["bucket", "doc_id", "text"]).filter(pa.array(hit))

    def left_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, hit in dealt(batches):
            b = b.filter(pa.array(~hit))
            for lo in range(0, b.num_rows, 256):
                ids, texts = (c.to_pylist() for c in b.slice(lo, 256).columns)
                out = [ids, [len(t) for t in texts], [0] * len(texts), [0] * len(texts), [hashlib.sha256(t).hexdigest() for t in texts], [[]] * len(texts), texts]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, RESULT, strict=True)], names=RESULT_NAMES)

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        gone = np.concatenate([np.zeros(0, STRETCH), *(np.frombuffer(p, STRETCH) for p in right.column("payload").to_pylist())])
        gone = gone[np.argsort(gone["doc"], kind="stable")]
        out: list[tuple] = []
        for doc, body in zip(left.column("doc_id").to_pylist(), left.column("text").to_pylist(), strict=True):
            spans = []
            if doc is not None:
                lo, hi = np.searchsorted(gone["doc"], doc, "left"), np.searchsorted(gone["doc"], doc, "right")
                spans = merged(gone["start"][lo:hi], gone["end"][lo:hi])
            kept, at = [], 0
            for a, b in spans:
                kept.append(body[at:a])
                at = b
            kept.append(body[at:])
            rest = b"".join(kept)
            out.append((doc, len(body), len(body) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [{"start": a, "end": b} for a, b in spans], rest))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), RESULT, strict=True)], names=RESULT_NAMES)

    sliced = docs.mapInArrow(slice_of, "bucket long, doc_id long, text binary")
    shortened = sliced.groupBy("bucket").cogroup(stretches.groupBy("bucket")).applyInArrow(
        lambda key, left, right: cut(key, left, right) if left.num_rows else EMPTY,
        RESULT_SCHEMA)
    shortened = shortened.unionByName(docs.mapInArrow(left_alone, RESULT_SCHEMA))
    if heavy is None:
        return shortened
    n = F.octet_length("text").cast("long")
    gone = F.when(n >= length, n).otherwise(0)
    rest = F.when(n >= length, F.lit(b"")).otherwise(F.col("text"))
    span = F.when(n >= length, F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end")))).otherwise(F.array().cast("array<struct<start:long,end:long>>"))
    return shortened.unionByName(others.select("doc_id", n.alias("n_bytes"), gone.cast("long").alias("n_removed"), F.size(span).cast("long").alias("n_spans"), F.sha2(rest, 256).alias("kept_sha256"), span.alias("spans"), rest.alias("kept")))


def copied(docs: DataFrame) -> DataFrame | None:
    """(digest, keep_id) of texts that many rows share, as ``exact_dedup`` finds them: no more than its counters, or None if there is none."""
    digests = stored(docs.where("doc_id is not null").select("doc_id", F.sha2("text", 256).alias("digest")), "digests")
    heavy = digests.join(F.broadcast(heavy_digests(digests)), "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("last"))
    heavy = stored(heavy.where("last > keep_id").select("digest", "keep_id"), "copied")
    return heavy if heavy.limit(1).count() else None


def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One segment of a bucket's several."""
    bucket, out = None, None
    for b in batches:
        for key, segment in zip(b.column("bucket").to_pylist(), b.column("segment").to_pylist(), strict=True):
            bits = np.frombuffer(segment, np.uint8)
            bucket, out = key, bits.copy() if out is None else out | bits
    yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "segment": pa.array([out.tobytes()], pa.binary())})


RESULT_NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
RESULT = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"
EMPTY = pa.Table.from_arrays([pa.array([], t) for t in RESULT], names=RESULT_NAMES)
