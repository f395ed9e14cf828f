"""Removal of passages that stand in an earlier document too, by suffix arrays of shards.

A byte goes if it is covered by a string of ``length`` bytes that also starts in a document with
a smaller id. Strings are UTF-8 bytes and never reach into the next document.

To shard suffixes by content, every string gets an anchor: the ``GRAM`` bytes in it with the
least hash (leftmost on ties). Equal strings have equal anchors, and one anchor serves all the strings
around it: its context. Contexts are dealt by their anchor's hash, packed
by block of documents. Equal contexts are told by their hashes (104 bits beside the anchor's), in the block
and again where they meet: one in a later document goes as a whole, and only the earliest is passed on, so copies
collapse before they travel. Anchors whose contexts differ are left; these contexts are gathered into
shards, and the suffix array of each shard decides string by string: suffixes are classified, the leftmost
smaller ones sorted by inducing their substrings and ranking the sequence of their names, the
array is induced in linear passes, and permuted common prefixes mark the runs of suffixes that share
``length`` bytes. The least id of a run tells what is kept.

Anchors that stand in very many different contexts (a common line's edges) would overload a
shard. The commonest, counted over all documents, are dealt string by string instead; which ones does
not change results.

A null text counts as empty. A null id comes after all others. Rows that share an id are no earlier
than each other, so repeated rows keep what their first keeps. Texts shorter than ``length`` lose
nothing. Long texts are read whole. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import _BYTE, bitmap, blocks, give_back, id_or_last, id_or_null, in_bitmap, materialize, mix, partitions, prefix_sums, signed, span_hashes, whole_text

LENGTH = 50
GRAM = 20
BLOCK = 4 << 20  # bytes of text whose contexts are told apart before they travel
STEP = 1 << 19  # bytes of text that are hashed together
RANGE = 4 << 20  # bytes of text per range of anchors
BUCKET = 8 << 20  # bytes of text per bucket, where what was found of its texts is gathered
SHARD = 1 << 20  # bytes of contexts per suffix array, which takes some eighty times as much while it is built
CROWD = 1024  # contexts of an anchor from which it may be dealt string by string
CROWDS = 1 << 16
_PLACE = 30  # bits of a position in a block; the others order anchors
_SPAN = np.dtype([("start", "<u4"), ("size", "u1")])
_EDGE = np.dtype([("start", "<u4"), ("size", "u1"), ("h", "<u8")])


# -- suffix arrays ------------------------------------------------------------------------


def _deal(pred: np.ndarray, chars: np.ndarray, at: np.ndarray, array: np.ndarray, step: int) -> None:
    """Appends suffixes to the buckets of their characters, in order; ``at`` are the next places."""
    order = np.argsort(chars, kind="stable")
    chars = chars[order]
    counts = np.bincount(chars, minlength=len(at))
    rank = np.arange(len(chars)) - (np.cumsum(counts) - counts)[chars]
    array[at[chars] + step * rank] = pred[order]
    at += step * counts


def induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, letters: int) -> np.ndarray:
    """The order of all suffixes that the order of the seeds (leftmost smaller suffixes) induces:
    larger ones bucket by bucket upwards, then smaller ones downwards."""
    n = len(text)
    sizes = np.bincount(text, minlength=letters)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    array = np.full(n, -1, np.int64)

    seed_chars = text[seeds]
    by_char = np.argsort(seed_chars, kind="stable")
    seeds, seed_sizes = seeds[by_char], np.bincount(seed_chars, minlength=letters)
    seed_ends = np.cumsum(seed_sizes)

    def push(items: np.ndarray, want_smaller: bool, at: np.ndarray, step: int) -> None:
        pred = items[items > 0] - 1
        pred = pred[smaller[pred] == want_smaller]
        if len(pred):
            _deal(pred, text[pred], at, array, step)

    # larger suffixes; the end of the text comes before all others
    at = heads.copy()
    _deal(np.array([n - 1]), text[n - 1 :], at, array, 1)
    larger_ends = heads
    for c in np.flatnonzero(sizes).tolist():
        done = heads[c]
        while done < at[c]:
            upto = int(at[c])
            push(array[done:upto], False, at, 1)
            done = upto
        if seed_sizes[c]:
            push(seeds[seed_ends[c] - seed_sizes[c] : seed_ends[c]], False, at, 1)
    larger_ends = at

    # smaller suffixes
    at = ends - 1
    for c in np.flatnonzero(sizes)[::-1].tolist():
        done = ends[c] - 1
        while done > at[c]:
            upto = int(at[c])
            push(array[upto + 1 : done + 1][::-1], True, at, -1)
            done = upto
        if larger_ends[c] > heads[c]:
            push(array[heads[c] : larger_ends[c]][::-1], True, at, -1)
    return array


def suffix_array(text: np.ndarray, letters: int, depth: int) -> np.ndarray:
    """The suffixes of a text of small numbers, sorted by their first ``depth`` numbers at least."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # a suffix is smaller than the next one if its next different number is larger; the last is not
    rise = np.append(text[1:].astype(np.int32) - text[:-1], -1)
    changes = np.flatnonzero(rise)
    smaller = rise[changes[np.searchsorted(changes, np.arange(n))]] > 0
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(leftmost):
        return induce(text, smaller, leftmost, letters)
    # substrings from one leftmost smaller suffix to the next, sorted by inducing
    first = induce(text, smaller, leftmost, letters)
    index = np.full(n, -1, np.int64)
    index[leftmost] = np.arange(len(leftmost))
    found = index[first]
    found = found[found >= 0]
    ends = np.append(leftmost[1:] + 1, n)
    sizes = (ends - leftmost)[found]
    hashes = span_hashes(prefix_sums(mix(text.astype(np.uint64) + np.uint64(1))), leftmost, ends)[found]
    new = np.ones(len(found), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (sizes[1:] != sizes[:-1])
    name = np.empty(len(found), np.int64)
    name[found] = np.cumsum(new)
    # the sequence of names, ranked by doubling until all differ or the depth is covered
    covered = 1
    while name.max() < len(name) and covered < depth:
        after = np.zeros(len(name), np.int64)
        after[:-covered] = name[covered:]
        both = name * (len(name) + 1) + after
        order = np.argsort(both, kind="stable")
        new = np.ones(len(name), np.int64)
        new[1:] = both[order][1:] != both[order][:-1]
        name = np.empty(len(order), np.int64)
        name[order] = np.cumsum(new)
        covered *= 2
    return induce(text, smaller, leftmost[np.argsort(name, kind="stable")], letters)


def shares_prefix(text: np.ndarray, array: np.ndarray, length: int) -> np.ndarray:
    """For each suffix, in text order, whether it has ``length`` numbers in common with the suffix before
    it in the array (the permuted common prefixes, as far as they matter)."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    words = np.zeros(n + length, np.uint64)  # four numbers of 16 bits at every place
    for i in range(4):
        words[: n - i] |= text[i:].astype(np.uint64) << np.uint64(16 * i)
    places = np.flatnonzero((before >= 0) & (np.maximum(before, np.arange(n)) + length <= n))
    for at in [*range(0, length - 3, 4), length - 4]:
        places = places[words[places + at] == words[before[places] + at]]
    shared = np.zeros(n, bool)
    shared[places] = True
    return shared


def repeated(contexts: list[bytes], ids: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of contexts laid end to end, the places where a string of ``length`` bytes starts that
    also stands in a context with a smaller id."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8).astype(np.uint16) + 1
    text[starts + sizes] = 0
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    array = suffix_array(text, 257, length)
    shared = shares_prefix(text, array, length)[array]
    begins = np.flatnonzero(~shared)
    who = ids[owner[array]]
    least = np.repeat(np.minimum.reduceat(who, begins), np.diff(np.append(begins, len(array))))
    whole = array + length <= (starts + sizes)[owner[array]]
    return np.sort(array[whole & (least < who)])


# -- anchors ------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Of texts laid end to end: places and hashes of anchors, first and last string of each, and prefix sums."""
    n = len(data)
    sums = prefix_sums(_BYTE[data])
    if n < length:
        return *(np.zeros(0, k) for k in (np.int64, np.uint64, np.int64, np.int64)), sums
    at = np.arange(n - gram + 1)
    grams = span_hashes(sums, at, at + gram)
    low = np.uint64((1 << _PLACE) - 1)
    least = (grams & ~low) | at.astype(np.uint64)
    width, done = length - gram + 1, 1
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if width > done:
        least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
    ends = np.repeat(offsets[1:], np.diff(offsets))
    strings = np.flatnonzero(np.arange(n - length + 1) + length <= ends[: n - length + 1])
    where = (least[strings] & low).astype(np.int64)
    begins = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else np.zeros(0, np.int64)
    lasts = strings[np.append(begins[1:], len(where)) - 1] if len(where) else strings
    return where[begins], grams[where[begins]], strings[begins], lasts, sums


def _contexts(texts: pa.Array, length: int, crowds: np.ndarray):
    """h, c, text, start, size of the contexts of a block of texts; of crowded anchors, of their strings."""
    parts = []
    for first_text, _, data, offsets in blocks(texts, STEP):
        where, h, first, last, sums = anchors(data, offsets, length)
        text = np.searchsorted(offsets, where, side="right") - 1
        start = np.maximum(where - (length - GRAM), offsets[text])
        end = np.minimum(where + length, offsets[text + 1])
        if len(crowds) and len(h):
            crowded = crowds[np.minimum(np.searchsorted(crowds, h), len(crowds) - 1)] == h
            if crowded.any():
                count = (last - first + 1)[crowded]
                each = np.repeat(first[crowded], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                h = np.append(h[~crowded], span_hashes(sums, each, each + length) ^ np.uint64(0x5851F42D4C957F2D))
                text = np.append(text[~crowded], np.repeat(text[crowded], count))
                start, end = np.append(start[~crowded], each), np.append(end[~crowded], each + length)
                where = np.append(where[~crowded], each)
        # a context is told by its bytes and by where its anchor stands in it
        c = mix(span_hashes(sums, start, end) + (where - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(24)
        parts.append((h, c, text + first_text, start - offsets[text], (end - start).astype(np.uint8)))
    return tuple(map(np.concatenate, zip(*parts)))


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, byte plane by byte plane."""
    planes = [(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes))


def _unpacked(value: bytes) -> list[np.ndarray]:
    planes = pickle.loads(zstandard.ZstdDecompressor().decompress(value))
    return [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel() for kind, b in planes]


def _joined(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that spans cover; adjacent ones are one run."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    begins = np.append(True, start[1:] > end[:-1]) if len(start) else np.zeros(0, bool)
    return start[begins], end[np.append(begins[1:], True)] if len(start) else end


# -- the passes ---------------------------------------------------------------------------


def _crowded(rows: DataFrame, length: int) -> np.ndarray:
    """Anchors with very many contexts, sorted: counted in blocks, summed over all; at most CROWDS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in blocks(batch.column("t"), BLOCK):
                h, c, *_ = _contexts(batch.column("t").slice(a, b - a), length, np.zeros(0, np.uint64))
                order = np.lexsort((c, h))
                h, c = h[order], c[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
                own, n = np.unique(h[new], return_counts=True)
                give_back()
                yield pa.RecordBatch.from_arrays([pa.array(signed(own[n > 3])), pa.array(n[n > 3].astype(np.int64))], names=["h", "n"])

    counted = rows.select("t").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= CROWD)
    found = materialize(counted, "crowds").orderBy(F.desc("n"), "h").limit(CROWDS).select("h").toArrow()
    return np.sort(found.column("h").to_numpy().view(np.uint64))


def _dealt(rows: DataFrame, ranges: int, length: int, crowds) -> DataFrame:
    """Packed contexts by range of their anchors (kind 0), and what blocks can tell to go (kind 1)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            all_ids, all_keys = (batch.column(c).to_numpy() for c in ("id", "key"))
            for a, b, _, _ in blocks(batch.column("t"), BLOCK):
                ids, keys = all_ids[a:b], all_keys[a:b]
                h, c, text, start, size = _contexts(batch.column("t").slice(a, b - a), length, crowds.value)
                order = np.lexsort((ids[text], c, h))
                h, c, text, start, size = (x[order] for x in (h, c, text, start, size))
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
                least = ids[text][np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else ids[:0]
                later = ids[text] > least
                out = []
                if later.any():
                    turn += 1
                    spans = []
                    order = np.argsort(text[later], kind="stable")
                    t, s, e = text[later][order], start[later][order], (start + size)[later][order]
                    bounds = np.append(np.flatnonzero(np.append(True, t[1:] != t[:-1])), len(t))
                    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                        s1, e1 = _joined(s[x:y], e[x:y])
                        spans.append((t[x], s1, e1))
                    counts = np.array([len(s1) for _, s1, _ in spans])
                    which = np.array([i for i, _, _ in spans])
                    out.append((int((a + turn * 7919) % ranges), 1, _packed(ids[which], keys[which], counts, np.concatenate([s1 for _, s1, _ in spans]), np.concatenate([e1 for _, _, e1 in spans]))))
                kept = ~later
                h, c, text, start, size = (x[kept] for x in (h, c, text, start, size))
                # sorted by h, so ranges are slices
                places = ((h >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)
                begins = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else np.zeros(0, np.int64)
                for x, y in zip(begins.tolist(), [*begins[1:].tolist(), len(places)]):
                    which, own = np.unique(text[x:y], return_inverse=True)
                    out.append((int(places[x]), 0, _packed(ids[which], keys[which], own.astype(np.uint32), h[x:y], c[x:y].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].copy().view("V5").ravel(), start[x:y].astype(np.uint32), size[x:y])))
                give_back()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["range", "kind", "data"])

    return rows.mapInArrow(deal, "range int, kind int, data binary")


_PACKS = "bucket int, kind int, data binary"
_OUT = "id long, key long, kind int, data binary"


def _by_bucket(ids: np.ndarray, keys: np.ndarray, kind: int, doc: np.ndarray, records: np.ndarray, buckets: int) -> pd.DataFrame:
    """A row for each bucket of texts: their ids and keys, how many records each has, and the records."""
    bucket = (mix(keys.view(np.uint64) ^ mix(ids.view(np.uint64))) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((doc, bucket[doc]))
    doc, records = doc[order], records[order]
    begins = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    texts, ends = doc[begins], np.append(begins, len(doc))
    of = bucket[texts]
    firsts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    data = [
        _packed(ids[texts[x:y]], keys[texts[x:y]], np.diff(ends[x : y + 1]), records[ends[x] : ends[y]])
        for x, y in zip(firsts.tolist(), [*firsts[1:].tolist(), len(texts)])
    ]
    return pd.DataFrame({"bucket": of[firsts], "kind": np.int32(kind), "data": pd.Series(data, dtype=object)})


def _gathered(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket of texts, a row for each text and kind with all its records as bytes."""
    out = []
    for kind, some in rows.groupby("kind"):
        parts = [_unpacked(data) for data in some["data"]]
        ids, keys = (np.concatenate([np.repeat(p[i], p[2]) for p in parts]) for i in (0, 1))
        records = np.concatenate([p[3] for p in parts])
        del parts
        order = np.lexsort((keys, ids))
        ids, keys, raw = ids[order], keys[order], records[order].tobytes()
        begins = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])))
        bounds = (np.append(begins, len(ids)) * records.itemsize).tolist()
        out.append(pd.DataFrame({"id": ids[begins], "key": keys[begins], "kind": np.int32(kind), "data": [raw[x:y] for x, y in zip(bounds[:-1], bounds[1:])]}))
    give_back()
    return pd.concat(out)


def _spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans as records; long ones in pieces."""
    pieces = -(-(end - start) // 255)
    first = np.repeat(start, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    out = np.empty(len(first), _SPAN)
    out["start"], out["size"] = first, np.minimum(255, np.repeat(end, pieces) - first)
    return out


def _meet(key, rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Contexts of one range of anchors: those in a later document go as a whole (kind 1); of anchors
    with different contexts the earliest of each is asked for (kind 2). A row for each bucket of texts."""
    out, parts = [], []
    for kind, data in zip(rows["kind"], rows["data"]):
        arrays = _unpacked(data)
        if kind == 1:
            ids, keys, counts, start, end = arrays
            doc = np.repeat(np.arange(len(ids)), counts)
            pieces = -(-(end - start) // 255)
            out.append(_by_bucket(ids, keys, 1, np.repeat(doc, pieces), _spans(start, end), buckets))
        else:
            parts.append(arrays)
    give_back()
    if parts:
        sizes = np.cumsum([0, *(len(p[0]) for p in parts)])
        ids, keys = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        doc = np.concatenate([p[2].astype(np.int64) + s for p, s in zip(parts, sizes)])
        h, c, start, size = (np.concatenate([p[i] for p in parts]) for i in (3, 4, 5, 6))
        del parts
        c = np.pad(c.view(np.uint8).reshape(-1, 5), ((0, 0), (0, 3))).view("<u8").ravel()
        who = ids[doc]
        order = np.lexsort((who, c, h))
        h, c, start, size, doc, who = (x[order] for x in (h, c, start, size, doc, who))
        new_h = np.append(True, h[1:] != h[:-1])
        new = new_h | np.append(True, c[1:] != c[:-1])
        least = who[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = who > least
        begins = np.flatnonzero(new_h)
        anchor = np.cumsum(new_h) - 1
        several = (np.add.reduceat(new.astype(np.int64), begins) > 1) & (np.minimum.reduceat(who, begins) < np.maximum.reduceat(who, begins))
        spans = np.empty(later.sum(), _SPAN)
        spans["start"], spans["size"] = start[later], size[later]
        out.append(_by_bucket(ids, keys, 1, doc[later], spans, buckets))
        asked = ~later & several[anchor]
        edges = np.empty(asked.sum(), _EDGE)
        edges["start"], edges["size"], edges["h"] = start[asked], size[asked], h[asked]
        out.append(_by_bucket(ids, keys, 2, doc[asked], edges, buckets))
    return pd.concat(out)


def _sorted_out(length: int, buckets: int):
    def work(key, rows: pd.DataFrame) -> pd.DataFrame:
        """What the suffix array of a shard of contexts tells to go."""
        contexts, ids, keys = rows["bytes"].tolist(), rows["id"].to_numpy(), rows["key"].to_numpy()
        sizes = np.array([len(c) for c in contexts], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        found = repeated(contexts, ids, length)
        give_back()
        owner = np.searchsorted(starts, found, side="right") - 1
        begin = rows["start"].to_numpy()[owner] + found - starts[owner]
        spans = np.empty(len(found), _SPAN)
        spans["start"], spans["size"] = begin, length
        return _by_bucket(ids, keys, 1, owner, spans, buckets)

    return work


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of texts (id, key) that are wanted and perhaps others; a bitmap of fixed size keeps most back."""
    hits = bitmap(wanted, F.xxhash64("id", "key"))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(hits.value, batch.column("x").to_numpy())))

    return rows.withColumn("x", F.xxhash64("id", "key")).mapInArrow(narrow, "id long, key long, t string, x long").drop("x")


def _spans_to_remove(rows: DataFrame, length: int) -> DataFrame:
    """id, key, data: spans of each text that go, in any order and overlapping."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE))
    crowds = spark.sparkContext.broadcast(_crowded(rows, length))
    buckets = max(1, -(-size // BUCKET))
    # found by range or shard, a text's records would be in as many rows; they are gathered before there are rows of texts
    gathered = lambda packs: packs.groupBy("bucket").applyInPandas(_gathered, _OUT)
    met = _dealt(rows, ranges, length, crowds).groupBy("range").applyInPandas(lambda key, part: _meet(key, part, buckets), _PACKS)
    met = materialize(gathered(met), "met")

    edges = met.where("kind = 2")
    contexts = edges.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards = max(1, contexts // _EDGE.itemsize * (2 * length) // SHARD)
    asked = edges.groupBy("id", "key").agg(F.collect_list("data").alias("data"))  # of one text each
    texts = _texts_of(rows, edges.select("id", "key")).dropDuplicates(["id", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                out: tuple[list, list, list, list, list] = ([], [], [], [], [])
                for id, key, text, data in zip(*(part.column(x).to_pylist() for x in ("id", "key", "t", "data"))):
                    text, wanted = text.encode(), np.frombuffer(b"".join(data), _EDGE)
                    starts = wanted["start"].tolist()
                    out[0].extend((wanted["h"] % np.uint64(shards)).astype(np.int64).tolist())
                    out[1].extend([id] * len(starts))
                    out[2].extend([key] * len(starts))
                    out[3].extend(starts)
                    out[4].extend([text[s : s + n] for s, n in zip(starts, wanted["size"].tolist())])
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["shard", "id", "key", "start", "bytes"])

    pieces = texts.join(asked, ["id", "key"]).select("id", "key", "t", "data").mapInArrow(cut, "shard long, id long, key long, start long, bytes binary")
    told = gathered(pieces.groupBy("shard").applyInPandas(_sorted_out(length, buckets), _PACKS))
    return materialize(met.where("kind = 1").unionByName(told).select("id", "key", "data"), "spans")


def _finish(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    """Removes spans from texts: sizes, spans removed, and the digest of what is kept (or the kept bytes)."""
    for batch in batches:
        for a in range(0, len(batch), 500):
            part = batch.slice(a, 500)
            out: tuple[list, list, list, list] = ([], [], [], [])
            for text, data in zip(part.column("t").to_pylist(), part.column("data").to_pylist()):
                text = text.encode()
                spans = np.frombuffer(b"".join(data or ()), _SPAN)
                begin = spans["start"].astype(np.int64)
                start, end = _joined(begin, begin + spans["size"])
                cuts = [0, *np.stack([start, end], 1).ravel().tolist(), len(text)]
                kept = b"".join([text[x:y] for x, y in zip(cuts[::2], cuts[1::2])])
                for column, value in zip(out, (len(text), int((end - start).sum()), len(start), kept if texts else hashlib.sha256(kept).hexdigest())):
                    column.append(value)
            columns = [part.column(c) for c in part.schema.names if c not in ("t", "data")]
            names = [c for c in part.schema.names if c not in ("t", "data")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary() if texts else pa.string())], names=[*names, "n_bytes", "n_removed", "n_spans", "kept"])


def removed(documents: DataFrame, text: str = "text", id: str = "doc_id", length: int = LENGTH, texts: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of
    the remaining bytes, or with ``texts`` these bytes as ``kept``."""
    if not 2 * GRAM <= length <= 127:
        raise ValueError(f"a length from {2 * GRAM} to 127 bytes is supported")
    rows = documents.select(id_or_last(id).alias("id"), F.xxhash64(whole_text(text)).alias("key"), whole_text(text).alias("t"))
    spans = _spans_to_remove(rows, length)
    hits = bitmap(spans, F.xxhash64("id", "key"))
    mark = F.xxhash64("id", "key")

    def some(inside: bool):
        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_bitmap(hits.value, batch.column("x").to_numpy()) == inside)).drop_columns(["x"])

        return rows.withColumn("x", mark).mapInArrow(narrow, "id long, key long, t string")

    per_text = spans.groupBy("id", "key").agg(F.collect_list("data").alias("data"))  # of one text each
    # texts that lose nothing are not shuffled
    joined = some(True).join(per_text, ["id", "key"], "left").select("id", "t", "data")
    alone = some(False).select("id", "t", F.lit(None).cast("array<binary>").alias("data"))
    kind = "binary" if texts else "string"
    done = joined.unionByName(alone).mapInArrow(lambda b: _finish(b, texts), f"id long, n_bytes long, n_removed long, n_spans long, kept {kind}")
    return done.select(id_or_null("id").alias(id), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept" if texts else "kept_sha256"))
