"""Prefix trie of conversations by union-find over the common prefixes of sorted neighbours.

A conversation is a key: the SHA-256 digests of its turns, one after the other. Keys are dealt to ranges and sorted there
by Spark, the conversation's id last, so that equal conversations stand together and a group of copies is split
between ranges. In a range, neighbours are joined in descending order of their common prefix: a join of two components makes a
branching node, or goes into the node that ends there already. That gives the explicit nodes of the trie, those where
something branches or ends; nodes between two of them have the members of the lower one and are written out from it.

What may go on in other ranges, the explicit nodes on the paths of a range's first and last key, is contracted to one record
each; subtrees that hang off them are summed up in it. These records, in the order of ranges, are a shorter
sequence with known common prefixes, and the same union-find joins them.
Nothing else leaves a range before it is finished; the driver holds the two end keys and the path records of every range.

Turns are ordered by turn, nulls first; equal turns by role, then by the digest of role and text. Null roles and texts
count as empty, equal rows count as often as they come, rows without conv_id are left out. An empty table gives
an empty result. A conversation's digests and word counts (40 bytes a turn) travel as one row, its texts do not. Ids that end at a node
are hashed in their order: SHA-256 of one list cannot be divided, so a node's ids stream through one
task, in packed chunks. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialize, whole_text

DIGEST = 32
WORD = r"[^\x20\x09-\x0D]+"
NOBODY = (1 << 63) - 1
EMPTY = hashlib.sha256(b"").hexdigest()
CHUNK = 65_536  # ids in a packed chunk
MOST_BROADCAST = 1_000_000  # records of paths that are sent to all tasks; more are joined by a shuffle
CLOSED, OPEN, ENDS, EDGE = range(4)
RECORD = (
    "kind int, ref long, side int, at long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, payload binary, words binary"
)
NAMES = [f.split()[0] for f in RECORD.split(", ")]
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# -- union-find ------------------------------------------------------------------------


@dataclass
class Forest:
    """Explicit nodes over a sorted sequence of items. The first nodes are the items' own; ``into`` leads from a node that was
    found to be another one to that one, ``parent`` is -1 for a top node, ``item`` is one whose path a node lies on."""

    depth: list[int]
    parent: list[int]
    item: list[int]
    into: list[int]
    order: list[int] = field(default_factory=list)  # nodes, the deepest first

    def node(self, v: int) -> int:
        while self.into[v] != v:
            self.into[v] = v = self.into[self.into[v]]
        return v


def forest(depths: list[int], shared: list[int]) -> Forest:
    """Joins items, each at its depth, with their neighbours in descending order of shared prefixes."""
    m = len(depths)
    f = Forest(list(depths), [-1] * m, list(range(m)), list(range(m)))
    lead, size, top = list(range(m)), [1] * m, list(range(m))

    def find(x: int) -> int:
        while lead[x] != x:
            lead[x] = x = lead[lead[x]]
        return x

    for e in np.argsort(-np.asarray(shared, np.int64), kind="stable").tolist():
        level, a, b = shared[e], find(e), find(e + 1)
        x, y = top[a], top[b]
        if f.depth[x] == level and f.depth[y] == level:
            f.into[y] = t = x
        elif f.depth[x] == level:
            f.parent[y] = t = x
        elif f.depth[y] == level:
            f.parent[x] = t = y
        else:
            t = len(f.depth)
            f.depth.append(level)
            f.parent.append(-1)
            f.item.append(f.item[x])
            f.into.append(t)
            f.parent[x] = f.parent[y] = t
        if size[a] < size[b]:
            a, b = b, a
        lead[b] = a
        size[a] += size[b]
        top[a] = t
    f.parent = [f.node(p) if p >= 0 else -1 for p in f.parent]
    real = [v for v in range(len(f.depth)) if f.into[v] == v]
    f.order = sorted(real, key=lambda v: -f.depth[v])
    return f


@dataclass
class Stats:
    """Sums by node: members, smallest member, children, their leaves, and tokens saved below it."""

    members: list[int]
    least: list[int]
    children: list[int]
    leaves: list[int]
    below: list[int]

    @classmethod
    def of_items(cls, f: Forest, members, least, children=None, leaves=None, below=None) -> Stats:
        """Items' figures, those of items at the same node together."""
        n, m = len(f.depth), len(members)
        s = cls([0] * n, [NOBODY] * n, [0] * n, [0] * n, [0] * n)
        for j in range(m):
            v = f.node(j)
            s.members[v] += members[j]
            s.least[v] = min(s.least[v], least[j])
            if children is not None:
                s.children[v] += children[j]
                s.leaves[v] += leaves[j]
                s.below[v] += below[j]
        return s

    def fold(self, f: Forest, words: np.ndarray, start: np.ndarray, open: set[int]) -> None:
        """Adds finished nodes to their parents, the deepest first; nodes that may go on elsewhere stay apart.
        words: for each item the running count of words by depth, from ``start`` on."""
        for v in f.order:
            if v in open:
                continue
            if not self.children[v]:
                self.leaves[v] = 1
            p = f.parent[v]
            if p >= 0:
                at = start[f.item[v]]
                path = int(words[at + f.depth[v]] - words[at + f.depth[p]])
                self.members[p] += self.members[v]
                self.least[p] = min(self.least[p], self.least[v])
                self.children[p] += 1
                self.leaves[p] += self.leaves[v]
                self.below[p] += self.below[v] + (self.members[v] - 1) * path


def _written(f: Forest, s: Stats, nodes: list[int], words: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of finished explicit nodes and of those between each and its parent; ``own`` marks the explicit one's row."""
    v = np.array(nodes, np.int64)
    depth, parent, item = (np.array(x, np.int64)[v] for x in (f.depth, f.parent, f.item))
    above = np.where(parent >= 0, np.array(f.depth, np.int64)[parent], -1)
    count = depth - above
    each = np.repeat(np.arange(len(v)), count)
    level = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + above[each] + 1
    own, first = level == depth[each], level == above[each] + 1
    members, least, children, leaves, below = (np.array(x, np.int64)[v][each] for x in (s.members, s.least, s.children, s.leaves, s.below))
    at = start[item][each]
    path = words[at + depth[each]] - words[at + np.maximum(level - 1, 0)]
    return {
        "node": v[each], "own": own, "first": first, "parent": parent[each], "conv_id": least, "depth": level, "n_convs": members,
        "n_children": np.where(own, children, 1), "n_leaves": leaves, "saved_tokens": below + (members - 1) * path,
    }


# -- a range ---------------------------------------------------------------------------


def _common(digests: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Turns that each key has in common with the one before it (the first: none)."""
    shared = np.zeros(len(lengths), np.int64)
    least = np.zeros(len(lengths), np.int64)
    least[1:] = np.minimum(lengths[1:], lengths[:-1])
    active, t = np.flatnonzero(least > 0), 0
    while len(active):
        active = active[(digests[start[active - 1] + t] == digests[start[active] + t]).all(axis=1)]
        shared[active] += 1
        t += 1
        active = active[least[active] > t]
    return shared


def _records(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = {"kind": pa.int32(), "side": pa.int32(), "ends_sha256": pa.string(), "payload": pa.binary(), "words": pa.binary()}
    arrays = [pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(n, kinds.get(c, pa.int64())) for c in NAMES]
    return pa.RecordBatch.from_arrays(arrays, names=NAMES)


def _range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a sorted range: finished nodes, records of the paths of its first and last key, and these keys."""
    ids, keys, counts = [], [], []
    for batch in batches:
        ids.append(batch.column("conv_id").to_numpy())
        keys += [k.as_buffer() for k in batch.column("key")]
        counts.append(batch.column("words").flatten().to_numpy(zero_copy_only=False))
    if not keys:
        return
    part = TaskContext.get().partitionId()
    ids = np.concatenate(ids)
    lengths = np.array([k.size // DIGEST for k in keys], np.int64)
    start = np.cumsum(lengths) - lengths
    digests = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, DIGEST // 8)
    ends = keys[0].to_pybytes(), keys[-1].to_pybytes()
    del keys
    shared = _common(digests, start, lengths)
    del digests
    # running counts of words by depth: a zero before the first turn of each
    running = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)
    at = np.repeat(start, lengths + 1) + (np.arange(lengths.sum() + len(lengths)) - np.repeat(start + np.arange(len(start)), lengths + 1))
    words = running[at]
    begin = start + np.arange(len(start))

    new = np.ones(len(ids), bool)  # equal keys are one item
    new[1:] = ~((shared[1:] == lengths[1:]) & (shared[1:] == lengths[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids))
    begin = begin[first]
    m = len(first)
    f = forest(lengths[first].tolist(), shared[first[1:]].tolist())
    s = Stats.of_items(f, (last - first).tolist(), ids[first].tolist())
    item_at = {f.node(j): j for j in range(m)}  # items have different keys, so different nodes

    paths = []
    for j in (0, m - 1):
        v, path = f.node(j), []
        while v >= 0:
            path.append(v)
            v = f.parent[v]
        paths.append(path)
    open = set(paths[0]) | set(paths[1])
    s.fold(f, words, begin, open)
    # every key of the range shares the top node's prefix: that node lies between the two paths
    sequence = paths[0] + [v for v in reversed(paths[1]) if v not in set(paths[0])]
    ref = {v: (part << 32) + i for i, v in enumerate(sequence)}

    closed = [v for v in f.order if v not in open]
    if closed:
        rows = _written(f, s, closed, words, begin)
        sha = {v: hashlib.sha256(",".join(map(str, ids[first[j] : last[j]].tolist())).encode()).hexdigest() for v, j in item_at.items() if v not in open}
        least = np.array(s.least, np.int64)
        to_open = rows["first"] & np.isin(rows["parent"], sequence)
        for a in range(0, len(rows["node"]), 4096):
            cut = {k: x[a : a + 4096] for k, x in rows.items()}
            up = to_open[a : a + 4096]
            yield _records(
                kind=np.full(len(up), CLOSED, np.int32),
                ref=pa.array([ref[p] if u else None for p, u in zip(cut["parent"].tolist(), up.tolist())], pa.int64()),
                parent_conv_id=pa.array(np.where(cut["first"], least[cut["parent"]], cut["conv_id"]), mask=up),
                ends_sha256=[sha.get(v, EMPTY) if o else EMPTY for v, o in zip(cut["node"].tolist(), cut["own"].tolist())],
                **{c: cut[c] for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")},
            )
    pick = lambda values: [values[v] for v in sequence]
    yield _records(
        kind=[OPEN] * len(sequence), ref=pick(ref), side=[int(v not in set(paths[0])) for v in sequence], at=[int(v in item_at) for v in sequence],
        conv_id=pick(s.least), depth=pick(f.depth), n_convs=pick(s.members), n_children=pick(s.children), n_leaves=pick(s.leaves), saved_tokens=pick(s.below),
    )
    for v in sequence:
        if (j := item_at.get(v)) is not None:
            for a in range(first[j], last[j], CHUNK):
                own = ids[a : min(a + CHUNK, last[j])].tolist()
                yield _records(kind=[ENDS], ref=[ref[v]], at=own[:1], payload=[",".join(map(str, own)).encode()])
    for side, j in enumerate((0, m - 1)):
        path = words[begin[j] : begin[j] + f.depth[j] + 1]
        yield _records(kind=[EDGE], ref=[part], side=[side], payload=[ends[side]], words=[path.tobytes()])


# -- all ranges ------------------------------------------------------------------------


def _joined(paths: list, edges: list) -> tuple[list[tuple], dict[int, int], dict[int, int]]:
    """From the records of paths: rows of the nodes on them (their group first), each record's smallest member, and the
    group of records where conversations end."""
    keys = {(e.ref, e.side): (bytes(e.payload), np.frombuffer(e.words, np.int64)) for e in edges}
    parts = sorted({p for p, _ in keys}, key=lambda p: (keys[p, 0][0], keys[p, 1][0], p))
    by_part = {p: list(own) for p, own in itertools.groupby(sorted(paths, key=lambda r: r.ref), key=lambda r: r.ref >> 32)}
    depths, shared, words, begin, size, before = [0], [], [np.zeros(1, np.int64)], [0], 1, None
    records = []
    for p in parts:
        sides = []
        for side in (0, 1):
            sides.append(size)
            words.append(keys[p, side][1])
            size += len(words[-1])
        for i, r in enumerate(by_part[p]):
            if i or before is None:
                shared.append(min(depths[-1], r.depth))
            else:
                digests = [np.frombuffer(k, np.uint64).reshape(-1, DIGEST // 8) for k in (before, keys[p, 0][0])]
                least = min(map(len, digests))
                differ = np.flatnonzero((digests[0][:least] != digests[1][:least]).any(axis=1))
                shared.append(int(differ[0]) if len(differ) else least)
            depths.append(r.depth)
            begin.append(sides[r.side])
            records.append(r)
        before = keys[p, 1][0]
    words, begin = np.concatenate(words), np.array(begin, np.int64)
    f = forest(depths, shared)
    zero = [0]
    s = Stats.of_items(
        f,
        zero + [r.n_convs for r in records],
        [NOBODY] + [r.conv_id for r in records],
        zero + [r.n_children for r in records],
        zero + [r.n_leaves for r in records],
        zero + [r.saved_tokens for r in records],
    )
    s.fold(f, words, begin, set())
    rows = _written(f, s, f.order, words, begin)
    ending = {f.node(j + 1) for j, r in enumerate(records) if r.at}
    out = []
    for i in range(len(rows["node"])):
        row = {c: int(rows[c][i]) for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")}
        p = int(rows["parent"][i])
        up = row["conv_id"] if not rows["first"][i] else (s.least[p] if p >= 0 else None)
        group = int(rows["node"][i]) if rows["own"][i] and int(rows["node"][i]) in ending else None
        out.append((group, row["conv_id"], row["depth"], up, *(row[c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))))
    least = {r.ref: s.least[f.node(j + 1)] for j, r in enumerate(records)}
    return out, least, {r.ref: f.node(j + 1) for j, r in enumerate(records) if r.at}


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's chunks, which come in order."""
    group, state = None, None
    row = lambda: pa.RecordBatch.from_pydict({"group": [group], "ends_sha256": [state.hexdigest()]}, pa.schema([("group", pa.int64()), ("ends_sha256", pa.string())]))
    for batch in batches:
        for g, payload in zip(batch.column("group").to_pylist(), batch.column("payload")):
            if g != group:
                if state is not None:
                    yield row()
                group, state = g, hashlib.sha256()
            else:
                state.update(b",")
            state.update(payload.as_buffer())
    if state is not None:
        yield row()


def _local(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of conv_id (unique), key (binary, 32 bytes a turn) and words (array<long>, one a turn)."""
    spark = sequences.sparkSession
    ranged = sequences.select("conv_id", "key", "words").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = materialize(ranged.mapInArrow(_range, RECORD), "forests")
    paths, edges = found.where(F.col("kind") == OPEN).collect(), found.where(F.col("kind") == EDGE).collect()
    if not edges:
        return found.select(*RESULT)
    rows, least, group = _joined(paths, edges)

    bounded = F.broadcast if len(least) <= MOST_BROADCAST else (lambda frame: frame)
    upper = bounded(_local(spark, list(least.items()), "ref long, upper long"))
    groups = bounded(_local(spark, list(group.items()), "ref long, `group` long"))
    closed = found.where(F.col("kind") == CLOSED)
    inner = closed.where("ref IS NULL").select(*RESULT)
    outer = closed.where("ref IS NOT NULL").join(upper, "ref").withColumn("parent_conv_id", F.col("upper")).select(*RESULT)
    chunks = found.where(F.col("kind") == ENDS).join(groups, "ref").select("group", "at", "payload")
    ends = chunks.repartition("group").sortWithinPartitions("group", "at").mapInArrow(_hashed, "`group` long, ends_sha256 string")
    path = _local(spark, rows, "`group` long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    ending = path.where("`group` IS NOT NULL").join(ends, "group").select(*RESULT)
    passing = path.where("`group` IS NULL").withColumn("ends_sha256", F.lit(EMPTY)).select(*RESULT)
    return inner.unionByName(outer).unionByName(ending).unionByName(passing)


def conversations(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns: each conversation's turns in order, as the digest of role and text and the number of words."""
    role, text = whole_text(role), whole_text(text)
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = rows.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def keyed(conversations: DataFrame, turns: Column | str = "turns") -> DataFrame:
    """conv_id, key, words: what ``trie`` takes."""
    key = F.unhex(F.array_join(F.transform(turns, lambda t: t["digest"]), ""))
    return conversations.select("conv_id", key.alias("key"), F.transform(turns, lambda t: t["words"]).alias("words"))


def rebuilt(found: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin like the one before them whose id ``every`` divides: with its first
    h turns (all if it has fewer, none if it is not there), then their own after the first h; h is crc32 of the id mod ``most``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    convs = found.withColumn("head", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h)
    heads = found.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, most - 1).alias("first"))
    own = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).otherwise(F.slice("turns", 1, 0))
    given = F.when(F.col("first").isNotNull(), F.slice("first", 1, F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return convs.join(heads, "head", "left").select("conv_id", F.concat(given, own).alias("turns"))
