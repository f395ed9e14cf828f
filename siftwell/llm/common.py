"""What several operators share: shared storage, blocks of text, hashes of words, components.

Operators read the columns that they are told about and nothing else, so further columns of
a table, whatever their names, neither disturb them nor are lost where rows are passed on.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 21
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
#: Workers are reused: freed arrays go back to the system, not to pools of the process.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "16777216"}
#: Stands for a null id inside an operator: nulls come after every other id.
NULL_ID = (1 << 63) - 1


def importable(spark: SparkSession) -> None:
    """Lets Python workers started from any folder import this package, where they see its files;
    on clusters that do not, ship it by --py-files."""
    here, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])
    for name, value in WORKER_MEMORY.items():
        environment.setdefault(name, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts are long: batches of fewer rows keep workers and the buffers that feed them small."""
    rows = spark.conf.get(BATCH_CONF)
    try:
        spark.conf.set(BATCH_CONF, str(min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS))
        yield
    finally:
        spark.conf.set(BATCH_CONF, rows)


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here and a lost executor costs
    nothing that was computed. Tables live until the folder is cleared."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    with small_batches(spark):
        frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_or_last(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def id_or_null(column: str) -> Column:
    return F.when(F.col(column) != NULL_ID, F.col(column))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and where each value begins."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole values of about ``limit`` bytes (one value at least):
    first, end, their bytes, and offsets into these bytes."""
    if not len(column):
        return
    data, offsets = text_buffers(column)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # no such function on this platform
    _trim = None


def give_back() -> None:
    """Returns memory that this process has freed; reused Python workers would keep it."""
    if _trim is not None:
        _trim(0)


# -- hashes ---------------------------------------------------------------------------

_RANDOM = np.random.default_rng(20_240_229)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 … base^(n-1) modulo 2^64, doubled as needed."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    if len(have) <= 1 << 23:  # an oversized text does not keep its table
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """sum of value · base^position before each position, modulo 2^64."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from prefix sums."""
    spans = (sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts]
    return mix(spans + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of marked bytes that stay within one text."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= ~inside[:-1]
    after[:-1] |= ~inside[1:]
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes other than \\x20 and \\x09-\\x0D) of texts."""
    return runs(~_SPACE[data], offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of texts, A-Z lower-cased."""
    starts, ends = word_spans(data, offsets)
    return starts, ends, span_hashes(prefix_sums(_LOWERED[data]), starts, ends)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``width``-word shingles; the whole
    sequence counts as one if it has fewer words, and a text without words has none."""
    starts, _, words = word_hashes(data, offsets)
    first = np.searchsorted(starts, offsets)
    sums = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width if len(sums) else 0):
        sums += words[i : i + len(sums)] * np.uint64(pow(_BASE, i + 1, 1 << 64))
    sums = mix(sums)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(sums[a : b - width + 1]))
        elif b > a:
            terms = words[a:b] * powers(_BASE, width + 1)[1 : b - a + 1]
            sets.append(mix(np.add.reduce(terms, keepdims=True) + np.uint64(0xA24BAED4963EE407 * (b - a) % (1 << 64))))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


class Remembered(dict):
    """Values by word that a process holds, in bounded memory: when a generation is full the one
    before it is forgotten, except for the words met since."""

    def __init__(self, most: int):
        self.most, self.before = most, {}

    def missing(self, words: Iterator[str]) -> set[str]:
        """The words without a value; those of the last generation come over to this one."""
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()
        new, before = set(), self.before
        for word in words:
            if word not in self:
                if word in before:
                    self[word] = before[word]
                else:
                    new.add(word)
        return new


# -- bitmaps ------------------------------------------------------------------------------


def bitmap(frame: DataFrame, hashed: Column, bits: int = 24) -> Broadcast:
    """A bitmap of 2^bits bits, whatever the number of rows, that marks the hashes of a column's values."""
    slot = frame.select(F.pmod(hashed, F.lit(1 << bits)).alias("slot")).distinct()
    words = slot.groupBy(F.shiftright("slot", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("w")).toArrow()
    marks = np.zeros(1 << (bits - 6), np.int64)
    marks[words.column("i").to_numpy()] = words.column("w").to_numpy()
    return frame.sparkSession.sparkContext.broadcast(marks.view(np.uint64))


def in_bitmap(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.view(np.uint64) & np.uint64(64 * len(marks) - 1)
    return (marks[(slot >> np.uint64(6)).view(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


# -- connected components ---------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) lead to, for each node of an edge.

    Alternating large-star and small-star steps over the edge table; the table is written to the
    shared folder after each round. A star may hold any share of all nodes: neighbours are
    reduced to their minimum by a partial aggregate, and the joins are ones that Spark can split.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour is linked to the smallest node around
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.toDF("a", "b").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        edges = materialize(small.where("a <> b").distinct(), "edges")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
