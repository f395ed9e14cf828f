"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order. It is posted in the inverted files of the first
few of them; a query looks into the files of its own first pivots and ranks what is there by the
footrule distance between the ordered lists. Everything within a radius of the footrule is reranked by the cosine of the
original vectors, in double precision, and of each file at least the nearest few. A pair that shares several files is
looked at in the first of them only. A posting holds the vector, so only results leave a file. Files are cut into buckets of
bounded size and queries into packs, so a pivot that is near to any share of all vectors is worked
on by many tasks. Pivots come from a bounded sample; all rows are indexed.

How many files and which radius are needed is measured: at most FITTED queries, chosen by hash, are compared with all rows
in one pass of blocks. The files are as many as it takes for true neighbours to share one, the radius is the one
within which the wanted share of them (``recall``) lies. Nothing within the radius is left out, at any size. The
number of pivots grows with the square root of the rows. With ``recall=1`` files are reranked whole, whose answers are then exact.

Vectors that are null, zero, or hold null or non-finite components, and those whose length is not
the commonest, take no part; nor do null ids. Rows that repeat an id count as one candidate with the best of
their scores; of queries that repeat an id, the smallest vector is asked for. Equal distances
go by the smaller id. Every file holds the row that its pivot is, so a query finds at least as many rows as it has
files. Fewer candidates than asked for give fewer rows; an empty
table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.llm.common import materialize

PIVOTS = 512  # at least, and the square root of the rows; 16 bits number them
MOST_PIVOTS = 16_384
LISTED = 64  # pivots in a vector's ordered list
DEPTHS = (16, 24, 32, 48, 64)  # numbers of files to choose from
RECALL = 0.96  # share of true neighbours within the radius
FITTED = 256  # queries that the radius and the number of files are measured by
LEAST = 128  # of a bucket of a file, the nearest by footrule that are reranked whatever the radius
BUCKET = 32_768  # vectors of a file in one task
PACK = 8_192  # queries in one task


def _usable(embeddings: DataFrame, id: str, vector: str, asked: Column) -> DataFrame:
    """vec_id, v, asked: rows that take part, and whether they are asked for."""
    single = embeddings.schema[vector].dataType.simpleString() == "array<float>"
    rows = embeddings.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"), asked.alias("asked")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(fine & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (length[0].n if length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very small or large components survive squaring
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivots_of(rows: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """Unit vectors of distinct directions, from at most 4 · count rows chosen by hash among all."""
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(4 * count).select("v").collect()
    if not sample:
        return np.zeros((0, 0))
    units = _unit(np.array([r.v for r in sample]))
    _, first = np.unique(units.round(12), axis=0, return_index=True)
    return units[np.sort(first)[:count]]


def _permutations(rows: DataFrame, pivots: np.ndarray, listed: int) -> DataFrame:
    """vec_id, the ordered list of nearest pivots as 16-bit numbers, and the vector's bytes."""
    double = rows.schema["v"].dataType.elementType.typeName() != "float"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                vectors = _matrix(part.column("v"))
                near = -(_unit(vectors.astype(np.float64)) @ pivots.T)
                order = np.argsort(near, axis=1, kind="stable")[:, :listed].astype("<u2")
                kept = np.ascontiguousarray(vectors, "<f8" if double else "<f4")
                columns = [part.column("vec_id"), *(pa.array([x.tobytes() for x in m], pa.binary()) for m in (order, kept))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "list", "v"])

    return rows.mapInArrow(work, "vec_id long, list binary, v binary")


def _files(lists: DataFrame, depth: int) -> DataFrame:
    """A row for each of the first pivots of a list, with its place there."""
    pivot = [(F.conv(F.hex(F.substring("list", 2 * i + 1, 1)), 16, 10).cast("int") + 256 * F.conv(F.hex(F.substring("list", 2 * i + 2, 1)), 16, 10).cast("int")) for i in range(depth)]
    return lists.select("*", F.posexplode(F.array(*pivot)).alias("place", "pivot"))


def footrule(query: np.ndarray, lists: np.ndarray, pivots: int) -> np.ndarray:
    """Sum over pivots of the difference between places in the query's list and in each list;
    a pivot that is not listed stands right behind the list."""
    size = lists.shape[1]
    place = np.full(pivots, size, np.int16)
    place[query] = np.arange(len(query))
    there = place[lists]
    apart = np.abs(there - np.arange(size, dtype=np.int16)).sum(axis=1, dtype=np.int64)
    return apart + there.sum(axis=1, dtype=np.int64) + size * len(query) - int(place[query].sum()) - size * size


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best ids, each at its best score."""
    top = np.lexsort((ids, -score))
    _, first = np.unique(ids[top], return_index=True)  # of a repeated id, its best
    return top[np.sort(first)[:k]]


def _neighbours(index: DataFrame, ids: list[int], vectors: np.ndarray, k: int, kind: str) -> DataFrame:
    """query_id, vec_id, score, list: the k nearest of all rows for a bounded set of queries, in one pass of blocks."""
    asked, units = np.array(ids), _unit(vectors.astype(np.float64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object))] * len(asked)
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                there = part.column("vec_id").to_numpy()
                lists = np.array(part.column("list").to_pylist(), object)
                score = units @ _unit(np.frombuffer(b"".join(part.column("v").to_pylist()), kind).reshape(len(part), -1).astype(np.float64)).T
                score[asked[:, None] == there[None, :]] = -9
                near = np.argpartition(-score, k, axis=1)[:, :k] if len(part) > k else np.tile(np.arange(len(part)), (len(asked), 1))
                for q in range(len(asked)):
                    at = near[q][score[q, near[q]] > -9]
                    joint = [np.concatenate(pair) for pair in zip(best[q], (there[at], score[q, at], lists[at]))]
                    top = _best(joint[0], joint[1], k)
                    best[q] = tuple(x[top] for x in joint)
        for q, (found, score, lists) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), asked[q])), pa.array(found), pa.array(score), pa.array(lists.tolist(), pa.binary())], names=["query_id", "vec_id", "score", "list"])

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return index.mapInArrow(work, "query_id long, vec_id long, score double, list binary").withColumn("rank", rank).where(F.col("rank") <= k)


def fit(pairs: list[tuple[np.ndarray, np.ndarray]], pivots: int, recall: float, depths: tuple[int, ...] = DEPTHS) -> tuple[int, float]:
    """The number of files and the radius of the footrule that find a share of the pairs of lists."""
    depths = [d for d in depths if d < pivots] or [pivots]
    if not pairs:
        return depths[0], float("inf")
    for depth in depths:
        met = np.array([len(np.intersect1d(a[:depth], b[:depth])) > 0 for a, b in pairs])
        if met.mean() >= min(1, recall + 0.01):
            break
    apart = np.sort([footrule(a, b[None, :], pivots)[0] for (a, b), m in zip(pairs, met) if m])
    wanted = int(np.ceil(recall * len(pairs)))
    return depth, float(apart[wanted - 1]) if 0 < wanted <= len(apart) and recall < 1 else float("inf")


def _probe(pivots: int, depths: tuple[int, int], radius: float, least: int, k: int, kind: str):
    none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    posted, probed = depths

    def work(key, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return none
        vectors = vectors.sort_values("vec_id", kind="stable")
        ids = vectors["vec_id"].to_numpy()
        lists = np.frombuffer(b"".join(vectors["list"]), "<u2").reshape(len(ids), -1)
        units = _unit(np.frombuffer(b"".join(vectors["v"]), kind).reshape(len(ids), -1).astype(np.float64))
        asked = _unit(np.frombuffer(b"".join(queries["v"]), kind).reshape(len(queries), -1).astype(np.float64))
        files, out = np.ascontiguousarray(lists[:, :posted]), []
        for query, own, place, unit in zip(queries["query_id"], queries["list"], queries["place"], asked):
            own = np.frombuffer(own, "<u2")
            earlier = np.zeros(pivots, bool)
            earlier[own[:probed][:place]] = True
            met = earlier[files].any(axis=1) if place else np.zeros(len(ids), bool)  # in an earlier file of the query
            new = np.flatnonzero(~met & (ids != query))
            apart = footrule(own, lists[new], pivots)
            inside = apart <= radius
            if inside.sum() < min(least, len(new)):
                inside[np.argsort(apart, kind="stable")[:least]] = True  # ties by the smaller id
            new = new[inside]
            score = np.clip((units[new] * unit).sum(axis=1), -1, 1)
            top = _best(ids[new], score, k)
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[new][top], "score": score[top]}))
        return pd.concat(out)

    return work


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.clip((_unit(a) * _unit(b)).sum(axis=1), -1, 1)


def search(
    embeddings: DataFrame,
    asked: Column,
    k: int = 5,
    id: str = "vec_id",
    vector: str = "embedding",
    pivots: int | None = None,
    listed: int = LISTED,
    posted: int | None = None,
    probed: int | None = None,
    recall: float = RECALL,
    least: int = LEAST,
) -> DataFrame:
    """The ``k`` nearest rows found for each row that meets ``asked`` (a condition on the table's
    columns): query_id, rank from 1, vec_id, score. A query's own id is no candidate.
    Numbers of pivots and files that are not given follow from the rows."""
    rows = _usable(embeddings, id, vector, asked)
    if pivots is None:
        pivots = min(max(PIVOTS, int(rows.count() ** 0.5)), MOST_PIVOTS)
    chosen = pivots_of(rows, pivots)
    count = len(chosen)
    empty = embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not count:
        return empty
    kind = "<f4" if rows.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    listed = min(listed, count)
    index = materialize(_permutations(rows, chosen, listed), "index")
    queries = rows.where("asked").groupBy("vec_id").agg(F.min("v").alias("v"))
    questions = materialize(_permutations(queries, chosen, listed).withColumnRenamed("vec_id", "query_id"), "queries")
    sample = questions.orderBy(F.xxhash64("query_id"), "query_id").limit(FITTED).collect()
    if not sample:
        return empty
    lists = {r.query_id: np.frombuffer(r.list, "<u2") for r in sample}
    true = _neighbours(index, [r.query_id for r in sample], np.stack([np.frombuffer(r.v, kind) for r in sample]), k, kind)
    depth, radius = fit([(lists[r.query_id], np.frombuffer(r.list, "<u2")) for r in true.collect()], count, recall)
    posted, probed = min(posted or depth, listed), min(probed or depth, listed)

    files, probes = _files(index, posted).drop("place"), _files(questions, probed)
    sizes = files.groupBy("pivot").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("buckets"))
    packs = probes.groupBy("pivot").agg(F.ceil(F.count("*") / PACK).cast("int").alias("packs"))
    shape = F.broadcast(sizes.join(packs, "pivot"))  # a row for each pivot
    left = files.join(shape, "pivot").select("pivot", F.pmod(F.xxhash64("vec_id"), "buckets").cast("int").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("packs") - 1)).alias("pack"), "vec_id", "list", "v")
    right = probes.join(shape, "pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.pmod(F.xxhash64("query_id"), "packs").cast("int").alias("pack"), "query_id", "place", "list", "v")
    keys = ["pivot", "bucket", "pack"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_probe(count, (posted, probed), radius, least, k, kind), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
