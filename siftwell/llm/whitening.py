"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become whole numbers, x = floor(256 c). Each distinct x-vector counts once: the fit list, kept as packed
blocks of numbers in the shared folder. Its covariance V is never formed. A block of directions Q goes through
products VQ = Xᵀ(XQ) / n, X centred before multiplying; a product is one pass over the blocks, whose tasks send one small
matrix each that Spark adds up cell by cell. A Chebyshev polynomial of V, three terms of recurrence at a time, damps the part of the
spectrum below the block's smallest Ritz value; QR and a Rayleigh-Ritz step follow. This ends when the
residuals |Vu - eu| of the wanted pairs are as small as double precision makes them. The lower end of the unwanted
spectrum comes from a Lanczos run that travels as one more column of the first products.

Rows take part if their vector is neither null nor empty and holds neither nulls nor non-finite entries nor such that 256 c
is beyond 2^62.
Of several vector lengths only the commonest takes part (the shorter one of two as common). Repeated rows are
returned as often as they come, and count once in the fit; null ids are passed on. Directions
without variance have no whitened form and are left out: a table of equal vectors gives no rows, and so does an empty table. A deviation beyond 64 bits is null. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialize

SCALE = 256
KINDS = ("<i1", "<i2", "<i4", "<i8")
EPS = float(np.finfo(np.float64).eps)
LARGEST = 1 << 62


@dataclass
class Whitening:
    """What rows are projected by: distinct vectors and their sums, unit directions [d, r] by falling variance,
    variances [r], the trace, the largest residual of a pair, and the largest entry of whitened covariance minus identity."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_vectors(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, x: the vectors that take part, as whole numbers."""
    rows = embeddings.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float(LARGEST // SCALE)), F.lit(False)))
    rows = rows.where(fine)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    whole = F.transform("v", lambda c: F.floor(c * SCALE))
    return rows.where(F.size("v") == (length[0].n if length else 0)).select("id", whole.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors in the narrowest numbers that hold them."""
    for batch in batches:
        if len(batch):
            x = _matrix(batch.column("x"))
            least, most = int(x.min()), int(x.max())
            kind = next(k for k in KINDS if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
            yield pa.RecordBatch.from_pydict({"rows": pa.array([len(x)], pa.int64()), "kind": [kind], "x": pa.array([x.astype(kind).tobytes()], pa.binary())})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for rows, kind, data in zip(batch.column("rows").to_pylist(), batch.column("kind").to_pylist(), batch.column("x")):
            yield np.frombuffer(data.as_buffer(), kind).reshape(rows, -1)


def _exact_sums(blocks: DataFrame) -> tuple[int, list[int]]:
    """Vectors in all and their sums, added as whole numbers."""

    def work(batches):
        n, sums = 0, 0
        for x in _blocks(batches):
            wide = int(np.abs(x.astype(np.float64)).max()) * len(x) >= LARGEST
            sums = sums + x.sum(axis=0, dtype=object if wide else np.int64).astype(object)
            n += len(x)
        if n:
            exact = pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(sums)), pa.int32()), "n": pa.array([n] * len(sums), pa.int64()), "s": exact})

    found = blocks.mapInArrow(work, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (found[0].n, [int(r.s) for r in found]) if found else (0, [])


def _added(blocks: DataFrame, mean: np.ndarray, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of a small matrix that a centred block gives; every task adds up its own."""

    def work(batches):
        total = np.zeros(shape)
        for x in _blocks(batches):
            total += part(x - mean)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "value"])

    found = blocks.mapInArrow(work, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(shape)
    out.ravel()[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    return out


def _lowest(alpha: list[float], beta: list[float]) -> float:
    """A guess from below of the spectrum's lower end: the smallest Ritz value of a Lanczos run less its residual."""
    values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
    return max(0.0, values[0] - abs(beta[-1] * vectors[-1, 0]))


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int, degree: int, most_rounds: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Values, vectors and largest residual of the ``wanted`` leading pairs of a symmetric positive semidefinite
    operator that is known by its products with narrow matrices."""
    random = np.random.default_rng(seed)
    k = min(d, max(block, wanted + 1))
    q = np.linalg.qr(random.normal(size=(d, k)))[0] if k < d else np.eye(d)
    lanczos = [np.ones(d) / np.sqrt(d)]
    alpha, beta = [], []

    def times(q: np.ndarray, probe: bool = False) -> np.ndarray:
        if not probe:
            return product(q)
        y = product(np.column_stack([q, lanczos[-1]]))
        w = y[:, -1]
        alpha.append(float(w @ lanczos[-1]))
        for _ in range(2):  # the whole run is kept orthogonal
            w = w - sum(v * (v @ w) for v in lanczos)
        beta.append(float(np.linalg.norm(w)))
        lanczos.append(w / beta[-1] if beta[-1] > 0 else w)
        return y[:, :-1]

    before, low, vq = np.inf, 0.0, times(q)
    for turn in range(most_rounds):
        # Rayleigh-Ritz: q is orthonormal and vq its product
        h = q.T @ vq
        values, turned = np.linalg.eigh((h + h.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        q, vq = q @ turned, vq @ turned
        residual = float(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max(initial=0))
        floor = values[0] * EPS
        if k == d or residual <= 4 * floor or (residual <= 64 * np.sqrt(d) * floor and residual > before / 2) or values[0] <= 0:
            break
        before = residual
        # the polynomial is small on [low, high] and grows from there to the largest value; scaled to stay near 1
        high = max(values[-1], values[0] * 1e-12)
        low = min(low, high * 0.999)
        center, half = (high + low) / 2, (high - low) / 2
        sigma = first = half / (values[0] - center) if values[0] > center else 1.0
        older, old = q, (vq - center * q) * (sigma / half)
        for _ in range(2, degree + 1):
            following = 1 / (2 / first - sigma)
            y = times(old, probe=turn == 0 and (not beta or beta[-1] > values[0] * 1e-9) and len(alpha) < d - 1)
            older, old = old, (y - center * old) * (2 * following / half) - older * (sigma * following)
            sigma = following
        if turn == 0 and alpha:
            low = _lowest(alpha, beta)
        q = np.linalg.qr(old)[0]
        vq = times(q)
    return values[:wanted], q[:, :wanted], residual


def fit(whole: DataFrame, components: int = 4, block: int = 32, degree: int = 8, most_rounds: int = 60) -> Whitening | None:
    """The whitening of the distinct vectors among ``whole``; nothing if they do not vary.

    block: directions that are iterated together; degree: of the polynomial, passes for each round.
    """
    blocks = materialize(whole.select("x").distinct().mapInArrow(_pack, "rows long, kind string, x binary"), "fit")
    n, sums = _exact_sums(blocks)
    if not n:
        return None
    d, mean, passes = len(sums), np.array([s / n for s in sums]), [1]

    def product(q: np.ndarray) -> np.ndarray:
        passes[0] += 1
        return _added(blocks, mean, q.shape, lambda x: x.T @ (x @ q)) / n

    trace = float(_added(blocks, mean, (d, 1), lambda x: (x * x).sum(axis=0)[:, None]).sum() / n)
    if trace <= 0:
        return None
    values, vectors, residual = leading_pairs(product, d, min(components, d), block, degree, most_rounds)
    real = values > 16 * d * EPS * values[0]
    values, vectors = values[real], vectors[:, real]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    scaled, r = vectors / np.sqrt(values), len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ scaled
        return np.column_stack([w.T @ w, w.sum(axis=0)])

    found = _added(blocks, mean, (r, r + 1), moments) / n
    covariance = found[:, :r] - np.outer(found[:, r], found[:, r])
    return Whitening(n, sums, vectors, values, trace, residual, float(np.abs(covariance - np.eye(r)).max()), passes[0] + 2)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """sum over dimensions of (n x - S)^2, exact; null beyond 64 bits."""
    bound = n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, sums))
    if len(sums) * bound * bound < LARGEST:
        return pa.array(((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1), pa.int64())
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def project(whole: DataFrame, found: Whitening | None, id: str = "vec_id") -> DataFrame:
    """For each vector and component: id, component from 1, n, deviation, whitened, explained, identity_error."""
    kind = whole.schema["id"].dataType.simpleString()
    schema = f"`{id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None:
        return whole.sparkSession.createDataFrame([], schema)
    mean, scaled, r = found.mean, found.directions / np.sqrt(found.variances), len(found.variances)
    explained = found.variances / found.trace

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, size = _matrix(batch.column("x")), len(batch)
            if not size:
                continue
            each = pa.array(np.repeat(np.arange(size), r))
            columns = [
                batch.column("id").take(each),
                pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), size)),
                pa.array(np.full(size * r, found.n)),
                _deviations(x, found.n, found.sums).take(each),
                pa.array(((x - mean) @ scaled).ravel()),
                pa.array(np.tile(explained, size)),
                pa.array(np.full(size * r, found.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.mapInArrow(work, schema)


def whitened(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """The projections of all vectors that take part on their leading directions, with unit variance."""
    whole = whole_vectors(embeddings, id, vector)
    return project(whole, fit(whole, **options), id)
