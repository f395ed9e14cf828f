"""Whitened embeddings against a dense eigendecomposition."""

import numpy as np

from siftwell.llm import whitening
from siftwell.llm.common import importable
from siftwell.llm.queries import QUERIES


def brute(rows, components=4):
    """id → for each component deviation, whitened (up to sign), explained; and the number of distinct vectors."""
    usable = [(i, v) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, np.float64)).all()]
    lengths = [len(v) for _, v in usable]
    common = min(set(lengths), key=lambda n: (-lengths.count(n), n)) if lengths else 0
    usable = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in usable if len(v) == common]
    fit = np.array(sorted({tuple(x) for _, x in usable}), np.int64).reshape(-1, common)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / max(n, 1)
    values, vectors = np.linalg.eigh(centred.T @ centred / max(n, 1))
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    keep = values > 1e-9
    values, vectors = values[keep], vectors[:, keep]
    out = []
    for i, x in usable:
        deviation = int(((n * np.array(x, object) - sums.astype(object)) ** 2).sum()) if common else 0
        w = (np.array(x) - sums / n) @ vectors / np.sqrt(values)
        out += [(i, j + 1, n, deviation, w[j], values[j] / np.trace(centred.T @ centred / n)) for j in range(len(values))]
    return out


def compare(found, want):
    got = [tuple(r) for r in found.collect()]
    key = lambda r: (r[0] is None, r[0], r[1], r[3], abs(r[4]))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    sign = {}
    for a, b in zip(got, want):
        if abs(b[4]) > 1e-3:
            sign.setdefault(a[1], np.sign(a[4] * b[4]))
    for a, b in zip(got, want):
        assert abs(a[4] * sign.get(a[1], 1) - b[4]) < 1e-8
        assert abs(a[5] - b[5]) < 1e-4 * b[5] and a[6] <= 1e-4


def frame(spark, rows, kind="float"):
    importable(spark)
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, x int, n int")


def test_query(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = QUERIES["op11_whitening"](spark, sf_dir)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(found, brute(rows))


def test_awkward_rows(spark):
    random = np.random.default_rng(2)
    rows = [(i, random.normal(size=6).astype(np.float32).tolist()) for i in range(40)]
    copies = [(100 + i, rows[0][1]) for i in range(30)]
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] + [0.0] * 5), (203, [float("inf")] + [0.0] * 5), (204, [1.0, 2.0]), (205, []), (None, [-0.0] * 6), (3, rows[3][1]), (206, [0.0] * 6)]
    compare(whitening.whitened(frame(spark, rows + copies + odd)), brute(rows + copies + odd))


def test_fewer_components_than_asked(spark):
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)]
    compare(whitening.whitened(frame(spark, line, "double")), brute(line))
    assert whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(frame(spark, [(1, [])])).count() == 0
    assert whitening.whitened(frame(spark, [])).count() == 0


def test_deviations_beyond_64_bits(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [0.0, 3.0])]
    found = {(r.vec_id, r.component): r.deviation for r in whitening.whitened(frame(spark, rows, "double")).collect()}
    assert found[(1, 1)] is None and found[(3, 1)] is not None


def test_pairs_are_certified():
    random = np.random.default_rng(4)
    x = random.normal(size=(20_000, 96))
    v = x.T @ x / len(x)
    passes = [0]

    def product(q):
        passes[0] += 1
        return v @ q

    values, vectors, residual = whitening.leading_pairs(product, 96, 4, 32, 8, 60)
    want, exact = np.linalg.eigh(v)
    assert residual < 1e-13 * values[0] and passes[0] < 60
    assert np.allclose(values, want[::-1][:4], rtol=1e-12)
    assert np.abs(np.abs((vectors * exact[:, ::-1][:, :4]).sum(axis=0)) - 1).max() < 1e-11
