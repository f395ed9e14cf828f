import numpy as np
from pyspark.sql import functions as F

from siftwell.llm import ann
from siftwell.llm.common import importable


def frame(spark, rows, kind="float"):
    importable(spark)
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, list int, v int")


def exact(rows, asked, k=5):
    """Nearest by cosine in double precision; the best of a repeated id, ties by the smaller id."""
    usable = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, np.float64)).all() and any(v)]
    out = {}
    for q in sorted({i for i, _ in usable if asked(i)}):
        vector = min((tuple(v) for i, v in usable if i == q))
        best = {}
        for i, v in usable:
            if i != q:
                s = float(v @ np.array(vector) / np.linalg.norm(v) / np.linalg.norm(vector))
                best[i] = max(best.get(i, -2), s)
        out[q] = sorted(((round(-s, 9), i) for i, s in best.items()))[:k]
    return out


def test_small_tables_are_exact(spark):
    random = np.random.default_rng(1)
    rows = [(i, random.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    found = ann.search(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    want = exact(rows, lambda i: i % 10 == 0)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(-r.score, 9), r.vec_id))
    assert got == want


def test_files_are_exact_without_a_radius(spark):
    """All files are opened and reranked whole, so nothing can lose a neighbour."""
    random = np.random.default_rng(4)
    rows = [(i, random.normal(size=8).astype(np.float32).tolist()) for i in range(400)] + [(i, [1.0] * 8) for i in range(400, 420)]
    found = ann.search(frame(spark, rows), F.col("vec_id") % 7 == 0, pivots=3, listed=3, posted=3, probed=3, least=5, recall=1)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(-r.score, 9), r.vec_id))
    assert got == exact(rows, lambda i: i % 7 == 0)


def test_recall(spark):
    importable(spark)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = ann.search(table, F.col("vec_id") % 50 == 0).toPandas()
    data = table.toPandas()
    ids, x = data["vec_id"].to_numpy(), np.stack(data["embedding"]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q, rows in found.groupby("query_id"):
        score = x @ x[ids == q][0]
        score[ids == q] = -9
        hits += len({*ids[np.lexsort((ids, -score))[:5]]} & {*rows["vec_id"]})
        total += 5
        assert np.allclose(rows["score"], [score[ids == v][0] for v in rows["vec_id"]])
    assert total == 5 * (ids % 50 == 0).sum() and hits / total >= 0.9


def test_awkward(spark):
    """Vectors that take no part, ties, repeated ids and rows, a very common vector."""
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 0.0])]
    rows += [(10, [1.0, 1.0]), (10, [1.0, 1.0]), (11, [2.0, 2.0]), (12, [1.0, 0.5]), (12, [1.0, 0.1]), (50, [1e-30, 1e-30]), (7, [1.0])]
    rows += [(i, [3.0, 3.0]) for i in range(100, 140)]
    want = exact([r for r in rows if r[0] != 7], lambda i: i % 50 == 0)
    got = {}
    for r in ann.search(frame(spark, rows, "double"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(-r.score, 9), r.vec_id))
    assert got == want


def test_queries_of_mixed_lengths(spark):
    """The commonest length of all rows counts, whatever the commonest among the queries."""
    rows = [(i, [1.0, float(i)]) for i in range(1, 30)] + [(i, [1.0, 2.0, float(i)]) for i in range(100, 110)]
    found = ann.search(frame(spark, rows), (F.col("vec_id") >= 100) | (F.col("vec_id") == 5)).orderBy("query_id", "rank").collect()
    want = exact(rows[:29], lambda i: i == 5)
    assert [(r.query_id, round(-r.score, 9), r.vec_id) for r in found] == [(5, *x) for x in want[5]]


def test_empty(spark):
    assert ann.search(frame(spark, []), F.lit(True)).collect() == []
    assert ann.search(frame(spark, [(1, None)]), F.lit(True)).collect() == []
    assert ann.search(frame(spark, [(1, [1.0, 2.0])]), F.lit(True)).collect() == []


def test_footrule():
    query = np.array([2, 0, 1])
    lists = np.array([[2, 0, 1], [0, 2, 1], [3, 4, 5]])
    # by hand: pivots outside a list stand at place 3
    assert ann.footrule(query, lists, 6).tolist() == [0, 2, 12]


def posted_frames(random, n=600, pivots=40, listed=12):
    """One file, as _probe gets it: all vectors and three queries."""
    import pandas as pd

    x = random.normal(size=(n, 8)).astype("<f4")
    centers = ann._unit(x[:pivots].astype(np.float64))
    lists = np.argsort(-(ann._unit(x.astype(np.float64)) @ centers.T), axis=1, kind="stable")[:, :listed].astype("<u2")
    rows = pd.DataFrame({"vec_id": np.arange(n), "list": [l.tobytes() for l in lists], "v": [v.tobytes() for v in x]})
    asked = rows.iloc[[100, 200, 300]].rename(columns={"vec_id": "query_id"}).assign(place=0)
    return rows, asked, lists


def test_footrule_decides(monkeypatch):
    """Only rows within the radius, and the nearest few, are opened: another distance opens others."""
    rows, asked, lists = posted_frames(np.random.default_rng(3))
    work = ann._probe(40, (12, 12), 60.0, 3, 1000, "<f4")
    found = work(None, rows, asked)
    for query, got in found.groupby("query_id"):
        apart = ann.footrule(lists[query], lists, 40)
        want = {i for i in np.flatnonzero(apart <= 60) if i != query} | set([i for i in np.argsort(apart, kind="stable") if i != query][:3])
        assert set(got["vec_id"]) == want and 3 <= len(want) < 599
    real = ann.footrule
    monkeypatch.setattr(ann, "footrule", lambda q, l, p: -real(q, l, p) + 1000)
    other = work(None, rows, asked)
    assert set(zip(found["query_id"], found["vec_id"])) != set(zip(other["query_id"], other["vec_id"]))


def test_pairs_are_opened_in_their_first_file_only():
    rows, asked, lists = posted_frames(np.random.default_rng(5))
    seen = []
    for place in range(4):
        pivot = [int(l) for l in lists[[100, 200, 300], place]]
        for q, p in zip((100, 200, 300), pivot):
            file = rows[(lists[:, :4] == p).any(axis=1)]
            one = asked[asked["query_id"] == q].assign(place=place)
            found = ann._probe(40, (4, 4), float("inf"), 3, 1000, "<f4")(None, file, one)
            seen += list(zip(found["query_id"], found["vec_id"]))
    want = {(q, int(i)) for q in (100, 200, 300) for i in np.flatnonzero((lists[:, :4, None] == lists[q, None, None, :4]).any(axis=(1, 2))) if i != q}
    assert len(seen) == len(set(seen)) and set(seen) == want


def test_fit():
    random = np.random.default_rng(2)
    pairs = [(random.permutation(30)[:20], random.permutation(30)[:20]) for _ in range(200)]
    depth, radius = ann.fit(pairs, 30, 0.9, (2, 4, 8, 16))
    met = lambda d: np.mean([len({*a[:d]} & {*b[:d]}) > 0 for a, b in pairs])
    assert met(depth) >= 0.91 and all(met(d) < 0.91 for d in (2, 4, 8, 16) if d < depth)
    inside = [ann.footrule(a, b[None, :], 30)[0] <= radius and len({*a[:depth]} & {*b[:depth]}) > 0 for a, b in pairs]
    assert 0.9 <= np.mean(inside) < 0.97
    assert ann.fit([], 30, 0.9) == (16, float("inf")) and ann.fit(pairs, 30, 1)[1] == float("inf")
