import re

import pytest

from siftwell.llm import jaccard_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    """Set size and smallest linked id, all pairs compared."""
    sets = [(1 << 62 if r[0] is None else r[0], shingles(r[1])) for r in rows]
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    least = {}
    for i, (id, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), id), id)
    null = lambda x: None if x == 1 << 62 else x
    return sorted([(null(id), len(s), null(least[root(i)])) for i, (id, s) in enumerate(sets)], key=str)


def found(documents):
    return sorted(map(tuple, jaccard_join.classes(documents).collect()), key=str)


def test_against_all_pairs(make, awkward, corpus):
    rows = awkward + corpus
    want = brute(rows)
    assert len({c for _, _, c in want}) < len({i for i, *_ in want})  # there are links
    assert found(make(rows).repartition(5)) == want


def test_threshold_is_exact(make):
    """Pairs just at and just below 3/4."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for n, cut in [(32, 8), (32, 7), (33, 8), (44, 10), (44, 11), (12, 2), (12, 1)]:
        base = 1000 * n + 10 * cut
        rows += [(base, " ".join(f"{n}{w}" for w in words[:n])), (base + 1, " ".join(f"{n}{w}" for w in words[: n - cut]))]
    assert found(make(rows)) == brute(rows)


def test_many_near_copies(make):
    """A large group of near copies stays one class, whatever the number of its pairs."""
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(1, 400):
        own = list(words)
        own[i % 120] = f"z{i}"
        rows.append((i, " ".join(own)))
    assert {r.component_id for r in jaccard_join.classes(make(rows)).collect()} == {1}


def test_pairs_of_near_copies(make, monkeypatch):
    """Near copies of one text, many of which link with few others or none, do not all meet each other."""
    import random

    draw = random.Random(5)
    words = [f"n{i}" for i in range(150)]
    rows = []
    for i in range(1, 401):
        own = list(words)
        for place in draw.sample(range(150), draw.randint(1, 8)):
            own[place] = f"z{i}x{place}"
        rows.append((i, " ".join(own)))
    pairs, write = [], jaccard_join.materialize

    def counted(frame, name):
        table = write(frame, name)
        if name == "queries":
            pairs.append(table.count())
        return table

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    assert found(make(rows).repartition(4)) == brute(rows)
    assert len(pairs) == 1 and pairs[0] <= 4 * len(rows)


def test_what_is_shuffled(spark, make, awkward, corpus, monkeypatch, capsys):
    """Where tables are too large to be broadcast, texts travel once, the matrix is made and asked by three
    exchanges of postings, and of the heads of runs only those of common tokens, which have several, are looked at."""
    plans, sets, write = {}, [], jaccard_join.materialize

    def seen(frame, name):
        capsys.readouterr()
        frame.explain()
        plans.setdefault(name, []).append(capsys.readouterr().out)
        table = write(frame, name)
        if name == "sets":
            sets.extend(table.where("posted IS NOT NULL").collect())
        return table

    monkeypatch.setattr(jaccard_join, "materialize", seen)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert found(make(awkward + corpus).repartition(5)) == brute(awkward + corpus)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    exchanges = lambda name: [plan.count("Exchange hashpartitioning") for plan in plans.get(name, [])]
    assert exchanges("texts") == [2, 2]  # the texts, and the rows that name them
    # (token, group) and token for the matrix, token for who asks, the asked by group
    assert sum(exchanges("matrix") + exchanges("queries")) == 4
    common = 1 << jaccard_join.TOKEN_BITS
    assert all((token >= common) == (at >= r.rare) for r in sets for at, token in enumerate(r.posted))
    assert any(token >= common for r in sets for token in r.posted)
    assert str(common) not in plans["nearest"][0] and str(common) in plans["nearest"][1]


def test_one_of_each(make, awkward, corpus):
    rows = awkward + corpus
    documents = make(rows)
    kept = jaccard_join.one_of_each(documents)
    assert kept.columns == documents.columns
    want = brute(rows)
    assert sorted(((r.doc_id, bool(shingles(r.text))) for r in kept.collect()), key=str) == sorted([(c, True) for c in {c for _, n, c in want if n}] + [(i, False) for i, n, _ in want if not n], key=str)


def test_empty(make):
    assert jaccard_join.classes(make([])).collect() == []
    assert jaccard_join.one_of_each(make([])).collect() == []
    assert [tuple(r) for r in jaccard_join.classes(make([(4, None)])).collect()] == [(4, 0, 4)]


@pytest.mark.parametrize("size", [1, 7])
def test_runs_over_batches(size):
    """Postings in batches of any size give the same shared tokens."""
    import pyarrow as pa

    postings = [(1, 5), (2, 1), (2, 3), (2, 9), (3, 4), (4, 4), (4, 6), (5, 1), (6, 1), (6, 2), (6, 3), (6, 4), (6, 5), (6, 8)]
    batches = [pa.RecordBatch.from_pylist([{"token": t, "uid": u, "at": 10 * u, "salt": int(t == 5)} for t, u in postings[i : i + size]]) for i in range(0, len(postings), size)]
    rows = [tuple(r.values()) for b in jaccard_join._shared(iter(batches)) for r in b.to_pylist()]
    # one posting of a salted token is not known to be alone
    several = {t for t, _ in postings if t == 5 or sum(x == t for x, _ in postings) > 1}
    first = {t: min(u for x, u in postings if x == t) for t in several}
    assert sorted(rows) == [(t, u, 10 * u, first[t]) for t, u in postings if t in several]


def test_common_tokens_are_counted_in_place():
    import numpy as np

    draw = np.random.default_rng(3)
    for size in (0, 1, 40):
        sets = [np.unique(draw.integers(0, 30, draw.integers(0, 20)).astype(np.uint64)) for _ in range(size)] + [np.array([7], np.uint64)]
        tokens, n = np.unique(np.concatenate(sets), return_counts=True)
        got, counts = jaccard_join._repeated(sets)
        assert got.tolist() == tokens[n > 1].tolist() and counts.tolist() == n[n > 1].tolist() and sets == []
