import math

import pytest
from pyspark.sql import functions as F

from siftwell.llm import mixing


def table(make, sizes, words=3):
    return make([(1000 * k + i, " ".join(["w"] * (words + i % 3)), None, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)])


def shares(spark, tokens):
    total = sum(tokens.values())
    return spark.createDataFrame([(s, t, 1, t / total) for s, t in tokens.items()], "source string, tokens long, rows long, p double")


TOKENS = {"a": 700, "b": 200, "c": 60, "d": 40}


def weights(a):
    p = {s: (t / 1000) ** a for s, t in TOKENS.items()}
    return {s: x / sum(p.values()) for s, x in p.items()}


def test_entropy_is_met(spark):
    a = mixing.exponent(shares(spark, TOKENS), entropy=0.9)
    entropy = -sum(w * math.log(w) for w in weights(a).values())
    assert abs(entropy / math.log(4) - 0.9) < 1e-6


@pytest.mark.parametrize("budget", ["total", 500, 3000])
def test_repetition_is_met(spark, budget):
    a = mixing.exponent(shares(spark, TOKENS), repetition=3.5, budget=budget)
    size = 1000 if budget == "total" else budget
    most = max(w * size / TOKENS[s] for s, w in weights(a).items())
    assert abs(most - 3.5) < 1e-6 or (a < 1e-9 and most < 3.5) or a == 1


def test_targets_are_checked(spark):
    with pytest.raises(ValueError):
        mixing.exponent(shares(spark, TOKENS))


def test_budgets_are_filled(make):
    """Every source comes within one document of its budget, and each document is taken as often as the others of its source, or once more."""
    documents = table(make, {"a": 600, "b": 90, "c": 30})
    taken = mixing.realised(documents, repetition=2.0)
    plan = {r.source: r for r in mixing.plan(documents.select("source", mixing.words_in(F.col("text")).alias("tokens")), repetition=2.0).collect()}
    got = {r.source: r.n for r in taken.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    for source, row in plan.items():
        assert row.budget - 5 <= got[source] <= row.budget
    epochs = taken.groupBy("source", "doc_id").count().groupBy("source").agg(F.min("count").alias("lo"), F.max("count").alias("hi")).collect()
    assert all(r.hi - r.lo <= 1 for r in epochs)
    assert taken.groupBy("doc_id", "epoch").count().where("count > 1").count() == 0


def test_blocks_change_nothing(make, monkeypatch):
    """The same documents are taken however finely permutations are cut."""
    documents = table(make, {"a": 600, "b": 90, None: 30})
    results = []
    for rows in (1, 4, 4096):
        monkeypatch.setattr(mixing, "ROWS_PER_BLOCK", rows)
        results.append(sorted(map(tuple, mixing.realised(documents, entropy=0.8).collect()), key=str))
    assert results[0] == results[1] == results[2]
    assert any(r[1] is None for r in results[0])


def test_whole_budget_takes_every_document(make):
    documents = table(make, {"a": 300, "b": 40, "c": 20})
    mix = mixing.mixed(documents, budget="whole", repetition=1.5)
    assert mix.columns == documents.columns
    counts = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert len(counts) == 360 and set(counts.values()) == {1, 2}
    assert {counts[i] for i in range(300)} == {1}


def test_awkward(make, awkward):
    documents = make(awkward)
    for frame in (mixing.realised(documents, repetition=2.0), mixing.mixed(documents, repetition=2.0)):
        assert frame.count() > 0
    mix = mixing.mixed(documents, budget="whole", repetition=1.5)
    assert mix.columns == documents.columns
    # repeated rows are taken alike, and every text with a word stays
    assert {r.text for r in mix.collect()} >= {t for _, t, *_ in awkward if t and t.strip()}


def test_empty(make):
    for rows in ([], [(1, None, None, "a"), (2, " ", None, "b")]):
        assert mixing.realised(make(rows), repetition=2.0).collect() == []
        assert mixing.mixed(make(rows), entropy=0.5).collect() == []
