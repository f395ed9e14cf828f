import re

import pytest

import corpus_pipeline
from siftwell.llm.common import components, materialize


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage leaves."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out))


def test_stages_pass_documents_on(spark, sf_dir, stages):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert [s.columns for s in stages.values()][:-1] == [columns] * 4


def test_clean_documents_stay(spark, sf_dir, stages):
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert stages["language_id"].count() >= 0.99 * before.count()


def test_one_of_each_text(stages):
    before, after = stages["language_id"].collect(), stages["exact_dedup"].collect()
    best = {}
    for r in before:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted((r.doc_id, r.text) for r in after) == sorted((i, t) for t, i in best.items())


def test_no_links_are_left(stages):
    before = [(r.doc_id, shingles(r.text)) for r in stages["exact_dedup"].collect()]
    kept = {r.doc_id for r in stages["jaccard_join"].collect()}
    linked = {}
    for i, (x, a) in enumerate(before):
        for y, b in before[:i]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                assert not (x in kept and y in kept)
                linked.setdefault(x, []).append(y)
                linked.setdefault(y, []).append(x)
    assert linked
    # who has no link stays, and so does the smallest of linked ones
    assert all(x in kept for x, s in before if x not in linked)
    assert all(x in kept for x, others in linked.items() if all(x < y for y in others) and all(x < z for y in others for z in linked[y] if z != x))


def test_the_mix_takes_every_document(stages):
    before = {r.doc_id for r in stages["jaccard_join"].collect()}
    counts = {r.doc_id: r["count"] for r in stages["mixing"].groupBy("doc_id").count().collect()}
    assert set(counts) == before and set(counts.values()) <= {1, 2}


def test_tokens_stand_for_the_texts(spark, sf_dir, stages):
    last = stages["sentencepiece"]
    assert last.count() == stages["mixing"].count() and last.where("NOT round_trip").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).columns == last.columns


def test_stages_on_awkward_tables(spark, make, awkward):
    for rows in (awkward, []):
        docs = make(rows).select("doc_id", "text", "lang", "source")
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, ""), name)
            docs.collect()
        # texts without letters go, of equal texts and of linked ones one stays; what is left is taken once at least
        assert {r.doc_id for r in docs.collect()} == ({5, 7, 9, 11} if rows else set())


def test_components(spark):
    import random

    draw = random.Random(8)
    for n, m in ((40, 30), (200, 180), (50, 200)):
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(60)]
        label = {x: x for e in edges for x in e}
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                low = min(label[a], label[b])
                changed = changed or label[a] != low or label[b] != low
                label[a] = label[b] = low
        found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert found == {x: c for x, c in label.items() if any(a != b and x in (a, b) for a, b in edges)}
