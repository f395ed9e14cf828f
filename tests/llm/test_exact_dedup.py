import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftwell.llm import exact_dedup


def brute(rows, best):
    groups = defaultdict(list)
    for id, text, *_ in rows:
        groups[text or ""].append(1 << 62 if id is None else id)
    out = []
    for text, ids in groups.items():
        keep, stays = best(ids), False
        for id in ids:
            out.append((None if id == 1 << 62 else id, None if keep == 1 << 62 else keep, len(ids), id == keep and not stays, hashlib.sha256(text.encode()).hexdigest()))
            stays = stays or id == keep
    return sorted(out, key=str)


@pytest.mark.parametrize("keep, best", [("largest", max), ("smallest", min)])
def test_against_brute_force(make, awkward, corpus, keep, best):
    rows = awkward + corpus
    found = exact_dedup.groups(make(rows), keep=keep)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, best)


def test_a_group_over_several_ranges(spark, make):
    """Nearly all rows are one text: the group is split over the ranges and mended."""
    rows = [(i, "the same text") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 3020)]
    found = exact_dedup.groups(make(rows).repartition(8), keep="largest")
    assert found.where("kept").count() == 21
    same = found.where("doc_id < 3000")
    assert same.where("keep_id = 2999 AND group_size = 3000").count() == 3000
    assert same.where("kept").select("doc_id").collect() == [(2999,)]


def test_carried_rows_are_whole(make, awkward):
    documents = make(awkward)
    kept = exact_dedup.deduplicated(documents, keep="largest")
    assert kept.columns == documents.columns
    before = {tuple(r) for r in documents.collect()}
    after = [tuple(r) for r in kept.collect()]
    assert set(after) <= before and len(after) == len({t or "" for _, t, *_ in awkward})


def test_normalised(make):
    found = exact_dedup.groups(make([(1, "A  b"), (2, "a b"), (3, "ab")]), normalise=lambda c: F.lower(F.regexp_replace(c, " +", " ")))
    assert {(r.doc_id, r.keep_id) for r in found.collect()} == {(1, 1), (2, 1), (3, 3)}


def test_empty(make):
    assert exact_dedup.groups(make([])).collect() == []
    assert exact_dedup.deduplicated(make([])).collect() == []
