import hashlib
import random

import numpy as np
import pytest

from siftwell.llm import suffix_dedup


def brute(rows, length=50):
    """Sizes, removed bytes and runs, and the digest of what is kept: every string looked up."""
    least, out = {}, []
    for id, text, *_ in rows:
        data, id = (text or "").encode(), 1 << 62 if id is None else id
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            least[s] = min(least.get(s, id), id)
    for id, text, *_ in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if least[data[i : i + length]] < (1 << 62 if id is None else id):
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((id, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(documents):
    return sorted(map(tuple, suffix_dedup.removed(documents).collect()), key=str)


@pytest.fixture(scope="module")
def rows(awkward, corpus):
    return [(i, t and t[:6000]) for i, t, *_ in awkward] + corpus


def test_against_brute_force(make, rows):
    want = brute(rows)
    assert sum(r[2] for r in want) > 10_000
    assert found(make(rows).repartition(5)) == want


def test_crowded_anchors(make, rows, monkeypatch):
    """Anchors that are dealt string by string give the same result."""
    monkeypatch.setattr(suffix_dedup, "CROWD", 2)
    crowds = suffix_dedup._crowded
    monkeypatch.setattr(suffix_dedup, "_crowded", lambda r, n: np.unique(np.concatenate([crowds(r, n), *[suffix_dedup.anchors(*_bytes([t or ""]))[1][:3] for _, t in rows[:40]]])))
    assert found(make(rows).repartition(3)) == brute(rows)


def _bytes(texts):
    encoded = [t.encode() for t in texts]
    return np.frombuffer(b"".join(encoded), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in encoded])])


def test_kept_texts(make):
    passage = "a passage of more than fifty bytes that both documents hold, word for word. "
    documents = make([(2, "Second. " + passage + "End."), (1, "First. " + passage)])
    kept = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.removed(documents, texts=True).collect()}
    assert kept[1] == "First. " + passage and kept[2] == "SecondEnd."


def test_suffix_arrays_sort_all_suffixes():
    draw = random.Random(5)
    for _ in range(500):
        text = np.array([draw.randint(0, draw.choice([1, 2, 4])) for _ in range(draw.randint(1, 60))], np.uint16)
        assert suffix_dedup.suffix_array(text, 6, 1000).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_equal_strings_have_equal_anchors():
    """Every string of two texts that share a passage finds its anchor at the same offset."""
    draw = random.Random(1)
    passage = bytes(draw.choice(b"ab c") for _ in range(300))
    places = []
    for lead in (b"", b"x" * 37, b"ab c"):
        data = np.frombuffer(lead + passage, np.uint8)
        where, h, first, last, _ = suffix_dedup.anchors(data, np.array([0, len(data)]))
        places.append({s - len(lead): (w - len(lead), v) for w, v, a, b in zip(where, h, first, last) for s in range(a, b + 1)})
    inside = range(len(passage) - 49)
    assert all(places[0][s] == places[1][s] == places[2][s] for s in inside)


def test_empty(make):
    assert found(make([])) == []
    nothing = hashlib.sha256(b"").hexdigest()
    assert found(make([(1, None), (2, "")])) == [(1, 0, 0, 0, nothing), (2, 0, 0, 0, nothing)]


def test_rows_of_texts_do_not_grow_with_ranges(make, rows, monkeypatch):
    """What many ranges and shards find of a text is one row for each kind."""
    monkeypatch.setattr(suffix_dedup, "RANGE", 2_000)
    monkeypatch.setattr(suffix_dedup, "SHARD", 1_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 50_000)
    tables = {}
    keep = suffix_dedup.materialize
    monkeypatch.setattr(suffix_dedup, "materialize", lambda frame, name: tables.setdefault(name, keep(frame, name)))
    assert found(make(rows).repartition(3)) == brute(rows)
    texts = tables["met"].select("id", "key").distinct().count()
    assert 0 < tables["met"].count() <= 2 * texts
    spans = tables["spans"]
    assert 0 < spans.count() <= 2 * spans.select("id", "key").distinct().count()
