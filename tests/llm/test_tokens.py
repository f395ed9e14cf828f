import math
import os
import random

import numpy as np
import pytest

from siftwell.llm import sentencepiece_codec as codec
from siftwell.llm import token_counts
from siftwell.llm.queries import MODEL

needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as file:
        return file.read()


def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return [r.text for r in rows] + codec.AWKWARD + ["trailing ", " lead", "a  b", "a   \n b", "\n", "▁x y▁", "ab\u0301c \ud7ff"]


@needs_model
def test_parity_with_sentencepiece(spark, model):
    assert codec.parity(model, texts(spark)) == []


@needs_model
def test_blocks_give_the_ids_of_whole_texts(spark, model):
    import sentencepiece

    theirs, ours, every = sentencepiece.SentencePieceProcessor(model_proto=model), codec.Codec(model), texts(spark)
    assert ours.by_word
    ours.known.most = 50  # the table of words starts anew again and again
    for i in range(0, len(every), 20):
        part = every[i : i + 20]
        flat, bounds = ours.encode(part)
        for j, expected in enumerate(theirs.encode(part)):
            own = flat[bounds[j] : bounds[j + 1]].tolist()
            assert own == expected and ours.decode(own) == theirs.decode(expected)
    assert ours.decode([3 + 0xC3, 3 + 0x28]) == theirs.decode([3 + 0xC3, 3 + 0x28])  # bytes that are no UTF-8


def unigram(pieces):
    """The protobuf of a unigram model with byte pieces."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(number, wire, value):
        return varint(number << 3 | wire) + (value if wire == 5 else varint(value) if wire == 0 else varint(len(value)) + value)

    every = [("<unk>", 0.0, 2), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256)), *((p, s, 1) for p, s in pieces)]
    out = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, kind)) for p, s, kind in every)
    out += field(2, 2, field(3, 0, 1) + field(35, 0, 1))
    return out + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))


def test_unigram_model():
    draw = random.Random(2)
    pieces = {"▁": -2.5, "▁a": -2.1, "ab": -2.3}
    pieces |= {"".join(draw.choice("ab▁é") if i == 0 else draw.choice("abé") for i in range(draw.randint(1, 4))): -draw.uniform(2, 9) for _ in range(40)}
    data = unigram(list(pieces.items()))
    assert codec.parse(data).kind == codec.UNIGRAM
    samples = ["".join(draw.choice("aab bé") for _ in range(draw.randint(0, 30))) for _ in range(200)]
    assert codec.parity(data, [s for s in samples if s.strip()]) == []


@needs_model
def test_codec_on_documents(make, awkward, model):
    documents = make(awkward)
    found = codec.annotate(documents, model, verify="same")
    assert found.columns == [*documents.columns, "ids", "same"]
    rows = found.collect()
    assert len(rows) == len(awkward) and all(r.same for r in rows) and all(r.ids == [] for r in rows if not r.text)
    again = codec.decoded(found, model).collect()
    assert [r.decoded for r in again] == [r.text or "" for r in again]
    counts = {r.doc_id: r for r in codec.checked(documents, model).collect()}
    assert all(counts[r.doc_id].n_tokens == len(r.ids) and counts[r.doc_id].round_trip for r in rows)
    assert codec.annotate(make([]), model).collect() == [] and codec.checked(make([]), model).collect() == []


def brute_count(text, pieces, byte_fallback=True):
    """The best segmentation of a whole text, every start and end tried; (score, pieces)."""
    if not text:
        return 0
    text = "▁" + text.replace(" ", "▁")
    unknown = min(pieces.values()) - 10
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(text)
    for i, c in enumerate(text):
        score, n = best[i]
        ways = [(i + len(p), s, 1) for p, s in pieces.items() if text.startswith(p, i)]
        if c not in pieces:
            ways.append((i + 1, unknown, len(c.encode())))
        for end, s, k in ways:
            if score + s > best[end][0] or (score + s == best[end][0] and n + k < best[end][1]):
                best[end] = (score + s, n + k)
    return best[-1][1]


def test_counts_against_brute_force():
    draw = random.Random(4)
    pieces = {"▁": -2.5}
    pieces |= {("▁" if draw.random() < 0.3 else "") + "".join(draw.choice("abc") for _ in range(draw.randint(1, 4))): -draw.uniform(1, 9) for _ in range(30)}
    counter = token_counts.Counter(pieces)
    samples = ["".join(draw.choice("aabbc  é") for _ in range(draw.randint(0, 25))) for _ in range(300)] + ["a" * 400]
    _, found = counter.count(samples)
    assert found == [brute_count(s, pieces) for s in samples]


@needs_model
def test_rebuild_checks_the_path_of_the_tasks(model, monkeypatch):
    codec.rebuild(model)
    split = codec.Codec._words
    monkeypatch.setattr(codec.Codec, "_words", lambda self, text: split(self, text[:-1]))
    with pytest.raises(ValueError, match="differs from sentencepiece"):
        codec.rebuild(model)


@needs_model
def test_counts_against_the_library(spark, model):
    """The same vocabulary as a unigram model of the tokenizers library, over whole texts."""
    from tokenizers import Tokenizer, models

    pieces, fallback, prefix = token_counts.scores_of(model)
    parsed = codec.parse(model)
    library = Tokenizer(models.Unigram([(p, pieces.get(p, -1e9 if i else 0.0)) for i, (p, _, _) in enumerate(parsed.pieces)], unk_id=0, byte_fallback=True))
    every = [t for t in texts(spark) if "<" not in t]
    _, found = token_counts.Counter(pieces, fallback, prefix).count(every)
    want = [len(library.encode("▁" + t.replace(" ", "▁")).ids) if t else 0 for t in every]
    assert found == want


@needs_model
def test_counts_of_documents(make, awkward, model):
    documents = make(awkward)
    rows = token_counts.counts(documents, model).collect()
    assert len(rows) == len(awkward)
    pieces, fallback, prefix = token_counts.scores_of(model)
    want = {t: token_counts.Counter(pieces, fallback, prefix).count([t])[1][0] for _, t, *_ in awkward if t}
    for id, text, *_ in awkward:
        assert {r.n_tokens for r in rows if r.doc_id == id} == {want.get(text, 0)}
    assert token_counts.counts(make([]), model).collect() == []


def test_words_are_remembered_for_two_generations():
    from siftwell.llm.common import Remembered

    kept = Remembered(2)
    for word in "abc":
        assert kept.missing(iter(word)) == {word}
        kept[word] = word
    assert kept.missing(iter("a")) == set() and kept["a"] == "a"
    kept.update(d="d", e="e")
    assert kept.missing(iter("b")) == {"b"} and kept.missing(iter("a")) == set()
    assert np.all(len(kept) <= 3)
