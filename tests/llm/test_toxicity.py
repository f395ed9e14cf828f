"""The automaton against edit distances, the lexicon's search against brute force, and the scores of held-out rows."""

import random
import zlib

import numpy as np
import pytest

from siftwell.llm import toxicity
from siftwell.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int, text string, t string, i long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_counts_edits():
    draw = random.Random(1)
    for _ in range(400):
        word, other = ("".join(draw.choice("abc") for _ in range(draw.randint(0, 7))) for _ in range(2))
        automaton = toxicity.Automaton(word, 3)
        state = automaton.start()
        for letter in other:
            state = automaton.step(state, letter)
        want = distance(word, other)
        assert automaton.distance(state) == (want if want <= 3 else None)
        beginning = min(distance(word[:n], other) for n in range(len(word) + 1))
        assert automaton.beginning(state) == (beginning if beginning <= 3 else None)


def test_neighbours_are_all_found():
    draw = random.Random(2)
    make = lambda low, high: "".join(draw.choice("abcde") for _ in range(draw.randint(low, high)))
    terms = {make(3, 12): 1.0 for _ in range(60)} | {make(4, 8) + "*": 1.0 for _ in range(20)}
    lexicon = toxicity.Lexicon(terms)
    for _ in range(1500):
        word = make(1, 14)
        if draw.random() < 0.7:  # near a term
            word = list(draw.choice(sorted(terms)).rstrip("*") + make(0, 3))
            for _ in range(draw.randint(0, 2)):
                at = draw.randrange(len(word) + 1)
                word[at : at + draw.randint(0, 1)] = make(0, 1)
            word = "".join(word)
        want = {}
        for term in terms:
            letters = term.rstrip("*")
            if term == letters:
                found = distance(word, letters)
            else:
                found = min(distance(word[:n], letters) for n in range(len(word) + 1)) if len(letters) >= toxicity.LEAST_STEM else 99
            if 0 < found <= toxicity.edits(len(letters)):
                want[term] = found
        assert lexicon.neighbours(word) == want, word


@pytest.fixture(scope="module")
def taught(make, spark):
    """Texts of random words; the toxic ones hold terms of abuse, as words or with endings."""
    draw = random.Random(3)
    words = ["".join(draw.choice(["ba", "ko", "ri", "mu", "te", "na"]) for _ in range(draw.randint(1, 4))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(1200):
        text = [draw.choice(words) for _ in range(draw.randint(20, 60))]
        if toxic := i % 6 == 0:
            for _ in range(draw.randint(1, 3)):
                text[draw.randrange(len(text))] = draw.choice(["sleazeball", "dimwit", "grumpff" + draw.choice(words), "blockhead"])
        rows.append((i, " ".join(text), "en", "a"))
        labels.append((i, 1, int(toxic), None, None, None))
    model = toxicity.learn(make(rows), spark.createDataFrame(labels, LABELS))
    return rows, labels, words, model


def scores(make, model, texts):
    found = toxicity.annotate(make([(i, t, None, None) for i, t in enumerate(texts)]), model, only=["doc_id"])
    return [r.score for r in found.orderBy("doc_id").collect()]


def test_held_out_rows_are_told(make, taught):
    rows, labels, _, model = taught
    toxic = {r[0]: r[2] for r in labels}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    found = scores(make, model, [r[1] for r in held])
    right = np.mean([(s >= 0.3) == toxic[r[0]] for s, r in zip(found, held)])
    assert right > 0.98 and "grumpff*" in model.lexicon.weights


def test_misspelled_and_quoted_terms(make, taught):
    _, _, words, model = taught
    clean = " ".join(words[:30])
    plain, wrong, twice, ending, none = scores(make, model, [f"{clean} {w} {clean}" for w in ("blockhead", "blokhead", "sleaseballl", "grumpffish", "koritena")])
    assert min(plain, wrong, twice, ending) >= 0.3 > none
    said, meant = scores(make, model, [f'{clean} he said "blockhead" there {clean}', f"{clean} you blockhead you {clean}"])
    assert said < plain <= meant


def test_awkward_rows(make, spark, taught, awkward):
    model = taught[3]
    found = toxicity.annotate(make(awkward), model)
    assert found.columns[:4] == ["doc_id", "text", "lang", "source"] and found.columns[-2:] == ["score", "predicted"]
    rows = found.collect()
    assert len(rows) == len(awkward) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.text is None or not r.text.strip()}) == 1
    assert toxicity.annotate(make([]), model).count() == 0
    long = " ".join(["koritena"] * 50_000)
    assert scores(make, model, [long + " blockhead"])[0] > scores(make, model, [long])[0]  # read to the end


def test_little_to_learn_from(make, spark, awkward):
    labelled = lambda rows: toxicity.learn(make(awkward), spark.createDataFrame(rows, LABELS))
    assert labelled([]) == 0.0
    assert labelled([(4, 1, 0, None, None, None), (None, 1, 1, None, None, None), (7, 0, None, None, None, None)]) == 0.0
    share = labelled([(i, 1, i % 2, None, None, None) for i in range(1, 12)])
    assert 0 < share < 1 and {r.score for r in toxicity.annotate(make(awkward), share).collect()} == {share}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op13_toxicity"](spark, sf)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    joined = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert found.count() == 1000 and all(r.toxic or not r.predicted for r in joined)
    assert sum(r.predicted for r in joined) >= 0.5 * sum(r.toxic for r in joined)
