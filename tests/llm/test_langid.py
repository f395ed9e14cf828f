import zlib

import numpy as np

from siftwell.llm import langid


def test_gradients():
    """Back-propagation agrees with differences."""
    network = langid.Network.fresh(["a", "b", "c"], hidden=4, seed=3)
    for name in ("table", "recurrent", "output", "bias"):
        setattr(network, name, getattr(network, name).astype(np.float64))
    random = np.random.default_rng(0)
    ids, lengths, labels = random.integers(0, 256, (7, 5)), np.array([7, 3, 7, 5, 1]), np.array([0, 1, 2, 0, 1])
    _, gradients = network.loss_and_gradients(ids, lengths, labels)
    for parameter, gradient in zip(network.parameters(), gradients):
        for place in zip(*np.unravel_index(np.argsort(-np.abs(gradient).ravel())[:4], gradient.shape)):
            old = parameter[place]
            losses = []
            for step in (1e-5, -1e-5):
                parameter[place] = old + step
                losses.append(network.loss_and_gradients(ids, lengths, labels)[0])
            parameter[place] = old
            assert abs((losses[0] - losses[1]) / 2e-5 - gradient[place]) < 1e-5


def test_inference_is_what_was_learnt():
    """The fast pass gives the probabilities of the pass that is differentiated."""
    network = langid.Network.fresh(["a", "b"], seed=5)
    texts = [b"some text", b"", "größer als ein Fenster ".encode() * 9]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = network.document_probabilities(data, offsets)
    ids = np.zeros((langid.WINDOW, 1), np.intp)
    ids[: len(texts[0]), 0] = list(texts[0])
    logits = network.position_logits(ids)[: len(texts[0]), :, 0]
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(found[0], p.mean(axis=0), atol=1e-5) and not found[1].any()
    # cross entropy from the differentiated pass
    loss, _ = network.loss_and_gradients(ids, np.array([len(texts[0])]), np.array([1]))
    assert abs(loss + np.log(p[:, 1]).mean()) < 1e-4


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out("doc_id"))
    found = langid.annotate(documents, langid.learn(documents), only=["doc_id", "lang", "held_out"]).toPandas()
    assert len(found) == documents.count() and found["score"].between(0, 1).all()
    assert list(found["held_out"]) == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found["doc_id"]]
    out = found[found["held_out"]]
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97


def test_awkward(make, awkward):
    documents = make(awkward)
    found = langid.annotate(documents, langid.learn(documents, rounds=5))
    assert found.columns == [*documents.columns, "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == len(awkward)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    assert [r.t for r in rows] == [7] * len(rows)


def test_nothing_to_learn_from(make):
    documents = make([(1, "text", None)])
    assert langid.learn(documents) is None
    assert [(r.lang_pred, r.score) for r in langid.annotate(documents, None).collect()] == [("und", 0.0)]
    assert langid.annotate(make([]), langid.Network.fresh(["a"])).collect() == []
