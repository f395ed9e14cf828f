import hashlib
import random
import re

from pyspark.sql import functions as F
from siftwell.llm import pii

# The patterns as they are stated.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if passes(k, m.group())] for k, p in STATED.items()}


def test_patterns_against_the_stated_ones():
    draw = random.Random(1)
    found = 0
    for letters, longest, times in (("a@.1 2-+()%9b\né", 30, 15_000), ("0123456789 -+.", 80, 3000), ("1 4-", 40, 2000), ("a@.b", 40, 3000)):
        for _ in range(times):
            text = "".join(draw.choice(letters) for _ in range(draw.randint(0, longest)))
            assert brute(text) == pii.base_spans(text), text
            found += sum(map(len, brute(text).values()))
    assert found > 1000


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 150_000, "1 " * 150_000):
        pii.base_spans(text)


def test_found_in_documents(make, awkward):
    texts = awkward + [(20, "é call +49 30 1234567, mail a.b@c.example.org, at 10.0.0.255 pay 4111 1111 1111 1111.", None, None)]
    rows = pii.find(make(texts)).collect()
    assert len(rows) == len(texts)
    for id, text, *_ in texts:
        base = ",".join(f"{k}:{a}:{b}" for k, own in brute(text or "").items() for a, b in own)
        for r in (r for r in rows if r.doc_id == id):
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans == base
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(own) for own in brute(text or "").values()]


def revealing_corpus():
    """A name that stands near one address in several contexts and nowhere else, and a word that stands everywhere."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefg") for _ in range(6))
    rows = [(i, " ".join([word() for _ in range(12)] + ["everywhere"])) for i in range(300)]
    for i in range(300, 305):
        rows.append((i, f"{word()} {word()} everywhere Quimby writes from q@x.example.com {word()} {word()}"))
    # copies of one context say nothing
    rows += [(i, "alpha betabeta gammagamma h@y.example.com deltadelta") for i in range(400, 410)]
    return rows


def test_terms_that_reveal(make):
    rows = revealing_corpus()
    texts = dict(rows)
    found = {r.doc_id: r for r in pii.find(make(rows)).collect()}
    for id in range(300, 305):
        spans = [s.split(":") for s in found[id].spans.split(",")]
        terms = {texts[id][int(a) : int(b)] for kind, a, b in spans if kind == "term"}
        assert terms == {"Quimby", "writes", "from"}
        assert spans[0][0] == "email"
    assert all("term" not in found[i].spans for i in [*range(300), *range(400, 410)])


def test_terms_are_marked_wherever_they_stand(make):
    """Far from the entity, in documents without it, after other scripts, in repeated rows; terms of two characters too."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefg") for _ in range(6))
    fill = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, fill(12)) for i in range(300)]
    rows += [(i, f"{fill(2)} Quimby Xu {fill(1)} q@x.example.com {fill(2)} ñandú {fill(20)} quimby") for i in range(300, 305)]
    rows += [(400, f"🙂 é {fill(3)} XU, {fill(3)} Quimby-ß x@quimby.example.com"), (401, "Quimby"), (401, "Quimby"), (None, "Xu")]
    found = pii.find(make(rows)).collect()
    assert len(found) == len(rows)
    texts = {}
    for id, text in rows:
        texts.setdefault(id, text)
    got = {r.doc_id: [texts[r.doc_id][int(a) : int(b)] for kind, a, b in (s.split(":") for s in r.spans.split(",")) if kind == "term"] for r in found if "term" in r.spans}
    assert {id: sorted(t) for id, t in got.items()} == {**{i: ["Quimby", "Xu", "quimby", "ñandú"] for i in range(300, 305)}, 400: ["Quimby", "XU"], 401: ["Quimby"], None: ["Xu"]}
    clean = {r.doc_id: r.text for r in pii.sanitised(make(rows)).collect()}
    assert not any("quimby" in clean[i].lower() for i in [*range(300, 305), 400, 401])


def test_disclosure_is_as_defined(spark, make):
    """p(e|t) and p(e) by hand."""
    from math import log2

    rows = [(i, f"padding{i} words{i} here{i}") for i in range(90)]
    rows += [(100 + i, f"aaa{i} bbb{i} Marker ccc{i} 1.2.3.4 ddd{i}") for i in range(4)] + [(200 + i, f"other{i} Marker") for i in range(6)]
    documents = make(rows)
    from pyspark.sql import functions as F

    from siftwell.llm.common import whole_text

    found = documents.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), whole_text("text").alias("t")).mapInArrow(pii._find, pii._FOUND)
    got = [r.disclosure for r in pii.revealing(found, documents, "text", contexts=3, generalise=0.1).collect()]
    assert len(got) == 1 and abs(got[0] - log2((4 / 10) / (4 / 100)) / -log2(4 / 100)) < 1e-9


def test_sanitised(make):
    documents = make(revealing_corpus() + [(1000, None), (1001, "mail z@z.example.org now")])
    clean = pii.sanitised(documents)
    assert clean.columns == documents.columns
    after = {r.doc_id: r.text for r in clean.collect()}
    assert after[1000] is None and after[1001] == "mail [EMAIL] now"
    assert "Quimby" not in after[301] and "everywhere" in after[301] and "[EMAIL]" in after[301]
    assert after[5] == dict(revealing_corpus())[5]


def test_generalised_terms_keep_their_class():
    text = "Quimby of Élan sent id47 from x@y.example.com there"
    at = {w: f"term:{text.index(w)}:{text.index(w) + len(w)}" for w in ("Quimby", "Élan", "sent", "id47", "there")}
    mail = f"email:{text.index('x@')}:{text.index(' there')}"
    assert pii.rewrite(text, ",".join([mail, *at.values()]), at["there"]) == "[NAME] of [NAME] [WORD] [CODE] from [EMAIL] "


def test_empty(make):
    assert pii.find(make([])).collect() == [] and pii.sanitised(make([])).collect() == []


def test_documents_are_counted_once_for_all_contexts_of_a_pair(spark, make):
    """An entity in 10 of 1,000 documents, a term in 10, together in 3 of them with four contexts each: log2(30) / log2(100)."""
    rows, mail = [], "zoe@example.org"
    for i in range(1000):
        if i < 3:
            text = " ".join(f"{mail} Zorblax alpha{j} beta{j} gamma{j} delta{j} eps{j} zeta{j} eta{j} theta{j} iota{j} kappa{j}" for j in range(4))
        elif i < 10:
            text = f"{mail} nobody here"
        else:
            text = "Zorblax stands alone" if i < 17 else "nothing of the kind"
        rows.append((i, text, None, None))
    docs = make(rows)
    found = pii.materialize(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), F.col("text").alias("t")).mapInArrow(pii._find, pii._FOUND), "found")
    pairs = [r.disclosure for r in pii.revealing(found, docs, "text", generalise=0.0).collect() if r.disclosure < 0.8]
    assert any(abs(d - 0.7386) < 1e-3 for d in pairs)


def test_reach_of_the_window(make):
    """A term that always stands far from the entity is learnt where all of a document is the window."""
    far = " ".join(f"filler{j % 7}" for j in range(20))
    rows = [(i, f"zoe@example.org {far} Zorblax and only{i} again{i}", None, None) for i in range(6)] + [(100 + i, f"{far} v{i}", None, None) for i in range(300)]
    span = lambda found: {r.doc_id: r.spans for r in found.collect()}[0]
    at = rows[0][1].index("Zorblax")
    assert f"term:{at}:{at + 7}" in span(pii.find(make(rows), reach=None))
    assert f"term:{at}:{at + 7}" not in span(pii.find(make(rows)))
