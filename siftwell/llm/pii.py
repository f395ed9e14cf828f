"""Personal data: patterns, and terms that reveal what the patterns find.

Emails, IP addresses, card and phone numbers are found by fixed patterns. Each value found is an
entity to protect. A term that stands near an entity again and again gives it away: with
probabilities over all documents, the term discloses the part

    PMI(entity; term) / IC(entity) = log2(p(e,t) / (p(e) p(t))) / -log2 p(e)

of the entity's information; 1 means that the entity is certain once the term is read. Terms beyond one threshold are
removed, those beyond a lower one generalised to the class of words of their form: with digits (``[CODE]``),
capitalised (``[NAME]``), or other (``[WORD]``). A pair counts only if it was met in
several different contexts, so copies of one passage say nothing. p(t) comes from all texts: a
bitmap of fixed size tells which words may matter, and only those are counted by a shuffle.

Pairs are met within NEAR words to either side of the entity, so that their number grows with that of the
entities and not with the length of texts; a term that only ever stands farther away is not learnt. A term that is
learnt is marked wherever it stands, in every document, whether the entity is there or not. Terms have any
length; numbers (digits alone) are none. Contexts are told apart by their words of three and more characters.

A null text counts as empty. Offsets count code points; texts are searched whole, in time
that grows with their length. Repeated rows are answered each and count as documents
each, but as one context. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import bitmap, blocks, in_bitmap, materialize, mix, prefix_sums, runs, signed, span_hashes, whole_text

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
NEAR = 8  # words to either side of an entity, where pairs are met
CONTEXTS = 3  # different contexts in which a pair must be met
REMOVE, GENERALISE = 0.9, 0.6
BITS = 23  # of the bitmap's size

# The patterns, written so that they need no second look at a character.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[0-9A-Za-z_\u0080-\U0010ffff]+")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(end, at + 1))
    return found


def ips(text: str) -> list[Span]:
    small = lambda part: len(part := part.lstrip("0")) < 4 and int(part or 0) <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> list[Span]:
    return [m.span() for m in _CARD.finditer(text) if 13 <= m.end() - m.start() and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind: leftmost matches that do not overlap, less those that fail their test."""
    numbers = _DIGIT.search(text) is not None
    return {"email": emails(text), "ip": ips(text) if numbers else [], "card": cards(text) if numbers else [], "phone": phones(text) if numbers else []}


def written(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in spans.items() for a, b in own)


# -- terms ------------------------------------------------------------------------------

_CLASS = np.zeros(256, bool)
_CLASS[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")] = True
_CLASS[128:] = True
_VALUES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]  # A-Z as a-z


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of texts (runs of letters, digits, "_" and bytes of other scripts; A-Z as a-z),
    and the text of each."""
    starts, ends = runs(_CLASS[data], offsets)
    return span_hashes(prefix_sums(_VALUES[data]), starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def _hash(parts: list[bytes]) -> np.ndarray:
    """Hashes of short byte strings, each one a term of its own."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    return signed(span_hashes(prefix_sums(_VALUES[np.frombuffer(b"".join(parts), np.uint8)]), ends - sizes, ends))


def _contexts(text: str, spans: dict[str, list[Span]], reach: int | None = NEAR) -> tuple[list, list, list]:
    """entity, context, term of each term near an entity."""
    taken = sorted(s for own in spans.values() for s in own)
    words, at = [], 0
    for m in _WORD.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if not any(a < m.end() and m.start() < b for a, b in taken[at : at + 4]):
            words.append(m.span())
    starts = np.array([a for a, _ in words], np.int64)
    out: tuple[list, list, list] = ([], [], [])
    for kind, own in spans.items():
        for a, b in own:
            value = text[a:b].lower() if kind == "email" else _digits(text[a:b]) if kind != "ip" else text[a:b]
            i = int(np.searchsorted(starts, a))
            window = words if reach is None else words[max(0, i - reach) : i + reach]
            near = [w for w in (text[x:y] for x, y in window) if not w.isdecimal()]
            context = " ".join(w.lower() for w in near if len(w) >= 3)
            for w in near if reach is not None else sorted(set(near)):
                for column, v in zip(out, (f"{kind}:{value}", context, w)):
                    column.append(v.encode())
    return out


_FOUND = "uid long, id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base string, near array<struct<entity:long,context:long,term:long>>"
_NEAR = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("term", pa.int64())]))


def _find(batches: Iterator[pa.RecordBatch], reach: int | None = NEAR) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 40
    for batch in batches:
        for a in range(0, len(batch), 1000):
            part = batch.slice(a, 1000)
            counts, base, near = [], [], []
            for text in part.column("t").to_pylist():
                spans = base_spans(text)
                counts.append([len(own) for own in spans.values()])
                base.append(written(spans))
                rows: list[dict] = []
                if base[-1]:
                    entities, contexts, terms = _contexts(text, spans, reach)
                    if terms:
                        rows = [dict(entity=e, context=c, term=t) for e, c, t in zip(_hash(entities).tolist(), _hash(contexts).tolist(), _hash(terms).tolist())]
                near.append(rows)
            uids = np.arange(uid, uid + len(part))
            uid += len(part)
            columns = [pa.array(uids), part.column("id"), part.column("key"), *(pa.array(c) for c in np.array(counts, np.int64).T), pa.array(base, pa.string()), pa.array(near, _NEAR)]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base", "near"])


def _documents_with(documents: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """term, n: in how many documents each of the terms (and some others) stands."""
    marks = bitmap(terms, F.col("term"), BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column("t"), 4 << 20):
                hashes, owner = term_hashes(data, offsets)
                hit = in_bitmap(marks.value, hashes)
                pairs = np.unique(np.stack([hashes[hit], owner[hit].astype(np.uint64)]), axis=1)[0]
                own, n = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(own)), pa.array(n.astype(np.int64))], names=["term", "n"])

    rows = documents.select(whole_text(text).alias("t"))
    return rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def revealing(found: DataFrame, documents: DataFrame, text: str, contexts: int = CONTEXTS, generalise: float = GENERALISE) -> DataFrame:
    """entity, term, disclosure: the pairs beyond the lower threshold."""
    near = found.select("uid", F.explode("near").alias("x")).select("uid", "x.entity", "x.context", "x.term")
    # documents and different contexts are counted without holding either
    pairs = near.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("uid").alias("both"))
    pairs = materialize(pairs.where(F.col("contexts") >= contexts), "pairs")
    entities = near.select("entity", "uid").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    terms = _documents_with(documents, text, pairs.select("term").distinct())
    total = found.agg(F.count("*").cast("double").alias("total"))
    known = pairs.join(entities, "entity").join(terms.withColumnRenamed("n", "n_term"), "term").join(F.broadcast(total))
    information = F.log2(F.col("total") / F.col("n_entity"))
    disclosure = F.log2(F.col("both") * F.col("total") / (F.col("n_entity") * F.col("n_term"))) / information
    return known.where("n_entity < total").withColumn("disclosure", disclosure).where(F.col("disclosure") >= generalise).select("entity", "term", "disclosure")


def _outside(spans: list[Span], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the words overlap none of the spans."""
    if not spans:
        return np.ones(len(starts), bool)
    own = np.array(sorted(spans))
    reach = np.append(0, np.maximum.accumulate(own[:, 1]))  # the end of the spans up to each
    return reach[np.searchsorted(own[:, 0], ends, side="left")] <= starts


def _occurrences(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """id, text_key, term, first, last: where the terms (and some others) stand in whole texts, base spans left out."""
    marks = bitmap(terms, F.col("term"), BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column("t"), 1 << 20):
                starts, ends = runs(_CLASS[data], offsets)
                hashes = span_hashes(prefix_sums(_VALUES[data]), starts, ends)
                hit = np.flatnonzero(in_bitmap(marks.value, hashes))
                if not len(hit):
                    continue
                starts, ends, hashes = starts[hit], ends[hit], signed(hashes[hit])
                owner = np.searchsorted(offsets, starts, side="right") - 1
                points = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # code points before each byte
                first, last = points[starts] - points[offsets[owner]], points[ends] - points[offsets[owner]]
                keep = np.ones(len(hit), bool)
                cuts = np.flatnonzero(np.diff(owner, prepend=-1))
                for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(owner)]):
                    taken = base_spans(batch.column("t")[a + int(owner[x])].as_py())
                    keep[x:y] = _outside([s for own in taken.values() for s in own], first[x:y], last[x:y])
                at = pa.array(a + owner[keep])
                columns = [batch.column("id").take(at), batch.column("key").take(at), pa.array(hashes[keep]), pa.array(first[keep].astype(np.int32)), pa.array(last[keep].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text_key", "term", "first", "last"])

    return rows.mapInArrow(mark, "id long, text_key long, term long, first int, last int")


def find(
    documents: DataFrame, text: str = "text", id: str = "doc_id", contexts: int = CONTEXTS, remove: float = REMOVE, generalise: float = GENERALISE,
    reach: int | None = NEAR,
) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans), spans
    ("kind:start:end", by kind, then start; terms last), text_key, and ``removed``: of ``spans``, the terms to remove.

    reach: words to either side of an entity among which terms are learnt; None takes all of the document."""
    rows = documents.select(F.col(id).cast("long").alias("id"), F.xxhash64(whole_text(text)).alias("key"), whole_text(text).alias("t"))
    found = materialize(rows.mapInArrow(lambda batches: _find(batches, reach), _FOUND), "found")
    risky = revealing(found, documents, text, contexts, generalise).groupBy("term").agg(F.max("disclosure").alias("d"))
    risky = materialize(risky, "risky")
    # the spans of a document follow from its text, so repeated rows share them
    extra = _occurrences(rows, risky).join(risky, "term").groupBy("id", "text_key", "first", "last").agg(F.max("d").alias("d"))
    extra = extra.groupBy("id", "text_key").agg(F.sort_array(F.collect_list(F.struct("first", "last", "d"))).alias("terms"))  # of one document
    extra = extra.toDF("term_id", "term_key", "terms")
    name = lambda x: F.concat(F.lit(f"{TERM}:"), x["first"].cast("string"), F.lit(":"), x["last"].cast("string"))
    listed = F.coalesce(F.array_join(F.transform("terms", name), ","), F.lit(""))
    gone = F.coalesce(F.array_join(F.transform(F.filter("terms", lambda x: x["d"] >= remove), name), ","), F.lit(""))
    return found.join(extra, F.col("id").eqNullSafe(F.col("term_id")) & (F.col("text_key") == F.col("term_key")), "left").select(
        F.col("id").alias(id), *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(listed != "", listed)).alias("spans"), "text_key", gone.alias("removed"),
    )


def word_class(word: str) -> str:
    """The class that a term is generalised to, by its form."""
    return "CODE" if any(c.isdigit() for c in word) else "NAME" if word[:1].isupper() else "WORD"


def rewrite(text: str, spans: str, removed: str) -> str:
    """The text with base values named by kind, terms removed or replaced by a class of words."""
    cuts, out, gone = [], [], set(removed.split(","))
    for span in filter(None, spans.split(",")):
        kind, a, b = span.split(":")
        new = word_class(text[int(a) : int(b)]) if kind == TERM else kind.upper()
        cuts.append((int(a), int(b), "" if span in gone else f"[{new}]"))
    end = 0
    for a, b, new in sorted(cuts):
        if a >= end:
            out += [text[end:a], new]
        end = max(end, b)
    return "".join([*out, text[end:]])


def sanitised(documents: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """The documents with all their columns, the text rewritten; a null text stays null."""
    spans = find(documents, text, id, **options).where("spans <> ''").select(F.col(id).alias("i"), "text_key", "spans", "removed").dropDuplicates(["i", "text_key"])
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.col(id).cast("long").alias("k"), F.xxhash64(whole_text(text)).alias("h"), whole_text(text).alias("t"))
    joined = rows.join(spans, F.col("k").eqNullSafe(F.col("i")) & (F.col("h") == F.col("text_key")), "left")

    @F.pandas_udf("string")
    def new_text(t, s, r):
        return t.combine(s, lambda a, b: (a, b)).combine(r, lambda ab, c: rewrite(ab[0], ab[1], c))

    changed = joined.withColumn("new", F.when(F.col("spans").isNotNull(), new_text("t", F.coalesce("spans", F.lit("")), F.coalesce("removed", F.lit("")))))
    fields = [(F.coalesce("new", F.col("row").getField(c)) if c == text else F.col("row").getField(c)).alias(c) for c in documents.columns]
    return changed.select(*fields)
