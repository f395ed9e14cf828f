"""Toxicity by a lexicon, Levenshtein automata for its misspelled terms, and scores of context windows.

The lexicon is learnt: words whose rows are labelled toxic far more often than all rows are (a likelihood ratio that holds for
as many words as were tested), counted over all labelled rows that are not held out, equal texts once. Its terms lie in a trie.
Terms are whole words, and stems that any ending may follow. For a word of a text, a Levenshtein automaton (bit sets of the places
reached with 0, 1, … edits) walks the trie: branches that no edit can mend are left at once. How much a misspelling of
a term weighs is learnt from rare words at the same distance from it; words that clean rows use as well are no misspellings.

Every hit is weighed in a window of words around it: inside quotation marks, or behind a verb of saying, a term is mentioned rather than meant;
beside a second person it is meant. Hits count towards abuse in that share and towards quotation in
the rest. A logistic regression over both, the strongest hit and the density turns them into a score. It is fitted on
the same rows; its prior lets quotations count less.

Nulls count as empty. Empty texts get the score of a text without hits. With no labelled row, or no toxic one, there is no lexicon
and all scores are the share of toxic rows (0 without any). Null labels and null ids teach nothing. Texts of any length are read
whole. Repeated rows get the same score each, an empty table gives an empty result. Further columns are not read; ``annotate`` passes them on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import Remembered, materialize, whole_text

TOKEN = re.compile(r"\w+(?:[@$!'’-]+\w+)*")
PERIOD = 1 << 17  # words that a process remembers the verdict of, twice over
WINDOW = 6  # words to either side of a hit
LEAST_LETTERS = 5  # shorter terms are met as they are only
LEAST_STEM = 6  # and so are shorter stems
LONG = 10  # letters from which a term may have two edits
STEMS = range(4, 9)  # letters of a stem
UNSEEN = 0.85  # of a term's weight that an edit leaves, as long as no word like it was met
RARE = 2  # rows: words in at most so many stand for words that were not met

# Marks and words of quoting and of address in the languages of the corpus.
OPENING, CLOSING = "\"“„«‹", "\"”“»›"
SAYING = frozenset("say says said saying call calls called quote quotes quoted wrote writes word words term dit dire mot écrit sagt sagte sagen wort schrieb dice dijo decir palabra escribió".split())
ADDRESS = frozenset("you your yours u ur tu te toi vous votre du dich dir dein ihr euch tú ti usted vosotros".split())


def edits(length: int) -> int:
    """Edits that a term of so many letters may have."""
    return 0 if length < LEAST_LETTERS else 1 if length < LONG else 2


class Automaton:
    """The Levenshtein automaton of a word. A state holds, for each number of edits, the set of places in the word
    (as bits) that are reached with so many."""

    def __init__(self, word: str, most: int):
        self.most, self.end = most, 1 << len(word)
        self.places: dict[str, int] = {}
        for i, c in enumerate(word):
            self.places[c] = self.places.get(c, 0) | 1 << i
        self.mask = (self.end << 1) - 1

    def start(self) -> tuple[int, ...]:
        return tuple(((2 << e) - 1) & self.mask for e in range(self.most + 1))

    def step(self, state: tuple[int, ...], letter: str) -> tuple[int, ...]:
        here, mask = self.places.get(letter, 0), self.mask
        out = [(state[0] & here) << 1]
        for e in range(1, self.most + 1):
            less = state[e - 1]  # a letter more, another letter, or (from the new state) a letter less
            out.append((((state[e] & here) << 1) | less | (less << 1) | (out[-1] << 1)) & mask)
        return tuple(out)

    def distance(self, state: tuple[int, ...]) -> int | None:
        """Edits from the letters that were read to the word."""
        return next((e for e, places in enumerate(state) if places & self.end), None)

    def beginning(self, state: tuple[int, ...]) -> int | None:
        """Edits from the letters that were read to the nearest beginning of the word."""
        return next((e for e, places in enumerate(state) if places), None)


@dataclass
class Lexicon:
    """Terms with weights: whole words, and stems (written with a star) that any ending may follow.
    ``near`` holds the weights of words at 1, 2, … edits from a term, ``usual`` words near a term that clean rows use."""

    weights: dict[str, float]
    near: dict[tuple[str, int], float] = field(default_factory=dict)
    usual: frozenset[str] = frozenset()

    def __post_init__(self):
        self.trie: dict = {}
        self.lengths = sorted({len(t) - 1 for t in self.weights if t[-1] == "*"})
        # of e + 1 pieces of a term, e edits leave one whole: the first at the start, the last at the end, others about their place
        self.pieces: dict[int, tuple[int, list[tuple[int, int]], list[set[str]]]] = {}
        for term in self.weights:
            stem = term[-1] == "*"
            letters = term[:-1] if stem else term
            n, e = len(letters), edits(len(letters))
            if e and not (stem and n < LEAST_STEM):
                node = self.trie
                for c in letters:
                    node = node.setdefault(c, {})
                node["*" * (1 + stem)] = term
                cuts = [n * i // (e + 1) for i in range(e + 2)]
                _, spans, sets = self.pieces.setdefault(n, (e, list(zip(cuts, cuts[1:])), [set() for _ in range(e + 1)]))
                for (x, y), own in zip(spans, sets):
                    own.add(letters[x:y])
        self.stemmed = sorted(n for n in {len(t) - 1 for t in self.weights if t[-1] == "*"} if n >= LEAST_STEM)

    def _may_match(self, word: str) -> bool:
        """Whether a piece of a term stands in the word near its place; without one the trie need not be walked."""
        m = len(word)
        for n, (e, spans, sets) in self.pieces.items():
            stems = n in self.stemmed
            if m < n - e or (m > n + e and not stems):
                continue
            if word[: spans[0][1]] in sets[0]:
                return True
            for i in range(1, len(spans)):
                x, y = spans[i]
                last = i == len(spans) - 1
                if last and not stems:
                    if word[m - (y - x) :] in sets[i]:
                        return True
                    continue
                for shift in range(-e, e + 1):
                    if x + shift >= 0 and word[x + shift : y + shift] in sets[i]:
                        return True
        return False

    def neighbours(self, word: str) -> dict[str, int]:
        """Terms at 1, 2, … edits from a word (stems: from one of its beginnings), by the word's automaton walking the trie."""
        if not self._may_match(word):
            return {}
        m = len(word)
        automaton = Automaton(word, max(e for n, (e, _, _) in self.pieces.items() if n - e <= m and (m <= n + e or n in self.stemmed)))
        found, stack = {}, [(self.trie, automaton.start())]
        while stack:
            node, state = stack.pop()
            for letter, child in node.items():
                if letter[0] != "*":
                    after = automaton.step(state, letter)
                    if any(after):
                        stack.append((child, after))
                    continue
                distance = automaton.distance(state) if letter == "*" else automaton.beginning(state)
                if distance and distance <= edits(len(child) - (letter == "**")):
                    found[child] = distance
        return found

    def exact(self, word: str) -> float | None:
        """Weight of the best term that a word is, or begins with."""
        best = self.weights.get(word)
        for n in self.lengths:
            if n >= len(word):
                break
            stem = self.weights.get(word[:n] + "*")
            if stem is not None and (best is None or stem > best):
                best = stem
        return best

    def all_exact(self, word: str) -> list[str]:
        """All terms that a word is, or begins with."""
        return [t for t in (word, *(word[:n] + "*" for n in self.lengths if n < len(word))) if t in self.weights]

    def match(self, word: str) -> float | None:
        """Weight of a word, as a term or as a misspelled one."""
        best = self.exact(word)
        if best is None and word not in self.usual and "*" not in word:
            best = max((self.near.get(n, 0.0) for n in self.neighbours(word).items()), default=0.0) or None
        return best


def words(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def share_of_abuse(text: str, tokens: list[re.Match], at: int) -> float:
    """How far a hit is meant and not mentioned, from 0 to 1, by the window around it."""
    first, last = max(0, at - WINDOW), min(len(tokens) - 1, at + WINDOW)
    before = text[tokens[first].start() : tokens[at].start()]
    after = text[tokens[at].end() : tokens[last].end() + 1]
    quoted = any(c in before for c in OPENING) and any(c in after for c in CLOSING)
    said = any(tokens[i].group() in SAYING for i in range(first, at))
    meant = any(tokens[i].group() in ADDRESS for i in range(first, last + 1) if i != at)
    return 1 / (1 + np.exp(-(2.0 - 2.5 * quoted - 1.0 * said + 1.0 * meant)))


def features(text: str, lexicon: Lexicon, verdicts: Remembered) -> tuple[float, float, float, float]:
    """log of abuse, log of quotation, the strongest hit that is meant, and hits among 100 words (as a logarithm)."""
    lower = text.lower()
    found = TOKEN.findall(lower)
    for word in verdicts.missing(found):
        verdicts[word] = lexicon.match(word)
    if not any(map(verdicts.get, set(found))):
        return 0.0, 0.0, 0.0, 0.0
    abuse = quotation = strongest = hits = 0.0
    tokens = list(TOKEN.finditer(lower))
    for i, token in enumerate(tokens):
        verdict = verdicts[token.group()]
        if verdict is not None:
            share = share_of_abuse(lower, tokens, i)
            abuse += verdict * share
            quotation += verdict * (1 - share)
            strongest = max(strongest, verdict * share)
            hits += 1
    return float(np.log1p(abuse)), float(np.log1p(quotation)), strongest, float(np.log1p(100 * hits / len(tokens)))


# Means and precisions of the prior: meant hits speak for, mentioned ones a little.
PRIOR_MEAN = np.array([1.0, 0.25, 0.5, 0.0])
PRIOR_PRECISION = np.array([0.5, 4.0, 0.5, 2.0])


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))


def regression(x: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by Newton's method, under the prior."""
    x = np.column_stack([x, np.ones(len(x))])
    mean = np.append(PRIOR_MEAN, np.log(share / (1 - share)) - 2)
    precision = np.append(PRIOR_PRECISION, 0.01)
    w = mean.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) + precision * (w - mean)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(precision), gradient)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def held_out(id: str):
    """Rows that are kept out of learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each text and their stems (with a star), with its label."""
    for batch in batches:
        for text, toxic in zip(batch.column("t"), batch.column("toxic").to_pylist()):
            own = set(words(text.as_py()))
            own |= {w[:n] + "*" for w in own for n in STEMS if n < len(w)}
            own = sorted(own)
            for a in range(0, len(own), 50_000):
                part = own[a : a + 50_000]
                yield pa.RecordBatch.from_pydict({"word": pa.array(part, pa.string()), "toxic": pa.array([toxic] * len(part), pa.int32())})


def pruned(terms: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Weights of the terms that say something of their own. terms: weight and toxic rows.
    A stem goes if a longer term has nearly all of its rows, a longer term if a stem that stays weighs as much."""
    kept = dict(terms)
    covered: dict[str, float] = {}
    for term, (_, rows) in terms.items():
        letters = term.rstrip("*")
        for n in STEMS:
            if n < len(letters):
                covered[letters[:n] + "*"] = max(covered.get(letters[:n] + "*", 0.0), rows)
    for stem, rows in covered.items():
        if stem in kept and rows >= 0.95 * kept[stem][1]:
            del kept[stem]
    out = {}
    for term, (weight, _) in kept.items():
        letters = term.rstrip("*")
        if not any(kept.get(letters[:n] + "*", (-np.inf,))[0] >= weight for n in STEMS if n < len(letters)):
            out[term] = weight
    return out


def excess(a: np.ndarray, m: np.ndarray, share: float) -> np.ndarray:
    """Likelihood ratio of "toxic as often as seen" (a of m rows) against "as often as all rows"; 0 if not more often."""
    part = lambda seen, expected: np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / expected), 0.0)
    ratio = 2 * (part(a, np.maximum(m * share, 1e-9)) + part(m - a, np.maximum(m * (1 - share), 1e-9)))
    return np.where((a > 2 * m * share) & (2 * a > m), ratio, 0.0)


def chosen(terms: list[str], toxic: np.ndarray, row: np.ndarray, term: np.ndarray, least: float) -> list[str]:
    """Terms that explain toxic rows which stronger terms leave unexplained: words that merely stand in the same
    texts, and in their near copies, are no terms. (row, term) says which row holds which term. Rounds take the terms of
    at least half the best ratio among the rows without a term so far."""
    left, out = np.ones(len(toxic), bool), np.zeros(len(terms), bool)
    while left.any() and 0 < toxic[left].sum() < left.sum():
        here = left[row]
        m = np.bincount(term[here], minlength=len(terms)).astype(np.float64)
        a = np.bincount(term[here], weights=toxic[row[here]].astype(np.float64), minlength=len(terms))
        ratio = np.where(out, 0.0, excess(a, m, toxic[left].mean()))
        if ratio.max(initial=0) < least:
            break
        out |= ratio >= max(least, ratio.max() / 2)
        left[row[out[term]]] = False
    return [t for t, taken in zip(terms, out) if taken]


def learn(documents: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", most_terms: int = 50_000, most_rows: int = 20_000) -> Model | float:
    """A model of labelled rows that are not held out; the share of toxic ones if there is no lexicon to learn.

    most_rows bounds the sample of labelled rows that everything is learnt from, most_terms the words that may become terms (the most telling ones stay).
    """
    marks = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(id)).select(F.col(id).alias("i"), (F.col(label) > 0).cast("int").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("i", F.lit(5)), "i", "toxic").limit(most_rows)
    rows = documents.where(~held_out(id)).select(F.col(id).alias("i"), whole_text(text).alias("t"))
    # most_rows short rows are sent to the texts; equal texts with equal labels teach once
    known = materialize(rows.join(F.broadcast(marks), "i").groupBy("toxic", F.sha2("t", 256).alias("h")).agg(F.min("t").alias("t")).drop("h"), "labelled")
    total = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    n, k = total.n, total.k or 0
    if not n or not k or k == n:
        return k / n if n else 0.0
    counts = known.select("t", "toxic").mapInArrow(_word_rows, "word string, toxic int").groupBy("word").agg(F.sum("toxic").cast("double").alias("a"), F.count("*").cast("double").alias("m"))
    counts = materialize(counts, "words")
    tested, share = counts.count(), k / n
    a, m = F.col("a"), F.col("m")
    # likelihood ratio of "toxic as often as all rows" against "as often as seen", for words that are toxic more often
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))
    ratio = 2 * (part(a, m * share) + part(m - a, m * (1 - share)))
    odds = F.log((a + 0.5) / (m - a + 0.5)) - float(np.log(share / (1 - share)))
    least = 2 * np.log(max(tested, 2)) + 2  # so that less than one word in all passes by chance
    telling = counts.where((a > 2 * m * share) & (2 * a > m) & (ratio > float(least))).select("word", odds.alias("weight"), a.alias("a"), ratio.alias("ratio"))
    terms = pruned({r.word: (r.weight, r.a) for r in telling.orderBy(F.desc("ratio"), "word").limit(most_terms).collect() if r.weight > 0})
    if not terms:
        return share
    names, lexicon = sorted(terms), Lexicon(terms)
    number = {t: i for i, t in enumerate(names)}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted({number[t] for w in set(words(text.as_py())) for t in lexicon.all_exact(w)}) for text in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(own, pa.list_(pa.int32()))], names=["toxic", "own"])

    found = known.mapInArrow(hits, "toxic int, own array<int>").collect()
    row, term = np.repeat(np.arange(len(found)), [len(r.own) for r in found]), np.array([t for r in found for t in r.own], np.int64)
    taken = chosen(names, np.array([r.toxic for r in found]), row, term, float(least))
    terms = {t: terms[t] for t in taken}
    if not terms:
        return share
    lexicon = Lexicon(terms)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, toxic, rows in zip(*(batch.column(c).to_pylist() for c in ("word", "a", "m"))):
                if lexicon.exact(word) is None:
                    out += [(word, term, distance, toxic, rows) for term, distance in lexicon.neighbours(word).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64()))], names=["word", "term", "distance", "a", "m"])

    # a misspelling that was never met is as telling as rare words at the same distance from the term; words that several clean
    # rows use are none. Both tables are bounded by the lexicon: so many edits of each term
    close = materialize(counts.where("word NOT LIKE '%*'").mapInArrow(near, "word string, term string, distance int, a double, m double"), "near")
    usual = close.where((F.col("m") > RARE) & (F.col("a") < F.col("m"))).select("word").distinct().collect()
    rare = close.where(F.col("m") <= RARE).groupBy("term", "distance").agg(F.sum("a").alias("a"), F.sum("m").alias("m")).collect()
    seen = {(r.term, r.distance): (r.a, r.m) for r in rare}
    prior, weights = float(np.log(share / (1 - share))), {}
    for term, weight in terms.items():
        for distance in range(1, edits(len(term.rstrip("*"))) + 1):
            toxic, rows = seen.get((term, distance), (0.0, 0.0))
            expected = 1 / (1 + np.exp(-(weight * UNSEEN**distance + prior)))
            p = (toxic + expected) / (rows + 1)
            weights[term, distance] = max(0.0, min(weight, float(np.log(p / (1 - p))) - prior))
    lexicon = Lexicon(terms, weights, frozenset(r.word for r in usual))
    fitted = known.mapInArrow(_features(lexicon, ["toxic"]), "toxic int, x array<double>").collect()
    x, y = np.array([r.x for r in fitted]), np.array([r.toxic for r in fitted], np.float64)
    weights, bias = regression(x, y, share)
    return Model(lexicon, weights, bias)


def _features(lexicon: Lexicon, names: list[str]):
    """Columns that are passed on, and x, the features of the text t."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdicts = Remembered(PERIOD)
        for batch in batches:
            x = [list(features(text.as_py(), lexicon, verdicts)) for text in batch.column("t")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x, pa.list_(pa.float64()))], names=[*names, "x"])

    return work


def annotate(documents: DataFrame, model: Model | float, text: str = "text", only: list[str] | None = None, score: str = "score", predicted: str = "predicted", threshold: float = 0.3) -> DataFrame:
    """The documents (or their columns ``only``), and for each its score and whether it reaches the threshold (1 or 0)."""
    names = documents.columns if only is None else only
    passed = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    rows = documents.select(*passed, whole_text(text).alias("t"))
    out = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    verdict = [F.col("s").alias(score), (F.col("s") >= threshold).cast("int").alias(predicted)]
    if not isinstance(model, Model):
        return rows.withColumn("s", F.lit(float(model))).select(*out, *verdict)
    own = [f"c{i}" for i in range(len(names))]
    work = _features(model.lexicon, own)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work(batches):
            x = batch.column("x").flatten().to_numpy().reshape(len(batch), -1)
            yield batch.drop_columns(["x"]).append_column("s", pa.array(model.scores(x)))

    schema = T.StructType([*(rows.schema[c] for c in own), T.StructField("s", T.DoubleType())])
    return rows.mapInArrow(predict, schema).select(*out, *verdict)
