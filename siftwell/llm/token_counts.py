"""Token counts under a unigram vocabulary, without keeping tokens.

A text's pre-tokens are its words with the marks (spaces) before them. The distinct pre-tokens of
a block of texts form a trie; the best segmentation score of a prefix (Viterbi's forward score) is
computed once, at the prefix's node, for all pre-tokens that begin with it, and the count of a
pre-token's pieces is read at its last node. The trie is walked depth first over the sorted
pre-tokens, so only the nodes of one path are held. Pieces are followed the same way: a node
knows which beginnings of pieces end there. Counts of pre-tokens are kept by a task's
process up to a bound, and no shuffle is needed.

Scores are the model's log probabilities; a model whose scores are merge ranks (BPE) has none, so
its pieces get Zipf's: -ln(rank + 1). A character that no piece begins with costs 10 less than the
worst piece and counts as its UTF-8 bytes (byte fallback) or, if the model has none, as one unknown
together with unknown neighbours. Of segmentations with the same score, the one with fewer
pieces counts.

A null text counts as empty: no tokens. Long texts and long words are counted whole. Repeated
rows get the same counts each. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import sentencepiece_codec as codec
from siftwell.llm.common import Remembered, blocks, whole_text

KEPT = 400_000  # counts that a process holds, twice
LONG = 256  # characters beyond which a pre-token's count is not held
_END = ""


def scores_of(data: bytes) -> tuple[dict[str, float], bool, bool]:
    """Pieces with log probabilities, whether bytes are pieces, and whether a text begins with a mark."""
    model = codec.parse(data)
    wanted = (codec.NORMAL, codec.USER_DEFINED)
    pieces = [(p, s) for p, s, kind in model.pieces if kind in wanted]
    if model.kind == codec.BPE:
        pieces = [(p, -math.log(rank + 1)) for rank, (p, _) in enumerate(sorted(pieces, key=lambda x: -x[1]), 1)]
    return dict(pieces), model.byte_fallback, model.dummy_prefix


class Counter:
    """Counts the pieces of pre-tokens."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool = True, prefix: bool = True):
        self.root: dict = {}
        for piece, score in pieces.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[_END] = score
        self.unknown = min(pieces.values(), default=0.0) - 10
        self.byte_fallback = byte_fallback
        self.prefix = codec.MARK if prefix else ""
        self.kept = Remembered(KEPT)

    def _child(self, node: tuple, c: str) -> tuple:
        """The node below by a character: (score, count, last is unknown, open beginnings of pieces)."""
        score, count, after_unknown, opened = node
        best, pieces, unknown, going = -math.inf, 0, False, []
        single = False
        for place, s, n in (*opened, (self.root, score, count)):
            below = place.get(c)
            if below is None:
                continue
            going.append((below, s, n))
            own = below.get(_END)
            if own is not None:
                single = single or place is self.root
                if s + own > best or (s + own == best and n + 1 < pieces):
                    best, pieces = s + own, n + 1
        if not single:
            n = count + (len(c.encode("utf-8", "replace")) if self.byte_fallback else int(not after_unknown))
            if score + self.unknown > best or (score + self.unknown == best and n < pieces):
                best, pieces, unknown = score + self.unknown, n, True
        return best, pieces, unknown, going

    def counts(self, words: list[str]) -> Iterator[int]:
        """The piece counts of sorted distinct pre-tokens."""
        path, before = [(0.0, 0, False, [])], ""
        for word in words:
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for c in word[shared:]:
                path.append(self._child(path[-1], c))
            before = word
            yield path[-1][1]

    def words(self, text: str) -> list[str]:
        """Pre-tokens: marks and what follows up to the next mark."""
        mark = codec.MARK
        if not text:
            return []
        if mark in text or "  " in text or text[0] == " " or text[-1] == " ":
            return codec.word_pattern.findall(self.prefix + text.replace(" ", mark))
        return (self.prefix + text.replace(" ", " " + mark)).split(" ")

    def count(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """For each text the numbers of pre-tokens and of tokens."""
        words = [self.words(t) for t in texts]
        kept = self.kept
        new = sorted(kept.missing(w for ws in words for w in ws))
        kept.update(zip(new, self.counts(new)))
        totals = [sum(map(kept.__getitem__, ws)) for ws in words]
        for w in new:
            if len(w) > LONG:
                del kept[w]
        return [len(ws) for ws in words], totals


_counters: dict[bytes, Counter] = {}


def counts(documents: DataFrame, model: bytes, id: str = "doc_id", text: str = "text", block: int = 4 << 20) -> DataFrame:
    """One row per document: id, n_pretokens, n_tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _counters:
            _counters[model] = Counter(*scores_of(model))
        counter = _counters[model]
        for batch in batches:
            for first, end, _, _ in blocks(batch.column("t"), block):
                part = batch.slice(first, end - first)
                words, tokens = counter.count(part.column("t").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.array(words, np.int64)), pa.array(np.array(tokens, np.int64))], names=["id", "n_pretokens", "n_tokens"])

    rows = documents.select(F.col(id).cast("long").alias("id"), whole_text(text).alias("t"))
    return rows.mapInArrow(work, "id long, n_pretokens long, n_tokens long").withColumnRenamed("id", id)
