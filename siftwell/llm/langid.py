"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of a text's UTF-8 bytes in both directions, gives a distribution over
languages at every byte, and a document's probabilities are the mean over all its bytes. It is
trained here in numpy by back-propagation through time, on a bounded sample of labelled rows;
after that every byte of every text is read by Spark tasks, with no shuffle.

Gates and candidate states use x / (1 + |x|) in place of the logistic function and tanh: of the
same shape, and cheap enough to label all bytes.

A null text and a text without a letter get "und" with score 0; so does every text when no row
has a label to learn from. Very long texts are read whole, window by window. Repeated rows get
the same answer each. An empty table gives an empty result. Further columns are
not read; ``annotate`` passes them on, its own two coming last under the names that it is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import blocks, give_back, whole_text

WINDOW = 96
HIDDEN = 8
UNDETERMINED = "und"
_BATCH = 4096  # windows that step together


def softsign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


@dataclass
class Network:
    """languages; for both directions tables [2, 256, 3H] (input weights and biases of each byte),
    recurrent weights [2, H, 3H] for update, reset and candidate; output [2, H, L] and bias [L]."""

    languages: list[str]
    table: np.ndarray
    recurrent: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 1) -> Network:
        random = np.random.default_rng(seed)
        draw = lambda scale, *shape: random.normal(0, scale, shape).astype(np.float32)
        return cls(languages, draw(0.5, 2, 256, 3 * hidden), draw(hidden**-0.5, 2, hidden, 3 * hidden), draw(hidden**-0.5, 2, hidden, len(languages)), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.recurrent, self.output, self.bias]

    # -- labelling --

    def position_logits(self, ids: np.ndarray) -> np.ndarray:
        """Logits [T, L, N] at every byte of windows [T, N]. Features come first, so that every
        step works on long rows; one product gives a state's output and the next step's gates."""
        steps, n = ids.shape
        H = self.recurrent.shape[1]
        logits = np.empty((steps, len(self.languages), n), np.float32)
        logits[:] = self.bias[:, None]
        x, spare, d = np.empty((3 * H, n), np.float32), np.empty((2 * H, n), np.float32), np.empty((H, n), np.float32)
        c = np.empty((H, n), np.float32)
        g = np.empty((3 * H + len(self.languages), n), np.float32)
        for way in (0, 1):
            table = np.ascontiguousarray(self.table[way])
            product = np.concatenate([self.recurrent[way].T, self.output[way].T])
            h = np.zeros((H, n), np.float32)
            g[:] = 0
            gates = x[: 2 * H]
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                x[:] = table.take(ids[t], axis=0, mode="clip").T
                gates += g[: 2 * H]
                np.abs(gates, out=spare)
                spare += 1
                gates /= spare
                gates += 1  # twice the gates
                np.multiply(gates[H:], g[2 * H : 3 * H], out=c)
                c *= 0.5
                c += x[2 * H :]
                np.abs(c, out=d)
                d += 1
                c /= d
                c -= h
                c *= gates[:H]
                c *= 0.5
                h += c
                np.matmul(product, h, out=g)
                logits[t] += g[3 * H :]
        return logits

    def window_sums(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The sum over a window's bytes of their probabilities [N, L]."""
        p = self.position_logits(ids)
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        p *= (np.arange(len(ids))[:, None] < lengths)[:, None, :]
        return p.sum(axis=0).T

    def document_probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities [documents, L] over all bytes of each text; zeros for empty ones."""
        sums = np.zeros((len(offsets) - 1, len(self.languages)))
        sizes = np.diff(offsets)
        counts = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = offsets[:-1][owner] + within * WINDOW
        lengths = np.minimum(WINDOW, offsets[1:][owner] - starts)
        padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
        for i in range(0, len(owner), _BATCH):
            part = slice(i, i + _BATCH)
            places = np.arange(WINDOW)[:, None]
            ids = padded[starts[part] + places]
            ids[places >= lengths[part]] = 0
            np.add.at(sums, owner[part], self.window_sums(ids.astype(np.intp), lengths[part]))
        return sums / np.maximum(sizes, 1)[:, None]

    # -- learning --

    def loss_and_gradients(self, ids: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over the bytes of windows [T, N], and its gradient by back-propagation through time."""
        steps, n = ids.shape
        H = self.recurrent.shape[1]
        logits = np.broadcast_to(self.bias, (steps, n, len(self.languages))).copy()
        states, kept = [], []
        for way in (0, 1):
            h, own, notes = np.zeros((n, H), np.float32), {}, {}
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                g = h @ self.recurrent[way]
                x = self.table[way][ids[t]]
                a = x[:, : 2 * H] + g[:, : 2 * H]
                gates = (softsign(a) + 1) / 2
                b = x[:, 2 * H :] + gates[:, H:] * g[:, 2 * H :]
                c = softsign(b)
                notes[t] = (h, g[:, 2 * H :], a, gates, b, c)
                h = h + gates[:, :H] * (c - h)
                own[t] = h
                logits[t] += h @ self.output[way]
            states.append(own)
            kept.append(notes)
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        inside = np.arange(steps)[:, None] < lengths
        total = inside.sum()
        loss = float(-(np.log(p[:, np.arange(n), labels] + 1e-9) * inside).sum() / total)
        p[:, np.arange(n), labels] -= 1
        p *= (inside / total)[:, :, None].astype(np.float32)
        table, recurrent, output = (np.zeros_like(x) for x in (self.table, self.recurrent, self.output))
        for way in (0, 1):
            back = np.zeros((n, H), np.float32)
            for t in range(steps - 1, -1, -1) if way == 0 else range(steps):
                h, gc, a, gates, b, c = kept[way][t]
                z, r = gates[:, :H], gates[:, H:]
                output[way] += states[way][t].T @ p[t]
                dh = back + p[t] @ self.output[way].T
                db = dh * z / (1 + np.abs(b)) ** 2
                da = np.concatenate([dh * (c - h), db * gc], axis=1) / (2 * (1 + np.abs(a)) ** 2)
                dg = np.concatenate([da, db * r], axis=1)
                recurrent[way] += h.T @ dg
                np.add.at(table[way], ids[t], np.concatenate([da, db], axis=1))
                back = dh * (1 - z) + dg @ self.recurrent[way].T
        return loss, [table, recurrent, output, p.sum(axis=(0, 1))]

    def fit(self, windows: list[bytes], labels: list[int], rounds: int = 220, batch: int = 256, rate: float = 0.02, seed: int = 1) -> float:
        """Adam over random batches of equal shares per language; the last loss."""
        random = np.random.default_rng(seed)
        labels = np.array(labels)
        lengths = np.array([min(len(w), WINDOW) for w in windows])
        ids = np.array([np.frombuffer(w[:WINDOW].ljust(WINDOW, b"\0"), np.uint8) for w in windows]).T.astype(np.intp)
        weights = 1 / np.bincount(labels)[labels]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        loss = float("inf")
        for step in range(1, rounds + 1):
            rows = random.choice(len(labels), min(batch, 4 * len(labels)), p=weights / weights.sum())
            loss, gradients = self.loss_and_gradients(ids[:, rows], lengths[rows], labels[rows])
            size = float(np.sqrt(sum((g**2).sum() for g in gradients)))
            for p, g, (m, v) in zip(self.parameters(), gradients, moments):
                g = g * min(1, 1 / (size + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g**2 - v)
                p -= rate * (1 - 0.9 * step / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return loss


def held_out(id: str) -> Column:
    """Rows that are kept out of learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(documents: DataFrame, text: str = "text", id: str = "doc_id", lang: str = "lang", per_language: int = 600, most_languages: int = 256, **options) -> Network | None:
    """A network learnt from labelled rows that are not held out; nothing if there are none.

    The sample is bounded: about ``per_language`` rows of each of the ``most_languages`` commonest
    labels, chosen by a hash of the id among all rows, and of each a passage of 3 windows at
    a place that depends on the hash.
    """
    rows = documents.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(id), F.lit(11)).alias("h"))
    rows = rows.where(~held_out(id) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return None
    spark = documents.sparkSession
    shares = spark.createDataFrame([(r["lang"], int(min(1.0, per_language / r["count"]) * (1 << 30))) for r in counts], "lang string, share long")
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share"))
    size = F.char_length("text")
    start = F.pmod(F.shiftright("h", 31), F.greatest(F.lit(1), size - 2 * WINDOW)) + 1
    passages = chosen.select("lang", "h", F.substring("text", start.cast("int"), F.lit(3 * WINDOW)).alias("text"))
    # the bound holds whatever the hash does
    passages = passages.orderBy("h", "text").limit(2 * per_language * len(counts)).collect()
    languages = sorted(r["lang"] for r in counts)
    windows, labels = [], []
    for row in sorted(passages, key=lambda r: (r.h, r.text)):
        data = row.text.encode()
        for i in range(0, len(data), WINDOW):
            windows.append(data[i : i + WINDOW])
            labels.append(languages.index(row.lang))
    network = Network.fresh(languages)
    network.fit(windows, labels, **options)
    return network


def annotate(documents: DataFrame, network: Network | None, text: str = "text", only: list[str] | None = None, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """The documents (or their columns ``only``), and for each the predicted language and its score, from 0 to 1."""
    names = documents.columns if only is None else only
    passed = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    # a text that is passed on is sent to the tasks once
    sent = [i for i, c in enumerate(names) if c == text and documents.schema[c].dataType == T.StringType()]
    own = f"c{sent[0]}" if sent else "t"
    rows = documents.select(*passed, *([] if sent else [whole_text(text).alias("t")]), whole_text(text).rlike(r"\p{L}").alias("letters"))
    if network is None:
        return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.lit(UNDETERMINED).alias(label), F.lit(0.0).alias(score))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(own)
            for first, end, data, offsets in blocks(texts.fill_null("") if texts.null_count else texts):
                part = batch.slice(first, end - first)
                found = network.document_probabilities(data, offsets)
                letters = part.column("letters").to_numpy(zero_copy_only=False)
                best = found.argmax(axis=1)
                labels = [network.languages[b] if known else UNDETERMINED for b, known in zip(best.tolist(), letters.tolist())]
                scores = np.where(letters, np.clip(found.max(axis=1), 0, 1), 0.0)
                yield part.drop_columns(["letters"] if sent else ["t", "letters"]).append_column("p0", pa.array(labels, pa.string())).append_column("p1", pa.array(scores))
        give_back()

    kinds = [T.StructField(f"c{i}", rows.schema[f"c{i}"].dataType) for i in range(len(names))]
    schema = T.StructType([*kinds, T.StructField("p0", T.StringType()), T.StructField("p1", T.DoubleType())])
    found = rows.mapInArrow(predict, schema)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("p0").alias(label), F.col("p1").alias(score))
