"""Encoding and decoding with SentencePiece models by the tokenizers library.

The model's protobuf is parsed here, field by field: pieces with scores and types, the model
type, byte fallback, and the normaliser's settings. From these the normaliser, the metaspace
marker, the model (unigram by its scores, or BPE with merges that are read off the
scores) and the decoder with byte fallback are rebuilt. Batches are encoded by several
threads. ``parity`` compares with the sentencepiece library, text by text; ``rebuild`` runs it over a
fixed set of awkward texts before any model is used.

The model's bytes (bounded: one file) travel with the tasks, so executors need no file. A null
text counts as empty: no ids, and it decodes to "". Long texts are encoded whole. Repeated rows get
the same ids each. An empty table gives an empty result. Further columns are passed on by
``annotate``, its own coming last; nulls in them do not matter.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from siftwell.llm.common import Remembered, blocks, give_back, whole_text

MARK = "▁"
# Fixed values of the model format: types of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
BLOCK = 1 << 20
#: Marks and what follows up to the next mark.
word_pattern = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
AWKWARD = ["", " ", "a", "  two  spaces ", "a\nb\tc", "naïve Straße ñandú", "日本語 テキスト", "🙂 emoji‍", "▁mark", "x" * 300, "1234567890", "<s> </s> <unk> <0x41>", "\x00\x07", "é combining"]


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @property
    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and raw values of a protobuf message's fields."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            if wire == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[wire]
            value, at = data[at : at + size], at + size
        yield number, value


def parse(data: bytes) -> Model:
    """A model from its protobuf: pieces (1), trainer settings (2), normaliser settings (3)."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            settings = dict(_fields(value))
            model.kind, model.byte_fallback = settings.get(3, UNIGRAM), bool(settings.get(35, 0))
        elif number == 3:
            settings = dict(_fields(value))
            model.charsmap = settings.get(2, b"")
            model.dummy_prefix, model.remove_extra_whitespaces, model.escape_whitespaces = (bool(settings.get(n, 1)) for n in (3, 4, 5))
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, those of better-scored pieces first."""
    rank = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    scores = {p: s for p, s, _ in model.pieces}
    found = []
    for piece in rank:
        parts = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in rank and piece[i:] in rank]
        found += [(-scores[piece], rank[a], rank[b], a, b) for a, b in parts]
    return [(a, b) for _, _, _, a, b in sorted(found)]


def _word_bound(model: Model) -> bool:
    """No piece goes on past the end of a word, so words can be encoded one by one."""
    return all(MARK not in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED))


def rebuild(data: bytes, check: bool = True) -> Tokenizer:
    """The model as a tokenizer. ``check``: compares a set of texts with the sentencepiece library first,
    through the tokenizer and through the codec that tasks encode by."""
    model = parse(data)
    if model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        unknown = model.pieces[model.unknown][0]
        core = models.BPE(vocab=vocabulary, merges=_merges(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is not supported")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_whitespaces else " "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if _word_bound(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])]
    )
    if check and (wrong := parity(data, AWKWARD, tokenizer) or codec_parity(data, AWKWARD)):
        raise ValueError(f"the rebuilt model differs from sentencepiece on {wrong[:3]!r}")
    return tokenizer


def parity(data: bytes, texts: list[str], tokenizer: Tokenizer | None = None) -> list[str]:
    """The texts whose ids or decoded text differ from those of the sentencepiece library."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    ours = tokenizer or rebuild(data, check=False)
    wrong = []
    for text, expected, found in zip(texts, theirs.encode(texts), ours.encode_batch(texts, add_special_tokens=False)):
        if found.ids != expected or ours.decode(found.ids, skip_special_tokens=False) != theirs.decode(expected):
            wrong.append(text)
    return wrong


def codec_parity(data: bytes, texts: list[str]) -> list[str]:
    """The texts that a codec, as tasks use it, gives other ids than the sentencepiece library."""
    import sentencepiece

    theirs, (flat, bounds) = sentencepiece.SentencePieceProcessor(model_proto=data), Codec(data).encode(texts)
    return [t for t, x, a, b in zip(texts, theirs.encode(texts), bounds[:-1], bounds[1:]) if flat[a:b].tolist() != x]


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file's bytes, from a local path or any that Spark can read."""
    if os.path.exists(path):
        with open(path, "rb") as file:
            return file.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


codecs.register_error("siftwell.bytewise", lambda error: ("\ufffd", error.start + 1))


class Codec:
    """Encodes and decodes blocks of texts. Where no piece reaches past a word, distinct words go to
    the tokenizer once and their ids are looked up after that; other models get whole texts."""

    WORDS = 200_000  # held in memory, twice, while a task runs
    LONG = 64  # characters beyond which a word is not held

    def __init__(self, data: bytes):
        model = parse(data)
        self.tokenizer = rebuild(data, check=False)
        self.prefix = MARK if model.dummy_prefix else ""
        self.by_word = _word_bound(model) and model.escape_whitespaces and not model.charsmap and not model.remove_extra_whitespaces
        self.bare = Tokenizer(self.tokenizer.model)
        self.known = Remembered(self.WORDS)
        self.plain = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]
        self.strip = model.dummy_prefix

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return word_pattern.findall(self.prefix + text.replace(" ", MARK))
        return (self.prefix + text.replace(" ", " " + MARK)).split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin."""
        if not self.by_word:
            found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            flat = np.concatenate([np.zeros(0, np.int32), *found])
            return flat, np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        words = [self._words(t) for t in texts]
        known = self.known
        new = list(known.missing(w for ws in words for w in ws))
        known.update((w, np.array(e.ids, np.int32).tobytes()) for w, e in zip(new, self.bare.encode_batch_fast(new, add_special_tokens=False)))
        found = [b"".join(map(known.__getitem__, ws)) for ws in words]
        for w in new:
            if len(w) > self.LONG:
                del known[w]
        return np.frombuffer(b"".join(found), np.int32), np.concatenate([[0], np.cumsum([len(b) // 4 for b in found], dtype=np.int64)])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; each byte that is no UTF-8 becomes U+FFFD, ids that the model lacks are left out."""
        try:
            data = b"".join(map(self.plain.__getitem__, ids))
        except IndexError:
            data = b"".join(self.plain[i] for i in ids if 0 <= i < len(self.plain))
        text = data.decode(errors="siftwell.bytewise")
        return text[1:] if self.strip and text[:1] == " " else text


_built: dict[tuple[bytes, int], Codec] = {}


def codec_of(data: bytes, threads: int) -> Codec:
    """The codec of this process."""
    if (data, threads) not in _built:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        _built[data, threads] = Codec(data)
    return _built[data, threads]


def _batched(frame: DataFrame, names: list[str], reads: dict[str, Column], work, adds: list[T.StructField]) -> DataFrame:
    """The columns ``names``, then those that ``work`` makes of each block of rows; internal names apart from the rows' own."""
    rows = frame.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), *(x.alias(k) for k, x in reads.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            for part in work(batch):
                kept = part[0].select([f"c{i}" for i in range(len(names))])
                yield pa.RecordBatch.from_arrays([*kept.columns, *part[1]], names=[*kept.schema.names, *(f.name for f in adds)])
        for codec in _built.values():  # the worker goes on with other stages
            codec.known = Remembered(codec.WORDS)
        give_back()

    kinds = [T.StructField(f"c{i}", rows.schema[f"c{i}"].dataType) for i in range(len(names))]
    found = rows.mapInArrow(run, T.StructType([*kinds, *(T.StructField(f.name, f.dataType) for f in adds)]))
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), *(F.col(f.name).alias(f.metadata["as"]) for f in adds))


def _adds(**columns: tuple[str, T.DataType]) -> list[T.StructField]:
    return [T.StructField(f"p_{k}", kind, metadata={"as": name}) for k, (name, kind) in columns.items()]


def annotate(documents: DataFrame, model: bytes, text: str = "text", only: list[str] | None = None, ids: str = "ids", verify: str | None = None, threads: int = 2) -> DataFrame:
    """The documents (or their columns ``only``), and the token ids of each whole text; in the column
    ``verify``, if it is named, whether decoding them gives the text back."""
    rebuild(model)  # a model that cannot be rebuilt fails here, not in the tasks

    def work(batch):
        codec = codec_of(model, threads)
        for first, end, _, _ in blocks(batch.column("t"), BLOCK):
            part = batch.slice(first, end - first)
            texts = part.column("t").to_pylist()
            flat, bounds = codec.encode(texts)
            columns = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))]
            if verify:
                columns.append(pa.array([codec.decode(flat[a:b].tolist()) == t for t, a, b in zip(texts, bounds[:-1], bounds[1:])], pa.bool_()))
            yield part, columns

    names = documents.columns if only is None else only
    adds = _adds(ids=(ids, T.ArrayType(T.IntegerType())), **({"same": (verify, T.BooleanType())} if verify else {}))
    return _batched(documents, names, {"t": whole_text(text)}, work, adds)


def decoded(frame: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded", threads: int = 2) -> DataFrame:
    """The rows and the text that their ids stand for; "" for null or no ids."""

    def work(batch):
        codec = codec_of(model, threads)
        for a in range(0, len(batch), 256):
            part = batch.slice(a, 256)
            yield part, [pa.array([codec.decode(x) for x in part.column("t").to_pylist()], pa.string())]

    reads = {"t": F.coalesce(F.col(ids), F.array().cast("array<int>"))}
    return _batched(frame, frame.columns, reads, work, _adds(text=(text, T.StringType())))


def checked(documents: DataFrame, model: bytes, id: str = "doc_id", text: str = "text", threads: int = 2) -> DataFrame:
    """One row per document: id, n_tokens, n_byte_tokens (of byte fallback), ids_sha256 (over
    little-endian 32-bit ids), and whether decoding gives the text back."""
    rebuild(model)
    byte_ids = np.array([i for i, p in enumerate(parse(model).pieces) if p[2] == BYTE], np.int32)

    def work(batch):
        codec = codec_of(model, threads)
        for first, end, _, _ in blocks(batch.column("t"), BLOCK):
            part = batch.slice(first, end - first)
            texts = part.column("t").to_pylist()
            flat, bounds = codec.encode(texts)
            fallback = np.concatenate([[0], np.cumsum(np.isin(flat, byte_ids), dtype=np.int64)])
            shas, same = [], []
            for i, t in enumerate(texts):
                own = flat[bounds[i] : bounds[i + 1]]
                shas.append(hashlib.sha256(own.astype("<i4").tobytes()).hexdigest())
                same.append(codec.decode(own.tolist()) == t)
            yield part, [pa.array(np.diff(bounds)), pa.array(np.diff(fallback[bounds])), pa.array(shas), pa.array(same)]

    adds = _adds(n=("n_tokens", T.LongType()), b=("n_byte_tokens", T.LongType()), s=("ids_sha256", T.StringType()), r=("round_trip", T.BooleanType()))
    return _batched(documents, [id], {"t": whole_text(text)}, work, adds)
