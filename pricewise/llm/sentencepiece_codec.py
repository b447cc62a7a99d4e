"""SentencePiece models on the tokenizers library.

The model file is a protobuf; ``parse_model`` reads the fields that encoding
needs from the wire format: pieces with scores and types, model type, byte
fallback and the normaliser. ``build`` makes the same tokenizer from them:

* normaliser: the compiled character map if there is one, extra spaces, then
  the dummy prefix and the metaspace marker ``U+2581`` for spaces;
* unigram models: pieces with their scores; BPE models: every way to put a
  piece together from two others, in the order of the pieces' scores;
* byte fallback for characters without a piece, and the way back in decoding.

If no piece has a marker after another character - as in all models trained
with the usual settings - no merge crosses the start of a word, so a text may
be encoded word by word and repeated words come from a bounded cache.
Otherwise the text stays whole.

Batches are encoded by the library's own threads. Every row is checked:
``parity`` says whether the sentencepiece library gives the same ids (for all
its words, or for the whole text), ``round_trip`` whether decoding all ids
gives the text back.

Null texts have null ids and null checks; empty texts have no ids. Repeated
rows are encoded row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricewise.llm.common import read, small_batches

MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters that are encoded in one call, and threads of a call.
CALL_CHARS, THREADS = 1 << 20, 2
#: Words whose ids a task keeps (about 200 MB).
CACHED_WORDS = 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message; values are ints or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def parse_model(data: bytes) -> Model:
    m = Model()
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
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.kind = v
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.add_dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    m.escape_whitespaces = bool(v)
    m.unk_id = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), 0)
    return m


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All pairs of pieces that make a piece, best score first."""
    score = {p: s for p, s, kind in pieces if kind in (NORMAL, USER)}
    rank = {p: i for i, (p, _, _) in enumerate(pieces)}
    found = []
    for p, s in score.items():
        for i in range(1, len(p)):
            if p[:i] in score and p[i:] in score:
                found.append((-s, rank[p], rank[p[:i]], rank[p[i:]], p[:i], p[i:]))
    return [x[-2:] for x in sorted(found)]


def build(m: Model):
    """The tokenizers-library tokenizer of a model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers
    if m.kind == BPE:
        unk = m.pieces[m.unk_id][0]
        core = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, _merges(m.pieces), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback)
    elif m.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback)
    else:
        raise ValueError(f"model type {m.kind}")
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape_whitespaces else " "))
    if m.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER)):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.add_dummy_prefix else [])])
    return t


class Codec:
    """Encoder and decoder of one model file's bytes.

    Where words encode independently, a text's ids are those of its words, and
    a word that was seen before comes from a bounded cache, which also knows
    whether the file's own library agrees."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        import sentencepiece
        self.model, self.threads = parse_model(data), threads
        self.tokenizer = build(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        m = self.model
        self.by_word = self.tokenizer.pre_tokenizer is not None and m.add_dummy_prefix and m.escape_whitespaces and not m.charsmap and not m.remove_extra_whitespaces
        self.starts = np.array([p.startswith(MARK) for p, _, _ in m.pieces])
        self.words: dict[str, bytes] = {}
        self.differs: set[str] = set()

    def _split(self, text: str) -> list[str] | None:
        """The words of a text, None where spaces or markers need the whole text."""
        if not self.by_word or not text or "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            return None
        return text.split(" ")

    def _learn(self, words: list[str]) -> None:
        """Put new words into the cache. They are encoded as texts of many words;
        a word's ids begin where a piece begins with the marker."""
        texts = [" ".join(words[i : i + 2000]) for i in range(0, len(words), 2000)]
        ids = list(chain.from_iterable(self._batch(texts)))
        own, refs = self._cut(ids), self.reference.encode(words, num_threads=self.threads)
        if len(own) != len(words):
            raise ValueError("a word without a marker at its start")
        self.words.update(zip(words, own, strict=True))
        if list(chain.from_iterable(refs)) != ids:
            self.differs.update(w for w, x, y in zip(words, own, refs, strict=True) if x != np.asarray(y, np.int32).tobytes())

    def _cut(self, ids: list[int]) -> list[bytes]:
        a = np.asarray(ids, np.int32)
        raw, at = a.tobytes(), np.append(np.flatnonzero(self.starts[a]), len(a)) * 4
        return [raw[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _batch(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        first, size = 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= CALL_CHARS or k == len(texts) - 1:
                out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[first : k + 1], add_special_tokens=False)]
                first, size = k + 1, 0
        return out

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """(ids, parity) of each text."""
        split = [self._split(t) for t in texts]
        new = {w for words in split if words for w in words} - self.words.keys()
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words, self.differs = {}, set()
            new = {w for words in split if words for w in words}
        self._learn(sorted(new))
        whole = [t for t, words in zip(texts, split, strict=True) if words is None]
        rest = iter(zip(self._batch(whole), self.reference.encode(whole, num_threads=self.threads), strict=True))
        ids, parity = [], []
        for words in split:
            if words is None:
                i, ref = next(rest)
                ids.append(np.asarray(i, np.int32))
                parity.append(i == ref)
            else:
                ids.append(np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32))
                parity.append(not self.differs or self.differs.isdisjoint(words))
        return ids, parity

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)

    def normalised(self, text: str) -> str:
        """What decoding gives back: the text after the normaliser, without the marker."""
        if not (self.model.charsmap or self.model.remove_extra_whitespaces):
            return text.replace(MARK, " ")
        out = self.tokenizer.normalizer.normalize_str(text).replace(MARK, " ")
        return out[1:] if self.model.add_dummy_prefix and text else out


_CODECS: dict[bytes, Codec] = {}


def _codec(data: bytes) -> Codec:
    """One codec per worker and model; its word cache lives as long as a task."""
    k = hashlib.sha256(data).digest()
    if k not in _CODECS:
        _CODECS[k] = Codec(data)
    return _CODECS[k]


def encoded(docs: DataFrame, text: str = "text", model: str = MODEL, with_ids: bool = True) -> DataFrame:
    """``docs`` without ``text``, with the struct ``__tokens``: n_tokens, n_byte_tokens,
    ids_sha256 (of the little-endian 32-bit ids), round_trip, parity, and ids."""
    small_batches(docs.sparkSession, 500)
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one model file, a few MB
    others = [c for c in docs.columns if c != text]
    kind = pa.struct([("n_tokens", pa.int64()), ("n_byte_tokens", pa.int64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_()), ("parity", pa.bool_()),
                      *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(batches):
        codec = _codec(shared.value)
        is_byte = np.array([p[2] == BYTE for p in codec.model.pieces])
        for b in batches:
            texts = b.column(text).to_pylist()
            some = [t for t in texts if t is not None]
            ids, parity = codec.encode(some)
            expect = iter(zip(ids, parity, codec.decode(ids), strict=True))
            rows = []
            for t in texts:
                if t is None:
                    rows.append(None)
                    continue
                i, same, decoded = next(expect)
                row = {"n_tokens": len(i), "n_byte_tokens": int(is_byte[i].sum()), "ids_sha256": hashlib.sha256(i.astype("<i4").tobytes()).hexdigest(),
                       "round_trip": decoded == codec.normalised(t), "parity": same}
                rows.append(row | ({"ids": i} if with_ids else {}))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(rows, kind)], names=[*others, "__tokens"])
        codec.words, codec.differs = {}, set()  # an idle worker keeps no words

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)
    ids = ", ids: array<int>" if with_ids else ""
    return docs.select(*[F.col(f"`{c}`") for c in [*others, text]]).mapInArrow(
        run, f"{fields}__tokens struct<n_tokens: long, n_byte_tokens: long, ids_sha256: string, round_trip: boolean, parity: boolean{ids}>")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False).select("doc_id", "__tokens.*")
