"""SentencePiece models run by the tokenizers library: encode, decode, and proof of parity."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame
from tokenizers import decoders, models, normalizers, pre_tokenizers

from triagelake.llm.common import give_back, only, prepared, texts

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: characters encoded at once, and distinct words remembered with their ids
SLICE_CHARS, KNOWN_CHUNKS = 1 << 21, 400_000
THREADS = 2

# fixed values: field numbers and piece types of the SentencePiece model message
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message in wire format; fixed-size values stay bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(message):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            if kind == 2:
                size, at = varint(at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind} at byte {at}")
            if at + size > len(message):
                raise ValueError("the model file is cut off")
            value = message[at : at + size]
            at += size
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True

    @property
    def unk(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def splits_at_marks(self) -> bool:
        """No piece goes on past the end of a word, so words can be encoded one by one."""
        inner = re.compile(f"[^{MARK}]{MARK}")
        return not any(inner.search(p) for p, _, t in self.pieces if t == NORMAL)


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in fields(data):
        if number == PIECES:
            got = dict(fields(value))
            m.pieces.append((got[1].decode("utf-8"), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
        elif number == TRAINER:
            got = dict(fields(value))
            m.kind, m.byte_fallback = got.get(3, UNIGRAM), bool(got.get(35, 0))
            if got.get(24, 0):
                raise ValueError("models with the space as a suffix are not supported")
        elif number == NORMALIZER:
            got = dict(fields(value))
            m.charsmap, m.dummy_prefix, m.squeeze = got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1))
            if not got.get(5, 1):
                raise ValueError("models without escaped spaces are not supported")
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {m.kind}: only unigram and BPE models are supported")
    if any(t == USER for _, _, t in m.pieces):
        raise ValueError("user-defined pieces are not supported")
    return m


def _merges(m: Model) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, best score of the joined piece first."""
    ids = {p: i for i, (p, _, t) in enumerate(m.pieces) if t == NORMAL}
    ranked = sorted(ids, key=lambda p: (-m.pieces[ids[p]][1], ids[p]))
    return [(p[:k], p[k:]) for p in ranked for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]


def build(m: Model) -> tokenizers.Tokenizer:
    """Normaliser, space marks, scores or merges, byte fallback and decoder of the model."""
    names = [p for p, _, _ in m.pieces]
    if m.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk, byte_fallback=m.byte_fallback)
    else:
        core = models.BPE(vocab={p: i for i, p in enumerate(names)}, merges=_merges(m), unk_token=names[m.unk], fuse_unk=True, byte_fallback=m.byte_fallback)
    t = tokenizers.Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Replace(tokenizers.Regex(" {2,}"), " "), normalizers.Strip()]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if m.splits_at_marks:
        t.pre_tokenizer = pre_tokenizers.Split(tokenizers.Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return t


class Codec:
    """One model in both libraries; made once per task from the bytes of the model file."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = parse_model(data)
        self.tokenizer = build(self.model)
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.dtype = "<u2" if len(self.model.pieces) <= 1 << 16 else "<u4"
        self.by_word = self.model.splits_at_marks and self.model.dummy_prefix
        self.plain = not (self.model.charsmap or self.model.squeeze)
        self.table = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, _, t in self.model.pieces]
        self._known: dict[str, bytes] = {}
        self._bad: set[str] = set()
        self._chunks = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def encode(self, batch: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def decode_packed(self, packed: bytes) -> str:
        """The text of packed ids, joined from the bytes of their pieces."""
        t = b"".join(map(self.table.__getitem__, np.frombuffer(packed, dtype=self.dtype).tolist())).decode("utf-8", "replace")
        return t[1:] if self.model.dummy_prefix and t[:1] == " " else t

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype == '<u2' else 'I'}", *ids)

    def marked(self, text: str) -> str:
        """The text after the model's normaliser, spaces as marks."""
        if self.plain and self.model.dummy_prefix:
            return MARK + text.replace(" ", MARK) if text else ""
        return self.tokenizer.normalizer.normalize_str(text)

    def normalized(self, text: str) -> str:
        """What decoding should give back."""
        t = self.marked(text).replace(MARK, " ")
        return t[1:] if self.model.dummy_prefix else t

    def encode_checked(self, batch: list[str]) -> tuple[list[bytes], list[bool]]:
        """Packed ids of each text, and whether the SentencePiece library gives the same.

        Where no piece goes past the end of a word, a text's ids are those of its words in order, in
        both libraries. Then each distinct word is encoded by both once, as one batch for all texts,
        and remembered. With any other model both libraries encode the whole texts.
        """
        if not self.by_word:
            ids = self.encode(batch)
            return [self.packed(i) for i in ids], [i == j for i, j in zip(ids, self.other.encode(batch), strict=True)]
        words = [self._chunks.findall(self.marked(t)) for t in batch]
        if len(self._known) > KNOWN_CHUNKS:
            self._known.clear()
        new = list(set().union(*words) - self._known.keys())
        if new:
            texts_ = [w[1:].replace(MARK, " ") for w in new]
            own = self.encode(texts_)
            for w, t, mine, theirs in zip(new, texts_, own, self.other.encode(texts_), strict=True):
                if not t:  # a mark alone is left of a text's last space, so it is compared behind a word
                    mine, theirs = (f(["a ", "a"]) for f in (self.encode, self.other.encode))
                    mine, theirs = mine[0][len(mine[1]) :], theirs[0][len(theirs[1]) :]
                self._known[w] = self.packed(mine)
                if mine != theirs:
                    self._bad.add(w)
        get = self._known.__getitem__
        return [b"".join(map(get, ws)) for ws in words], [self._bad.isdisjoint(ws) for ws in words] if self._bad else [True] * len(batch)


def sliced(batch: list[str], most: int = SLICE_CHARS) -> Iterator[list[str]]:
    part, size = [], 0
    for t in batch:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_decode(docs: DataFrame, model_path: str = MODEL_PATH, threads: int = THREADS) -> DataFrame:
    """doc_id, ids, n_tokens, decoded, round_trip, parity: one row per row.

    ``ids`` holds little-endian 16-bit numbers (32-bit for more than 65,536 pieces). A null or empty
    text has no ids. ``round_trip`` says whether decoding gives back the normalised text, ``parity``
    whether the SentencePiece library gives the same ids; both are checked for every row. The model
    file is read once on the driver and sent along, as its size doesn't depend on the data.
    """
    prepared(docs.sparkSession)
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, threads)
        for b in batches:
            at = 0
            for part in sliced(texts(b)):
                packed, parity = codec.encode_checked(part)
                back = [codec.decode_packed(p) for p in packed]
                same = [d == t or d == codec.normalized(t) for d, t in zip(back, part, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(part)), pa.array(packed, pa.binary()), pa.array([len(p) // int(codec.dtype[-1]) for p in packed], pa.int64()), pa.array(back, pa.string()), pa.array(same, pa.bool_()), pa.array(parity, pa.bool_())],
                    ["doc_id", "ids", "n_tokens", "decoded", "round_trip", "parity"],
                )
                at += len(part)
        del codec
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long, decoded string, round_trip boolean, parity boolean")
