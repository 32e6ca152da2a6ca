"""SentencePiece encoding and decoding with the ``tokenizers`` library as the backend.

The model file is a protobuf; its wire format is read here, and from it come
the normaliser (character map, white space rules, the marker for a space, the
marker in front), the unigram scores or the merges that BPE scores imply, and
byte fallback. Batches are encoded multithreaded by the library.

Where no piece of the vocabulary crosses from a word to the next marker, or
between a Latin letter and another character, a text falls into units (markers
and the run of letters, or of others, behind them) that are encoded apart. A
worker keeps the ids of the first units it meets. The same holds for checks:
every unit is also encoded by the SentencePiece library. Units on which the
two differ take that library's ids and are reported, so results are always
SentencePiece's.

A null text gives null ids, an empty text none. Decoding gives the normalised
text: for an identity normaliser the text itself, with markers in it as spaces.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

MARK = "▁"
KEPT_UNITS = 400_000
GROUP_CHARS = 4_000_000
# Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of one protobuf message: number and value, the value undecoded unless a varint."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    byte_fallback: bool
    char_map: bytes
    dummy_prefix: bool
    strip_spaces: bool
    escape_spaces: bool

    @property
    def unknown_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parse_model(data: bytes) -> Model:
    """The parts of a model file that encoding and decoding need."""
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    if trainer.get(24, 0):
        raise ValueError("models with the marker behind the word are not supported")
    return Model(
        tuple(pieces),
        kind,
        bool(trainer.get(35, 0)),
        normalizer.get(2, b""),
        bool(normalizer.get(3, 1)),
        bool(normalizer.get(4, 1)),
        bool(normalizer.get(5, 1)),
    )


def build_tokenizer(model: Model, normalize: bool = True):
    """The model as a tokenizer of the ``tokenizers`` library; without ``normalize`` it takes text that is normalised already."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown_id, model.byte_fallback)
    else:
        merges = []
        usable = {p for p, _, t in model.pieces if t in (NORMAL, USER_DEFINED, UNUSED)}
        for piece, score, kind in model.pieces:
            if kind in (NORMAL, USER_DEFINED, UNUSED) and len(piece) > 1:
                halves = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in usable and piece[i:] in usable]
                merges += [(-score, ids[a], ids[b], a, b) for a, b in halves]
        merges.sort(key=lambda m: m[:3])
        core = models.BPE(
            ids,
            [m[3:] for m in merges],
            unk_token=model.pieces[model.unknown_id][0],
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    out = Tokenizer(core)
    own = [p for p, _, t in model.pieces if t == USER_DEFINED]
    out.add_tokens([AddedToken(p, normalized=True, special=False) for p in own])
    steps = []
    if model.char_map:
        steps.append(normalizers.Precompiled(model.char_map))
    if model.strip_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    decode = [decoders.Replace(MARK, " ")]
    if model.byte_fallback:
        decode.append(decoders.ByteFallback())
    decode.append(decoders.Fuse())
    if model.dummy_prefix and normalize:
        decode.append(decoders.Strip(" ", 1, 0))
    out.decoder = decoders.Sequence(decode)
    if not normalize:
        out.normalizer = normalizers.Sequence([])
    return out


_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_UNIT = re.compile(f"{MARK}*(?:[{_LETTERS}]+|[^{_LETTERS}{MARK}]+)|{MARK}+")
_LETTER = re.compile(f"[{_LETTERS}]")
_CODECS: dict[str, Codec] = {}


class Codec:
    """A worker's encoder and decoder for one model, with the units it has met."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece
        self.model = parse_model(data)
        self.full = build_tokenizer(self.model)
        self.bare = build_tokenizer(self.model, normalize=False)
        self.check = sentencepiece.SentencePieceProcessor(model_proto=data)
        usable = [p for p, _, t in self.model.pieces if t in (NORMAL, USER_DEFINED, UNUSED)]
        whole = all(len(_UNIT.findall(p)) == 1 for p in usable)
        plain = self.model.escape_spaces and self.model.dummy_prefix and self.model.byte_fallback
        self.by_unit = whole and plain and not any(t == USER_DEFINED for _, _, t in self.model.pieces)
        self.as_bytes = [bytes([int(p[3:5], 16)]) if t == BYTE else p.encode() for p, _, t in self.model.pieces]
        #: What stands before a unit without marker when SentencePiece encodes it, and its ids.
        self.guards = {guard: self.check.encode(guard) for guard in ("x", ".")}
        self.known: dict[str, bytes] = {}
        #: Units on which the libraries differ, and units that their ids do not spell.
        self.differing: set[str] = set()
        self.misspelled: set[str] = set()

    def normalized(self, text: str) -> str:
        return self.full.normalizer.normalize_str(text)

    def _spelled(self, ids: list[int]) -> str:
        return b"".join([self.as_bytes[i] for i in ids]).decode("utf-8", "replace")

    def _checked(self, units: list[str]) -> list[list[int]]:
        """SentencePiece's ids of units, each encoded on its own."""
        guards = ["" if u[0] == MARK and u.strip(MARK) else "." if _LETTER.match(u) else "x" for u in units]
        plain = [(g + u if g else u[1:]).replace(MARK, " ") for u, g in zip(units, guards, strict=True)]
        found = self.check.encode(plain, num_threads=1)
        return [ids[len(self.guards[g]) :] if g else ids for ids, g in zip(found, guards, strict=True)]

    def _learn(self, units: list[str]) -> None:
        mine = [e.ids for e in self.bare.encode_batch_fast(units, add_special_tokens=False)]
        theirs = self._checked(units)
        for unit, a, b in zip(units, mine, theirs, strict=True):
            self.known[unit] = array("i", b).tobytes()
            if a != b:
                self.differing.add(unit)
            if self._spelled(b) != unit:
                self.misspelled.add(unit)

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[bytes, bool, bool]]:
        """Per text: packed ids, whether both libraries agree, whether the ids spell the normalised text."""
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size > GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[tuple[bytes, bool, bool]]:
        """The same for some texts together, whose new units make one batch for the library's threads."""
        identity = self.model.dummy_prefix and self.model.escape_spaces and not self.model.strip_spaces and not self.model.char_map
        marked = [(MARK + t.replace(" ", MARK) if identity else self.normalized(t)) if t else "" for t in texts]
        units = [_UNIT.findall(m) if self.by_unit and m.startswith(MARK) else None for m in marked]
        known = self.known
        new = list({u for parts in units if parts for u in parts if u not in known})
        room = max(0, KEPT_UNITS - len(known))
        if new:
            self._learn(new)
        for text, shown, parts in zip(texts, marked, units, strict=True):
            if not shown:
                yield b"", True, True
            elif parts is None:
                mine = self.full.encode(text, add_special_tokens=False).ids
                theirs = self.check.encode(text)
                yield array("i", theirs).tobytes(), mine == theirs, self._spelled(theirs) == shown
            else:
                same = not self.differing or self.differing.isdisjoint(parts)
                spelled = not self.misspelled or self.misspelled.isdisjoint(parts)
                yield b"".join([known[u] for u in parts]), same, spelled
        for unit in new[room:]:
            del known[unit]


def codec(path: str) -> Codec:
    if path not in _CODECS:
        with open(path, "rb") as file:
            _CODECS[path] = Codec(file.read())
    return _CODECS[path]


def encode(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids array<int>): the token ids of each text; null for a null text."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = codec(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [None if t is None else np.frombuffer(x[0], "<i4") for t, x in zip(texts, worker.encode(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    columns = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("_text"))
    return columns.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, ids array<int>")


def decode(df: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows (key, text): texts of token id arrays; null for a null array."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = codec(model_path)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            texts = worker.full.decode_batch([r or [] for r in rows], skip_special_tokens=False)
            texts = [None if r is None else t for r, t in zip(rows, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    columns = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{ids}`").alias("_ids"))
    return columns.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, text string")


def encode_digest(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text: n_tokens, SHA-256 of the ids (little-endian 32-bit), whether both libraries agree, whether the ids spell the normalised text.

    A null text counts as empty.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = codec(model_path)
        for batch in batches:
            made = list(worker.encode(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(ids) // 4 for ids, _, _ in made], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids, _, _ in made], pa.string()),
                    pa.array([same for _, same, _ in made], pa.bool_()),
                    pa.array([spelled for _, _, spelled in made], pa.bool_()),
                ],
                names=[key, "n_tokens", "ids_sha256", "parity", "round_trip"],
            )

    columns = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = dict(df.dtypes)[key]
    return columns.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, parity boolean, round_trip boolean")
