"""Byte-level BPE ids of whole texts, those of the ``tokenizers`` library for a vocabulary file of its kind.

The library's own encoder is too slow for a corpus whose words seldom repeat.
A byte-level vocabulary numbers its merged tokens in the order of the merges,
so the file's tokens, as bytes with their ids, are the ranks that ``tiktoken``
merges by; that engine gives the same ids in half the time and without a
store of words. It takes texts of Latin letters, where both libraries' character
classes are the same; any other text, and any that spells a special token,
goes to the ``tokenizers`` library. A vocabulary whose ids are no ranks is
left to that library altogether.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

# Fixed value: the pattern that cuts text into pieces before the merges of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Anything but white space, printable ASCII, Latin letters and common punctuation.
_UNUSUAL = re.compile("[^\t\n\r -~¡-ɏ‐-•…€]")
_ENCODERS: dict[str, ByteEncoder] = {}


def _byte_characters() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: its own where it is printable, else one from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {chr(b) if b in printable else chr(next(others)): b for b in range(256)}


def _ranks(file: dict) -> dict[bytes, int] | None:
    """Tokens as bytes with their ids; None where ids do not follow the merges."""
    model, as_byte = file["model"], _byte_characters()
    added = {t["content"] for t in file.get("added_tokens", [])}
    cut = file.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not file.get("normalizer")
    if not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in added}
    merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if merged != sorted(merged) or len(vocabulary) != 256 + len(merged):
        return None
    return {bytes(as_byte[c] for c in t): i for t, i in vocabulary.items()}


class ByteEncoder:
    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        with open(path, encoding="utf-8") as file:
            ranks = _ranks(json.load(file))
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.quick = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Packed ids of each text; a null text is empty."""
        for text in texts:
            if not text:
                yield b""
            elif self.quick is None or _UNUSUAL.search(text) or (self.special and self.special.search(text)):
                yield array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                yield array(self.code, self.quick.encode_ordinary(text)).tobytes()


def encoder(path: str) -> ByteEncoder:
    """The worker's encoder for a vocabulary file; kept between batches and tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]
