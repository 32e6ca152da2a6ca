"""Masked byte strings found in contents by fixed grams, for few strings.

Pickled by value, so that executors need no copy of the package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SLICE = 1 << 20
_COMPARED = 1 << 22
_BITS = 16
_ODD = np.uint32(0x9E3779B1)


class AnchoredStrings:
    """Strings (hex mask with ``_`` for a half byte, place of the gram, gram), looked up at every byte of a buffer of contents.

    A small table of hashed grams turns most bytes away; a string is compared,
    half byte by half byte, only where its gram stands.
    """

    def __init__(self, strings: Sequence[tuple[str, int, bytes]]) -> None:
        usable = [(i, mask, place, gram) for i, (mask, place, gram) in enumerate(strings) if len(mask) % 2 == 0 and set(mask) <= set("0123456789ABCDEF_")]
        self.number = np.array([i for i, *_ in usable], np.int64)
        self.place = np.array([p for _, _, p, _ in usable], np.int64)
        self.size = np.array([len(m) // 2 for _, m, _, _ in usable], np.int64)
        self.value = [np.frombuffer(bytes.fromhex(m.replace("_", "0")), np.uint8) for _, m, _, _ in usable]
        self.care = [np.frombuffer(bytes.fromhex("".join("0" if c == "_" else "F" for c in m)), np.uint8) for _, m, _, _ in usable]
        self.by_width = {}
        for width in sorted({len(g) for *_, g in usable}):
            at = np.array([i for i, (*_, g) in enumerate(usable) if len(g) == width], np.int64)
            grams = np.array([int.from_bytes(usable[i][3], "little") for i in at], np.uint32)
            order = np.argsort(grams, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[self._hash(grams)] = True
            self.by_width[width] = at[order], grams[order], seen

    @staticmethod
    def _hash(grams: np.ndarray) -> np.ndarray:
        return (grams * _ODD) >> np.uint32(32 - _BITS)

    def find(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(content, string, offset in the content) of all places in ``data``, where content i lies between bounds i and i + 1."""
        for low in range(int(bounds[0]), int(bounds[-1]), _SLICE):
            high = min(low + _SLICE, int(bounds[-1]))
            for width, (strings, grams, seen) in self.by_width.items():
                end = min(high, int(bounds[-1]) - width + 1)
                if end <= low:
                    continue
                found = np.zeros(end - low, np.uint32)
                for byte in range(width):
                    found |= data[low + byte : end + byte].astype(np.uint32) << np.uint32(8 * byte)
                at = np.flatnonzero(seen[self._hash(found)])
                first, last = (np.searchsorted(grams, found[at], side) for side in ("left", "right"))
                met = last > first
                at, first, times = at[met] + low, first[met], (last - first)[met]
                content = np.searchsorted(bounds, at, "right") - 1
                ends = np.cumsum(times)
                total = int(ends[-1]) if len(ends) else 0
                for begin in range(0, total, _COMPARED):
                    pair = np.arange(begin, min(begin + _COMPARED, total))
                    hit = np.searchsorted(ends, pair, "right")
                    string = strings[first[hit] + pair - (ends - times)[hit]]
                    yield self._compared(data, bounds, content[hit], string, at[hit] - self.place[string])

    def _compared(self, data: np.ndarray, bounds: np.ndarray, content: np.ndarray, string: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = (start >= bounds[content]) & (start + self.size[string] <= bounds[content + 1])
        content, string, start = content[inside], string[inside], start[inside]
        order = np.argsort(string, kind="stable")
        content, string, start = content[order], string[order], start[order]
        edges = np.append(np.flatnonzero(np.diff(string, prepend=-1)), len(string))
        kept = [np.zeros(0, np.int64)]
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            one = string[low]
            left = np.arange(low, high)
            for byte in np.flatnonzero(self.care[one]):
                left = left[(data[start[left] + byte] & self.care[one][byte]) == self.value[one][byte]]
            kept.append(left)
        left = np.concatenate(kept)
        return content[left], self.number[string[left]], start[left] - bounds[content[left]]
