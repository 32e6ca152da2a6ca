"""Fill-in-middle over texts stored as seekable compressed frames.

A text is kept as independent zstandard frames of about ``FRAME_BYTES``, cut
between units (lines) where a unit fits. Every frame knows how many units and
code points begin before it, so a unit is found by a search of these counts and
only the frame that holds it is decompressed.

Moving the middle of a text to its end thus opens two frames at most, those of
the two cuts. All other frames go to the output as they are, in another order;
markers and the parts of cut frames become small frames between them. What
needs the whole text (digests, the rebuilt original) streams the frames in
order and holds one of them at a time.

Units are ``[^\\n]*\\n|[^\\n]+``. Cuts and forms follow from a hash of the key
alone, so any table layout gives the same output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import set_columns, ship_package

FRAME_BYTES = 1 << 16
LEVEL = 3
MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Order of prefix (0), suffix (1) and middle (2) in each form.
ORDERS = {PSM: (0, 1, 2), SPM: (1, 0, 2)}

FRAMES = "array<struct<unit: bigint, char: bigint, begins: boolean, data: binary>>"
OUTPUT = "array<binary>"


class Frame(NamedTuple):
    """unit, char: units and code points that begin before the frame; begins: whether a unit begins with it."""

    unit: int
    char: int
    begins: bool
    data: bytes


def code_points(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def to_frames(text: bytes, compress: Callable[[bytes], bytes], frame_bytes: int = FRAME_BYTES) -> tuple[list[Frame], int, int]:
    """Frames of a UTF-8 text, its units and its code points."""
    frames: list[Frame] = []
    at, unit, char = 0, 0, 0
    while at < len(text):
        end = min(at + frame_bytes, len(text))
        if end < len(text):
            line = text.rfind(b"\n", at, end) + 1
            if line:
                end = line
            else:  # a unit longer than a frame goes on in the next one, whole code points in each
                while end > at + 1 and text[end] & 0xC0 == 0x80:
                    end -= 1
        part, begins = text[at:end], at == 0 or text[at - 1 : at] == b"\n"
        frames.append(Frame(unit, char, begins, compress(part)))
        unit += begins + part.count(b"\n", 0, len(part) - 1)
        char += code_points(part)
        at = end
    return frames, unit, char


class Cut(NamedTuple):
    """A place in a text: frame, byte within it, code points before it."""

    frame: int
    byte: int
    char: int


class Text:
    """A stored text, of which frames are opened one at a time."""

    def __init__(self, frames: Sequence[Frame], n_units: int, n_chars: int, decompress: Callable[[bytes], bytes]) -> None:
        self.frames, self.n_units, self.n_chars, self._decompress = frames, n_units, n_chars, decompress
        self._units = [f.unit for f in frames]
        self.opened: dict[int, bytes] = {}

    def open(self, frame: int) -> bytes:
        if frame not in self.opened:
            self.opened[frame] = self._decompress(self.frames[frame].data)
        return self.opened[frame]

    def cut(self, unit: int) -> Cut:
        """Where unit number ``unit`` begins; the end of the text for the number of units."""
        if unit >= self.n_units:
            return Cut(len(self.frames), 0, self.n_chars)
        # of frames with one count, the last holds the unit's beginning: the others have none
        number = int(np.searchsorted(self._units, unit, side="right")) - 1
        frame = self.frames[number]
        steps = unit - frame.unit + (not frame.begins)
        if not steps:
            return Cut(number, 0, frame.char)
        data, at = self.open(number), 0
        for _ in range(steps):
            at = data.index(b"\n", at) + 1
        return Cut(number, at, frame.char + code_points(data[:at]))

    def between(self, start: Cut, end: Cut) -> Iterator[tuple[bytes, bool]]:
        """Parts of the text in order: whole frames as stored (true), and plain bytes of cut ones (false)."""
        number, byte = start.frame, start.byte
        while (number, byte) < (end.frame, end.byte):
            last = number == end.frame
            if byte or last:
                yield self.open(number)[byte : end.byte if last else None], False
            else:
                yield self.frames[number].data, True
            number, byte = number + 1, 0


def rearranged(text: Text, form: str, first: int, second: int, compress: Callable[[bytes], bytes], markers: Sequence[str] = MARKERS) -> tuple[list[bytes], int | None, int | None]:
    """Output frames of a text cut at units ``first`` and ``second``, and the code points of prefix and middle."""
    if form == PLAIN:
        return [f.data for f in text.frames], None, None
    start, a, b, end = Cut(0, 0, 0), text.cut(first), text.cut(second), Cut(len(text.frames), 0, text.n_chars)
    parts = ((start, a), (b, end), (a, b))
    out: list[bytes] = []
    held: list[bytes] = []
    for part in ORDERS[form]:
        held.append(markers[part].encode())
        for data, whole in text.between(*parts[part]):
            if not whole:
                held.append(data)
                continue
            if held:
                out.append(compress(b"".join(held)))
                held = []
            out.append(data)
    if held:
        out.append(compress(b"".join(held)))
    return out, a.char, b.char - a.char


class _Stream:
    """Bytes of output frames by their place, one frame at a time; the frames' headers give their sizes."""

    def __init__(self, frames: Sequence[bytes], decompress: Callable[[bytes], bytes]) -> None:
        self.frames, self._decompress = frames, decompress
        sizes = [zstandard.frame_content_size(f) for f in frames]
        self.begins = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).tolist()

    def read(self, start: int, end: int) -> Iterator[bytes]:
        number = int(np.searchsorted(self.begins, start, side="right")) - 1
        while number < len(self.frames) and self.begins[number] < end:
            data, base = self._decompress(self.frames[number]), self.begins[number]
            yield data[max(0, start - base) : end - base]
            number += 1


def digests(frames: Sequence[bytes], form: str, decompress: Callable[[bytes], bytes], markers: Sequence[str] = MARKERS) -> tuple[str, str]:
    """SHA-256 of the output, and of the text rebuilt from output and form."""
    stream, names = _Stream(frames, decompress), [m.encode() for m in markers]
    end = stream.begins[-1]
    whole, found, tail, at = hashlib.sha256(), {}, b"", 0
    reach = max(map(len, names)) - 1
    for data in stream.read(0, end):
        whole.update(data)
        if form != PLAIN:
            seen = tail + data
            for name in names:
                place = seen.find(name)
                if place >= 0:
                    found.setdefault(name, at - len(tail) + place)
            tail = seen[-reach:] if reach else b""
        at += len(data)
    if form == PLAIN:
        return whole.hexdigest(), whole.hexdigest()
    in_order = sorted((found[name], name) for name in names)
    ends = [place for place, _ in in_order[1:]] + [end]
    span = {name: (place + len(name), stop) for (place, name), stop in zip(in_order, ends, strict=True)}
    rebuilt = hashlib.sha256()
    for part in (0, 2, 1):  # prefix, middle, suffix
        for data in stream.read(*span[names[part]]):
            rebuilt.update(data)
    return whole.hexdigest(), rebuilt.hexdigest()


def _check(markers: Sequence[str]) -> None:
    if len(set(markers)) != 3 or not all(markers):
        raise ValueError("three different markers are needed")
    for x in markers:
        for y in markers:
            if x is not y and y in x or any(x.endswith(y[:k]) for k in range(1, min(len(x), len(y)))):
                raise ValueError("a marker must not hold or overlap another")


def _mapped(df: DataFrame, keep: Sequence[str], used: Sequence[Column], new: str, fn: Callable[..., Iterator[list[pa.Array]]]) -> DataFrame:
    """Columns ``keep`` as they are and ``new`` ones that ``fn`` makes of the Arrow arrays of ``used``."""
    added = T.StructType.fromDDL(new)
    kept = [c for c in keep if c not in added.names]
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)
    count = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:count], *work(*batch.columns[count:])], names=schema.names)

    ship_package(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(f"_used_{i}") for i, c in enumerate(used)]).mapInArrow(run, schema)


def _binaries(lists: list[list[bytes]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([y for x in lists for y in x], pa.binary()))


def store(docs: DataFrame, keep: Sequence[str] = ("doc_id",), markers: Sequence[str] = MARKERS, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Columns ``keep``, frames, n (units), n_chars and marked (whether the text holds a marker) of every text.

    A null text is an empty one and has no frames. Only ``text`` and ``keep``
    are read; a kept column with the name of a new one gives way to it.
    """
    _check(markers)
    if frame_bytes < 4:
        raise ValueError("a frame must hold a code point")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = F.lit(False)
    for marker in markers:
        marked = marked | text.contains(marker)

    def fn() -> Callable[..., list[pa.Array]]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress

        def work(texts: pa.Array, marks: pa.Array) -> list[pa.Array]:
            made = [to_frames(t, compress, frame_bytes) for t in texts.to_pylist()]
            flat = [f for frames, _, _ in made for f in frames]
            offsets = np.concatenate([[0], np.cumsum([len(frames) for frames, _, _ in made])]).astype(np.int32)
            fields = [
                pa.array([f.unit for f in flat], pa.int64()),
                pa.array([f.char for f in flat], pa.int64()),
                pa.array([f.begins for f in flat], pa.bool_()),
                pa.array([f.data for f in flat], pa.binary()),
            ]
            frames = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=Frame._fields))
            return [frames, pa.array([n for _, n, _ in made], pa.int64()), pa.array([c for _, _, c in made], pa.int64()), marks]

        return work

    return _mapped(docs, keep, [text.cast("binary"), marked], f"frames {FRAMES}, n bigint, n_chars bigint, marked boolean", fn)


def with_cuts(stored: DataFrame, key: str = "doc_id", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """``stored`` with form and the two cuts, ``first`` and ``second``, drawn by four hashes of seed and key.

    ``rate`` per cent of the texts are rearranged, ``spm_rate`` per cent of
    those with the suffix first. Empty texts and texts that hold a marker are
    plain. A null key hashes as an empty one.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    staged = stored.withColumn("_digest", digest)
    h = [F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    cut_a, cut_b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    form = F.when((F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= rate), PLAIN).when(h[3] % 100 < spm_rate, SPM).otherwise(PSM)
    return set_columns(staged, {"form": form, "first": F.least(cut_a, cut_b), "second": F.greatest(cut_a, cut_b)}).drop("_digest")


def rearrange(cut: DataFrame, keep: Sequence[str] = ("doc_id", "n"), markers: Sequence[str] = MARKERS) -> DataFrame:
    """Columns ``keep``, form, prefix_chars, middle_chars (null where plain) and the output as frames, of rows with cuts."""

    def fn() -> Callable[..., list[pa.Array]]:
        compress, decompress = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress

        def work(frames: pa.Array, n: pa.Array, chars: pa.Array, form: pa.Array, first: pa.Array, second: pa.Array) -> list[pa.Array]:
            ends, flat = frames.offsets.to_pylist(), [Frame(*f) for f in zip(*(frames.values.field(i).to_pylist() for i in range(4)), strict=True)]
            made = [
                rearranged(Text(flat[ends[i] : ends[i + 1]], units, n_chars, decompress), kind, a, b, compress, markers)
                for i, (units, n_chars, kind, a, b) in enumerate(zip(*(x.to_pylist() for x in (n, chars, form, first, second)), strict=True))
            ]
            return [form, pa.array([p for _, p, _ in made], pa.int64()), pa.array([m for _, _, m in made], pa.int64()), _binaries([o for o, _, _ in made])]

        return work

    used = [F.col(c) for c in ("frames", "n", "n_chars", "form", "first", "second")]
    return _mapped(cut, keep, used, f"form string, prefix_chars bigint, middle_chars bigint, output {OUTPUT}", fn)


def with_digests(made: DataFrame, markers: Sequence[str] = MARKERS) -> DataFrame:
    """``made`` with output_sha256 and restored_sha256 in place of the output."""

    def fn() -> Callable[..., list[pa.Array]]:
        decompress = zstandard.ZstdDecompressor().decompress

        def work(output: pa.Array, form: pa.Array) -> list[pa.Array]:
            both = [digests(o, f, decompress, markers) for o, f in zip(output.to_pylist(), form.to_pylist(), strict=True)]
            return [pa.array([x for x, _ in both], pa.string()), pa.array([y for _, y in both], pa.string())]

        return work

    keep = [c for c in made.columns if c != "output"]
    return _mapped(made, keep, [F.col("output"), F.col("form")], "output_sha256 string, restored_sha256 string", fn)


def with_text(made: DataFrame) -> DataFrame:
    """``made`` with the output as one string, for training."""

    def fn() -> Callable[..., list[pa.Array]]:
        decompress = zstandard.ZstdDecompressor().decompress
        return lambda output: [pa.array([b"".join(map(decompress, o)).decode("utf-8", "replace") for o in output.to_pylist()], pa.string())]

    return _mapped(made, [c for c in made.columns if c != "output"], [F.col("output")], "output string", fn)
