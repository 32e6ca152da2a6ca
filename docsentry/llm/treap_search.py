"""Ranked lexical search by K2-treaps over the term-document grid.

The documents of a task are taken in blocks. In a block, terms are the rows of
a grid and documents its columns; a cell holds the impact of a term on a
document, which depends on the term's occurrences, the document's length and
the corpus's mean length, and not on the item. A quadtree over the grid keeps
for each occupied cell which quarters are occupied (four bits) and the largest
impact below, as the difference to its parent's, in byte planes of one
zstandard frame a level. Rows are ordered by falling frequency, so dense rows
lie together and share cells. Where terms outnumber documents, the grid is a
column of square bands, each with a root of its own.

An item's terms are rows. Within a range of documents, each of them stands at
one cell of its row's path, and the weighted sum of these cells' maxima bounds
every score in the range. Ranges are opened best bound first, all paths going
down together, a batch of ranges at a time; the search of a block ends when no
bound reaches the lowest of the ``k`` best scores, those of the blocks before
it in the same task included. Nothing is approximate.

Index rows stay where their documents were read. Items meet the index in joins
on terms and on blocks, in packs of bounded size; nothing is broadcast that
grows with documents or items.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsentry.session import materialize

from .common import ship_package

#: Terms are maximal runs of anything but ASCII control, space and punctuation; A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
TOP = 50
BLOCK_DOCS = 16384
BLOCK_BYTES = 16_000_000
PACK_ITEMS = 256
#: Items of one task whose best scores are remembered from block to block.
KEPT_ITEMS = 20_000
_BATCH = 256
#: Set bits of a nibble; and by nibble and place, set bits below the place, or -1 where it is not set.
_SET = np.array([bin(x).count("1") for x in range(16)], np.int32)
_BELOW = np.array([bin(x & ((1 << i) - 1)).count("1") if x >> i & 1 else -1 for x in range(16) for i in range(4)], np.int32)


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in order."""
    return text.translate(_LETTERS).split() if text else []


def mean_factor(n: int, documents: int, terms: int) -> int:
    """The length factor m of a document of ``n`` terms."""
    return 100 - 50 + (50 * n * documents) // terms


def impacts(tf: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * factors)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 16-bit numbers with a gap after each."""
    x = x.astype(np.uint64)
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def _pressed(values: np.ndarray, compress) -> bytes:
    """Numbers below 2**31 as byte planes, low bytes first."""
    return compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _expanded(data: bytes, decompress) -> np.ndarray:
    planes = np.frombuffer(decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def build(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, depth: int, compress) -> tuple[list[bytes], list[bytes]]:
    """Occupied quarters of each level above the leaves, and maxima of each level, of a grid of distinct cells.

    Level 0 has one cell for each band of ``2**depth`` rows; every band must
    have a value.
    """
    mask = (1 << depth) - 1
    codes = (rows.astype(np.uint64) >> np.uint64(depth)) << np.uint64(2 * depth) | _spread(rows & mask) << np.uint64(1) | _spread(columns)
    order = np.argsort(codes, kind="stable")
    codes, values = codes[order], values[order].astype(np.int64)
    marks: list[bytes] = []
    maxima: list[bytes] = []
    for _ in range(depth):
        above = codes >> np.uint64(2)
        starts = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
        quarters = np.bitwise_or.reduceat(np.left_shift(1, (codes & np.uint64(3)).astype(np.int64)), starts).astype(np.uint8)
        largest = np.maximum.reduceat(values, starts)
        maxima.append(_pressed(np.repeat(largest, np.diff(np.append(starts, len(values)))) - values, compress))
        even = np.append(quarters, np.zeros(len(quarters) % 2, np.uint8))
        marks.append(compress((even[::2] | even[1::2] << 4).tobytes()))
        codes, values = above[starts], largest
    maxima.append(_pressed(values, compress))
    return marks[::-1], maxima[::-1]


class Treap:
    """A block's quadtrees, opened: per level the quarters, the place of each cell's first child, and the maxima."""

    def __init__(self, marks: list[bytes], maxima: list[bytes], decompress) -> None:
        self.depth = len(marks)
        self.maxima = [_expanded(maxima[0], decompress)]
        self.quarters: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        for level, packed in enumerate(marks):
            both = np.frombuffer(decompress(packed), np.uint8)
            quarters = np.stack([both & 15, both >> 4], axis=1).reshape(-1)[: len(self.maxima[level])]
            children = _SET[quarters]
            self.quarters.append(np.append(quarters, np.uint8(0)))
            self.first.append(np.append(np.cumsum(children, dtype=np.int32) - children, np.int32(0)))
            self.maxima.append(np.repeat(self.maxima[level], children) - _expanded(maxima[level + 1], decompress))
        # a last cell of each level stands for a path that has ended
        self.maxima = [np.append(x, np.int32(0)) for x in self.maxima]

    def top(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of at least ``least`` that can be among the ``k`` best, ties at the last included, in no order.

        A score is the sum of weight times cell over ``rows``.
        """
        depth = self.depth
        # a path's cell in each range, the last cell of a level where it has ended
        places = (rows >> depth)[None, :]
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * (depth + 1)
        best: list[int] = [-1] * (depth + 1)

        def add(level: int, columns: np.ndarray, paths: np.ndarray) -> None:
            bounds = self.maxima[level].take(paths).astype(np.int64) @ weights
            keep = bounds >= least
            if not keep.any():
                return
            new = (bounds[keep], columns[keep], paths[keep])
            old = waiting[level]
            waiting[level] = new if old is None else tuple(np.concatenate(x) for x in zip(old, new, strict=True))  # type: ignore[assignment]
            best[level] = max(best[level], int(new[0].max()))

        add(0, np.zeros(1, np.int64), places)
        found_columns, found_scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while (top := max(best)) >= least:
            level = best.index(top)
            bounds, columns, paths = waiting[level]  # type: ignore[misc]
            if level == depth:  # a single document: the bound is its score
                found_columns, found_scores = [np.concatenate([*found_columns, columns])], [np.concatenate([*found_scores, bounds])]
                if len(found_scores[0]) >= k:
                    least = max(least, int(np.partition(found_scores[0], -k)[-k]))
                    stay = found_scores[0] >= least
                    found_columns, found_scores = [found_columns[0][stay]], [found_scores[0][stay]]
                waiting[level], best[level] = None, -1
                continue
            if len(bounds) > _BATCH:
                order = np.argpartition(bounds, -_BATCH)
                now, later = order[-_BATCH:], order[:-_BATCH]
                later = later[bounds[later] >= least]
                waiting[level] = (bounds[later], columns[later], paths[later]) if len(later) else None
                best[level] = int(bounds[later].max()) if len(later) else -1
                columns, paths = columns[now], paths[now]
            else:
                waiting[level], best[level] = None, -1
            marks, base, nothing = self.quarters[level].take(paths).astype(np.int32) * 4, self.first[level].take(paths), len(self.maxima[level + 1]) - 1
            low_row = (((rows >> (depth - 1 - level)) & 1) * 2).astype(np.int32)
            for side in (0, 1):
                below = _BELOW.take(marks + (low_row + side))
                add(level + 1, columns * 2 + side, np.where(below >= 0, base + below, nothing))
        return found_columns[0], found_scores[0]


class Block(NamedTuple):
    doc_ids: list[int | None]
    terms: list[str]
    df: list[int]
    depth: int
    marks: list[bytes]
    maxima: list[bytes]


def block_of(doc_ids: list[int | None], terms: list[bytes], ids: list[np.ndarray], documents: int, total: int, compress) -> Block:
    """Index of one block; ``ids`` has the numbers of each document's terms in ``terms``."""
    depth = max(1, (len(ids) - 1).bit_length())
    lengths = np.array([len(x) for x in ids], np.int64)
    pairs = np.concatenate(ids).astype(np.int64) << depth | np.repeat(np.arange(len(ids), dtype=np.int64), lengths)
    pairs, tf = np.unique(pairs, return_counts=True)
    rows, columns = pairs >> depth, pairs & ((1 << depth) - 1)
    df = np.bincount(rows, minlength=len(terms))
    order = np.argsort(-df, kind="stable")
    place = np.empty(len(terms), np.int64)
    place[order] = np.arange(len(terms))
    factors = np.array([mean_factor(int(n), documents, total) for n in lengths], np.int64)
    marks, maxima = build(place[rows], columns, impacts(tf.astype(np.int64), factors[columns]), depth, compress)
    return Block(doc_ids, [terms[i].decode("utf-8", "replace") for i in order.tolist()], df[order].tolist(), depth, marks, maxima)


INDEX = "block long, doc_ids array<long>, terms array<string>, df array<int>, depth int, marks array<binary>, maxima array<binary>"


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, terms = 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n = len(terms_of(text))
                documents, terms = documents + (n > 0), terms + n
        yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([terms], pa.int64())], names=["documents", "terms"])

    ship_package(docs.sparkSession)
    counted = docs.select(F.col("text").cast("string").cast("binary")).mapInArrow(run, "documents long, terms long")
    row = counted.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def index(docs: DataFrame, documents: int, total: int, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows ``INDEX``, one for each block of documents (doc_id, text); those without a term are in none."""
    if not 1 <= block_docs <= 1 << 16:
        raise ValueError("a block has 1 to 65536 documents")
    ship_package(docs.sparkSession)
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        number = TaskContext.get().partitionId() << 32  # type: ignore[union-attr]
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        size = 0

        def fresh() -> defaultdict[bytes, int]:
            numbers: defaultdict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            return numbers

        numbers = fresh()

        def emit() -> pa.RecordBatch:
            block = block_of(doc_ids, list(numbers), ids, documents, total, compress)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([block.doc_ids], pa.list_(pa.int64())),
                    pa.array([block.terms], pa.list_(pa.string())),
                    pa.array([block.df], pa.list_(pa.int32())),
                    pa.array([block.depth], pa.int32()),
                    pa.array([block.marks], pa.list_(pa.binary())),
                    pa.array([block.maxima], pa.list_(pa.binary())),
                ],
                names=names,
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                if ids and (len(ids) >= block_docs or size + len(text) > block_bytes):
                    yield emit()
                    number, doc_ids, ids, size, numbers = number + 1, [], [], 0, fresh()
                ids.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                doc_ids.append(doc_id)
                size += len(text)
        if ids:
            yield emit()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item, term) of ``items`` (item_id, text); rows of one item_id are one item, a null one too."""
    text = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select(F.col("item_id").alias("item"), F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def search(indexed: DataFrame, items: DataFrame, documents: int, k: int = TOP, pack_items: int = PACK_ITEMS) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score.

    ``indexed`` is a written index of ``documents`` documents with a term.
    Equal scores are ranked by doc_id, null last; a document scores above 0
    or is left out.
    """
    asked = materialize(item_terms(items), "treap-items")
    # rows of the index that items ask for, by block
    held = indexed.select("block", F.posexplode(F.arrays_zip("terms", "df")).alias("row", "cell")).select("block", "row", F.col("cell.terms").alias("term"), F.col("cell.df").alias("df"))
    met = materialize(held.join(asked.select("term").distinct(), "term"), "treap-rows")
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.sum("df") + 1))).cast("long")
    weights = met.groupBy("term").agg(weight.alias("weight")).filter("weight > 0")
    packs = max(1, -(-asked.select("item").distinct().count() // pack_items))
    paths = met.join(weights, "term").join(asked, "term").withColumn("pack", F.pmod(F.xxhash64("item"), F.lit(packs)))
    by_item = paths.groupBy("block", "pack", "item").agg(F.collect_list("row").alias("rows"), F.collect_list("weight").alias("weights"))
    by_pack = by_item.groupBy("block", "pack").agg(F.collect_list(F.struct("item", "rows", "weights")).alias("asked"))
    joined = indexed.select("block", "doc_ids", "marks", "maxima").join(by_pack, "block").select("block", "doc_ids", "marks", "maxima", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        kept: dict[int | None, np.ndarray] = {}
        opened: tuple[int, Treap, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column(0)[i].as_py()
                if opened is None or opened[0] != block:  # rows of one block follow each other after a sorted join
                    ids = batch.column(1)[i].as_py()
                    order = np.array([j for j, _ in sorted(enumerate(ids), key=lambda x: (x[1] is None, x[1] or 0))], np.int64)
                    place = np.empty(len(ids), np.int64)
                    place[order] = np.arange(len(ids))
                    opened = (block, Treap(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), decompress), np.array(ids, object), place)
                _, treap, doc_ids, place = opened
                out: list[tuple[int | None, np.ndarray, np.ndarray]] = []
                for asked_ in batch.column(4)[i].as_py():
                    item, rows, own = asked_["item"], np.array(asked_["rows"], np.int64), np.array(asked_["weights"], np.int64)
                    scores_before = kept.get(item)
                    least = int(scores_before[-1]) if scores_before is not None and len(scores_before) == k else 1
                    columns, scores = treap.top(rows, own, k, least)
                    best = np.lexsort((place[columns], -scores))[:k]
                    columns, scores = columns[best], scores[best]
                    if len(scores) and (scores_before is not None or len(kept) < KEPT_ITEMS):
                        both = scores if scores_before is None else np.concatenate([scores_before, scores])
                        kept[item] = -np.sort(-both)[:k]
                    out.append((item, columns, scores))
                sizes = [len(c) for _, c, _ in out]
                found = np.concatenate([c for _, c, _ in out]) if out else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item for (item, _, _), n in zip(out, sizes, strict=True) for _ in range(n)], pa.int64()),
                        pa.array(doc_ids[found].tolist(), pa.int64()),
                        pa.array(np.concatenate([s for _, _, s in out]) if out else np.zeros(0, np.int64), pa.int64()),
                    ],
                    names=["item_id", "doc_id", "score"],
                )

    scored = joined.mapInArrow(run, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES, pack_items: int = PACK_ITEMS) -> DataFrame:
    """``search`` of ``items`` (item_id, text) over all ``docs`` (doc_id, text), the index written once.

    Null, empty and termless texts neither count as documents nor rank; an item
    without terms has no rows. Repeated rows are documents of their own. Other
    columns are ignored.
    """
    documents, total = corpus_size(docs)
    indexed = materialize(index(docs, documents, total, block_docs, block_bytes), "treap-index")
    return search(indexed, items.select(F.col("item_id").cast("long"), "text"), documents, k, pack_items)
