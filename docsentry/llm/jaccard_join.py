"""Similarity join of texts on shingle sets by several global orders, and its components.

Two sets link when 100 * |intersection| >= 80 * |union|. Under any global order
of shingles, two such sets share a shingle among the first n - ceil(0.8 n) + 1
of each. One order ranks rare shingles before common ones and makes the
candidates; further orders, by independent hashes, give further prefixes, and
a pair is verified only if its prefixes meet under every order.

What comes out is the class of each document, so pairs are sought only as far
as they can join classes:

1. Documents with equal sets are one node; a task sends each set once.
2. Every prefix shingle is a bucket of sets. Its centre is the set with the
   largest share of common shingles, as an original has among its edited
   copies. Every set is held against the centres of its buckets, and once
   more, where classes still differ, against the set of most links there.
3. Within buckets whose sets are then still of different classes, all pairs
   of different classes are candidates.

Before sets are fetched, a pair's shared prefix shingles are counted under the
first order; pairs with too few for a link end there.

A class that no link joins after 3 has no link to any other, so classes are
exact. Large groups of copies end in step 2 with one pair a member; step 3 has
the pairs of rare shingles only, since common ones come last in the order.

Which shingles are common is counted over all documents, in groups of some
million shingles at a time; the ``COMMON_SHINGLES`` most frequent are
broadcast (at most). The order decides how many candidates there are, not which links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsentry.session import materialize

from .common import most_frequent, ship_package
from .components import components
from .shingles import Shingler, mixed, set_id

PERCENT = 80
COMMON_SHINGLES = 500_000
#: Further global orders, by the salt of their hash.
ORDERS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
_GROUP_SHINGLES = 3_000_000
_BITS = 1 << 24
_SENT_SETS = 200_000
_SLICE_ROWS = 1000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some rows, so that the sets of a part, and not of a batch, are in memory at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE_ROWS):
            yield batch.slice(at, _SLICE_ROWS)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets link; prefixes under the further orders are met first."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    for salt in ORDERS:
        x, y = mixed(a ^ np.uint64(salt)), mixed(b ^ np.uint64(salt))
        p, q = prefix_length(len(a), percent), prefix_length(len(b), percent)
        if not len(np.intersect1d(np.partition(x, p - 1)[:p], np.partition(y, q - 1)[:q], assume_unique=True)):
            return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def document_sets(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: (doc_id, n, set_id) per document, and (shingle, seen) for shingles met more than once in a group of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        held: list[np.ndarray] = []
        size = 0

        def common() -> tuple[np.ndarray, np.ndarray]:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return values[counts > 1], counts[counts > 1]

        for batch in _slices(batches):
            n, ids = [], []
            values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for shingles in shingler.all_of(batch.column(1).to_pylist()):
                n.append(len(shingles))
                ids.append(set_id(shingles) if len(shingles) else None)
                held.append(shingles)
                size += len(shingles)
                if size > _GROUP_SHINGLES:
                    v, c = common()
                    values, counts, held, size = np.concatenate([values, v]), np.concatenate([counts, c]), [], 0
            yield _two_kinds(batch.column(0), n, ids, values, counts)
        if held:
            yield _two_kinds(pa.array([], pa.int64()), [], [], *common())

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(run, "is_doc boolean, doc_id long, n long, set_id long, shingle long, seen long")


def _two_kinds(doc_ids: pa.Array, n: list[int], ids: list[int | None], values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    docs, others = len(doc_ids), len(values)
    empty = pa.nulls(others, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([True] * docs + [False] * others, pa.bool_()),
            pa.concat_arrays([doc_ids.cast(pa.int64()), empty]),
            pa.concat_arrays([pa.array(n, pa.int64()), empty]),
            pa.concat_arrays([pa.array(ids, pa.int64()), empty]),
            pa.concat_arrays([pa.nulls(docs, pa.int64()), pa.array(values.view(np.int64))]),
            pa.concat_arrays([pa.nulls(docs, pa.int64()), pa.array(counts.astype(np.int64))]),
        ],
        names=["is_doc", "doc_id", "n", "set_id", "shingle", "seen"],
    )


def prefixes(docs: DataFrame, shared: Broadcast, percent: int = PERCENT) -> DataFrame:
    """Rows (shingle, set_id, n, rare): the prefix of each distinct set under the first order; rare: per mille of shingles that are not common.

    ``shared`` holds common shingles by value and their ranks by frequency,
    rarest first. A task sends a set once, as far as it remembers the sets it has sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ranks = shared.value
        shingler = Shingler()
        sent: set[int] = set()
        for batch in _slices(batches):
            out: list[tuple[np.ndarray, int, int, int]] = []
            for shingles in shingler.all_of(batch.column(0).to_pylist()):
                n = len(shingles)
                if not n:
                    continue
                own = set_id(shingles)
                if own in sent:
                    continue
                if len(sent) < _SENT_SETS:
                    sent.add(own)
                length = prefix_length(n, percent)
                at = np.minimum(np.searchsorted(values, shingles), max(0, len(values) - 1))
                is_common = values[at] == shingles if len(values) else np.zeros(n, bool)
                rare = shingles[~is_common]
                prefix = rare[:length]
                if len(prefix) < length:
                    rest = shingles[is_common]
                    prefix = np.concatenate([prefix, rest[np.argsort(ranks[at[is_common]])][: length - len(prefix)]])
                out.append((prefix, own, n, 1000 * len(rare) // n))
            if out:
                lengths = [len(p) for p, _, _, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([p for p, _, _, _ in out]).view(np.int64)),
                        *[pa.array(np.repeat(np.array([o[i] for o in out], np.int64), lengths)) for i in (1, 2, 3)],
                    ],
                    names=["shingle", "set_id", "n", "rare"],
                )

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "shingle long, set_id long, n long, rare long")


def full_sets(docs: DataFrame, wanted: DataFrame, name: str = "jaccard-sets") -> DataFrame:
    """Rows (set_id, shingles binary), written, of the documents in ``wanted`` (doc_id), one document for each set.

    Sets are worked out from the texts again. A bit table of fixed size says
    which documents send theirs, so nothing is shuffled; the few others that
    share a bit send a set that no pair asks for, or a second copy of one.
    """
    spark = docs.sparkSession
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(_BITS))
    words = wanted.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    table = np.zeros(_BITS // 64, np.int64)
    found = words.toArrow()  # a row per word of the table at most
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(table.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        shingler = Shingler()
        for batch in _slices(batches):
            places = batch.column(0).to_numpy(zero_copy_only=False)
            asked = (bits[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
            texts = batch.column(1).filter(pa.array(asked.astype(bool))).to_pylist()
            sets = [x for x in shingler.all_of(texts) if len(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["set_id", "shingles"]
            )

    sets = materialize(docs.select(slot.alias("slot"), F.col("text").cast("string")).mapInArrow(run, "set_id long, shingles binary"), name)
    shared.destroy()
    return sets


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(left, right, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("_x")), "a")
    second = first.join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("_y")), "b")
    return second.select("a", "b", "_x", "_y").mapInArrow(run, "a long, b long")


def promising(pairs: DataFrame, index: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose prefixes share enough shingles for a link."""
    own = index.select("shingle", F.col("set_id").alias("a"), F.col("n").alias("n_a"))
    others = index.select("shingle", F.col("set_id").alias("b"), F.col("n").alias("n_b"))
    return enough(pairs.select("a", "b").join(own, "a").join(others, ["b", "shingle"]), percent)


def enough(shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) with enough rows in ``shared`` (a, b, n_a, n_b), one for each prefix shingle that two sets share.

    A set shares with another what their prefixes share, and at most all it has
    besides its prefix. A link needs 80 of 180 parts of both sizes in common.
    """
    needed = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    least = F.least(*[needed - F.ceil(percent * F.col(n) / 100) + 1 for n in ("n_a", "n_b")])
    return shared.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least).select("a", "b")


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (shingle, set_id, n, label) of the buckets that hold sets of several classes; a set without links is its own class."""
    labelled = members.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    labelled = materialize(labelled.select("shingle", "set_id", "n", F.coalesce("label", "set_id").alias("label")), "jaccard-members")
    several = labelled.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("shingle")
    return materialize(labelled.join(several, "shingle", "left_semi"), "jaccard-open")


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id): each document with the smallest doc_id that links reach from it, its own included.

    Only doc_id and text are read. Null, empty and wordless texts have no
    shingles and link with nothing. Repeated rows are documents of equal sets.
    """
    ship_package(docs.sparkSession)
    rows = materialize(document_sets(docs), "jaccard-documents")
    documents = rows.filter("is_doc").select("doc_id", "n", "set_id")
    counted = materialize(rows.filter("not is_doc").groupBy("shingle").agg(F.sum("seen").alias("seen")), "jaccard-common")
    top = most_frequent(counted, "seen", COMMON_SHINGLES).toArrow()  # 16 bytes a shingle
    shingles, seen = (top.column(c).to_numpy() for c in ("shingle", "seen"))
    common = shingles[np.lexsort((shingles, seen))].view(np.uint64)

    by_value = np.argsort(common)
    ranks = docs.sparkSession.sparkContext.broadcast((common[by_value], by_value.astype(np.int64)))
    # buckets: prefix shingles that at least two different sets share, each with its centre
    bucket = Window.partitionBy("shingle")
    dealt = prefixes(docs, ranks, percent).select(
        "shingle",
        "set_id",
        "n",
        F.min(F.struct("rare", "n", "set_id")).over(bucket).alias("centre"),
        F.min("set_id").over(bucket).alias("low"),
        F.max("set_id").over(bucket).alias("high"),
    )
    index = dealt.filter("low != high").select("shingle", "set_id", "n", F.col("centre.set_id").alias("centre"), F.col("centre.n").alias("centre_n"))
    # a set whose neighbours by size in a bucket are too small and too large for a link has no partner there
    by_size = Window.partitionBy("shingle").orderBy("n", "set_id")
    near = (100 * F.lag("n").over(by_size) >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.lead("n").over(by_size))
    again = F.coalesce(F.lag("set_id").over(by_size) == F.col("set_id"), F.lit(False))  # several tasks may have sent a set
    index = index.select("*", near.alias("near"), again.alias("again")).filter("near AND NOT again").drop("near", "again")
    index = materialize(index, "jaccard-index")
    ranks.destroy()

    first_doc = materialize(documents.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc")), "jaccard-first-documents")

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that link, written; sets are fetched for these pairs only."""
        kept = materialize(pairs, f"jaccard-{name}-pairs")
        if kept.isEmpty():
            return kept
        ends = kept.select(F.col("a").alias("set_id")).union(kept.select(F.col("b").alias("set_id")))
        wanted = first_doc.join(ends, "set_id", "left_semi").select(F.col("doc").alias("doc_id"))
        sets = full_sets(docs, wanted, f"jaccard-{name}-sets")
        return materialize(verified(kept, sets, percent), f"jaccard-{name}-links")

    def alike(x: str, y: str) -> Column:
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    centred = index.filter((F.col("set_id") != F.col("centre")) & alike("n", "centre_n")).select(F.col("set_id").alias("a"), F.col("centre").alias("b"))
    links = links_of(promising(centred.distinct(), index, percent), "first")
    labels = components(links, "jaccard-first")
    members = open_members(index.select("shingle", "set_id", "n"), labels)

    # once more with the set of most links as the centre of each bucket that still holds several classes
    degrees = links.select(F.col("a").alias("set_id")).union(links.select(F.col("b").alias("set_id"))).groupBy("set_id").agg(F.count("*").alias("links"))
    ranked = members.join(degrees, "set_id", "left").select("*", F.struct(F.coalesce("links", F.lit(0)).alias("links"), "set_id", "n", "label").alias("own"))
    hubs = materialize(ranked.groupBy("shingle").agg(F.max("own").alias("hub")), "jaccard-hubs")
    met = members.join(hubs, "shingle").filter((F.col("label") != F.col("hub.label")) & alike("n", "hub.n"))
    links = materialize(links.union(links_of(promising(met.select(F.col("set_id").alias("a"), F.col("hub.set_id").alias("b")).distinct(), index, percent), "second")), "jaccard-links")
    labels = components(links, "jaccard-second")

    # what is left of different classes within a bucket
    members = open_members(members.select("shingle", "set_id", "n"), labels)
    x, y = members.alias("x"), members.alias("y")
    other = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.set_id") < F.col("y.set_id")) & (F.col("x.label") != F.col("y.label")) & alike("x.n", "y.n")
    # sets of different classes share open buckets only, so this join has all that their prefixes share
    shared = x.join(y, other).select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
    links = links.union(links_of(enough(shared, percent), "last"))
    labels = components(links, "jaccard-all")

    classed = first_doc.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "doc", F.coalesce("label", "set_id").alias("label"))
    classed = materialize(classed, "jaccard-classes")
    smallest = materialize(classed.groupBy("label").agg(F.min("doc").alias("component_id")), "jaccard-smallest")
    of_set = materialize(classed.join(smallest, "label").select("set_id", "component_id"), "jaccard-components")
    return documents.join(of_set, "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
