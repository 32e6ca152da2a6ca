"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped into buckets of nearly equal length. A query needs, in a
bucket, at least the cosine ``threshold / (query length * longest length)``,
its local threshold, to enter its k best. Where that is over one, the whole
bucket is passed over. Otherwise the bucket is searched in one of two ways:

* low local threshold: *length* pruning; the bucket is sorted by length, and
  the vectors too short to reach the threshold even in the query's direction
  are cut off;
* high local threshold: *coordinate* pruning; the largest coordinates of the
  query bound the same coordinates of every vector that reaches the cosine,
  and only vectors inside all these ranges stay.

The products of what stays are verified in full. Each query's first threshold
comes from one bounded block of long vectors, seen by all queries; it rises
with each bucket. Vectors with the threshold's own product stay, so ties are
complete and the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsentry.session import materialize

from .common import ship_package
from .vector_blocks import BLOCK_ROWS, QUERY_ROWS, best_rows, matrix, packed, ranked, usable, with_chunks

#: Lengths in a bucket differ by this factor at most.
BUCKET_RATIO = 1.05
#: Local thresholds from here on are pruned by coordinates; below, their ranges exclude almost nothing.
COORDINATE_FROM = 0.6
FOCUS = 3
SCALE = 64
#: Vectors of the block that gives first thresholds.
SEED_ROWS = 2048


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, exact: in doubles where every partial sum fits them, in Python integers beyond."""
    largest = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * rows.shape[1]
    if largest < 2**53:
        return (rows @ query).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in rows], dtype=np.int64)


def candidates(unit: np.ndarray, lengths: np.ndarray, query: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of a bucket (sorted by length, longest first) whose product with ``query`` may reach ``threshold``."""
    n = len(lengths)
    size = float(np.linalg.norm(query))
    if not size or not lengths[0]:
        return np.arange(n) if threshold <= 0 else np.arange(0)
    slack = 1e-9  # rounding of lengths and cosines never excludes a vector
    local = threshold / (size * lengths[0]) if threshold > -math.inf else -math.inf
    if local > 1 + slack:
        return np.arange(0)
    if local < COORDINATE_FROM:
        if threshold <= 0:
            return np.arange(n)
        return np.arange(np.searchsorted(-lengths, -threshold / size * (1 - slack), side="right"))
    direction = query / size
    keep = np.arange(n)
    for f in np.argsort(-np.abs(direction))[:FOCUS]:
        q = direction[f]
        spread = math.sqrt(max(0.0, 1 - local * local)) * math.sqrt(max(0.0, 1 - q * q))
        # within the angle of the local threshold around the query; the range is open to a side where the axis itself lies in it
        low = -1.0 if -q >= local else q * local - spread
        high = 1.0 if q >= local else q * local + spread
        value = unit[keep, f]
        keep = keep[(value >= low - slack) & (value <= high + slack)]
    return keep


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k largest integer products of every query row, ties to smaller ids.

    Components are floor(scale * x). Null vectors, vectors with null or
    non-finite components and rows without id take no part; a row is no
    candidate of its own id. Zero vectors do take part.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = usable(vectors, key, vector).select("id", F.transform("vector", lambda x: F.floor(x * scale).cast("double")).alias("vector"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    bucket = F.when(F.col("length") > 0, F.floor(F.log("length") / math.log(BUCKET_RATIO))).otherwise(F.lit(-1)).cast("int")
    rows = rows.withColumn("length", length).withColumn("bucket", bucket)
    rows = materialize(rows, "bucketed-vectors")
    blocks = packed(with_chunks(rows, "bucket", BLOCK_ROWS, "chunk"), ["bucket", "chunk"], -F.col("length"))
    queries = rows.withColumnRenamed("id", key).filter(is_query).withColumnRenamed(key, "id")
    n_packs = max(1, -(-queries.count() // QUERY_ROWS))
    packs = packed(queries.withColumn("pack", F.pmod(F.xxhash64("id", "vector"), F.lit(n_packs)).cast("int")), ["pack"])
    packs = packs.select("pack", F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))
    seeds = rows.orderBy(F.desc("length"), "id").limit(SEED_ROWS).select("id", "vector").collect()
    shared = spark.sparkContext.broadcast((np.array([r["id"] for r in seeds], np.int64), np.array([r["vector"] for r in seeds], float)))

    def first_thresholds(asking: np.ndarray, wanted: np.ndarray) -> list[float]:
        ids, seed = shared.value
        out = []
        for query, row in zip(asking, wanted, strict=True):
            scores = products(seed[ids != query], row)
            out.append(float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -math.inf)
        return out

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, asking = np.asarray(row.ids), np.asarray(row.q_ids)
                own, wanted = matrix(row.flat, len(ids)), matrix(row.q_flat, len(asking))
                lengths = np.linalg.norm(own, axis=1)
                unit = own / np.where(lengths > 0, lengths, 1)[:, None]
                found = []
                for query, vector_, threshold in zip(asking, wanted, first_thresholds(asking, wanted), strict=True):
                    near = candidates(unit, lengths, vector_, threshold)
                    near = near[ids[near] != query]
                    scores = products(own[near], vector_) if len(near) else np.zeros(0, np.int64)
                    reached = scores >= threshold
                    found.append((ids[near][reached], scores[reached]))
                yield best_rows(list(asking), found, k, np.int64)

    # every pack of queries meets every block: each block goes once to each pack's number
    sent = blocks.select("ids", "flat", F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1))).alias("pack"))
    met = sent.join(packs, "pack")
    return ranked(met.select("q_ids", "q_flat", "ids", "flat").mapInPandas(scan, "query_id long, vec_id long, score long"), k)
