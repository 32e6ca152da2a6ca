"""Approximate nearest neighbours by adaptive dimension scan over probed lists.

Vectors are dealt to lists by their nearest centre (spherical k-means on a
bounded sample). A query probes its nearest lists. Within a list, vectors are
rotated by one random orthogonal matrix and read in blocks of columns. After
each block a hypothesis test compares the distance so far, scaled to all
dimensions, with the best k distances found: a candidate that is farther with
high confidence is abandoned. What is left at the last block gets its exact
cosine from the original vectors in double precision.

The sample and the number of lists are bounded parameters, so centres are
small enough to broadcast. Lists of any size are cut into chunks, and probes
into packs; a task holds one chunk and one pack.
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

SAMPLE_ROWS = 20_000
MAX_LISTS = 1024
#: Share of the lists a query probes. Nearly uniform vectors need most of them for a recall over 0.9.
PROBED = 0.7
COLUMNS = 16
#: Width of the test, in units of 1 / sqrt(dimensions seen); 2.1 abandons a true neighbour about once in a thousand.
EPSILON = 2.1


def rotation(dimensions: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(11).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def centres_of(sample: np.ndarray, lists: int, turns: int = 10) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(5)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(turns):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # first to a size whose square neither overflows nor vanishes
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scan_list(rotated: np.ndarray, query: np.ndarray, k: int, columns: int = COLUMNS, epsilon: float = EPSILON) -> np.ndarray:
    """Rows of ``rotated`` that survive every test against ``query``.

    The radius of the test is the k-th distance of the rows that look nearest
    so far, computed in full for them, and so never below the true one.
    """
    n, dimensions = rotated.shape
    alive = np.arange(n)
    part = np.zeros(n)
    radius = math.inf
    for start in range(0, dimensions, columns):
        block = rotated[alive, start : start + columns] - query[start : start + columns]
        part = part + np.einsum("ij,ij->i", block, block)
        seen = min(start + columns, dimensions)
        if seen < dimensions and len(alive) > k:
            best = alive[np.argpartition(part, k - 1)[:k]]
            radius = min(radius, float(((rotated[best] - query) ** 2).sum(axis=1).max()))
            keep = part * (dimensions / seen) <= radius * (1 + epsilon / math.sqrt(seen)) ** 2
            alive, part = alive[keep], part[keep]
    return alive


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    lists: int | None = None,
    probed: float = PROBED,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found of every row for which ``is_query`` (over ``key``) holds.

    Score is the cosine; ties go to smaller ids. Null, zero and non-finite
    vectors and rows without id take no part; a row is no neighbour of its own
    id. ``lists`` is by default a quarter of the root of the rows, from 16 to
    ``MAX_LISTS``. Vectors of different lengths raise an error in the job.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = usable(vectors, key, vector).filter(F.exists("vector", lambda x: x != 0))
    total = rows.count()
    n_lists = lists or min(MAX_LISTS, max(16, round(math.sqrt(total) / 4)))
    share = min(1.0, sample_rows / max(1, total))
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    sample = [r["vector"] for r in drawn.select("vector").limit(2 * sample_rows).collect()]
    centres = centres_of(_unit(np.array(sample)), n_lists) if sample else np.ones((1, 1))
    probes = max(1, math.ceil(probed * len(centres)))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = _unit(np.stack(batch["vector"])) @ shared.value.T
                order = np.argsort(-near, axis=1)[:, :probes]
                yield batch.assign(near=list(order.astype(np.int32)))

    placed = rows.select("id", "vector").mapInPandas(assign, "id long, vector array<double>, near array<int>")
    placed = materialize(placed, "scan-lists")
    own = with_chunks(placed.select("id", "vector", F.element_at("near", 1).alias("list")), "list", BLOCK_ROWS, "chunk")
    blocks = packed(own, ["list", "chunk"])
    asked = is_query if isinstance(is_query, Column) else F.expr(is_query)
    queries = placed.withColumnRenamed("id", key).filter(asked).withColumnRenamed(key, "id")
    probing = with_chunks(queries.select("id", "vector", F.explode("near").alias("list")), "list", QUERY_ROWS, "pack")
    packs = packed(probing, ["list", "pack"]).select("list", "pack", F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, asking = np.asarray(row.ids), np.asarray(row.q_ids)
                own_rows, query_rows = matrix(row.flat, len(ids)), matrix(row.q_flat, len(asking))
                unit, query_unit = _unit(own_rows), _unit(query_rows)
                turn = rotation(unit.shape[1])
                rotated, query_rotated = unit @ turn, query_unit @ turn
                found = []
                for i, query in enumerate(asking):
                    alive = scan_list(rotated, query_rotated[i], k + 1)
                    alive = alive[ids[alive] != query]
                    found.append((ids[alive], unit[alive] @ query_unit[i]))
                yield best_rows(list(asking), found, k, np.float64)

    met = packs.join(blocks, "list").select("q_ids", "q_flat", "ids", "flat")
    return ranked(met.mapInPandas(scan, "query_id long, vec_id long, score double"), k)
