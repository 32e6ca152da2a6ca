"""Vectors packed into bounded blocks, and the best results per query; shared by the two vector searches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
QUERY_ROWS = 512


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id long, vector array<double>) that can take part: an id, and a vector without null or non-finite components.

    Vectors of any other length than the most frequent one are left to the
    caller; the searches refuse mixed lengths.
    """
    out = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return out.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~bad)


def with_chunks(df: DataFrame, by: str, rows: int, name: str) -> DataFrame:
    """Adds ``name``: a chunk number within the group ``by``, so that a chunk holds about ``rows`` rows whatever the group's size.

    Groups are lists or buckets, some ten thousands at most by their making, so
    their sizes are broadcast and no group meets in one task.
    """
    sizes = df.groupBy(by).agg(F.ceil(F.count("*") / rows).alias("_chunks"))
    return df.join(F.broadcast(sizes), by).withColumn(name, F.pmod(F.xxhash64("id", "vector"), F.col("_chunks")).cast("int")).drop("_chunks")


def packed(df: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """One row per ``keys``: ids and vectors as flat arrays, in the same order."""
    rows = F.collect_list(F.struct(*([order.alias("o")] if order is not None else []), "id", "vector"))
    ordered = F.array_sort(rows)
    return df.groupBy(*keys).agg(ordered.alias("_rows")).select(
        *keys, F.transform("_rows", lambda r: r["id"]).alias("ids"), F.flatten(F.transform("_rows", lambda r: r["vector"])).alias("flat")
    )


def matrix(flat: np.ndarray, n: int) -> np.ndarray:
    return np.asarray(flat, dtype=np.float64).reshape(n, -1)


def best_rows(query_ids: list[int], found: list[tuple[np.ndarray, np.ndarray]], k: int, kind: type) -> pd.DataFrame:
    """The k best (ids, scores) of each query, ties to smaller ids."""
    out = []
    for query, (ids, scores) in zip(query_ids, found, strict=True):
        order = np.lexsort((ids, -scores))[:k]
        out.append(pd.DataFrame({"query_id": np.full(len(order), query, np.int64), "vec_id": ids[order], "score": scores[order].astype(kind)}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query over all blocks; each block has sent k rows a query at most."""
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
