"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query of this subpackage and, where SQL can express it, its cross-check."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_columns(df: DataFrame, new: dict[str, Column], keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with ``new`` columns last; an input column with the name of a new one gives way to it."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    return df.select(*[F.col(f"`{c}`") for c in kept], *[v.alias(k) for k, v in new.items()])


def most_frequent(counts: DataFrame, n: str, limit: int) -> DataFrame:
    """Rows of ``counts`` above the smallest count that at most ``limit`` rows exceed.

    Only the numbers of rows per count go to the driver, not a candidate list
    from every partition. Rows that tie at the cut are all left out.
    """
    cuts = counts.groupBy(n).agg(F.count("*").alias("_rows")).toArrow()
    values, rows = (cuts.column(c).to_numpy() for c in (n, "_rows"))
    order = np.argsort(-values)
    over = np.flatnonzero(np.cumsum(rows[order]) > limit)
    return counts.filter(F.col(n) > int(values[order][over[0]] if len(over) else 0))


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python once per application, so that functions go by reference and workers keep their caches."""
    context = spark.sparkContext
    if getattr(context, "_docsentry_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="docsentry-")  # read by the driver alone; Spark serves the file to executors
    archive = os.path.join(folder, "docsentry_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "docsentry").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(archive)
    context._docsentry_shipped = True
