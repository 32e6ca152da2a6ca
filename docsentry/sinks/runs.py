"""Tables written in runs that commit once.

The rows of a run are the partition ``run_id=…`` of each of its tables, which a
further try of the run replaces. A run counts when its row in the table of
commits is there; it is written last, after all tables. A run that failed
midway leaves nothing that ``read`` shows, and a run that has committed is not
written again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.scale import broadcast_small
from ..session import materialize
from ..sources.corpus import new_content

COMMITS = "commits"
_COMMIT_ROW = "table_name string, n_rows bigint, run_id string"


def _load(spark: SparkSession, path: str, schema: StructType | str, form: str = "parquet") -> DataFrame:
    """The table at ``path``; without rows where none has been written."""
    reader = spark.read.schema(schema)
    if form == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\\N")
    try:
        return reader.format(form).load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, root: str) -> DataFrame:
    """Commit rows below ``root``: (table_name, n_rows, run_id)."""
    return _load(spark, f"{root}/{COMMITS}", _COMMIT_ROW)


def write(tables: Mapping[str, DataFrame], root: str, run_id: str, form: str = "parquet") -> bool:
    """Writes ``tables`` as one run; false, and nothing written, where the run has committed before.

    ``form`` is parquet or csv (with a header, and a mark for nulls).
    """
    spark = next(iter(tables.values())).sparkSession
    if not committed(spark, root).where(F.col("run_id") == run_id).isEmpty():
        return False
    counts = []
    for name, rows in tables.items():
        writer = rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").format(form)
        if form == "csv":
            writer = writer.option("header", True).option("escape", '"').option("nullValue", "\\N")
        writer.save(f"{root}/{name}")
        written = _load(spark, f"{root}/{name}", _with_run(rows.schema), form)
        counts.append((name, written.where(F.col("run_id") == run_id).count(), run_id))
    commit = spark.createDataFrame(counts, _COMMIT_ROW)
    commit.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{COMMITS}")
    return True


def _with_run(schema: StructType) -> StructType:
    return StructType([*[f for f in schema.fields if f.name != "run_id"], StructField("run_id", StringType())])


def read(spark: SparkSession, root: str, name: str, schema: StructType, form: str = "parquet") -> DataFrame:
    """Rows of the table ``name`` from runs that have committed, with their run_id.

    The commits, one row a run, prune the partitions that are read.
    """
    rows = _load(spark, f"{root}/{name}", _with_run(schema), form)
    done = committed(spark, root).where(F.col("table_name") == name).select("run_id").distinct()
    return rows.join(broadcast_small(done, 100_000), "run_id", "left_semi").select(*[f.name for f in _with_run(schema).fields])


def store_content(incoming: DataFrame, root: str, run_id: str, ingest_date: Column) -> bool:
    """Documents (url, text) not stored yet, by (url, content hash), as one run of the table ``content``."""
    stored = read(incoming.sparkSession, root, "content", content_schema(incoming))
    # a table of its own: the run must not read the table that it writes
    fresh = materialize(new_content(incoming, stored.select("url", "content_hash")), "fresh-content")
    return write({"content": fresh.withColumn("ingest_date", ingest_date)}, root, run_id)


def content_schema(incoming: DataFrame) -> StructType:
    return StructType([*incoming.schema.fields, StructField("content_hash", StringType()), StructField("ingest_date", StringType())])


def run_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows per table over all runs that have committed."""
    return committed(spark, root).groupBy("table_name").agg(F.sum("n_rows").cast(LongType()).alias("n_rows"), F.count("*").alias("n_runs"))
