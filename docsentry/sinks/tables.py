"""Table sinks. Parquet has no in-place update, so updates return a new snapshot to write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import first_row
from ..sources.corpus import new_content


def rows_to_store(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents not stored yet, keyed by (url, content hash): a rerun adds nothing."""
    return new_content(incoming, stored)


def append_content(incoming: DataFrame, stored: DataFrame | None, path: str, ingest_date: Column) -> None:
    """Idempotent append, partitioned by ingest date."""
    fresh = rows_to_store(incoming, stored) if stored is not None else incoming.withColumn("content_hash", F.sha2("text", 256)).dropDuplicates(["url", "content_hash"])
    fresh.withColumn("ingest_date", ingest_date).write.mode("append").partitionBy("ingest_date").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Append-only log (model performance, feedback, notifications)."""
    df.write.mode("append").parquet(path)


def code_block_rows(parsed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per element of ``code_blocks``."""
    return parsed.select(doc_id, F.posexplode("code_blocks").alias("block_no", "_b")).select(doc_id, "block_no", "_b.*")


def extracted_item_rows(parsed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per url or reference: (item_type, target_value)."""
    item = lambda kind, column: F.transform(F.col(column), lambda v: F.struct(F.lit(kind).alias("item_type"), v.alias("target_value")))
    return parsed.select(doc_id, F.explode(F.concat(item("url", "urls"), item("reference", "references"))).alias("_i")).select(doc_id, "_i.*")


def latest_parsed(processed: DataFrame, blocks: DataFrame, items: DataFrame, key: str = "url") -> DataFrame:
    """Latest parsed form of each URL with its children gathered again.

    The latest version is chosen from ids alone (``max_by`` combines map side).
    A group of children belongs to one document, so it is bounded by that text.
    """
    newest = processed.groupBy(key).agg(F.max_by("doc_id", F.struct("parsed_at", "doc_id")).alias("doc_id"))
    gathered_blocks = blocks.join(newest, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("block_no", "language", "code"))), lambda b: F.struct(b["language"].alias("language"), b["code"].alias("code"))).alias("code_blocks")
    )
    gathered_items = items.join(newest, "doc_id", "left_semi").groupBy("doc_id").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("item_type") == kind, F.col("target_value")))).alias(name) for kind, name in (("url", "urls"), ("reference", "references"))]
    )
    return newest.join(gathered_blocks, "doc_id", "left").join(gathered_items, "doc_id", "left")


def exists(keys: DataFrame, stored: DataFrame, key: str = "url") -> DataFrame:
    """Existence flag per key."""
    known = stored.select(key).distinct().withColumn("_known", F.lit(True))
    return keys.join(known, key, "left").withColumn("exists", F.coalesce("_known", F.lit(False))).drop("_known")


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], updated_at: str = "updated_at") -> DataFrame:
    """Registry upsert: the newest row per key of both sides."""
    return first_row(existing.unionByName(incoming, allowMissingColumns=True), list(keys), F.col(updated_at), latest=True)


def update_likelihoods(findings: DataFrame, results: DataFrame) -> DataFrame:
    """New snapshot of findings with false-positive likelihoods from ``results`` where present."""
    new = results.select("finding_id", F.col("false_positive_likelihood").alias("_new"))
    out = findings.join(new, "finding_id", "left").withColumn("false_positive_likelihood", F.coalesce("_new", "false_positive_likelihood"))
    return out.drop("_new")


def anomaly_findings(results: DataFrame, severity: Column) -> DataFrame:
    """Anomalous results as findings with JSON location and evidence."""
    return results.where("is_anomalous").select(
        "content_id",
        F.lit("ml_anomaly_detection").alias("finding_type"),
        severity.alias("severity"),
        F.lit("ML-based anomaly detection identified suspicious content").alias("description"),
        F.to_json(F.struct("content_id", "url_id")).alias("location"),
        F.to_json(F.struct(F.col("combined_score").alias("anomaly_score"), "confidence", "contributing_factors")).alias("evidence"),
        F.lit(0.0).alias("false_positive_likelihood"),
        F.lit("Review the content for potential security issues").alias("remediation_suggestion"),
    )


def metric_rows(wide: DataFrame, metric_type: str, numeric: Sequence[str] = (), nested: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Wide metrics -> (timestamp, metric_type, metric_name, metric_value, metric_data) rows."""
    entry = lambda name, value, data: F.struct(F.lit(name).alias("metric_name"), value.cast("double").alias("metric_value"), data.cast("string").alias("metric_data"))
    entries = [entry(n, F.col(n), F.lit(None)) for n in numeric] + [entry(n, F.lit(None), F.to_json(n)) for n in nested]
    return wide.select(F.col(ts).alias("timestamp"), F.lit(metric_type).alias("metric_type"), F.inline(F.array(*entries)))


def retain(df: DataFrame, now: Column, days: int = 30, ts: str = "timestamp") -> DataFrame:
    """Rows still inside the retention horizon."""
    return df.where(F.col(ts) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def write_csv_report(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with header. ``single_file`` is for reports of known small size."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)
