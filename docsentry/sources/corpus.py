"""Corpus scans: joins over stored content, single files, incremental selection, filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stored_corpus(urls: DataFrame, content: DataFrame) -> DataFrame:
    """urls ⋈ fetched text: successful fetches with text, as (url_id, url, text)."""
    ok = content.where((F.col("fetch_status") == "success") & F.col("text_content").isNotNull())
    return urls.join(ok, urls["id"] == ok["url_id"]).select(F.col("id").alias("url_id"), F.col("url"), F.col("text_content").alias("text"))


def processed_urls(urls: DataFrame, processed: DataFrame) -> DataFrame:
    """URLs that have processed content (semi join: no duplicates to remove afterwards)."""
    return urls.join(processed, urls["id"] == processed["url_id"], "left_semi").select("id", "url")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as documents: (source, text). Accepts ``file://`` or any path Spark reads."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text"))


def read_binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as bytes, with their text: (source, content, text)."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("source"), "content", decode_bytes(F.col("content")).alias("text"))


def decode_bytes(content: Column) -> Column:
    """UTF-8 where valid, Latin-1 otherwise (every byte string has a reading)."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def content_items(df: DataFrame, source: Column, text: Column, method: Column, url_id: Column | None = None, retrieved_at: Column | None = None) -> DataFrame:
    """The content-item envelope every later stage reads."""
    item_id = F.concat(F.lit("content-"), F.substring(F.md5(source), 1, 8))
    if url_id is not None:
        item_id = F.coalesce(F.concat(F.lit("db-item-"), url_id.cast("string")), item_id)
    stamp = retrieved_at if retrieved_at is not None else F.current_timestamp()
    return df.select(
        item_id.alias("id"),
        F.lit("markdown").alias("type"),
        source.alias("source"),
        F.lit("markdown").alias("language"),
        text.alias("content"),
        text.alias("raw_content"),
        F.struct(
            F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("timestamp"),
            method.alias("retrieval_method"),
            (url_id if url_id is not None else F.lit(None)).cast("long").alias("db_url_id"),
        ).alias("metadata"),
    )


def lookup(wanted: DataFrame, content: DataFrame, key: str = "url") -> DataFrame:
    """Text per wanted key; null text marks a key that could not be read."""
    return wanted.join(content.select(key, "text"), key, "left")


def validate_items(df: DataFrame, source: str = "source") -> DataFrame:
    """Adds ``processing_error``; bad rows stay in the batch and are told apart by filter."""
    bad = F.col(source).isNull() | (F.col(source) == "")
    return df.withColumn("processing_error", F.when(bad, F.lit("Invalid source")))


def without_errors(df: DataFrame, error: str = "processing_error") -> DataFrame:
    return df.where(F.col(error).isNull())


def new_content(incoming: DataFrame, seen: DataFrame, url: str = "url", text: str = "text") -> DataFrame:
    """Rows whose (url, content hash) is not known yet, one per pair.

    Only the 64-character hash takes part in the anti join; known pairs are
    removed before the text is deduplicated.
    """
    hashed = incoming.withColumn("content_hash", F.sha2(text, 256))
    fresh = hashed.join(seen.select(url, "content_hash").distinct(), [url, "content_hash"], "left_anti")
    return fresh.dropDuplicates([url, "content_hash"])


def filter_corpus(
    df: DataFrame,
    *,
    domain: str | None = None,
    source: str | None = None,
    quality: str | None = None,
    topic: str | None = None,
    purpose: str | None = None,
    topics: DataFrame | None = None,
    purposes: DataFrame | None = None,
    key: str = "url_id",
    combine: str = "and",
) -> DataFrame:
    """domain / source / quality / topic / purpose filters joined with AND or OR.

    Column filters push down to the scan. Ranking filters are semi joins; with
    OR they become flags from a left join, so each document still comes once.
    """
    tests: list[Column] = []
    if domain is not None:
        tests.append(F.lower(F.col("domain")) == domain.lower())
    if source is not None:
        tests.append(F.col("source") == source)
    if quality is not None:
        tests.append(F.lower(F.col("quality")) == quality.lower())
    ranked = [(topic, topics, "topic"), (purpose, purposes, "purpose")]
    for value, rankings, label in ranked:
        if value is None:
            continue
        members = rankings.where(F.lower(F.col("label")) == value.lower()).select(key).distinct()
        if combine == "and":
            df = df.join(members, key, "left_semi")
        else:
            df = df.join(members.withColumn(f"_{label}", F.lit(True)), key, "left")
            tests.append(F.coalesce(F.col(f"_{label}"), F.lit(False)))
    if tests:
        condition = tests[0]
        for t in tests[1:]:
            condition = (condition & t) if combine == "and" else (condition | t)
        df = df.where(condition)
    return df.drop("_topic", "_purpose")


def metadata_map(metadata: DataFrame, key: str = "url_id") -> DataFrame:
    """Key-value rows -> one map per url (first value by sort order wins for a repeated key)."""
    one = metadata.groupBy(key, "key").agg(F.min("value").alias("value"))
    return one.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))


def metadata_columns(metadata: DataFrame, names: Sequence[str], key: str = "url_id") -> DataFrame:
    """The same pivoted to named columns; naming them avoids a pass to discover the keys."""
    return metadata.groupBy(key).pivot("key", list(names)).agg(F.min("value"))
