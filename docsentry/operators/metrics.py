"""Metric series: filters and window roll-ups."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_metrics(metrics: DataFrame, metric_type: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Series points as ordered rows (type, name, timestamp, value, data).

    The nested type → name → series form is the sorted long table: a series may
    be arbitrarily long, so it is range partitioned and never gathered in one row.
    """
    if metric_type is not None:
        metrics = metrics.where(F.col("metric_type") == metric_type)
    if start is not None:
        metrics = metrics.where(F.col("timestamp") >= start)
    if end is not None:
        metrics = metrics.where(F.col("timestamp") <= end)
    return metrics.orderBy("metric_type", "metric_name", "timestamp")


def with_nested(metrics: DataFrame, fields: Mapping[str, tuple[str, str]], data: str = "metric_data") -> DataFrame:
    """``metrics`` with typed columns out of their nested values: name -> (path, type), as ("$.errors", "bigint").

    The text is parsed once into a variant, and paths are read out of it without
    another pass over the text. What is missing, of another type or no JSON is null.
    """
    parsed = metrics.withColumn("_nested", F.try_parse_json(F.col(data)))
    return parsed.select(*metrics.columns, *[F.try_variant_get("_nested", path, kind).alias(name) for name, (path, kind) in fields.items()])


def windowed(events: DataFrame, length: str = "5 minutes", slide: str | None = None, ts: str = "ts", name: str = "event_type", value: str = "value") -> DataFrame:
    """Count, sum, average and maximum per time window and metric.

    Sliding windows that a whole number of slides fills are put together from
    counts per slide, so no event is copied into every window it falls in.
    """
    of_rows = [F.count("*").alias("n"), F.sum(value).alias("total"), F.count(value).alias("valued"), F.max(value).alias("maximum")]
    if slide and pd.Timedelta(length) % pd.Timedelta(slide) == pd.Timedelta(0):
        steps = events.groupBy(F.window(ts, slide).alias("w"), F.col(name).alias("metric_name")).agg(*of_rows)
        window = F.window("at", length, slide)
        of_steps = [F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("valued").alias("valued"), F.max("maximum").alias("maximum")]
        grouped = steps.withColumn("at", F.col("w.start")).drop("w").groupBy(window.alias("w"), "metric_name").agg(*of_steps)
    else:
        window = F.window(ts, length, slide) if slide else F.window(ts, length)
        grouped = events.groupBy(window.alias("w"), F.col(name).alias("metric_name")).agg(*of_rows)
    average = F.when(F.col("valued") > 0, F.col("total") / F.col("valued"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "metric_name", "n", "total", average.alias("average"), "maximum")
