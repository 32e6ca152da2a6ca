"""Risk history: series, trend lines and moving-window anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scale import row_numbers, with_halo

COMPONENTS = ("markdown", "pattern", "secrets", "static")
_DAY = 86.4e9


def long_series(history: DataFrame) -> DataFrame:
    """(url, ts, overall, four component risks) -> (url, component, ts, value); null component scores count as 0."""
    pairs = [F.struct(F.lit("overall").alias("component"), F.col("overall_risk_score").alias("value"))]
    pairs += [F.struct(F.lit(c).alias("component"), F.coalesce(f"{c}_risk", F.lit(0.0)).alias("value")) for c in COMPONENTS]
    return history.select("url", "ts", "event_id", F.inline(F.array(*pairs)))


def numbered_series(history: DataFrame, bucket: Column | None = None) -> DataFrame:
    """The ordered history of each URL as numbered rows: a series of any length stays distributed."""
    bucket = bucket if bucket is not None else F.date_trunc("day", F.col("ts"))
    return row_numbers(history, ["url"], bucket, [F.col("ts"), F.col("event_id")], "position")


def history_with_versions(history: DataFrame, versions: DataFrame) -> DataFrame:
    """Risk scores with their version number where known (left join), in time order."""
    return history.join(versions.select("url", "version_number", "content_hash"), ["url", "version_number"], "left").orderBy("url", "ts")


def trends(series: DataFrame) -> DataFrame:
    """Least-squares trend per (url, component): direction, strength, r² and a 30-day forecast.

    Regression aggregates merge partial sums, so a hot URL reduces map side.
    """
    x = F.unix_micros("ts") / F.lit(_DAY)
    fitted = series.groupBy("url", "component").agg(
        F.count("*").alias("data_points"),
        F.regr_slope("value", x).alias("_slope"),
        F.regr_intercept("value", x).alias("_intercept"),
        F.regr_r2("value", x).alias("_r2"),
        F.var_pop("value").alias("_var"),
        F.max_by("value", F.struct("ts", "event_id")).alias("current_value"),
        F.min(x).alias("_x0"),
        F.max(x).alias("_x1"),
    )
    slope = F.coalesce("_slope", F.lit(0.0))
    size = F.abs(slope)
    strength = F.when(size < 0.001, F.lit("none")).when(size < 0.01, F.lit("weak")).when(size < 0.05, F.lit("moderate")).otherwise(F.lit("strong"))
    direction = F.when(size < 0.001, F.lit("stable")).when(slope > 0, F.lit("increasing")).otherwise(F.lit("decreasing"))
    forecast = F.coalesce(F.col("_intercept") + slope * (F.col("_x1") + 30), F.col("current_value"))
    return fitted.where("data_points >= 2").select(
        "url", "component", "data_points", (F.col("_x1") - F.col("_x0")).alias("time_span_days"), direction.alias("direction"), strength.alias("strength"), slope.alias("slope"),
        F.when(F.col("_var") == 0, F.lit(0.0)).otherwise(F.coalesce("_r2", F.lit(0.0))).alias("r_squared"), "current_value", F.least(F.greatest(forecast, F.lit(0.0)), F.lit(1.0)).alias("prediction_30_days"),
    )


def score_anomalies(history: DataFrame, block_rows: int = 4096) -> DataFrame:
    """Scores further than two standard deviations from the mean of the three before them.

    Needs at least five points per URL: a fourth point counts only when a fifth
    exists, which ``lead`` tells. Rows are numbered per URL and windowed in blocks
    with a three-row halo, never a whole URL at once. Three equal scores have no
    spread to measure by, whatever rounding leaves of their deviation.
    """
    if block_rows < 5:
        raise ValueError("a block must hold the fourth and fifth point of a series")
    numbered = numbered_series(history)
    wide = with_halo(numbered, "position", 3, block_rows)
    pairs = [F.struct(F.lit("overall_risk").alias("score_type"), F.col("overall_risk_score").alias("value"))]
    pairs += [F.struct(F.lit(f"{c}_risk").alias("score_type"), F.coalesce(f"{c}_risk", F.lit(0.0)).alias("value")) for c in COMPONENTS]
    series = wide.select("url", "ts", "position", "_block", "_home", F.inline(F.array(*pairs)))
    order = Window.partitionBy("url", "_block", "score_type").orderBy("position")
    before = order.rowsBetween(-3, -1)
    scored = series.select(
        "*", F.avg("value").over(before).alias("expected_value"), F.stddev_pop("value").over(before).alias("_std"), (F.max("value").over(before) > F.min("value").over(before)).alias("_spread"), F.lead("position").over(order).isNotNull().alias("_more")
    ).where("_home")
    deviation = F.col("value") - F.col("expected_value")
    enough = (F.col("position") >= 5) | ((F.col("position") == 4) & F.col("_more"))
    return scored.where(enough & F.col("_spread") & (F.col("_std") > 0) & (F.abs(deviation) > 2 * F.col("_std"))).select(
        "url", "ts", "score_type", "value", "expected_value", deviation.alias("deviation"), (F.abs(deviation) / F.col("_std")).alias("standard_deviations"),
        F.when(F.abs(deviation) > 3 * F.col("_std"), F.lit("high")).otherwise(F.lit("medium")).alias("severity"),
    )
