"""Anomaly detection: isolation forest, normal-behaviour profile, rule outliers, and their combination."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules as R
from ..functions.forest import TREE_SCHEMA, score_batch, tree_builder
from ..functions.scale import exact_quantiles, quantile_bucket
from ..session import materialize


@dataclass
class IsolationForest:
    """Fitted trees (a small table: trees × sampled rows) and the score threshold."""

    trees: DataFrame
    n_trees: int
    sample_size: int
    threshold: float = 0.0


def fit_forest(vectors: DataFrame, key: str = "doc_id", n_trees: int = 100, sample_size: int = 256, seed: int = 42) -> IsolationForest:
    """Each tree grows on its own hashed sample of about ``sample_size`` rows.

    A row is offered to a tree when a hash of (row, tree) falls below a rate; the
    hashes are compared before any row is copied, so both the copies and the
    shuffle are ~1.5 × trees × sample_size rows however large the input.
    Splits are uniform between a feature's bounds, so scaling features first
    would not change the trees.
    """
    n = vectors.count()
    rate = min(1.0, 1.5 * sample_size / max(n, 1))
    rank = lambda tree: F.pmod(F.xxhash64(F.col(key), tree, F.lit(seed)), F.lit(1 << 60))
    ranked = F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.struct(t.alias("tree"), rank(t).alias("rank_hash")))
    joined = F.filter(ranked, lambda r: r["rank_hash"] < F.lit(int(rate * (1 << 60))))
    offered = vectors.select(F.col(key).cast("string").alias("id"), "features", F.inline(joined)).select("id", "features", "tree", "rank_hash")
    trees = offered.groupBy("tree").applyInPandas(tree_builder(sample_size, seed), TREE_SCHEMA)
    return IsolationForest(trees, n_trees, min(sample_size, max(n, 1)))


def save_forest(forest: IsolationForest, path: str) -> None:
    """Trees as a parquet table; sizes and threshold travel with every row."""
    kept = forest.trees.withColumns({"n_trees": F.lit(forest.n_trees), "sample_size": F.lit(forest.sample_size), "score_threshold": F.lit(float(forest.threshold))})
    kept.write.mode("overwrite").parquet(path)


def load_forest(spark, path: str) -> IsolationForest:
    stored = spark.read.parquet(path)
    head = stored.first()
    return IsolationForest(stored.drop("n_trees", "sample_size", "score_threshold"), head["n_trees"], head["sample_size"], head["score_threshold"])


def forest_scores(vectors: DataFrame, forest: IsolationForest) -> DataFrame:
    """Adds ``raw_score`` in 0–1. The trees are at most n_trees × 2·sample_size nodes, so they travel with the task."""
    nodes = forest.trees.orderBy("tree", "node").toPandas()
    arrays = [{c: g[c].to_numpy() for c in ("feature", "threshold", "left_node", "right_node", "size", "depth")} for _, g in nodes.groupby("tree")]
    size = forest.sample_size

    def score(batch: pd.Series) -> pd.Series:
        return score_batch(batch, arrays, size)

    return vectors.withColumn("raw_score", F.pandas_udf(score, T.DoubleType())("features"))


def contamination_threshold(scores: DataFrame, column: str = "raw_score", contamination: float = 0.1) -> DataFrame:
    """One row: the linearly interpolated (1 − contamination) percentile, exact, without gathering scores in one task."""
    return exact_quantiles(scores, [], column, quantile_bucket(scores, column), {"threshold": ("linear", 1 - contamination)})


def anomaly_results(scored: DataFrame, threshold: Column) -> DataFrame:
    """Score above its percentile offset is an anomaly; confidence grows with the distance.

    ``threshold`` is the percentile of raw scores; anomaly_score is measured from it, so its own threshold is 0.
    """
    score = F.col("raw_score") - threshold
    return scored.withColumn("anomaly_score", score).withColumn("is_anomaly", score > 0).withColumn("threshold", F.lit(0.0)).withColumn(
        "anomaly_confidence", F.least(F.abs(score - F.lit(0.0)) / F.greatest(F.lit(1.0), F.lit(0.0)), F.lit(1.0))
    )


def _entry(name: str, value: Column, contribution: Column, order: int) -> Column:
    return F.struct((-contribution).alias("o"), F.lit(order).alias("i"), F.lit(name).alias("feature"), value.cast("double").alias("value"), contribution.cast("double").alias("contribution"))


def contributing_features(is_anomaly: Column, top: int = 5) -> Column:
    """The strongest present features by a fixed contribution table, ties in table order."""
    pick = lambda pair: F.when(is_anomaly, F.lit(pair[0])).otherwise(F.lit(pair[1]))
    entries = []
    for name in R.SECURITY_FLAGS:
        entries.append((F.col(name), f"security_indicator.{name}", F.lit(1.0), pick(R.CONTRIBUTIONS["indicator"])))
    for name in R.EVASION_COUNTS:
        entries.append((F.col(name) > 0, f"evasion_technique.{name}", F.col(name), pick(R.CONTRIBUTIONS["evasion"])))
    for name in [*R.CODE_COUNTS, "has_obfuscated_code", "language_count"]:
        if name == "has_obfuscated_code":
            entries.append((F.col(name), f"code_pattern.{name}", F.lit(1.0), pick(R.CONTRIBUTIONS["code_flag"])))
        else:
            counted = F.when(is_anomaly, F.least(F.col(name) * R.CODE_COUNT_STEP, F.lit(R.CODE_COUNT_CAP))).otherwise(F.lit(R.CODE_COUNT_NORMAL))
            entries.append((F.col(name) > 0, f"code_pattern.{name}", F.col(name), counted))
    entries.append((~F.col("has_proper_structure"), "markdown_structure.improper_structure", F.lit(1.0), pick(R.CONTRIBUTIONS["structure"])))
    rows = F.array_compact(F.array(*[F.when(test, _entry(n, v, c, i)) for i, (test, n, v, c) in enumerate(entries)]))
    return F.transform(F.slice(F.array_sort(rows), 1, top), lambda s: F.struct(s["feature"].alias("feature"), s["value"].alias("value"), s["contribution"].alias("contribution")))


def normal_profile(features: DataFrame) -> DataFrame:
    """One row describing normal content: means, population deviations, extremes and rates."""
    aggs = []
    for name in ("line_count", "lexical_diversity", "special_char_ratio", "eval_exec_count", "import_count", "code_block_count", "heading_count"):
        aggs += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std")]
    aggs += [F.min("line_count").alias("line_count_min"), F.max("line_count").alias("line_count_max"), F.max("eval_exec_count").alias("eval_exec_count_max")]
    rates = {
        "obfuscation_rate": "has_obfuscated_code", "proper_structure_rate": "has_proper_structure", "credential_rate": "has_credentials", "ip_address_rate": "has_ip_addresses",
        "base64_rate": "has_base64", "script_tags_rate": "has_script_tags", "command_injection_rate": "has_command_injection",
    }
    aggs += [F.avg(F.col(flag).cast("int")).alias(rate) for rate, flag in rates.items()]
    return features.agg(*aggs)


def rule_outliers(features: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Items outside the normal profile. The profile is one row, read as a scalar subquery."""
    if profile is None:
        p = {k: F.lit(v) for k, v in R.DEFAULT_PROFILE.items()}
        staged = features
    else:
        staged = features.withColumn("_p", profile.select(F.struct(*[F.col(k).cast("double").alias(k) for k in R.DEFAULT_PROFILE])).scalar())
        p = {k: F.col("_p")[k] for k in R.DEFAULT_PROFILE}
    spread = p["special_char_ratio_std"] * 3
    ratio_limit = p["special_char_ratio_mean"] + spread
    count_limit = F.greatest(p["eval_exec_count_mean"] + p["eval_exec_count_std"] * 3, p["eval_exec_count_max"])
    factor = lambda name, value, severity: F.struct(F.lit(name).alias("factor"), value.cast("double").alias("value"), severity.cast("double").alias("severity"))
    rare = lambda name, flag, rate: F.when(F.col(flag) & (p[rate] < R.OUTLIER_RARE_RATE[name]), factor(name, F.lit(1.0), F.lit(R.OUTLIER_SEVERITY[name])))
    ratio, evals = F.col("special_char_ratio"), F.col("eval_exec_count")
    # zero spread: any excess is a full-strength outlier
    ratio_severity = F.when(spread > 0, F.least((ratio - p["special_char_ratio_mean"]) / spread, F.lit(1.0))).otherwise(F.lit(1.0))
    factors = F.array_compact(
        F.array(
            F.when(ratio > ratio_limit, factor("high_special_char_ratio", ratio, ratio_severity)),
            F.when(evals > count_limit, factor("high_eval_exec_count", evals, F.least(evals / (p["eval_exec_count_max"] + 1), F.lit(1.0)))),
            rare("code_obfuscation", "has_obfuscated_code", "obfuscation_rate"),
            rare("contains_credentials", "has_credentials", "credential_rate"),
            rare("command_injection", "has_command_injection", "command_injection_rate"),
        )
    )
    out = staged.withColumn("outlier_factors", factors)
    n = F.size("outlier_factors")
    return (
        out.withColumn("is_outlier", n > 0)
        .withColumn("outlier_score", F.coalesce(F.array_max(F.transform("outlier_factors", lambda x: x["severity"])), F.lit(0.0)))
        .withColumn("outlier_confidence", F.when(n > 0, F.least(F.lit(0.5) + F.lit(0.1) * n, F.lit(0.9))).otherwise(F.lit(0.5)))
        .drop("_p")
    )


def combine(anomalies: DataFrame, outliers: DataFrame, key: str = "doc_id", top: int = 10) -> DataFrame:
    """Both detectors joined on the content id: either flags, weighted score, agreement sets the confidence."""
    a = anomalies.select(key, "is_anomaly", "anomaly_score", "anomaly_confidence", "contributing_features")
    o = outliers.select(key, "is_outlier", "outlier_score", "outlier_confidence", "outlier_factors")
    both = a.join(o, key)
    agree = F.col("is_anomaly") == F.col("is_outlier")
    factor = lambda f, c, s: F.struct((-c).alias("o"), f.alias("factor"), c.alias("contribution"), F.lit(s).alias("source"))
    factors = F.concat(
        F.transform("contributing_features", lambda x: factor(x["feature"], x["contribution"], "anomaly_detection")),
        F.transform("outlier_factors", lambda x: factor(x["factor"], x["severity"], "outlier_detection")),
    )
    ranked = F.transform(F.slice(F.array_sort(factors), 1, top), lambda s: F.struct(s["factor"].alias("factor"), s["contribution"].alias("contribution"), s["source"].alias("source")))
    return both.select(
        F.col(key).alias("content_id"),
        (F.col("is_anomaly") | F.col("is_outlier")).alias("is_anomalous"),
        (F.col("anomaly_score") * R.ANOMALY_WEIGHT + F.col("outlier_score") * R.OUTLIER_WEIGHT).alias("combined_score"),
        F.when(agree, F.greatest("anomaly_confidence", "outlier_confidence")).otherwise(F.least("anomaly_confidence", "outlier_confidence")).alias("confidence"),
        ranked.alias("contributing_factors"),
    )


def detect(features: DataFrame, key: str = "doc_id", n_trees: int = 100, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """Isolation forest and rule outliers over a feature table, combined.

    The features are written once: fitting, scoring, the profile and the outlier
    rules all read that table and not the texts.
    """
    features = materialize(features, "features")
    forest = fit_forest(features, key, n_trees, seed=seed)
    scored = materialize(forest_scores(features, forest), "forest-scores")
    results = anomaly_results(scored, contamination_threshold(scored, contamination=contamination).scalar())
    results = results.withColumn("contributing_features", contributing_features(F.col("is_anomaly")))
    return combine(results, rule_outliers(features, normal_profile(features)), key)


def grid_by_variance(vectors: DataFrame, grid: list[dict], key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Score variance per setting of a forest grid: the setting with the most spread ranks first."""
    out = None
    for i, params in enumerate(grid):
        forest = fit_forest(vectors, key, params.get("n_estimators", 100), params.get("max_samples", 256), seed)
        row = forest_scores(vectors, forest).agg(F.var_pop("raw_score").alias("score_variance")).select(
            F.lit(i).alias("setting"), F.lit(params.get("n_estimators", 100)).alias("n_estimators"), F.lit(params.get("max_samples", 256)).alias("max_samples"), "score_variance"
        )
        out = row if out is None else out.unionByName(row)
    return out
