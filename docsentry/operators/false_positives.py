"""False-positive classifier: labels, training, scoring, importances, feedback."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.forest import cut_forest, cut_predictions
from ..functions.scale import broadcast_small, exact_quantiles
from ..session import materialize, shared_dir
from .features import finding_feature_names, finding_vector

#: Rows of a partition in a grid search, at least.
_SEARCH_ROWS = 5_000


def labels_from_likelihood(findings: DataFrame, threshold: float = 0.7) -> DataFrame:
    """label 0 (false positive) above the threshold, else 1."""
    return findings.withColumn("label", F.when(F.col("false_positive_likelihood") > threshold, 0).otherwise(1))


def finding_rows(findings: DataFrame, content_features: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings with the 47-value vector: content features of their document plus finding features."""
    joined = findings.join(content_features.select(key, "features"), key)
    remediation = F.col("remediation_suggestion") if "remediation_suggestion" in findings.columns else F.lit(None).cast("string")
    vector = finding_vector(F.col("features"), F.col("finding_type"), F.lower("severity"), F.col("evidence"), F.col("location"), remediation)
    return joined.withColumn("features", vector)


def stratified_split(df: DataFrame, key: str, label: str = "label", train: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``is_train``: within every label the lowest 80 % of a row hash train.

    The cut is an exact quantile of hashes per label, from bucketed counts, so a
    dominant label is not sorted in one task; reruns give the same split.
    """
    hashed = df.withColumn("_h", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)).cast("double"))
    cuts = exact_quantiles(hashed, [label], "_h", F.floor(F.col("_h") / float(1 << 28)), {"_cut": ("linear", train)})
    return hashed.join(broadcast_small(cuts), label).withColumn("is_train", F.col("_h") <= F.col("_cut")).drop("_h", "_cut")


def classifier(n_trees: int = 100, max_depth: int = 10, seed: int = 42) -> Pipeline:
    return Pipeline(
        stages=[
            StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True),
            RandomForestClassifier(featuresCol="scaled", labelCol="label", numTrees=n_trees, maxDepth=max_depth, seed=seed),
        ]
    )


def as_vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("vector", array_to_vector("features")).withColumn("label", F.col("label").cast("double")) if "label" in df.columns else df.withColumn("vector", array_to_vector("features"))


def train(rows: DataFrame, n_trees: int = 100, max_depth: int = 10, seed: int = 42) -> PipelineModel:
    return classifier(n_trees, max_depth, seed).fit(as_vectors(rows))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_metadata(spark: SparkSession, name: str, version: str, kind: str, algorithm: str, path: str, threshold: float | None = None, parameters: dict | None = None, performance: dict | None = None) -> DataFrame:
    """Registry row of a saved model, for ``sinks.tables.upsert_latest`` by (name, version)."""
    row = (name, version, kind, algorithm, path, threshold, {k: str(v) for k, v in (parameters or {}).items()}, {k: float(v) for k, v in (performance or {}).items()}, R.FEATURE_VERSION)
    schema = "name string, version string, model_type string, algorithm string, path string, threshold double, parameters map<string,string>, performance map<string,double>, feature_version string"
    return spark.createDataFrame([row], schema).withColumn("updated_at", F.current_timestamp())


def classify(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds tp_probability, is_true_positive and false_positive_likelihood."""
    scored = model.transform(as_vectors(rows))
    probability = F.get(vector_to_array("probability"), F.lit(1))
    out = scored.withColumn("tp_probability", F.coalesce(probability, F.lit(0.0))).withColumn("is_true_positive", F.col("prediction") == 1.0)
    return out.withColumn("false_positive_likelihood", 1 - F.col("tp_probability")).drop("vector", "scaled", "rawPrediction", "probability")


def top_model_features(spark: SparkSession, model: PipelineModel, names: Sequence[str] | None = None, top: int = 10) -> DataFrame:
    """The model's strongest features by importance."""
    names = list(names or finding_feature_names())
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def finding_importances(top_features: Sequence[tuple[str, float]], is_true_positive: Column, columns: Sequence[str], top: int = 5) -> Column:
    """Strongest present features of one finding: model features with a value, then type, severity and evidence."""
    pick = lambda yes, no: F.when(is_true_positive, F.lit(yes)).otherwise(F.lit(no))
    entry = lambda name, weight: F.struct((-weight).alias("o"), name.alias("feature"), weight.alias("importance"))
    entries = [F.when(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) > 0, entry(F.lit(n), F.lit(float(w)))) for n, w in top_features if n in columns]
    entries.append(entry(F.concat(F.lit("finding_type."), F.coalesce("finding_type", F.lit("unknown"))), pick(0.7, 0.3)))
    entries.append(entry(F.concat(F.lit("severity."), F.coalesce("severity", F.lit("unknown"))), pick(0.6, 0.4)))
    entries.append(F.when(F.coalesce(F.col("evidence"), F.lit("")) != "", entry(F.lit("has_evidence"), pick(0.8, 0.2))))
    ranked = F.slice(F.array_sort(F.array_compact(F.array(*entries))), 1, top)
    return F.transform(ranked, lambda s: F.struct(s["feature"].alias("feature"), s["importance"].alias("importance")))


class Search(NamedTuple):
    """Settings (n_trees, max_depth, min_split), their mean F1 over the folds, and the model of the best one over all rows."""

    settings: list[tuple[int, int, int]]
    avgMetrics: list[float]
    bestModel: PipelineModel


def _forest_nodes(forest: RandomForestClassificationModel) -> pd.DataFrame:
    """The nodes of a forest's trees, from its saved form."""
    spark = SparkSession.active()
    path = shared_dir(spark, "forest-nodes")
    forest.write().overwrite().save(path)
    node = [f"nodeData.{c}" for c in ("id", "prediction", "impurityStats", "leftChild", "rightChild")]
    split = [F.col("nodeData.split.featureIndex").alias("featureIndex"), F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")]
    return spark.read.parquet(f"{path}/data").select("treeID", *node, *split).toPandas()


def _weighted_f1(counts: dict[tuple[float, float], int]) -> float:
    """F1 of the classes, weighted by their rows, from counts by (label, prediction)."""
    total = sum(counts.values())
    out = 0.0
    for label in {y for y, _ in counts}:
        support = sum(n for (y, _), n in counts.items() if y == label)
        predicted = sum(n for (_, x), n in counts.items() if x == label)
        out += support * 2 * counts.get((label, label), 0) / (support + predicted)
    return out / total if total else 0.0


def _remember_nodes(pipeline: Pipeline) -> Pipeline:
    """Rows keep the node they have come to in every tree, four bytes each, and do not walk from the root again for each level; the trees are the same."""
    pipeline.getStages()[-1].setCacheNodeIds(True).setCheckpointInterval(-1)
    return pipeline


def search(rows: DataFrame, n_trees: Sequence[int] = (50, 100, 200), max_depth: Sequence[int] = (5, 10, 20), min_split: Sequence[int] = (1, 2, 4), folds: int = 5, parallelism: int = 4, seed: int = 42) -> Search:
    """Cross-validated grid search by weighted F1 over every setting and fold.

    The trees of a forest are grown independently, and level by level: its first
    trees are a forest of fewer trees, and what is above a depth is the tree of
    that depth. So one forest of the largest size is grown for each fold and
    ``min_split``, and all sizes and depths are read from it in one pass over
    the held-out rows.
    """
    spark = rows.sparkSession
    fold = F.floor(F.rand(seed) * folds).cast("int")
    data = as_vectors(materialize(rows.select("features", "label", fold.alias("_fold")), "search-rows"))
    # each partition sends the statistics of every node that grows, so few rows belong in few partitions; forests grow side by side
    data = data.coalesce(-(-data.count() // _SEARCH_ROWS) or 1).cache()
    schema = "setting int, label double, prediction double, n long"
    settings = list(product(n_trees, max_depth, min_split))

    def held_out(job: tuple[int, int]) -> list[tuple[int, float]]:
        number, least = job
        base = classifier(max(n_trees), max(max_depth), seed)
        base.getStages()[-1].setMinInstancesPerNode(least)
        model = _remember_nodes(base).fit(data.where(F.col("_fold") != number))
        forest = spark.sparkContext.broadcast(cut_forest(_forest_nodes(model.stages[-1]), max_depth))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: Counter[tuple[int, float, float]] = Counter()
            for batch in batches:
                if not len(batch):
                    continue
                scaled, labels = np.stack(batch["scaled"].to_numpy()), batch["label"].to_numpy()
                for depth in max_depth:
                    for trees, said in zip(n_trees, cut_predictions(forest.value, scaled, n_trees, depth), strict=True):
                        setting = settings.index((trees, depth, least))
                        pairs, counts = np.unique(np.stack([labels, said]), axis=1, return_counts=True)
                        found.update({(setting, float(y), float(x)): int(n) for (y, x), n in zip(pairs.T, counts, strict=True)})
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["setting", "label", "prediction", "n"])

        tested = model.stages[0].transform(data.where(F.col("_fold") == number)).select(vector_to_array("scaled").alias("scaled"), "label")
        counted = tested.mapInPandas(run, schema).groupBy("setting", "label", "prediction").agg(F.sum("n").alias("n")).collect()
        forest.destroy()
        by_setting: dict[int, dict[tuple[float, float], int]] = defaultdict(dict)
        for row in counted:
            by_setting[row["setting"]][row["label"], row["prediction"]] = row["n"]
        return [(i, _weighted_f1(by_setting[i])) for i, s in enumerate(settings) if s[2] == least]

    with ThreadPool(parallelism) as pool:
        scores = [pair for part in pool.map(inheritable_thread_target(held_out), list(product(range(folds), min_split))) for pair in part]
    means = [sum(f1 for i, f1 in scores if i == setting) / folds for setting in range(len(settings))]
    trees, depth, least = settings[max(range(len(settings)), key=means.__getitem__)]
    best = classifier(trees, depth, seed)
    best.getStages()[-1].setMinInstancesPerNode(least)
    model = _remember_nodes(best).fit(data)
    data.unpersist()
    return Search(settings, means, model)


def valid_feedback(feedback: DataFrame, findings: DataFrame) -> DataFrame:
    """Feedback whose finding exists."""
    return feedback.join(findings.select("finding_id"), "finding_id", "left_semi")


def feedback_statistics(feedback: DataFrame) -> DataFrame:
    """Counts and rates per finding type and, where finding_type is null, overall (one rollup)."""
    kind = F.coalesce("finding_type", F.lit("unknown")).alias("finding_type")
    tp = F.count_if("is_true_positive")
    total = F.count("*")
    return feedback.rollup(kind).agg(
        total.alias("n_feedback"), tp.alias("true_positives"), (total - tp).alias("false_positives"), (tp / total).alias("true_positive_rate"), ((total - tp) / total).alias("false_positive_rate")
    )


def model_performance(classified: DataFrame, feedback: DataFrame) -> DataFrame:
    """Accuracy against feedback; feedback without a classification still counts in the denominator of accuracy."""
    c = classified.select("finding_id", F.col("is_true_positive").alias("_predicted"))
    both = feedback.join(c, "finding_id", "left")
    known, actual = F.col("_predicted").isNotNull(), F.col("is_true_positive")
    right = known & (F.col("_predicted") == actual)
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp_total, fp_total = F.count_if(known & actual), F.count_if(known & ~actual)
    return both.agg(
        F.count("*").alias("feedback_count"), safe(F.count_if(right), F.count("*")).alias("accuracy"), safe(F.count_if(right & actual), tp_total).alias("true_positive_accuracy"),
        safe(F.count_if(right & ~actual), fp_total).alias("false_positive_accuracy"), F.count_if(right).alias("correct_count"), tp_total.alias("true_positive_total"), fp_total.alias("false_positive_total"),
    )
