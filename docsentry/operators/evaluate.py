"""Accuracy: ground truth, matching, precision and recall, confusion, ROC and PR curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.runs import earliest_free
from ..functions.scale import exact_quantiles, quantile_bucket, running_totals
from ..session import materialize


#: Askers of a share in one-to-one matching, on average.
_SHARE_ROWS = 5_000


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def scenario_truth(spark: SparkSession) -> DataFrame:
    """Expected findings implied by a scenario type."""
    rows = [(s, *v) for s, v in R.SCENARIO_EXPECTED.items()]
    return spark.createDataFrame(rows, "scenario_type string, type string, severity string, description string")


def expected_findings(cases: DataFrame, truth: DataFrame) -> DataFrame:
    """Explicit truth per case where there is any, otherwise what the scenario implies.

    A ``mixed`` case expects one finding per listed transformation of the first three scenario types.
    """
    implied = F.broadcast(scenario_truth(cases.sparkSession).withColumnRenamed("scenario_type", "_scenario"))
    open_cases = cases.join(truth.select("case_id"), "case_id", "left_anti")
    mixed_types = list(R.SCENARIO_EXPECTED)[:3]
    scenarios = F.when(F.col("scenario_type") == "mixed", F.filter("transformation_types", lambda t: t.isin(*mixed_types))).otherwise(F.array("scenario_type"))
    derived = open_cases.select("case_id", F.posexplode(scenarios).alias("expected_no", "_s")).join(implied, F.col("_s") == F.col("_scenario"))
    derived = derived.select("case_id", "expected_no", "type", "severity", F.lit(None).cast("string").alias("pattern"))
    return truth.select("case_id", "expected_no", "type", "severity", "pattern").unionByName(derived)


def severity_band_matches(actual: Column, expected: Column) -> Column:
    """Expected severities accept any actual severity of their band; other expectations accept everything."""
    a, e = F.lower(F.coalesce(actual, F.lit(""))), F.lower(expected)
    out = F.when(F.lit(False), F.lit(True))
    for words in R.SEVERITY_BANDS.values():
        out = out.when(e.isin(*words), a.isin(*words))
    return out.otherwise(F.lit(True))


def match_kinds(actual: DataFrame, expected: DataFrame, key: str = "case_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings and expectations of a case by kind, and which kinds agree: (key, actual_no, sort), (key, expected_no, kind), (key, sort, kind).

    Findings of equal type, texts and severity are one sort, expectations of
    equal type, pattern and severity one kind. Type, pattern and severity are
    compared once for a sort and a kind of a case, however many rows have them.
    """
    lowered = lambda c: F.lower(F.coalesce(c, F.lit("")))
    text = F.lower(F.concat_ws("\n", "description", "details", "code", "content"))
    a = actual.select(F.col(key), "actual_no", lowered("type").alias("_atype"), lowered("description").alias("_adesc"), text.alias("_atext"), F.col("severity").alias("_asev"))
    e = expected.select(F.col(key), "expected_no", F.lower("type").alias("_type"), F.lower("pattern").alias("_pattern"), F.col("severity").alias("_severity"))
    named = lambda *columns: F.sha2(F.to_json(F.array(*columns)), 256)
    a = a.withColumn("sort", named("_atype", "_adesc", "_atext", "_asev"))
    e = e.withColumn("kind", named("_type", "_pattern", "_severity"))
    sorts = a.groupBy(key, "sort").agg(F.first(F.struct("_atype", "_adesc", "_atext", "_asev")).alias("_s")).select(key, "sort", "_s.*")
    kinds = e.groupBy(key, "kind").agg(F.first(F.struct("_type", "_pattern", "_severity")).alias("_k")).select(key, "kind", "_k.*")
    typed = F.contains("_atype", "_type") | F.contains("_adesc", "_type")
    pattern = F.col("_pattern").isNull() | F.contains("_atext", "_pattern")
    agree = sorts.join(kinds, key).where(typed & pattern & severity_band_matches(F.col("_asev"), F.col("_severity"))).select(key, "sort", "kind")
    return a.select(key, "actual_no", "sort"), e.select(key, "expected_no", "kind"), agree


def one_to_one(findings: DataFrame, expectations: DataFrame, agree: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, actual_no, expected_no): findings in order each take the first expectation that agrees and is still free.

    Findings with the same choice of kinds are a class. What is left of a case
    is numbers: its findings with their class and its expectations with their
    kind, two small integers and a digest a row. They are walked through in one
    pass with a queue a kind, many cases to a call, so a case costs its rows times its kinds, and
    never its pairs.
    """
    chosen = agree.groupBy(key, "sort").agg(F.sort_array(F.collect_set("kind")).alias("_kinds")).select(key, "sort", "_kinds", F.sha2(F.to_json("_kinds"), 256).alias("class"))
    chosen = materialize(chosen, "match-classes")
    askers = findings.join(chosen.select(key, "sort", "class"), [key, "sort"]).select(key, F.col("actual_no").cast("long").alias("actual_no"), "class")
    kinds = chosen.dropDuplicates([key, "class"]).select(key, F.explode("_kinds").alias("kind"), F.lit(None).cast("long").alias("expected_no"), "class")
    offered = expectations.join(kinds.select(key, "kind").distinct(), [key, "kind"], "left_semi").select(key, "kind", F.col("expected_no").cast("long").alias("expected_no"), F.lit(None).cast("string").alias("class"))
    wishes = offered.unionByName(kinds)
    schema = f"{key} {dict(findings.dtypes)[key]}, actual_no long, expected_no long"
    # a call of its own for every case costs more than its rows: whole cases are dealt to shares of some thousand askers
    shares = -(-askers.count() // _SHARE_ROWS) or 1
    dealt = [side.withColumn("_share", F.pmod(F.xxhash64(key), F.lit(shares))) for side in (askers, wishes)]
    return dealt[0].groupBy("_share").cogroup(dealt[1].groupBy("_share")).applyInPandas(earliest_free(key), schema)


def case_counts(cases: DataFrame, actual: DataFrame, expected: DataFrame, key: str = "case_id") -> DataFrame:
    """True positives, false positives and false negatives per case (cases without findings included)."""
    matched = one_to_one(*match_kinds(actual, expected, key), key).groupBy(key).agg(F.count("*").alias("tp"))
    found = actual.groupBy(key).agg(F.count("*").alias("n_actual"))
    wanted = expected.groupBy(key).agg(F.count("*").alias("n_expected"))
    out = reduce(lambda a, b: a.join(b, key, "left"), [matched, found, wanted], cases).na.fill(0, ["tp", "n_actual", "n_expected"])
    return out.withColumn("fp", F.col("n_actual") - F.col("tp")).withColumn("fn", F.col("n_expected") - F.col("tp"))


def with_scores(df: DataFrame) -> DataFrame:
    """Adds precision, recall and F1 from tp, fp, fn (0 where undefined)."""
    out = df.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def precision_recall(counts: DataFrame, key: str = "case_id") -> DataFrame:
    """Scores per case and, where the key is null, micro-averaged over all cases (one rollup)."""
    return with_scores(counts.rollup(key).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def scenario_metrics(counts: DataFrame, scenario: str = "scenario_type", pass_f1: float = R.PASS_F1) -> DataFrame:
    """Scores and pass rate per scenario and overall; a case passes at F1 ≥ 0.7."""
    scored = with_scores(counts).withColumn("passed", F.col("f1") >= pass_f1)
    rolled = scored.rollup(scenario).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.count_if("passed").alias("passed_tests"), F.count("*").alias("total_tests"))
    return with_scores(rolled).withColumn("pass_rate", ratio(F.col("passed_tests"), F.col("total_tests")))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction", classes=(0, 1)) -> DataFrame:
    return df.groupBy(label).agg(*[F.count_if(F.col(prediction) == c).alias(f"predicted_{c}") for c in classes])


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction", classes=(0, 1)) -> DataFrame:
    """Precision, recall, F1 and support per class, from one aggregation over all classes."""
    per_class = [
        F.struct(
            F.lit(c).alias("class"), F.count_if((F.col(label) == c) & (F.col(prediction) == c)).alias("tp"), F.count_if((F.col(label) != c) & (F.col(prediction) == c)).alias("fp"),
            F.count_if((F.col(label) == c) & (F.col(prediction) != c)).alias("fn"), F.count_if(F.col(label) == c).alias("support"),
        )
        for c in classes
    ]
    return with_scores(df.agg(F.array(*per_class).alias("_c")).select(F.inline("_c")))


def curve(df: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """ROC and PR points per distinct score, highest first.

    Equal scores collapse map side; cumulative counts run per bucket of scores.
    Buckets are cut at quantiles, so the curve of any number of scores is built
    in parallel, however close together they lie.
    """
    counts = df.groupBy(score).agg(F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))
    running = running_totals(counts, [], -quantile_bucket(counts, score), [-F.col(score)], {"tp": F.col("pos"), "fp": F.col("neg")})
    totals = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("t"))
    out = running.withColumn("_t", totals.scalar())
    return out.select(
        F.col(score).alias("threshold"), "pos", "neg", "tp", "fp", F.col("_t.p").alias("positives"), F.col("_t.n").alias("negatives"), ratio(F.col("tp"), F.col("_t.p")).alias("tpr"), ratio(F.col("fp"), F.col("_t.n")).alias("fpr"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def curve_areas(points: DataFrame) -> DataFrame:
    """AUC by trapezoids and average precision. Each point knows its own step, so no ordering is needed."""
    trapezoid = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos"))) / 2
    return points.agg(ratio(trapezoid, F.first("positives") * F.first("negatives")).alias("auc"), ratio(F.sum(F.col("pos") * F.col("precision")), F.first("positives")).alias("average_precision"))


def score_statistics(scores: DataFrame, column: str, threshold: Column) -> DataFrame:
    """Count, anomaly count and ratio, min, max, mean, exact median and population deviation."""
    above = F.count_if(F.col(column) > threshold)
    base = scores.agg(
        F.count("*").alias("num_samples"), above.alias("num_anomalies"), ratio(above, F.count("*")).alias("anomaly_ratio"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std")
    )
    median = exact_quantiles(scores, [], column, quantile_bucket(scores, column), {"median": ("linear", 0.5)})
    return base.withColumn("median", median.scalar())


def performance_over_time(df: DataFrame, batch: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 of every evaluation batch, in time order."""
    yes, said = F.col(label) == 1, F.col(prediction) == 1
    grouped = df.groupBy(batch).agg(F.count("*").alias("num_samples"), F.count_if(yes == said).alias("_right"), F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(yes & ~said).alias("fn"))
    return with_scores(grouped).withColumn("accuracy", ratio(F.col("_right"), F.col("num_samples"))).drop("_right").orderBy(batch)
