"""Risk scoring: evidence confidence, weighted dimensions, context adjustment, classification.

Everything here is arithmetic on columns of one row, except the two joins that
bring in domain reputations and the baseline.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.matching import let
from ..functions.patterns import java


def _lookup(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def severity_score(severity: Column) -> Column:
    return F.coalesce(_lookup(R.SEVERITY_IMPACT)[F.lower(severity)], F.lit(0.0))


def evidence_confidence(evidence: Column, reliability: dict | None = None) -> Column:
    """Mean of strength × reliability plus a bonus for several strong sources.

    ``evidence`` is array<struct<source, strength>>. A null element counts in the
    mean's denominator but adds nothing, as a malformed item does.
    """
    table = reliability or R.SOURCE_RELIABILITY
    default = F.lit(table["DEFAULT_SOURCE"])
    weight = lambda e: F.coalesce(_lookup(table)[F.coalesce(e["source"], F.lit("DEFAULT_SOURCE"))], default)
    usable = F.filter(evidence, lambda e: e.isNotNull())
    strength = F.aggregate(
        F.transform(usable, lambda e: F.coalesce(e["strength"], weight(e)) * weight(e)), F.lit(0.0), lambda a, x: a + x
    )
    strong = F.size(F.filter(usable, lambda e: weight(e) >= R.STRONG_SOURCE))
    bonus = F.when(strong > 1, F.least(F.lit(R.CORROBORATION_STEP) * (strong - 1), F.lit(R.CORROBORATION_CAP))).otherwise(F.lit(0.0))
    filled = F.coalesce(F.size(evidence), F.lit(0)) > 0
    return F.when(filled, clamp(strength / F.size(evidence) + bonus)).otherwise(F.lit(R.NO_EVIDENCE_CONFIDENCE))


def dimension_breakdown(scores: Column, weights: dict | None = None) -> Column:
    """map<dimension, struct<score, weight, weighted>>; a missing dimension scores 0."""
    entries = []
    for name, weight in (weights or R.DIMENSION_WEIGHTS).items():
        score = F.coalesce(scores[name], F.lit(0.0))
        entries += [F.lit(name), F.struct(score.alias("score"), F.lit(weight).alias("weight"), (score * weight).alias("weighted"))]
    return F.create_map(*entries)


def aggregate_score(scores: Column, confidence: Column | None = None, weights: dict | None = None, confidence_weight: float = R.CONFIDENCE_WEIGHT) -> Column:
    """Σ score·weight / Σ weight, scaled by the confidence when there is one."""
    weights = weights or R.DIMENSION_WEIGHTS
    total = sum(weights.values())
    summed = reduce(lambda a, b: a + b, [F.coalesce(scores[n], F.lit(0.0)) * w for n, w in weights.items()])
    base = summed / total if total > 0 else F.lit(0.0)
    return base if confidence is None else base * (confidence * confidence_weight)


def classify(score: Column, thresholds: dict | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for label, bound in sorted((thresholds or R.SEVERITY_THRESHOLDS).items(), key=lambda kv: -kv[1]):
        out = out.when(score >= bound, F.lit(label))
    return out.otherwise(F.lit("info"))


def categories(description: Column, taxonomy: dict | None = None) -> Column:
    """Categories whose keywords occur in the description, or [uncategorized]; the first is primary."""

    def hits(lowered: Column) -> Column:
        tests = [(c, reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w.lower())) for w in words])) for c, words in (taxonomy or R.CATEGORY_KEYWORDS).items()]
        return F.array_compact(F.array(*[F.when(test, F.lit(c)) for c, test in tests]))

    found = let(F.lower(description), hits)
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit("uncategorized"))))


def purpose_scores(content: Column, lowered: Column, purposes: dict | None = None) -> list[tuple[str, Column]]:
    """(purpose, (keyword hits + 2 · pattern hits) · weight) in definition order."""
    out = []
    for name, (weight, words, patterns) in (purposes or R.PURPOSES).items():
        hits = reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(w.lower())).cast("int") for w in words])
        for p in patterns:
            hits = hits + F.lit(2) * content.rlike(java(p, "i")).cast("int")
        out.append((name, hits * F.lit(weight)))
    return out


def top_purposes(content: Column, n: int = 1, purposes: dict | None = None) -> Column:
    """The n best purposes by score, ties in definition order; [unknown] when nothing hits."""

    def scored(lowered: Column) -> Column:
        rows = [F.struct((-score).alias("o"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, score) in enumerate(purpose_scores(content, lowered, purposes))]
        return F.filter(F.array(*rows), lambda s: s["o"] < 0)

    ranked = F.transform(F.slice(F.array_sort(let(F.lower(content), scored)), 1, n), lambda s: s["name"])
    return let(ranked, lambda r: F.when(F.size(r) > 0, r).otherwise(F.array(F.lit("unknown"))))


def fallback_reputation(domain: Column) -> Column:
    d = F.lower(domain)
    has = lambda s: F.contains(d, F.lit(s))
    ends = lambda *s: reduce(lambda a, b: a | b, [F.endswith(d, F.lit(x)) for x in s])
    return (
        F.when(ends(".gov", ".edu") | has("internal.company.com"), F.lit(0.9))
        .when(ends(".xyz", ".top") | has("suspicious") | has("phish"), F.lit(0.2))
        .when(ends(".info", ".biz"), F.lit(0.4))
        .when(d.isNotNull(), F.lit(0.5))
    )


def with_reputation(df: DataFrame, known: DataFrame | None = None, domain: str = "domain") -> DataFrame:
    """Adds ``domain_reputation``: a known score, else the suffix rules. The join strategy is left to AQE."""
    if known is None:
        return df.withColumn("domain_reputation", fallback_reputation(F.col(domain)))
    listed = known.select(F.lower("domain").alias("_domain"), F.col("score").alias("_score")).dropDuplicates(["_domain"])
    out = df.join(listed, F.lower(F.col(domain)) == F.col("_domain"), "left")
    return out.withColumn("domain_reputation", F.coalesce("_score", fallback_reputation(F.col(domain)))).drop("_domain", "_score")


def baseline_key(type_: str = "finding_type", rule: str = "rule_id", line: str = "line", file: str = "file_path") -> Column:
    c = lambda name, default: F.coalesce(F.col(name).cast("string"), F.lit(default))
    return F.concat_ws("|", c(type_, "unknown_type"), c(rule, "no_rule"), c(line, "na"), c(file, "no_file"))


def compare_baseline(findings: DataFrame, baseline: DataFrame, context: str = "context_id") -> DataFrame:
    """Adds similarity_score, baseline_status and is_novel against the baseline of the same context."""
    known = baseline.groupBy(F.col(context).alias("_context"), F.col("baseline_key").alias("_key")).agg(
        F.min_by(F.coalesce("status", F.lit("unknown_status_in_baseline")), F.struct("seq")).alias("_status")
    )
    out = findings.withColumn("_k", baseline_key()).join(known, (F.col(context) == F.col("_context")) & (F.col("_k") == F.col("_key")), "left")
    hit = F.col("_key").isNotNull()
    return (
        out.withColumn("similarity_score", F.when(hit, F.lit(1.0)).otherwise(F.lit(R.BASELINE_MISS_SIMILARITY)))
        .withColumn("baseline_status", F.col("_status"))
        .withColumn("is_novel", ~hit)
        .drop("_context", "_key", "_status", "_k")
    )


def novel_only(findings: DataFrame, baseline: DataFrame, context: str = "context_id") -> DataFrame:
    known = baseline.select(F.col(context).alias("_context"), F.col("baseline_key").alias("_key"))
    keyed = findings.withColumn("_k", baseline_key())
    return keyed.join(known, (F.col(context) == F.col("_context")) & (F.col("_k") == F.col("_key")), "left_anti").drop("_k")


def update_baseline(baseline: DataFrame, additions: DataFrame, context: str = "context_id") -> DataFrame:
    """New snapshot: known keys take the new status, unknown keys are added."""
    new = additions.select(F.col(context).alias("_c"), F.col("baseline_key").alias("_k"), F.coalesce("status", F.lit("newly_added_to_baseline")).alias("_s"))
    joined = baseline.join(new, (F.col(context) == F.col("_c")) & (F.col("baseline_key") == F.col("_k")), "full_outer")
    return joined.select(F.coalesce(context, "_c").alias(context), F.coalesce("baseline_key", "_k").alias("baseline_key"), F.coalesce("_s", "status").alias("status"))


def adjust(score: Column, reputation: Column, purposes: Column, is_novel: Column, status: Column, similarity: Column) -> Column:
    """Score × reputation, primary-purpose, novelty, status and similarity multipliers, clamped to 0–1."""
    r = R.REPUTATION_ADJUST
    by_reputation = F.when(reputation >= r["trusted_threshold"], F.lit(r["trusted"])).when(reputation <= r["suspicious_threshold"], F.lit(r["suspicious"])).otherwise(F.lit(1.0))
    primary = F.coalesce(F.get(purposes, F.lit(0)), F.lit("unknown"))
    by_purpose = F.coalesce(_lookup(R.PURPOSE_MULTIPLIERS)[primary], F.lit(R.PURPOSE_MULTIPLIERS["unknown"]))
    by_novelty = F.when(is_novel, F.lit(R.NOVEL_MULTIPLIER)).otherwise(F.lit(1.0))
    by_status = F.coalesce(_lookup(R.STATUS_MULTIPLIERS)[status], F.lit(1.0))
    by_similarity = F.when((similarity >= R.SIMILAR_THRESHOLD) & status.isNull(), F.lit(R.SIMILAR_MULTIPLIER)).otherwise(F.lit(1.0))
    return clamp(score * by_reputation * by_purpose * by_novelty * by_status * by_similarity)


def document_purposes(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 3) -> DataFrame:
    """(key, content_purposes) per document."""
    return docs.select(key, top_purposes(F.col(text), n).alias("content_purposes"))


def finding_dimensions(severity: Column, detector: Column, confidence: Column) -> Column:
    """Dimension scores of a detected finding: impact, likelihood, exposure."""
    return F.create_map(
        F.lit("impact"), severity_score(severity), F.lit("likelihood"), confidence, F.lit("exposure"), F.coalesce(_lookup(R.DETECTOR_EXPOSURE)[detector], F.lit(0.5))
    )


def assess(findings: DataFrame, baseline: DataFrame, known_domains: DataFrame | None = None) -> DataFrame:
    """Full assessment per finding.

    Expects: description, evidence_items, scores, domain, context_id, the baseline
    key columns and content_purposes (from ``document_purposes``: texts are reduced
    to purposes before any join). Without that column the description decides.
    Returns both confidences, the aggregate and adjusted score, severity,
    categories and the context that was used.
    """
    out = compare_baseline(with_reputation(findings, known_domains), baseline)
    own = top_purposes(F.col("description"), 3)
    out = out.withColumn("content_purposes", F.coalesce(F.col("content_purposes"), own) if "content_purposes" in findings.columns else own)
    out = out.withColumn("assessor_confidence", evidence_confidence(F.col("evidence_items"), R.ASSESSOR_RELIABILITY))
    out = out.withColumn("model_confidence", evidence_confidence(F.col("evidence_items")))
    out = out.withColumn("aggregate_score", aggregate_score(F.col("scores"), F.col("model_confidence")))
    out = out.withColumn(
        "final_score", adjust(F.col("aggregate_score"), F.col("domain_reputation"), F.col("content_purposes"), F.col("is_novel"), F.col("baseline_status"), F.col("similarity_score"))
    )
    out = out.withColumn("risk_severity", classify(F.col("final_score"))).withColumn("categories", categories(F.col("description")))
    return out.withColumn("primary_category", F.element_at("categories", 1)).withColumn("breakdown", dimension_breakdown(F.col("scores")))
