"""Credential, LLM-key and personal-data detection (the secrets detector family)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.matching import Rule, scan


def entropy_proxy(value: Column) -> Column:
    """min(8, distinct characters / length * 8)."""
    characters = F.filter(F.split(value, "", F.lit(-1)), lambda c: c != "")
    distinct = F.size(F.array_distinct(characters))
    return F.when(F.length(value) > 0, F.least(F.lit(8.0), distinct / F.length(value) * 8)).otherwise(F.lit(0.0))


def plausible_base64(value: Column) -> Column:
    """Length of at least 20, a multiple of 4, and decodable."""
    return (F.length(value) >= 20) & (F.length(value) % 4 == 0) & F.try_to_binary(value, F.lit("base64")).isNotNull()


def in_comment(text: Column, start: Column) -> Column:
    """A ``#`` or ``//`` in the 100 characters before the offset."""
    before = F.substring(text, F.greatest(start - 99, F.lit(1)), F.least(start, F.lit(100)))
    return F.contains(before, F.lit("#")) | F.contains(before, F.lit("//"))


def severity(detector: Column, type_name: Column) -> Column:
    lowered = F.lower(type_name)
    hits = lambda words: F.expr("false") if not words else lowered.rlike("|".join(words))
    out = F.when(detector == "pattern_library", F.lit("Medium"))
    for name, levels in R.SECRET_SEVERITY_KEYWORDS.items():
        for level, words in levels:
            out = out.when((detector == name) & hits(words), F.lit(level))
        if name == "trufflehog":
            out = out.when((detector == name) & F.contains(lowered, F.lit("password")) & ~F.contains(lowered, F.lit("example")), F.lit("Medium"))
    return out.when(detector.isin(*R.SECRET_SEVERITY_KEYWORDS), F.lit("Low")).otherwise(F.lit("Medium"))


def accepted(name: Column, match: Column, text: Column, start: Column) -> Column:
    """Context checks: base64 must be plausible; e-mails and JWT secrets in what looks like a comment are rejected."""
    return (
        F.when(name == "Base64-Encoded Token", plausible_base64(match))
        .when(name.isin("Email Address", "JWT Secret"), ~in_comment(text, start))
        .otherwise(F.lit(True))
    )


def raw_matches(
    df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = R.SECRET_RULES
) -> DataFrame:
    """Every accepted match of the secret rules; checks run where the text still is, then the text is dropped."""
    found = scan(df, text, rules, keep)
    return found.where(accepted(F.col("rule_name"), F.col("match"), F.col(text), F.col("start"))).select(
        *keep, F.col("family").alias("detector"), "rule_no", "match_no", F.col("rule_name").alias("name"), "match", "start", "end"
    )


def location(start: Column, end: Column, file_path: Column | None = None) -> Column:
    if file_path is None:
        return F.format_string("offset:%d-%d", start, end)
    return F.when(
        file_path.isNull() | (file_path == ""), F.format_string("offset:%d-%d", start, end)
    ).otherwise(F.concat(F.lit("file:"), file_path, F.format_string(";span:%d-%d", start, end)))


def normalize(matches: DataFrame, keep: Sequence[str] = ("doc_id",), file_path: str | None = None) -> DataFrame:
    """Secret matches in the common findings shape."""
    detector, name, value = F.col("detector"), F.col("name"), F.col("match")
    types = F.create_map(*[F.lit(x) for kv in R.SECRET_FINDING_TYPES.items() for x in kv])
    intro = F.create_map(*[F.lit(x) for kv in R.SECRET_DESCRIPTIONS.items() for x in kv])
    base = F.concat(intro[detector], name, F.lit("."))
    base = F.when(
        detector == "trufflehog", F.concat(base, F.format_string(" Entropy: %.2f.", entropy_proxy(value)))
    ).otherwise(base)
    group = F.when(name == "Hostname", F.substring_index(value, ".", -1)).when(
        name == "Database Connection String", F.substring_index(value, ":", 1)
    )
    base = F.when(group.isNotNull(), F.concat(base, F.lit(" Captured groups: ('"), group, F.lit("',)."))).otherwise(base)
    snippet = F.substring(value, 1, 30)
    described = F.when(
        (snippet != "") & ~F.contains(base, snippet), F.concat(base, F.lit(" Evidence snippet: "), snippet, F.lit("..."))
    ).otherwise(base)
    return matches.select(
        *keep,
        types[detector].alias("finding_type"),
        severity(detector, name).alias("severity"),
        described.alias("description"),
        location(F.col("start"), F.col("end"), F.col(file_path) if file_path else None).alias("location"),
        value.alias("evidence"),
        detector.alias("detector"),
        name.alias("rule_id"),
        F.col("start"),
        F.col("end"),
        F.col("rule_no"),
        F.col("match_no"),
    )


def dedup(findings: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """First finding per (type, location, evidence[:64], detector) and document.

    ``min_by`` keeps the earliest row with map-side combining, so copies never
    gather in one task before they are reduced.
    """
    key = [*keep, "finding_type", "location", "_evidence_key", "detector"]
    keyed = findings.withColumn("_evidence_key", F.substring("evidence", 1, 64))
    rest = [c for c in keyed.columns if c not in key]
    return (
        keyed.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), F.struct("rule_no", "match_no")).alias("_r"))
        .select(*key, "_r.*")
        .select(*findings.columns)
    )


def secret_findings(
    df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = R.SECRET_RULES, file_path: str | None = None
) -> DataFrame:
    """Union of the three secret detectors, normalised and deduplicated."""
    kept = [*keep, file_path] if file_path and file_path not in keep else list(keep)
    return dedup(normalize(raw_matches(df, text, kept, rules), kept, file_path), kept)


def test_patterns(samples: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per sample: does the set of pattern names found equal the expected set?

    ``collect_set`` holds at most one entry per pattern name.
    """
    names = found.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("found"))
    empty = F.array().cast("array<string>")
    out = samples.join(names, key, "left").withColumn("found", F.coalesce("found", empty))
    return out.withColumn("success", F.col("found") == F.array_sort(F.array_distinct("expected")))
