"""Code rules on fenced blocks, with the fallback scan for content too complex for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.matching import Rule, column_of, newlines, scan, staged_matches, with_offsets
from ..functions.scale import broadcast_small
from ..session import materialize
from . import gates
from .parse import FENCE, code_blocks, strip

FINDING_COLUMNS = ("rule_id", "path", "start_line", "start_col", "end_line", "end_col", "message", "category", "priority", "severity")


def rule_table(spark: SparkSession, rules: Sequence[Rule] = R.CODE_RULES) -> DataFrame:
    """Code rules as rows: id, languages, message, severity, category, priority, pattern, cwe."""
    rows = [
        (r.name, list(r.languages), r.message, r.severity, r.category, r.priority, r.java_pattern, R.CODE_RULE_CWE.get(r.name))
        for r in rules
    ]
    schema = "id string, languages array<string>, message string, severity string, category string, priority string, pattern string, cwe string"
    return spark.createDataFrame(rows, schema)


def rules_for_language(rules: DataFrame, language: str) -> DataFrame:
    return rules.where(F.array_contains(F.transform("languages", F.lower), language.lower()))


def priority_severity(priority: Column) -> Column:
    lowered = F.lower(priority)
    return F.when(lowered.isin("high", "critical"), F.lit("High")).when(lowered == "low", F.lit("Low")).otherwise(F.lit("Medium"))


def rebase(line: Column, block_start: Column) -> Column:
    """Line inside a block -> line in the document."""
    return F.coalesce(line + block_start - 1, line)


def block_findings(blocks: DataFrame, rules: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rules joined to blocks on language, then matched; unsupported languages are skipped.

    The rule side is configuration, a handful of rows however large the corpus;
    it is broadcast after a size check, and blocks are then never shuffled.
    """
    by_language = rules.select(
        F.explode("languages").alias("_rule_language"), F.col("id").alias("rule_id"), "message", "category", "priority", "pattern", "cwe"
    )
    usable = blocks.where(gates.is_supported(F.col("language"))).withColumn("_language", gates.canonical_language(F.col("language")))
    joined = usable.join(broadcast_small(by_language), F.col("_language") == F.lower("_rule_language")).where(F.rlike(F.col("code"), F.col("pattern")))
    hits = with_offsets(joined, "code", F.col("pattern"), lines=True)
    end_line = F.col("line") + newlines(F.col("match"))
    return hits.select(
        doc_id,
        "block_no",
        "rule_id",
        F.concat(F.lit("item-"), F.col(doc_id).cast("string")).alias("path"),
        rebase(F.col("line"), F.col("line_start")).alias("start_line"),
        column_of(F.col("code"), F.col("start")).alias("start_col"),
        rebase(end_line, F.col("line_start")).alias("end_line"),
        column_of(F.col("code"), F.col("end")).alias("end_col"),
        "message",
        F.coalesce("category", F.lit("Uncategorized")).alias("category"),
        F.coalesce("priority", F.lit("Medium")).alias("priority"),
        priority_severity(F.coalesce("priority", F.lit("Medium"))).alias("severity"),
        "cwe",
        F.col("match").alias("evidence"),
    )


def content_findings(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Five content patterns with line and column in every document; documents of very complex content get one more row that says so."""
    complex_docs = df.where(gates.is_complex(F.col(text)))
    hits = scan(df, text, R.FALLBACK_RULES, [doc_id], lines=True)
    snippet = F.when(F.length("match") > 100, F.concat(F.substring("match", 1, 100), F.lit("..."))).otherwise(F.col("match"))
    path = F.concat(F.lit("item-"), F.col(doc_id).cast("string"))
    found = hits.select(
        doc_id,
        F.col("rule_name").alias("rule_id"),
        path.alias("path"),
        F.col("line").alias("start_line"),
        column_of(F.col(text), F.col("start")).alias("start_col"),
        (F.col("line") + newlines(F.col("match"))).alias("end_line"),
        column_of(F.col(text), F.col("end")).alias("end_col"),
        "message",
        "category",
        "priority",
        priority_severity(F.col("priority")).alias("severity"),
        snippet.alias("evidence"),
    )
    marker = complex_docs.select(
        doc_id,
        F.lit("alternative_analysis_used").alias("rule_id"),
        path.alias("path"),
        *[F.lit(1).alias(c) for c in ("start_line", "start_col", "end_line", "end_col")],
        F.lit("Complex generic content analyzed with alternative method instead of semgrep").alias("message"),
        F.lit("Info").alias("category"),
        F.lit("Low").alias("priority"),
        F.lit("Low").alias("severity"),
        F.lit(None).cast("string").alias("evidence"),
    )
    return found.unionByName(marker)


def error_findings(items: DataFrame, error: str = "processing_error", doc_id: str = "doc_id", expected: bool = True) -> DataFrame:
    """Rows whose analysis failed, as findings, so a bad item never stops a batch."""
    rule, prefix, priority = (
        ("static_analysis_error", "Static analysis error: ", "Medium") if expected else ("static_analysis_unexpected_error", "Unexpected error: ", "High")
    )
    return items.where(F.col(error).isNotNull()).select(
        doc_id,
        F.lit(rule).alias("rule_id"),
        F.col(doc_id).cast("string").alias("path"),
        *[F.lit(1).alias(c) for c in ("start_line", "start_col", "end_line", "end_col")],
        F.concat(F.lit(prefix), F.col(error)).alias("message"),
        F.lit("Error").alias("category"),
        F.lit(priority).alias("priority"),
        priority_severity(F.lit(priority)).alias("severity"),
    )


def dedup(findings: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """First finding per (rule, path, span); block order decides, and partial aggregation runs map side."""
    key = [doc_id, "rule_id", "path", "start_line", "start_col", "end_line", "end_col"]
    rest = [c for c in findings.columns if c not in key]
    order = F.struct(*[c for c in ("block_no", "message") if c in rest])
    return findings.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def stored_or_parsed_blocks(docs: DataFrame, stored: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Stored blocks where a document has any, otherwise blocks parsed from its text."""
    parsed = code_blocks(docs.join(stored.select(doc_id).distinct(), doc_id, "left_anti"), text, (doc_id,))
    return stored.select(*parsed.columns).unionByName(parsed)


def code_facts(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """What the code rules need from each document, in one pass: sizes, broken limit and all code blocks."""
    t = F.col(text)
    gated = df.select(doc_id, text, F.length(t).alias("n_chars"), gates.line_count(t).alias("n_lines"), gates.limit_rule(t).alias("broken_limit"))
    found, matches = staged_matches(gated, text, F.lit(FENCE), {"info": 1, "code": 2}, lines=True)
    blocks = F.transform(
        matches,
        lambda z, i: F.struct(
            i.alias("block_no"),
            F.coalesce(F.nullif(strip(z["info"]), F.lit("")), F.lit("text")).alias("language"),
            z["code"].alias("code"),
            (z["_line"] - newlines(z["match"]) + 1).alias("line_start"),
        ),
    )
    return found.select(doc_id, "n_chars", "n_lines", "broken_limit", blocks.alias("blocks"))


def static_findings(df: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: DataFrame | None = None) -> DataFrame:
    """The whole code-rule family over every document: block rules, content patterns, and a finding more for a document over a limit.

    Sizes and blocks go to shared storage for two of the branches; the content
    patterns read the texts, so no text is written or shuffled.
    """
    rules = rules if rules is not None else rule_table(df.sparkSession)
    facts = materialize(code_facts(df, text, doc_id), "code-facts")
    block_rows = block_findings(facts.select(doc_id, F.inline("blocks")), rules, doc_id)
    content = content_findings(df.select(doc_id, text), text, doc_id)
    limits = gates.limit_findings(facts, doc_id).select(
        "*",
        F.concat(F.lit("item-"), F.col(doc_id).cast("string")).alias("path"),
        *[F.lit(1).alias(c) for c in ("start_line", "start_col", "end_line", "end_col")],
        priority_severity(F.col("priority")).alias("severity"),
    )
    everything = block_rows.unionByName(content, allowMissingColumns=True)
    return dedup(everything.unionByName(limits, allowMissingColumns=True), doc_id)
