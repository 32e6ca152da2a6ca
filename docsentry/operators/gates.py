"""Cheap tests of documents: limits, complexity, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.matching import any_of, let


def literal_count(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def canonical_language(language: Column) -> Column:
    """Lower case, alias, and ``generic`` for anything unsupported."""
    aliases = F.create_map(*[F.lit(x) for kv in R.LANGUAGE_ALIASES.items() for x in kv])
    lowered = F.lower(language)
    named = F.coalesce(aliases[lowered], lowered)
    return F.when(named.isin(*R.SUPPORTED_LANGUAGES), named).otherwise(F.lit("generic"))


def is_supported(language: Column) -> Column:
    return F.lower(language).isin(*R.SUPPORTED_LANGUAGES)


def line_count(text: Column) -> Column:
    return literal_count(text, "\n") + 1


def limit_rule(text: Column, max_chars: int = R.MAX_CONTENT_CHARS, max_lines: int = R.MAX_CONTENT_LINES) -> Column:
    """Name of the limit a document breaks, or null."""
    return F.when(F.length(text) > max_chars, F.lit("content_size_limit_exceeded")).when(
        line_count(text) > max_lines, F.lit("content_line_limit_exceeded")
    )


def is_complex(text: Column) -> Column:
    """Too complex for generic-language code rules (literal markers counted, not regexes)."""
    out = (F.length(text) > R.COMPLEX_CHARS) | (literal_count(text, "\n") > R.COMPLEX_NEWLINES)
    for marker in R.COMPLEX_MARKERS:
        out = out | (literal_count(text, marker) > R.COMPLEX_MARKER_COUNT)
    return out


def document_cost(text: Column, language: Column) -> Column:
    """Relative analysis cost of a document: 60…300, from size, lines, markers and language."""
    markers = F.lit(0)
    for marker in R.COST_MARKERS:
        markers = markers + F.least(literal_count(text, marker), F.lit(10))
    total = (
        F.lit(60.0)
        + F.least(F.length(text) / 10240, F.lit(60.0))
        + F.least(line_count(text) / 100, F.lit(30.0))
        + markers
        + F.when(F.lower(language).isin("generic", "markdown", "md"), 30).otherwise(0)
    )
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(60.0)).otherwise(F.least(total, F.lit(300.0)))


def limit_findings(facts: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One Performance finding per document over a limit, from (n_chars, n_lines, broken_limit); it adds to their other findings."""
    n = lambda c: F.col(c).cast("string")
    message = F.when(
        F.col("broken_limit") == "content_size_limit_exceeded",
        F.concat(F.lit("Content size ("), n("n_chars"), F.lit(f" bytes) exceeds maximum allowed size ({R.MAX_CONTENT_CHARS} bytes)")),
    ).otherwise(F.concat(F.lit("Content line count ("), n("n_lines"), F.lit(f") exceeds maximum allowed lines ({R.MAX_CONTENT_LINES})")))
    return facts.where("broken_limit IS NOT NULL").select(
        doc_id, F.col("broken_limit").alias("rule_id"), F.lit("Performance").alias("category"), F.lit("Medium").alias("priority"), message.alias("message")
    )


def severity_rank(severity: Column) -> Column:
    """1…5 for INFO…CRITICAL; unknown or missing counts as INFO."""
    levels = F.array(*[F.lit(x) for x in R.ALERT_LEVELS])
    return F.greatest(F.coalesce(F.array_position(levels, F.upper(severity)), F.lit(1)), F.lit(1))


def above_threshold(severity: Column, threshold: str) -> Column:
    return severity_rank(severity) >= R.ALERT_LEVELS.index(threshold.upper()) + 1


def mentions_any(text: Column, keywords: list[str]) -> Column:
    """Any keyword in the text, ignoring case."""
    return let(F.lower(text), lambda lowered: any_of(lowered, [k.lower() for k in keywords]))
