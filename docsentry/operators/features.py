"""Content features as plain columns: text, code, markdown, security and metadata groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.linear import may_match, pattern_counts
from ..functions.patterns import java, re2
from .parse import raw_lines


def feature_names(sets: Sequence[str] = tuple(R.FEATURE_SETS)) -> list[str]:
    """Names in vector order for the enabled feature sets."""
    return [n for s in sets for n in R.FEATURE_SETS[s]]


def _count(text: Column, pattern: str, flags: str) -> Column:
    # the same count without rescanning a run of blank lines from each of its lines
    pattern = pattern.replace(r"^[\s]*", r"^[^\S\n]*")
    return F.regexp_count(text, F.lit(java(pattern, flags)))


def _flag(text: Column, pattern: str, flags: str) -> Column:
    # a run of base64 letters is tried from its start alone
    pattern = pattern.replace("[a-zA-Z0-9+/]{30,}={0,2}", "(?<![a-zA-Z0-9+/])[a-zA-Z0-9+/]{30}")
    return text.rlike(java(_without_host_loop(pattern), flags))


def _without_host_loop(pattern: str) -> str:
    """The same test for ``scheme//(label.)+ letters`` with a loop that Java runs without recursion, for hosts of any length.

    Labels that no two letters follow are passed over for good; the next one
    must have them. What comes after the letters is optional and tests nothing.
    """
    if r"\.)+" not in pattern:
        return pattern
    scheme, label = pattern.split(r"\.)+")[0].split("//(?:", 1)
    return rf"{scheme}//(?:{label}\.(?![a-zA-Z]{{2}}))*+{label}\.[a-zA-Z]{{2}}"


#: Every pattern of the features that is looked for in texts.
PATTERNS = {
    **R.CODE_COUNTS,
    **R.MARKDOWN_COUNTS,
    **R.SECURITY_FLAGS,
    **R.EVASION_COUNTS,
    "has_obfuscated_code": (R.OBFUSCATED_CODE, ""),
    "has_proper_structure": R.PROPER_STRUCTURE,
    "special_char_ratio": (R.SPECIAL_CHARACTER, ""),
    "language_count": (R.FENCE_LANGUAGE, ""),
    "max_heading_depth": R.HEADING_LEVEL,
}
_FLAGS = (*R.SECURITY_FLAGS, "has_obfuscated_code", "has_proper_structure")
#: Columns that hold an extracted part of the match, for which a look by RE2 is a gate alone.
_EXTRACTED = ("language_count", "max_heading_depth")


def _same_in_re2(name: str) -> bool:
    """Whether RE2 finds the same matches as Java: no word boundary, no word character, no case folding."""
    pattern, flags = PATTERNS[name]
    return name not in _EXTRACTED and "i" not in flags and not any(part in pattern for part in (r"\b", r"\w"))


_BY_SET = {
    "text_statistics": ("special_char_ratio",),
    "code_patterns": (*R.CODE_COUNTS, "has_obfuscated_code", "language_count"),
    "markdown_structure": (*R.MARKDOWN_COUNTS, "max_heading_depth", "has_proper_structure"),
    "security_indicators": (*R.SECURITY_FLAGS, *R.EVASION_COUNTS),
}


def _look(df: DataFrame, text: str, sets: Sequence[str]) -> DataFrame:
    """Adds ``_looked``: for each pattern of ``sets`` its count in the text, or 0 where it cannot match; one pass for all of them."""
    if "_looked" in df.columns:
        return df
    names = [n for s in sets if s in _BY_SET for n in _BY_SET[s]]
    if not names:
        return df
    wanted = [re2(*PATTERNS[n]) if _same_in_re2(n) else may_match(*PATTERNS[n]) or "" for n in names]
    counts = pattern_counts(F.col(text), wanted, [_same_in_re2(n) and n not in _FLAGS for n in names])
    return df.withColumn("_counts", counts).withColumn("_looked", F.struct(*[F.get("_counts", F.lit(i)).alias(n) for i, n in enumerate(names)])).drop("_counts")


def _gated_count(text: Column, name: str, pattern: str, flags: str) -> Column:
    found = F.col(f"_looked.{name}")
    count = found if _same_in_re2(name) else F.when(found > 0, _count(text, pattern, flags)).otherwise(F.lit(0))
    return F.when(text.isNotNull(), count)


def _gated_flag(text: Column, name: str, pattern: str, flags: str) -> Column:
    found = F.col(f"_looked.{name}") > 0
    return F.when(text.isNotNull(), found if _same_in_re2(name) else found & _flag(text, pattern, flags))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(R.WORD), F.lit(0))


def with_text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    had, df = "_looked" in df.columns, _look(df, text, ["text_statistics"])
    staged = df.withColumn("_words", words(t)).withColumn("_n", F.size("_words"))
    total = F.length(F.array_join("_words", ""))
    n_lines = F.size(raw_lines(t))
    out = staged.withColumns(
        {
            "line_count": n_lines,
            "char_count": F.length(t),
            "word_count": F.col("_n"),
            "avg_line_length": (F.length(t) - n_lines + 1) / n_lines,
            "avg_word_length": F.when(F.col("_n") > 0, total / F.col("_n")).otherwise(F.lit(0.0)),
            "unique_words": F.size(F.array_distinct("_words")),
            "special_char_ratio": F.when(F.length(t) > 0, F.col("_looked.special_char_ratio") / F.length(t)).otherwise(F.lit(0.0)),
        }
    )
    diversity = F.when(F.col("_n") > 0, F.col("unique_words") / F.col("_n")).otherwise(F.lit(0.0))
    return out.withColumn("lexical_diversity", diversity).drop("_words", "_n", *([] if had else ["_looked"]))


def fence_languages(text: Column) -> Column:
    """Lower-cased fence languages except plain text ones, with repeats."""
    found = F.transform(F.regexp_extract_all(text, F.lit(java(R.FENCE_LANGUAGE)), F.lit(1)), F.lower)
    return F.filter(found, lambda x: ~x.isin("", *R.PLAIN_LANGUAGES))


def with_code_patterns(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    had, df = "_looked" in df.columns, _look(df, text, ["code_patterns"])
    counts = {n: _gated_count(t, n, p, f) for n, (p, f) in R.CODE_COUNTS.items()}
    languages = F.when(F.col("_looked.language_count") > 0, F.size(F.array_distinct(fence_languages(t)))).otherwise(F.lit(0))
    out = df.withColumns(
        {**counts, "has_obfuscated_code": _gated_flag(t, "has_obfuscated_code", R.OBFUSCATED_CODE, ""), "language_count": F.when(t.isNotNull(), languages)}
    )
    return out if had else out.drop("_looked")


def with_markdown_structure(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    had, df = "_looked" in df.columns, _look(df, text, ["markdown_structure"])
    depths = F.transform(F.regexp_extract_all(t, F.lit(java(*R.HEADING_LEVEL)), F.lit(1)), F.length)
    depth = F.when(F.col("_looked.max_heading_depth") > 0, F.array_max(depths))
    counts = {n: _gated_count(t, n, p, f) for n, (p, f) in R.MARKDOWN_COUNTS.items()}
    out = df.withColumns({**counts, "max_heading_depth": F.coalesce(depth, F.lit(0)), "has_proper_structure": _gated_flag(t, "has_proper_structure", *R.PROPER_STRUCTURE)})
    return out if had else out.drop("_looked")


def with_security_indicators(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    had, df = "_looked" in df.columns, _look(df, text, ["security_indicators"])
    flags = {n: _gated_flag(t, n, p, f) for n, (p, f) in R.SECURITY_FLAGS.items()}
    out = df.withColumns({**flags, **{n: _gated_count(t, n, p, f) for n, (p, f) in R.EVASION_COUNTS.items()}})
    return out if had else out.drop("_looked")


def with_metadata(df: DataFrame, text: str = "text", url: str = "url") -> DataFrame:
    address = F.coalesce(F.col(url), F.lit(""))
    return df.withColumns(
        {"url_length": F.length(address), "has_suspicious_domain": _flag(address, R.SUSPICIOUS_DOMAIN, ""), "content_size": F.length(text), "has_analysis_history": F.lit(False)}
    )


def extract(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), sets: Sequence[str] = tuple(R.FEATURE_SETS), url: str = "url", history: DataFrame | None = None) -> DataFrame:
    """All enabled feature columns, the feature version, and ``features`` (array<double> in a fixed order).

    One projection over the text; the text itself is dropped before anything is shuffled.
    """
    builders = {"text_statistics": with_text_statistics, "code_patterns": with_code_patterns, "markdown_structure": with_markdown_structure, "security_indicators": with_security_indicators}
    out = df.select(*dict.fromkeys([*keep, text, *([url] if "metadata" in sets and url in df.columns else [])]))
    out = _look(out, text, sets)
    for name in sets:
        if name in builders:
            out = builders[name](out, text)
    if "metadata" in sets:
        out = with_metadata(out if url in out.columns else out.withColumn(url, F.lit("")), text, url)
    columns = [c for c in out.columns if c not in (text, "_looked") and (c != url or url in keep)]
    out = out.select(*columns)
    if "metadata" in sets and history is not None:
        known = history.select(keep[0]).distinct().withColumn("_known", F.lit(True))
        out = out.join(known, keep[0], "left").withColumn("has_analysis_history", F.coalesce("_known", F.lit(False))).drop("_known")
    vector = F.array(*[F.col(n).cast("double") for n in feature_names(sets)])
    return out.withColumn("feature_version", F.lit(R.FEATURE_VERSION)).withColumn("features", vector)


def finding_vector(content_vector: Column, finding_type: Column, severity: Column, evidence: Column, location: Column, remediation: Column) -> Column:
    """Content features followed by the 11 finding features (types, severities, presence flags)."""
    one = lambda test: F.coalesce(test, F.lit(False)).cast("double")
    filled = lambda c: one(c.isNotNull() & (c != ""))
    parts = [one(finding_type == t) for t in R.FINDING_FEATURE_TYPES] + [one(severity == s) for s in R.FINDING_FEATURE_SEVERITIES] + [filled(evidence), filled(location), filled(remediation)]
    return F.concat(content_vector, F.array(*parts))


def finding_feature_names() -> list[str]:
    return [*feature_names(), *[f"type_{t}" for t in R.FINDING_FEATURE_TYPES], *[f"severity_{s}" for s in R.FINDING_FEATURE_SEVERITIES], "has_evidence", "has_location", "has_remediation"]
