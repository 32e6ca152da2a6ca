"""Markdown security scan and structural validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.matching import Rule, scan
from .parse import strip

LINE_BREAK = r"\r\n|[\n\u000B\f\r\u001C-\u001E\u0085\u2028\u2029]"
_TAG = r"<[^>]*>"
_ATTRIBUTE = r"""\s([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""


def lines(text: Column) -> Column:
    """``str.splitlines``: every Unicode line break, no empty element after a final break."""
    parts = F.split(text, LINE_BREAK, F.lit(-1))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"(?U)\S")


def content_findings(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = R.MARKDOWN_RULES) -> DataFrame:
    """Script vectors, prompt injection and behaviour manipulation with spans and named groups."""
    found = scan(df, text, rules, keep)
    named = F.create_map().cast("map<string,string>")
    for rule in rules:
        if rule.groups:
            entries = [
                x
                for name, number in rule.groups
                for x in (F.lit(name), F.get(F.regexp_extract_all(F.col(text), F.lit(rule.java_pattern), F.lit(number)), F.col("match_no")))
            ]
            named = F.when(F.col("rule_name") == rule.name, F.map_filter(F.create_map(*entries), lambda _, v: v != "")).otherwise(named)
    return found.select(*keep, "family", "rule_name", "rule_no", "match_no", "pattern", "severity", "match", "start", "end", named.alias("groups"))


def lint(text: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(is_blank(text), F.lit("Markdown is empty.")),
            F.when(~F.contains(text, F.lit("# ")), F.lit("No top-level heading found.")),
        )
    )


def section_rules(text: Column) -> Column:
    """Missing sections, separators and tags expected in an llms.txt instruction file."""
    has = lambda s: F.contains(text, F.lit(s))
    missing = [
        F.when(
            ~(has(f"====\n\n{s}") | has(f"\n{s}\n\n====") | text.rlike(f"(?dm)^#+ {s}")),
            F.lit(f"Missing required section: '{s}'. Expected '==== {s} ====' or '# {s}'."),
        )
        for s in R.REQUIRED_SECTIONS
    ]
    tags = [
        F.when(~has("====="), F.lit("Missing '=====' separators, which are typical in llms.txt.")),
        F.when(has("TOOL USE") & ~has("<tool_name>"), F.lit("'TOOL USE' section found, but no '<tool_name>' tags detected, which might indicate malformed tool definitions.")),
        F.when(has("MODE") & ~has("<slug>"), F.lit("'MODES' section found, but no '<slug>' tags detected, which might indicate malformed mode definitions.")),
        F.when(has("OBJECTIVE") & ~has("<attempt_completion>"), F.lit("OBJECTIVE section is present, but no '<attempt_completion>' tag found. Ensure the agent can complete tasks.")),
    ]
    return F.array_compact(F.array(*missing, *tags))


def blank_line_stats(line_array: Column) -> tuple[Column, Column]:
    """(blank lines, longest run of blank lines) from a 0/1 string of the lines, without a window."""
    flags = F.array_join(F.transform(line_array, lambda x: F.when(is_blank(x), F.lit("1")).otherwise(F.lit("0"))), "")
    blank = F.length(flags) - F.length(F.replace(flags, F.lit("1"), F.lit("")))
    longest = F.coalesce(F.array_max(F.transform(F.split(flags, "0"), lambda r: F.length(r))), F.lit(0))
    return blank, longest


def abnormal_patterns(line_array: Column) -> Column:
    """Long lines, repeated characters, deep headings, blank-line excess, heading excess."""
    number = lambda i: (i + 1).cast("string")
    per_line = F.flatten(
        F.transform(
            line_array,
            lambda x, i: F.array_compact(
                F.array(
                    F.when(F.length(x) > 1000, F.concat(F.lit("Line "), number(i), F.lit(" is unusually long (>"), F.length(x).cast("string"), F.lit(" chars)."))),
                    F.when(x.rlike(r"(?d)(.)\1{30,}"), F.concat(F.lit("Line "), number(i), F.lit(" contains 30+ repeated characters."))),
                    F.when(x.rlike("^#{6,}"), F.concat(F.lit("Line "), number(i), F.lit(" uses a very deep heading level (H6+)."))),
                )
            ),
        )
    )
    total = F.size(line_array)
    blank, longest = blank_line_stats(line_array)
    headings = F.size(F.filter(line_array, lambda x: x.rlike("^#+ ")))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    whole = F.array_compact(
        F.array(
            F.when(blank > total / 2, text("Excessive empty lines: ", blank.cast("string"), " out of ", total.cast("string"), " lines.")),
            F.when(longest > 10, text("Excessive consecutive empty lines: ", longest.cast("string"), " lines.")),
            F.when(
                (headings > 50) & (total < 1000),
                text("Unusually high number of headings: ", headings.cast("string"), " headings in ", total.cast("string"), " lines."),
            ),
        )
    )
    return F.concat(per_line, whole)


def outline(line_array: Column) -> Column:
    """Trimmed heading lines in document order."""
    return F.transform(F.filter(line_array, lambda x: x.rlike("^#+ ")), strip)


def structure_report(df: DataFrame, text: str = "text", template: str | None = None) -> DataFrame:
    """Adds lint, custom_rules, abnormal_patterns and (with a template) the outline comparison."""
    out = df.withColumn("_lines", lines(F.col(text)))
    out = out.withColumn("lint", lint(F.col(text))).withColumn("custom_rules", section_rules(F.col(text)))
    out = out.withColumn("abnormal_patterns", abnormal_patterns(F.col("_lines")))
    if template is not None:
        wanted = outline(lines(F.lit(template)))
        out = out.withColumn("headings", outline(F.col("_lines"))).withColumn("matches_template", F.col("headings") == wanted)
    return out.drop("_lines")


def sanitize(html: Column) -> Column:
    """Keeps allow-listed tags, attributes and link protocols; drops comments; keeps the text of dropped tags."""
    clean = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    pieces = F.split(clean, _TAG, F.lit(-1))
    tags = F.regexp_extract_all(clean, F.lit(_TAG), F.lit(0))
    allowed = F.array(*[F.lit(t) for t in R.ALLOWED_TAGS])
    permitted = F.array(*[F.lit(f"{tag}.{a}") for tag, attrs in R.ALLOWED_ATTRIBUTES.items() for a in attrs])

    def rebuild(tag: Column) -> Column:
        name = F.lower(F.regexp_extract(tag, r"^</?\s*([a-zA-Z][a-zA-Z0-9]*)", 1))
        pairs = F.arrays_zip(
            F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1)).alias("k"),
            F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2)).alias("v"),
        )

        def keep(pair: Column) -> Column:
            key = F.lower(pair["k"])
            value = F.regexp_replace(pair["v"], r"""^["']|["']$""", "")
            scheme = F.lower(F.regexp_extract(value, r"^\s*([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
            named = F.array_contains(permitted, F.concat(name, F.lit("."), key)) | F.array_contains(permitted, F.concat(F.lit("*."), key))
            safe = ~key.isin(*R.URL_ATTRIBUTES) | (scheme == "") | scheme.isin(*R.ALLOWED_PROTOCOLS)
            return named & safe

        kept = F.transform(
            F.filter(pairs, keep),
            lambda p: F.concat(F.lit(" "), F.lower(p["k"]), F.lit('="'), F.regexp_replace(p["v"], r"""^["']|["']$""", ""), F.lit('"')),
        )
        return (
            F.when(~F.array_contains(allowed, name), F.lit(""))
            .when(F.startswith(tag, F.lit("</")), F.concat(F.lit("</"), name, F.lit(">")))
            .otherwise(F.concat(F.lit("<"), name, F.array_join(kept, ""), F.lit(">")))
        )

    return F.array_join(F.zip_with(pieces, F.transform(tags, rebuild), lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")
