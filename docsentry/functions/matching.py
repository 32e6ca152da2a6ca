"""Match-with-offset primitive shared by every detector.

``scan`` turns (text, rule set) into one row per match without a shuffle and
with one look in Python: a projection decides which rules hit a text at all (each
rule behind a pass of RE2, or a literal gate), only those (text, rule) pairs are expanded, and
offsets come from prefix sums over the matches and the pieces between them.
Offsets are code points, zero based, end exclusive, as ``re.finditer`` reports.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import may_match, pattern_counts
from .patterns import java

_BLOCK = 512


@dataclass(frozen=True)
class Rule:
    """One detection rule; ``gate`` is a conjunction of literal alternatives a match must contain."""

    name: str
    pattern: str
    flags: str = ""
    family: str = ""
    severity: str = "Medium"
    message: str = ""
    category: str = ""
    priority: str = ""
    weight: float = 1.0
    languages: tuple[str, ...] = ()
    gate: tuple[tuple[str, ...], ...] = ()
    groups: tuple[tuple[str, int], ...] = field(default=())
    #: The same language without needless backtracking, for the engine that scans; ``pattern`` where it is empty.
    scanned: str = ""

    @property
    def java_pattern(self) -> str:
        return java(self.scanned or self.pattern, self.flags)


def any_of(text: Column, literals: Iterable[str]) -> Column:
    """True when any literal occurs in ``text`` (plain substring test)."""
    out = F.lit(False)
    for literal in literals:
        out = out | F.contains(text, F.lit(literal))
    return out


def gate_column(lowered: Column, rule: Rule) -> Column:
    out = F.lit(True)
    for alternatives in rule.gate:
        out = out & any_of(lowered, [a.lower() for a in alternatives])
    return out


def _rule_struct(rule: Rule) -> Column:
    return F.struct(
        F.lit(rule.name).alias("rule_name"),
        F.lit(rule.family).alias("family"),
        F.lit(rule.java_pattern).alias("regex"),
        F.lit(rule.pattern).alias("pattern"),
        F.lit(rule.severity).alias("severity"),
        F.lit(rule.message).alias("message"),
        F.lit(rule.category).alias("category"),
        F.lit(rule.priority).alias("priority"),
        F.lit(float(rule.weight)).alias("weight"),
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, where a column cannot be staged in its own projection."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hit_rules(text: Column, lowered: Column, rules: Sequence[Rule], may: dict[int, Column] | None = None) -> Column:
    """Array of rule structs (in rule order) with at least one match in ``text``.

    ``may`` says for numbers of rules whether they can match at all; a rule that
    is not in it has its gate.
    """
    may = may or {}
    tests = [
        F.when(may.get(i, gate_column(lowered, r)) & text.rlike(r.java_pattern), F.struct(F.lit(i).alias("rule_no"), _rule_struct(r).alias("r")))
        for i, r in enumerate(rules)
    ]
    return F.array_compact(F.array(*tests))


def prefix_sums(steps: Column) -> Column:
    """Running totals of an int array, in blocks so long arrays stay near linear; each stage is computed once."""
    running = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    zero = F.array(F.lit(0))

    def split_blocks(values: Column) -> Column:
        n_blocks = F.ceil(F.size(values) / _BLOCK).cast("int")
        numbers = F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))

    def block_bases(blocks: Column) -> Column:
        return F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), zero, running)

    def totals(blocks: Column, bases: Column) -> Column:
        return F.flatten(
            F.transform(blocks, lambda b, i: F.slice(F.aggregate(b, F.array(F.element_at(bases, i + 1)), running), F.lit(2), F.lit(_BLOCK)))
        )

    return let(steps, lambda values: let(split_blocks(values), lambda blocks: let(block_bases(blocks), lambda bases: totals(blocks, bases))))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def staged_matches(
    df: DataFrame, text: str, regex: Column, group_numbers: dict[str, int] | None = None, lines: bool = False
) -> tuple[DataFrame, Column]:
    """A frame with the parts of all matches staged, and array<struct<match, end[, groups…][, _line]>> over them.

    Generators must take the returned column itself. Exploding a named column
    makes the optimizer infer a size filter on it and push that below the
    projection, which would run every regex again.
    """
    group_numbers = group_numbers or {}
    t = F.col(text)
    staged = df.withColumn("_m", F.regexp_extract_all(t, regex, F.lit(0))).withColumn(
        "_s", F.split(t, regex, F.lit(-1))
    )
    extra = []
    for alias, number in group_numbers.items():
        staged = staged.withColumn(f"_g_{alias}", F.regexp_extract_all(t, regex, F.lit(number)))
        extra.append(alias)
    steps = F.zip_with(
        F.col("_m"), F.slice(F.col("_s"), F.lit(1), F.size("_m")), lambda m, s: F.length(m) + F.length(s)
    )
    staged = staged.withColumn("_e", prefix_sums(steps))
    if lines:
        breaks = F.zip_with(
            F.col("_m"), F.slice(F.col("_s"), F.lit(1), F.size("_m")), lambda m, s: newlines(m) + newlines(s)
        )
        staged = staged.withColumn("_g__line", prefix_sums(breaks))
        extra.append("_line")
    fields = [
        F.col("_m").alias("match"),
        F.col("_e").alias("end"),
        *[F.col(f"_g_{a}").alias(a) for a in extra],
    ]
    return staged, F.arrays_zip(*fields)


def with_offsets(
    df: DataFrame, text: str, regex: Column, group_numbers: dict[str, int] | None = None, lines: bool = False
) -> DataFrame:
    """One row per match of ``regex`` in column ``text``: match_no, match, start, end (+ named groups).

    ``lines`` also adds the 1-based ``line`` of each match, from the same kind of prefix sum.
    """
    group_numbers = group_numbers or {}
    staged, matches = staged_matches(df, text, regex, group_numbers, lines)
    out = staged.select(*df.columns, F.posexplode(matches).alias("match_no", "_z"))
    return out.select(
        *df.columns,
        "match_no",
        F.col("_z.match").alias("match"),
        (F.col("_z.end") - F.length("_z.match")).alias("start"),
        F.col("_z.end").alias("end"),
        *[F.nullif(F.col(f"_z.{a}"), F.lit("")).alias(a) for a in group_numbers],
        *([(F.col("_z._line") - newlines(F.col("_z.match")) + 1).alias("line")] if lines else []),
    )


def scan(df: DataFrame, text: str, rules: Sequence[Rule], keep: Sequence[str], lines: bool = False) -> DataFrame:
    """Rows (keep…, text, rule fields, rule_no, match_no, match, start, end[, line]) for every match."""
    cols = list(dict.fromkeys([*keep, text]))
    # the lower-cased text is its own projection: every gate reads it, none recomputes it
    wide = {i: pattern for i, r in enumerate(rules) if (pattern := may_match(r.pattern, r.flags))}
    looked = pattern_counts(F.col(text), list(wide.values()), [False] * len(wide)) if wide else F.lit(None)
    staged = df.select(*cols, F.lower(text).alias("_lower"), looked.alias("_may"))
    may = {i: F.get("_may", F.lit(place)) > 0 for place, i in enumerate(wide)}
    hits = staged.select(*cols, F.explode(hit_rules(F.col(text), F.col("_lower"), rules, may)).alias("_h"))
    flat = hits.select(*cols, F.col("_h.rule_no").alias("rule_no"), "_h.r.*")
    return with_offsets(flat, text, F.col("regex"), lines=lines).drop("regex")


def context_window(text: str, start: str = "start", end: str = "end", width: int = 50) -> Column:
    """The match with ``width`` characters either side."""
    left = F.greatest(F.col(start) - width, F.lit(0))
    return F.substring(F.col(text), left + 1, F.col(end) - left + width)


def column_of(text: Column, offset: Column) -> Column:
    """1-based column of a 0-based offset."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1
