"""Extension points: analyzers, pattern rules, context predicates and alert hooks."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import Rule, scan
from .findings import union_findings

Analyzer = Callable[[DataFrame], DataFrame]


@dataclass
class AnalyzerRegistry:
    """Named functions from documents to findings; all run in one plan as a union."""

    analyzers: dict[str, Analyzer] = field(default_factory=dict)

    def register(self, name: str, analyzer: Analyzer) -> None:
        self.analyzers[name] = analyzer

    def run(self, docs: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        chosen = list(names or self.analyzers)
        return union_findings(*[self.analyzers[n](docs).withColumn("analyzer", F.lit(n)) for n in chosen])


def pattern_rules(specs: Sequence[dict]) -> tuple[list[Rule], list[dict]]:
    """(usable rules, rejected specs) from {id, regex, description, severity} dictionaries.

    A pattern that is empty, does not compile or can match the empty string is
    rejected: offsets are defined for non-empty matches only.
    """
    good, bad = [], []
    for spec in specs:
        regex = spec.get("regex") or ""
        try:
            usable = bool(regex) and re.compile(regex, re.MULTILINE).match("") is None
        except re.error:
            usable = False
        if usable:
            good.append(Rule(name=spec.get("id", "unknown"), pattern=regex, flags="m", family="custom_pattern", severity=spec.get("severity", "MEDIUM").upper(), message=spec.get("description", "")))
        else:
            bad.append(spec)
    return good, bad


def custom_pattern_findings(df: DataFrame, specs: Sequence[dict], text: str = "text", keep: Sequence[str] = ("doc_id",), confidence: float = 0.7) -> DataFrame:
    """Findings of caller-supplied patterns with the line of each match; bad patterns are skipped."""
    rules, _ = pattern_rules(specs)
    hits = scan(df, text, rules, keep, lines=True)
    return hits.select(*keep, F.col("rule_name").alias("type"), "severity", F.col("message").alias("description"), "line", "match", F.lit(confidence).alias("confidence"))


def match_with_context(df: DataFrame, rules: Sequence[Rule], accept: dict[str, Callable[[Column, Column, Column], Column]], text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Rule matches filtered by per-rule predicates of (text, start, end) columns."""
    hits = scan(df, text, rules, keep)
    test = F.lit(True)
    for name, predicate in accept.items():
        test = F.when(F.col("rule_name") == name, predicate(F.col(text), F.col("start"), F.col("end"))).otherwise(test)
    return hits.where(test).select(*keep, F.col("rule_name").alias("name"), "match", "start", "end")


def alert_hooks(*hooks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One ``foreachBatch`` function that calls every hook with the batch."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for hook in hooks:
                hook(batch, epoch)
        finally:
            batch.unpersist()

    return run
