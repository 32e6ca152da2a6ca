"""SQL text for the cross-checks, generated from the same rule rows."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.matching import Rule
from ..functions.patterns import re2, sql_str

START_LIST = (
    "list_transform(range(1, len(m) + 1), lambda i: "
    "cast(list_sum(list_transform(s[1:i], lambda x: length(x))) "
    "+ coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as bigint))"
)


def find_all_sql(src: str, keep: str, text: str, pattern: str, flags: str = "", consts: str = "", groups: dict[str, int] | None = None) -> str:
    """SELECT keep, consts, match_no, match, start, end, text for every match."""
    p = sql_str(re2(pattern, flags))
    extra = "".join(f", regexp_extract_all({text}, {p}, {n}) AS g_{g}" for g, n in (groups or {}).items())
    out = "".join(f", nullif(unnest(g_{g}), '') AS {g}" for g in (groups or {}))
    return (
        f"SELECT *, start + length(match) AS \"end\" FROM (SELECT {keep}{', ' + consts if consts else ''}, {text}, "
        f"unnest(range(0, len(m))) AS match_no, unnest(m) AS match, unnest({START_LIST}) AS start{out} FROM ("
        f"SELECT {keep}, {text}, regexp_extract_all({text}, {p}, 0) AS m, regexp_split_to_array({text}, {p}) AS s{extra} "
        f"FROM {src} WHERE regexp_matches({text}, {p})))"
    )


def scan_sql(src: str, keep: str, text: str, rules: Sequence[Rule]) -> str:
    """UNION ALL of every rule's matches with its name, family, severity…"""
    parts = []
    for i, r in enumerate(rules):
        consts = (
            f"{i} AS rule_no, {sql_str(r.name)} AS rule_name, {sql_str(r.family)} AS family, {sql_str(r.severity)} AS severity, "
            f"{sql_str(r.category)} AS category, {sql_str(r.message)} AS message, {sql_str(r.priority)} AS priority, "
            f"{float(r.weight)} AS weight, {len(r.pattern)} AS pattern_length"
        )
        parts.append(find_all_sql(src, keep, text, r.pattern, r.flags, consts))
    return "(" + " UNION ALL ".join(parts) + ")"


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {sql_str(str(k))} THEN {sql_str(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def contains_any(text: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {sql_str(w)})" for w in words) + ")" if words else "false"
