"""Patterns looked for by RE2, in time linear in the text, over whole Arrow batches.

Spark's own engine decides what matches; here texts are told apart that cannot
match at all, and patterns on which both engines agree are counted. Pickled by
value, so that executors need no copy of the package.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .patterns import java, re2

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Letters that Java takes for i, s or k in either case, and RE2 does not all.
_FOLDED = r"(?-i:[\x{17F}\x{212A}\x{130}\x{131}])"
# what RE2 lacks, or where a shorter text would have to be looked at
_UNKNOWN = re.compile(r"\(\?(?:[=!>]|<[=!])|[*+?}]\+|\\[1-9]|\\[AZzBGQEkKpPuNRX]|(?<!\\)&&|\(\?P=")
_NEGATED_CLASS = re.compile(r"\[\^(?:\\.|[^\]\\])*\\[wW]|\[(?:\\.|[^\]\\])*\\[WSD]")
_PLAIN_GROUP = r"\((?:\?:)?([^()\[\]]*)\)"


def _keeps_boundary(before: str, after: str) -> bool:
    """Whether an ASCII word character certainly stands on one side of a word boundary.

    The other side is then no word character at all, and no ASCII one, so that
    RE2's boundary, which knows ASCII alone, is there as well.
    """
    if "\\x" in before + after or "\\u" in before + after:
        return False
    group = re.match(_PLAIN_GROUP + r"(?![?*{])", after)
    starts = group[1].split("|") if group else [after]
    group = re.search(_PLAIN_GROUP + "$", before)
    ends = group[1].split("|") if group else [before]
    return all(re.match(r"[A-Za-z0-9_](?![?*{])", x) for x in starts) or all(re.search(r"(?<!\\)[A-Za-z0-9_]$", x) for x in ends)


def may_match(pattern: str, flags: str = "") -> str | None:
    """An RE2 pattern that matches at least the texts that ``pattern`` matches in Java; None where there is no simple one.

    Word boundaries go where RE2's may differ, word characters are any characters but spaces. A text
    that does not match it needs no look by Java's engine.
    """
    end = "$" in re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern) and "m" not in flags
    if end or _UNKNOWN.search(pattern) or _NEGATED_CLASS.search(pattern):
        return None
    wide, in_class = [], False
    for token in re.finditer(r"\\.|.", pattern, re.S):
        part = token[0]
        if part == r"\b" and not _keeps_boundary(pattern[: token.start()], pattern[token.end() :]):
            continue
        if part == r"\w":
            # in a class: letters, marks, numbers, connectors, joiners, and symbols, some of which count as letters
            part = r"\w\p{M}\p{Pc}\p{S}\x{200C}\x{200D}" if in_class else r"\S"
        elif part == r"\W":
            part = r"[\x{0}-\x{10FFFF}]"
        elif part == "[":
            in_class = True
        elif part == "]":
            in_class = False
        wide.append(part)
    out = re2("".join(wide), flags)
    if "i" in flags and java(pattern, flags).startswith("(?dU"):
        out = f"{out}|{_FOLDED}"
    try:
        pc.match_substring_regex(pa.array([""]), out)
    except pa.ArrowInvalid:
        return None
    return out


def pattern_counts(text: Column, patterns: Sequence[str], counted: Sequence[bool]) -> Column:
    """array<int> with an entry for each RE2 pattern: how often it matches where ``counted``, else 1 if it does and 0 if not.

    The text goes to Python once for all patterns. Null texts have zeros.
    """

    def run(texts: pa.Array) -> pa.Array:
        columns = [
            (pc.count_substring_regex if number else pc.match_substring_regex)(texts, pattern).cast(pa.int32()).fill_null(0).to_numpy(zero_copy_only=False)
            for pattern, number in zip(patterns, counted, strict=True)
        ]
        flat = np.stack(columns, axis=1).reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(patterns)), pa.array(flat, pa.int32()))

    # not deterministic in name alone: the optimizer would work it out once for each entry that is read
    return F.arrow_udf(run, ArrayType(IntegerType())).asNondeterministic()(F.make_valid_utf8(text))
