"""Regex dialect helpers.

Rules are written once, in Python ``re`` syntax. Spark evaluates them with
``java.util.regex``; the flags below make the two agree on text in any language:

* ``d``  only ``\\n`` ends a line, so ``.``, ``^`` and ``$`` behave as in Python
* ``U``  ``\\w \\d \\s \\b`` and case folding follow Unicode, as Python ``str`` patterns do
"""

from __future__ import annotations

import re

_NAMED = re.compile(r"\(\?P<(\w+)>")
_UNICODE_ESCAPE = re.compile(r"\\[wWdDsSbB]")

# the same classes spelled for engines whose \w \d \s are ASCII only
_WORD, _DIGIT = r"\p{L}\p{N}_", r"\p{Nd}"
_SPACE = r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def java(pattern: str, flags: str = "") -> str:
    """Python-syntax pattern -> the pattern string Spark should run."""
    body = _NAMED.sub(lambda m: "(?<" + m.group(1).replace("_", "") + ">", pattern)
    unicode_flag = "U" if _UNICODE_ESCAPE.search(pattern) else ""
    return f"(?d{unicode_flag}{flags})" + body


def re2(pattern: str, flags: str = "") -> str:
    """The same pattern for RE2, which the SQL cross-checks run on."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\w", r"\s", r"\d"):
            body = {"w": _WORD, "s": _SPACE, "d": _DIGIT}[two[1]]
            out.append(body if in_class else f"[{body}]")
            i += 2
        elif two == r"\S":
            out.append(f"[^{_SPACE}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            if two[0] == "[" and not in_class:
                in_class = True
            elif two[0] == "]" and in_class and pattern[i - 1] not in "[^":
                in_class = False
            out.append(two[0])
            i += 1
    mode = flags if "s" in flags else flags + "-s"
    return f"(?{mode})" + "".join(out)


def sql_str(text: str) -> str:
    """Text as a single-quoted SQL literal."""
    return "'" + text.replace("'", "''") + "'"
