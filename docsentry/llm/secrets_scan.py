"""Secret scan with sliding-window entropy, in DataFrame functions only.

Three fixed rules give the base spans. On top, candidate strings (runs of
token characters) are put in the narrowest character class that holds them, a
window slides over each, and the Shannon entropy of the window is kept up to
date by counts: one symbol enters, one leaves. A candidate whose best window
reaches its class's threshold is a span of kind ``entropy``, unless the
allow-list covers it. Words inside a candidate cover themselves only: what is
left without them is tested like a candidate of its own. The SQL of the query
lets a word discard its whole candidate, so it has fewer spans on such texts.

Everything is a projection over the scan: no shuffle, no explode, work linear
in the text. Offsets are code points, end exclusive. A null text counts as
empty: no spans, the digest of the empty string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsentry.functions.matching import let, prefix_sums

from .common import set_columns

# The base rules. Letters of the first are spelt in both cases, so that no engine folds other letters to them.
ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings for the entropy test.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20

#: The same patterns as they are run: an assignment is tried where its first letter fits, runs only where they begin.
SCANNED = ("(?=[pPsStTaA])" + ASSIGN, ACCESS, "(?<![0-9a-f])" + HEX, "(?<![A-Za-z0-9+/_=-])" + CANDIDATE)


@dataclass(frozen=True)
class CharClass:
    """Symbols of a class and the entropy, in bits, that a window of it must reach."""

    name: str
    alphabet: str
    threshold: float


#: Narrowest first. A window of 20 symbols holds at most log2(20) = 4.32 bits.
CLASSES = (
    CharClass("hex", "0123456789abcdef", 3.05),
    CharClass("hex_upper", "0123456789ABCDEF", 3.05),
    CharClass("lower_alnum", "0123456789abcdefghijklmnopqrstuvwxyz", 3.65),
    CharClass("upper_alnum", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.65),
    CharClass("base64", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 3.85),
)

#: Candidates that are no secrets whatever their entropy: no digit in them, digits and marks only, UUIDs, dates and
#: versions chained by marks, and anything with a word of six or more lower-case letters in it (paths, slugs, names).
ALLOW = (
    "^[^0-9]*$",
    "^[0-9+/_=-]*$",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(^|[/_=+-])[A-Z]?[a-z]{6,}([/_=+-]|$)",
)
#: A word of the last pattern with the mark behind it, and one that ends its candidate.
WORD = "(?<![^/_=+-])[A-Z]?[a-z]{6,}(?:[/_=+-]|$)"
LAST_WORD = "(?<![^/_=+-])[A-Z]?[a-z]{6,}$"


def _entropy_peak(text: Column, alphabet: str, window: int) -> Column:
    """Largest entropy of any window of ``text`` over ``alphabet``; counts change by the symbol that enters and the one that leaves."""
    size = len(alphabet)
    weight = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    symbols = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c))
    start = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("peak"))

    def step(state: Column, move: Column) -> Column:
        counts, enter, leave, i = state["counts"], move["enter"], move["leave"], move["i"]
        plus = F.element_at(counts, enter)
        minus = F.when(leave > 0, F.element_at(counts, F.greatest(leave, F.lit(1))))
        gained = F.when(leave == enter, F.lit(0.0)).otherwise(
            weight(plus + 1) - weight(plus) + F.when(leave > 0, weight(minus - 1) - weight(minus)).otherwise(F.lit(0.0))
        )
        moved = F.transform(
            counts, lambda c, j: c + F.when(j + 1 == enter, 1).otherwise(0) - F.when(j + 1 == leave, 1).otherwise(0)
        )
        entropy = F.when(i >= window, F.log2(F.lit(float(window))) - (state["s"] + gained) / window).otherwise(F.lit(0.0))
        return F.struct(moved.alias("counts"), (state["s"] + gained).alias("s"), F.greatest(state["peak"], entropy).alias("peak"))

    def moves(s: Column) -> Column:
        leaving = F.concat(F.array_repeat(F.lit(0), window), s)
        return F.zip_with(s, F.slice(leaving, F.lit(1), F.size(s)), lambda a, b: F.struct(a.alias("enter"), b.alias("leave")))

    numbered = F.transform(let(symbols, moves), lambda m, j: F.struct(m["enter"].alias("enter"), m["leave"].alias("leave"), (j + 1).alias("i")))
    return F.aggregate(F.slice(numbered, F.lit(1), F.length(text)), start, step, lambda s: s["peak"])


def _without_words(candidate: Column) -> Column:
    """What is left of a candidate when its words are taken out; a mark before a last word goes with it."""
    rest = F.regexp_replace(candidate, WORD, "")
    return F.when(candidate.rlike(LAST_WORD), F.rtrim(rest, F.lit("/_=+-"))).otherwise(rest)


def suspicious(candidate: Column, window: int = WINDOW) -> Column:
    """True where a window of the candidate without its words reaches its class's entropy and the allow-list does not cover all of it."""

    def allowed(text: Column) -> Column:
        covered = F.lit(False)
        for pattern in ALLOW[:-1]:
            covered = covered | text.rlike(pattern)
        return covered

    def reaches(rest: Column) -> Column:
        tests = None
        for c in CLASSES:
            inside = rest.rlike("^[" + c.alphabet + "]+$")
            reached = _entropy_peak(rest, c.alphabet, window) >= c.threshold
            tests = F.when(inside, reached) if tests is None else tests.when(inside, reached)
        return F.when(allowed(rest), F.lit(False)).otherwise(tests.otherwise(F.lit(False)))

    return F.when(allowed(candidate), F.lit(False)).otherwise(let(_without_words(candidate), reaches))


def _spans(matches: Column, gaps: Column, kept: Column, kind: int) -> Column:
    """Array of struct<start, kind, end> of the matches that ``kept`` marks; offsets are prefix sums over gaps and matches."""
    steps = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.length(m) + F.length(g))
    ends = prefix_sums(steps)
    rows = F.arrays_zip(matches.alias("m"), ends.alias("e"), kept.alias("k"))
    spans = F.transform(
        F.filter(rows, lambda r: r["k"]),
        lambda r: F.struct((r["e"] - F.length(r["m"])).alias("start"), F.lit(kind).alias("kind"), r["e"].alias("end")),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(F.size(matches) > 0, spans).otherwise(none)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def find_spans(df: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """``df`` plus ``into``: array<struct<start, kind, end>> of all spans by start, then kind; kind indexes ``KINDS``.

    Base spans are the leftmost, non-overlapping matches of each rule; an
    assignment whose value has under six characters is dropped.
    """
    out = df.select("*", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_t"))
    out = out.select(
        "*",
        *[F.regexp_extract_all("_t", F.lit(p), F.lit(0)).alias(f"_m{i}") for i, p in enumerate(SCANNED)],
    )
    value = lambda m: F.length(F.regexp_extract(m, "[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", 1)) >= 6
    out = out.select(
        "*",
        F.transform("_m0", value).alias("_k0"),
        F.transform("_m1", lambda m: F.lit(True)).alias("_k1"),
        F.transform("_m2", lambda m: F.lit(True)).alias("_k2"),
        F.transform("_m3", lambda c: suspicious(c)).alias("_k3"),
    )
    # gaps are split off only where a match is kept; without one the array of matches is emptied with them
    for i, pattern in enumerate(SCANNED):
        some = F.exists(f"_k{i}", lambda k: k)
        out = out.select("*", F.when(some, F.split("_t", pattern, -1)).otherwise(F.array().cast("array<string>")).alias(f"_g{i}"))
    found = [
        F.when(F.size(f"_g{i}") > 0, _spans(F.col(f"_m{i}"), F.col(f"_g{i}"), F.col(f"_k{i}"), i)).otherwise(
            F.array().cast("array<struct<start:int,kind:int,end:int>>")
        )
        for i in range(len(KINDS))
    ]
    out = out.select("*", F.sort_array(F.flatten(F.array(*found))).alias("_spans"))
    return set_columns(out, {into: F.col("_spans")}, keep=df.columns)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, counts of the base kinds, digest of the base spans, and all spans written as kind:start:end."""
    found = find_spans(df.select(key, text), text, "_found")
    count = lambda kind: F.size(F.filter("_found", lambda s: s["kind"] == kind)).cast("long")
    base = _written(F.filter("_found", lambda s: s["kind"] < 3))
    return found.select(
        key,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"),
        _written(F.col("_found")).alias("spans"),
    )


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of its text replaced by ``mark``; overlapping spans count as one. Other rows stay as they are."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("whole"))
    found = find_spans(rows, "whole", "found")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    whole = F.col("whole")

    def cut(state: Column, span: Column) -> Column:
        before = F.when(span["start"] >= state["at"], F.array(F.substring(whole, state["at"] + 1, span["start"] - state["at"]), F.lit(mark)))
        parts = F.concat(state["parts"], F.coalesce(before, F.array().cast("array<string>")))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), parts.alias("parts"))

    rebuilt = F.aggregate(
        "found", start, cut, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(whole, s["at"] + 1, F.length(whole)))
    )
    clean = F.when(F.size("found") > 0, rebuilt).otherwise(whole)
    return found.select(*[(clean if c == text else F.col("row")[c]).alias(c) for c in df.columns])
