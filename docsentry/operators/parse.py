"""Markdown structure as rows: code blocks, links, headings, lists, sections, llms.txt layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import newlines, prefix_sums, with_offsets

# fixed values: block shapes
FENCE = r"(?dms)^```([^\n]*)\n(.*?)(?:^```[ \t]*$|\z)"
LINK = r"(?d)(?:!?)\[[^\]\n]*\]\(\s*<?([^)\s>]+)>?[^)\n]*\)"
FOOTNOTE = r"\[\^([^\]\s]+)\](:?)"
HEADING = r"(?d)^(#{1,6})[ \t]+(.*?)[ \t#]*$"
LIST_ITEM = r"(?d)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+(.*)$"
QUOTE = r"(?d)^[ \t]*>[ \t]?(.*)$"
RULE_LINE = r"^[ \t]*(?:-[ \t]*-[ \t]*-[- \t]*|\*[ \t]*\*[ \t]*\*[* \t]*|_[ \t]*_[ \t]*_[_ \t]*)$"
# what str.strip removes
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
SECTION_BREAK = r"(?dm)^## "
FILE_LINE = r"(?dm)^[-*][ \t]+\[([^\]\n]+)\]\(([^)\n]+)\)(:?[^\n]*)$"


def strip(text: Column) -> Column:
    """``str.strip``, linear in the text whatever it contains."""
    return F.btrim(text, F.lit(WHITESPACE))


def raw_lines(text: Column) -> Column:
    return F.split(text, "\n", F.lit(-1))


def code_blocks(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), context: int = 3) -> DataFrame:
    """Fenced blocks with language (default ``text``), code, true line span and context lines."""
    source = [*dict.fromkeys([*keep, text])]
    found = with_offsets(df.select(*source), text, F.lit(FENCE), {"info": 1, "code": 2}, lines=True)
    code = F.coalesce("code", F.lit(""))
    language = strip(F.coalesce("info", F.lit("")))
    end = F.col("line") + newlines(code) + 1
    all_lines = raw_lines(F.col(text))
    first = F.greatest(F.col("line") - context, F.lit(1))
    return found.select(
        *keep,
        F.col("match_no").alias("block_no"),
        F.when(language == "", F.lit("text")).otherwise(language).alias("language"),
        code.alias("code"),
        F.col("line").alias("line_start"),
        end.alias("line_end"),
        F.array_join(F.slice(all_lines, first, F.col("line") - first), "\n").alias("context_before"),
        F.array_join(F.slice(all_lines, end + 2, F.lit(context)), "\n").alias("context_after"),
    )


def link_targets(text: Column) -> Column:
    """Sorted distinct link and image targets."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(LINK), F.lit(1))))


def footnote_refs(text: Column) -> Column:
    """Sorted distinct footnote keys that are referenced (``[^key]`` not followed by a colon)."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(FOOTNOTE), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(FOOTNOTE), F.lit(2)).alias("c")
    )
    return F.array_sort(F.array_distinct(F.transform(F.filter(pairs, lambda p: p["c"] == ""), lambda p: p["k"])))


def without_code(text: Column) -> Column:
    return F.regexp_replace(text, FENCE, "")


def structure(text: Column) -> Column:
    """Headings, lists and list items in order: array<struct<type, level, text>>."""
    rows = raw_lines(without_code(text))
    is_item = lambda x: x.rlike(LIST_ITEM)
    item = lambda kind, level, body: F.struct(kind.alias("type"), level.cast("int").alias("level"), body.alias("text"))
    none = F.lit(None)

    def entries(line: Column, i: Column) -> Column:
        previous = F.get(rows, i - 1)
        opens = is_item(line) & ~F.coalesce(is_item(previous), F.lit(False))
        return F.array_compact(
            F.array(
                F.when(line.rlike(HEADING), item(F.lit("heading"), F.length(F.regexp_extract(line, HEADING, 1)), F.regexp_extract(line, HEADING, 2))),
                F.when(opens, item(F.lit("list"), none, F.lit(""))),
                F.when(is_item(line), item(F.lit("list_item"), none, F.regexp_extract(line, LIST_ITEM, 1))),
            )
        )

    return F.flatten(F.transform(rows, entries))


def fence_state(text: Column) -> Column:
    """Per line: array<struct<line_no, is_fence, in_code>>; the state is the parity of fences so far."""
    rows = raw_lines(text)
    marks = F.transform(rows, lambda x: F.when(F.startswith(x, F.lit("```")), F.lit(1)).otherwise(F.lit(0)))
    return F.transform(
        F.arrays_zip(marks.alias("mark"), prefix_sums(marks).alias("seen")),
        lambda z, i: F.struct((i + 1).alias("line_no"), (z["mark"] == 1).alias("is_fence"), ((z["mark"] == 0) & (z["seen"] % 2 == 1)).alias("in_code")),
    )


def content_nodes(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The content tree flattened to one node per non-blank line (code lines carry their fence depth)."""
    rows = F.arrays_zip(raw_lines(F.col(text)).alias("line"), fence_state(F.col(text)).alias("state"))
    flat = df.select(*keep, F.posexplode(rows).alias("_i", "_r")).select(*keep, (F.col("_i") + 1).alias("line_no"), "_r.line", "_r.state")
    line, state = F.col("line"), F.col("state")
    kind = (
        F.when(state["is_fence"], F.lit("fence"))
        .when(state["in_code"], F.lit("block_code"))
        .when(line.rlike(HEADING), F.lit("heading"))
        .when(line.rlike(RULE_LINE), F.lit("thematic_break"))
        .when(line.rlike(LIST_ITEM), F.lit("list_item"))
        .when(line.rlike(QUOTE), F.lit("block_quote"))
        .otherwise(F.lit("paragraph"))
    )
    indent = F.length(F.regexp_extract(line, r"^[ \t]*", 0))
    depth = F.when(kind == "heading", F.length(F.regexp_extract(line, "^#+", 0))).when(kind == "list_item", F.floor(indent / 2) + 1).otherwise(F.lit(1))
    body = (
        F.when(kind == "heading", F.regexp_extract(line, HEADING, 2))
        .when(kind == "list_item", F.regexp_extract(line, LIST_ITEM, 1))
        .when(kind == "block_quote", F.regexp_extract(line, QUOTE, 1))
        .otherwise(line)
    )
    out = flat.where(line.rlike(r"\S") | state["in_code"])
    return out.select(*keep, "line_no", kind.alias("type"), depth.cast("int").alias("depth"), body.alias("text"))


def sections(text: Column) -> Column:
    """Bodies between ``## `` headers: array<struct<name, body>> in document order."""
    parts = F.split(text, SECTION_BREAK, F.lit(-1))
    pieces = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    named = F.transform(
        pieces,
        lambda p: F.struct(
            strip(F.substring_index(p, "\n", 1)).alias("name"),
            strip(F.when(F.contains(p, F.lit("\n")), F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).otherwise(F.lit(""))).alias("body"),
            (F.substring_index(p, "\n", 1) != "").alias("_named"),
        ),
    )
    return F.transform(F.filter(named, lambda s: s["_named"]), lambda s: F.struct(s["name"].alias("name"), s["body"].alias("body")))


def llms_layout(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """llms.txt file lists: one row per ``- [name](url): notes`` line with its section and page header."""
    t = F.col(text)
    base = df.select(
        *keep,
        F.regexp_extract(t, r"(?dm)^# (.*)$", 1).alias("title"),
        F.regexp_extract(t, r"(?dm)^> ?(.*)$", 1).alias("summary"),
        F.posexplode(sections(t)).alias("section_no", "_s"),
    )
    body = F.col("_s.body")
    columns = [F.regexp_extract_all(body, F.lit(FILE_LINE), F.lit(i)).alias(n) for i, n in ((1, "name"), (2, "url"), (3, "notes"))]
    files = base.select(*keep, "title", "summary", "section_no", F.col("_s.name").alias("section"), F.posexplode(F.arrays_zip(*columns)).alias("file_no", "_f"))
    return files.select(
        *keep,
        "title",
        "summary",
        "section",
        "section_no",
        "file_no",
        F.col("_f.name").alias("name"),
        F.col("_f.url").alias("url"),
        strip(F.regexp_replace("_f.notes", "^:", "")).alias("notes"),
        (F.lower("section") == "optional").alias("optional"),
    )


def parse(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds urls, references and structure as columns, all in one projection."""
    t = F.col(text)
    return df.withColumn("urls", link_targets(t)).withColumn("references", footnote_refs(t)).withColumn("structure", structure(t))
