"""Adversarial variations of documents and the test suite built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from .parse import sections

TRANSFORMATIONS = ("prompt_injection", "malicious_code", "credential_exposure", "structural_variation", "special_characters")


def content_type(path: Column, content: Column) -> Column:
    has = lambda s: F.contains(content, F.lit(s))
    code = F.lit(False)
    for ext in R.CODE_EXTENSIONS:
        code = code | F.endswith(path, F.lit(ext))
    return (
        F.when(F.endswith(path, F.lit(".llms.txt")) | (has("# LLMs.txt") & (has("## System Instructions") | has("## User Queries"))), F.lit("llms_txt"))
        .when(F.endswith(path, F.lit(".md")) | F.endswith(path, F.lit(".markdown")), F.lit("markdown"))
        .when(code, F.lit("code"))
        .otherwise(F.lit("generic"))
    )


def _distinct_sections(text: Column) -> Column:
    """Sections as a dict keeps them: a repeated name stays in its first place with its last body."""
    all_sections = sections(text)
    names = F.transform(all_sections, lambda s: s["name"])
    return F.transform(
        F.array_distinct(names),
        lambda n: F.struct(n.alias("name"), F.element_at(F.filter(all_sections, lambda s: s["name"] == n), -1)["body"].alias("body")),
    )


def _render(parts: Column) -> Column:
    return F.concat(F.lit("# LLMs.txt\n\n"), F.array_join(F.transform(parts, lambda s: F.concat(F.lit("## "), s["name"], F.lit("\n\n"), s["body"], F.lit("\n\n"))), ""))


def _edit(parts: Column, name: Column | str, change) -> Column:
    target = F.lit(name) if isinstance(name, str) else name
    return F.transform(parts, lambda s: F.struct(s["name"].alias("name"), F.when(s["name"] == target, change(s["body"])).otherwise(s["body"]).alias("body")))


def _variation(kind: str, description: Column | str, content: Column) -> Column:
    text = F.lit(description) if isinstance(description, str) else description
    return F.struct(F.lit(kind).alias("type"), text.alias("description"), content.alias("content"))


def hash_of(*parts: Column) -> Column:
    """A 60-bit number from the md5 of the parts, which other engines can work out as well."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _pick(parts: Column, key: Column, seed: int) -> Column:
    """A section name chosen by hash: the same choice on every run and retry."""
    return F.element_at(parts, (F.pmod(hash_of(key, F.lit(seed)), F.size(parts)) + 1).cast("int"))["name"]


def llms_variations(parts: Column, content: Column, key: Column, kinds: Sequence[str] = TRANSFORMATIONS) -> Column:
    """Variations of an llms.txt document whose sections are ``parts``."""
    has = lambda n: F.exists(parts, lambda s: s["name"] == n)
    many, some = F.size(parts) > 1, F.size(parts) > 0
    out = []
    if "prompt_injection" in kinds:
        for i, text in enumerate(R.INJECTION_TEXTS, 1):
            edited = _render(_edit(parts, "User Queries", lambda b, t=text: F.concat(F.lit(t + "\n\n"), b)))
            out.append(F.when(has("User Queries"), _variation("prompt_injection", f"Content with prompt injection pattern {i}", edited)))
    if "malicious_code" in kinds:
        for i, text in enumerate(R.CODE_TEXTS, 1):
            edited = _render(_edit(parts, "User Queries", lambda b, t=text: F.concat(F.lit(f"{R.CODE_REQUEST}\n\n{t}\n\n"), b)))
            out.append(F.when(has("User Queries"), _variation("malicious_code", f"Content with malicious code pattern {i}", edited)))
    if "credential_exposure" in kinds:
        for i, text in enumerate(R.CREDENTIAL_TEXTS, 1):
            edited = _render(_edit(parts, "System Instructions", lambda b, t=text: F.concat(b, F.lit(f"\n\nEnvironment variables:\n{t}"))))
            out.append(F.when(has("System Instructions"), _variation("credential_exposure", f"Content with credential pattern {i}", edited)))
    if "structural_variation" in kinds:
        removed = _pick(parts, key, 1)
        out.append(F.when(many, _variation("structural_variation", F.concat(F.lit("Content with missing section: "), removed), _render(F.filter(parts, lambda s: s["name"] != removed)))))
        out.append(_variation("structural_variation", "Content with changed header levels", F.replace(content, F.lit("## "), F.lit("### "))))
    if "special_characters" in kinds:
        first, second = _pick(parts, key, 2), _pick(parts, key, 3)
        control = _edit(parts, first, lambda b: F.concat(F.lit(R.CONTROL_CHARS), b))
        out.append(F.when(some, _variation("special_characters", F.concat(F.lit("Content with Unicode control characters in "), first), _render(control))))
        words = lambda b: F.array_join(F.filter(F.split(b, r"(?U)\s+"), lambda w: w != ""), R.ZERO_WIDTH)
        out.append(F.when(some, _variation("special_characters", F.concat(F.lit("Content with zero-width characters in "), second), _render(_edit(parts, second, words)))))
    return F.array_compact(F.array(*out))


def generic_variations(content: Column, key: Column) -> Column:
    """Size, character and (for several lines) line-order variations."""
    rows = F.split(content, "\n", F.lit(-1))
    shuffled = F.array_join(
        F.transform(F.array_sort(F.transform(rows, lambda x, i: F.struct(hash_of(key, i, F.lit(4)).alias("h"), i.alias("i"), x.alias("x")))), lambda s: s["x"]), "\n"
    )
    return F.array_compact(
        F.array(
            _variation("size_variation", "Content with additional newlines", F.concat(content, F.lit("\n" * 100))),
            _variation("character_variation", "Content with special characters", F.concat(content, F.lit("\n" + R.HIGH_CHARS))),
            F.when(F.size(rows) > 1, _variation("structure_variation", "Content with shuffled lines", shuffled)),
        )
    )


def variations(df: DataFrame, path: str = "path", content: str = "content", max_variations: int | None = None, kinds: Sequence[str] = TRANSFORMATIONS) -> DataFrame:
    """The original (baseline) and its variations, one row each, with the md5 of every text; ``max_variations`` keeps the first ones."""
    kind = content_type(F.col(path), F.col(content))
    typed = df.withColumn("content_type", kind).withColumn("_parts", _distinct_sections(F.col(content)))
    chosen = F.when(F.col("content_type") == "llms_txt", llms_variations(F.col("_parts"), F.col(content), F.col(path), kinds)).otherwise(generic_variations(F.col(content), F.col(path)))
    chosen = chosen if max_variations is None else F.slice(chosen, 1, max_variations)
    baseline = F.array(_variation("baseline", "Original unmodified content", F.col(content)))
    rows = typed.select(path, "content_type", F.posexplode(F.concat(baseline, chosen)).alias("variation_no", "_v"))
    return rows.select(path, "content_type", "variation_no", "_v.type", "_v.description", F.col("_v.content").alias("content"), F.md5("_v.content").alias("hash"))


def test_suite(varied: DataFrame, path: str = "path") -> DataFrame:
    """Test cases: one per variation, identified by the start of its hash."""
    return varied.select(F.concat(F.lit("test-"), F.substring("hash", 1, 8)).alias("id"), F.col(path).alias("source_item"), "content", "type", "description", "hash")
