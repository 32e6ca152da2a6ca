"""Text and binary signature rules with threat classification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import rules as R
from ..functions.anchored import AnchoredStrings
from ..functions.matching import Rule, scan
from ..functions.scale import broadcast_small
from ..session import materialize


def signature_rules(signatures: dict | None = None) -> tuple[Rule, ...]:
    """One matching rule per literal: family = rule name, name = string identifier."""
    out = []
    for rule, spec in (signatures or R.SIGNATURES).items():
        for identifier, literal in spec["strings"].items():
            quoted = "".join("\\" + c if not c.isalnum() and c != " " and c != "_" else c for c in literal)
            out.append(Rule(name=identifier, pattern=quoted, flags="i" if spec["nocase"] else "", family=rule, gate=((literal,),)))
    return tuple(out)


def signature_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(R.SIGNATURE_DOCS.items()), "rule_name string, documentation string")


def signature_matches(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), signatures: dict | None = None) -> DataFrame:
    """Matched strings with byte offsets and an excerpt of ±30 bytes."""
    signatures = signatures or R.SIGNATURES
    found = scan(df, text, signature_rules(signatures), keep)
    before = F.substring(F.col(text), F.lit(1), F.col("start"))
    raw = F.encode(F.col(text), "UTF-8")
    offset = F.octet_length(before)
    size = F.octet_length("match")
    left = F.greatest(offset - 30, F.lit(0))
    return found.select(
        *keep,
        F.col("family").alias("rule_name"),
        F.col("rule_name").alias("identifier"),
        "rule_no",
        "match_no",
        offset.alias("offset"),
        F.col("match").alias("data"),
        F.make_valid_utf8(F.substring(raw, left + 1, F.least(offset + size + 30, F.octet_length(raw)) - left).cast("string")).alias("excerpt"),
    )


def _meta(signatures: dict) -> Column:
    entries = []
    for rule, spec in signatures.items():
        meta = F.create_map(*[F.lit(x) for kv in spec["meta"].items() for x in kv])
        tags = F.array(*[F.lit(t) for t in spec["tags"]]).cast("array<string>")
        entries += [F.lit(rule), F.struct(tags.alias("tags"), meta.alias("meta"))]
    return F.create_map(*entries)


def classify_threat(rule_name: Column, tags: Column, meta: Column) -> Column:
    """meta.threat_type, then category, then threat, then tag keywords, then rule-name keywords."""
    has = lambda text, words: F.lower(text).rlike("|".join(words))

    def from_tag(tag: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for threat, words in R.TAG_KEYWORDS:
            out = out.when(has(tag, words), F.lit(threat))
        return out

    tagged = F.get(F.filter(F.transform(tags, from_tag), lambda t: t.isNotNull()), F.lit(0))
    named = F.when(F.lit(False), F.lit(""))
    for threat, words in R.NAME_KEYWORDS:
        named = named.when(has(rule_name, words), F.lit(threat))
    filled = lambda key: F.nullif(F.lower(meta[key]), F.lit(""))
    return F.coalesce(filled("threat_type"), filled("category"), filled("threat"), tagged, named, F.lit("other"))


def signature_findings(matches: DataFrame, keep: Sequence[str] = ("doc_id",), signatures: dict | None = None, require_all: Sequence[str] = ()) -> DataFrame:
    """One row per (document, rule): its strings, meta, threat class and summary bucket.

    ``require_all`` names rules whose every string must occur; the rest need any.
    """
    signatures = signatures or R.SIGNATURES
    hit = F.struct("offset", "identifier", "data", "excerpt")
    grouped = matches.groupBy(*keep, "rule_name").agg(F.array_sort(F.collect_list(hit)).alias("strings"))
    sizes = F.create_map(*[F.lit(x) for rule, s in signatures.items() for x in (rule, len(s["strings"]) if rule in require_all else 1)])
    found = F.size(F.array_distinct(F.transform("strings", lambda s: s["identifier"])))
    info = _meta(signatures)[F.col("rule_name")]
    threat = classify_threat(F.col("rule_name"), info["tags"], info["meta"])
    buckets = F.create_map(*[F.lit(x) for kv in R.THREAT_BUCKETS.items() for x in kv])
    return grouped.where(found >= sizes[F.col("rule_name")]).select(
        *keep,
        "rule_name",
        info["tags"].alias("tags"),
        info["meta"].alias("meta"),
        threat.alias("threat"),
        F.coalesce(buckets[threat], F.lit("other_flagged_patterns")).alias("bucket"),
        "strings",
    )


def bucket_counts(findings: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Findings per document and bucket as columns."""
    names = [*R.THREAT_BUCKETS.values(), "other_flagged_patterns"]
    return findings.groupBy(*keep).agg(*[F.count_if(F.col("bucket") == n).alias(n) for n in names])


#: Rule rows: any of ``headers`` begins the content (none: any content does), and all groups of one alternative hold. A
#: group holds when ``least`` of its strings each occur ``times`` times.
RULE_ROWS = (
    "rule string, headers array<string>, strings array<struct<identifier: string, pattern: string>>, "
    "alternatives array<array<struct<identifiers: array<string>, least: int, times: int>>>"
)
_ANCHOR_WIDTHS = (4, 3, 2, 1)
_BLOCK_BYTES = 4096
_HEADER_BYTES = 64
#: Anchors that are broadcast at most; more of them meet the contents in a shuffle.
BROADCAST_ANCHORS = 50_000


def binary_rule_rows(spark: SparkSession, rules: Sequence[dict]) -> DataFrame:
    """Rule rows of {name, header or headers (hex), strings: {id: hex with ?}, condition: all|any} or, in place of the condition, groups or alternatives.

    ``groups`` is a list of groups that must all hold, ``alternatives`` a list of
    such lists. A group is {of: [ids], least: number or "all", times: number}; an
    id that ends with ``*`` stands for all strings it begins.
    """
    rows = []
    for rule in rules:
        names = list(rule["strings"])
        if not names:
            raise ValueError(f"rule {rule['name']} has no strings")
        default = {"of": names, "least": "all" if rule.get("condition", "all") == "all" else 1}
        groups_of = rule.get("alternatives") or [rule.get("groups") or [default]]
        alternatives = []
        for groups in groups_of:
            shaped = []
            for group in groups:
                ids = [n for n in names if any(n == o or (o.endswith("*") and n.startswith(o[:-1])) for o in group["of"])]
                least = group.get("least", "all")
                shaped.append((ids, len(ids) if least == "all" else int(least), int(group.get("times", 1))))
            alternatives.append(shaped)
        headers = rule.get("headers") or ([rule["header"]] if rule.get("header") else [])
        rows.append((rule["name"], headers, list(rule["strings"].items()), alternatives))
    return spark.createDataFrame(rows, RULE_ROWS)


def _plain_hex(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"\s", ""))


def anchors(rules: DataFrame) -> DataFrame:
    """One row per string of ``rules``: its fixed run of up to four bytes with the most different ones, and where in the string it stands.

    A string without any fixed byte has an empty anchor, which stands everywhere.
    """
    headed = F.concat(F.lit("^("), F.array_join(F.transform("headers", _plain_hex), "|"), F.lit(")"))
    strings = rules.select("rule", headed.alias("headed"), F.inline("strings"))
    strings = strings.withColumn("hex", _plain_hex(F.col("pattern"))).withColumn("size", (F.length("hex") / 2).cast("int"))
    at = lambda i, width: F.substring(F.col("hex"), 2 * i + 1, F.lit(2 * width))

    def best(width: int) -> Column:
        variety = lambda i: F.size(F.array_distinct(F.array(*[at(i + k, 1) for k in range(width)])))
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.col("size") - width, F.lit(0))), lambda i: ~F.contains(at(i, width), F.lit("?")))
        found = F.array_max(F.transform(starts, lambda i: F.struct(variety(i).alias("variety"), (-i).alias("back"))))
        return F.when(F.col("size") >= width, F.struct(F.lit(width).alias("width"), (-found["back"]).alias("place")))

    found = F.coalesce(*[F.when(best(w)["place"].isNotNull(), best(w)) for w in _ANCHOR_WIDTHS], F.struct(F.lit(0).alias("width"), F.lit(0).alias("place")))
    placed = strings.where(F.col("size") > 0).withColumn("_a", found)
    return placed.select(
        "rule", "headed", "identifier", "size", F.translate("hex", "?", "_").alias("mask"), F.col("_a.place").alias("place"), F.col("_a.width").alias("width"),
        F.unhex(F.substring(F.col("hex"), 2 * F.col("_a.place") + 1, 2 * F.col("_a.width"))).alias("gram"),
    )


def binary_matches(df: DataFrame, content: str, rules: DataFrame, keep: Sequence[str], broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """Rows (keep, rule, identifier, offset): every place where a string of a rule stands in contents that begin with one of its headers.

    Strings are hex bytes with ``?`` for a half byte. Every byte position of a
    content looks its next bytes up in the rules' anchors; only where an anchor
    stands is the whole string compared. Up to ``broadcast_anchors`` strings are
    sent to all tasks, which look a batch of contents up at once; more meet the
    positions in a shuffle, from chunks that overlap by the longest string, so a
    row never carries more. Null and empty contents have no matches; of a
    header, at most 64 bytes may be given.
    """
    table = materialize(anchors(rules), "signature-anchors")
    reach = table.agg(F.max("size")).first()[0] or 0
    content_bytes = F.col("_content")
    source = df.select(F.struct(*keep).alias("_keep"), F.col(content).cast("binary").alias("_content")).where(F.octet_length("_content") > 0)
    begins = F.hex(F.substring(content_bytes, F.lit(1), F.lit(_HEADER_BYTES)))
    if table.limit(broadcast_anchors + 1).count() <= broadcast_anchors:
        return _few_matches(source.select("_keep", begins.alias("_begins"), "_content"), table)
    widths = [r["width"] for r in table.select("width").distinct().orderBy("width").collect()]  # at most five
    blocks = source.select("*", F.explode(F.sequence(F.lit(0), F.octet_length("_content") - 1, F.lit(_BLOCK_BYTES))).alias("_base"))
    low = F.greatest(F.col("_base") - reach, F.lit(0))
    chunks = blocks.select(
        "_keep",
        "_base",
        F.octet_length("_content").alias("_size"),
        begins.alias("_begins"),
        low.alias("_low"),
        F.substring(content_bytes, low + 1, F.col("_base") - low + _BLOCK_BYTES + reach).alias("_chunk"),
    )
    # the chunk stays behind while its positions meet the anchors
    chunks = materialize(chunks.withColumn("_row", F.monotonically_increasing_id()), "signature-chunks")
    places = chunks.select("_chunk", "_low", "_size", "_row", F.explode(F.sequence(F.col("_base"), F.least(F.col("_base") + _BLOCK_BYTES, F.col("_size")) - 1)).alias("_at"))
    # whole grams only: a cut one at the end could look like a shorter anchor
    grams = [F.when(F.col("_at") + w <= F.col("_size"), F.substring(F.col("_chunk"), F.col("_at") - F.col("_low") + 1, F.lit(w))) for w in widths] or [F.lit(None).cast("binary")]
    gram = grams[0] if len(grams) == 1 else F.explode(F.array(*grams))
    met = places.select("_row", "_at", gram.alias("gram")).join(table, "gram").join(chunks.select("_row", "_keep", "_begins", "_low", "_chunk"), "_row")
    start = F.col("_at") - F.col("place")
    stands = F.like(F.hex(F.substring(F.col("_chunk"), start - F.col("_low") + 1, F.col("size"))), F.col("mask"))
    return met.where((start >= 0) & F.rlike(F.col("_begins"), F.col("headed")) & stands).select("_keep.*", "rule", "identifier", start.alias("offset"))


def _few_matches(contents: DataFrame, table: DataFrame) -> DataFrame:
    """``binary_matches`` of contents (_keep, _begins, _content) for anchors that a task can hold."""
    spark = contents.sparkSession
    # rows as collected, so that a string's number is its place in them
    rows = table.where("gram IS NOT NULL").collect()
    shared = spark.sparkContext.broadcast([(r["mask"], r["place"], bytes(r["gram"])) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = AnchoredStrings(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(2).cast(pa.large_binary())
            bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8)
            for content, string, offset in strings.find(data, bounds):
                taken = pa.array(content)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(string.astype(np.int32)), pa.array(offset.astype(np.int32))],
                    names=["_keep", "_begins", "_string", "offset"],
                )

    schema = StructType([*contents.schema.fields[:2], StructField("_string", IntegerType()), StructField("offset", IntegerType())])
    named = spark.createDataFrame([(i, r["rule"], r["identifier"], r["headed"]) for i, r in enumerate(rows)], "_string int, rule string, identifier string, headed string")
    met = contents.mapInArrow(run, schema).join(F.broadcast(named), "_string")
    return met.where(F.rlike(F.col("_begins"), F.col("headed"))).select("_keep.*", "rule", "identifier", "offset")


def binary_findings(matches: DataFrame, rules: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows (keep, rule) whose condition the ``matches`` meet."""
    counted = matches.groupBy(*keep, "rule", "identifier").agg(F.count("*").alias("_n"))
    alternatives = rules.select("rule", F.posexplode("alternatives").alias("_alternative", "_groups")).select("rule", "_alternative", F.size("_groups").alias("_of"), F.posexplode("_groups").alias("_group", "_g"))
    members = alternatives.select("rule", "_alternative", "_of", "_group", F.col("_g.least").alias("_least"), F.col("_g.times").alias("_times"), F.explode("_g.identifiers").alias("identifier"))
    held = counted.join(broadcast_small(members, BROADCAST_ANCHORS), ["rule", "identifier"]).where(F.col("_n") >= F.col("_times"))
    groups = held.groupBy(*keep, "rule", "_alternative", "_of", "_group").agg(F.count("*").alias("_hits"), F.first("_least").alias("_least")).where("_hits >= _least")
    return groups.groupBy(*keep, "rule", "_alternative", "_of").agg(F.count("*").alias("_held")).where("_held = _of").select(*keep, F.col("rule").alias("rule_name")).distinct()


def binary_signature_hits(df: DataFrame, content: str, rules: Sequence[dict] | DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows (keep, rule_name) of the rules (rows, or as for ``binary_rule_rows``) that a content meets."""
    rows = rules if isinstance(rules, DataFrame) else binary_rule_rows(df.sparkSession, rules)
    return binary_findings(binary_matches(df, content, rows, keep), rows, keep)
