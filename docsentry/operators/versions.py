"""Content versions per URL, changes between consecutive versions, and evolution of changed sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.patterns import java
from ..functions.runs import longest_increasing_run
from ..functions.scale import exact_quantiles, row_numbers
from ..session import wide_partitions
from .markdown import lines


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def number_versions(observations: DataFrame, bucket: Column | None = None) -> DataFrame:
    """(url, content_hash, ts, doc_id) observations -> one row per version.

    A hash seen again keeps its first number. Repeats collapse map side, text is
    never shuffled, and numbering runs per (url, day), so a URL owning a large
    share of the corpus still spreads over tasks.
    """
    first = observations.groupBy("url", "content_hash").agg(F.min(F.struct("ts", "doc_id")).alias("_f"))
    flat = first.select("url", "content_hash", F.col("_f.ts").alias("ts"), F.col("_f.doc_id").alias("doc_id"))
    bucket = bucket if bucket is not None else F.date_trunc("day", F.col("ts"))
    return row_numbers(flat, ["url"], bucket, [F.col("ts"), F.col("doc_id")], "version_number")


def track(observations: DataFrame, versions: DataFrame) -> DataFrame:
    """Every observation with its version number and whether it created that version."""
    v = versions.select("url", "content_hash", "version_number", F.col("doc_id").alias("_first"))
    return observations.join(v, ["url", "content_hash"]).withColumn("is_new_version", F.col("doc_id") == F.col("_first")).drop("_first")


def consecutive_pairs(versions: DataFrame) -> DataFrame:
    """Each version with its predecessor: an equi-join on (url, number), not a window over a whole URL."""
    prev = versions.select("url", (F.col("version_number") + 1).alias("version_number"), F.col("doc_id").alias("old_doc_id"), F.col("ts").alias("old_ts"))
    return versions.join(prev, ["url", "version_number"]).select("url", "version_number", "ts", "old_ts", F.col("doc_id").alias("new_doc_id"), "old_doc_id")


def latest_versions(versions: DataFrame) -> DataFrame:
    """Latest version of each URL."""
    return versions.groupBy("url").agg(F.max_by(F.struct("version_number", "content_hash", "ts", "doc_id"), "version_number").alias("_v")).select("url", "_v.*")


def days_between(versions: DataFrame) -> DataFrame:
    """Days since the previous version, per version after the first."""
    return consecutive_pairs(versions).select("url", "version_number", ((F.unix_micros("ts") - F.unix_micros("old_ts")) / 86.4e9).alias("days"))


def section_type(section: Column) -> Column:
    has = lambda s: F.contains(section, F.lit(s))
    return (
        F.when(section.isNull(), F.lit("unknown"))
        .when(has("```"), F.lit("code_block"))
        .when(has("http://") | has("https://"), F.lit("url"))
        .when(section.rlike(r"(?U)^\s*#"), F.lit("heading"))
        .otherwise(F.lit("text"))
    )


def change_size(before: Column, after: Column) -> Column:
    old, new = F.coalesce(F.length(before), F.lit(0)), F.coalesce(F.length(after), F.lit(0))
    return F.when(before.isNull(), new).when(after.isNull(), old).otherwise(F.abs(new - old))


def suspicion(change_type: Column, before: Column, after: Column, near_identical: Column) -> Column:
    token = reduce(lambda a, b: a | b, [F.contains(after, F.lit(t)) for t in R.SUSPICIOUS_TOKENS])
    score = (
        F.when((change_type == "deletion") & (F.length(before) > 500), F.lit(0.4)).otherwise(F.lit(0.0))
        + F.when(F.coalesce(token, F.lit(False)), F.lit(0.3)).otherwise(F.lit(0.0))
        + F.when((change_type == "modification") & near_identical, F.lit(0.2)).otherwise(F.lit(0.0))
    )
    return F.least(score, F.lit(1.0))


def suspicious_patterns(text: Column) -> Column:
    """Listed patterns found in added text, in list order."""
    hits = [F.when(text.rlike(java(p, "i")), F.lit(p)) for p in R.SUSPICIOUS_ADDITIONS]
    return F.coalesce(F.array_compact(F.array(*hits)), F.array().cast("array<string>"))


def with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds old_text and new_text; joins are on the unique doc_id, so no key is hot."""
    text = docs.select("doc_id", "text")
    return pairs.join(text.withColumnsRenamed({"doc_id": "new_doc_id", "text": "new_text"}), "new_doc_id").join(
        text.withColumnsRenamed({"doc_id": "old_doc_id", "text": "old_text"}), "old_doc_id"
    )


def near_identical(before: Column, after: Column) -> Column:
    """Whether two texts share more than four fifths of their distinct words."""
    words = lambda text: F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return 5 * F.size(F.array_intersect(words(before), words(after))) > 4 * F.size(F.array_union(words(before), words(after)))


def _same_at(old: Column, new: Column, from_end: bool) -> Column:
    """How many lines two arrays share at their beginning, or at their end."""
    ends = (lambda rows: F.reverse(rows)) if from_end else (lambda rows: rows)
    differs = F.array_position(F.zip_with(ends(old), ends(new), lambda x, y: F.coalesce(x != y, F.lit(True))), True)
    return F.when(differs > 0, differs - 1).otherwise(F.size(old)).cast("int")


def changed_ranges(pairs: DataFrame) -> DataFrame:
    """Changed line ranges of pairs carrying old_text and new_text, in order, numbered by ``change_seq``.

    Lines that both texts begin or end with are kept. Between them, the k-th
    occurrence of a line in the old text may stay as the k-th of the same line
    in the new one; kept are those of a longest run that stands in the same
    order on both sides, so a line that moves is removed at one place and added
    at another. What lies between two kept lines is one range. Texts of equal
    lines that differ in their line breaks alone are one modification of all lines.

    Texts are shuffled once, by pair. The hashes of their middle lines meet in
    groups of that partitioning, ranges form from one small array a pair, and
    contents are cut out of the same partition's texts. Only pairs in which kept
    lines cross need Python, for their longest run.
    """
    base = [c for c in pairs.columns if c not in ("old_text", "new_text")]
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    dealt = pairs.select(F.struct(*base).alias("_pair"), text("old_text").alias("_o"), text("new_text").alias("_n"))
    dealt = dealt.repartition(wide_partitions(pairs.sparkSession), "_pair")
    hashed = lambda name: F.transform(lines(F.col(name)), lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b")))
    sides = dealt.select("_pair", hashed("_o").alias("_old"), hashed("_n").alias("_new")).withColumn("_head", _same_at(F.col("_old"), F.col("_new"), False))
    rest = lambda name: F.slice(name, F.col("_head") + 1, F.size(name) - F.col("_head"))
    sides = sides.withColumn("_tail", _same_at(rest("_old"), rest("_new"), True))
    middle = lambda name, new: F.transform(
        F.slice(name, F.col("_head") + 1, F.size(name) - F.col("_head") - F.col("_tail")),
        lambda line, i: F.struct(F.lit(new).alias("is_new"), (i + F.col("_head")).alias("no"), line.alias("line")),
    )
    rows = sides.select("_pair", F.inline(F.concat(middle("_old", False), middle("_new", True))))
    places = lambda new: F.sort_array(F.collect_list(F.when(F.col("is_new") == new, F.col("no"))))
    met = rows.groupBy("_pair", "line").agg(places(False).alias("_old"), places(True).alias("_new"))
    both = F.least(F.size("_old"), F.size("_new"))
    partners = met.where(both > 0).select("_pair", F.inline(F.arrays_zip(F.slice("_new", F.lit(1), both).alias("new"), F.slice("_old", F.lit(1), both).alias("old"))))
    listed = partners.groupBy("_pair").agg(F.sort_array(F.collect_list(F.struct("new", "old"))).alias("_met"))
    crossing = F.array_sort("_met.old") != F.col("_met.old")
    listed = listed.withColumn("_run", longest_increasing_run(F.when(crossing, F.col("_met.old"))))
    kept = F.when(F.col("_run").isNull(), F.col("_met")).otherwise(F.transform("_run", lambda i: F.get("_met", i)))
    listed = listed.select(F.col("_pair").alias("_of"), kept.alias("_kept"))

    # a range lies between each kept line and the next, where one of the texts has lines there
    split = dealt.select("_pair", lines(F.col("_o")).alias("_old"), lines(F.col("_n")).alias("_new"), (F.col("_o") != F.col("_n")).alias("_differs"))
    split = split.withColumn("_head", _same_at(F.col("_old"), F.col("_new"), False)).withColumn("_tail", _same_at(rest("_old"), rest("_new"), True))
    joined = split.join(listed, F.col("_pair") == F.col("_of"), "left")
    mark = lambda new, old: F.struct(new.cast("int").alias("new"), old.cast("int").alias("old"))
    inner = F.coalesce("_kept", F.array().cast("array<struct<new:int,old:int>>"))
    first = mark(F.col("_head") - 1, F.col("_head") - 1)
    last = mark(F.size("_new") - F.col("_tail"), F.size("_old") - F.col("_tail"))
    gap = lambda a, b: F.struct(
        (a["old"] + 1).alias("old_start"), b["old"].alias("old_end"), (a["new"] + 1).alias("new_start"), b["new"].alias("new_end")
    )
    gaps = F.filter(F.zip_with(F.concat(F.array(first), inner), F.concat(inner, F.array(last)), gap), lambda g: (g["old_end"] > g["old_start"]) | (g["new_end"] > g["new_start"]))
    whole = F.struct(F.lit(0).alias("old_start"), F.size("_old").alias("old_end"), F.lit(0).alias("new_start"), F.size("_new").alias("new_end"))
    equal = (F.col("_head") == F.size("_old")) & (F.size("_old") == F.size("_new"))
    ranges = F.when(equal & F.col("_differs"), F.array(whole)).when(~equal, gaps)
    part = lambda name, start, end: F.when(end > start, F.array_join(F.slice(name, start + 1, end - start), "\n"))
    shaped = F.transform(
        ranges,
        lambda g: F.struct(
            g["old_start"].alias("old_start"), g["old_end"].alias("old_end"), g["new_start"].alias("new_start"), g["new_end"].alias("new_end"),
            part("_old", g["old_start"], g["old_end"]).alias("content_before"), part("_new", g["new_start"], g["new_end"]).alias("content_after"),
        ),
    )
    return joined.select("_pair", F.posexplode(shaped).alias("change_seq", "_c")).select("_pair.*", "_c.*", "change_seq")


def line_changes(pairs: DataFrame) -> DataFrame:
    """Change rows for pairs carrying old_text and new_text, with kind, section, size and suspicion score."""
    found = changed_ranges(pairs)
    before, after = F.col("content_before"), F.col("content_after")
    kind = F.when(before.isNull(), F.lit("addition")).when(after.isNull(), F.lit("deletion")).otherwise(F.lit("modification"))
    return (
        found.withColumn("change_type", kind)
        .withColumn("section_type", section_type(F.coalesce(after, before)))
        .withColumn("change_size", change_size(before, after))
        .withColumn("suspicion_score", suspicion(F.col("change_type"), before, after, F.coalesce(near_identical(before, after), F.lit(False))))
    )


def suspicious_changes(changes: DataFrame, since: Column | None = None, threshold: float = 0.3) -> DataFrame:
    """Changes at or above the threshold, optionally recent only, highest score first, with the patterns they added."""
    out = changes.where(F.col("suspicion_score") >= threshold)
    if since is not None:
        out = out.where(F.col("ts") >= since)
    return out.withColumn("detected_patterns", suspicious_patterns(F.col("content_after"))).orderBy(F.desc("suspicion_score"), "url", "version_number", "change_seq")


def gradual_modifications(changes: DataFrame, versions: DataFrame, section: str | None = "code_block", min_versions: int = 3, max_step: int = 100) -> DataFrame:
    """Places changed little by little over several versions.

    Changes are grouped by (url, old line range). The first and last change come
    from min_by/max_by and the rest from sums, so there is no ordered window and
    every aggregate combines map side.
    """
    pool = changes if section is None else changes.where(F.col("section_type") == section)
    order = F.struct("version_number", "change_seq")
    fields = F.struct("version_number", "ts", "content_before", "content_after", "change_size")
    size = F.coalesce("change_size", F.lit(0))
    grouped = pool.groupBy("url", "section_type", "old_start", "old_end").agg(
        F.count("*").alias("change_count"), F.sum(size).alias("_sum"), F.count_if(size > max_step).alias("_large"),
        F.min_by(fields, order).alias("_first"), F.max_by(fields, order).alias("_last"),
    )
    first_size = F.coalesce(F.col("_first.change_size"), F.lit(0))
    total = F.col("_sum") - first_size
    enough = versions.groupBy("url").agg(F.max("version_number").alias("_n")).where(F.col("_n") >= min_versions).select("url")
    tracks = grouped.where((F.col("change_count") >= 2) & (F.col("_large") - (first_size > max_step).cast("int") == 0) & (total > 0))
    return tracks.join(enough, "url", "left_semi").select(
        "url", F.concat(F.lit("gradual_"), F.when(F.col("section_type") == "code_block", F.lit("code")).otherwise(F.col("section_type")), F.lit("_modification")).alias("type"),
        F.concat_ws(":", F.col("old_start").cast("string"), F.col("old_end").cast("string")).alias("location"),
        F.col("_first.version_number").alias("start_version"), F.col("_last.version_number").alias("end_version"), F.col("_first.ts").alias("start_timestamp"), F.col("_last.ts").alias("end_timestamp"),
        "change_count", total.alias("total_change_size"), F.col("_first.content_before").alias("initial_content"), F.col("_last.content_after").alias("final_content"),
    )


def version_history(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """Every version with its change list; a group is the changes of one document pair."""
    entry = F.struct("change_seq", "change_type", "section_type", "change_size", "suspicion_score")
    lists = changes.groupBy("url", "version_number").agg(F.array_sort(F.collect_list(entry)).alias("changes"))
    return versions.join(lists, ["url", "version_number"], "left").select("url", "version_number", "ts", "changes").orderBy("url", "version_number")


def analysis_history(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """History row for every version after the first."""
    counted = changes.groupBy("url", "version_number").agg(F.count("*").alias("_n"))
    found = F.coalesce("_n", F.lit(0)) > 0
    return pairs.join(counted, ["url", "version_number"], "left").select(
        "url", "version_number", F.col("ts").alias("timestamp"), found.alias("changes_detected"), F.when(found, F.lit("Content changes detected")).otherwise(F.lit("No changes detected")).alias("change_summary")
    )


def compare_versions(versions: DataFrame, docs: DataFrame, version1: int, version2: int) -> DataFrame:
    """Unified diff, without context lines, of two versions of every URL that has both; empty where they are equal."""
    a = versions.where(F.col("version_number") == version1).select("url", F.col("doc_id").alias("old_doc_id"), F.col("ts").alias("timestamp1"))
    b = versions.where(F.col("version_number") == version2).select("url", F.col("doc_id").alias("new_doc_id"), F.col("ts").alias("timestamp2"))
    pairs = a.join(b, "url")
    span = lambda start, end: F.concat((F.col(start) + (F.col(end) > F.col(start)).cast("int")).cast("string"), F.lit(","), (F.col(end) - F.col(start)).cast("string"))
    marked = lambda text, mark: F.when(F.col(text).isNotNull(), F.concat(F.lit("\n" + mark), F.regexp_replace(text, "\n", "\n" + mark)))
    hunk = F.concat(F.lit("\n@@ -"), span("old_start", "old_end"), F.lit(" +"), span("new_start", "new_end"), F.lit(" @@"), F.coalesce(marked("content_before", "-"), F.lit("")), F.coalesce(marked("content_after", "+"), F.lit("")))
    ranges = changed_ranges(with_texts(pairs, docs)).select("url", "change_seq", hunk.alias("_hunk"))
    hunks = ranges.groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("change_seq", "_hunk"))), lambda h: h["_hunk"]), "").alias("_hunks"))
    diff = F.when(F.col("_hunks").isNotNull(), F.concat(F.lit(f"--- Version {version1}\n+++ Version {version2}"), F.col("_hunks"))).otherwise(F.lit(""))
    return pairs.join(hunks, "url", "left").select("url", F.lit(version1).alias("version1"), F.lit(version2).alias("version2"), "timestamp1", "timestamp2", diff.alias("unified_diff"))


def changes_between(changes: DataFrame, version1: int, version2: int) -> DataFrame:
    """Changes of versions version1+1 … version2."""
    return changes.where(F.col("version_number").between(version1 + 1, version2)).orderBy("url", "version_number", "change_seq")


def changes_with_version(changes: DataFrame, versions: DataFrame, url: Column) -> DataFrame:
    """Change rows of chosen URLs with the hash and time of their version."""
    v = versions.where(url).select("url", "version_number", "content_hash", F.col("ts").alias("version_ts"))
    return changes.join(v, ["url", "version_number"])


def change_frequency(versions: DataFrame) -> DataFrame:
    """Version count, first and latest date, gaps in days and changes per 30 days, for URLs with two or more versions.

    The median is the upper middle element, found from counts of equal gaps.
    """
    spans = versions.groupBy("url").agg(F.count("*").alias("versions_count"), F.min("ts").alias("first_version_date"), F.max("ts").alias("latest_version_date"))
    gaps = days_between(versions)
    stats = gaps.groupBy("url").agg(F.avg("days").alias("avg_days_between_changes"), F.min("days").alias("min_days_between_changes"), F.max("days").alias("max_days_between_changes"))
    medians = exact_quantiles(gaps, ["url"], "days", F.floor("days"), {"median_days_between_changes": ("upper", 0.5)})
    total = (F.unix_micros("latest_version_date") - F.unix_micros("first_version_date")) / 86.4e9
    per_month = F.when(total > 0, (F.col("versions_count") - 1) / (total / 30)).otherwise(F.lit(0.0))
    return spans.join(stats, "url").join(medians, "url").withColumn("changes_per_month", per_month)


def component_risks(findings: DataFrame, key: str, score: Column) -> DataFrame:
    """Highest severity score per component; a finding type naming several components counts for the first."""
    kind = F.lower("finding_type")
    names = [("markdown_risk", "markdown"), ("pattern_risk", "pattern"), ("secrets_risk", "secret"), ("static_risk", "static")]
    component = F.when(F.lit(False), F.lit(""))
    for column, word in names:
        component = component.when(F.contains(kind, F.lit(word)), F.lit(column))
    tagged = findings.select(key, component.alias("_c"), score.alias("_s"))
    return tagged.groupBy(key).agg(
        *[F.coalesce(F.max(F.when(F.col("_c") == column, F.col("_s"))), F.lit(0.0)).alias(column) for column, _ in names], F.max("_s").alias("overall_risk_score")
    )


def track_risk(latest: DataFrame, risks: DataFrame) -> DataFrame:
    """Risk-history rows: the scores of a URL against its latest version (which may be missing)."""
    return risks.join(latest.select("url", "version_number"), "url", "left")


def temporal_results(latest: DataFrame, suspicious: DataFrame, gradual: DataFrame, trend: DataFrame) -> DataFrame:
    """Per URL: version, whether changes were detected, counts, and the overall trend where there is one."""
    s = suspicious.groupBy("url").agg(F.count("*").alias("n_suspicious"), F.max("suspicion_score").alias("max_suspicion"))
    g = gradual.groupBy("url").agg(F.count("*").alias("n_gradual"))
    out = latest.join(s, "url", "left").join(g, "url", "left").join(trend, "url", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_suspicious", "n_gradual")})
    applies = F.col("version_number") > 1
    return out.withColumn("changes_detected", applies & ((F.col("n_suspicious") > 0) | (F.col("n_gradual") > 0)))


def temporal_rollup(results: DataFrame, suspicious: DataFrame, gradual: DataFrame, urls_per_group: int = 256) -> DataFrame:
    """What a report says of all URLs together: (kind, group_no, items) rows under one any-change flag, ``has_changes``.

    A report's flattened lists of suspicious changes and gradual modifications
    come in groups of URLs by a hash, so that no row holds the whole corpus; the
    flag and the totals come from one aggregate.
    """
    flags = results.agg(F.coalesce(F.bool_or("changes_detected"), F.lit(False)).alias("has_changes"), F.count("*").alias("_urls"))
    sizes = flags.withColumn("_groups", F.greatest(F.ceil(F.col("_urls") / urls_per_group), F.lit(1)))
    group = lambda url: F.pmod(F.xxhash64(url), F.col("_groups"))
    change = F.struct("url", "version_number", "change_seq", "change_type", "suspicion_score")
    step = F.struct("url", "location", "start_version", "end_version", "change_count")
    shaped = lambda rows, kind, item: rows.select(F.lit(kind).alias("kind"), "url", F.to_json(item).alias("item"))
    known = results.select("url")
    items = shaped(suspicious.join(known, "url", "left_semi"), "suspicious_changes", change).unionByName(shaped(gradual.join(known, "url", "left_semi"), "gradual_modifications", step))
    # one row of sizes: its broadcast is bounded
    grouped = items.join(F.broadcast(sizes)).groupBy("kind", group(F.col("url")).alias("group_no"), "has_changes").agg(F.array_sort(F.collect_list("item")).alias("items"))
    nothing = sizes.select(F.lit("summary").alias("kind"), F.lit(0).cast("long").alias("group_no"), "has_changes", F.array().cast("array<string>").alias("items"))
    return nothing.unionByName(grouped)
