"""Analysis of model responses: findings, behaviour profiles and response comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.matching import any_of, context_window, let, scan, with_offsets

FENCED = r"(?ds)```(?:\w+)?\n(.*?)\n```"
INLINE = r"`([^`]+)`"


def match_confidence(match: Column, sensitivity: int = 3) -> Column:
    """0.7, ±0.1 by match length, shifted by sensitivity, clamped to 0–1."""
    base = F.lit(0.7) + F.when(F.length(match) > 50, 0.1).when(F.length(match) < 10, -0.1).otherwise(0.0)
    return F.least(F.greatest(base + (sensitivity - 3) * 0.05, F.lit(0.0)), F.lit(1.0))


def _finding(keep: Sequence[str], kind: Column, subtype: Column, severity: Column, context: Column, start: Column, end: Column, sensitivity: int) -> list[Column]:
    return [
        *[F.col(k) for k in keep], kind.alias("type"), subtype.alias("subtype"), severity.alias("severity"), match_confidence(F.col("match"), sensitivity).alias("confidence"),
        context.alias("context"), F.col("match"), start.alias("start"), end.alias("end"),
    ]


def analyze(df: DataFrame, text: str = "response", keep: Sequence[str] = ("response_id",), types: Sequence[str] = R.RESPONSE_TYPES, extra: dict | None = None, sensitivity: int = 3) -> DataFrame:
    """Findings of the chosen analysis types.

    Malicious code counts only inside fenced (high) or inline (medium) code; its
    position is the code span's start plus the offset inside it.
    """
    prose = [t for t in types if t != "malicious_code"]
    parts = []
    if prose:
        hits = scan(df, text, R.response_rules(prose, extra), keep)
        parts.append(hits.select(*_finding(keep, F.col("family"), F.col("rule_name"), F.col("severity"), context_window(text), F.col("start"), F.col("end"), sensitivity)))
    if "malicious_code" in types:
        rules = R.response_rules(["malicious_code"], extra)
        base = df.select(*dict.fromkeys([*keep, text]))
        for pattern, inline in ((FENCED, False), (INLINE, True)):
            java_pattern = pattern.replace("(?ds)", "(?dsU)")
            spans = with_offsets(base.where(F.contains(text, F.lit("`"))), text, F.lit(java_pattern), {"code": 1}).select(*keep, F.col("start").alias("_base"), F.coalesce("code", F.lit("")).alias("code"))
            hits = scan(spans, "code", rules, [*keep, "_base"])
            suffix, severity = ("_inline", "medium") if inline else ("", "high")
            context = F.col("code") if inline else context_window("code")
            parts.append(
                hits.select(*_finding(keep, F.lit("malicious_code"), F.concat("rule_name", F.lit(suffix)), F.lit(severity), context, F.col("_base") + F.col("start"), F.col("_base") + F.col("end"), sensitivity))
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summarize(responses: DataFrame, findings: DataFrame, keep: Sequence[str] = ("response_id",), types: Sequence[str] = R.RESPONSE_TYPES) -> DataFrame:
    """Findings per type and in total for every response, including clean ones."""
    counts = findings.groupBy(*keep).agg(*[F.count_if(F.col("type") == t).alias(t) for t in types], F.count("*").alias("total_findings"))
    return responses.select(*keep).join(counts, list(keep), "left").na.fill(0)


def profile_matches(df: DataFrame, text: str = "response", keep: Sequence[str] = ("response_id",), profiles: dict | None = None, threshold: float = 0.7) -> DataFrame:
    """Indicator matches of the behaviour profiles at or above the confidence threshold."""
    hits = scan(df, text, R.profile_rules(profiles), keep)
    base = F.lit(0.7) + F.when(F.length("match") > 50, 0.1).when(F.length("match") < 10, -0.1).otherwise(0.0)
    confidence = F.least(F.greatest(base + F.least(F.lit(0.1), F.length("pattern") / 100), F.lit(0.0)), F.lit(1.0))
    scored = hits.withColumn("confidence", confidence).where(F.col("confidence") >= threshold)
    return scored.select(
        *keep, F.col("family").alias("profile"), F.col("category").alias("behavior"), F.col("rule_name").cast("int").alias("indicator"), F.col("message").alias("description"),
        "confidence", "weight", context_window(text).alias("context"), "match", "start", "end",
    )


def profile_scores(matches: DataFrame, keep: Sequence[str] = ("response_id",)) -> DataFrame:
    return matches.groupBy(*keep, "profile").agg(F.sum(F.col("confidence") * F.col("weight")).alias("score"), F.count("*").alias("n_matches"), F.array_sort(F.collect_set("behavior")).alias("behaviors"))


def dominant_profiles(scores: DataFrame, keep: Sequence[str] = ("response_id",), order: Sequence[str] = tuple(R.BEHAVIOR_PROFILES)) -> DataFrame:
    """Best-scoring profile; equal scores go to the profile defined first."""
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("profile"))
    rounded = F.round("score", 9)
    return scores.groupBy(*keep).agg(
        F.max_by("profile", F.struct(rounded, -rank)).alias("dominant_profile"), F.max("score").alias("dominant_score"), F.sum("n_matches").alias("total_matches")
    )


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity: 1 when both are empty, 0 when one is."""
    empty = F.array().cast("array<string>")
    x, y = F.coalesce(a, empty), F.coalesce(b, empty)
    return (
        F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0))
        .when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0))
        .otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    )


def response_pairs(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "response", step: int = 2) -> DataFrame:
    """Each response with the next one of its conversation: an equi-join on (conversation, turn + step)."""
    left = df.select(conversation, F.col(turn).alias("turn1"), (F.col(turn) + step).alias("turn2"), F.col(text).alias("response1"))
    right = df.select(conversation, F.col(turn).alias("turn2"), F.col(text).alias("response2"))
    return left.join(right, [conversation, "turn2"]).select(
        F.concat_ws(":", F.col(conversation).cast("string"), F.col("turn1").cast("string")).alias("pair_id"), conversation, "turn1", "turn2", "response1", "response2"
    )


def similarity(left: Column, right: Column) -> Column:
    """Twice the distinct lower-case words two texts share over the distinct words of both; 1 for two texts without words."""
    words = lambda text: F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))
    both = F.size(words(left)) + F.size(words(right))
    return F.when(left.isNull() | right.isNull(), F.lit(None).cast("double")).when(both == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(words(left), words(right))) / both)


def pair_similarity(pairs: DataFrame) -> DataFrame:
    """Hashes and text similarity of each pair."""
    return pairs.select("pair_id", F.md5("response1").alias("response1_hash"), F.md5("response2").alias("response2_hash"), similarity(F.col("response1"), F.col("response2")).alias("similarity_score"))


def compare_findings(first: DataFrame, second: DataFrame) -> DataFrame:
    """New and removed findings per pair and type, with the count difference.

    ``first`` and ``second`` carry pair_id, type and match. A finding is new when
    no finding of that type and text exists on the other side.
    """
    distinct = lambda df: df.groupBy("pair_id", "type", "match").agg(F.count("*").alias("n"))
    a = distinct(first).withColumnRenamed("n", "n1")
    b = distinct(second).withColumnRenamed("n", "n2")
    both = a.join(b, ["pair_id", "type", "match"], "full_outer").na.fill(0, ["n1", "n2"])
    return both.groupBy("pair_id", "type").agg(
        (F.sum("n2") - F.sum("n1")).alias("count_diff"), F.sum(F.when(F.col("n1") == 0, F.col("n2")).otherwise(0)).alias("new_findings"), F.sum(F.when(F.col("n2") == 0, F.col("n1")).otherwise(0)).alias("removed_findings")
    )


def compare_profiles(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per pair and profile: match difference, behaviour similarity, behaviours unique to each side.

    Inputs are ``profile_scores`` keyed by pair_id.
    """
    a = first.select("pair_id", "profile", F.col("n_matches").alias("n1"), F.col("behaviors").alias("b1"))
    b = second.select("pair_id", "profile", F.col("n_matches").alias("n2"), F.col("behaviors").alias("b2"))
    empty = F.array().cast("array<string>")
    both = a.join(b, ["pair_id", "profile"], "full_outer").withColumns({"b1": F.coalesce("b1", empty), "b2": F.coalesce("b2", empty)}).na.fill(0, ["n1", "n2"])
    return both.select(
        "pair_id", "profile", (F.col("n2") - F.col("n1")).alias("match_count_diff"), jaccard(F.col("b1"), F.col("b2")).alias("similarity"),
        F.array_except("b1", "b2").alias("unique_to_response1"), F.array_except("b2", "b1").alias("unique_to_response2"),
    )


def overall_similarity(pairs: DataFrame, by_profile: DataFrame, dominant1: DataFrame, dominant2: DataFrame) -> DataFrame:
    """Mean profile similarity per pair (0 when no profile matched) and whether the dominant profiles agree."""
    mean = by_profile.groupBy("pair_id").agg(F.avg("similarity").alias("_m"))
    d1 = dominant1.select("pair_id", F.col("dominant_profile").alias("_d1"))
    d2 = dominant2.select("pair_id", F.col("dominant_profile").alias("_d2"))
    out = pairs.select("pair_id").join(mean, "pair_id", "left").join(d1, "pair_id", "left").join(d2, "pair_id", "left")
    return out.select("pair_id", F.coalesce("_m", F.lit(0.0)).alias("similarity"), F.col("_d1").eqNullSafe(F.col("_d2")).alias("dominant_profile_match"))


def prompt_intent(prompt: Column) -> Column:
    """injection, credential or code request by keyword; first class that hits."""

    def intent(lowered: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for name, words in R.INTENT_KEYWORDS:
            out = out.when(any_of(lowered, words), F.lit(name))
        return out.otherwise(F.lit("default"))

    return let(F.lower(prompt), intent)


def sessions(turns: DataFrame, session: str = "conv_id", at: str = "ts") -> DataFrame:
    """Session start, duration in seconds and interaction count."""
    seconds = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1e6
    return turns.groupBy(F.col(session).alias("session_id")).agg(F.min(at).alias("session_start"), seconds.alias("session_duration"), F.count("*").alias("interaction_count"))
