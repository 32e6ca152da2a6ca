"""Scoring, response-analysis and variation queries."""

from pyspark.sql import functions as F

from .. import rules as R
from ..functions.patterns import re2, sql_str
from ..operators import augment as AU
from ..operators import responses as RSP
from ..operators import scoring as SCO
from ..operators import secrets as S
from ..session import materialize
from . import derived as D
from .registry import query
from .secrets_queries import deduped_sql
from .sqlgen import case_map, contains_any, find_all_sql, scan_sql

_MD, _RS = D.MARKDOWN_SQL, D.RESPONSE_SQL

# --- evidence and dimensions: built from labels and events so every branch occurs --------------
_EV = """(SELECT event_id, CASE event_id % 6 WHEN 0 THEN [] WHEN 1 THEN [{'source': 'TEXT_PATTERN_WEAK', 'strength': value / 500}] WHEN 2 THEN [{'source': 'YARA_RULE_HIGH_CONFIDENCE', 'strength': 0.9}, {'source': 'SEMGREP_PRECISE_MATCH', 'strength': NULL}]
  WHEN 3 THEN [{'source': 'TRUFFLEHOG_VERIFIED', 'strength': 0.9}, {'source': 'BEHAVIOR_CONFIRMED', 'strength': 0.8}, {'source': 'YARA_RULE_HIGH_CONFIDENCE', 'strength': 1.0}, {'source': 'SEMGREP_PRECISE_MATCH', 'strength': 1.0}]
  WHEN 4 THEN [{'source': 'NEVER_HEARD_OF', 'strength': NULL}] ELSE [{'source': 'MANUAL_VERIFICATION', 'strength': 0.7}, {'source': 'TRUFFLEHOG_VERIFIED', 'strength': 0.5}] END AS ev FROM events)"""


def _evidence():
    item = lambda s, v: F.struct(F.lit(s).alias("source"), (v if hasattr(v, "cast") else F.lit(v)).cast("double").alias("strength"))
    k = F.col("event_id") % 6
    empty = F.array().cast("array<struct<source:string,strength:double>>")
    return (
        F.when(k == 0, empty)
        .when(k == 1, F.array(item("TEXT_PATTERN_WEAK", F.col("value") / 500)))
        .when(k == 2, F.array(item("YARA_RULE_HIGH_CONFIDENCE", 0.9), item("SEMGREP_PRECISE_MATCH", None)))
        .when(k == 3, F.array(item("TRUFFLEHOG_VERIFIED", 0.9), item("BEHAVIOR_CONFIRMED", 0.8), item("YARA_RULE_HIGH_CONFIDENCE", 1.0), item("SEMGREP_PRECISE_MATCH", 1.0)))
        .when(k == 4, F.array(item("NEVER_HEARD_OF", None)))
        .otherwise(F.array(item("MANUAL_VERIFICATION", 0.7), item("TRUFFLEHOG_VERIFIED", 0.5)))
    )


def _confidence_sql(ev: str, table: dict) -> str:
    w = case_map("e.source", table, str(table["DEFAULT_SOURCE"]))
    return f"""CASE WHEN len({ev}) = 0 THEN 0.3 ELSE least(greatest(list_sum(list_transform({ev}, lambda e: coalesce(e.strength, {w}) * {w})) / len({ev})
      + CASE WHEN len(list_filter({ev}, lambda e: {w} >= 0.75)) > 1 THEN least(0.1 * (len(list_filter({ev}, lambda e: {w} >= 0.75)) - 1), 0.2) ELSE 0 END, 0.0), 1.0) END"""


@query(
    "evidence_confidence",
    "AGG-15",
    f"SELECT event_id, round({_confidence_sql('ev', R.SOURCE_RELIABILITY)}, 6) AS model_confidence, round({_confidence_sql('ev', R.ASSESSOR_RELIABILITY)}, 6) AS assessor_confidence FROM {_EV}",
)
def evidence_confidence(spark, sf):
    ev = D.table(spark, sf, "events").select("event_id", _evidence().alias("ev"))
    return ev.select("event_id", F.round(SCO.evidence_confidence(F.col("ev")), 6).alias("model_confidence"), F.round(SCO.evidence_confidence(F.col("ev"), R.ASSESSOR_RELIABILITY), 6).alias("assessor_confidence"))


@query(
    "dimension_scores",
    "AGG-16 RISK-1 RISK-2",
    """WITH d AS (SELECT event_id, least(value / 200, 1.0) AS impact, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE (event_id % 10) / 10.0 END AS likelihood, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 0.9 END AS confidence FROM events),
       s AS (SELECT *, (impact * 0.5 + likelihood * 0.3 + 0.6 * 0.2) / 1.0 * coalesce(confidence, 1.0) AS score FROM d)
       SELECT event_id, round(score + 1e-9, 6) AS aggregate_score, round(impact * 0.5, 6) AS weighted_impact, coalesce(confidence, 1.0) AS confidence,
         CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' WHEN score >= 0.3 THEN 'low' ELSE 'info' END AS severity FROM s""",
)
def dimension_scores(spark, sf):
    ev = D.table(spark, sf, "events")
    likelihood = F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 10) / 10.0)
    scores = F.create_map(F.lit("impact"), F.expr("least(value / 200, 1.0D)"), F.lit("likelihood"), likelihood, F.lit("exposure"), F.lit(0.6))
    confidence = F.when(F.col("event_id") % 7 != 0, F.lit(0.9))
    rows = ev.select("event_id", scores.alias("scores"), confidence.alias("given"))
    score = F.when(F.col("given").isNotNull(), SCO.aggregate_score(F.col("scores"), F.col("given"))).otherwise(SCO.aggregate_score(F.col("scores")))
    return rows.select("event_id", F.round(score + 1e-9, 6).alias("aggregate_score"), F.round(SCO.dimension_breakdown(F.col("scores"))["impact"]["weighted"], 6).alias("weighted_impact"), F.coalesce("given", F.lit(1.0)).alias("confidence"), SCO.classify(score).alias("severity"))


def _categories_sql(text: str) -> str:
    items = ", ".join(f"CASE WHEN {contains_any(f'lower({text})', words)} THEN '{c}' END" for c, words in R.CATEGORY_KEYWORDS.items())
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


@query("finding_categories", "RISK-3", f"SELECT doc_id, coalesce(nullif(array_to_string(c, ','), ''), 'uncategorized') AS categories, coalesce(c[1], 'uncategorized') AS primary_category FROM (SELECT doc_id, {_categories_sql('text')} AS c FROM {_MD})")
def finding_categories(spark, sf):
    docs = D.markdown(spark, sf).select("doc_id", SCO.categories(F.col("text")).alias("c"))
    return docs.select("doc_id", F.array_join("c", ",").alias("categories"), F.element_at("c", 1).alias("primary_category"))


def _purposes_sql(text: str, n: int) -> str:
    items = []
    for i, (name, (weight, words, patterns)) in enumerate(R.PURPOSES.items()):
        hits = " + ".join([f"contains(lower({text}), {sql_str(w.lower())})::int" for w in words] + [f"2 * regexp_matches({text}, {sql_str(re2(p, 'i'))})::int" for p in patterns])
        items.append(f"{{'o': -(({hits}) * {weight}::double), 'i': {i}, 'name': '{name}'}}")
    ranked = f"list_transform(list_sort(list_filter([{', '.join(items)}], lambda s: s.o < 0))[1:{n}], lambda s: s.name)"
    return f"CASE WHEN len({ranked}) > 0 THEN {ranked} ELSE ['unknown'] END"


@query("content_purposes", "RISK-4 TOP-4", f"SELECT doc_id, array_to_string({_purposes_sql('text', 3)}, ',') AS purposes FROM {_MD}")
def content_purposes(spark, sf):
    return D.markdown(spark, sf).select("doc_id", F.array_join(SCO.top_purposes(F.col("text"), 3), ",").alias("purposes"))


_DOMAIN = "CASE page_id % 9 WHEN 0 THEN 'agency.GOV' WHEN 1 THEN 'cheap.xyz' WHEN 2 THEN 'news.info' WHEN 3 THEN 'git.internal.company.com' WHEN 4 THEN 'phish-login.com' WHEN 5 THEN 'known.example.com' WHEN 6 THEN NULL ELSE regexp_extract(url, '^https?://([^/?#]*)', 1) END"
_REP_SQL = """CASE WHEN d = 'known.example.com' THEN 0.95 WHEN d LIKE '%.gov' OR d LIKE '%.edu' OR contains(d, 'internal.company.com') THEN 0.9 WHEN d LIKE '%.xyz' OR d LIKE '%.top' OR contains(d, 'suspicious') OR contains(d, 'phish') THEN 0.2
  WHEN d LIKE '%.info' OR d LIKE '%.biz' THEN 0.4 WHEN d IS NOT NULL THEN 0.5 END"""


@query("domain_reputation", "JOIN-22 RX-11", f"SELECT page_id, domain, {_REP_SQL} AS domain_reputation FROM (SELECT page_id, {_DOMAIN} AS domain, lower({_DOMAIN}) AS d FROM pages)")
def domain_reputation(spark, sf):
    pages = D.table(spark, sf, "pages").select("page_id", F.expr(_DOMAIN).alias("domain"))
    known = D.table(spark, sf, "pages").select(F.lit("Known.example.com").alias("domain"), F.lit(0.95).alias("score")).distinct()
    return SCO.with_reputation(pages, known)


# --- baseline and assessment -------------------------------------------------------------------
_F_SQL = f"(SELECT doc_id, rule_id, finding_type, severity, detector, description, evidence, start AS line, source AS file_path FROM {deduped_sql(_MD)} JOIN documents USING (doc_id))"
_KEY_SQL = "concat_ws('|', finding_type, rule_id, cast(line as varchar), file_path)"
_STATUS = "CASE doc_id % 4 WHEN 0 THEN 'accepted_risk' WHEN 1 THEN 'false_positive' WHEN 2 THEN 'custom_status' ELSE NULL END"
_BASE_SQL = f"(SELECT file_path AS context_id, {_KEY_SQL} AS k, arg_min(coalesce({_STATUS}, 'unknown_status_in_baseline'), doc_id) AS status FROM {_F_SQL} WHERE doc_id % 3 = 0 GROUP BY ALL)"


def _findings(spark, sf):
    found = S.secret_findings(D.markdown(spark, sf), keep=("doc_id", "source"))
    rows = found.select("doc_id", "rule_id", "finding_type", "severity", "detector", "description", "evidence", F.col("start").alias("line"), F.col("source").alias("file_path"), F.col("source").alias("context_id"))
    return materialize(rows, "findings")


def _baseline(found):
    return found.where("doc_id % 3 = 0").select("context_id", SCO.baseline_key().alias("baseline_key"), F.expr(_STATUS).alias("status"), F.col("doc_id").alias("seq"))


@query(
    "baseline_comparison",
    "JOIN-11",
    f"""SELECT f.doc_id, f.rule_id, line, CASE WHEN k IS NOT NULL THEN 1.0 ELSE 0.2 END AS similarity_score, b.status AS baseline_status, k IS NULL AS is_novel FROM {_F_SQL} f LEFT JOIN {_BASE_SQL} b ON b.context_id = f.file_path AND b.k = {_KEY_SQL}""",
)
def baseline_comparison(spark, sf):
    found = _findings(spark, sf)
    return SCO.compare_baseline(found, _baseline(found)).select("doc_id", "rule_id", "line", "similarity_score", "baseline_status", "is_novel")


@query("novel_findings", "JOIN-11", f"SELECT f.doc_id, f.rule_id, line FROM {_F_SQL} f WHERE NOT EXISTS (SELECT 1 FROM {_BASE_SQL} b WHERE b.context_id = f.file_path AND b.k = {_KEY_SQL})")
def novel_findings(spark, sf):
    found = _findings(spark, sf)
    return SCO.novel_only(found, _baseline(found)).select("doc_id", "rule_id", "line")


@query(
    "baseline_update",
    "JOIN-12",
    f"""WITH n AS (SELECT file_path AS context_id, {_KEY_SQL} AS k, min(CASE WHEN doc_id % 2 = 0 THEN 'mitigated_by_waf' END) AS s FROM {_F_SQL} WHERE doc_id % 5 = 0 GROUP BY ALL)
        SELECT coalesce(b.context_id, n.context_id) AS context_id, coalesce(b.k, n.k) AS baseline_key, CASE WHEN n.k IS NOT NULL THEN coalesce(n.s, 'newly_added_to_baseline') ELSE b.status END AS status FROM {_BASE_SQL} b FULL JOIN n ON b.context_id = n.context_id AND b.k = n.k""",
)
def baseline_update(spark, sf):
    found = _findings(spark, sf)
    base = _baseline(found).groupBy("context_id", "baseline_key").agg(F.min_by(F.coalesce("status", F.lit("unknown_status_in_baseline")), "seq").alias("status"))
    new = found.where("doc_id % 5 = 0").select("context_id", SCO.baseline_key().alias("baseline_key"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'mitigated_by_waf' END").alias("status"))
    return SCO.update_baseline(base, new.groupBy("context_id", "baseline_key").agg(F.min("status").alias("status")))


def _assess_sql() -> str:
    strength = "(length(evidence) % 10) / 10.0"
    rel = {d: R.SOURCE_RELIABILITY[s] for d, s in R.DETECTOR_SOURCE.items()}
    adjusted = f"""least(greatest(agg * CASE WHEN rep >= 0.8 THEN 0.8 WHEN rep <= 0.3 THEN 1.25 ELSE 1.0 END * {case_map('pur[1]', R.PURPOSE_MULTIPLIERS, '1.0')}
      * CASE WHEN novel THEN 1.15 ELSE 1.0 END * {case_map('status', R.STATUS_MULTIPLIERS, '1.0')}, 0.0), 1.0)"""
    return f"""WITH f AS (SELECT f.*, b.status, b.k IS NULL AS novel, md.text, {strength} * {case_map('detector', rel)} AS conf, {case_map('severity', {k.capitalize(): v for k, v in R.SEVERITY_IMPACT.items()}, '0.0')} AS impact,
          {case_map('detector', R.DETECTOR_EXPOSURE, '0.5')} AS exposure, CASE f.doc_id % 3 WHEN 0 THEN 'x.gov' WHEN 1 THEN 'y.xyz' ELSE 'z.com' END AS domain
          FROM {_F_SQL} f JOIN {_MD} md USING (doc_id) LEFT JOIN {_BASE_SQL} b ON b.context_id = f.file_path AND b.k = {_KEY_SQL}),
      g AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.2 ELSE 0.5 END AS rep, {_purposes_sql('text', 3)} AS pur, (impact * 0.5 + conf * 0.3 + exposure * 0.2) * conf AS agg FROM f),
      h AS (SELECT *, {adjusted} AS final FROM g)
      SELECT doc_id, rule_id, line, round(conf, 6) AS model_confidence, round(agg, 6) AS aggregate_score, round(final, 6) AS final_score, array_to_string(pur, ',') AS content_purposes,
        CASE WHEN final >= 0.85 THEN 'critical' WHEN final >= 0.7 THEN 'high' WHEN final >= 0.5 THEN 'medium' WHEN final >= 0.3 THEN 'low' ELSE 'info' END AS risk_severity, coalesce({_categories_sql('description')}[1], 'uncategorized') AS primary_category FROM h"""


@query("risk_assessment", "RISK-6 RISK-5 RISK-1 RISK-2 RISK-3 RISK-4 JOIN-22 AGG-15 AGG-16", _assess_sql())
def risk_assessment(spark, sf):
    found = _findings(spark, sf)
    sources = F.create_map(*[F.lit(x) for kv in R.DETECTOR_SOURCE.items() for x in kv])
    item = F.struct(sources[F.col("detector")].alias("source"), ((F.length("evidence") % 10) / 10.0).alias("strength"))
    ready = found.join(SCO.document_purposes(D.markdown(spark, sf)), "doc_id").withColumn("evidence_items", F.array(item))
    ready = ready.withColumn("domain", F.expr("CASE doc_id % 3 WHEN 0 THEN 'x.gov' WHEN 1 THEN 'y.xyz' ELSE 'z.com' END"))
    ready = ready.withColumn("scores", SCO.finding_dimensions(F.col("severity"), F.col("detector"), SCO.evidence_confidence(F.col("evidence_items"))))
    out = SCO.assess(ready, _baseline(found))
    rounded = [F.round(c, 6).alias(c) for c in ("model_confidence", "aggregate_score", "final_score")]
    return out.select("doc_id", "rule_id", "line", *rounded, F.array_join("content_purposes", ",").alias("content_purposes"), "risk_severity", "primary_category")


# --- responses ---------------------------------------------------------------------------------
_CONF = "round(least(greatest(0.7 + CASE WHEN length(match) > 50 THEN 0.1 WHEN length(match) < 10 THEN -0.1 ELSE 0 END, 0.0), 1.0), 6)"


def _response_findings_sql() -> str:
    prose = R.response_rules([t for t in R.RESPONSE_TYPES if t != "malicious_code"])
    ctx = lambda t: f'substr({t}, greatest(start - 50, 0) + 1, "end" + 50 - greatest(start - 50, 0))'
    parts = [f'SELECT conv_id, turn, family AS type, rule_name AS subtype, severity, {_CONF} AS confidence, md5({ctx("response")}) AS context_md5, match, start, "end" FROM {scan_sql(_RS, "conv_id, turn", "response", prose)}']
    for pattern, flags, inline in ((RSP.FENCED.replace("(?ds)", ""), "s", False), (RSP.INLINE, "", True)):
        spans = f"(SELECT conv_id, turn, start AS base, coalesce(code, '') AS code FROM ({find_all_sql(_RS, 'conv_id, turn', 'response', pattern, flags, '', {'code': 1})}))"
        hits = scan_sql(spans, "conv_id, turn, base", "code", R.response_rules(["malicious_code"]))
        sub, sev = ("rule_name || '_inline'", "'medium'") if inline else ("rule_name", "'high'")
        c = "code" if inline else ctx("code")
        parts.append(f'SELECT conv_id, turn, \'malicious_code\', {sub}, {sev}, {_CONF}, md5({c}), match, base + start, base + "end" FROM {hits}')
    return "(" + " UNION ALL ".join(parts) + ")"


_KEYS = ("conv_id", "turn")


@query("response_findings", "RSP-1 RSP-2 RSP-3 RX-0", f"SELECT * FROM {_response_findings_sql()}")
def response_findings(spark, sf):
    out = RSP.analyze(D.responses(spark, sf), keep=_KEYS)
    return out.select(*_KEYS, "type", "subtype", "severity", F.round("confidence", 6).alias("confidence"), F.md5("context").alias("context_md5"), "match", "start", "end")


@query("response_summary", "AGG-12", f"SELECT r.conv_id, r.turn, {', '.join(f'coalesce(count_if(f.type = {chr(39)}{t}{chr(39)}), 0) AS {t}' for t in R.RESPONSE_TYPES)}, count(f.type) AS total_findings FROM {_RS} r LEFT JOIN {_response_findings_sql()} f ON f.conv_id = r.conv_id AND f.turn = r.turn GROUP BY ALL")
def response_summary(spark, sf):
    rs = D.responses(spark, sf)
    return RSP.summarize(rs, RSP.analyze(rs, keep=_KEYS), keep=_KEYS)


_PROFILE_SQL = f"""(SELECT conv_id, turn, family AS profile, category AS behavior, weight, match, c AS confidence FROM (SELECT *, least(greatest(0.7 + CASE WHEN length(match) > 50 THEN 0.1 WHEN length(match) < 10 THEN -0.1 ELSE 0 END + least(0.1, pattern_length / 100), 0.0), 1.0) AS c
   FROM {scan_sql(_RS, 'conv_id, turn', 'response', R.profile_rules())}) WHERE round(c, 12) >= 0.7)"""


@query("behavior_profiles", "RSP-6 RSP-7 AGG-13", f"SELECT conv_id, turn, profile, round(sum(confidence * weight), 6) AS score, count(*) AS n_matches, string_agg(DISTINCT behavior, ',' ORDER BY behavior) AS behaviors FROM {_PROFILE_SQL} GROUP BY ALL")
def behavior_profiles(spark, sf):
    scores = RSP.profile_scores(RSP.profile_matches(D.responses(spark, sf), keep=_KEYS), _KEYS)
    return scores.select(*_KEYS, "profile", F.round("score", 6).alias("score"), "n_matches", F.array_join("behaviors", ",").alias("behaviors"))


@query(
    "dominant_profiles",
    "AGG-13",
    f"""WITH s AS (SELECT conv_id, turn, profile, sum(confidence * weight) AS score, count(*) AS n FROM {_PROFILE_SQL} GROUP BY ALL)
        SELECT conv_id, turn, arg_max(profile, (round(score, 9), CASE profile WHEN 'secure' THEN 1 ELSE 0 END)) AS dominant_profile, round(max(score), 6) AS dominant_score, sum(n)::bigint AS total_matches FROM s GROUP BY ALL""",
)
def dominant_profiles(spark, sf):
    scores = RSP.profile_scores(RSP.profile_matches(D.responses(spark, sf), keep=_KEYS), _KEYS)
    return RSP.dominant_profiles(scores, _KEYS).withColumn("dominant_score", F.round("dominant_score", 6))


_PAIRS = f"(SELECT a.conv_id || ':' || a.turn AS pair_id, a.conv_id, a.turn AS turn1, b.turn AS turn2, a.response AS r1, b.response AS r2 FROM {_RS} a JOIN {_RS} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2)"


def _pairs(spark, sf):
    return RSP.response_pairs(D.responses(spark, sf))


_WORDS = lambda t: f"list_distinct(list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda w: w <> ''))"


@query(
    "response_similarity",
    "RSP-4 RSP-5",
    f"""SELECT pair_id, md5(r1) AS response1_hash, md5(r2) AS response2_hash, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS similarity_score
        FROM (SELECT *, {_WORDS('r1')} AS a, {_WORDS('r2')} AS b FROM {_PAIRS})""",
)
def response_similarity(spark, sf):
    return RSP.pair_similarity(_pairs(spark, sf)).withColumn("similarity_score", F.round("similarity_score", 6))


def _sided(df, pairs):
    """Findings of every response attached to the pairs it is first or second in."""
    keys = pairs.select("pair_id", "conv_id", "turn1", "turn2")
    first = keys.select("pair_id", "conv_id", F.col("turn1").alias("turn")).join(df, ["conv_id", "turn"])
    second = keys.select("pair_id", "conv_id", F.col("turn2").alias("turn")).join(df, ["conv_id", "turn"])
    return first, second


@query(
    "response_finding_diff",
    "JOIN-17 RSP-5",
    f"""WITH f AS (SELECT * FROM {_response_findings_sql()}), p AS (SELECT pair_id, conv_id, turn1, turn2 FROM {_PAIRS}),
        a AS (SELECT pair_id, type, match, count(*) AS n FROM p JOIN f ON f.conv_id = p.conv_id AND f.turn = turn1 GROUP BY ALL), b AS (SELECT pair_id, type, match, count(*) AS n FROM p JOIN f ON f.conv_id = p.conv_id AND f.turn = turn2 GROUP BY ALL)
        SELECT pair_id, type, (sum(coalesce(b.n, 0)) - sum(coalesce(a.n, 0)))::bigint AS count_diff, sum(CASE WHEN a.n IS NULL THEN b.n ELSE 0 END)::bigint AS new_findings, sum(CASE WHEN b.n IS NULL THEN a.n ELSE 0 END)::bigint AS removed_findings FROM a FULL JOIN b USING (pair_id, type, match) GROUP BY ALL""",
)
def response_finding_diff(spark, sf):
    found = RSP.analyze(D.responses(spark, sf), keep=_KEYS).select("conv_id", "turn", "type", "match")
    return RSP.compare_findings(*_sided(found, _pairs(spark, sf)))


@query(
    "profile_comparison",
    "RSP-8 SET-4 SET-5",
    f"""WITH s AS (SELECT conv_id, turn, profile, count(*) AS n, list_distinct(list(behavior)) AS bs FROM {_PROFILE_SQL} GROUP BY ALL), p AS (SELECT pair_id, conv_id, turn1, turn2 FROM {_PAIRS}),
        a AS (SELECT pair_id, profile, n, bs FROM p JOIN s ON s.conv_id = p.conv_id AND s.turn = turn1), b AS (SELECT pair_id, profile, n, bs FROM p JOIN s ON s.conv_id = p.conv_id AND s.turn = turn2)
        SELECT pair_id, profile, coalesce(b.n, 0) - coalesce(a.n, 0) AS match_count_diff, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 0.0 ELSE round(len(list_intersect(a.bs, b.bs)) / len(list_distinct(list_concat(a.bs, b.bs))), 6) END AS similarity,
          array_to_string(list_sort(list_filter(coalesce(a.bs, []), lambda x: NOT list_contains(coalesce(b.bs, []), x))), ',') AS unique_to_response1,
          array_to_string(list_sort(list_filter(coalesce(b.bs, []), lambda x: NOT list_contains(coalesce(a.bs, []), x))), ',') AS unique_to_response2 FROM a FULL JOIN b USING (pair_id, profile)""",
)
def profile_comparison(spark, sf):
    scores = RSP.profile_scores(RSP.profile_matches(D.responses(spark, sf), keep=_KEYS), _KEYS)
    out = RSP.compare_profiles(*_sided(scores, _pairs(spark, sf)))
    joined = [F.array_join(F.array_sort(c), ",").alias(c) for c in ("unique_to_response1", "unique_to_response2")]
    return out.select("pair_id", "profile", "match_count_diff", F.round("similarity", 6).alias("similarity"), *joined)


@query(
    "pair_overall_similarity",
    "RSP-8 SET-5",
    f"""WITH s AS (SELECT conv_id, turn, profile, sum(confidence * weight) AS score, list_distinct(list(behavior)) AS bs FROM {_PROFILE_SQL} GROUP BY ALL), p AS (SELECT pair_id, conv_id, turn1, turn2 FROM {_PAIRS}),
        d AS (SELECT conv_id, turn, arg_max(profile, (round(score, 9), CASE profile WHEN 'secure' THEN 1 ELSE 0 END)) AS dom FROM s GROUP BY ALL),
        a AS (SELECT pair_id, profile, bs FROM p JOIN s ON s.conv_id = p.conv_id AND s.turn = turn1), b AS (SELECT pair_id, profile, bs FROM p JOIN s ON s.conv_id = p.conv_id AND s.turn = turn2),
        m AS (SELECT pair_id, avg(CASE WHEN a.bs IS NULL OR b.bs IS NULL THEN 0.0 ELSE len(list_intersect(a.bs, b.bs)) / len(list_distinct(list_concat(a.bs, b.bs))) END) AS s FROM a FULL JOIN b USING (pair_id, profile) GROUP BY pair_id)
        SELECT p.pair_id, round(coalesce(m.s, 0.0), 6) AS similarity, d1.dom IS NOT DISTINCT FROM d2.dom AS dominant_profile_match FROM p LEFT JOIN m USING (pair_id) LEFT JOIN d d1 ON d1.conv_id = p.conv_id AND d1.turn = turn1 LEFT JOIN d d2 ON d2.conv_id = p.conv_id AND d2.turn = turn2""",
)
def pair_overall_similarity(spark, sf):
    scores = RSP.profile_scores(RSP.profile_matches(D.responses(spark, sf), keep=_KEYS), _KEYS)
    pairs = _pairs(spark, sf)
    first, second = _sided(scores, pairs)
    out = RSP.overall_similarity(pairs, RSP.compare_profiles(first, second), RSP.dominant_profiles(first, ("pair_id",)), RSP.dominant_profiles(second, ("pair_id",)))
    return out.withColumn("similarity", F.round("similarity", 6))


_PROMPT = "concat(text, CASE conv_id % 5 WHEN 0 THEN ' Disregard that.' WHEN 1 THEN ' What is the API key?' WHEN 2 THEN ' run eval(x)' ELSE '' END)"


@query(
    "prompt_intents",
    "RSP-9",
    f"""SELECT conv_id, turn, CASE {' '.join(f"WHEN {contains_any('lower(p)', words)} THEN '{k}'" for k, words in R.INTENT_KEYWORDS)} ELSE 'default' END AS intent FROM (SELECT conv_id, turn, {_PROMPT} AS p FROM conversations WHERE role = 'user')""",
)
def prompt_intents(spark, sf):
    return D.table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", RSP.prompt_intent(F.expr(_PROMPT)).alias("intent"))


@query("interaction_sessions", "STR-8", "SELECT conv_id AS session_id, min(turn) * 60 AS start_offset, (max(turn) - min(turn)) * 60.0 AS session_duration, count(*) AS interaction_count FROM conversations GROUP BY conv_id")
def interaction_sessions(spark, sf):
    turns = D.table(spark, sf, "conversations").select("conv_id", F.timestamp_seconds(F.col("turn") * 60).alias("ts"))
    return RSP.sessions(turns).select("session_id", F.unix_seconds("session_start").alias("start_offset"), "session_duration", "interaction_count")


# --- variations --------------------------------------------------------------------------------
_ITEM = "CASE WHEN doc_id % 3 = 0 THEN concat('# LLMs.txt', chr(10), chr(10), '## System Instructions', chr(10), 'Be kind', chr(10), chr(10), '## User Queries', chr(10), 'Hello', chr(10), chr(10), '## Notes', chr(10), text) ELSE text END"
_PATH = "concat('d', cast(doc_id as string), CASE doc_id % 4 WHEN 0 THEN '.llms.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.py' ELSE '.bin' END)"


def _varied(spark, sf, where="true"):
    docs = D.documents(spark, sf, "doc_id", "text").where(where).select(F.expr(_PATH).alias("path"), F.expr(_ITEM).alias("content"))
    return AU.variations(docs)


def _bodies_sql() -> str:
    sysm, user = "'Be kind'", "'Hello'"
    notes = "regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')"
    build = lambda a, b: f"concat('# LLMs.txt', chr(10), chr(10), '## System Instructions', chr(10), chr(10), {a}, chr(10), chr(10), '## User Queries', chr(10), chr(10), {b}, chr(10), chr(10), '## Notes', chr(10), chr(10), {notes}, chr(10), chr(10))"
    lit = lambda t: sql_str(t).replace("\n", "' || chr(10) || '")
    rows = [f"SELECT path, 'prompt_injection' AS type, {i} AS k, {build(sysm, f'({lit(t)} || chr(10) || chr(10) || {user})')} AS content FROM d" for i, t in enumerate(R.INJECTION_TEXTS, 1)]
    rows += [f"SELECT path, 'malicious_code', {i}, {build(sysm, f'({lit(f'{R.CODE_REQUEST}{chr(10)}{chr(10)}{t}{chr(10)}{chr(10)}')} || {user})')} FROM d" for i, t in enumerate(R.CODE_TEXTS, 1)]
    rows += [f"SELECT path, 'credential_exposure', {i}, {build(f'({sysm} || {lit(f'{chr(10)}{chr(10)}Environment variables:{chr(10)}{t}')})', user)} FROM d" for i, t in enumerate(R.CREDENTIAL_TEXTS, 1)]
    # the chosen section of each kind, 0 to 2 in page order, by the same hash of path and seed
    pick = lambda seed: f"CAST('0x' || substr(md5(path || '|{seed}'), 1, 15) AS BIGINT) % 3"
    part = lambda name, body: f"concat('## {name}', chr(10), chr(10), {body}, chr(10), chr(10))"
    names, parts = ("System Instructions", "User Queries", "Notes"), (sysm, user, notes)
    changed = lambda seed, change: "concat('# LLMs.txt', chr(10), chr(10), " + ", ".join(f"CASE WHEN {pick(seed)} = {i} THEN {change(n, b)} ELSE {part(n, b)} END" for i, (n, b) in enumerate(zip(names, parts, strict=True))) + ")"
    control = "array_to_string(list_transform(range(128, 160), lambda i: chr(i::int)), '')"
    words = lambda b: f"array_to_string(list_filter(regexp_split_to_array({b}, '\\s+'), lambda w: w <> ''), chr(8203) || chr(8204) || chr(8205) || chr(65279))"
    rows += [
        "SELECT path, 'baseline', 0, content FROM d",
        "SELECT path, 'structural_variation', 2, replace(content, '## ', '### ') FROM d",
        f"SELECT path, 'structural_variation', 1, {changed(1, lambda n, b: chr(39) * 2)} FROM d",
        f"SELECT path, 'special_characters', 1, {changed(2, lambda n, b: part(n, f'concat({control}, {b})'))} FROM d",
        f"SELECT path, 'special_characters', 2, {changed(3, lambda n, b: part(n, words(b)))} FROM d",
    ]
    return f"""WITH d AS (SELECT {D.duck(_PATH)} AS path, {_ITEM} AS content, text FROM documents WHERE doc_id % 3 = 0 AND NOT regexp_matches(text, '(?m)^## ')) SELECT path, type, md5(content) AS hash FROM ({' UNION ALL '.join(rows)})"""


@query("adversarial_variations", "AUG-2 TOP-8 VER-1", _bodies_sql())
def adversarial_variations(spark, sf):
    # the SQL follows composed documents without headings of their own; other llms.txt files are in llms_file_variations
    return _varied(spark, sf, "doc_id % 3 = 0").where("content_type = 'llms_txt'").select("path", "type", "hash")


@query(
    "llms_file_variations",
    "AUG-2",
    f"""WITH d AS (SELECT {D.duck(_PATH)} AS path, text FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 = 0)
        SELECT path, 'baseline' AS type, md5(text) AS hash FROM d UNION ALL SELECT path, 'structural_variation', md5(replace(text, '## ', '### ')) FROM d""",
)
def llms_file_variations(spark, sf):
    return _varied(spark, sf, "doc_id % 3 <> 0").where("content_type = 'llms_txt'").select("path", "type", "hash")


_KIND = "CASE WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.py' THEN 'code' ELSE 'generic' END AS content_type"


@query(
    "generic_variations",
    "AUG-1 AUG-2",
    f"""WITH d AS (SELECT {D.duck(_PATH)} AS path, text FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0),
        l AS (SELECT path, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM d),
        h AS (SELECT *, CAST('0x' || substr(md5(path || '|' || i || '|4'), 1, 15) AS BIGINT) AS h FROM l)
        SELECT path, {_KIND}, 'baseline' AS type, md5(text) AS hash FROM d
        UNION ALL SELECT path, {_KIND}, 'size_variation', md5(text || repeat(chr(10), 100)) FROM d
        UNION ALL SELECT path, {_KIND}, 'character_variation', md5(text || chr(10) || array_to_string(list_transform(range(128, 256), lambda i: chr(i::int)), '')) FROM d
        UNION ALL SELECT path, {_KIND}, 'structure_variation', md5(string_agg(x, chr(10) ORDER BY h, i)) FROM h GROUP BY path HAVING count(*) > 1""",
)
def generic_variations(spark, sf):
    return _varied(spark, sf).where("content_type <> 'llms_txt'").select("path", "content_type", "type", "hash")


@query(
    "variation_suite",
    "AUG-3 AUG-2",
    f"""WITH d AS (SELECT {D.duck(_PATH)} AS path, doc_id, text, doc_id % 3 = 0 OR doc_id % 4 = 0 AS is_llms FROM documents WHERE NOT regexp_matches(text, '(?m)^## ')),
        r AS (SELECT path, unnest(CASE WHEN NOT is_llms THEN ['baseline', 'size_variation', 'character_variation']
                || CASE WHEN contains(text, chr(10)) THEN ['structure_variation'] ELSE [] END
              WHEN doc_id % 3 <> 0 THEN ['baseline', 'structural_variation']
              ELSE ['baseline', 'structural_variation', 'structural_variation', 'special_characters', 'special_characters']
                || list_transform(range(0, {len(R.INJECTION_TEXTS)}), lambda i: 'prompt_injection') || list_transform(range(0, {len(R.CODE_TEXTS)}), lambda i: 'malicious_code')
                || list_transform(range(0, {len(R.CREDENTIAL_TEXTS)}), lambda i: 'credential_exposure') END) AS type FROM d)
        SELECT type, count(*) AS n_cases, count(DISTINCT path) AS n_items FROM r GROUP BY type""",
)
def variation_suite(spark, sf):
    return AU.test_suite(_varied(spark, sf)).groupBy("type").agg(F.count("*").alias("n_cases"), F.countDistinct("source_item").alias("n_items"))
