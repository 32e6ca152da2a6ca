"""Version, change and risk-trend queries."""

from pyspark.sql import functions as F

from ..operators import scoring as SCO
from ..operators import secrets as S
from ..operators import trends as TR
from ..operators import versions as V
from .. import rules as R
from ..session import materialize
from . import derived as D
from .registry import query
from .secrets_queries import deduped_sql

_TS = "timestamp '2024-01-01 00:00:00' + to_days(cast(doc_id as int))"
_OBS = f"(SELECT source AS url, doc_id, {_TS} AS ts, sha256(text) AS content_hash FROM documents)"
_VER = f"""(SELECT url, content_hash, ts, doc_id, row_number() OVER (PARTITION BY url ORDER BY ts, doc_id) AS version_number FROM
   (SELECT url, content_hash, min(ts) AS ts, min(doc_id) AS doc_id FROM {_OBS} GROUP BY ALL))"""


def observations(spark, sf):
    docs = D.documents(spark, sf, "doc_id", "source", "text")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 86400)
    return docs.select(F.col("source").alias("url"), "doc_id", ts.alias("ts"), V.content_hash(F.col("text")).alias("content_hash"))


def version_rows(spark, sf):
    return V.number_versions(observations(spark, sf))


# consecutive documents of a source are unrelated texts, so a common head with small edits goes in front
_EDIT = """concat('# Title', chr(10), '```py', repeat('v', cast(floor(doc_id / 20) as int) % 7), chr(10), 'eval(x)', cast(cast(floor(doc_id / 20) as int) % 3 as string), chr(10), '```', chr(10),
CASE cast(floor(doc_id / 20) as int) % 4 WHEN 0 THEN 'See https://a.example.com' WHEN 1 THEN '## Added heading' WHEN 2 THEN 'fetch(url); setTimeout(f)' ELSE 'nothing' END, chr(10), text)"""


def edited_documents(spark, sf):
    return D.documents(spark, sf, "doc_id", "text").select("doc_id", F.expr(_EDIT).alias("text"))


def _ranges_sql(pairs: str) -> str:
    """Changed line ranges of (url, version_number, new_doc_id, old_doc_id) rows: shared ends, occurrences, then a longest increasing run level by level."""
    split = "string_split(regexp_replace({}.text, '\\n$', ''), chr(10))"
    same = lambda a, b: f"coalesce(nullif(list_position(list_transform(list_zip({a}, {b}), lambda z: coalesce(z[1] = z[2], false)), false), 0) - 1, len({a}))"
    pair = "url, version_number"
    on = "a.url = b.url AND a.version_number = b.version_number"
    return f"""(WITH RECURSIVE pr AS (SELECT * FROM {pairs}), tx AS (SELECT doc_id, {D.duck(_EDIT)} AS text FROM documents),
      sp AS (SELECT {pair}, {split.format("o")} AS lo, {split.format("n")} AS ln, o.text <> n.text AS differs FROM pr JOIN tx o ON o.doc_id = old_doc_id JOIN tx n ON n.doc_id = new_doc_id),
      hd AS (SELECT *, {same("lo", "ln")} AS h FROM sp),
      tl AS (SELECT *, {same("list_reverse(lo[h + 1:])", "list_reverse(ln[h + 1:])")} AS t FROM hd),
      li AS (SELECT {pair}, true AS is_new, unnest(ln[h + 1:len(ln) - t]) AS line, unnest(range(h, len(ln) - t)) AS no FROM tl
        UNION ALL SELECT {pair}, false, unnest(lo[h + 1:len(lo) - t]), unnest(range(h, len(lo) - t)) FROM tl),
      nu AS (SELECT *, row_number() OVER (PARTITION BY {pair}, is_new, line ORDER BY no) AS occ FROM li),
      ma AS (SELECT a.url, a.version_number, a.no AS i, b.no AS p FROM nu a JOIN nu b ON {on} AND a.line = b.line AND a.occ = b.occ AND a.is_new AND NOT b.is_new),
      lv AS (SELECT *, 1 AS k FROM ma UNION ALL SELECT {pair}, i, p, k + 1 FROM (
        SELECT *, min(p) OVER (PARTITION BY {pair} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM lv) WHERE p > low),
      le AS (SELECT {pair}, i, p, max(k) AS k FROM lv GROUP BY ALL),
      pd AS (SELECT a.*, b.i AS before FROM le a ASOF LEFT JOIN le b ON {on} AND a.k - 1 = b.k AND a.i > b.i),
      ke AS (SELECT {pair}, i, p, before FROM (SELECT *, row_number() OVER (PARTITION BY {pair} ORDER BY k DESC, i DESC) AS r FROM pd) WHERE r = 1
        UNION ALL SELECT b.url, b.version_number, b.i, b.p, b.before FROM ke a JOIN pd b ON {on} AND a.before = b.i),
      mk AS (SELECT {pair}, i, p FROM ke UNION ALL SELECT {pair}, h - 1, h - 1 FROM tl UNION ALL SELECT {pair}, len(ln) - t, len(lo) - t FROM tl),
      ga AS (SELECT {pair}, p + 1 AS old_start, lead(p) OVER w AS old_end, i + 1 AS new_start, lead(i) OVER w AS new_end FROM mk WINDOW w AS (PARTITION BY {pair} ORDER BY i)),
      al AS (SELECT * FROM ga WHERE old_end > old_start OR new_end > new_start UNION ALL SELECT {pair}, 0, len(lo), 0, len(ln) FROM tl WHERE differs AND lo = ln)
      SELECT {pair}, old_start, old_end, new_start, new_end, CASE WHEN old_end > old_start THEN array_to_string(lo[old_start + 1:old_end], chr(10)) END AS content_before,
        CASE WHEN new_end > new_start THEN array_to_string(ln[new_start + 1:new_end], chr(10)) END AS content_after, row_number() OVER (PARTITION BY {pair} ORDER BY new_start, old_start) - 1 AS change_seq
      FROM al JOIN tl USING ({pair}))"""


_PAIRS = f"(SELECT v.url, v.version_number, v.ts, v.doc_id AS new_doc_id, p.doc_id AS old_doc_id FROM {_VER} v JOIN {_VER} p ON p.url = v.url AND p.version_number = v.version_number - 1)"
_TOKENS = lambda c: f"list_distinct(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"
_NEAR = f"5 * len(list_intersect({_TOKENS('content_before')}, {_TOKENS('content_after')})) > 4 * len(list_distinct(list_concat({_TOKENS('content_before')}, {_TOKENS('content_after')})))"
_ADDED = "coalesce(array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(content_after, '(?i){p}') THEN '{p}' END" for p in R.SUSPICIOUS_ADDITIONS) + "], lambda x: x IS NOT NULL), ' '), '')"
_CHANGES = f"""(SELECT *, CASE WHEN content_before IS NULL THEN 'addition' WHEN content_after IS NULL THEN 'deletion' ELSE 'modification' END AS change_type,
    CASE WHEN contains(x, '```') THEN 'code_block' WHEN contains(x, 'http://') OR contains(x, 'https://') THEN 'url' WHEN regexp_matches(x, '^\\s*#') THEN 'heading' ELSE 'text' END AS section_type,
    CASE WHEN content_before IS NULL THEN length(content_after) WHEN content_after IS NULL THEN length(content_before) ELSE abs(length(content_after) - length(content_before)) END AS change_size,
    round(least((CASE WHEN content_after IS NULL AND length(content_before) > 500 THEN 0.4 ELSE 0.0 END)
      + (CASE WHEN {' OR '.join("contains(content_after, '" + t.replace("'", "''") + "')" for t in R.SUSPICIOUS_TOKENS)} THEN 0.3 ELSE 0.0 END)
      + (CASE WHEN content_before IS NOT NULL AND content_after IS NOT NULL AND {_NEAR} THEN 0.2 ELSE 0.0 END), 1.0), 6) AS suspicion_score
    FROM (SELECT *, coalesce(content_after, content_before) AS x FROM {_ranges_sql(_PAIRS)}))"""


def change_rows(spark, sf):
    return V.line_changes(V.with_texts(V.consecutive_pairs(version_rows(spark, sf)), edited_documents(spark, sf)))


@query("version_numbers", "WIN-1 VER-1", f"SELECT o.url, o.doc_id, version_number, o.doc_id = v.doc_id AS is_new_version FROM {_OBS} o JOIN {_VER} v ON v.url = o.url AND v.content_hash = o.content_hash")
def version_numbers(spark, sf):
    obs = observations(spark, sf)
    return V.track(obs, V.number_versions(obs)).select("url", "doc_id", "version_number", "is_new_version")


@query("latest_versions", "JOIN-13 WIN-2", f"SELECT url, version_number, content_hash, doc_id FROM {_VER} QUALIFY row_number() OVER (PARTITION BY url ORDER BY version_number DESC) = 1")
def latest_versions(spark, sf):
    return V.latest_versions(version_rows(spark, sf)).select("url", "version_number", "content_hash", "doc_id")


@query("days_between_versions", "WIN-3 JOIN-14", f"SELECT url, version_number, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86.4e9, 6) AS days FROM {_VER} WINDOW w AS (PARTITION BY url ORDER BY version_number) QUALIFY lag(ts) OVER w IS NOT NULL")
def days_between_versions(spark, sf):
    return V.days_between(version_rows(spark, sf)).withColumn("days", F.round("days", 6))


@query(
    "change_frequency",
    "AGG-24 WIN-3",
    f"""WITH g AS (SELECT url, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY url ORDER BY version_number))) / 86.4e9 AS d FROM {_VER}),
       s AS (SELECT url, count(*) AS n, min(ts) AS a, max(ts) AS b FROM {_VER} GROUP BY url)
       SELECT s.url, n AS versions_count, strftime(a, '%Y-%m-%d') AS first_version_date, strftime(b, '%Y-%m-%d') AS latest_version_date, round(avg(d), 6) AS avg_days_between_changes,
         round(list_sort(list(d) FILTER (d IS NOT NULL))[(n - 1) // 2 + 1], 6) AS median_days_between_changes, round(min(d), 6) AS min_days_between_changes, round(max(d), 6) AS max_days_between_changes,
         round((n - 1) / ((epoch_us(b) - epoch_us(a)) / 86.4e9 / 30), 6) AS changes_per_month FROM s JOIN g USING (url) GROUP BY s.url, n, a, b""",
)
def change_frequency(spark, sf):
    out = V.change_frequency(version_rows(spark, sf))
    for c in out.columns:
        if c.endswith("_date"):
            out = out.withColumn(c, F.date_format(c, "yyyy-MM-dd"))
        elif c not in ("url", "versions_count"):
            out = out.withColumn(c, F.round(c, 6))
    return out


@query(
    "line_changes",
    "VER-2 VER-3 VER-4 VER-5 JOIN-14",
    f"SELECT url, version_number, change_seq, change_type, section_type, old_start, old_end, new_start, new_end, change_size, suspicion_score FROM {_CHANGES}",
)
def line_changes(spark, sf):
    return change_rows(spark, sf).select("url", "version_number", "change_seq", "change_type", "section_type", "old_start", "old_end", "new_start", "new_end", "change_size", "suspicion_score")


@query(
    "suspicious_changes",
    "FLT-9 TOP-1 VER-6 JOIN-7",
    f"""SELECT c.url, c.version_number, change_type, section_type, suspicion_score, {_ADDED} AS detected_patterns, content_hash FROM {_CHANGES} c JOIN {_VER} v ON v.url = c.url AND v.version_number = c.version_number
        WHERE suspicion_score >= 0.3 AND v.ts >= timestamp '2024-01-31 00:00:00' AND c.url IN ('src1', 'src2', 'src3')""",
)
def suspicious_changes(spark, sf):
    since = F.timestamp_seconds(F.lit(1704067200 + 30 * 86400))
    recent = V.suspicious_changes(change_rows(spark, sf), since)
    out = V.changes_with_version(recent, version_rows(spark, sf), F.col("url").isin("src1", "src2", "src3"))
    return out.select("url", "version_number", "change_type", "section_type", "suspicion_score", F.array_join("detected_patterns", " ").alias("detected_patterns"), "content_hash")


@query(
    "added_text_patterns",
    "VER-6",
    "SELECT doc_id, array_to_string(list_filter(["
    + ", ".join("CASE WHEN regexp_matches(t, '(?i)" + p + "') THEN '" + p + "' END" for p in R.SUSPICIOUS_ADDITIONS)
    + f"], lambda x: x IS NOT NULL), ' ') AS patterns FROM (SELECT doc_id, {D.duck(_EDIT)} || ' localStorage.x innerHTML = 1 String.fromCharCode' AS t FROM documents)",
)
def added_text_patterns(spark, sf):
    docs = edited_documents(spark, sf).withColumn("text", F.concat("text", F.lit(" localStorage.x innerHTML = 1 String.fromCharCode")))
    return docs.select("doc_id", F.array_join(V.suspicious_patterns(F.col("text")), " ").alias("patterns"))


@query(
    "gradual_modifications",
    "AGG-25 SET-3",
    f"""WITH g AS (SELECT url, section_type, old_start, old_end, count(*) AS n, sum(change_size) AS total, count_if(change_size > 100) AS large, arg_min(change_size, (version_number, change_seq)) AS first_size,
            arg_min(version_number, (version_number, change_seq)) AS v1, arg_max(version_number, (version_number, change_seq)) AS v2 FROM {_CHANGES} GROUP BY url, section_type, old_start, old_end)
        SELECT url, 'gradual_' || (CASE section_type WHEN 'code_block' THEN 'code' ELSE section_type END) || '_modification' AS type, old_start || ':' || old_end AS location, v1 AS start_version, v2 AS end_version, n AS change_count,
          CAST(total - first_size AS BIGINT) AS total_change_size FROM g
        WHERE n >= 2 AND large - (CASE WHEN first_size > 100 THEN 1 ELSE 0 END) = 0 AND total - first_size > 0 AND url IN (SELECT url FROM {_VER} GROUP BY url HAVING max(version_number) >= 3)""",
)
def gradual_modifications(spark, sf):
    ver = version_rows(spark, sf)
    changes = V.line_changes(V.with_texts(V.consecutive_pairs(ver), edited_documents(spark, sf)))
    return V.gradual_modifications(changes, ver, section=None).select("url", "type", "location", "start_version", "end_version", "change_count", "total_change_size")


@query(
    "version_history",
    "WIN-7",
    f"SELECT v.url, v.version_number, count(change_seq) AS n_changes, max(suspicion_score) AS max_suspicion FROM {_VER} v LEFT JOIN {_CHANGES} c ON c.url = v.url AND c.version_number = v.version_number GROUP BY v.url, v.version_number",
)
def version_history(spark, sf):
    out = V.version_history(version_rows(spark, sf), change_rows(spark, sf))
    return out.select("url", "version_number", F.coalesce(F.size("changes"), F.lit(0)).alias("n_changes"), F.array_max(F.transform("changes", lambda c: c["suspicion_score"])).alias("max_suspicion"))


@query(
    "analysis_history",
    "VER-8",
    f"""SELECT p.url, p.version_number, n IS NOT NULL AS changes_detected, CASE WHEN n IS NOT NULL THEN 'Content changes detected' ELSE 'No changes detected' END AS change_summary
        FROM {_PAIRS} p LEFT JOIN (SELECT url, version_number, count(*) AS n FROM {_CHANGES} GROUP BY ALL) c ON c.url = p.url AND c.version_number = p.version_number""",
)
def analysis_history(spark, sf):
    pairs = V.consecutive_pairs(version_rows(spark, sf))
    return V.analysis_history(pairs, V.line_changes(V.with_texts(pairs, edited_documents(spark, sf)))).drop("timestamp")


_HUNK = "chr(10) || '@@ -' || (old_start + CASE WHEN old_end > old_start THEN 1 ELSE 0 END) || ',' || (old_end - old_start) || ' +' || (new_start + CASE WHEN new_end > new_start THEN 1 ELSE 0 END) || ',' || (new_end - new_start) || ' @@' || coalesce(chr(10) || '-' || replace(content_before, chr(10), chr(10) || '-'), '') || coalesce(chr(10) || '+' || replace(content_after, chr(10), chr(10) || '+'), '')"
_ONE_THREE = f"(SELECT a.url, 3 AS version_number, b.doc_id AS new_doc_id, a.doc_id AS old_doc_id FROM {_VER} a JOIN {_VER} b ON a.url = b.url AND a.version_number = 1 AND b.version_number = 3)"


@query(
    "version_comparison",
    "VER-7 JOIN-15",
    f"""SELECT p.url, 1 AS version1, 3 AS version2, coalesce('--- Version 1' || chr(10) || '+++ Version 3' || h, '') AS unified_diff FROM {_ONE_THREE} p
        LEFT JOIN (SELECT url, string_agg({_HUNK}, '' ORDER BY change_seq) AS h FROM {_ranges_sql(_ONE_THREE)} GROUP BY url) d ON d.url = p.url""",
)
def version_comparison(spark, sf):
    return V.compare_versions(version_rows(spark, sf), edited_documents(spark, sf), 1, 3).select("url", "version1", "version2", "unified_diff")


@query(
    "changes_between_versions",
    "JOIN-15",
    f"SELECT url, version_number, change_seq, change_type, section_type, suspicion_score FROM {_CHANGES} WHERE version_number BETWEEN 2 AND 4",
)
def changes_between_versions(spark, sf):
    return V.changes_between(change_rows(spark, sf), 1, 4).select("url", "version_number", "change_seq", "change_type", "section_type", "suspicion_score")


@query(
    "component_risks",
    "AGG-14 VER-9 JOIN-13",
    f"""WITH f AS (SELECT source AS url, CASE severity WHEN 'High' THEN 0.8 WHEN 'Medium' THEN 0.5 ELSE 0.2 END AS s,
          CASE rule_no % 5 WHEN 0 THEN 'markdown_secret' WHEN 1 THEN 'pattern_static' WHEN 2 THEN 'secret_leak' WHEN 3 THEN 'Static_Code' ELSE 'other' END AS t FROM {deduped_sql(D.MARKDOWN_SQL)} JOIN documents USING (doc_id)),
        g AS (SELECT url, coalesce(max(s) FILTER (t = 'markdown_secret'), 0.0) AS markdown_risk, coalesce(max(s) FILTER (t = 'pattern_static'), 0.0) AS pattern_risk, coalesce(max(s) FILTER (t = 'secret_leak'), 0.0) AS secrets_risk,
              coalesce(max(s) FILTER (t = 'Static_Code'), 0.0) AS static_risk, max(s) AS overall_risk_score FROM f GROUP BY url)
        SELECT g.*, (SELECT max(version_number) FROM {_VER} v WHERE v.url = g.url) AS version_number FROM g""",
)
def component_risks(spark, sf):
    found = S.secret_findings(D.markdown(spark, sf), keep=("doc_id", "source"))
    kind = F.expr("CASE rule_no % 5 WHEN 0 THEN 'markdown_secret' WHEN 1 THEN 'pattern_static' WHEN 2 THEN 'secret_leak' WHEN 3 THEN 'Static_Code' ELSE 'other' END")
    risks = V.component_risks(found.withColumn("finding_type", kind).withColumnRenamed("source", "url"), "url", SCO.severity_score(F.col("severity")))
    return V.track_risk(V.latest_versions(version_rows(spark, sf)), risks)


# --- risk history ------------------------------------------------------------------------------
_HIST = """(SELECT concat('u', cast(user_id as string)) AS url, ts, event_id, least(value / 500, 1.0) AS overall_risk_score, least(value / 250, 1.0) AS markdown_risk,
   cast(event_id % 10 as double) / 10 AS pattern_risk, CASE WHEN event_id % 3 = 0 THEN NULL ELSE least(value / 400, 1.0) END AS secrets_risk, 0.5 AS static_risk FROM events)"""
_LONG = f"""(SELECT url, ts, event_id, 'overall' AS component, overall_risk_score AS value FROM {_HIST} UNION ALL SELECT url, ts, event_id, 'markdown', markdown_risk FROM {_HIST}
   UNION ALL SELECT url, ts, event_id, 'pattern', pattern_risk FROM {_HIST} UNION ALL SELECT url, ts, event_id, 'secrets', coalesce(secrets_risk, 0.0) FROM {_HIST} UNION ALL SELECT url, ts, event_id, 'static', 0.5 FROM {_HIST})"""


def risk_history(spark, sf):
    ev = D.events(spark, sf)
    return ev.select(
        F.expr("concat('u', cast(user_id as string))").alias("url"), "ts", "event_id", F.expr("least(value / 500, 1.0D)").alias("overall_risk_score"), F.expr("least(value / 250, 1.0D)").alias("markdown_risk"),
        F.expr("cast(event_id % 10 as double) / 10").alias("pattern_risk"), F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE least(value / 400, 1.0D) END").alias("secrets_risk"), F.lit(0.5).alias("static_risk"),
    )


@query(
    "risk_score_series",
    "WIN-6 JOIN-8",
    f"""SELECT url, event_id, row_number() OVER (PARTITION BY url ORDER BY ts, event_id) AS position, overall_risk_score, coalesce(secrets_risk, 0.0) AS secrets_risk, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 5 END AS version_number,
        (SELECT any_value('h' || n) FROM range(1, 4) t(n) WHERE n = event_id % 5) AS content_hash FROM {_HIST} h""",
)
def risk_score_series(spark, sf):
    hist = TR.numbered_series(risk_history(spark, sf)).withColumn("version_number", F.nullif(F.col("event_id") % 5, F.lit(0)))
    known = hist.select("url").distinct().select("url", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("version_number"))
    known = known.withColumn("content_hash", F.concat(F.lit("h"), F.col("version_number").cast("string")))
    out = TR.history_with_versions(hist, known)
    return out.select("url", "event_id", "position", "overall_risk_score", F.coalesce("secrets_risk", F.lit(0.0)).alias("secrets_risk"), "version_number", "content_hash")


@query(
    "risk_trends",
    "WIN-5 SET-3",
    f"""WITH x AS (SELECT *, epoch_us(ts) / 86.4e9 AS d FROM {_LONG}),
        g AS (SELECT url, component, count(*) AS data_points, max(d) - min(d) AS span, coalesce(regr_slope(value, d), 0) AS slope, regr_intercept(value, d) AS ic, CASE WHEN var_pop(value) = 0 THEN 0 ELSE regr_r2(value, d) END AS r2,
              arg_max(value, (ts, event_id)) AS cur, max(d) AS d1 FROM x GROUP BY ALL HAVING count(*) >= 2)
        SELECT url, component, data_points, round(span, 6) AS time_span_days, CASE WHEN abs(slope) < 0.001 THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
          CASE WHEN abs(slope) < 0.001 THEN 'none' WHEN abs(slope) < 0.01 THEN 'weak' WHEN abs(slope) < 0.05 THEN 'moderate' ELSE 'strong' END AS strength, round(slope, 6) AS slope, round(r2, 6) AS r_squared,
          round(cur, 6) AS current_value, round(least(greatest(ic + slope * (d1 + 30), 0.0), 1.0), 5) AS prediction_30_days FROM g""",
)
def risk_trends(spark, sf):
    out = TR.trends(TR.long_series(risk_history(spark, sf)))
    for c in ("time_span_days", "slope", "r_squared", "current_value"):
        out = out.withColumn(c, F.round(c, 6))
    return out.withColumn("prediction_30_days", F.round("prediction_30_days", 5))


@query(
    "risk_anomalies",
    "WIN-4 SET-3",
    f"""WITH s AS (SELECT url, ts, event_id, CASE component WHEN 'overall' THEN 'overall_risk' ELSE component || '_risk' END AS score_type, value FROM {_LONG}),
        w AS (SELECT *, avg(value) OVER f AS e, stddev_pop(value) OVER f AS sd, max(value) OVER f > min(value) OVER f AS spread, row_number() OVER (PARTITION BY url, score_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY url, score_type) AS n FROM s
              WINDOW f AS (PARTITION BY url, score_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
        SELECT url, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, score_type, round(value, 6) AS value, round(e, 6) AS expected_value, round(value - e, 6) AS deviation, CASE WHEN abs(value - e) > 3 * sd THEN 'high' ELSE 'medium' END AS severity
        FROM w WHERE i > 3 AND n >= 5 AND spread AND abs(value - e) > 2 * sd""",
)
def risk_anomalies(spark, sf):
    out = TR.score_anomalies(risk_history(spark, sf), block_rows=64)
    return out.select(
        "url", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "score_type", F.round("value", 6).alias("value"), F.round("expected_value", 6).alias("expected_value"), F.round("deviation", 6).alias("deviation"), "severity"
    )


@query(
    "temporal_results",
    "VER-10 AGG-6",
    f"""WITH s AS (SELECT c.url, count(*) AS n FROM {_CHANGES} c JOIN {_VER} v ON v.url = c.url AND v.version_number = c.version_number
          WHERE suspicion_score >= 0.3 AND v.ts >= (SELECT max(ts) FROM {_VER}) - interval 30 day GROUP BY c.url),
        k AS (SELECT url, old_start, old_end, count(*) AS n, sum(change_size) AS total, count_if(change_size > 100) AS large, arg_min(change_size, (version_number, change_seq)) AS first_size
          FROM {_CHANGES} WHERE section_type = 'code_block' GROUP BY url, old_start, old_end),
        g AS (SELECT url, count(*) AS n FROM k WHERE n >= 2 AND large - (CASE WHEN first_size > 100 THEN 1 ELSE 0 END) = 0 AND total - first_size > 0
          AND url IN (SELECT url FROM {_VER} GROUP BY url HAVING max(version_number) >= 3) GROUP BY url),
        t AS (SELECT url, coalesce(regr_slope((version_number % 10) / 10.0, epoch_us(ts) / 86.4e9), 0) AS slope FROM {_VER} GROUP BY url HAVING count(*) >= 2),
        l AS (SELECT url, max(version_number) AS version_number FROM {_VER} GROUP BY url)
        SELECT l.url, version_number, version_number > 1 AND coalesce(s.n, 0) + coalesce(g.n, 0) > 0 AS changes_detected, coalesce(s.n, 0) AS n_suspicious, coalesce(g.n, 0) AS n_gradual,
          CASE WHEN abs(slope) < 0.001 THEN 'stable' WHEN slope > 0 THEN 'increasing' WHEN slope <= 0 THEN 'decreasing' END AS direction,
          CASE WHEN abs(slope) < 0.001 THEN 'none' WHEN abs(slope) < 0.01 THEN 'weak' WHEN abs(slope) < 0.05 THEN 'moderate' WHEN slope IS NOT NULL THEN 'strong' END AS strength
        FROM l LEFT JOIN s ON s.url = l.url LEFT JOIN g ON g.url = l.url LEFT JOIN t ON t.url = l.url""",
)
def temporal_results(spark, sf):
    ver = materialize(version_rows(spark, sf), "versions")
    changes = materialize(V.line_changes(V.with_texts(V.consecutive_pairs(ver), edited_documents(spark, sf))), "changes")
    latest = V.latest_versions(ver)
    history = ver.select("url", "ts", F.col("doc_id").alias("event_id"), (F.col("version_number") % 10 / 10).alias("overall_risk_score"), *[F.lit(0.0).alias(f"{c}_risk") for c in TR.COMPONENTS])
    overall = TR.trends(TR.long_series(history)).where("component = 'overall'").select("url", "direction", "strength")
    # the last thirty days, counted from the latest version
    since = F.lit(ver.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 30 DAYS")
    out = V.temporal_results(latest, V.suspicious_changes(changes, since), V.gradual_modifications(changes, ver), overall)
    return out.select("url", "version_number", "changes_detected", "n_suspicious", "n_gradual", "direction", "strength")


@query(
    "temporal_rollup",
    "AGG-7",
    f"""WITH s AS (SELECT c.url, c.version_number, change_seq, suspicion_score FROM {_CHANGES} c WHERE suspicion_score >= 0.3),
        k AS (SELECT url, old_start, old_end, count(*) AS n, sum(change_size) AS total, count_if(change_size > 100) AS large, arg_min(change_size, (version_number, change_seq)) AS first_size FROM {_CHANGES}
          WHERE section_type = 'code_block' GROUP BY url, old_start, old_end),
        g AS (SELECT url FROM k WHERE n >= 2 AND large - (CASE WHEN first_size > 100 THEN 1 ELSE 0 END) = 0 AND total - first_size > 0 AND url IN (SELECT url FROM {_VER} GROUP BY url HAVING max(version_number) >= 3))
        SELECT 'summary' AS kind, (SELECT count(*) FROM s) + (SELECT count(*) FROM g) > 0 AS has_changes, 0 AS n_items, 0 AS n_urls
        UNION ALL SELECT 'suspicious_changes', true, count(*), count(DISTINCT url) FROM s HAVING count(*) > 0 UNION ALL SELECT 'gradual_modifications', true, count(*), count(DISTINCT url) FROM g HAVING count(*) > 0""",
)
def temporal_rollup(spark, sf):
    ver = materialize(version_rows(spark, sf), "versions")
    changes = materialize(V.line_changes(V.with_texts(V.consecutive_pairs(ver), edited_documents(spark, sf))), "changes")
    suspicious, gradual = V.suspicious_changes(changes), V.gradual_modifications(changes, ver)
    trend = ver.select("url").distinct().select("url", F.lit("stable").alias("direction"))
    rolled = V.temporal_rollup(V.temporal_results(V.latest_versions(ver), suspicious, gradual, trend), suspicious, gradual, urls_per_group=8)
    item = F.explode_outer("items")
    flat = rolled.select("kind", "has_changes", item.alias("item"))
    return flat.groupBy("kind", "has_changes").agg(F.count("item").alias("n_items"), F.count_distinct(F.get_json_object("item", "$.url")).alias("n_urls"))
