"""Corpus, findings, join and report queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import rules as R
from ..operators import findings as FD
from ..operators import gates as G
from ..operators import parse as P
from ..operators import secrets as S
from ..operators.signatures import signature_rules
from ..session import materialize
from ..sinks import tables as T
from ..sources import corpus as SC
from . import derived as D
from .registry import query
from .secrets_queries import deduped_sql
from .sqlgen import case_map, scan_sql
from .structure_queries import blocks_sql, static_sql

_MD = D.MARKDOWN_SQL
# catalog tables derived from documents and labels
_URLS = "(SELECT doc_id AS id, concat('https://', source, '.example.com/p/', cast(doc_id as string)) AS url, concat(source, '.example.com') AS domain, source, CASE WHEN doc_id % 3 = 0 THEN 'High' ELSE 'Low' END AS quality FROM documents)"
_CONTENT = "(SELECT doc_id AS url_id, CASE WHEN doc_id % 11 = 5 THEN NULL ELSE text END AS text_content, CASE WHEN doc_id % 10 = 9 THEN 'error' ELSE 'success' END AS fetch_status FROM documents)"
_TOPICS = "(SELECT doc_id AS url_id, lang AS label, cast(quality as double) AS score FROM documents JOIN labels USING (doc_id))"


def urls(spark, sf):
    docs = D.table(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.expr("concat('https://', source, '.example.com/p/', cast(doc_id as string))").alias("url"),
        F.expr("concat(source, '.example.com')").alias("domain"),
        "source",
        F.expr("CASE WHEN doc_id % 3 = 0 THEN 'High' ELSE 'Low' END").alias("quality"),
    )


def content(spark, sf):
    return D.table(spark, sf, "documents").select(
        F.col("doc_id").alias("url_id"),
        F.expr("CASE WHEN doc_id % 11 = 5 THEN NULL ELSE text END").alias("text_content"),
        F.expr("CASE WHEN doc_id % 10 = 9 THEN 'error' ELSE 'success' END").alias("fetch_status"),
    )


def topics(spark, sf):
    docs, labels = D.table(spark, sf, "documents"), D.table(spark, sf, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("url_id"), F.col("lang").alias("label"), F.col("quality").cast("double").alias("score"))


@query("stored_corpus", "SRC-1", f"SELECT id AS url_id, url, md5(text_content) AS text_md5 FROM {_URLS} JOIN {_CONTENT} ON id = url_id WHERE fetch_status = 'success' AND text_content IS NOT NULL")
def stored_corpus(spark, sf):
    return SC.stored_corpus(urls(spark, sf), content(spark, sf)).select("url_id", "url", F.md5("text").alias("text_md5"))


@query("processed_urls", "SRC-2", f"SELECT DISTINCT id, url FROM {_URLS} JOIN labels ON id = doc_id")
def processed_urls(spark, sf):
    return SC.processed_urls(urls(spark, sf), D.table(spark, sf, "labels").select(F.col("doc_id").alias("url_id")))


@query(
    "content_items",
    "SRC-4 SRC-5",
    f"""SELECT CASE WHEN doc_id % 2 = 0 THEN 'db-item-' || doc_id ELSE 'content-' || substr(md5(url), 1, 8) END AS id, 'markdown' AS type, url AS source, md5(text) AS content_md5,
          '2024-01-01T00:00:00.000000Z' AS ts, CASE WHEN doc_id % 2 = 0 THEN 'db_all_known_urls' ELSE 'direct_url_query' END AS method, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS db_url_id FROM {_MD}""",
)
def content_items(spark, sf):
    docs = D.markdown(spark, sf).withColumn("text", SC.decode_bytes(F.encode("text", "UTF-8")))
    url_id = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))
    method = F.when(F.col("doc_id") % 2 == 0, F.lit("db_all_known_urls")).otherwise(F.lit("direct_url_query"))
    items = SC.content_items(docs, F.col("url"), F.col("text"), method, url_id, F.expr("timestamp'2024-01-01 00:00:00'"))
    return items.select("id", "type", "source", F.md5("content").alias("content_md5"), F.col("metadata.timestamp").alias("ts"), F.col("metadata.retrieval_method").alias("method"), F.col("metadata.db_url_id").alias("db_url_id"))


@query("batch_lookup", "SRC-6", f"SELECT u.url, md5(text_content) AS text_md5 FROM {_URLS} u LEFT JOIN (SELECT url, text_content FROM {_URLS} JOIN {_CONTENT} ON id = url_id WHERE fetch_status = 'success' AND text_content IS NOT NULL) c ON c.url = u.url")
def batch_lookup(spark, sf):
    stored = SC.stored_corpus(urls(spark, sf), content(spark, sf))
    return SC.lookup(urls(spark, sf).select("url"), stored).select("url", F.md5("text").alias("text_md5"))


@query("invalid_items", "SRC-7 FLT-10", "SELECT count_if(doc_id % 10 = 3) AS invalid, count_if(doc_id % 10 <> 3) AS valid FROM documents")
def invalid_items(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 10 = 3 THEN NULL ELSE source END").alias("source"))
    checked = SC.validate_items(docs)
    return checked.agg(F.count_if(F.col("processing_error").isNotNull()).alias("invalid"), F.count_if(F.col("processing_error").isNull()).alias("valid"))


@query(
    "filtered_corpus_and",
    "SRC-11 JOIN-4 FLT-12",
    f"SELECT id AS url_id, url FROM {_URLS} WHERE domain = 'src3.example.com' AND quality = 'High' AND id IN (SELECT url_id FROM {_TOPICS} WHERE label = 'en')",
)
def filtered_corpus_and(spark, sf):
    corpus = urls(spark, sf).withColumnRenamed("id", "url_id")
    return SC.filter_corpus(corpus, domain="src3.example.com", quality="high", topic="en", topics=topics(spark, sf)).select("url_id", "url")


@query(
    "filtered_corpus_or",
    "SRC-11",
    f"SELECT id AS url_id, url FROM {_URLS} WHERE source = 'src4' OR id IN (SELECT url_id FROM {_TOPICS} WHERE label = 'fr') OR id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def filtered_corpus_or(spark, sf):
    corpus = urls(spark, sf).withColumnRenamed("id", "url_id")
    purposes = D.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("url_id"), F.lit("training").alias("label"))
    out = SC.filter_corpus(corpus, source="src4", topic="fr", purpose="training", topics=topics(spark, sf), purposes=purposes, combine="or")
    return out.select("url_id", "url")


_SEEN_SQL = "(SELECT DISTINCT source AS url, sha256(text) AS content_hash FROM documents WHERE doc_id % 2 = 0)"


@query(
    "incremental_new_documents",
    "SRC-12 SNK-1 VER-1",
    f"SELECT DISTINCT source AS url, sha256(text) AS content_hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM {_SEEN_SQL} s WHERE s.url = d.source AND s.content_hash = sha256(d.text))",
)
def incremental_new_documents(spark, sf):
    docs = D.documents(spark, sf, "doc_id", "source", "text").select(F.col("source").alias("url"), "text", "doc_id")
    seen = docs.where("doc_id % 2 = 0").select("url", F.sha2("text", 256).alias("content_hash"))
    return T.rows_to_store(docs.drop("doc_id"), seen).select("url", "content_hash")


_META = "(SELECT doc_id AS url_id, 'lang' AS key, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents UNION ALL SELECT doc_id, 'quality', cast(quality as string) FROM labels)"


@query(
    "url_metadata",
    "SRC-13",
    f"SELECT url_id, max(CASE WHEN key = 'lang' THEN value END) AS lang, max(CASE WHEN key = 'quality' THEN value END) AS quality, string_agg(key || '=' || value, ';' ORDER BY key) AS metadata FROM {_META} GROUP BY url_id",
)
def url_metadata(spark, sf):
    docs, labels = D.table(spark, sf, "documents"), D.table(spark, sf, "labels")
    rows = docs.select(F.col("doc_id").alias("url_id"), F.inline(F.array(F.struct(F.lit("lang").alias("key"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("key"), F.col("source").alias("value")))))
    rows = rows.unionByName(labels.select(F.col("doc_id").alias("url_id"), F.lit("quality").alias("key"), F.col("quality").cast("string").alias("value")))
    mapped = SC.metadata_map(rows).select("url_id", F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("metadata"))
    return SC.metadata_columns(rows, ["lang", "quality"]).join(mapped, "url_id")


@query(
    "child_rows",
    "SNK-2",
    """WITH i AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\]\\(\\s*<?([^)\\s>]+)>?[^)\\n]*\\)', 1))) AS v FROM """
    + _MD
    + f""") SELECT 'url' AS kind, count(*) AS n, count(DISTINCT doc_id) AS documents FROM i UNION ALL SELECT 'code_block', count(*), count(DISTINCT doc_id) FROM {blocks_sql(_MD)}""",
)
def child_rows(spark, sf):
    docs = D.markdown(spark, sf).select("doc_id", "text")
    items = T.extracted_item_rows(P.parse(docs))
    blocks = P.code_blocks(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "language", "code"))).alias("code_blocks"))
    rows = T.code_block_rows(blocks.select("doc_id", F.transform("code_blocks", lambda b: F.struct(b["language"].alias("language"), b["code"].alias("code"))).alias("code_blocks")))
    both = items.select(F.col("item_type").alias("kind"), "doc_id").unionByName(rows.select(F.lit("code_block").alias("kind"), "doc_id"))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


@query(
    "latest_parsed_documents",
    "SNK-3 WIN-2",
    f"""WITH l AS (SELECT source AS url, max(doc_id) AS doc_id FROM documents GROUP BY source)
        SELECT l.url, l.doc_id, (SELECT string_agg(language || ':' || code, '|' ORDER BY block_no) FROM {blocks_sql(_MD)} b WHERE b.doc_id = l.doc_id) AS code_blocks,
          (SELECT array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\]\\(\\s*<?([^)\\s>]+)>?[^)\\n]*\\)', 1))), ' ') FROM {_MD} m WHERE m.doc_id = l.doc_id) AS urls FROM l""",
)
def latest_parsed_documents(spark, sf):
    docs = D.markdown(spark, sf)
    processed = docs.select(F.col("source").alias("url"), "doc_id", F.col("doc_id").alias("parsed_at"))
    out = T.latest_parsed(processed, P.code_blocks(docs), T.extracted_item_rows(P.parse(docs.select("doc_id", "text"))))
    blocks = F.array_join(F.transform("code_blocks", lambda b: F.concat(b["language"], F.lit(":"), b["code"])), "|")
    return out.select("url", "doc_id", blocks.alias("code_blocks"), F.array_join("urls", " ").alias("urls"))


@query("url_exists", "SNK-4", f"SELECT url, id IN (SELECT doc_id FROM labels) AS exists FROM {_URLS}")
def url_exists(spark, sf):
    known = SC.processed_urls(urls(spark, sf), D.table(spark, sf, "labels").select(F.col("doc_id").alias("url_id")))
    return T.exists(urls(spark, sf).select("url"), known)


# --- findings table ----------------------------------------------------------------------------
_RESULT = "timestamp '2024-03-01 00:00:00'"
_FIND_SQL = f"(SELECT *, doc_id % 40 AS analysis_id, CASE WHEN doc_id % 17 = 0 THEN 'not a date' ELSE strftime({_RESULT} + to_hours(cast(doc_id % 200 as int)), '%Y-%m-%dT%H:%M:%S') END AS timestamp FROM {deduped_sql(_MD)})"


def findings(spark, sf):
    base = S.secret_findings(D.markdown(spark, sf))
    stamp = F.date_format(F.expr(f"{_RESULT} + make_interval(0, 0, 0, 0, cast(doc_id % 200 as int))"), "yyyy-MM-dd'T'HH:mm:ss")
    return base.withColumn("analysis_id", F.col("doc_id") % 40).withColumn("timestamp", F.when(F.col("doc_id") % 17 == 0, F.lit("not a date")).otherwise(stamp))


def _all_findings_sql() -> str:
    threat = {r: s["meta"]["threat"] for r, s in R.SIGNATURES.items()}
    level = {r: s["meta"]["severity"].capitalize() for r, s in R.SIGNATURES.items()}
    signed = f"(SELECT DISTINCT doc_id, family FROM {scan_sql(_MD, 'doc_id', 'text', signature_rules())})"
    return f"""SELECT detector, finding_type, severity, count(*) AS n_findings, count(DISTINCT doc_id) AS n_documents FROM (
        SELECT doc_id, detector, finding_type, severity FROM {deduped_sql(_MD)}
        UNION ALL SELECT doc_id, 'markdown', 'markdown_' || family, severity FROM {scan_sql(_MD, 'doc_id', 'text', R.MARKDOWN_RULES)}
        UNION ALL SELECT doc_id, 'signature', 'pattern_' || {case_map('family', threat)}, {case_map('family', level)} FROM {signed}
        UNION ALL SELECT doc_id, 'static', 'static_code', severity FROM {static_sql(_MD)}) GROUP BY ALL"""


@query("all_findings_by_detector", "SET-1 SET-2 AGG-2", _all_findings_sql())
def all_findings_by_detector(spark, sf):
    found = FD.all_findings(D.markdown(spark, sf).select("doc_id", "text"))
    return found.groupBy("detector", "finding_type", "severity").agg(F.count("*").alias("n_findings"), F.countDistinct("doc_id").alias("n_documents"))


@query("findings_by_severity", "AGG-2", f"SELECT severity, count(*) AS n_findings FROM {_FIND_SQL} GROUP BY severity")
def findings_by_severity(spark, sf):
    return FD.by_severity(findings(spark, sf))


@query("findings_by_type_and_analysis", "AGG-3", f"SELECT finding_type, analysis_id, count(*) AS n_findings FROM {_FIND_SQL} GROUP BY GROUPING SETS ((finding_type), (analysis_id))")
def findings_by_type_and_analysis(spark, sf):
    return FD.by_type_and_analysis(findings(spark, sf))


@query("findings_per_day", "AGG-5", f"SELECT strftime(CAST(try_cast(timestamp AS timestamp) AS date), '%Y-%m-%d') AS day, count(*) AS n_findings FROM {_FIND_SQL} WHERE try_cast(timestamp AS timestamp) IS NOT NULL GROUP BY 1")
def findings_per_day(spark, sf):
    return FD.per_day(findings(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query(
    "executive_summary",
    "AGG-8",
    f"SELECT upper(severity) AS severity, count(*) AS n_findings, count(DISTINCT doc_id) AS n_items FROM {_FIND_SQL} GROUP BY ROLLUP (upper(severity))",
)
def executive_summary(spark, sf):
    return FD.executive_summary(findings(spark, sf))


@query(
    "filtered_findings",
    "FLT-4",
    f"SELECT doc_id, rule_id, timestamp FROM {_FIND_SQL} WHERE severity = 'Medium' AND finding_type = 'sensitive_data_exposure' AND CAST(try_cast(timestamp AS timestamp) AS date) BETWEEN date '2024-03-02' AND date '2024-03-05'",
)
def filtered_findings(spark, sf):
    out = FD.filter_findings(findings(spark, sf), "Medium", "sensitive_data_exposure", "2024-03-02", "2024-03-05T10:00:00")
    return out.select("doc_id", "rule_id", "timestamp")


@query("finding_lookup", "FLT-6", f"SELECT doc_id, rule_id, location FROM {_FIND_SQL} WHERE cast(doc_id as varchar) = '7'")
def finding_lookup(spark, sf):
    return FD.lookup(findings(spark, sf), 7, "doc_id").select("doc_id", "rule_id", "location")


@query(
    "alertable_findings",
    "FLT-7 STR-6",
    f"""SELECT doc_id, rule_id, 'Security Alert: [' || upper(sev) || '] ' || rule_id AS subject FROM (SELECT *, CASE WHEN doc_id % 19 = 0 THEN 'weird' ELSE severity END AS sev FROM {_FIND_SQL}) WHERE CASE upper(sev) WHEN 'LOW' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'HIGH' THEN 4 WHEN 'CRITICAL' THEN 5 ELSE 1 END >= 4""",
)
def alertable_findings(spark, sf):
    from ..operators import alerts as A

    found = findings(spark, sf).withColumn("severity", F.expr("CASE WHEN doc_id % 19 = 0 THEN 'weird' ELSE severity END"))
    chosen = found.where(G.above_threshold(F.col("severity"), "HIGH"))
    return A.finding_alerts(chosen.withColumn("title", F.col("rule_id")), finding_id="doc_id").select(F.col("finding_id").alias("doc_id"), F.col("title").alias("rule_id"), "subject")


@query(
    "findings_for_url",
    "JOIN-1 FLT-12",
    f"""SELECT 'https://' || source || '.example.com/p/' || d.doc_id AS url, finding_type, severity, description FROM {_FIND_SQL} f JOIN documents d USING (doc_id) WHERE source IN ('src3', 'src7')""",
)
def findings_for_url(spark, sf):
    results = D.table(spark, sf, "documents").select((F.col("doc_id") + 100).alias("id"), F.col("doc_id").alias("url_id"))
    found = S.secret_findings(D.markdown(spark, sf)).withColumn("analysis_id", F.col("doc_id") + 100)
    return FD.findings_for_urls(urls(spark, sf), results, found, F.col("source").isin("src3", "src7"))


_LINED = f"(SELECT doc_id, rule_id, CASE WHEN severity = 'Medium' THEN 'Critical' ELSE severity END AS severity, 6 + doc_id % 9 AS line FROM {deduped_sql(_MD)})"


@query(
    "vulnerable_code_blocks",
    "JOIN-2",
    f"""SELECT f.doc_id, rule_id, severity, line, language, line_start, line_end FROM {_LINED} f JOIN {blocks_sql(_MD)} c ON c.doc_id = f.doc_id AND f.line BETWEEN c.line_start AND c.line_end WHERE severity IN ('Critical', 'High')""",
)
def vulnerable_code_blocks(spark, sf):
    docs = D.markdown(spark, sf)
    found = S.secret_findings(docs).select("doc_id", "rule_id", F.expr("CASE WHEN severity = 'Medium' THEN 'Critical' ELSE severity END").alias("severity"), (6 + F.col("doc_id") % 9).alias("line"))
    return FD.findings_in_blocks(found, P.code_blocks(docs)).select("doc_id", "rule_id", "severity", "line", "language", "line_start", "line_end")


@query(
    "high_risk_urls",
    "JOIN-3",
    f"SELECT url, max(s) AS overall_risk_score FROM {_URLS} JOIN (SELECT doc_id, CASE severity WHEN 'High' THEN 0.8 WHEN 'Medium' THEN 0.5 ELSE 0.2 END AS s FROM {_FIND_SQL}) ON id = doc_id GROUP BY url HAVING max(s) > 0.75",
)
def high_risk_urls(spark, sf):
    from ..operators.scoring import severity_score

    scores = findings(spark, sf).groupBy("doc_id").agg(F.max(severity_score(F.col("severity"))).alias("overall_risk_score"))
    joined = urls(spark, sf).join(scores.where("overall_risk_score > 0.75"), F.col("id") == F.col("doc_id"))
    return joined.select("url", "overall_risk_score").orderBy(F.desc("overall_risk_score"), "url")


@query(
    "top_topics_by_domain",
    "JOIN-4",
    f"""SELECT domain, topic, score, k FROM (SELECT domain, topic, score, row_number() OVER (PARTITION BY domain ORDER BY score DESC, topic) AS k FROM
        (SELECT domain, label AS topic, round(avg(score), 6) AS score FROM {_URLS} JOIN {_TOPICS} ON id = url_id GROUP BY ALL)) WHERE k <= 2""",
)
def top_topics_by_domain(spark, sf):
    ranking = urls(spark, sf).join(topics(spark, sf), F.col("id") == F.col("url_id")).groupBy("domain", F.col("label").alias("topic")).agg(F.round(F.avg("score"), 6).alias("score"))
    # the optimizer keeps at most k rows per domain and task before the shuffle (group limit)
    best = Window.partitionBy("domain").orderBy(F.desc("score"), "topic")
    return ranking.withColumn("k", F.row_number().over(best)).where("k <= 2")


@query(
    "findings_with_content",
    "JOIN-5 ML-10",
    f"""SELECT doc_id, rule_id, length(text_content) AS content_chars, CASE WHEN (doc_id % 10) / 10.0 > 0.7 THEN 0 ELSE 1 END AS label FROM {_FIND_SQL} JOIN {_CONTENT} ON url_id = doc_id WHERE fetch_status = 'success'""",
)
def findings_with_content(spark, sf):
    from ..operators.false_positives import labels_from_likelihood

    ok = content(spark, sf).where("fetch_status = 'success'").select(F.col("url_id").alias("doc_id"), F.length("text_content").alias("content_chars"))
    joined = FD.with_content(findings(spark, sf), ok).withColumn("false_positive_likelihood", (F.col("doc_id") % 10) / 10.0)
    return labels_from_likelihood(joined).select("doc_id", "rule_id", "content_chars", "label")


@query(
    "report_rows",
    "SNK-11",
    f"""SELECT doc_id AS finding_id, '- [' || severity || '] ' || CASE WHEN doc_id % 2 = 0 THEN rule_id ELSE 'Untitled' END || ': ' || description AS summary, CASE WHEN doc_id % 3 = 0 THEN 'No evidence provided' ELSE evidence END AS evidence, 'Unknown' AS source,
        'Review and address the finding as appropriate.' AS remediation FROM {_FIND_SQL}""",
)
def report_rows(spark, sf):
    rows = findings(spark, sf).select(
        F.col("doc_id").alias("finding_id"), "severity", "description", F.expr("CASE WHEN doc_id % 2 = 0 THEN rule_id END").alias("title"),
        F.expr("CASE WHEN doc_id % 3 <> 0 THEN evidence END").alias("evidence"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("remediation"),
    )
    return FD.report_rows(rows)


@query(
    "updated_likelihoods",
    "SNK-6",
    f"SELECT doc_id, rule_id, location, CASE WHEN doc_id % 3 = 0 THEN 0.9 ELSE 0.1 END AS false_positive_likelihood FROM {_FIND_SQL}",
)
def updated_likelihoods(spark, sf):
    found = findings(spark, sf).withColumn("finding_id", FD.finding_id("doc_id", "rule_id", "location", "detector")).withColumn("false_positive_likelihood", F.lit(0.1))
    results = found.where("doc_id % 3 = 0").select("finding_id", F.lit(0.9).alias("false_positive_likelihood"))
    return T.update_likelihoods(found, results).select("doc_id", "rule_id", "location", "false_positive_likelihood")


_RES_SQL = f"(SELECT event_id AS id, user_id AS url_id, ts AS analysis_timestamp, ts AS started_at, ts + to_milliseconds(cast(floor(value * 10) as bigint)) AS finished_at FROM events)"


def results(spark, sf):
    ev = D.events(spark, sf)
    return ev.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("url_id"), F.col("ts").alias("analysis_timestamp"), F.col("ts").alias("started_at"),
        F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 10) * 1000).alias("finished_at"),
    )


@query(
    "usage_counts",
    "AGG-1 STR-2",
    f"SELECT count(*) AS total_analyses, count_if(analysis_timestamp > timestamp '2024-01-30 00:00:00' - interval 1 day) AS analyses_last_24h, count(DISTINCT url_id) AS unique_files_analyzed FROM {_RES_SQL}",
)
def usage_counts(spark, sf):
    return FD.usage_counts(results(spark, sf), F.expr("timestamp'2024-01-30 00:00:00'"))


@query(
    "analysis_durations",
    "AGG-4",
    f"SELECT round(avg(epoch_us(finished_at) - epoch_us(started_at)) / 86.4e9, 9) AS avg_analysis_duration, round(max(epoch_us(finished_at) - epoch_us(started_at)) / 86.4e9, 9) AS max_analysis_duration FROM {_RES_SQL}",
)
def analysis_durations(spark, sf):
    out = FD.duration_stats(results(spark, sf))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("domain_quality", "JOIN-4", f"SELECT DISTINCT domain, quality FROM {_URLS} WHERE quality = 'High'")
def domain_quality(spark, sf):
    known = urls(spark, sf)
    domains = known.select("domain").distinct()
    return domains.join(known.where("quality = 'High'").select("domain", "quality"), "domain").distinct()


@query("urls_of_topic", "JOIN-4", f"SELECT url, label AS topic, score FROM {_URLS} JOIN {_TOPICS} ON id = url_id WHERE label = (SELECT min(lang) FROM documents)")
def urls_of_topic(spark, sf):
    ranked = topics(spark, sf)
    first = D.table(spark, sf, "documents").agg(F.min("lang").alias("label"))
    joined = urls(spark, sf).join(ranked.join(F.broadcast(first), "label"), F.col("id") == F.col("url_id"))
    return joined.select("url", F.col("label").alias("topic"), "score").orderBy(F.desc("score"), "url")


@query(
    "processed_content_items",
    "JOIN-9",
    f"""SELECT doc_id AS processed_id, url, sha256(text) AS raw_content_hash, length(text) AS n_chars FROM documents JOIN {_URLS} ON id = doc_id WHERE doc_id % 7 <> 3 ORDER BY doc_id LIMIT 1000""",
)
def processed_content_items(spark, sf):
    docs = D.table(spark, sf, "documents")
    processed = docs.select(F.col("doc_id").alias("processed_id"), F.col("doc_id").alias("url_id"), F.sha2("text", 256).alias("raw_content_hash"), F.length("text").alias("n_chars"))
    known = urls(spark, sf).where("id % 7 <> 3")  # a content of an unknown URL is left out
    return FD.processed_content(processed, known).select("processed_id", "url", "raw_content_hash", "n_chars")


@query(
    "usage_from_stored_hours",
    "AGG-1",
    f"""WITH r AS (SELECT *, analysis_timestamp >= timestamp '2024-01-29 00:00:00' AS recent FROM {_RES_SQL})
        SELECT count(*) AS total_analyses, count_if(recent) AS analyses_last_24h, true AS urls_within_bound, true AS recent_urls_within_bound FROM r""",
)
def usage_from_stored_hours(spark, sf):
    every = results(spark, sf)
    now = F.expr("timestamp'2024-01-30 00:00:00'")
    told = FD.usage_from_hours(materialize(FD.hourly_usage(every), "usage-hours"), now)
    recent = F.when(F.col("analysis_timestamp") >= now - F.expr("INTERVAL 1 DAY"), F.col("url_id"))
    exact = every.agg(F.count_distinct("url_id").alias("_all"), F.count_distinct(recent).alias("_recent"))
    # one row each
    both = told.join(F.broadcast(exact))
    near = lambda estimate, truth: F.abs(F.col(estimate) - F.col(truth)) <= 0.05 * F.col(truth)
    return both.select("total_analyses", "analyses_last_24h", near("unique_files_analyzed", "_all").alias("urls_within_bound"), near("unique_files_last_24h", "_recent").alias("recent_urls_within_bound"))
