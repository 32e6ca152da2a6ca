"""Secrets and personal-data queries."""

from pyspark.sql import functions as F

from .. import rules as R
from ..operators import secrets as S
from . import derived as D
from .registry import query
from .sqlgen import case_map, contains_any, scan_sql

_COMMENTED = "regexp_matches(substr(text, greatest(start - 99, 1), least(start, 100)), '#|//')"
_ACCEPT = (
    "CASE WHEN rule_name = 'Base64-Encoded Token' THEN length(match) >= 20 AND length(match) % 4 = 0 AND try(from_base64(match)) IS NOT NULL "
    f"WHEN rule_name IN ('Email Address', 'JWT Secret') THEN NOT {_COMMENTED} ELSE true END"
)
_ENTROPY = "least(8.0, len(list_distinct(string_split(match, ''))) / length(match) * 8)"


def accepted_sql(src: str) -> str:
    return f"(SELECT * FROM {scan_sql(src, 'doc_id', 'text', R.SECRET_RULES)} WHERE {_ACCEPT})"


def _severity_sql() -> str:
    whens = ["WHEN family = 'pattern_library' THEN 'Medium'"]
    for name, levels in R.SECRET_SEVERITY_KEYWORDS.items():
        for level, words in levels:
            whens.append(f"WHEN family = '{name}' AND {contains_any('lower(rule_name)', words)} THEN '{level}'")
    return "CASE " + " ".join(whens) + " ELSE 'Low' END"


_GROUPS = (
    "CASE WHEN rule_name = 'Hostname' THEN ' Captured groups: (' || chr(39) || regexp_extract(match, '[^.]*$') || chr(39) || ',).' "
    "WHEN rule_name = 'Database Connection String' THEN ' Captured groups: (' || chr(39) || regexp_extract(match, '^[^:]*') || chr(39) || ',).' ELSE '' END"
)


def normalized_sql(src: str) -> str:
    return f"""(SELECT doc_id, finding_type, severity,
      CASE WHEN substr(match, 1, 30) <> '' AND NOT contains(d, substr(match, 1, 30))
           THEN d || ' Evidence snippet: ' || substr(match, 1, 30) || '...' ELSE d END AS description,
      location, match AS evidence, detector, rule_id, start, "end", rule_no, match_no
    FROM (SELECT *, {case_map('family', R.SECRET_FINDING_TYPES)} AS finding_type, {_severity_sql()} AS severity2,
      {case_map('family', R.SECRET_DESCRIPTIONS)} || rule_name || '.' ||
        CASE WHEN family = 'trufflehog' THEN ' Entropy: ' || printf('%.2f', {_ENTROPY}) || '.' ELSE '' END || {_GROUPS} AS d,
      'offset:' || start || '-' || "end" AS location, family AS detector, rule_name AS rule_id
      FROM {accepted_sql(src)}) x)""".replace("finding_type, severity,", "finding_type, severity2 AS severity,", 1)


def deduped_sql(src: str) -> str:
    return f"""(SELECT * FROM {normalized_sql(src)}
      QUALIFY row_number() OVER (PARTITION BY doc_id, finding_type, location, substr(evidence, 1, 64), detector
                                 ORDER BY rule_no, match_no) = 1)"""


@query(
    "pii_findings_by_type",
    "SEC-5 SEC-6 AGG-2 RX-0",
    f"""SELECT rule_id, severity, count(*) AS n_findings, count(DISTINCT doc_id) AS n_documents
        FROM {deduped_sql('documents')} WHERE detector = 'sensitive_detector' GROUP BY ALL""",
)
def pii_findings_by_type(spark, sf):
    docs = D.documents(spark, sf, "doc_id", "text")
    found = S.secret_findings(docs, rules=R.SENSITIVE_RULES)
    return found.groupBy("rule_id", "severity").agg(
        F.count("*").alias("n_findings"), F.countDistinct("doc_id").alias("n_documents")
    )


@query(
    "secret_findings",
    "SEC-1 SEC-3 SEC-4 SEC-7 SEC-8 SEC-9 AGG-28 SET-1",
    f"""SELECT doc_id, finding_type, severity, description, location, evidence, detector, rule_id FROM {deduped_sql(D.MARKDOWN_SQL)}""",
)
def secret_findings(spark, sf):
    return S.secret_findings(D.markdown(spark, sf)).select(
        "doc_id", "finding_type", "severity", "description", "location", "evidence", "detector", "rule_id"
    )


@query(
    "credential_entropy",
    "SEC-1 SEC-2 RX-0",
    f"""SELECT doc_id, rule_name AS type, match, start, "end", round({_ENTROPY}, 6) AS entropy
        FROM {scan_sql(D.MARKDOWN_SQL, 'doc_id', 'text', R.CREDENTIAL_RULES)}""",
)
def credential_entropy(spark, sf):
    found = S.raw_matches(D.markdown(spark, sf), rules=R.CREDENTIAL_RULES)
    return found.select(
        "doc_id", F.col("name").alias("type"), "match", F.col("start").cast("long"), F.col("end").cast("long"),
        F.round(S.entropy_proxy(F.col("match")), 6).alias("entropy"),
    )


@query(
    "pattern_expectations",
    "AGG-30",
    f"""WITH found AS (SELECT doc_id, string_agg(DISTINCT rule_name, '|' ORDER BY rule_name) AS found
                       FROM {accepted_sql(D.MARKDOWN_SQL)} WHERE family = 'pattern_library' GROUP BY doc_id)
        SELECT d.doc_id, coalesce(found, '') AS found, CASE WHEN d.doc_id % 13 = 7 THEN 'OpenAI API Key' ELSE '' END AS expected,
               coalesce(found, '') = CASE WHEN d.doc_id % 13 = 7 THEN 'OpenAI API Key' ELSE '' END AS success
        FROM documents d LEFT JOIN found USING (doc_id)""",
)
def pattern_expectations(spark, sf):
    samples = D.documents(spark, sf, "doc_id").withColumn(
        "expected", F.expr("CASE WHEN doc_id % 13 = 7 THEN array('OpenAI API Key') ELSE cast(array() AS array<string>) END")
    )
    found = S.raw_matches(D.markdown(spark, sf), rules=R.LLM_CREDENTIAL_RULES)
    tested = S.test_patterns(samples, found)
    return tested.select(
        "doc_id", F.array_join("found", "|").alias("found"), F.array_join("expected", "|").alias("expected"), "success"
    )
