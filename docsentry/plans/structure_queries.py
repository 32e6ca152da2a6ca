"""Parsing, gating, code-rule and signature queries."""

from pyspark.sql import functions as F

from .. import rules as R
from ..functions.patterns import re2, sql_str
from ..functions.scale import balanced
from ..operators import code as C
from ..operators import gates as G
from ..operators import parse as P
from ..operators import signatures as S
from . import derived as D
from .registry import query
from .sqlgen import START_LIST, case_map, contains_any, find_all_sql, scan_sql

_MD = D.MARKDOWN_SQL
_FENCE = sql_str(P.FENCE.replace("(?dms)", "(?ms)"))
_NL = "chr(10)"


def newlines_sql(x: str) -> str:
    return f"(length({x}) - length(replace({x}, {_NL}, '')))"


def blocks_sql(src: str) -> str:
    """doc_id, block_no, language, code, line_start, line_end, context_before, context_after."""
    return f"""(WITH b AS (SELECT doc_id, text, unnest(range(0, len(m))) AS block_no, unnest({START_LIST}) AS start, unnest(l) AS info, unnest(c) AS code FROM (
        SELECT doc_id, text, regexp_extract_all(text, {_FENCE}, 0) AS m, regexp_split_to_array(text, {_FENCE}) AS s,
               regexp_extract_all(text, {_FENCE}, 1) AS l, regexp_extract_all(text, {_FENCE}, 2) AS c FROM {src})),
      k AS (SELECT *, {newlines_sql('substr(text, 1, start)')} + 1 AS line_start FROM b),
      e AS (SELECT *, line_start + {newlines_sql('code')} + 1 AS line_end, string_split(text, {_NL}) AS ls FROM k)
      SELECT doc_id, block_no, CASE WHEN trim(info) = '' THEN 'text' ELSE trim(info) END AS language, code, line_start, line_end,
        array_to_string(ls[greatest(line_start - 3, 1):line_start - 1], {_NL}) AS context_before,
        array_to_string(ls[line_end + 2:line_end + 4], {_NL}) AS context_after FROM e)"""


_TWO_BLOCKS = "concat(text, chr(10), '```python', chr(10), 'eval(a(b))', chr(10), 'y = eval(c)', chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('```', chr(10), 'tail') ELSE 'open' END)"
_BLOCK_MD = f"(SELECT doc_id, {_TWO_BLOCKS} AS text FROM {_MD})"


def _block_docs(spark, sf):
    return D.markdown(spark, sf).select("doc_id", F.expr(_TWO_BLOCKS).alias("text"))


@query("code_blocks", "DOC-1 WIN-10 WIN-11 RX-0", f"SELECT * FROM {blocks_sql(_BLOCK_MD)}")
def code_blocks(spark, sf):
    return P.code_blocks(_block_docs(spark, sf))


@query(
    "fence_state",
    "WIN-10",
    f"""SELECT doc_id, count(*) AS lines, count_if(is_fence) AS fence_lines, count_if(in_code) AS code_lines, coalesce(min(CASE WHEN in_code THEN line_no END), 0) AS first_code_line
        FROM (SELECT doc_id, i AS line_no, starts_with(x, '```') AS is_fence,
              NOT starts_with(x, '```') AND sum(CASE WHEN starts_with(x, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS in_code
              FROM (SELECT doc_id, unnest(string_split(text, {_NL})) AS x, generate_subscripts(string_split(text, {_NL}), 1) AS i FROM {_BLOCK_MD})) GROUP BY doc_id""",
)
def fence_state(spark, sf):
    states = _block_docs(spark, sf).select("doc_id", P.fence_state(F.col("text")).alias("s"))
    first = F.coalesce(F.array_min(F.transform(F.filter("s", lambda x: x["in_code"]), lambda x: x["line_no"])), F.lit(0))
    return states.select(
        "doc_id",
        F.size("s").alias("lines"),
        F.size(F.filter("s", lambda x: x["is_fence"])).alias("fence_lines"),
        F.size(F.filter("s", lambda x: x["in_code"])).alias("code_lines"),
        first.alias("first_code_line"),
    )


_REFS_EXPR = "concat(text, ' a[^1] b[^n2], c[^1]', chr(10), '[^1]: note ![img](http://', source, '/i.png \"t\") [x](<y z>)')"


@query(
    "document_links",
    "DOC-2",
    f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, {sql_str(P.LINK.replace('(?d)', ''))}, 1))), ' ') AS urls,
          array_to_string(list_sort(list_distinct(list_transform(list_filter(list_zip(regexp_extract_all(t, {sql_str(P.FOOTNOTE)}, 1), regexp_extract_all(t, {sql_str(P.FOOTNOTE)}, 2)), lambda z: z[2] = ''), lambda z: z[1]))), ' ') AS footnotes
        FROM (SELECT doc_id, {_REFS_EXPR} AS t FROM {_MD})""",
)
def document_links(spark, sf):
    docs = D.markdown(spark, sf).select("doc_id", F.expr(_REFS_EXPR).alias("t"))
    return docs.select("doc_id", F.array_join(P.link_targets(F.col("t")), " ").alias("urls"), F.array_join(P.footnote_refs(F.col("t")), " ").alias("footnotes"))


_H, _LI = sql_str(P.HEADING.replace("(?d)", "")), sql_str(P.LIST_ITEM.replace("(?d)", ""))


@query(
    "document_structure",
    "DOC-3",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(t, {_NL})) AS x, generate_subscripts(string_split(t, {_NL}), 1) AS i FROM (SELECT doc_id, regexp_replace(text, {_FENCE}, '', 'g') AS t FROM {_MD})),
        p AS (SELECT *, coalesce(lag(regexp_matches(x, {_LI})) OVER (PARTITION BY doc_id ORDER BY i), false) AS prev FROM l),
        u AS (SELECT doc_id, i, 0 AS k, 'heading' AS type, length(regexp_extract(x, {_H}, 1)) AS level, regexp_extract(x, {_H}, 2) AS text FROM p WHERE regexp_matches(x, {_H})
              UNION ALL SELECT doc_id, i, 1, 'list', NULL, '' FROM p WHERE regexp_matches(x, {_LI}) AND NOT prev
              UNION ALL SELECT doc_id, i, 2, 'list_item', NULL, regexp_extract(x, {_LI}, 1) FROM p WHERE regexp_matches(x, {_LI}))
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS position, type, level, text FROM u""",
)
def document_structure(spark, sf):
    docs = D.markdown(spark, sf)
    return docs.select("doc_id", F.posexplode(P.structure(F.col("text"))).alias("position", "e")).select("doc_id", "position", "e.type", "e.level", "e.text")


@query(
    "content_nodes",
    "DOC-4",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, {_NL})) AS x, generate_subscripts(string_split(text, {_NL}), 1) AS i FROM {_MD}),
        f AS (SELECT *, starts_with(x, '```') AS fence, NOT starts_with(x, '```') AND sum(CASE WHEN starts_with(x, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS code FROM l),
        k AS (SELECT *, CASE WHEN fence THEN 'fence' WHEN code THEN 'block_code' WHEN regexp_matches(x, {_H}) THEN 'heading' WHEN regexp_matches(x, {sql_str(P.RULE_LINE)}) THEN 'thematic_break'
              WHEN regexp_matches(x, {_LI}) THEN 'list_item' WHEN regexp_matches(x, {sql_str(P.QUOTE.replace('(?d)', ''))}) THEN 'block_quote' ELSE 'paragraph' END AS type FROM f WHERE code OR regexp_matches(x, '[^\\s\\x{{0B}}]'))
        SELECT doc_id, i AS line_no, type, CASE type WHEN 'heading' THEN length(regexp_extract(x, '^#+')) WHEN 'list_item' THEN length(regexp_extract(x, '^[ \\t]*')) // 2 + 1 ELSE 1 END AS depth,
          CASE type WHEN 'heading' THEN regexp_extract(x, {_H}, 2) WHEN 'list_item' THEN regexp_extract(x, {_LI}, 1) WHEN 'block_quote' THEN regexp_extract(x, {sql_str(P.QUOTE.replace('(?d)', ''))}, 1) ELSE x END AS text FROM k""",
)
def content_nodes(spark, sf):
    return P.content_nodes(D.markdown(spark, sf))


_LLMS = "concat('# Site ', cast(doc_id as string), chr(10), '> About ', source, chr(10), chr(10), '## Docs', chr(10), '- [Guide](https://', source, '/g): start here', chr(10), '- [API](https://', source, '/a)', chr(10), text, chr(10), '## Optional', chr(10), '* [Old](https://', source, '/o):', chr(10))"


@query(
    "llms_layout",
    "DOC-5 WIN-9",
    f"""WITH d AS (SELECT doc_id, {D.duck(_LLMS)} AS t FROM documents),
        s AS (SELECT doc_id, t, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS section_no FROM (SELECT doc_id, t, regexp_split_to_array(t, '(?m)^## ')[2:] AS ps FROM d)),
        f AS (SELECT *, unnest(regexp_extract_all(p, '(?m)^[-*][ \\t]+\\[([^\\]\\n]+)\\]\\(([^)\\n]+)\\)(:?[^\\n]*)$', 0)) AS m,
              generate_subscripts(regexp_extract_all(p, '(?m)^[-*][ \\t]+\\[([^\\]\\n]+)\\]\\(([^)\\n]+)\\)(:?[^\\n]*)$', 0), 1) - 1 AS file_no FROM s)
        SELECT doc_id, regexp_extract(t, '(?m)^# (.*)$', 1) AS title, regexp_extract(t, '(?m)^> ?(.*)$', 1) AS summary, trim(string_split(p, {_NL})[1]) AS section, section_no, file_no,
          regexp_extract(m, '\\[([^\\]]+)\\]', 1) AS name, regexp_extract(m, '\\]\\(([^)]+)\\)', 1) AS url, trim(regexp_replace(regexp_extract(m, '\\)(:?[^\\n]*)$', 1), '^:', '')) AS notes,
          lower(trim(string_split(p, {_NL})[1])) = 'optional' AS optional FROM f""",
)
def llms_layout(spark, sf):
    docs = D.documents(spark, sf, "doc_id", "source", "text").select("doc_id", F.expr(_LLMS).alias("text"))
    return P.llms_layout(docs)


@query(
    "document_sections",
    "WIN-9",
    f"""SELECT doc_id, section_no, trim(string_split(p, {_NL})[1]) AS name, length(regexp_replace(regexp_replace(array_to_string(string_split(p, {_NL})[2:], {_NL}), '^\\s+', ''), '\\s+$', '')) AS body_chars
        FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS section_no FROM (SELECT doc_id, regexp_split_to_array({D.duck(_LLMS)}, '(?m)^## ')[2:] AS ps FROM documents))""",
)
def document_sections(spark, sf):
    docs = D.documents(spark, sf, "doc_id", "source", "text").select("doc_id", F.posexplode(P.sections(F.expr(_LLMS))).alias("section_no", "s"))
    return docs.select("doc_id", "section_no", "s.name", F.length("s.body").alias("body_chars"))


@query(
    "code_language_histogram",
    "AGG-26 FLT-1",
    f"""SELECT CASE WHEN c IN ({', '.join(sql_str(x) for x in R.SUPPORTED_LANGUAGES)}) THEN c ELSE 'generic' END AS language, count(*) AS blocks, count(DISTINCT doc_id) AS documents
        FROM (SELECT doc_id, coalesce({case_map('lower(language)', R.LANGUAGE_ALIASES)}, lower(language)) AS c FROM {blocks_sql(_BLOCK_MD)}) GROUP BY ALL""",
)
def code_language_histogram(spark, sf):
    blocks = P.code_blocks(_block_docs(spark, sf))
    language = G.canonical_language(F.col("language"))
    return blocks.groupBy(language.alias("language")).agg(F.count("*").alias("blocks"), F.countDistinct("doc_id").alias("documents"))


def _count_sql(text: str, literal: str) -> str:
    return f"((length({text}) - length(replace({text}, {sql_str(literal)}, ''))) // {len(literal)})"


_COMPLEX_SQL = "(length(text) > 100000 OR " + newlines_sql("text") + " > 1000 OR " + " OR ".join(f"{_count_sql('text', m)} > 10" for m in R.COMPLEX_MARKERS) + ")"
_MARKED = "concat(text, repeat(CASE doc_id % 5 WHEN 0 THEN '[[a]] ' WHEN 1 THEN '{{ x }} ' WHEN 2 THEN concat('```', chr(10)) ELSE 'def f(): ' END, CAST(doc_id % 14 AS int)))"


@query(
    "document_gates",
    "FLT-2 FLT-3 FLT-11",
    f"""SELECT doc_id, CASE WHEN length(text) > 20000 THEN 'content_size_limit_exceeded' WHEN {newlines_sql('text')} + 1 > 60 THEN 'content_line_limit_exceeded' END AS broken_limit, {_COMPLEX_SQL} AS is_complex,
        round(least(60.0 + least(length(text) / 10240, 60.0) + least(({newlines_sql('text')} + 1) / 100, 30.0) + {' + '.join(f"least({_count_sql('text', m)}, 10)" for m in R.COST_MARKERS)} + CASE WHEN doc_id % 3 = 0 THEN 30 ELSE 0 END, 300.0), 6) AS cost
        FROM (SELECT doc_id, {_MARKED} AS text FROM documents)""",
)
def document_gates(spark, sf):
    docs = D.documents(spark, sf, "doc_id", "text").select("doc_id", F.expr(_MARKED).alias("text"))
    t = F.col("text")
    language = F.when(F.col("doc_id") % 3 == 0, F.lit("markdown")).otherwise(F.lit("python"))
    return docs.select("doc_id", G.limit_rule(t, 20000, 60).alias("broken_limit"), G.is_complex(t).alias("is_complex"), F.round(G.document_cost(t, language), 6).alias("cost"))


def _code_sql(src_md: str = _BLOCK_MD) -> str:
    parts = []
    for r in R.CODE_RULES:
        consts = f"{sql_str(r.name)} AS rule_id, {sql_str(r.message)} AS message, {sql_str(r.category)} AS category, {sql_str(r.priority)} AS priority, {sql_str(R.CODE_RULE_CWE[r.name])} AS cwe"
        src = f"(SELECT * FROM {blocks_sql(src_md)} WHERE coalesce({case_map('lower(language)', R.LANGUAGE_ALIASES)}, lower(language)) = '{r.languages[0]}')"
        parts.append(find_all_sql(src, "doc_id, block_no, line_start", "code", r.pattern.replace(r"(?<![\w.])", r"\b").replace("*+", "*"), "", consts))
    pre, post = "substr(code, 1, start)", 'substr(code, 1, "end")'
    col = lambda x: f"length(string_split({x}, {_NL})[-1]) + 1"
    return f"""SELECT doc_id, block_no, rule_id, 'item-' || doc_id AS path, {newlines_sql(pre)} + line_start AS start_line, {col(pre)} AS start_col, {newlines_sql(post)} + line_start AS end_line, {col(post)} AS end_col,
        message, category, priority, CASE lower(priority) WHEN 'high' THEN 'High' ELSE 'Medium' END AS severity, cwe, match AS evidence FROM ({' UNION ALL '.join(parts)})"""


@query("code_findings", "STA-1 STA-2 STA-4 STA-5 JOIN-19 AGG-29 SRC-8 FLT-1", _code_sql())
def code_findings(spark, sf):
    docs = _block_docs(spark, sf)
    stored = P.code_blocks(docs.where("doc_id % 2 = 0"))
    blocks = C.stored_or_parsed_blocks(docs, stored)
    return C.dedup(C.block_findings(blocks, C.rule_table(spark)))


_MARKED_MD = f"(SELECT doc_id, {_MARKED} AS text FROM {_MD})"


def _fallback_sql(src_md: str = _MARKED_MD) -> str:
    src = f"(SELECT doc_id, text FROM {src_md})"
    pre, post = "substr(text, 1, start)", 'substr(text, 1, "end")'
    col = lambda x: f"length(string_split({x}, {_NL})[-1]) + 1"
    sev = "CASE WHEN lower(priority) IN ('high', 'critical') THEN 'High' WHEN lower(priority) = 'low' THEN 'Low' ELSE 'Medium' END"
    return f"""SELECT doc_id, rule_name AS rule_id, {newlines_sql(pre)} + 1 AS start_line, {col(pre)} AS start_col, {newlines_sql(post)} + 1 AS end_line, {col(post)} AS end_col, message, category, priority, {sev} AS severity,
          CASE WHEN length(match) > 100 THEN substr(match, 1, 100) || '...' ELSE match END AS evidence FROM {scan_sql(src, 'doc_id', 'text', R.FALLBACK_RULES)}
        UNION ALL SELECT doc_id, 'alternative_analysis_used', 1, 1, 1, 1, 'Complex generic content analyzed with alternative method instead of semgrep', 'Info', 'Low', 'Low', NULL FROM {src} WHERE {_COMPLEX_SQL}"""


@query("fallback_content_scan", "STA-3 STA-4 FLT-3 RX-0", _fallback_sql())
def fallback_content_scan(spark, sf):
    docs = D.markdown(spark, sf).select("doc_id", F.expr(_MARKED).alias("text"))
    return C.content_findings(docs).drop("path")


def static_sql(src_md: str) -> str:
    """doc_id, rule_id, severity of the deduplicated code-rule family."""
    limits = f"SELECT doc_id, CASE WHEN length(text) > {R.MAX_CONTENT_CHARS} THEN 'content_size_limit_exceeded' ELSE 'content_line_limit_exceeded' END AS rule_id, 1 AS start_line, 1 AS start_col, 1 AS end_line, 1 AS end_col, 'Medium' AS severity FROM {src_md} WHERE length(text) > {R.MAX_CONTENT_CHARS} OR {newlines_sql('text')} + 1 > {R.MAX_CONTENT_LINES}"
    cols = "doc_id, rule_id, start_line, start_col, end_line, end_col, severity"
    return f"(SELECT DISTINCT {cols} FROM (SELECT {cols} FROM ({_code_sql(src_md)}) UNION ALL SELECT {cols} FROM ({_fallback_sql(src_md)}) UNION ALL {limits}))"


@query(
    "static_findings_by_rule",
    "STA-1 STA-3 STA-4 AGG-29 FLT-2 FLT-3",
    f"SELECT rule_id, severity, count(*) AS n_findings FROM {static_sql(_MARKED_MD)} GROUP BY ALL",
)
def static_findings_by_rule(spark, sf):
    docs = D.markdown(spark, sf).select("doc_id", F.expr(_MARKED).alias("text"))
    return C.static_findings(docs).groupBy("rule_id", "severity").agg(F.count("*").alias("n_findings"))


@query(
    "rules_for_blocks",
    "SRC-8 SRC-9",
    f"""WITH r AS (SELECT * FROM (VALUES {', '.join(f"({sql_str(r.name)}, {sql_str(r.languages[0])}, {sql_str(r.priority)}, {sql_str(R.CODE_RULE_CWE[r.name])})" for r in R.CODE_RULES)}) v(rule_id, language, priority, cwe))
        SELECT rule_id, priority, cwe, count(block_no) AS candidate_blocks FROM r LEFT JOIN (SELECT block_no, coalesce({case_map('lower(language)', R.LANGUAGE_ALIASES)}, lower(language)) AS l FROM {blocks_sql(_BLOCK_MD)}) b ON b.l = r.language GROUP BY ALL""",
)
def rules_for_blocks(spark, sf):
    rules = C.rule_table(spark)
    wanted = C.rules_for_language(rules, "Python").unionByName(C.rules_for_language(rules, "javascript"))
    counts = P.code_blocks(_block_docs(spark, sf)).groupBy(G.canonical_language(F.col("language")).alias("language")).agg(F.count("*").alias("n"))
    joined = wanted.withColumn("language", F.explode("languages")).join(counts, "language", "left")
    return joined.select(F.col("id").alias("rule_id"), "priority", "cwe", F.coalesce("n", F.lit(0)).alias("candidate_blocks"))


@query(
    "analysis_errors",
    "STA-6 SRC-7 FLT-10",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'static_analysis_error' ELSE 'static_analysis_unexpected_error' END AS rule_id,
         CASE WHEN doc_id % 3 = 0 THEN 'Static analysis error: Invalid source' ELSE 'Unexpected error: Invalid source' END AS message,
         CASE WHEN doc_id % 3 = 0 THEN 'Medium' ELSE 'High' END AS priority FROM documents WHERE doc_id % 10 = 3""",
)
def analysis_errors(spark, sf):
    from ..sources import corpus as SC

    docs = D.documents(spark, sf, "doc_id", "source").withColumn("source", F.expr("CASE WHEN doc_id % 10 = 3 THEN '' ELSE source END"))
    checked = SC.validate_items(docs)
    known = C.error_findings(checked.where("doc_id % 3 = 0"))
    other = C.error_findings(checked.where("doc_id % 3 <> 0"), expected=False)
    return known.unionByName(other).select("doc_id", "rule_id", "message", "priority")


def _signature_sql() -> str:
    rules = S.signature_rules()
    src = scan_sql(_MD, "doc_id", "text", rules)
    before = "octet_length(encode(substr(text, 1, start)))"
    meta = {r: spec["meta"] for r, spec in R.SIGNATURES.items()}
    threat = case_map("family", {r: m["threat"] for r, m in meta.items()})
    return f"""SELECT doc_id, family AS rule_name, {threat} AS threat, {case_map(threat, R.THREAT_BUCKETS)} AS bucket, {case_map('family', {r: m['severity'] for r, m in meta.items()})} AS severity,
        string_agg(rule_name || '@' || {before} || ':' || match, '|' ORDER BY {before}) AS strings FROM {src} GROUP BY doc_id, family"""


@query("signature_findings", "SIG-1 SIG-3 SIG-4 SIG-5 JOIN-18", _signature_sql())
def signature_findings(spark, sf):
    found = S.signature_findings(S.signature_matches(D.markdown(spark, sf)))
    strings = F.array_join(F.transform("strings", lambda s: F.concat(s["identifier"], F.lit("@"), s["offset"].cast("string"), F.lit(":"), s["data"])), "|")
    return found.select("doc_id", "rule_name", "threat", "bucket", F.col("meta")["severity"].alias("severity"), strings.alias("strings"))


@query(
    "context_gated_signatures",
    "FLT-8 SIG-4",
    f"""SELECT doc_id, count_if(family = 'LLM_Prompt_Injection') AS manipulation_attempts, 0 AS jailbreak_attempts, count_if(family = 'llm_sensitive_data_extraction') AS data_extraction_hints,
          count_if(family = 'LLM_Evasion_Technique') AS evasion_techniques, 0 AS other_flagged_patterns
        FROM (SELECT DISTINCT doc_id, family FROM {scan_sql(_MD, 'doc_id', 'text', S.signature_rules())} WHERE {contains_any('lower(text)', ['rules', 'confidential', 'filter now'])}) GROUP BY doc_id""",
)
def context_gated_signatures(spark, sf):
    docs = D.markdown(spark, sf).where(G.mentions_any(F.col("text"), ["Rules", "confidential", "filter now"]))
    return S.bucket_counts(S.signature_findings(S.signature_matches(docs)))


# a header, a wildcard byte and an any-of rule, run over whole texts as bytes
_BINARY_RULES = [
    {"name": "all_of_markers", "header": "23 20", "strings": {"$a": "44 6F 63 20 3?", "$b": "53 65 ?? 74 69 6F 6E"}, "condition": "all"},
    {"name": "any_call", "header": "", "strings": {"$a": "65 76 61 6C 28", "$b": "2E 77 72 69 74 65 ?? 61"}, "condition": "any"},
]


@query(
    "binary_signatures",
    "SIG-2",
    f"""WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM {_MD})
        SELECT doc_id, 'all_of_markers' AS rule_name FROM b WHERE starts_with(h, '2320') AND regexp_matches(h, '^([0-9A-F]{{2}})*446F63203[0-9A-F]') AND regexp_matches(h, '^([0-9A-F]{{2}})*5365[0-9A-F]{{2}}74696F6E')
        UNION ALL SELECT doc_id, 'any_call' FROM b WHERE regexp_matches(h, '^([0-9A-F]{{2}})*6576616C28') OR regexp_matches(h, '^([0-9A-F]{{2}})*2E7772697465[0-9A-F]{{2}}61')""",
)
def binary_signatures(spark, sf):
    docs = D.markdown(spark, sf).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return S.binary_signature_hits(docs, "content", _BINARY_RULES, ["doc_id"])


@query("documents_by_cost", "FLT-11", "SELECT count(*) AS n_docs, CAST(sum(strlen(text) + 1000) AS BIGINT) AS total_cost, 8 AS n_shares, true AS no_share_twice_the_median FROM documents")
def documents_by_cost(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    cost = F.octet_length("text") + 1000  # bytes to scan, and what any document costs
    spread = balanced(docs, cost, [F.col("doc_id")], 8)
    shares = spread.groupBy(F.spark_partition_id().alias("share")).agg(F.count("*").alias("n"), F.sum(cost).alias("cost"))
    return shares.agg(F.sum("n").alias("n_docs"), F.sum("cost").alias("total_cost"), F.count("*").alias("n_shares"), (F.max("cost") < 2 * F.median("cost")).alias("no_share_twice_the_median"))


# a rule per benchmark item: two parts and a word of its text, half and whole bytes left open, or one piece that occurs twice
_OPEN = "concat(substring(h, {0}, 9), '?', substring(h, {0} + 10, 4), '??', substring(h, {0} + 16, 8))"


def item_rules(spark, sf):
    """Rule rows made of the benchmark texts."""
    part = lambda start: F.expr(_OPEN.format(start))
    items = D.table(spark, sf, "benchmark").select("item_id", F.hex(F.encode("text", "UTF-8")).alias("h"))
    capitals = F.transform(F.sequence(F.lit(65), F.lit(90)), lambda c: F.hex(c))
    string = lambda name, pattern: F.struct(F.lit(name).alias("identifier"), pattern.alias("pattern"))
    group = lambda ids, least, times: F.struct(F.array(*map(F.lit, ids)).alias("identifiers"), F.lit(least).alias("least"), F.lit(times).alias("times"))
    return items.select(
        F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("rule"),
        F.when(F.col("item_id") % 3 == 0, capitals).otherwise(F.array().cast("array<string>")).alias("headers"),
        F.array(string("$part_1", part(1)), string("$part_2", part(41)), string("$word", F.substring("h", 81, 12)), string("$again", F.substring("h", 121, 10))).alias("strings"),
        F.array(F.array(group(["$part_1", "$part_2"], 2, 1), group(["$word"], 1, 1)), F.array(group(["$word", "$again"], 1, 2))).alias("alternatives"),
    )


@query(
    "binary_rule_table",
    "SIG-2 JOIN-18",
    """WITH d AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE text <> ''),
        i AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark),
        p AS (SELECT item_id, [substr(h, 1, 9) || '[0-9A-F]' || substr(h, 11, 4) || '[0-9A-F]{2}' || substr(h, 17, 8), substr(h, 41, 9) || '[0-9A-F]' || substr(h, 51, 4) || '[0-9A-F]{2}' || substr(h, 57, 8)] AS parts,
            substr(h, 81, 12) AS word, substr(h, 121, 10) AS again FROM i),
        m AS (SELECT doc_id, item_id, regexp_matches(x, '^(?:..)*?' || parts[1]) AND regexp_matches(x, '^(?:..)*?' || parts[2]) AND regexp_matches(x, '^(?:..)*?' || word) AS whole,
            regexp_matches(x, '^(?:..)*?' || word || '(?:..)*?' || word) OR regexp_matches(x, '^(?:..)*?' || again || '(?:..)*?' || again) AS twice, x FROM d, p)
        SELECT doc_id, 'item_' || item_id AS rule_name FROM m WHERE (whole OR twice) AND (item_id % 3 <> 0 OR regexp_matches(x, '^(4[1-9A-F]|5[0-9A])'))""",
)
def binary_rule_table(spark, sf):
    docs = D.documents(spark, sf, "doc_id", "text").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return S.binary_signature_hits(docs, "content", item_rules(spark, sf), ["doc_id"])
