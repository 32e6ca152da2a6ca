"""Markdown scan, structure and link queries."""

from pyspark.sql import functions as F

from .. import rules as R
from ..functions.patterns import re2, sql_str
from ..operators import links as L
from ..operators import markdown as M
from . import derived as D
from .registry import query
from .sqlgen import find_all_sql, scan_sql

_MD = D.MARKDOWN_SQL
_SCAN_COLS = 'doc_id, family, rule_name, match, start, "end"'


def _scan_out(df, *keys):
    return df.select(*keys, "family", "rule_name", "match", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("markdown_xss", "RX-0 RX-1", f"SELECT {_SCAN_COLS} FROM {scan_sql(_MD, 'doc_id', 'text', R.XSS_RULES)}")
def markdown_xss(spark, sf):
    return _scan_out(M.content_findings(D.markdown(spark, sf), rules=R.XSS_RULES), "doc_id")


@query(
    "page_xss",
    "RX-0 RX-1",
    f"SELECT page_id, rule_name, count(*) AS n, min(start) AS first_start, sum(length(match)) AS matched_chars FROM {scan_sql('pages', 'page_id', 'html', R.XSS_RULES)} GROUP BY ALL",
)
def page_xss(spark, sf):
    found = M.content_findings(D.pages(spark, sf), "html", ("page_id",), R.XSS_RULES)
    return found.groupBy("page_id", "rule_name").agg(
        F.count("*").alias("n"), F.min("start").cast("long").alias("first_start"), F.sum(F.length("match")).alias("matched_chars")
    )


@query("prompt_injection", "RX-0 RX-2", f"SELECT {_SCAN_COLS} FROM {scan_sql(_MD, 'doc_id', 'text', R.PROMPT_INJECTION_RULES)}")
def prompt_injection(spark, sf):
    return _scan_out(M.content_findings(D.markdown(spark, sf), rules=R.PROMPT_INJECTION_RULES), "doc_id")


def _manipulation_sql() -> str:
    parts = []
    for r in R.MANIPULATION_RULES:
        groups = dict(r.groups)
        named = " || ".join(f"CASE WHEN {g} IS NULL THEN '' ELSE '{g}=' || {g} || ';' END" for g in groups) or "''"
        src = find_all_sql(_MD, "doc_id", "text", r.pattern, r.flags, f"{sql_str(r.name)} AS rule_name", groups)
        parts.append(f'SELECT doc_id, rule_name, match, start, "end", {named} AS named_groups FROM ({src})')
    return " UNION ALL ".join(parts)


@query("behavior_manipulation", "RX-0 RX-3", _manipulation_sql())
def behavior_manipulation(spark, sf):
    found = M.content_findings(D.markdown(spark, sf), rules=R.MANIPULATION_RULES)
    named = F.array_join(F.transform(F.map_entries("groups"), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))), "")
    return found.select("doc_id", "rule_name", "match", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), named.alias("named_groups"))


_LB = sql_str(r"\r\n|[\n\x{0B}\f\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]")


def lines_sql(text: str = "text") -> str:
    parts = f"regexp_split_to_array({text}, {_LB})"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[1:len({parts})-1] ELSE {parts} END"


_LINTS = "list_filter([CASE WHEN NOT regexp_matches(text, '[^\\s]') THEN 'Markdown is empty.' END, CASE WHEN NOT contains(text, '# ') THEN 'No top-level heading found.' END], lambda x: x IS NOT NULL)"


def _sections_sql() -> str:
    items = []
    for s in R.REQUIRED_SECTIONS:
        items.append(
            f"CASE WHEN NOT (contains(text, '====' || chr(10) || chr(10) || '{s}') OR contains(text, chr(10) || '{s}' || chr(10) || chr(10) || '====') "
            f"OR regexp_matches(text, '(?m)^#+ {s}')) THEN 'Missing required section: ''{s}''. Expected ''==== {s} ===='' or ''# {s}''.' END"
        )
    items += [
        "CASE WHEN NOT contains(text, '=====') THEN 'Missing ''====='' separators, which are typical in llms.txt.' END",
        "CASE WHEN contains(text, 'TOOL USE') AND NOT contains(text, '<tool_name>') THEN '''TOOL USE'' section found, but no ''<tool_name>'' tags detected, which might indicate malformed tool definitions.' END",
        "CASE WHEN contains(text, 'MODE') AND NOT contains(text, '<slug>') THEN '''MODES'' section found, but no ''<slug>'' tags detected, which might indicate malformed mode definitions.' END",
        "CASE WHEN contains(text, 'OBJECTIVE') AND NOT contains(text, '<attempt_completion>') THEN 'OBJECTIVE section is present, but no ''<attempt_completion>'' tag found. Ensure the agent can complete tasks.' END",
    ]
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


_SECTIONED = "CASE WHEN doc_id % 5 = 0 THEN concat('# TOOL USE', chr(10), '====', chr(10), chr(10), 'RULES', chr(10), text) WHEN doc_id % 5 = 1 THEN concat('=====', chr(10), '## OBJECTIVE', chr(10), text) ELSE text END"


@query(
    "structure_lint",
    "RX-5 RX-6",
    f"SELECT doc_id, array_to_string({_LINTS}, '|') AS lint, array_to_string({_sections_sql()}, '|') AS custom_rules FROM (SELECT doc_id, {_SECTIONED} AS text FROM documents)",
)
def structure_lint(spark, sf):
    docs = D.documents(spark, sf, "doc_id", "text").withColumn("text", F.expr(_SECTIONED))
    return docs.select("doc_id", F.array_join(M.lint(F.col("text")), "|").alias("lint"), F.array_join(M.section_rules(F.col("text")), "|").alias("custom_rules"))


_RUN31 = sql_str("|".join(r"\x{%02X}{31}" % c for c in [*range(9, 10), *range(32, 127), 0xA0, 0x2014, 0xB7]))
_STRUCT_EXPR = "concat(text, CASE WHEN doc_id % 4 = 0 THEN repeat(chr(10), 14) ELSE '' END, CASE WHEN doc_id % 9 = 0 THEN repeat(concat('# h', chr(10)), 60) ELSE chr(10) END, CASE WHEN doc_id % 7 = 0 THEN concat(repeat('=', 40), chr(10), '###### deep') ELSE '' END)"


@query(
    "abnormal_structure",
    "RX-7 WIN-8",
    f"""WITH l AS (SELECT doc_id, {lines_sql()} AS ls FROM (SELECT doc_id, {_STRUCT_EXPR} AS text FROM documents)),
    f AS (SELECT doc_id, ls, array_to_string(list_transform(ls, lambda x: CASE WHEN regexp_matches(x, '[^\\s]') THEN '0' ELSE '1' END), '') AS flags FROM l),
    s AS (SELECT *, length(replace(flags, '0', '')) AS blank, coalesce(list_max(list_transform(string_split(flags, '0'), lambda r: length(r))), 0) AS longest,
          len(list_filter(ls, lambda x: regexp_matches(x, '^#+ '))) AS heads, len(ls) AS total FROM f),
    per AS (SELECT doc_id, flatten(list_transform(ls, lambda x, i: list_filter([
        CASE WHEN length(x) > 1000 THEN 'Line ' || i || ' is unusually long (>' || length(x) || ' chars).' END,
        CASE WHEN regexp_matches(x, {_RUN31}) THEN 'Line ' || i || ' contains 30+ repeated characters.' END,
        CASE WHEN regexp_matches(x, '^#{{6,}}') THEN 'Line ' || i || ' uses a very deep heading level (H6+).' END], lambda z: z IS NOT NULL))) AS a FROM l)
    SELECT s.doc_id, blank AS blank_lines, longest AS longest_blank_run, array_to_string(a || list_filter([
        CASE WHEN blank > total / 2 THEN 'Excessive empty lines: ' || blank || ' out of ' || total || ' lines.' END,
        CASE WHEN longest > 10 THEN 'Excessive consecutive empty lines: ' || longest || ' lines.' END,
        CASE WHEN heads > 50 AND total < 1000 THEN 'Unusually high number of headings: ' || heads || ' headings in ' || total || ' lines.' END], lambda z: z IS NOT NULL), '|') AS abnormal_patterns
    FROM s JOIN per USING (doc_id)""",
)
def abnormal_structure(spark, sf):
    docs = D.documents(spark, sf, "doc_id", "text").select("doc_id", M.lines(F.expr(_STRUCT_EXPR)).alias("ls"))
    blank, longest = M.blank_line_stats(F.col("ls"))
    return docs.select("doc_id", blank.alias("blank_lines"), longest.alias("longest_blank_run"), F.array_join(M.abnormal_patterns(F.col("ls")), "|").alias("abnormal_patterns"))


_TEMPLATE = "# Doc 0\n\n## Section 0\n"


@query(
    "outline_match",
    "RX-8",
    f"SELECT doc_id, array_to_string(h, '|') AS headings, h = ['# Doc 0', '## Section 0'] AS matches_template FROM (SELECT doc_id, list_transform(list_filter({lines_sql()}, lambda x: regexp_matches(x, '^#+ ')), lambda x: trim(x)) AS h FROM {_MD})",
)
def outline_match(spark, sf):
    out = M.structure_report(D.markdown(spark, sf).select("doc_id", "text"), template=_TEMPLATE)
    return out.select("doc_id", F.array_join("headings", "|").alias("headings"), "matches_template")


_ATTR = sql_str(r"""\s([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_OK_TAGS = "[" + ", ".join(f"'{t}'" for t in R.ALLOWED_TAGS) + "]"
_OK_ATTRS = "[" + ", ".join(f"'{t}.{a}'" for t, attrs in R.ALLOWED_ATTRIBUTES.items() for a in attrs) + "]"
_UNQUOTE = "regexp_replace(regexp_replace({v}, '^[\"'']', ''), '[\"'']$', '')"
_SANITIZED_HTML = "concat('<p id=x onclick=\"a()\">', '<a href=''javascript:x'' title=\"t\">j</a><a HREF=http://e.com>k</a><!-- c --></p>', html)"


def _sanitize_sql() -> str:
    v = _UNQUOTE.format(v="z[2]")
    attrs = f"""array_to_string(list_transform(list_filter(list_zip(regexp_extract_all(tg, {_ATTR}, 1), regexp_extract_all(tg, {_ATTR}, 2)), lambda z:
      (list_contains({_OK_ATTRS}, nm || '.' || lower(z[1])) OR list_contains({_OK_ATTRS}, '*.' || lower(z[1])))
      AND (lower(z[1]) NOT IN ('href', 'src') OR lower(regexp_extract({v}, '^\\s*([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) IN ('', 'http', 'https', 'mailto', 'ftp'))),
      lambda z: ' ' || lower(z[1]) || '="' || {v} || '"'), '')"""
    return f"""WITH c AS (SELECT page_id, regexp_replace(h, '(?s)<!--.*?-->', '', 'g') AS h FROM (SELECT page_id, {_SANITIZED_HTML} AS h FROM pages)),
    p AS (SELECT page_id, regexp_split_to_array(h, '<[^>]*>') AS ps, regexp_extract_all(h, '<[^>]*>', 0) AS ts FROM c),
    t AS (SELECT page_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS piece, unnest(list_concat(ts, [NULL])) AS tg FROM p),
    n AS (SELECT *, lower(regexp_extract(tg, '^</?\\s*([a-zA-Z][a-zA-Z0-9]*)', 1)) AS nm FROM t),
    r AS (SELECT page_id, i, piece || CASE WHEN tg IS NULL OR NOT list_contains({_OK_TAGS}, nm) THEN '' WHEN starts_with(tg, '</') THEN '</' || nm || '>'
          ELSE '<' || nm || {attrs} || '>' END AS x FROM n)
    SELECT page_id, string_agg(x, '' ORDER BY i) AS sanitized FROM r GROUP BY page_id"""


@query("sanitized_pages", "RX-4", _sanitize_sql())
def sanitized_pages(spark, sf):
    return D.pages(spark, sf).select("page_id", M.sanitize(F.expr(_SANITIZED_HTML.replace("''", "\\'"))).alias("sanitized"))


# --- links -------------------------------------------------------------------------------------
_URL_RE = sql_str(re2(L.URL_PATTERN, "i"))
_PARTS = sql_str(L.URL_PARTS)


def urls_sql(src: str, key: str, text: str) -> str:
    """key, position, url for distinct links in first-seen order."""
    g = [f"regexp_extract_all({text}, {_URL_RE}, {i})" for i in (1, 2, 3)]
    return f"""(SELECT {key}, url, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS position FROM (
      SELECT {key}, url, min(i) AS i FROM (SELECT {key}, unnest(range(0, len({g[0]}))) AS i,
        unnest(list_transform(list_zip({g[0]}, {g[1]}, {g[2]}), lambda z: CASE WHEN z[1] <> '' THEN z[1] WHEN z[2] <> '' THEN z[2] ELSE z[3] END)) AS url FROM {src})
      GROUP BY {key}, url))"""


def parts_sql(src: str) -> str:
    """Adds scheme, netloc, path, hostname, malformed, normalized_url, reputation, reasons."""
    schemes = ", ".join(f"'{s}'" for s in L.NETLOC_SCHEMES)
    return f"""(WITH a AS (SELECT *, lower(regexp_extract(url, {_PARTS}, 1)) AS s, regexp_extract(url, {_PARTS}, 2) AS n,
        regexp_replace(regexp_extract(url, {_PARTS}, 3), ';[^/]*$', '') AS p FROM {src}),
      b AS (SELECT *, lower(regexp_extract(n, '([^@]*)$', 1)) AS hp, regexp_matches(n, '[\\[\\]]') AND NOT regexp_matches(n, {sql_str(L.BRACKETED_HOST)}) AS malformed FROM a),
      c AS (SELECT *, CASE WHEN starts_with(hp, '[') THEN regexp_extract(hp, '^\\[([^\\]]*)\\]', 1) ELSE string_split(hp, ':')[1] END AS host FROM b),
      d AS (SELECT *, CASE WHEN malformed THEN NULL ELSE CASE WHEN s <> '' THEN s || ':' ELSE '' END ||
         CASE WHEN n <> '' THEN '//' || lower(n) || CASE WHEN p <> '' AND NOT starts_with(p, '/') THEN '/' || p ELSE p END
              WHEN starts_with(p, '//') OR (s IN ({schemes}) AND (p = '' OR starts_with(p, '/'))) THEN '//' || p ELSE p END END AS norm,
         list_filter([CASE WHEN malformed THEN 'malformed' END, CASE WHEN s IN ('javascript', 'data', 'vbscript') THEN 'risky_scheme' END,
           CASE WHEN len(regexp_extract_all(p || host, '%[0-9a-fA-F]{{2}}')) > 5 THEN 'percent_encoding' END,
           CASE WHEN regexp_matches(url, '\\\\u[0-9a-fA-F]{{4}}') THEN 'unicode_escape' END,
           CASE WHEN regexp_matches(host, '^[0-9]+$') AND coalesce(try_cast(host AS hugeint) > 65535, true) THEN 'decimal_host' END,
           CASE WHEN length(host) - length(replace(host, '.', '')) > 7 THEN 'many_dots' END, CASE WHEN contains(host, 'xn--') THEN 'punycode' END,
           CASE WHEN contains(p, '@') THEN 'at_in_path' END, CASE WHEN regexp_matches(lower(url), '\\.exe|\\.bat|\\.sh|\\.js') THEN 'payload_extension' END,
           CASE WHEN regexp_matches(n, '[\\[\\](){{}}]') THEN 'brackets_in_authority' END, CASE WHEN length(url) > 2000 THEN 'very_long' END], lambda x: x IS NOT NULL) AS reasons FROM c)
      SELECT *, coalesce(norm, url) AS normalized_url, CASE WHEN malformed THEN 'error_parsing_url' WHEN lower(n) LIKE '%.ru' OR lower(n) IN ('malicious.com', 'phish.site') THEN 'bad' WHEN n <> '' THEN 'good' END AS reputation,
        CASE WHEN malformed THEN url || '>error_parsing_url' WHEN contains(norm, 'redirect') THEN norm || '>https://final.destination.com' ELSE norm END AS chain FROM d)"""


_LINKED = "concat(html, ' http://3232235777/a ', '<HTTP://User:pw@EXAMPLE.com/A;v=1/b;c?x#y> [u](redirect/x) <//h.ru/p> <http://[::1/x> ', 'http://a.b.c.d.e.f.g.h.i/%41%42%43%44%45%46 <data:text;x> ')"


@query(
    "link_checks",
    "RX-9 RX-10 RX-11 RX-12 SET-6 JOIN-23",
    f"""SELECT page_id, position, url, normalized_url, reputation, chain AS redirect_chain, len(reasons) > 0 AS is_obfuscated, array_to_string(reasons, ',') AS reasons
        FROM {parts_sql(urls_sql(f'(SELECT page_id, {_LINKED} AS h FROM pages)', 'page_id', 'h'))}""",
)
def link_checks(spark, sf):
    pages = D.pages(spark, sf).select("page_id", F.expr(_LINKED).alias("h"))
    links = L.link_table(pages, "h", ("page_id",))
    return links.withColumn("redirect_chain", F.array_join("redirect_chain", ">")).withColumn("reasons", F.array_join("reasons", ","))


@query(
    "link_report",
    "RX-13 RX-9 SET-6",
    f"""WITH l AS (SELECT * FROM {parts_sql(urls_sql(_MD, 'doc_id', 'text'))}),
        m AS (SELECT doc_id, normalized_url, min(position) AS position, arg_min(reputation, position) AS reputation FROM l GROUP BY ALL)
    SELECT doc_id, (SELECT string_agg(url, ' ' ORDER BY position) FROM l x WHERE x.doc_id = d.doc_id) AS urls,
      (SELECT string_agg(normalized_url, ' ' ORDER BY position) FROM l x WHERE x.doc_id = d.doc_id) AS normalized_urls,
      (SELECT coalesce(string_agg(normalized_url || '=' || reputation, ' ' ORDER BY position), '') FROM m x WHERE x.doc_id = d.doc_id AND reputation IS NOT NULL) AS domain_reputation,
      (SELECT coalesce(string_agg(url, ' ' ORDER BY position), '') FROM l x WHERE x.doc_id = d.doc_id AND len(reasons) > 0) AS obfuscated_urls
    FROM (SELECT DISTINCT doc_id FROM l) d""",
)
def link_report(spark, sf):
    report = L.link_report(L.link_table(D.markdown(spark, sf).select("doc_id", "text")))
    return report.select(
        "doc_id",
        F.array_join("urls", " ").alias("urls"),
        F.array_join("normalized_urls", " ").alias("normalized_urls"),
        F.array_join(F.transform(F.map_entries("domain_reputation"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ").alias("domain_reputation"),
        F.array_join("obfuscated_urls", " ").alias("obfuscated_urls"),
    )


@query(
    "redirect_chains",
    "JOIN-23",
    """WITH RECURSIVE r AS (SELECT a.url AS src, b.url AS dst FROM pages a JOIN pages b ON b.page_id = a.page_id - 1 AND a.page_id % 16 <> 0),
       c(url, last, chain, hops) AS (SELECT url, url, [url], 0 FROM (SELECT DISTINCT url FROM pages)
         UNION ALL SELECT c.url, r.dst, list_append(c.chain, r.dst), hops + 1 FROM c JOIN r ON r.src = c.last WHERE NOT list_contains(c.chain, r.dst))
       SELECT url, array_to_string(arg_max(chain, hops), ' ') AS chain, max(hops) AS hops FROM c GROUP BY url""",
)
def redirect_chains(spark, sf):
    pages = D.table(spark, sf, "pages").select("page_id", "url")
    src = pages.where("page_id % 16 <> 0").select(F.col("url").alias("src"), (F.col("page_id") - 1).alias("to_id"))
    redirects = src.join(pages.select(F.col("page_id").alias("to_id"), F.col("url").alias("dst")), "to_id").select("src", "dst", "to_id")
    chains = L.follow_redirects(pages.select("url").distinct(), redirects, prefer="to_id")
    # a page without URL has a chain of nothing, which joins to null and not to an empty text
    return chains.select("url", F.when(F.col("url").isNotNull(), F.array_join("chain", " ")).alias("chain"), (F.size("chain") - 1).alias("hops"))


@query(
    "markdown_report",
    "RX-14 RX-1 RX-2 RX-3",
    f"""WITH f AS (SELECT doc_id, count_if(family = 'xss') AS xss, count_if(family = 'prompt_injection') AS injection, count_if(family = 'behavior_manipulation') AS manipulation
                   FROM {scan_sql(_MD, 'doc_id', 'text', R.MARKDOWN_RULES)} GROUP BY doc_id),
        l AS (SELECT doc_id, count(*) AS links FROM {urls_sql(_MD, 'doc_id', 'text')} GROUP BY doc_id)
    SELECT d.doc_id, len({_LINTS}) + len({_sections_sql()}) AS structural_issues, coalesce(links, 0) AS links, coalesce(xss, 0) AS xss_vectors,
           coalesce(injection, 0) AS prompt_injections, coalesce(manipulation, 0) AS manipulations
    FROM {_MD} d LEFT JOIN f USING (doc_id) LEFT JOIN l USING (doc_id)""",
)
def markdown_report(spark, sf):
    docs = D.markdown(spark, sf).select("doc_id", "text")
    text = F.col("text")
    found = M.content_findings(docs).groupBy("doc_id").agg(
        *[F.count_if(F.col("family") == fam).alias(out) for fam, out in (("xss", "xss_vectors"), ("prompt_injection", "prompt_injections"), ("behavior_manipulation", "manipulations"))]
    )
    base = docs.select("doc_id", (F.size(M.lint(text)) + F.size(M.section_rules(text))).alias("structural_issues"), F.size(L.extract_urls(text)).alias("links"))
    return base.join(found, "doc_id", "left").na.fill(0)
