"""Feature, anomaly, classifier and accuracy queries."""

from pyspark.sql import functions as F

from .. import rules as R
from ..functions.patterns import re2, sql_str
from ..operators import anomaly as AN
from ..operators import evaluate as EV
from ..operators import false_positives as FP
from ..operators import features as FE
from ..operators import secrets as S
from ..session import materialize, shared_dir
from ..sinks import tables as T
from . import derived as D
from .registry import query
from .secrets_queries import deduped_sql

_MD = D.MARKDOWN_SQL
_NL = "chr(10)"


def _count(p, f):
    return f"len(regexp_extract_all(text, {sql_str(re2(p, f))}, 0))"


def _flag(p, f, t="text"):
    return f"regexp_matches({t}, {sql_str(re2(p, f))})"


def stats_sql(src: str) -> str:
    w = f"regexp_extract_all(lower(text), {sql_str(R.WORD)}, 0)"
    return f"""(SELECT *, len(string_split(text, {_NL})) AS line_count, length(text) AS char_count, len(w) AS word_count, (length(text) - len(string_split(text, {_NL})) + 1) / len(string_split(text, {_NL})) AS avg_line_length,
       CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0 END AS avg_word_length, len(list_distinct(w)) AS unique_words, CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END AS lexical_diversity,
       CASE WHEN length(text) > 0 THEN {_count(R.SPECIAL_CHARACTER, '')} / length(text) ELSE 0 END AS special_char_ratio FROM (SELECT *, {w} AS w FROM {src}))"""


def code_sql(src: str) -> str:
    counts = ", ".join(f"{_count(p, f)} AS {n}" for n, (p, f) in R.CODE_COUNTS.items())
    langs = f"list_filter(list_transform(regexp_extract_all(text, {sql_str(re2(R.FENCE_LANGUAGE))}, 1), lambda x: lower(x)), lambda x: x NOT IN ('', 'text', 'markdown', 'md'))"
    return f"(SELECT *, {counts}, {_flag(R.OBFUSCATED_CODE, '')} AS has_obfuscated_code, len(list_distinct({langs})) AS language_count FROM {src})"


def structure_sql(src: str) -> str:
    counts = ", ".join(f"{_count(p, f)} AS {n}" for n, (p, f) in R.MARKDOWN_COUNTS.items())
    depth = f"coalesce(list_max(list_transform(regexp_extract_all(text, {sql_str(re2(*R.HEADING_LEVEL))}, 1), lambda x: length(x))), 0)"
    return f"(SELECT *, {counts}, {depth} AS max_heading_depth, {_flag(*R.PROPER_STRUCTURE)} AS has_proper_structure FROM {src})"


def security_sql(src: str) -> str:
    cols = [f"{_flag(p, f)} AS {n}" for n, (p, f) in R.SECURITY_FLAGS.items()] + [f"{_count(p, f)} AS {n}" for n, (p, f) in R.EVASION_COUNTS.items()]
    return f"(SELECT *, {', '.join(cols)} FROM {src})"


_MARK = "concat(text, chr(10), CASE doc_id % 7 WHEN 0 THEN 'import os; def f(x): exec(x)' WHEN 1 THEN concat(chr(92), 'x41', chr(92), 'u0041 \"a\" + \"b\"') WHEN 2 THEN 'SELECT * FROM t; host 1.2.3.4' WHEN 3 THEN concat('|a|b|', chr(10), '|---|---|', chr(10), '> quote ![i](u)') WHEN 4 THEN '<script>x</script> window[\"eval\"]' ELSE 'plain' END)"
_SRC = f"(SELECT doc_id, url, source, {_MARK} AS text FROM {_MD})"
_ALL = security_sql(structure_sql(code_sql(stats_sql(_SRC))))


def _docs(spark, sf):
    return D.markdown(spark, sf).withColumn("text", F.expr(_MARK.replace("chr(92)", "char(92)"))).select("doc_id", "url", "source", "text")


def feature_table(spark, sf):
    history = D.table(spark, sf, "labels").select("doc_id")
    return FE.extract(_docs(spark, sf), history=history)


def _longs(df, keep, names):
    return df.select(*keep, *[(F.round(n, 6) if n in ("avg_line_length", "avg_word_length", "lexical_diversity", "special_char_ratio") else F.col(n)).alias(n) for n in names])


@query(
    "text_statistics",
    "FE-1",
    f"SELECT doc_id, line_count, char_count, word_count, unique_words, round(avg_line_length, 6) AS avg_line_length, round(avg_word_length, 6) AS avg_word_length, round(lexical_diversity, 6) AS lexical_diversity, round(special_char_ratio, 6) AS special_char_ratio FROM {stats_sql('documents')}",
)
def text_statistics(spark, sf):
    out = FE.with_text_statistics(D.documents(spark, sf, "doc_id", "text"))
    return _longs(out, ["doc_id"], ["line_count", "char_count", "word_count", "unique_words", "avg_line_length", "avg_word_length", "lexical_diversity", "special_char_ratio"])


@query("code_patterns", "FE-2", f"SELECT doc_id, {', '.join(R.FEATURE_SETS['code_patterns'])} FROM {code_sql(_SRC)}")
def code_patterns(spark, sf):
    return FE.with_code_patterns(_docs(spark, sf)).select("doc_id", *R.FEATURE_SETS["code_patterns"])


@query("markdown_structure", "FE-3", f"SELECT doc_id, section_count, {', '.join(R.FEATURE_SETS['markdown_structure'])} FROM {structure_sql(_SRC)}")
def markdown_structure(spark, sf):
    return FE.with_markdown_structure(_docs(spark, sf)).select("doc_id", "section_count", *R.FEATURE_SETS["markdown_structure"])


@query("security_indicators", "FE-4", f"SELECT doc_id, {', '.join(R.FEATURE_SETS['security_indicators'])} FROM {security_sql(_SRC)}")
def security_indicators(spark, sf):
    return FE.with_security_indicators(_docs(spark, sf)).select("doc_id", *R.FEATURE_SETS["security_indicators"])


_PAGE_URL = "concat(url, CASE page_id % 3 WHEN 0 THEN '.xyz/a' ELSE '' END)"


@query("page_metadata_features", "FE-5", f"SELECT page_id, length(u) AS url_length, {_flag(R.SUSPICIOUS_DOMAIN, '', 'u')} AS has_suspicious_domain, length(html) AS content_size FROM (SELECT page_id, {_PAGE_URL} AS u, html FROM pages)")
def page_metadata_features(spark, sf):
    pages = D.table(spark, sf, "pages").select("page_id", F.expr(_PAGE_URL).alias("url"), "html")
    return FE.with_metadata(pages, "html").select("page_id", "url_length", "has_suspicious_domain", "content_size")


_VECTOR = ", ".join(f"cast({n} as double)" for s, names in R.FEATURE_SETS.items() if s != "metadata" for n in names)


@query(
    "feature_vectors",
    "FE-6 FE-5",
    f"""SELECT doc_id, '1.0.0' AS feature_version, 36 AS dimensions, round(list_sum([{_VECTOR}, cast(length(url) as double), 0.0, cast(length(text) as double), CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1.0 ELSE 0.0 END]), 4) AS total FROM {_ALL}""",
)
def feature_vectors(spark, sf):
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return feature_table(spark, sf).select("doc_id", "feature_version", F.size("features").alias("dimensions"), F.round(total, 4).alias("total"))


def _secret_findings(spark, sf):
    return S.secret_findings(D.markdown(spark, sf)).withColumn("finding_type", F.expr("CASE detector WHEN 'sensitive_detector' THEN 'xss' WHEN 'trufflehog' THEN 'credential_exposure' ELSE finding_type END"))


@query(
    "finding_vectors",
    "FE-7",
    f"""SELECT doc_id, rule_id, location, 47 AS dimensions, concat_ws('', CASE WHEN detector = 'trufflehog' THEN 1 ELSE 0 END, 0, CASE WHEN detector = 'sensitive_detector' THEN 1 ELSE 0 END, 0, 0, CASE WHEN severity = 'High' THEN 1 ELSE 0 END, CASE WHEN severity = 'Medium' THEN 1 ELSE 0 END,
          CASE WHEN severity = 'Low' THEN 1 ELSE 0 END, 1, 1, 0) AS finding_bits FROM {deduped_sql(_MD)}""",
)
def finding_vectors(spark, sf):
    rows = FP.finding_rows(_secret_findings(spark, sf), feature_table(spark, sf))
    bits = F.array_join(F.transform(F.slice("features", 37, 11), lambda x: x.cast("int").cast("string")), "")
    return rows.select("doc_id", "rule_id", "location", F.size("features").alias("dimensions"), bits.alias("finding_bits"))


_PROFILE_COLS = ["line_count", "lexical_diversity", "special_char_ratio", "eval_exec_count", "import_count", "code_block_count", "heading_count"]
_RATES = {"obfuscation_rate": "has_obfuscated_code", "proper_structure_rate": "has_proper_structure", "credential_rate": "has_credentials", "ip_address_rate": "has_ip_addresses", "base64_rate": "has_base64", "script_tags_rate": "has_script_tags", "command_injection_rate": "has_command_injection"}
_PROFILE = f"""(SELECT {', '.join(f'avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std' for c in _PROFILE_COLS)}, min(line_count) AS line_count_min, max(line_count) AS line_count_max, max(eval_exec_count) AS eval_exec_count_max,
   {', '.join(f'avg({c}::int) AS {r}' for r, c in _RATES.items())} FROM f)"""


@query("normal_profile", "AGG-9", f"WITH f AS {_ALL} SELECT round(COLUMNS(*), 6) FROM {_PROFILE}")
def normal_profile(spark, sf):
    out = AN.normal_profile(feature_table(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "rule_outliers",
    "ML-4 AGG-9",
    f"""WITH f AS {_ALL}, p AS {_PROFILE}, g AS (SELECT doc_id, [CASE WHEN special_char_ratio > special_char_ratio_mean + 3 * special_char_ratio_std THEN least((special_char_ratio - special_char_ratio_mean) / (3 * special_char_ratio_std), 1.0) END,
          CASE WHEN eval_exec_count > greatest(eval_exec_count_mean + 3 * eval_exec_count_std, eval_exec_count_max) THEN 1.0 END, CASE WHEN has_obfuscated_code AND obfuscation_rate < 0.1 THEN 0.9 END,
          CASE WHEN has_credentials AND credential_rate < 0.2 THEN 0.8 END, CASE WHEN has_command_injection AND command_injection_rate < 0.1 THEN 0.95 END] AS s FROM f, p)
        SELECT doc_id, len(list_filter(s, lambda x: x IS NOT NULL)) > 0 AS is_outlier, round(coalesce(list_max(s), 0.0), 6) AS outlier_score, round(CASE WHEN len(list_filter(s, lambda x: x IS NOT NULL)) > 0 THEN least(0.5 + 0.1 * len(list_filter(s, lambda x: x IS NOT NULL)), 0.9) ELSE 0.5 END, 6) AS outlier_confidence FROM g""",
)
def rule_outliers(spark, sf):
    feats = feature_table(spark, sf)
    out = AN.rule_outliers(feats, AN.normal_profile(feats))
    return out.select("doc_id", "is_outlier", F.round("outlier_score", 6).alias("outlier_score"), F.round("outlier_confidence", 6).alias("outlier_confidence"))


@query("isolation_forest", "ML-1 ML-2 ML-13 AGG-11 UDF-6")
def isolation_forest(spark, sf):
    vectors = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    path = shared_dir(spark, "forest")
    AN.save_forest(AN.fit_forest(vectors), path)
    scored = materialize(AN.forest_scores(vectors, AN.load_forest(spark, path)), "forest-scores")
    return AN.anomaly_results(scored, AN.contamination_threshold(scored).scalar()).select("doc_id", "anomaly_score", "is_anomaly", "anomaly_confidence")


@query("forest_grid", "ML-9")
def forest_grid(spark, sf):
    vectors = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return AN.grid_by_variance(vectors, [{"n_estimators": n, "max_samples": m} for n in (50, 100, 200) for m in (256, 100, 200)]).orderBy(F.desc("score_variance"))


_CONTRIB_SQL = f"""WITH f AS {_ALL}, e AS (SELECT doc_id, list_sort(list_filter([{', '.join(f"CASE WHEN {n} THEN (-0.9::double, {i}, 'security_indicator.{n}') END" for i, n in enumerate(R.SECURITY_FLAGS))},
   {', '.join(f"CASE WHEN {n} > 0 THEN (-0.8::double, {i}, 'evasion_technique.{n}') END" for i, n in enumerate(R.EVASION_COUNTS, 7))},
   {', '.join(f"CASE WHEN {n} > 0 THEN (-least({n} * 0.5, 0.9)::double, {i}, 'code_pattern.{n}') END" for i, n in enumerate(R.CODE_COUNTS, 10))}, CASE WHEN has_obfuscated_code THEN (-0.7::double, 15, 'code_pattern.has_obfuscated_code') END,
   CASE WHEN language_count > 0 THEN (-least(language_count * 0.5, 0.9)::double, 16, 'code_pattern.language_count') END, CASE WHEN NOT has_proper_structure THEN (-0.8::double, 17, 'markdown_structure.improper_structure') END], lambda x: x IS NOT NULL))[1:5] AS r FROM f)
   SELECT doc_id, array_to_string(list_transform(r, lambda x: x[3]), ',') AS features, round(list_sum(list_transform(r, lambda x: -x[1])), 6) AS total FROM e"""


@query("contributing_features", "ML-3 TOP-5", _CONTRIB_SQL)
def contributing_features(spark, sf):
    out = feature_table(spark, sf).withColumn("c", AN.contributing_features(F.lit(True)))
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x["contribution"])
    return out.select("doc_id", F.array_join(F.transform("c", lambda x: x["feature"]), ",").alias("features"), F.round(total, 6).alias("total"))


@query(
    "combined_anomalies",
    "ML-5 JOIN-10",
    f"""WITH a AS (SELECT doc_id, (doc_id % 10) / 10.0 AS s, (doc_id % 10) / 10.0 > 0.6 AS f, 0.4 + (doc_id % 5) / 10.0 AS c FROM documents), o AS (SELECT doc_id, doc_id % 4 = 0 AS f, CASE WHEN doc_id % 4 = 0 THEN 0.9 ELSE 0.0 END AS s, CASE WHEN doc_id % 4 = 0 THEN 0.6 ELSE 0.5 END AS c FROM documents)
        SELECT doc_id AS content_id, a.f OR o.f AS is_anomalous, round(a.s * 0.7 + o.s * 0.3, 6) AS combined_score, round(CASE WHEN a.f = o.f THEN greatest(a.c, o.c) ELSE least(a.c, o.c) END, 6) AS confidence, CASE WHEN o.f THEN 'code_obfuscation,x' ELSE 'x' END AS factors FROM a JOIN o USING (doc_id)""",
)
def combined_anomalies(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id")
    k = F.col("doc_id")
    feature = F.array(F.struct(F.lit("x").alias("feature"), F.lit(1.0).alias("value"), F.lit(0.5).alias("contribution")))
    a = docs.select("doc_id", ((k % 10) / 10.0).alias("anomaly_score"), ((k % 10) / 10.0 > 0.6).alias("is_anomaly"), (F.lit(0.4) + (k % 5) / 10.0).alias("anomaly_confidence"), feature.alias("contributing_features"))
    flag = k % 4 == 0
    factor = F.struct(F.lit("code_obfuscation").alias("factor"), F.lit(1.0).alias("value"), F.lit(0.9).alias("severity"))
    o = docs.select("doc_id", flag.alias("is_outlier"), F.when(flag, 0.9).otherwise(0.0).alias("outlier_score"), F.when(flag, 0.6).otherwise(0.5).alias("outlier_confidence"), F.when(flag, F.array(factor)).otherwise(F.array_remove(F.array(factor), factor)).alias("outlier_factors"))
    out = AN.combine(a, o)
    return out.select("content_id", "is_anomalous", F.round("combined_score", 6).alias("combined_score"), F.round("confidence", 6).alias("confidence"), F.array_join(F.transform("contributing_factors", lambda x: x["factor"]), ",").alias("factors"))


@query("anomaly_findings", "ML-14")
def anomaly_findings(spark, sf):
    from ..operators.scoring import classify

    results = AN.detect(feature_table(spark, sf)).withColumn("url_id", F.col("content_id"))
    return T.anomaly_findings(results, classify(F.col("combined_score"))).select("content_id", "finding_type", "severity", "location")


# --- false positives ---------------------------------------------------------------------------
def _labelled(spark, sf):
    rows = FP.finding_rows(_secret_findings(spark, sf), feature_table(spark, sf)).withColumn("finding_id", F.xxhash64("doc_id", "rule_id", "location", "detector"))
    return materialize(rows.withColumn("label", F.when(F.col("detector") == "pattern_library", 0).otherwise(1)), "labelled")


@query("stratified_split", "ML-6", """SELECT label, count(*) AS n, floor((count(*) - 1) * 0.8)::bigint + 1 AS n_train FROM (SELECT quality AS label FROM labels) GROUP BY label""")
def stratified_split(spark, sf):
    rows = D.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return FP.stratified_split(rows, "doc_id").groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_train").alias("n_train"))


@query("fp_classifier", "ML-6 ML-7 ML-11 AGG-19")
def fp_classifier(spark, sf):
    split = FP.stratified_split(_labelled(spark, sf), "finding_id")
    model = FP.train(split.where("is_train"))
    tested = FP.classify(model, split.where("NOT is_train")).select("finding_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), "false_positive_likelihood")
    return EV.classification_report(tested)


@query("fp_likelihoods", "ML-7 ML-8 ML-13 TOP-5 TOP-6")
def fp_likelihoods(spark, sf):
    rows = _labelled(spark, sf)
    path = shared_dir(spark, "fp-model")
    FP.save_model(FP.train(rows), path)
    model = FP.load_model(path)
    best = [(r["feature"], r["importance"]) for r in FP.top_model_features(spark, model).collect()]
    scored = FP.classify(model, rows)
    importances = FP.finding_importances(best, F.col("is_true_positive"), scored.columns)
    return scored.select("finding_id", F.round("false_positive_likelihood", 6).alias("false_positive_likelihood"), F.array_join(F.transform(importances, lambda x: x["feature"]), ",").alias("importances"))


@query("fp_grid_search", "ML-9")
def fp_grid_search(spark, sf):
    rows = _labelled(spark, sf).select("features", "label")
    found = FP.search(rows)
    return spark.createDataFrame([(i, float(m)) for i, m in enumerate(found.avgMetrics)], "setting int, mean_f1 double")


_FB = """(SELECT doc_id AS finding_id, toxic = 1 AS is_true_positive, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'xss' ELSE 'credential_leak' END AS finding_type FROM labels)"""


def _feedback(spark, sf):
    return D.table(spark, sf, "labels").select(F.col("doc_id").alias("finding_id"), (F.col("toxic") == 1).alias("is_true_positive"), F.expr("CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'xss' ELSE 'credential_leak' END").alias("finding_type"), F.col("doc_id").alias("timestamp"))


@query(
    "feedback_statistics",
    "AGG-21 ML-12",
    f"""SELECT coalesce(finding_type, 'unknown') AS finding_type, count(*) AS n_feedback, count_if(is_true_positive) AS true_positives, count_if(NOT is_true_positive) AS false_positives, round(count_if(is_true_positive) / count(*), 6) AS true_positive_rate, round(count_if(NOT is_true_positive) / count(*), 6) AS false_positive_rate
        FROM {_FB} WHERE finding_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) GROUP BY 1 UNION ALL SELECT NULL, count(*), count_if(is_true_positive), count_if(NOT is_true_positive), round(count_if(is_true_positive) / count(*), 6), round(count_if(NOT is_true_positive) / count(*), 6) FROM {_FB} WHERE finding_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)""",
)
def feedback_statistics(spark, sf):
    known = D.table(spark, sf, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("finding_id"))
    out = FP.feedback_statistics(FP.valid_feedback(_feedback(spark, sf), known))
    return out.withColumn("true_positive_rate", F.round("true_positive_rate", 6)).withColumn("false_positive_rate", F.round("false_positive_rate", 6))


@query(
    "model_performance",
    "AGG-22 JOIN-6",
    f"""WITH j AS (SELECT f.*, p FROM {_FB} f LEFT JOIN (SELECT doc_id, doc_id % 5 = 0 AS p FROM documents WHERE doc_id % 7 <> 0) ON doc_id = finding_id)
        SELECT count(*) AS feedback_count, round(count_if(p = is_true_positive) / count(*), 6) AS accuracy, round(count_if(p AND is_true_positive) / count_if(p IS NOT NULL AND is_true_positive), 6) AS true_positive_accuracy,
          round(count_if(NOT p AND NOT is_true_positive) / count_if(p IS NOT NULL AND NOT is_true_positive), 6) AS false_positive_accuracy, count_if(p = is_true_positive) AS correct_count, count_if(p IS NOT NULL AND is_true_positive) AS true_positive_total, count_if(p IS NOT NULL AND NOT is_true_positive) AS false_positive_total FROM j""",
)
def model_performance(spark, sf):
    classified = D.table(spark, sf, "documents").where("doc_id % 7 <> 0").select(F.col("doc_id").alias("finding_id"), (F.col("doc_id") % 5 == 0).alias("is_true_positive"))
    out = FP.model_performance(classified, _feedback(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) if "accuracy" in c else F.col(c) for c in out.columns])


@query("latest_feedback", "TOP-3", f"SELECT finding_id, is_true_positive, finding_type FROM {_FB} WHERE finding_type = 'xss' ORDER BY finding_id DESC LIMIT 25")
def latest_feedback(spark, sf):
    return _feedback(spark, sf).where("finding_type = 'xss'").orderBy(F.desc("timestamp")).limit(25).drop("timestamp")


@query("evaluation_sample", "TOP-7", "SELECT doc_id FROM documents ORDER BY md5(concat(doc_id, ':42')), doc_id LIMIT 100")
def evaluation_sample(spark, sf):
    # a hash order: the same sample on every run, kept as a top-k per task and merged
    return D.table(spark, sf, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42"))), "doc_id").limit(100)


# --- accuracy ----------------------------------------------------------------------------------
_ACTUAL_SQL = f"(SELECT doc_id AS case_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, rule_no, match_no) AS actual_no, finding_type AS type, description, evidence AS content, severity FROM {deduped_sql(_MD)})"
_TRUTH_SQL = """(SELECT doc_id AS case_id, 0 AS expected_no, 'credential_leak' AS type, 'High' AS severity, 'AKIA' AS pattern FROM documents WHERE doc_id % 13 = 3 UNION ALL SELECT doc_id, 1, 'credential', 'medium', NULL FROM documents WHERE doc_id % 13 = 3
   UNION ALL SELECT doc_id, 0, 'sensitive_data', 'low', NULL FROM documents WHERE doc_id % 13 IN (5, 7) UNION ALL SELECT doc_id, 1, 'sensitive_data', 'medium', 'internal ip' FROM documents WHERE doc_id % 13 = 5 UNION ALL SELECT doc_id, 0, 'llm_specific', 'moderate', NULL FROM documents WHERE doc_id % 13 = 9)"""
_PAIRS = """(SELECT a.case_id, actual_no, expected_no FROM a JOIN e USING (case_id) WHERE (contains(lower(a.type), lower(e.type)) OR contains(lower(a.description), lower(e.type))) AND (pattern IS NULL OR contains(lower(a.description || chr(10) || a.content), lower(pattern)))
   AND CASE WHEN lower(e.severity) IN ('high', 'critical', 'severe') THEN lower(a.severity) IN ('high', 'critical', 'severe') WHEN lower(e.severity) IN ('medium', 'moderate', 'warning') THEN lower(a.severity) IN ('medium', 'moderate', 'warning') ELSE lower(a.severity) IN ('low', 'info', 'informational') END)"""
# every finding fits at most one expectation here, so the greedy matching has a closed form
_COUNTS_SQL = f"""(WITH a AS {_ACTUAL_SQL}, e AS {_TRUTH_SQL}, p AS {_PAIRS}, m AS (SELECT case_id, count(DISTINCT expected_no) AS tp FROM p GROUP BY case_id)
   SELECT d.doc_id AS case_id, coalesce(tp, 0) AS tp, (SELECT count(*) FROM a WHERE a.case_id = d.doc_id) AS na, (SELECT count(*) FROM e WHERE e.case_id = d.doc_id) AS ne FROM documents d LEFT JOIN m ON m.case_id = d.doc_id)"""


def _accuracy_inputs(spark, sf):
    from ..functions.scale import row_numbers

    found = S.secret_findings(D.markdown(spark, sf)).select(F.col("doc_id").alias("case_id"), F.col("finding_type").alias("type"), "description", F.col("evidence").alias("content"), "severity", "start", "rule_no", "match_no")
    actual = row_numbers(found, ["case_id"], F.lit(0), [F.col("start"), F.col("rule_no"), F.col("match_no")], "actual_no")
    actual = materialize(actual.withColumns({"details": F.lit(None).cast("string"), "code": F.lit(None).cast("string")}), "actual")
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"))
    k = F.col("case_id") % 13
    item = lambda n, t, s, p: F.struct(F.lit(n).alias("expected_no"), F.lit(t).alias("type"), F.lit(s).alias("severity"), F.lit(p).cast("string").alias("pattern"))
    wanted = (
        F.when(k == 3, F.array(item(0, "credential_leak", "High", "AKIA"), item(1, "credential", "medium", None)))
        .when(k == 5, F.array(item(0, "sensitive_data", "low", None), item(1, "sensitive_data", "medium", "internal ip")))
        .when(k == 7, F.array(item(0, "sensitive_data", "low", None)))
        .when(k == 9, F.array(item(0, "llm_specific", "moderate", None)))
    )
    return docs, actual, docs.select("case_id", F.inline(wanted))


@query(
    "precision_recall",
    "AGG-17 JOIN-16 SRC-10",
    f"""WITH c AS {_COUNTS_SQL}, r AS (SELECT case_id, sum(tp)::bigint AS tp, sum(na - tp)::bigint AS fp, sum(ne - tp)::bigint AS fn FROM c GROUP BY ROLLUP (case_id)),
        s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM r)
        SELECT case_id, tp, fp, fn, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS f1 FROM s""",
)
def precision_recall(spark, sf):
    out = EV.precision_recall(EV.case_counts(*_accuracy_inputs(spark, sf)))
    return out.select("case_id", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "scenario_metrics",
    "AGG-18 SRC-10",
    f"""WITH c AS (SELECT *, na - tp AS fp, ne - tp AS fn, CASE case_id % 3 WHEN 0 THEN 'prompt_injection' WHEN 1 THEN 'credential_exposure' ELSE 'mixed' END AS scenario_type FROM {_COUNTS_SQL}),
        k AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p0, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r0 FROM c),
        g AS (SELECT scenario_type, sum(tp)::bigint AS tp, sum(fp)::bigint AS fp, sum(fn)::bigint AS fn, count_if(CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END >= 0.7) AS passed_tests, count(*) AS total_tests FROM k GROUP BY ROLLUP (scenario_type)),
        s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM g)
        SELECT scenario_type, tp, fp, fn, passed_tests, total_tests, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS f1, round(passed_tests / total_tests, 6) AS pass_rate FROM s""",
)
def scenario_metrics(spark, sf):
    counts = EV.case_counts(*_accuracy_inputs(spark, sf))
    counts = counts.withColumn("scenario_type", F.expr("CASE case_id % 3 WHEN 0 THEN 'prompt_injection' WHEN 1 THEN 'credential_exposure' ELSE 'mixed' END"))
    out = EV.scenario_metrics(counts)
    return out.select("scenario_type", "tp", "fp", "fn", "passed_tests", "total_tests", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "pass_rate")])


@query(
    "scenario_expectations",
    "SRC-10",
    """WITH x AS (SELECT doc_id AS case_id, CASE doc_id % 6 WHEN 0 THEN ['prompt_injection'] WHEN 1 THEN ['malicious_code'] WHEN 2 THEN ['structural_variation'] WHEN 3 THEN ['special_characters'] WHEN 4 THEN ['malicious_code', 'credential_exposure'] ELSE [] END AS s FROM documents WHERE doc_id % 13 NOT IN (3, 5)),
        y AS (SELECT case_id, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS expected_no FROM x)
        SELECT case_id, expected_no, CASE t WHEN 'structural_variation' THEN 'structural_issue' ELSE t END AS type, CASE t WHEN 'structural_variation' THEN 'medium' WHEN 'special_characters' THEN 'low' ELSE 'high' END AS severity, NULL AS pattern FROM y
        UNION ALL SELECT doc_id, 0, 'known', 'high', 'x' FROM documents WHERE doc_id % 13 IN (3, 5)""",
)
def scenario_expectations(spark, sf):
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"))
    scenario = F.expr("CASE case_id % 6 WHEN 0 THEN 'prompt_injection' WHEN 1 THEN 'malicious_code' WHEN 2 THEN 'structural_variation' WHEN 3 THEN 'special_characters' WHEN 4 THEN 'mixed' ELSE 'other' END")
    cases = docs.select("case_id", scenario.alias("scenario_type"), F.array(F.lit("malicious_code"), F.lit("structural_variation"), F.lit("credential_exposure")).alias("transformation_types"))
    truth = docs.where("case_id % 13 IN (3, 5)").select("case_id", F.lit(0).alias("expected_no"), F.lit("known").alias("type"), F.lit("high").alias("severity"), F.lit("x").alias("pattern"))
    return EV.expected_findings(cases, truth)


_SCORED = "(SELECT event_id, value / 500 AS score, event_type = 'error' OR event_id % 7 = 0 AS positive FROM events)"


def _scored(spark, sf):
    return D.table(spark, sf, "events").select("event_id", (F.col("value") / 500).alias("score"), ((F.col("event_type") == "error") | (F.col("event_id") % 7 == 0)).alias("positive"), "ts")


_CURVE = f"""(WITH g AS (SELECT score, count_if(positive) AS pos, count_if(NOT positive) AS neg FROM {_SCORED} GROUP BY score),
  r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC)) SELECT * FROM r)"""


@query("roc_curve", "AGG-20", f"SELECT score AS threshold, tp::bigint AS tp, fp::bigint AS fp, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM {_CURVE}")
def roc_curve(spark, sf):
    out = EV.curve(_scored(spark, sf))
    return out.select("threshold", "tp", "fp", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "precision")])


@query("curve_areas", "AGG-20 ML-11", f"SELECT round(sum(neg * (2 * tp - pos)) / 2 / any_value(p * n), 6) AS auc, round(sum(pos * tp / (tp + fp)) / any_value(p), 6) AS average_precision FROM {_CURVE}")
def curve_areas(spark, sf):
    return EV.curve_areas(EV.curve(_scored(spark, sf))).select(F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("average_precision"))


@query("confusion_matrix", "AGG-19", f"SELECT positive::int AS label, count_if(score <= 0.1) AS predicted_0, count_if(score > 0.1) AS predicted_1 FROM {_SCORED} GROUP BY 1")
def confusion_matrix(spark, sf):
    rows = _scored(spark, sf).select(F.col("positive").cast("int").alias("label"), (F.col("score") > 0.1).cast("int").alias("prediction"))
    return EV.confusion_matrix(rows)


@query(
    "classification_report",
    "AGG-19",
    f"""WITH r AS (SELECT positive::int AS y, (score > 0.1)::int AS x FROM {_SCORED}), c AS (SELECT k AS class, count_if(y = k AND x = k) AS tp, count_if(y <> k AND x = k) AS fp, count_if(y = k AND x <> k) AS fn, count_if(y = k) AS support FROM r, (VALUES (0), (1)) t(k) GROUP BY k)
        SELECT class, tp, fp, fn, support, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
)
def classification_report(spark, sf):
    rows = _scored(spark, sf).select(F.col("positive").cast("int").alias("label"), (F.col("score") > 0.1).cast("int").alias("prediction"))
    out = EV.classification_report(rows)
    return out.select("class", "tp", "fp", "fn", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "score_statistics",
    "AGG-10 AGG-11 ML-11",
    f"""SELECT count(*) AS num_samples, count_if(score > t) AS num_anomalies, round(count_if(score > t) / count(*), 6) AS anomaly_ratio, round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(median(score), 6) AS median, round(any_value(t), 6) AS threshold
        FROM {_SCORED}, (SELECT quantile_cont(score, 0.9) AS t FROM {_SCORED})""",
)
def score_statistics(spark, sf):
    scores = _scored(spark, sf)
    threshold = AN.contamination_threshold(scores, "score").scalar()
    out = EV.score_statistics(scores.withColumn("_t", threshold), "score", F.col("_t")).withColumn("threshold", threshold)
    return out.select(*[F.col(c) if c.startswith("num") else F.round(c, 6).alias(c) for c in out.columns])


@query(
    "performance_over_time",
    "AGG-23",
    f"""WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS batch, positive AS y, value / 500 > 0.1 AS x FROM (SELECT *, event_type = 'error' OR event_id % 7 = 0 AS positive FROM events)), g AS (SELECT batch, count(*) AS num_samples, count_if(y AND x) AS tp, count_if(NOT y AND x) AS fp, count_if(y AND NOT x) AS fn, count_if(y = x) AS ok FROM r GROUP BY batch)
        SELECT batch, num_samples, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(ok / num_samples, 6) AS accuracy FROM g""",
)
def performance_over_time(spark, sf):
    rows = _scored(spark, sf).select(F.date_format("ts", "yyyy-MM-dd").alias("batch"), F.col("positive").cast("int").alias("label"), (F.col("score") > 0.1).cast("int").alias("prediction"))
    out = EV.performance_over_time(rows, "batch")
    return out.select("batch", "num_samples", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])
