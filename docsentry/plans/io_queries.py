"""Queries that write files and tables and read them back."""

from pyspark.sql import functions as F

from ..operators import anomaly as AN
from ..session import materialize, shared_dir
from ..sinks import runs as RU
from ..sinks import tables as T
from ..sources import files as FI
from ..streaming import streams as ST
from . import derived as D
from .ml_queries import precision_recall
from .registry import ORACLES, query

_NARROW = "NOT regexp_matches(text, '[^\\x00-\\xff]')"
#: What the bytes of a written text show: texts of ASCII alone look the same in two of the encodings.
_FOUND = f"CASE WHEN doc_id % 3 = 1 THEN 'UTF-16LE' WHEN doc_id % 3 = 2 AND {_NARROW} AND regexp_matches(text, '[\\x80-\\xff]') THEN 'ISO-8859-1' ELSE 'UTF-8' END"
_BYTES = f"CASE {_FOUND} WHEN 'UTF-16LE' THEN 2 * length(text) + 2 * len(regexp_extract_all(text, '[^\\x00-\\x{{ffff}}]')) + 2 WHEN 'ISO-8859-1' THEN length(text) + 1 ELSE strlen(text) + 1 END"


def written_files(spark, sf):
    """Folders with every text of ``documents`` as a file in one of them, in three encodings by doc_id."""
    docs = D.documents(spark, sf, "doc_id", "text").where("text IS NOT NULL")
    narrow = ~F.col("text").rlike("[^\\x00-\\xff]")
    encoding = F.when(F.col("doc_id") % 3 == 1, "UTF-16LE").when((F.col("doc_id") % 3 == 2) & narrow, "ISO-8859-1").otherwise("UTF-8")
    root = shared_dir(spark, "files")
    ends = {"UTF-8": "\n", "UTF-16LE": "\n\0", "ISO-8859-1": "\n"}
    if FI.is_shared_folder(spark, root):
        raw = F.coalesce(*[F.when(encoding == name, F.concat(F.encode("text", name), F.lit(end.encode()))) for name, end in ends.items()])
        return FI.write_slices(docs.select("doc_id", raw.alias("raw")), f"{root}/slices", "doc_id", "raw")
    for name, end in ends.items():
        rows = docs.where(encoding == name).select("doc_id", F.encode("text", name).alias("raw"))
        FI.write_documents(rows, f"{root}/{name}", "doc_id", "raw", end)
    return [root]


def _doc_id(source):
    return F.regexp_extract(source, r"doc_id=(-?\d+)[./]", 1).cast("long")


@query("file_round_trip", "SRC-3 SRC-4", f"SELECT doc_id, {_FOUND} AS encoding, CAST({_BYTES} AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL")
def file_round_trip(spark, sf):
    out, schema = shared_dir(spark, "file-texts"), "doc_id long, encoding string, n_bytes long, text_md5 string"
    with FI.many_files(spark):
        for folder in written_files(spark, sf):
            files = FI.decoded(FI.scan(spark, folder, "*.txt"))
            text = F.regexp_replace("text", "\\n\\z", "")
            rows = files.select(_doc_id(F.col("source")).alias("doc_id"), "encoding", "n_bytes", F.md5(text).alias("text_md5"))
            rows.write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


@query("stream_file_items", "SRC-3 SRC-4 SRC-5", "SELECT doc_id, 'local_file' AS method, md5(text) AS content_md5 FROM documents WHERE text IS NOT NULL")
def stream_file_items(spark, sf):
    out, schema = shared_dir(spark, "file-items"), "doc_id long, method string, content_md5 string"
    with FI.many_files(spark):
        for folder in written_files(spark, sf):
            # a stream remembers the files it has seen: one for each folder
            items = FI.file_items(FI.stream(spark, folder, "*.txt", bytes_per_batch=256 * 1024 * 1024))
            content = F.md5(F.regexp_replace("content", "\\n\\z", ""))
            rows = items.select(_doc_id(F.col("source")).alias("doc_id"), F.col("metadata.retrieval_method").alias("method"), content.alias("content_md5"))
            ST.run_available(rows, "file-items-slice").write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


@query(
    "stored_content_twice",
    "SNK-1",
    "SELECT concat('https://', source, '.example.com') AS url, sha256(text) AS content_hash, min(CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END) AS run_id FROM documents GROUP BY 1, 2",
)
def stored_content_twice(spark, sf):
    root = shared_dir(spark, "content-store")
    docs = D.documents(spark, sf, "doc_id", "source", "text")
    incoming = docs.select(F.expr("concat('https://', source, '.example.com')").alias("url"), "text", "doc_id")
    half = incoming.where("doc_id % 2 = 0").drop("doc_id")
    everything = incoming.drop("doc_id")
    # the first run is tried again, and the second brings all that the first has stored
    for run_id, rows in (("first", half), ("first", half), ("second", everything), ("second", everything), ("third", half)):
        RU.store_content(rows, root, run_id, F.lit("2024-01-01"))
    return RU.read(spark, root, "content", RU.content_schema(half)).select("url", "content_hash", "run_id")


_RESULTS = """(SELECT doc_id AS content_id, least(length(text) / 20000.0, 1.0) AS anomaly_score, length(text) > 6000 AS is_anomaly, position('password' IN lower(text)) > 0 AS is_outlier FROM documents)"""


@query(
    "anomaly_results_stored",
    "SNK-5",
    f"""WITH r AS (SELECT content_id, is_anomaly OR is_outlier AS is_anomalous, round(anomaly_score * 0.7 + CASE WHEN is_outlier THEN 0.8 ELSE 0.0 END * 0.3, 6) AS score FROM {_RESULTS})
        SELECT 'results' AS kind, content_id, score, CAST(NULL AS VARCHAR) AS finding_type FROM r UNION ALL SELECT 'findings', content_id, score, 'ml_anomaly_detection' FROM r WHERE is_anomalous""",
)
def anomaly_results_stored(spark, sf):
    from ..operators.scoring import classify

    docs = D.documents(spark, sf, "doc_id", "text")
    long_text = F.length("text")
    feature = F.array(F.struct(F.lit("text_length").alias("feature"), long_text.cast("double").alias("value"), F.lit(0.5).alias("contribution")))
    detected = docs.select("doc_id", F.least(long_text / 20000.0, F.lit(1.0)).alias("anomaly_score"), (long_text > 6000).alias("is_anomaly"), F.lit(0.5).alias("anomaly_confidence"), feature.alias("contributing_features"))
    flag = F.contains(F.lower("text"), F.lit("password"))
    factor = F.array(F.struct(F.lit("credential_word").alias("factor"), F.lit(1.0).alias("value"), F.lit(0.8).alias("severity")))
    outliers = docs.select("doc_id", flag.alias("is_outlier"), F.when(flag, 0.8).otherwise(0.0).alias("outlier_score"), F.lit(0.5).alias("outlier_confidence"), F.filter(factor, lambda _: flag).alias("outlier_factors"))
    results = AN.combine(detected, outliers).withColumn("url_id", F.col("content_id"))
    found = T.anomaly_findings(results, classify(F.col("combined_score")))
    root = shared_dir(spark, "anomaly-results")
    for run_id in ("monday", "monday", "monday"):  # one run and two repeats of it
        RU.write({"results": results, "findings": found}, root, run_id)
    stored = RU.read(spark, root, "results", results.schema)
    findings = RU.read(spark, root, "findings", found.schema)
    score = F.get_json_object("evidence", "$.anomaly_score").cast("double")
    rows = stored.select(F.lit("results").alias("kind"), "content_id", F.round("combined_score", 6).alias("score"), F.lit(None).cast("string").alias("finding_type"))
    return rows.unionByName(findings.select(F.lit("findings").alias("kind"), "content_id", F.round(score, 6).alias("score"), "finding_type"))


@query(
    "feedback_log",
    "SNK-8",
    """SELECT 'feedback' AS table_name, count_if(event_type = 'click') AS n_rows, 2 AS n_runs FROM events UNION ALL SELECT 'performance', 2, 2
       UNION ALL SELECT 'rows', count_if(event_type = 'click') + 2, NULL FROM events""",
)
def feedback_log(spark, sf):
    root = shared_dir(spark, "logs")
    events = D.table(spark, sf, "events").where("event_type = 'click'")
    feedback = events.select(F.col("event_id").alias("finding_id"), (F.col("value") > 50).alias("is_true_positive"), F.col("user_id").cast("string").alias("user"))
    schema = None
    for run_id, part in (("even", feedback.where("finding_id % 2 = 0")), ("odd", feedback.where("finding_id % 2 = 1")), ("even", feedback)):
        performance = part.agg(F.lit("accuracy").alias("metric_name"), F.avg(F.col("is_true_positive").cast("double")).alias("metric_value"))
        RU.write({"feedback": part, "performance": performance}, root, run_id)
        schema = performance.schema
    n = RU.read(spark, root, "feedback", feedback.schema).select("run_id").unionByName(RU.read(spark, root, "performance", schema).select("run_id"))
    return RU.run_counts(spark, root).unionByName(n.agg(F.lit("rows").alias("table_name"), F.count("*").alias("n_rows"), F.lit(None).cast("long").alias("n_runs")))


@query("accuracy_report_csv", "SNK-12 AGG-17", ORACLES["precision_recall"])
def accuracy_report_csv(spark, sf):
    root = shared_dir(spark, "accuracy-report")
    report = materialize(precision_recall(spark, sf), "accuracy-rows")  # two tries of a run write the same report
    for run_id in ("run-1", "run-1"):
        RU.write({"report": report}, root, run_id, "csv")
    return RU.read(spark, root, "report", report.schema, "csv").drop("run_id")
