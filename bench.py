"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion through the ``noop`` sink, so every row and
column is computed and nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pii_findings_by_type",
    "secret_findings",
    "markdown_report",
    "page_xss",
    "all_findings_by_detector",
    "code_findings",
    "link_checks",
    "signature_findings",
    "risk_assessment",
    "version_numbers",
    "line_changes",
    "risk_trends",
    "risk_anomalies",
    "feature_vectors",
    "rule_outliers",
    "response_findings",
    "precision_recall",
    "roc_curve",
    "alert_lifecycle",
    "stream_metric_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from docsentry.plans import catalogue
    from docsentry.session import get_session

    spark = get_session("docsentry-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # JVM, parquet reader and shuffle start-up stay outside the timings
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("lang", "length(text) AS n").groupBy("lang").sum("n").collect()
    times = {}
    for name in names:
        start = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "documents": n_docs,
                "documents_per_sec_all_detectors": round(n_docs / times["all_findings_by_detector"], 1) if times.get("all_findings_by_detector") else None,
            }
        )
    )


if __name__ == "__main__":
    main()
