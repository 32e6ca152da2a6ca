"""Files in, tables out."""

import os

from pyspark.sql import functions as F

from docsentry.operators import false_positives as FP
from docsentry.operators import parse as P
from docsentry.operators.responses import similarity
from docsentry.sinks import tables as T
from docsentry.sources import corpus as SC
from docsentry.streaming import streams as ST


def test_files_with_any_encoding(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("é ok".encode())
    (tmp_path / "b.md").write_bytes("é latin".encode("latin-1"))
    rows = {os.path.basename(r["source"]): r["text"] for r in SC.read_binary_files(spark, str(tmp_path)).collect()}
    assert rows == {"a.md": "é ok", "b.md": "é latin"}
    assert SC.read_text_files(spark, f"file://{tmp_path}/a.md").first()["text"] == "é ok"


def test_append_content_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "a"), ("u", "a")], "url string, text string")
    T.append_content(docs, None, path, F.lit("2024-01-01"))
    stored = spark.read.parquet(path)
    assert stored.count() == 3
    more = docs.unionByName(spark.createDataFrame([("v", "new")], "url string, text string"))
    fresh = T.rows_to_store(more, stored)
    assert [(r["url"], r["text"]) for r in fresh.collect()] == [("v", "new")]
    T.append_content(more, spark.read.parquet(path).select("url", "content_hash"), path, F.lit("2024-01-02"))
    assert spark.read.parquet(path).groupBy("ingest_date").count().count() == 2 and spark.read.parquet(path).count() == 4


def test_child_rows_and_latest(spark):
    docs = spark.createDataFrame([(1, "u", "[a](x) [b](y) [^1]\n```py\nk\n```"), (2, "u", "[c](z)")], "doc_id int, url string, text string")
    parsed = P.parse(docs)
    items = T.extracted_item_rows(parsed)
    assert sorted((r["doc_id"], r["item_type"], r["target_value"]) for r in items.collect()) == [(1, "reference", "1"), (1, "url", "x"), (1, "url", "y"), (2, "url", "z")]
    latest = T.latest_parsed(docs.select("url", "doc_id", F.col("doc_id").alias("parsed_at")), P.code_blocks(docs), items).first()
    assert latest["doc_id"] == 2 and latest["urls"] == ["z"] and latest["code_blocks"] is None


def test_csv_report(spark, tmp_path):
    T.write_csv_report(spark.createDataFrame([("f", 1)], "case_id string, tp int"), str(tmp_path / "r"), single_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first()["tp"] == "1"


def test_registry_upsert_and_retention(spark):
    old = spark.createDataFrame([("m", "1", 0.1, 1), ("m", "2", 0.2, 1)], "name string, version string, threshold double, updated_at int")
    new = spark.createDataFrame([("m", "1", 0.9, 2)], "name string, version string, threshold double, updated_at int")
    assert sorted((r["version"], r["threshold"]) for r in T.upsert_latest(old, new, ["name", "version"]).collect()) == [("1", 0.9), ("2", 0.2)]


def test_model_roundtrip(spark, tmp_path):
    rows = spark.range(60).select(F.array(F.col("id").cast("double"), (F.col("id") % 3).cast("double")).alias("features"), (F.col("id") > 30).cast("int").alias("label"))
    model = FP.train(rows, n_trees=5, max_depth=3)
    FP.save_model(model, str(tmp_path / "model"))
    again = FP.load_model(str(tmp_path / "model"))
    row = FP.model_metadata(spark, "fp", "1", "false_positive_classifier", "random_forest", str(tmp_path / "model"), parameters={"n": 5}, performance={"f1": 1}).first()
    assert row["parameters"] == {"n": "5"} and row["performance"] == {"f1": 1.0}
    assert FP.classify(again, rows).where(F.col("is_true_positive") == (F.col("label") == 1)).count() >= 58
    assert FP.top_model_features(spark, again, ["a", "b"]).first()["feature"] == "a"


def test_similarity_of_word_sets(spark):
    df = spark.createDataFrame([("Hello World ", "hello there"), ("", ""), ("a", None), ("b a a", "A b")], "a string, b string")
    got = [r["s"] for r in df.select(similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [0.5, 1.0, None, 1.0]


def test_forest_finds_the_far_points(spark, tmp_path):
    from docsentry.operators import anomaly as AN

    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.array((F.col("id") % 20).cast("double"), (F.col("id") % 7).cast("double")).alias("features"))
    far = spark.createDataFrame([(1000 + i, [500.0 + i, -300.0]) for i in range(4)], "doc_id long, features array<double>")
    points = rows.unionByName(far)
    AN.save_forest(AN.fit_forest(points, n_trees=40, sample_size=64), str(tmp_path / "forest"))
    forest = AN.load_forest(spark, str(tmp_path / "forest"))
    assert forest.n_trees == 40 and forest.sample_size == 64
    top = AN.forest_scores(points, forest).orderBy(F.desc("raw_score")).limit(4).collect()
    assert {r["doc_id"] for r in top} == {1000, 1001, 1002, 1003}
    again = AN.forest_scores(points, forest).orderBy(F.desc("raw_score")).limit(4).collect()
    assert [r["raw_score"] for r in top] == [r["raw_score"] for r in again]
