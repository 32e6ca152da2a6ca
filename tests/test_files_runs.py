"""File sources in any encoding, and sinks that commit once."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docsentry.operators import findings as FD
from docsentry.operators import versions as V
from docsentry.sinks import runs as RU
from docsentry.sources import files as FI
from docsentry.streaming import streams as ST

TEXTS = {
    "utf8": ("naïve 漢字 😀\n", "utf-8", "UTF-8"), "bom": ("mark", "utf-8-sig", "UTF-8"), "le": ("wide text, é", "utf-16-le", "UTF-16LE"), "be": ("wide text 漢", "utf-16-be", "UTF-16BE"),
    "le_mark": ("漢字漢字", "utf-16", "UTF-16LE"), "u32": ("four bytes 😀", "utf-32", "UTF-32LE"), "latin": ("caf\xe9 and more", "latin-1", "ISO-8859-1"), "cp": ("“quoted” – 5 €", "cp1252", "windows-1252"),
    "pairs": ("a b😁" * 40, "utf-16-le", "UTF-16LE"), "long": ("é line\n" * 60_000, "utf-16-be", "UTF-16BE"),
}


def _write(folder):
    for name, (text, codec, _) in TEXTS.items():
        (folder / f"{name}.md").write_bytes(text.encode(codec))


def test_every_encoding_is_found_and_read(spark, tmp_path):
    _write(tmp_path)
    got = {r["file_name"][:-3]: r for r in FI.decoded(FI.scan(spark, str(tmp_path), "*.md")).collect()}
    assert {n: (r["text"], r["encoding"]) for n, r in got.items()} == {n: (t, e) for n, (t, _, e) in TEXTS.items()}
    assert all(got[n]["n_bytes"] == os.path.getsize(tmp_path / f"{n}.md") and got[n]["modified"] is not None for n in TEXTS)
    one = FI.file_items(FI.scan(spark, str(tmp_path / "cp.md"))).first()
    assert one["content"] == "“quoted” – 5 €" and one["metadata"]["retrieval_method"] == "local_file"


def test_damaged_bytes_still_have_a_reading(spark):
    rows = [(1, b"a\x00b\x00\x05\xd8c\x00d\x00"), (2, b"ok \xff\x81"), (3, None), (4, bytes(range(256)))]
    got = {r["id"]: (r["encoding"], r["text"]) for r in FI.decoded(spark.createDataFrame(rows, "id int, content binary")).collect()}
    assert got[1] == ("UTF-16LE", rows[0][1].decode("utf-16-le", "replace")) and got[2] == ("ISO-8859-1", "ok \xff\x81")
    assert got[3] == (None, None) and got[4] == ("ISO-8859-1", bytes(range(256)).decode("latin-1"))


def test_files_as_a_stream(spark, tmp_path):
    _write(tmp_path)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.md").write_bytes(b"deep")
    rows = ST.run_available(FI.decoded(FI.stream(spark, str(tmp_path), "*.md", files_per_batch=3)).select("file_name", "encoding", "text"), "files")
    got = {(r["file_name"][:-3], r["text"]) for r in rows.collect()}
    assert got == {(n, t) for n, (t, _, _) in TEXTS.items()} | {("deep", "deep")}


def test_a_run_commits_once(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert RU.read(spark, root, "t", rows.schema).count() == 0
    assert RU.write({"t": rows}, root, "r1") and not RU.write({"t": rows}, root, "r1")
    assert RU.write({"t": rows.limit(0)}, root, "r2")
    assert sorted((r["id"], r["v"], r["run_id"]) for r in RU.read(spark, root, "t", rows.schema).collect()) == [(1, "a", "r1"), (2, None, "r1")]
    assert RU.run_counts(spark, root).collect() == [("t", 2, 2)]


def test_a_failed_run_shows_nothing_and_is_replaced(spark, tmp_path):
    root = str(tmp_path)
    good = spark.range(3).select(F.col("id"))
    bad = spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        RU.write({"first": good, "second": bad}, root, "r")
    assert RU.read(spark, root, "first", good.schema).count() == 0
    assert RU.write({"first": good.limit(2), "second": good}, root, "r")
    assert RU.read(spark, root, "first", good.schema).count() == 2 and RU.read(spark, root, "second", good.schema).count() == 3


def test_content_is_stored_once_over_runs(spark, tmp_path):
    root = str(tmp_path)
    docs = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "a"), ("v", "a")], "url string, text string")
    more = docs.unionByName(spark.createDataFrame([("w", "new")], "url string, text string"))
    for run_id, rows in (("1", docs), ("1", docs), ("2", more), ("3", more)):
        RU.store_content(rows, root, run_id, F.lit("2024-01-01"))
    stored = RU.read(spark, root, "content", RU.content_schema(docs))
    assert sorted((r["url"], r["text"], r["run_id"]) for r in stored.collect()) == [("u", "a", "1"), ("u", "b", "1"), ("v", "a", "1"), ("w", "new", "2")]


def test_csv_runs_keep_nulls_and_breaks(spark, tmp_path):
    rows = spark.createDataFrame([("a,b\n\"c\"", 1.5, None), (None, None, ""), ("", 0.0, "x")], "name string, score double, note string")
    for _ in range(2):
        RU.write({"report": rows}, str(tmp_path), "r", "csv")
    assert {tuple(r)[:3] for r in RU.read(spark, str(tmp_path), "report", rows.schema, "csv").collect()} == {tuple(r) for r in rows.collect()}


def test_rollup_of_all_urls(spark):
    results = spark.createDataFrame([("u", True), ("v", False)], "url string, changes_detected boolean")
    suspicious = spark.createDataFrame([("u", 2, 0, "addition", 0.5), ("u", 3, 1, "deletion", 0.4), ("zz", 2, 0, "addition", 0.9)], "url string, version_number int, change_seq int, change_type string, suspicion_score double")
    gradual = spark.createDataFrame([("v", "1:2", 2, 4, 3)], "url string, location string, start_version int, end_version int, change_count int")
    got = {r["kind"]: r for r in V.temporal_rollup(results, suspicious, gradual).collect()}
    assert set(got) == {"summary", "suspicious_changes", "gradual_modifications"} and all(r["has_changes"] for r in got.values())
    assert len(got["suspicious_changes"]["items"]) == 2 and len(got["gradual_modifications"]["items"]) == 1
    none = V.temporal_rollup(results.limit(0), suspicious.limit(0), gradual.limit(0)).collect()
    assert [(r["kind"], r["has_changes"]) for r in none] == [("summary", False)]


def test_processed_content_limit_counts_joined_rows(spark):
    processed = spark.range(50).selectExpr("id AS processed_id", "id % 5 AS url_id")
    urls = spark.createDataFrame([(0, "a"), (1, "b")], "id long, url string")
    got = FD.processed_content(processed, urls, limit=5).collect()
    assert sorted(r["processed_id"] for r in got) == [0, 1, 5, 6, 10] and {r["url"] for r in got} == {"a", "b"}
    assert FD.processed_content(processed, urls.limit(0)).count() == 0 and isinstance(processed.schema, StructType)


def test_every_row_becomes_a_file(spark, tmp_path):
    rows = [(1, b"a"), (1, b"b"), (2, b"\x00\xff"), (None, b"n"), (-3, b"")]
    df = spark.createDataFrame(rows, "doc_id int, raw binary")
    for _ in range(2):  # a second try replaces the files of the first
        FI.write_documents(df, f"{tmp_path}/out", "doc_id", "raw", "\n\0")
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    with FI.many_files(spark):
        assert spark.conf.get(name) != before
        got = FI.scan(spark, f"{tmp_path}/out", "*.txt").select("source", "content").collect()
    assert spark.conf.get(name) == before
    folders = sorted((r["source"].split("/")[-2], bytes(r["content"])) for r in got)
    assert folders == sorted([(f"doc_id={'__HIVE_DEFAULT_PARTITION__' if k is None else k}", v + b"\n\0") for k, v in rows])


def test_files_are_written_and_read_in_bounded_slices(spark, tmp_path, monkeypatch):
    """Listings and streams hold the names of one slice at a time."""
    import duckdb

    from docsentry.plans import catalogue

    rows = [(i % 90 if i != 7 else None, None if i == 9 else f"text {i}".encode()) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, raw binary")
    for _ in range(2):  # a second try replaces the files of the first
        slices = FI.write_slices(df, f"{tmp_path}/out", "doc_id", "raw", rows_per_task=10, tasks_per_slice=2, per_folder=3)
    found = [FI.scan(spark, s, "*.txt").select("file_name", "content").collect() for s in slices]
    assert len(slices) == 5 and all(0 < len(f) < 60 for f in found)
    files = [r for f in found for r in f]
    # Spark lists no files without bytes: the one of null bytes is not among them
    assert sorted((r["file_name"].split(".")[0], bytes(r["content"])) for r in files) == sorted((f"doc_id={'__HIVE_DEFAULT_PARTITION__' if k is None else k}", v) for k, v in rows if v)

    docs = [(i, None if i == 3 else f"text \u00e9\n{i}" if i % 2 else f"\U0001f600 some words of a text {i}", "en", "s", 1) for i in range(-20, 60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    write, streamed, scanned = FI.write_slices, [], []
    monkeypatch.setattr(FI, "write_slices", lambda *a: write(*a, tasks_per_slice=4))
    stream, scan = FI.stream, FI.scan
    monkeypatch.setattr(FI, "stream", lambda spark, path, *a, **k: streamed.append(path) or stream(spark, path, *a, **k))
    monkeypatch.setattr(FI, "scan", lambda spark, path, *a, **k: scanned.append(path) or scan(spark, path, *a, **k))
    for query in ("file_round_trip", "stream_file_items"):
        got = sorted(map(tuple, catalogue.QUERIES[query](spark, str(tmp_path)).collect()))
        assert got == sorted(con.execute(catalogue.ORACLES[query]).fetchall()) and len(got) == 79
    assert len(set(streamed)) == len(streamed) == len(scanned) == len(set(scanned)) >= 1


def test_micro_batches_by_size(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"f{i}.md").write_bytes(b"x" * 100)
    rows = ST.run_available(FI.stream(spark, str(tmp_path), "*.md", bytes_per_batch=1000).select("file_name", "n_bytes"), "sized")
    assert sorted(r["file_name"] for r in rows.collect()) == sorted(f"f{i}.md" for i in range(30))
