"""Stateful streams: whole rows over restarts, and state that goes away."""

import pytest
from pyspark.sql import functions as F

from docsentry.streaming import streams as ST


@pytest.fixture
def run(spark, tmp_path):
    """A function that adds rows to a folder and runs a stream over what is new in it; gives all output so far."""

    def push(rows, schema, build):
        folder, root = str(tmp_path / "in"), str(tmp_path)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        kinds = ", ".join(f"{n} {t}" for n, t in spark.createDataFrame(rows, schema).dtypes)
        with ST.rocksdb(spark):
            out = ST.run_available(build(ST.file_stream(spark, folder, "*.parquet", kinds)), "test", root=root)
        return sorted(map(tuple, out.collect()), key=str)

    push.checkpoint = str(tmp_path / "state")
    return push


def seconds(df, *names):
    return df.withColumns({n: F.timestamp_seconds(n) for n in names})


def test_versions_over_restarts(spark, run):
    build = lambda s: ST.track_versions(seconds(s, "ts")).select("url", "content_hash", "doc_id", "version_number")
    schema = "url string, ts long, doc_id long, content_hash string"
    assert run([("u", 2, 2, "B"), ("u", 1, 1, "A"), ("u", 3, 3, "A")], schema, build) == [("u", "A", 1, 1), ("u", "B", 2, 2)]
    got = run([("u", 4, 4, "A"), ("u", 5, 5, "C"), ("v", 6, 6, "A"), (None, 7, 7, "A")], schema, build)
    assert got == sorted([("u", "A", 1, 1), ("u", "B", 2, 2), ("u", "C", 5, 3), ("v", "A", 6, 1), (None, "A", 7, 1)], key=str)
    latest = {r["key"][0]: r["value"][0] for r in ST.state_rows(spark, run.checkpoint, "latest", 0).collect()}
    assert latest == {"u": 3, "v": 1, None: 1}


def test_resolved_alerts_leave_no_state(spark, run):
    build = lambda s: ST.alert_lifecycle(seconds(s, "timestamp")).select("alert_id", "action", F.unix_timestamp("created_at"), F.unix_timestamp("updated_at"), "n_breaches", "message")
    schema = "alert_id string, timestamp long, breached boolean, message string"
    run([("a", 1, True, "m1"), ("a", 2, True, "m2"), ("b", 1, True, "x"), ("c", 1, False, "y")], schema, build)
    held = lambda: {r["key"][0]: r["value"][1] for r in ST.state_rows(spark, run.checkpoint, "alert").collect()}
    assert held() == {"a": 2, "b": 1}
    got = run([("a", 3, False, "m3"), ("a", 4, False, "m4"), ("b", 5, True, "x5")], schema, build)
    assert got == sorted([("a", "opened", 1, 1, 1, "m1"), ("a", "updated", 1, 2, 2, "m2"), ("a", "resolved", 1, 3, 2, "m3"), ("b", "opened", 1, 1, 1, "x"), ("b", "updated", 1, 5, 2, "x5")], key=str)
    assert held() == {"b": 2}


def test_throttle_forgets_after_the_interval(spark, run):
    build = lambda s: ST.throttled(seconds(s, "created_at"), 100, "10 seconds").select("alert_id", F.unix_timestamp("created_at"))
    schema = "alert_id string, created_at long"
    run([("a", 1000), ("a", 1099), ("a", 1100), ("a", 1150), ("b", 1020), ("b", 1020)], schema, build)
    held = lambda: {r["key"][0] for r in ST.state_rows(spark, run.checkpoint, "last").collect()}
    assert held() == {"a"}  # the watermark is at 1140: b, last sent at 1020, may go out whenever it comes
    got = run([("a", 1199), ("a", 1201), ("b", 2000)], schema, build)
    assert got == [("a", 1000), ("a", 1100), ("a", 1201), ("b", 1020), ("b", 2000)]
    assert held() == {"b"}


def test_latest_evaluation_of_an_interval(spark, run):
    build = lambda s: ST.latest_evaluations(seconds(s, "timestamp"), "1 minute", "0 seconds").select("alert_id", F.unix_timestamp("timestamp"), "breached", "message")
    schema = "alert_id string, timestamp long, breached boolean, message string"
    got = run([("a", 1, True, "m1"), ("a", 50, False, "m2"), ("a", 50, True, "m3"), ("a", 70, False, "m4"), ("b", 3, False, "x"), ("b", 600, False, "end")], schema, build)
    assert got == [("a", 50, True, "m3"), ("a", 70, False, "m4"), ("b", 3, False, "x")]


def test_versions_of_times_that_pandas_cannot_hold(spark, run):
    """Nanoseconds in 64 bits end in the year 2262; times are kept to the microsecond, and null ones come last."""
    ts = F.timestamp_micros(F.col("seconds") * 1000000 + 1).alias("ts")
    build = lambda s: ST.track_versions(s.select("url", "content_hash", "doc_id", ts)).select("url", "content_hash", F.unix_micros("ts"), "doc_id", "version_number")
    got = run([("u", "b", 8, 200_000 * 86400), ("u", "a", 7, 3_000_000 * 86400), ("u", "b", 9, 300_000 * 86400), ("u", "c", 6, None), ("u", "d", 5, 0)], "url string, content_hash string, doc_id long, seconds long", build)
    assert got == [("u", "a", 3_000_000 * 86400 * 10**6 + 1, 7, 3), ("u", "b", 200_000 * 86400 * 10**6 + 1, 8, 2), ("u", "c", None, 6, 4), ("u", "d", 1, 5, 1)]


def test_provider_setting_comes_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with ST.rocksdb(spark):
        assert spark.conf.get(name) == ST.ROCKSDB
    assert spark.conf.get(name) == before


def test_tables_of_many_files_are_streamed_whole(spark, tmp_path):
    import duckdb

    from docsentry.plans import catalogue

    docs = spark.createDataFrame([(i, f"text {i * 7 % 60}", "en", f"src{i % 2}", 7) for i in range(240)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(120, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalogue.QUERIES["stream_versions"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(catalogue.ORACLES["stream_versions"]).fetchall()) and len(got) == 60
