"""Structured Streaming forms of the monitor loop: metric windows, alerts, throttled notifications, version tracking."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import alerts as A
from ..session import shared_dir

# executors need no copy of this package: the state processors travel with the query
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_TIME = 2**63 - 1


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB; the session's own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: str, max_files: int | None = 100) -> DataFrame:
    """Parquet files ``pattern`` of a folder as a stream, or those of the folder of that name in it; new files become new micro-batches.

    Without ``max_files``, all files that are there make one micro-batch.
    """
    table = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    whole = table.getFileSystem(spark._jsc.hadoopConfiguration()).isDirectory(table)
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader
    return reader.parquet(f"{folder}/{pattern}") if whole else reader.option("pathGlobFilter", pattern).parquet(folder)


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The events table as a stream; its zoneless timestamps are cast before any watermark."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return file_stream(spark, folder, pattern, schema).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_metrics(events: DataFrame, length: str = "5 minutes", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Windowed count, sum and maximum per metric; rows later than the watermark are dropped.

    State is one row per open window and metric name, however many events arrive.
    """
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = events.withWatermark("ts", lateness).groupBy(window.alias("w"), F.col("event_type").alias("metric_name"))
    out = grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("maximum"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "metric_name", "n", "total", "maximum")


def trailing_counts(events: DataFrame, length: str = "24 hours", slide: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts per metric over trailing windows, from the counts of their slides.

    An event is counted once, in its slide; only the slides' counts, one row per
    metric each, go into the windows that hold them.
    """
    slides = events.withWatermark("ts", lateness).groupBy(F.window("ts", slide).alias("s"), F.col("event_type").alias("metric_name")).agg(F.count("*").alias("_n"))
    timed = slides.select(F.window_time("s").alias("_at"), "metric_name", "_n")
    out = timed.groupBy(F.window("_at", length, slide).alias("w"), "metric_name").agg(F.sum("_n").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "metric_name", "n")


def sessions(turns: DataFrame, key: str = "user_id", gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Interaction sessions closed by inactivity."""
    grouped = turns.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), F.col(key))
    return grouped.agg(F.count("*").alias("interaction_count")).select(
        F.col(key), F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "interaction_count"
    )


class ThrottleState(StatefulProcessor):
    """Remembers when each alert was last sent, until an alert may go out again whatever the memory says.

    An event-time timer at the end of the interval removes the memory: from
    then on a missing one and an old one mean the same.
    """

    def __init__(self, seconds: float) -> None:
        self.millis = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "sent_at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        interval = self.millis * 1000
        before = self.last.get()[0] if self.last.exists() else None
        last, sent = before, []
        times = np.sort(np.concatenate([r["created_at"].to_numpy(dtype="datetime64[us]").astype(np.int64) for r in rows]))
        while len(times):
            after = 0 if last is None else int(np.searchsorted(times, last + interval))
            if after == len(times):
                break
            last = int(times[after])
            sent.append((key[0], pd.Timestamp(last, unit="us")))
            times = times[after + 1 :]
        if sent:
            if before is not None:
                self.handle.deleteTimer(_ends(before, self.millis))
            self.last.update((last,))
            self.handle.registerTimer(_ends(last, self.millis))
            yield pd.DataFrame(sent, columns=["alert_id", "created_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and _ends(self.last.get()[0], self.millis) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield pd.DataFrame({"alert_id": pd.Series(dtype=object), "created_at": pd.Series(dtype="datetime64[us]")})

    def close(self) -> None:
        pass


def _ends(micros: int, millis: int) -> int:
    return -(-micros // 1000) + millis


def throttled(alerts: DataFrame, seconds: float = 3600, lateness: str = "10 minutes") -> DataFrame:
    """(alert_id, created_at) of the notifications to send: the first of an alert, then each first one an interval or more after the last sent.

    Equal times of an alert collapse before they are shuffled to its key; of a
    micro-batch, a key then has eight bytes per time. The only state is one time
    per alert that was sent within the last interval, by the watermark (needs
    the RocksDB state store). Alerts later than ``lateness`` are left out.
    """
    return (
        alerts.withWatermark("created_at", lateness).select("alert_id", "created_at").groupBy("alert_id")
        .transformWithStateInPandas(ThrottleState(seconds), "alert_id string, created_at timestamp", "Append", "EventTime")
    )


def latest_evaluations(evaluations: DataFrame, interval: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """One evaluation per alert and interval: the last one in it, as a monitor that looks once an interval would see.

    The aggregate combines map side, so what reaches an alert's key is bounded
    by time and not by the number of metrics. Of evaluations at one time, a
    breach counts.
    """
    last = F.max_by(F.struct("timestamp", "breached", "message"), F.struct("timestamp", "breached", "message")).alias("_last")
    grouped = evaluations.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", interval).alias("w"), "alert_id").agg(last)
    # the window's time, and not the row's, is the event time from here on: it is what the watermark has passed
    return grouped.select("alert_id", F.window_time("w").alias("seen"), F.col("_last.timestamp").alias("timestamp"), F.col("_last.breached").alias("breached"), F.col("_last.message").alias("message"))


class AlertState(StatefulProcessor):
    """Keeps one small record per open alert and emits its openings, updates and resolutions; a resolved alert leaves no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alert", "created_at timestamp, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        created, n = self.state.get() if self.state.exists() else (None, 0)
        was_open, is_open = created is not None, created is not None
        out = []
        for r in pd.concat(list(rows)).sort_values(["timestamp", "breached"]).itertuples(index=False):
            if r.breached:
                action = "updated" if is_open else "opened"
                created, n, is_open = (created if is_open else r.timestamp), (n + 1 if is_open else 1), True
            elif is_open:
                action, is_open = "resolved", False
            else:
                continue
            out.append((key[0], action, created, r.timestamp, n, r.message))
        if is_open:
            self.state.update((pd.Timestamp(created).to_pydatetime(), n))
        elif was_open:
            self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=["alert_id", "action", "created_at", "updated_at", "n_breaches", "message"])

    def close(self) -> None:
        pass


class FirstSeenState(StatefulProcessor):
    """Lets the first observation of a (url, content hash) through, and remembers that it did."""

    def __init__(self, keep_seconds: float | None) -> None:
        self.keep = None if keep_seconds is None else int(keep_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "doc_id bigint", self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        if not self.seen.exists():
            best = None
            for part in rows:
                first = part.sort_values(["micros", "doc_id"]).iloc[0]
                mine = (first["micros"], first["doc_id"])
                best = mine if best is None or mine < best else best
            self.seen.update((int(best[1]),))
            yield pd.DataFrame([(key[0], key[1], *best)], columns=["url", "content_hash", "micros", "doc_id"])

    def close(self) -> None:
        pass


class NumberState(StatefulProcessor):
    """Numbers what is new at a URL, in time order within a micro-batch; the state is one number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "version int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        latest = self.latest.get()[0] if self.latest.exists() else 0
        new = pd.concat(list(rows)).sort_values(["micros", "doc_id"])
        self.latest.update((latest + len(new),))
        yield new.assign(version_number=np.arange(latest + 1, latest + len(new) + 1, dtype=np.int32))[["url", "content_hash", "micros", "doc_id", "version_number"]]

    def close(self) -> None:
        pass


def alert_lifecycle(evaluations: DataFrame) -> DataFrame:
    """Alert transitions from a stream of rule evaluations (alert_id, timestamp, breached, message); needs the RocksDB state store.

    State is one record per alert that is open. A micro-batch's evaluations of
    one alert are put in order together: reduce them with ``latest_evaluations``
    where there are many.
    """
    schema = "alert_id string, action string, created_at timestamp, updated_at timestamp, n_breaches bigint, message string"
    rows = evaluations.select("alert_id", "timestamp", "breached", "message")
    return rows.groupBy("alert_id").transformWithStateInPandas(AlertState(), schema, "Append", "None")


def track_versions(observations: DataFrame, keep_seconds: float | None = None) -> DataFrame:
    """The versions, (url, content_hash, ts, doc_id, version_number), that a stream of (url, ts, doc_id, content_hash) brings.

    Hashes are remembered per (url, hash), so a URL with very many observations
    is spread over tasks, and only what is new there goes on to the URL's own
    key, whose state is its latest number. With ``keep_seconds``, a hash is
    forgotten that long after it was first seen, and content that returns
    later is a new version. Observations get their number by a join with the
    versions. Needs the RocksDB state store.
    """
    mode = "None" if keep_seconds is None else "ProcessingTime"
    # times go as whole microseconds, null ones last: pandas has none after the year 2262
    micros = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NO_TIME)).alias("micros")
    new = observations.select("url", "content_hash", micros, "doc_id").groupBy("url", "content_hash").transformWithStateInPandas(
        FirstSeenState(keep_seconds), "url string, content_hash string, micros bigint, doc_id bigint", "Append", mode
    )
    out = new.groupBy("url").transformWithStateInPandas(NumberState(), "url string, content_hash string, micros bigint, doc_id bigint, version_number int", "Append", "None")
    return out.select("url", "content_hash", F.timestamp_micros(F.nullif("micros", F.lit(NO_TIME))).alias("ts"), "doc_id", "version_number")


def state_rows(spark: SparkSession, checkpoint: str, variable: str, operator_id: int = 0) -> DataFrame:
    """What a stateful query remembers under ``checkpoint``: key and value of one state variable."""
    return spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator_id).option("stateVarName", variable).load()


def evaluate_batches(metrics: DataFrame, rules: DataFrame, on_alerts: Callable[[DataFrame, int], None]):
    """Writer that joins each micro-batch of metrics to the rules and hands the triggered alerts to a callback."""

    def handle(batch: DataFrame, epoch: int) -> None:
        on_alerts(A.triggered(A.evaluate(batch, rules)), epoch)

    return metrics.writeStream.foreachBatch(handle)


def run_available(stream: DataFrame, name: str, partitions: list[str] | None = None, root: str | None = None) -> DataFrame:
    """Processes everything available now into parquet below ``root`` (a fresh shared folder), and returns that table.

    Offsets and state live beside the output, so a restarted query continues where it stopped.
    """
    spark = stream.sparkSession
    root = root or shared_dir(spark, name)
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", os.path.join(root, "out")).option("checkpointLocation", os.path.join(root, "state"))
    writer = (writer.partitionBy(*partitions) if partitions else writer).trigger(availableNow=True)
    query = writer.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(os.path.join(root, "out"))
