"""Files as documents: whole-file scans with metadata, and text from bytes of any common encoding.

The encoding is decided from the bytes alone: a byte-order mark, else the share
of zero bytes at odd and at even places (two-byte text has them on one side
only), else whether they are valid UTF-8, else whether bytes occur that only
the Windows code page prints. Decoding stays in the JVM but for bytes with
zeros, whose places are counted, and for two- and four-byte text, where damaged
units must become replacement characters.
"""

from __future__ import annotations

import os
import shutil
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import content_items

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
#: Characters of the Windows code page at bytes 80 to 9F, in order; U+FFFD where it has none.
WINDOWS_1252 = "€\ufffd‚ƒ„…†‡ˆ‰Š‹Œ\ufffdŽ\ufffd\ufffd‘’“”•–—˜™š›œ\ufffdžŸ"
#: Two-byte text has at least this share of zero bytes on one side, and an eighth of it at most on the other.
ZERO_SHARE = 0.02
_MARKS = (("UTF-8", "EFBBBF"), ("UTF-32LE", "FFFE0000"), ("UTF-32BE", "0000FEFF"), ("UTF-16LE", "FFFE"), ("UTF-16BE", "FEFF"))


@contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """Files listed and read within are dealt to a few tasks a core, however many and small they are; the session's own settings come back after.

    By default a listing has a task per folder, up to ten thousand, and a file
    counts as four more megabytes.
    """
    settings = {
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(8 * spark.sparkContext.defaultParallelism),
        "spark.sql.files.openCostInBytes": str(64 * 1024),
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def scan(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """Files below ``path`` as (source, file_name, modified, n_bytes, content), one row each; partition columns of the folder stay.

    ``pattern`` is a glob over file names. Listing and reading are Spark's, so
    any store it can read will do; a single file is a folder of one. Spark
    lists no files without bytes, so they have no row.
    """
    return _named(_options(spark.read, pattern, recursive).load(path))


def stream(spark: SparkSession, path: str, pattern: str | None = None, files_per_batch: int = 1000, bytes_per_batch: int | None = None) -> DataFrame:
    """As ``scan``, as a stream: each file once, when it appears below ``path``.

    ``bytes_per_batch`` bounds a micro-batch by the size of its files in place of
    their number: many small files then make few micro-batches.
    """
    bound = ("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else ("maxFilesPerTrigger", files_per_batch)
    return _named(_options(spark.readStream.option(*bound).schema(BINARY_FILE), pattern, True).load(path))


def _options(reader, pattern: str | None, recursive: bool):
    reader = reader.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.option("pathGlobFilter", pattern) if pattern else reader


def _named(files: DataFrame) -> DataFrame:
    rest = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    return files.select(
        F.col("path").alias("source"), F.regexp_extract("path", r"[^/]*$", 0).alias("file_name"), F.col("modificationTime").alias("modified"), F.col("length").alias("n_bytes"), "content", *rest
    )


def _two_byte_encoding(content: Column) -> Column:
    """UTF-16LE or UTF-16BE where zero bytes lie on one side only, else null; a last byte without a partner counts for both sides."""

    def kind(c: bytes | None) -> str | None:
        if c is None:
            return None
        zero, pairs = np.frombuffer(c, dtype=np.uint8) == 0, max(len(c) // 2, 1)
        first = np.count_nonzero(zero[0::2]) / pairs
        second = (np.count_nonzero(zero[1::2]) + int(len(zero) % 2 and zero[-1])) / pairs
        if second >= ZERO_SHARE and first * 8 <= second:
            return "UTF-16LE"
        return "UTF-16BE" if first >= ZERO_SHARE and second * 8 <= first else None

    def kinds(contents: pd.Series) -> pd.Series:
        return pd.Series([kind(c) for c in contents], dtype=object)

    return F.pandas_udf(kinds, "string")(content)


def encoding_of(content: Column) -> Column:
    """Name of the encoding of some bytes; null for null."""
    latin = F.decode(content, "ISO-8859-1")
    begins = F.hex(F.substring(content, F.lit(1), F.lit(4)))
    zeros = F.contains(latin, F.lit("\x00"))
    two_byte = _two_byte_encoding(F.when(zeros, content))
    out = F.when(content.isNull(), F.lit(None).cast("string"))
    for name, mark in _MARKS:
        out = out.when(F.startswith(begins, F.lit(mark)), F.lit(name))
    out = out.when(two_byte.isNotNull(), two_byte)
    out = out.when(F.is_valid_utf8(content.cast("string")), F.lit("UTF-8"))
    windows = latin.rlike("[\x80-\x9f]") & ~latin.rlike("[\x81\x8d\x8f\x90\x9d]")
    return out.when(windows, F.lit("windows-1252")).otherwise(F.lit("ISO-8859-1"))


def _wide_text(content: Column, encoding: Column) -> Column:
    def decode(contents: pd.Series, encodings: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or e is None else bytes(c).decode(e, "replace") for c, e in zip(contents, encodings, strict=True)], dtype=object)

    return F.pandas_udf(decode, "string")(content, encoding)


def decoded(df: DataFrame, content: str = "content", encoding: str = "encoding", text: str = "text") -> DataFrame:
    """``df`` with ``encoding`` and ``text`` of the bytes ``content``; byte-order marks are no text.

    Every byte string has a reading. Null bytes have neither.
    """
    named = df.withColumn(encoding, encoding_of(F.col(content)))
    marked = F.lit(0)
    begins = F.hex(F.substring(F.col(content), F.lit(1), F.lit(4)))
    for name, mark in reversed(_MARKS):
        marked = F.when((F.col(encoding) == name) & F.startswith(begins, F.lit(mark)), len(mark) // 2).otherwise(marked)
    body = F.substring(F.col(content), marked + 1, F.octet_length(content))
    wide = F.col(encoding).startswith("UTF-16") | F.col(encoding).startswith("UTF-32")
    latin = F.decode(body, "ISO-8859-1")
    upper = "".join(map(chr, range(0x80, 0xA0)))
    return named.withColumn(
        text,
        F.when(wide, _wide_text(F.when(wide, body), F.when(wide, F.col(encoding))))
        .when(F.col(encoding) == "UTF-8", F.make_valid_utf8(body.cast("string")))
        .when(F.col(encoding) == "windows-1252", F.translate(latin, upper, WINDOWS_1252))
        .otherwise(latin),
    )


def file_items(files: DataFrame, method: str = "local_file") -> DataFrame:
    """Content items of scanned files, with the time of the file as that of its retrieval."""
    return content_items(decoded(files), F.col("source"), F.col("text"), F.lit(method), retrieved_at=F.col("modified"))


def is_shared_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` lies in the file system, where tasks can write files themselves."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def _label(name: str, value) -> str:
    return f"{name}=" + ("__HIVE_DEFAULT_PARTITION__" if value is None else quote(str(value), safe=" "))


def write_documents(df: DataFrame, path: str, name: str, content: str, line_end: str = "\n") -> None:
    """Each row's bytes and ``line_end`` as one file below ``path``, in a folder ``name=value``; null bytes are none.

    In a folder of the file system, which all executors share, tasks write the
    files themselves, under names that a further try replaces: Spark's writer
    starts several processes a file there. Elsewhere Spark's writer is used;
    there, rows of one value share a file.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = df.select(name, F.col(content).cast("binary").alias("_bytes")).repartition(name)
    if not is_shared_folder(spark, path):
        text = rows.select(name, F.col("_bytes").cast("string").alias("value"))
        text.write.mode("overwrite").partitionBy(name).option("lineSep", line_end).text(path)
        return
    store.delete(folder, True)
    root, end = folder.toUri().getPath(), line_end.encode()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, attempt = None, 0, uuid.uuid4().hex
        for batch in batches:
            for value, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = os.path.join(root, _label(name, value))
                number = number + 1 if at == last else 0
                last = at
                os.makedirs(at, exist_ok=True)
                with open(f"{at}/.{attempt}", "wb") as file:
                    file.write((data or b"") + end)
                os.replace(f"{at}/.{attempt}", f"{at}/part-{number:05d}.txt")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, schema=pa.schema([("n", pa.int64())]))

    rows.sortWithinPartitions(name).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def write_slices(df: DataFrame, path: str, name: str, content: str, rows_per_task: int = 6_250, tasks_per_slice: int = 16, per_folder: int = 1000) -> list[str]:
    """Each row's bytes as one file ``name=value.number.txt`` in the slices of ``path``, and the slices' paths; null bytes are none.

    A slice is a folder of about a hundred thousand files at most: who lists and
    reads slice by slice holds the names of one at a time, however many rows
    there are. Rows are dealt to tasks by ``name``, a thousand files of a task share
    a folder, and a task's files appear at once when all are written, so that a
    further try adds none. ``path`` must be ``is_shared_folder``.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    root = folder.toUri().getPath()
    rows = df.select(name, F.col(content).cast("binary").alias("_bytes"))
    rows = rows.repartition(max(-(-df.count() // rows_per_task), spark.sparkContext.defaultParallelism), name)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        slice_ = f"slice={task // tasks_per_slice:05d}"
        attempt = f"{root}/{slice_}/.{uuid.uuid4().hex}"
        for batch in batches:
            for value, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if number % per_folder == 0:
                    at = f"{attempt}/{number // per_folder:05d}"
                    os.makedirs(at)
                with open(f"{at}/{_label(name, value)}.{number:07d}.txt", "wb") as file:
                    file.write(data or b"")
                number += 1
        if number:
            try:
                os.rename(attempt, f"{root}/{slice_}/task={task:05d}")
            except OSError:  # another try of this task was there first
                if not os.path.isdir(f"{root}/{slice_}/task={task:05d}"):
                    raise
                shutil.rmtree(attempt)
            yield pa.RecordBatch.from_pydict({"slice": [slice_]}, schema=pa.schema([("slice", pa.string())]))

    return [f"{path}/{r['slice']}" for r in rows.mapInArrow(write, "slice string").distinct().orderBy("slice").collect()]
