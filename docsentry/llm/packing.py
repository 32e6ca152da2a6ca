"""Mixture-controlled packing of token streams into fixed windows.

Sources are queues of documents. Deficit round-robin serves them: at each
round a source's deficit grows by its share of a window, and it sends pieces
of its documents while the deficit lasts, never below ``min_piece`` tokens
unless a document or a window ends. Each window so holds its sources in the
target proportions up to the deficits, which go on to the next window.

Spark spreads the queues: documents are dealt to lanes by a hash, so no source
owns a task, and each lane is packed on its own. The deficits with which a
lane begins are those that all lanes before it leave behind: target share of
what they sent, less what they sent of the source. They follow from token
totals per (lane, source) by prefix sums, so lanes run in parallel and the
mixture holds across them. Each lane's last window alone may be short.

Default targets are the sources' own shares of all tokens, under which every
queue lasts to the end. Given targets hold while the sources last; a source
without a target is served when the others have run out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsentry.functions.scale import running_totals
from docsentry.session import materialize

from .byte_bpe import encoder
from .common import ship_package

WINDOW = 2048
MIN_PIECE = 256
#: Tokens a lane holds on average: the memory of one packing call.
LANE_TOKENS = 4_000_000
LANES_PER_BLOCK = 1024
_LEAST_SHARE = 1e-9

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Rows (doc_id, source, ids binary, n_tokens, h): the packed ids of each text and ``end_id``; h is a hash for dealing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        end = np.asarray([end_id], bpe.dtype).tobytes()
        for batch in batches:
            ids = [x + end for x in bpe.encode(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(ids, pa.binary()),
                    pa.array([len(x) // bpe.dtype.itemsize for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                ],
                names=["doc_id", "source", "ids", "n_tokens", "h"],
            )

    columns = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return columns.mapInArrow(run, "doc_id long, source string, ids binary, n_tokens long, h long")


class Lane:
    """Deficit round-robin over one lane's queues; yields (document row, start, length, window, offset)."""

    def __init__(self, queues: list[list[tuple[int, int]]], shares: list[float], deficits: list[float], window: int, min_piece: int) -> None:
        self.queues, self.deficits, self.window, self.min_piece = queues, list(deficits), window, min_piece
        self.shares = [max(s, _LEAST_SHARE) for s in shares]

    def pieces(self) -> Iterator[tuple[int, int, int, int, int]]:
        heads = [0] * len(self.queues)  # next document of each queue, and its tokens already sent
        sent = [0] * len(self.queues)
        at, offset = 0, 0
        active = [q for q in range(len(self.queues)) if self.queues[q]]
        while active:
            moved = False
            for q in list(active):
                queue = self.queues[q]
                self.deficits[q] += self.window * self.shares[q]
                while heads[q] < len(queue):
                    doc, tokens = queue[heads[q]]
                    left = tokens - sent[q]
                    if self.deficits[q] < min(self.min_piece, left):
                        break
                    length = min(left, int(self.deficits[q]), self.window - offset)
                    yield doc, sent[q], length, at, offset
                    moved = True
                    self.deficits[q] -= length
                    offset += length
                    sent[q] += length
                    if offset == self.window:
                        at, offset = at + 1, 0
                    if sent[q] == tokens:
                        heads[q], sent[q] = heads[q] + 1, 0
                if heads[q] == len(queue):
                    active.remove(q)
            if active and not moved:  # nobody may send yet: as many rounds at once as the first to send needs
                rounds = min(
                    (min(self.min_piece, self.queues[q][heads[q]][1] - sent[q]) - self.deficits[q]) / (self.window * self.shares[q]) for q in active
                )
                for q in active:
                    self.deficits[q] += max(0, int(rounds)) * self.window * self.shares[q]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    window: int = WINDOW,
    targets: Mapping[str | None, float] | None = None,
    min_piece: int = MIN_PIECE,
    lane_tokens: int = LANE_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``docs`` needs doc_id, text and source; other columns are ignored. Null and
    empty texts give the end id alone. A null source is a queue of its own,
    repeated doc_ids are separate documents, an empty table gives no pieces.
    Sequence ids are unique but leave no meaning to their order; offsets of a
    sequence have no gaps.
    """
    ship_package(docs.sparkSession)
    tokens = materialize(tokenize(docs, tokenizer_path, end_id), "packing-tokens")
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    lanes = max(1, -(-total // lane_tokens))
    lane = F.pmod(F.xxhash64("doc_id", "h"), F.lit(lanes)).alias("lane")

    counts = tokens.groupBy(lane, F.col("source").alias("queue")).agg(F.sum("n_tokens").alias("n"))
    block = F.floor(F.col("lane") / LANES_PER_BLOCK)
    by_source = running_totals(counts, ["queue"], block, [F.col("lane")], {"upto": F.col("n")})
    by_lane = counts.groupBy("lane").agg(F.sum("n").alias("lane_n"))
    by_lane = running_totals(
        by_lane, [], block, [F.col("lane")], {"all_upto": F.col("lane_n"), "windows_upto": F.ceil(F.col("lane_n") / window)}
    )
    shares = counts.groupBy(F.col("queue").alias("_s")).agg(F.sum("n").alias("source_n"))
    if targets is None:
        shares = shares.select("_s", (F.col("source_n") / F.lit(max(1, total))).alias("share"))
    else:
        whole = float(sum(targets.values()))
        share = F.lit(0.0)
        for name, value in targets.items():
            share = F.when(F.col("_s").eqNullSafe(F.lit(name)), value / whole).otherwise(share)
        shares = shares.select("_s", share.alias("share"))
    plan = (
        by_source.join(by_lane, "lane")
        .join(shares, F.col("queue").eqNullSafe(F.col("_s")))
        .select(
            "lane",
            "queue",
            "share",
            (F.col("share") * (F.col("all_upto") - F.col("lane_n")) - (F.col("upto") - F.col("n"))).alias("deficit"),
            (F.col("windows_upto") - F.ceil(F.col("lane_n") / window)).cast("long").alias("first_window"),
        )
    )

    dtype = encoder(tokenizer_path).dtype.str

    def run(own: pd.DataFrame, planned: pd.DataFrame) -> pd.DataFrame:
        planned = planned.sort_values("queue", na_position="first")
        own = own.sort_values(["doc_id", "h"], na_position="first").reset_index(drop=True)
        names = [None if pd.isna(s) else s for s in planned["queue"]]
        number = {s: i for i, s in enumerate(names)}
        queues: list[list[tuple[int, int]]] = [[] for _ in names]
        for row, (source, n) in enumerate(zip(own["source"], own["n_tokens"], strict=True)):
            queues[number[None if pd.isna(source) else source]].append((row, n))
        made = list(Lane(queues, list(planned["share"]), list(planned["deficit"]), window, min_piece).pieces())
        doc, start, length, at, offset = (np.array(x, dtype=np.int64) for x in zip(*made, strict=True))
        ids = [np.frombuffer(x, dtype=dtype) for x in own["ids"]]
        crc = [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
        return pd.DataFrame(
            {
                "doc_id": own["doc_id"].astype("Int64").take(doc).array,
                "start": start,
                "length": length,
                "ids_crc32": np.array(crc, dtype=np.int64),
                "doc_tokens": own["n_tokens"].to_numpy()[doc],
                "sequence_id": at + int(planned["first_window"].iloc[0]),
                "offset": offset,
                "source": own["source"].take(doc).array,
            }
        )

    dealt = tokens.select(lane, "doc_id", "source", "ids", "n_tokens", "h")
    grouped = dealt.groupBy("lane").cogroup(plan.groupBy("lane"))
    return grouped.applyInPandas(run, PIECES)
