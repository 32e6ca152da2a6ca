"""Document scores by masked pseudo-likelihood of a small bidirectional window network.

Each word is hidden in turn and predicted from the ``SIDE`` words on either
side of it; the sum of the log-probabilities of a document is its score.

* Vocabulary: at most the ``vocabulary`` most frequent words, counted over all
  documents. They are dealt to ``classes`` by frequency; the network predicts
  the class, and within its class a word has its share of the counts. All
  other words form a last class and share it evenly.
* Network: embeddings of the window's words, one weight block a place, a tanh
  layer, a softmax over classes; written in numpy.
* Texts are split once: their words' ids, two bytes each, are written and
  read by all rounds and the scores.
* Training: every document takes part; each task descends over its own rows
  from the common weights, ``1 / stride`` of the positions of every document
  as targets, a different share each round; ``stride`` is the number of rounds,
  so that each position is a target once. Weights are averaged between
  rounds in two steps of Spark aggregation, so no task and not the driver
  receives more than its bounded share of the tasks' weights.

Training sees rows in the order of the input's splits, so scores differ in
late digits where the same table is split otherwise. A null or empty text has
no tokens, score 0 and a null mean.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsentry.session import materialize

from .common import most_frequent, ship_package

SIDE = 2
VOCABULARY = 30_000
CLASSES = 64
INPUTS = 4096
EMBED = 16
HIDDEN = 32
ROUNDS = 2
#: The rounds together take every position once.
STRIDE = ROUNDS
BATCH = 512
RATE = 0.2
#: Parts the weights travel in, and tasks whose weights meet in one group.
PARTS = 16
FAN_IN = 256
#: Few enough that a call's numbers stay in a core's cache.
_TOKENS_PER_CALL = 2048
#: Scores up to this size need no shift before they are exponentiated.
_PLAIN = 60.0

#: Marks that are words of their own.
MARKS = ".,;:!?()\""


def words(text: str) -> list[str]:
    """Lower-case runs between white space, the ``MARKS`` apart from them."""
    text = text.lower()
    for mark in MARKS:
        if mark in text:
            text = text.replace(mark, f" {mark} ")
    return text.split()


@dataclass
class Vocabulary:
    """Ids by frequency; id ``len(words)`` stands for every other word."""

    index: dict[str, int]
    class_of: np.ndarray
    log_within: np.ndarray
    n_classes: int
    class_share: np.ndarray

    @property
    def stored(self) -> str:
        """Type that written ids have: two bytes where they fit."""
        return "<u2" if len(self.index) < 1 << 16 else "<u4"

    def read(self, ids: bytes) -> np.ndarray:
        return np.frombuffer(ids, self.stored).astype(np.int32)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        other = len(self.index)
        get = self.index.get
        return np.array([get(w, other) for w in words(text)], dtype=np.int32)


def count_words(docs: DataFrame) -> DataFrame:
    """Rows (word, n) over all texts; each task adds up its own words first."""
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    found.update(words(text))
            if len(found) > 400_000:
                yield pack()
                found.clear()
        yield pack()

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", name: str = "lm-ids") -> DataFrame:
    """Rows (key, ids binary), written: the words of every text by number, split once for all rounds and the scores."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            ids = [vocab.ids(text).astype(vocab.stored).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=[key, "ids"])

    own = F.col(f"`{key}`") if key in docs.columns else F.lit(None).cast("long").alias(key)  # training asks for no key
    columns = docs.select(own, F.col("text").cast("string"))
    return materialize(columns.mapInArrow(run, f"`{key}` {dict(columns.dtypes)[key]}, ids binary"), name)


def build_vocabulary(docs: DataFrame, size: int = VOCABULARY, classes: int = CLASSES) -> Vocabulary:
    counted = materialize(count_words(docs), "lm-words")
    summed = sorted(most_frequent(counted, "n", size).collect(), key=lambda r: (-r["n"], r["word"]))
    whole = counted.agg(F.count("*").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    rest_types = whole["types"] - len(summed)
    n = np.array([r["n"] for r in summed], dtype=float)
    weight = np.sqrt(n)
    edges = np.cumsum(weight) / max(weight.sum(), 1e-9)
    class_of = np.minimum((edges * (classes - 1)).astype(int), classes - 2)
    within = np.bincount(class_of, weights=n, minlength=classes) if len(n) else np.zeros(classes)
    shares = within + 1.0
    shares[-1] += whole["tokens"] - n.sum()
    log_within = np.append(np.log(n / within[class_of]) if len(n) else np.zeros(0), -math.log(rest_types + 1))
    return Vocabulary({r["word"]: i for i, r in enumerate(summed)}, np.append(class_of, classes - 1).astype(np.int32), log_within, classes, shares / shares.sum())


class Network:
    """Weights as one float vector, so that they can be averaged and cut into parts."""

    def __init__(self, classes: int, vector: np.ndarray | None = None) -> None:
        self.shapes = [(INPUTS + 1, EMBED), (2 * SIDE, EMBED, HIDDEN), (HIDDEN,), (HIDDEN, classes), (classes,)]
        sizes = [int(np.prod(s)) for s in self.shapes]
        if vector is None:
            rng = np.random.default_rng(7)
            vector = np.concatenate([rng.normal(0, 0.3, s) if i in (0, 1) else np.zeros(s) for i, s in enumerate(sizes)])
        self.vector = vector.astype(np.float32)
        cuts = np.split(self.vector, np.cumsum(sizes)[:-1])
        self.embed, self.mix, self.bias, self.out, self.out_bias = (c.reshape(s) for c, s in zip(cuts, self.shapes, strict=True))

    @staticmethod
    def inputs(ids: np.ndarray) -> np.ndarray:
        return np.where(ids < INPUTS - 1024, ids, INPUTS - 1024 + ids % 1024).astype(np.int32)

    @staticmethod
    def windows(inputs: np.ndarray) -> np.ndarray:
        """Neighbours of each place, left to right without the place itself; beyond the ends stands the pad id."""
        padded = np.concatenate([np.full(SIDE, INPUTS, np.int32), inputs, np.full(SIDE, INPUTS, np.int32)])
        return np.stack([padded[i : i + len(inputs)] for i in range(2 * SIDE + 1) if i != SIDE], axis=1)

    def _exponentials(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the classes, less a shift where they could be large, their exponentials, and each row's sum of these."""
        scores = state @ self.out
        scores += self.out_bias
        if np.abs(self.out).sum(axis=0).max() + np.abs(self.out_bias).max() > _PLAIN:
            scores -= scores.max(axis=1, keepdims=True)
        powers = np.exp(scores)
        return scores, powers, powers @ np.ones((powers.shape[1], 1), powers.dtype)

    def _state(self, window: np.ndarray, tables: np.ndarray) -> np.ndarray:
        state = np.take(tables[0], window[:, 0], axis=0)
        for place in range(1, 2 * SIDE):
            state += np.take(tables[place], window[:, place], axis=0)
        state += self.bias
        return np.tanh(state, out=state)

    def forward(self, window: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state = self._state(window, tables)
        scores, _, sums = self._exponentials(state)
        return state, scores - np.log(sums)

    def log_probs(self, window: np.ndarray, target: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Log-probability of each place's class."""
        scores, _, sums = self._exponentials(self._state(window, tables))
        return scores[np.arange(len(target)), target] - np.log(sums[:, 0])

    def tables(self) -> np.ndarray:
        return np.stack([self.embed @ self.mix[p] for p in range(2 * SIDE)])

    def step(self, window: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One gradient step on the mean log-loss of a batch."""
        n = len(target)
        vectors = np.take(self.embed, window.ravel(), axis=0).reshape(n, -1)
        mix = self.mix.reshape(-1, self.mix.shape[-1])
        state = vectors @ mix
        state += self.bias
        np.tanh(state, out=state)
        _, grad, sums = self._exponentials(state)
        grad /= sums * np.float32(n)
        grad[np.arange(n), target] -= np.float32(1 / n)
        back = grad @ self.out.T
        back *= 1 - state * state
        into = back @ mix.T
        into *= np.float32(rate)
        ones = np.ones(n, np.float32)
        self.out -= rate * (state.T @ grad)
        self.out_bias -= rate * (ones @ grad)
        mix -= rate * (vectors.T @ back)
        # number by number, as rows of the same input add up
        at = (window.reshape(-1, 1).astype(np.int64) * self.embed.shape[1] + np.arange(self.embed.shape[1])).ravel()
        np.subtract.at(self.embed.reshape(-1), at, into.ravel())
        self.bias -= rate * (ones @ back)


def _train_round(encoded: DataFrame, vocabulary, weights, turn: int, stride: int) -> DataFrame:
    """Rows (part, task, tokens, weights): each task's weights after a pass over its rows, cut into parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        net = Network(vocab.n_classes, weights.value.copy())
        seen = 0
        windows, targets, held = [], [], 0
        for batch in batches:
            for stored in batch.column(0).to_pylist():
                ids = vocab.read(stored)
                places = np.arange((turn + len(ids)) % stride, len(ids), stride)
                if not len(places):
                    continue
                windows.append(net.windows(net.inputs(ids))[places])
                targets.append(vocab.class_of[ids[places]])
                held += len(places)
                if held >= 64 * BATCH:
                    seen += _descend(net, windows, targets)
                    windows, targets, held = [], [], 0
        if held:
            seen += _descend(net, windows, targets)
        parts = np.array_split(net.vector, PARTS)
        task = TaskContext.get().partitionId()
        if seen:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(PARTS), pa.int32()),
                    pa.array([task] * PARTS, pa.int32()),
                    pa.array([seen] * PARTS, pa.int64()),
                    pa.array([p.astype("<f4").tobytes() for p in parts], pa.binary()),
                ],
                names=["part", "task", "tokens", "weights"],
            )

    if "ids" not in encoded.columns:
        encoded = encode(encoded, vocabulary.value)
    return encoded.select("ids").mapInArrow(run, "part int, task int, tokens long, weights binary")


def _descend(net: Network, windows: list[np.ndarray], targets: list[np.ndarray]) -> int:
    window, target = np.concatenate(windows), np.concatenate(targets)
    order = np.random.default_rng(len(target)).permutation(len(target))
    for at in range(0, len(order), BATCH):
        rows = order[at : at + BATCH]
        net.step(window[rows], target[rows], RATE)
    return len(target)


def _mean(group: pd.DataFrame) -> pd.DataFrame:
    tokens = group["tokens"].to_numpy(dtype=float)
    stacked = sum(np.frombuffer(w, "<f4") * t for w, t in zip(group["weights"], tokens, strict=True)) / tokens.sum()
    return pd.DataFrame({"part": group["part"].iloc[:1], "tokens": [int(tokens.sum())], "weights": [stacked.astype("<f4").tobytes()]})


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, stride: int = STRIDE, encoded: DataFrame | None = None) -> np.ndarray:
    """Weights after ``rounds`` rounds of local descent and averaging over all documents; ``encoded``: what ``encode`` wrote of them."""
    spark = docs.sparkSession
    encoded = encode(docs.select("text"), vocabulary) if encoded is None else encoded
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    first = Network(vocabulary.n_classes)
    first.out_bias[:] = np.log(vocabulary.class_share)  # the classes' own frequencies are where training starts
    vector = first.vector
    for turn in range(rounds):
        weights = spark.sparkContext.broadcast(vector)
        rows = _train_round(encoded, shared, weights, turn, stride)
        near = rows.groupBy("part", F.floor(F.col("task") / FAN_IN).alias("group")).applyInPandas(_mean, "part int, tokens long, weights binary")
        parts = near.groupBy("part").applyInPandas(_mean, "part int, tokens long, weights binary").collect()
        if parts:
            vector = np.concatenate([np.frombuffer(p["weights"], "<f4") for p in sorted(parts, key=lambda p: p["part"])])
        weights.unpersist()
    return vector


def score(docs: DataFrame, vocabulary: Vocabulary, vector: np.ndarray, key: str = "doc_id", encoded: DataFrame | None = None) -> DataFrame:
    """Rows (key, n_tokens, log_prob, mean_log_prob) of every document, each token predicted from both sides."""
    spark = docs.sparkSession
    encoded = encode(docs, vocabulary, key) if encoded is None else encoded
    ship_package(spark)
    shared = spark.sparkContext.broadcast((vocabulary, vector))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, weights = shared.value
        net = Network(vocab.n_classes, weights)
        tables = net.tables()

        def log_probs(ids: np.ndarray, window: np.ndarray) -> np.ndarray:
            out = np.empty(len(ids))
            for at in range(0, len(ids), _TOKENS_PER_CALL):
                part = ids[at : at + _TOKENS_PER_CALL]
                logs = net.log_probs(window[at : at + _TOKENS_PER_CALL], vocab.class_of[part], tables)
                out[at : at + len(part)] = logs + vocab.log_within[part]
            return out

        def scored(run_ids: list[np.ndarray]) -> list[float]:
            """Sums per document; documents are scored together, each with its own windows."""
            ids = np.concatenate(run_ids)
            window = np.concatenate([net.windows(net.inputs(i)) for i in run_ids])
            ends = np.cumsum([len(i) for i in run_ids])
            total = np.concatenate([[0.0], np.cumsum(log_probs(ids, window))])
            return list(total[ends] - total[ends - [len(i) for i in run_ids]])

        for batch in batches:
            sizes, sums, waiting, held = [], [], [], 0
            for stored in batch.column(1).to_pylist():
                ids = vocab.read(stored)
                sizes.append(len(ids))
                waiting.append(ids)
                held += len(ids)
                if held >= 32 * _TOKENS_PER_CALL:
                    sums += scored(waiting)
                    waiting, held = [], 0
            if waiting:
                sums += scored(waiting)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.float64()),
                    pa.array([s / n if n else None for s, n in zip(sums, sizes, strict=True)], pa.float64()),
                ],
                names=[key, "n_tokens", "log_prob", "mean_log_prob"],
            )

    kind = dict(docs.dtypes)[key]
    return encoded.select(F.col(f"`{key}`"), "ids").mapInArrow(run, f"`{key}` {kind}, n_tokens long, log_prob double, mean_log_prob double")
