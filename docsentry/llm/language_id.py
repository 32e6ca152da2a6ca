"""Language identification, words first, shorter and shorter n-grams for words never seen.

A known word scores by its log frequency in each language. An unseen word is
covered from left to right: at each place the longest known character n-gram
(five to one) scores by its log frequency, weighed by its share of the word,
so that a guessed word counts no more than a known one. The document's
language has the largest total; the score is its posterior under equal priors.

Word frequencies are learnt from documents with a label. The sample is bounded
by ``sample_docs`` and drawn by a hash of the key; the vocabulary by
``vocabulary``. The model is so bounded, is fitted on the driver and broadcast;
prediction is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package

SAMPLE_DOCS = 40_000
VOCABULARY = 80_000
NGRAM = 5
MIN_GRAM_COUNT = 3
UNDETERMINED = "und"
CACHE_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Model:
    """Log frequencies per language of words and n-grams: a dictionary of places and a matrix for each, as both can be large."""

    def __init__(self, counts: Iterable[tuple[str, str, int]]) -> None:
        places: dict[str, int] = {}
        cells: list[tuple[int, str, int]] = []
        totals: Counter[str] = Counter()
        for language, word, n in counts:
            cells.append((places.setdefault(word, len(places)), language, n))
            totals[language] += n
        self.languages = sorted(totals)
        number = {language: i for i, language in enumerate(self.languages)}
        found = np.zeros((len(places), len(number)))
        for at, language, n in cells:
            found[at, number[language]] = n
        del cells
        sizes = np.array([totals[x] for x in self.languages], dtype=float)
        self.words = places
        self.word_rows = np.log((found + 0.1) / (sizes + 0.1 * len(places)))

        grams: dict[str, int] = {}
        of_gram, of_word = array("i"), array("i")
        for word, at in places.items():
            marked = f"<{word}>"
            for size in range(1, NGRAM + 1):
                for i in range(len(marked) - size + 1):
                    of_gram.append(grams.setdefault(marked[i : i + size], len(grams)))
                    of_word.append(at)
        gram_counts = np.zeros((len(grams), len(number)))
        for column in range(len(number)):
            gram_counts[:, column] = np.bincount(np.frombuffer(of_gram, np.int32), found[np.frombuffer(of_word, np.int32), column], len(grams)) if len(grams) else 0
        lengths = np.fromiter(map(len, grams), np.int64, len(grams))
        known = (lengths == 1) | (gram_counts.sum(axis=1) >= MIN_GRAM_COUNT)
        whole = np.array([gram_counts[known & (lengths == size)].sum(axis=0) + 0.1 * (known & (lengths == size)).sum() for size in range(NGRAM + 1)])
        self.grams = {gram: i for i, gram in enumerate(g for g, kept in zip(grams, known.tolist(), strict=True) if kept)}
        self.gram_rows = np.log((gram_counts[known] + 0.1) / whole[lengths[known]]) if len(grams) else np.zeros((0, len(number)))
        self.known = bool(self.languages) and bool(sizes.sum())

    def word_scores(self, word: str) -> tuple[float, ...]:
        """Log frequency per language of one lower-case word, by back-off where it is unseen."""
        found = self.words.get(word)
        if found is not None:
            return tuple(self.word_rows[found].tolist())
        marked = f"<{word}>"
        total = [0.0] * len(self.languages)
        at = parts = 0
        while at < len(marked):
            for size in range(min(NGRAM, len(marked) - at), 0, -1):
                gram = self.grams.get(marked[at : at + size])
                if gram is not None:
                    total = [a + b for a, b in zip(total, self.gram_rows[gram].tolist(), strict=True)]
                    parts += 1
                    at += size
                    break
            else:
                at += 1
        return tuple(x / max(1, parts) for x in total)


class Predictor:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, max(1, len(model.languages))))
        self.letters = np.zeros(1024, dtype=bool)

    def _add(self, word: str) -> int:
        at = len(self.index)
        if at == len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.rows[at] = self.model.word_scores(word)
        self.letters[at] = any(c.isalpha() for c in word)
        self.index[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text) if text else []
        if not found or not self.model.known:
            return UNDETERMINED, 0.0
        if len(self.index) > CACHE_WORDS:
            self.index.clear()
        index = self.index
        at = np.array([index[w] if w in index else self._add(w) for w in found])
        at = at[self.letters[at]]
        if not len(at):
            return UNDETERMINED, 0.0
        total = self.rows[at].sum(axis=0)
        best = int(total.argmax())
        return self.model.languages[best], float(1.0 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def train(docs: DataFrame, labelled: Column, sample_docs: int = SAMPLE_DOCS, vocabulary: int = VOCABULARY) -> Model:
    """Model of ``docs`` (doc_id, text, lang) where ``labelled`` holds; rows without text or lang teach nothing."""
    ship_package(docs.sparkSession)
    usable = docs.filter(labelled & F.col("lang").isNotNull())
    rows = usable.count()
    share = min(1.0, sample_docs / max(1, rows))
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else usable

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter[str]] = defaultdict(Counter)

        def rows() -> pa.RecordBatch:
            flat = [(x, w, n) for x, c in found.items() for w, n in c.items()]
            columns = zip(*flat, strict=True) if flat else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    found[language].update(words(text))
            if sum(map(len, found.values())) > 200_000:
                yield rows()
                found.clear()
        yield rows()

    counted = drawn.select("lang", F.col("text").cast("string")).mapInArrow(count, "lang string, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Model([])
    share_of = F.lit(0.0)
    for language, n in totals.items():
        share_of = F.when(F.col("lang") == language, F.col("n") / F.lit(float(n))).otherwise(share_of)
    top = counted.select("lang", "word", "n", share_of.alias("share")).orderBy(F.desc("share"), "lang", "word").limit(vocabulary)
    found = top.toArrow()
    return Model(zip(*(found.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True))


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score"), keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per row: the columns in ``keep``, language and score; ``und`` and 0 where the text is null or has no letter.

    Only the text is looked at. Without any labelled text there is no language
    to name, and every text is ``und``. Repeated rows are judged each on its
    own; a kept column with the name of a result gives way to it.
    """
    keep = [c for c in keep if c not in names]
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    language, score = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            found = [predictor.predict(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*keep, language, score],
            )

    kinds = dict(docs.dtypes)
    columns = docs.select(F.col("text").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    return columns.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{language}` string, `{score}` double")
