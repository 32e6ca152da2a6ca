"""Ranked search by K2-treaps against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from docsentry.llm import treap_search as T

compress, decompress = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k):
    kept = [(d, words(t)) for d, t in docs if words(t)]
    n_docs, total = len(kept), sum(len(w) for _, w in kept)
    df = Counter(t for _, w in kept for t in set(w))
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, w in kept:
            tf, m = Counter(w), 100 - 50 + (50 * len(w) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in terms if t in tf)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def corpus(n=300):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "naïve", "日本", "A1", "x_y", "it's"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40)))) for i in range(n)]
    docs += [(None, "w1 w2 w3"), (7, docs[7][1]), (7, "w59 other text"), (900, None), (901, ""), (902, " .,;\n"), (903, "w5 " * 60_000 + "rare")]
    return docs


ITEMS = [(1, "w1 w2 w3 w40 rare"), (2, "W59 été, NAÏVE 日本"), (3, None), (4, "..."), (5, "absent words only"), (1, "a1 w50"), (None, "w7 w7 w8"), (6, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize(("block_docs", "block_bytes", "pack_items"), [(8192, 8_000_000, 256), (7, 8_000_000, 2), (1, 100, 1), (64, 500, 3)])
def test_ranks_equal_plain_scores(spark, block_docs, block_bytes, pack_items):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, item_id string, score int").repartition(3)
    items = spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id long, text string, rank int")
    got = T.rank(df, items, 20, block_docs, block_bytes, pack_items).collect()
    assert sorted(map(tuple, got), key=key) == sorted(ranked(docs, ITEMS, 20), key=key)


def test_ties_are_ranked_by_id(spark):
    docs = [(i, "same words here") for i in range(500, 0, -1)] + [(1000 + i, "other things") for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, "same here")], "item_id long, text string")
    got = T.rank(df, items, 50, block_docs=64).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == list(range(1, 51)) and [r["rank"] for r in got] == list(range(1, 51))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert T.rank(docs.limit(0), items).count() == 0 and T.rank(docs, items.limit(0)).count() == 0
    assert T.rank(docs.selectExpr("doc_id", "cast(null AS string) AS text"), items).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_treap_finds_the_best_columns(data):
    depth = data.draw(st.integers(1, 6))
    rows = data.draw(st.integers(1, 150))
    seed = np.random.default_rng(data.draw(st.integers(0, 1 << 30)))
    grid = np.where(seed.random((rows, 1 << depth)) < 0.2, seed.integers(1, 1_000_000, (rows, 1 << depth)), 0)
    grid[np.arange(rows), seed.integers(0, 1 << depth, rows)] = 5  # no empty row, so no empty band
    r, c = np.nonzero(grid)
    treap = T.Treap(*T.build(r, c, grid[r, c], depth, compress), decompress)
    asked = seed.choice(rows, min(rows, data.draw(st.integers(1, 12))), replace=False)
    weights = seed.integers(1, 20_000, len(asked))
    scores = weights @ grid[asked]
    k, least = data.draw(st.integers(1, 10)), data.draw(st.sampled_from([1, 1 << 20, 1 << 33]))
    columns, found = treap.top(asked, weights, k, least)
    best = np.sort(scores)[::-1]
    cut = max(least, best[k - 1] if len(best) >= k else 1)
    assert dict(zip(columns.tolist(), found.tolist(), strict=True)) == {i: s for i, s in enumerate(scores.tolist()) if s >= cut}


def test_best_first_leaves_most_ranges_closed():
    rng = np.random.default_rng(2)
    depth, rows = 12, 400
    grid = np.where(rng.random((rows, 1 << depth)) < 0.02, rng.integers(1, 1000, (rows, 1 << depth)), 0)
    grid[:, 0] = 1
    grid[:8, 77] = 1_000_000
    r, c = np.nonzero(grid)
    treap = T.Treap(*T.build(r, c, grid[r, c], depth, compress), decompress)
    opened = 0

    class Counting(np.ndarray):
        def take(self, at):
            nonlocal opened
            opened += np.size(at)
            return np.asarray(self).take(at)

    treap.quarters = [q.view(Counting) for q in treap.quarters]
    columns, _ = treap.top(np.arange(8), np.full(8, 100), 1)
    assert columns.tolist() == [77] and opened < 8 * (1 << depth) / 2
