"""The two vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsentry.llm import adaptive_scan as A
from docsentry.llm import bucketed_topk as B

SCHEMA = "vec_id long, embedding array<float>, rank int"


def table(spark, vectors, extra=()):
    data = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(data + list(extra), SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 24)) * rng.uniform(0.2, 3, size=(600, 1))
    x[100:160] = x[100] + 0.01 * rng.normal(size=(60, 24))  # a hot group
    x[200:205] = x[200]  # equal vectors
    return x.astype(np.float32).astype(float)


ODD = [
    (9001, None, 0),
    (9002, [1.0, None] * 12, 0),
    (9003, [float("nan")] * 24, 0),
    (9004, [float("inf")] * 24, 0),
    (9005, [0.0] * 24, 0),
    (None, [1.0] * 24, 0),
    (9006, [], 0),
]


def test_exact_topk_with_ties_and_odd_rows(spark, vectors):
    got = B.search(table(spark, vectors, ODD), F.col("vec_id") % 20 == 0).collect()
    ints = np.vstack([np.floor(64 * vectors), np.zeros((1, 24))]).astype(int)
    ids = np.array([*range(600), 9005])
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by_query) == set(range(0, 600, 20))
    for query, found in by_query.items():
        scores = ints @ ints[query]
        order = [k for k in np.lexsort((ids, -scores)) if ids[k] != query][:20]
        assert sorted(found) == [(i + 1, ids[k], scores[k]) for i, k in enumerate(order)]


def test_exact_topk_of_few_rows_and_of_none(spark, vectors):
    few = B.search(table(spark, vectors[:4]), F.col("vec_id") == 0).collect()
    assert sorted(r["rank"] for r in few) == [1, 2, 3]
    assert B.search(table(spark, vectors).limit(0), F.col("vec_id") == 0).count() == 0


def test_huge_components_stay_exact():
    rows = np.array([[1e9, 3.0], [2.0, 1e9]])
    assert list(B.products(rows, np.array([1e9, 1e9]))) == [10**18 + 3 * 10**9, 2 * 10**9 + 10**18]


def test_bucket_pruning_keeps_every_needed_row(vectors):
    rng = np.random.default_rng(2)
    own = np.floor(64 * vectors)
    lengths = np.linalg.norm(own, axis=1)
    own, lengths = own[np.argsort(-lengths)], -np.sort(-lengths)
    unit = own / lengths[:, None]
    seen = set()
    for query in own[rng.choice(len(own), 40)]:
        scores = own @ query
        for threshold in (-np.inf, 0.0, *np.quantile(scores, [0.5, 0.9, 0.99, 1])):
            near = B.candidates(unit, lengths, query, threshold)
            assert set(np.flatnonzero(scores >= threshold)) <= set(near)
            seen.add(len(near) < len(own))
    assert seen == {True, False}


def test_nearest_neighbours_recall_and_scores(spark, vectors):
    got = A.search(table(spark, vectors, ODD), F.col("vec_id") % 10 == 0).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append(r)
        assert r["vec_id"] != r["query_id"] and abs(r["score"] - unit[r["query_id"]] @ unit[r["vec_id"]]) < 1e-12
    assert set(by_query) == set(range(0, 600, 10))
    for query, found in by_query.items():
        assert [r["rank"] for r in sorted(found, key=lambda r: (-r["score"], r["vec_id"]))] == [1, 2, 3, 4, 5]
        scores = unit @ unit[query]
        scores[query] = -9
        hits += len({r["vec_id"] for r in found} & set(np.lexsort((np.arange(600), -scores))[:5]))
    assert hits >= 0.9 * 5 * len(by_query)


def test_nearest_neighbours_of_few_rows_and_of_none(spark, vectors):
    few = A.search(table(spark, vectors[:3]), F.col("vec_id") == 0, probed=1.0).collect()
    assert sorted(r["rank"] for r in few) == [1, 2]
    assert A.search(table(spark, vectors).limit(0), F.col("vec_id") == 0).count() == 0


def test_scan_seldom_abandons_a_neighbour(vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ A.rotation(24)
    kept = lost = 0
    for query in range(0, 600, 7):
        alive = set(A.scan_list(turned, turned[query], 6, columns=6))
        true = set(np.argsort(-(unit @ unit[query]))[:6])
        kept += len(alive)
        lost += len(true - alive)
    assert lost <= 0.02 * 6 * 86 and kept < 0.9 * 600 * 86
