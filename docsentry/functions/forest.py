"""Isolation trees on small samples, and grown forests cut to smaller ones: numpy helpers run inside Spark tasks."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREE_SCHEMA = "tree int, node int, feature int, threshold double, left_node int, right_node int, size int, depth int"


def average_path(n) -> np.ndarray:
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    value = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def grow_tree(points: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, size, depth); feature -1 marks a leaf."""
    nodes: list[tuple] = []
    todo = [(0, points, 0)]
    next_id = 1
    while todo:
        node, rows, depth = todo.pop()
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (None, None)
        usable = np.flatnonzero(high > low) if len(rows) > 1 else np.array([], dtype=int)
        if depth >= limit or len(usable) == 0:
            nodes.append((node, -1, 0.0, -1, -1, len(rows), depth))
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = rows[:, feature] < threshold
        nodes.append((node, feature, threshold, next_id, next_id + 1, len(rows), depth))
        todo += [(next_id, rows[goes_left], depth + 1), (next_id + 1, rows[~goes_left], depth + 1)]
        next_id += 2
    return nodes


def tree_builder(sample_size: int, seed: int):
    """Function for ``groupBy('tree').applyInPandas``; a group is one tree's sample."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        chosen = pdf.sort_values(["rank_hash", "id"]).head(sample_size)
        points = np.stack([np.asarray(v, dtype=float) for v in chosen["features"]])
        limit = int(np.ceil(np.log2(max(len(points), 2))))
        rows = grow_tree(points, limit, np.random.default_rng([seed, tree]))
        return pd.DataFrame([(tree, *r) for r in rows], columns=["tree", "node", "feature", "threshold", "left_node", "right_node", "size", "depth"])

    return build


def path_lengths(points: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """Depth of every point's leaf plus the expected rest of its path."""
    at = np.zeros(len(points), dtype=int)
    rows = np.arange(len(points))
    while True:
        feature = tree["feature"][at]
        inner = feature >= 0
        if not inner.any():
            return tree["depth"][at] + average_path(tree["size"][at])
        left = points[rows[inner], feature[inner]] < tree["threshold"][at[inner]]
        at[inner] = np.where(left, tree["left_node"][at[inner]], tree["right_node"][at[inner]])


def score_batch(batch: pd.Series, trees: list[dict[str, np.ndarray]], sample_size: int) -> pd.Series:
    points = np.stack([np.asarray(v, dtype=float) for v in batch]) if len(batch) else np.zeros((0, 1))
    mean = np.mean([path_lengths(points, t) for t in trees], axis=0) if len(points) else np.zeros(0)
    return pd.Series(np.power(2.0, -mean / max(float(average_path(sample_size)), 1e-12)))


def cut_forest(nodes: pd.DataFrame, depths: Sequence[int]) -> dict:
    """A grown classification forest as arrays, with the leaves its trees have if they are grown to given depths only.

    ``nodes``: (treeID, id, prediction, impurityStats, leftChild, rightChild,
    featureIndex, threshold) rows as Spark saves them, ids in pre-order. At the
    depth the last nodes become leaves, and leaves of equal prediction are
    joined, as Spark does when it ends a tree.
    """
    nodes = nodes.sort_values(["treeID", "id"], kind="stable")
    roots = np.flatnonzero(nodes["id"].to_numpy() == 0)
    base = np.repeat(roots, np.diff(np.append(roots, len(nodes))))
    left, right = (np.where(c < 0, -1, c + base) for c in (nodes["leftChild"].to_numpy(), nodes["rightChild"].to_numpy()))
    stats = np.stack(nodes["impurityStats"].to_numpy()).astype(float)
    inner = [(i, int(left[i]), int(right[i])) for i in np.flatnonzero(left >= 0).tolist()]
    level = [0] * len(nodes)
    for node, a, b in inner:  # pre-order: a node comes before its children
        level[a] = level[b] = level[node] + 1
    leaves = {}
    for depth in depths:
        leaf, said = [a < 0 or at >= depth for a, at in zip(left.tolist(), level, strict=True)], nodes["prediction"].tolist()
        for node, a, b in reversed(inner):
            if not leaf[node] and leaf[a] and leaf[b] and said[a] == said[b]:
                leaf[node], said[node] = True, said[a]
        leaves[depth] = np.array(leaf)
    return {
        "roots": roots,
        "left": left,
        "right": right,
        "feature": np.maximum(nodes["featureIndex"].to_numpy(), 0),
        "threshold": nodes["threshold"].fillna(0.0).to_numpy(dtype=float),
        "votes": stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300),
        "leaves": leaves,
    }


def cut_predictions(forest: dict, rows: np.ndarray, n_trees: Sequence[int], depth: int) -> list[np.ndarray]:
    """Predicted classes of ``rows`` by the first trees of a ``cut_forest``, for each number of trees in ``n_trees``."""
    leaf, left, right, feature, threshold = (forest["leaves"][depth], *(forest[k] for k in ("left", "right", "feature", "threshold")))
    total, out = np.zeros((len(rows), forest["votes"].shape[1])), {}
    for tree, root in enumerate(forest["roots"].tolist(), 1):
        at, moving = np.full(len(rows), root), np.arange(len(rows))
        while True:
            moving = moving[~leaf[at[moving]]]
            if not len(moving):
                break
            node = at[moving]
            at[moving] = np.where(rows[moving, feature[node]] <= threshold[node], left[node], right[node])
        total += forest["votes"][at]
        if tree in n_trees:
            out[tree] = total.argmax(axis=1)
    return [out[n] for n in n_trees]
