"""Connected components of a link table, without collecting links or nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsentry.session import materialize


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Rows (node, label) for every end of ``links`` (a, b): the smallest node that links reach from it.

    Every turn each node takes the smallest label among its neighbours', then
    the label of its label. Both steps are joins on written tables, so that a
    node with very many links is split over tasks, and a lost executor costs
    one turn at most. The turns needed grow with the logarithm of the longest
    path, and few of them suffice for stars.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
    labels = materialize(labels, f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        moved = materialize(
            labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), f"{name}-near"
        )
        jump = moved.select(F.col("node").alias("at"), F.col("label").alias("to"))
        after = moved.join(jump, F.col("label") == F.col("at"), "left").select(
            "node", "old", F.least("label", F.coalesce("to", "label")).alias("label")
        )
        after = materialize(after, f"{name}-labels")
        labels = after.select("node", "label")
        if after.filter(F.col("label") != F.col("old")).isEmpty():
            return labels
