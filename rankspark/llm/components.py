"""Connected components by minimum labels with pointer jumping, on written tables, the same way at every size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, staged


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and, for each, the smallest node reachable."""
    nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    labels = np.arange(len(nodes))
    while True:
        low = np.minimum(labels[x], labels[y])
        before = labels.copy()
        for at in (labels[x], labels[y], x, y):
            np.minimum.at(labels, at, low)
        while (labels != labels[labels]).any():
            labels = labels[labels]
        if (labels == before).all():
            return nodes, nodes[labels]


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a long, b long) to (node long, label long), label being the smallest node reachable. Nodes without links are not
    in it. Each round takes the smallest label around a node, then that label's own label, so paths shorten geometrically;
    rounds are written to the shared folder, and only whether one changed anything comes to the driver. A node with very many
    links and a label with very many nodes are looked up in salted parts, so neither lands in one task."""
    links = links.where("a <> b").select("a", "b")
    both = staged(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    for _ in range(most_rounds):
        near = lookup(both, "b", labels.withColumnRenamed("node", "b"), "a").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = staged(step, "step")
        # a label is a node itself, so each has a row
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = staged(lookup(step, "label", jump, "node").select("node", "old", F.least("label", "far").alias("label")), "labels")
        if not labels.where("label <> old").limit(1).count():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
