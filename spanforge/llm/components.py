"""Connected components of a link table, as rounds of DataFrame joins; nothing of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node that it reaches.

    links: columns a and b of one ordered type; direction, repeats and loops don't matter, nulls are dropped.
    Each round takes the smallest label among a node and its neighbours (a partial minimum before the shuffle, so a
    hub costs a row a task), then replaces every label by its own label, which halves the paths that are left.
    No links: no rows.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("near")).agg(F.min("label").alias("least"))
        lower = labels.join(near, labels["node"] == near["near"], "left").select("node", F.col("label").alias("was"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        after = cut(lower.join(jump, lower["label"] == jump["to"], "left").select("node", "was", F.least("label", "beyond").alias("label")))
        moved = after.where(F.col("was") != F.col("label")).limit(1).count()
        labels = after.select("node", "label")
        if not moved:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components have not settled after {rounds} rounds")
