"""Connected components of a graph in DataFrames: least labels spread over the edges, and labels jump to their labels.

Every round writes its labels to the shared folder and removes what it no longer needs, so a lost executor costs one
round at most, and nothing but whether labels changed reaches the driver. Least neighbours come from partial
aggregation and joins, whose large keys adaptive execution splits: a node with many edges is not one task.

Defined results: edges may repeat, turn and be self-loops; an edge with a null end is left out; no edges give no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of the component of each node of ``edges`` (columns a, b)."""
    edges = edges.filter("a is not null and b is not null")
    # each node to its smallest neighbour, that one to the other neighbours: fewer edges, same components
    low = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    least = low.groupBy("b").agg(F.min("a").alias("m"))
    turned = least.select(F.col("m").alias("a"), "b").unionByName(low.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")))
    turned = materialise(turned.distinct(), "edges")
    discard(low)
    both = materialise(turned.unionByName(turned.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    discard(turned)
    written = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    for _ in range(rounds):
        labels = written.select("node", "label")
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        target = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = stepped.join(target, stepped["label"] == target["_n"], "left").select("node", "old", F.least("label", F.coalesce("_l", "label")).alias("label"))
        made = materialise(jumped, "labels")
        discard(written)
        if not made.filter("label <> old").head(1):
            discard(both)
            return made.select("node", "label")
        written = made
    raise RuntimeError("components did not settle")
