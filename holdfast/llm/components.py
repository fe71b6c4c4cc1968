"""Connected components of an edge table, in rounds of joins handed over through storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.session import few_files, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of `edges` (a, b long): comp is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then jumps to the label
    of that label, so paths shrink about by half; rounds end when no label changes. A hub with
    very many edges meets only partial minima. Repeated edges count once, edges from a node to
    itself are left out, edges with a null end join nothing, and no edges give no rows.
    """
    ab = stage(few_files(edges.select("a", "b").where("a <> b").distinct()), "edges")
    both = ab.unionByName(ab.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stage(few_files(both.groupBy(F.col("a").alias("node")).agg(
        F.min(F.least("a", "b")).alias("comp"))), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select(
            "node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        moved = stage(few_files(low.join(jump, "comp").select(
            "node", "old", F.least("comp", "next").alias("comp"))), "labels")
        labels = moved.select("node", "comp")
        if moved.where("old <> comp").isEmpty():
            return labels


def extended(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, comp) after more links (a, b long), equal to those of all links at
    once. Only links between different components take part, a component being one node of them,
    so the rounds have the size of what is new; without such a link `comps` comes back as it is."""
    def end(side: str) -> DataFrame:
        return comps.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}"))

    placed = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(
        F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    new = stage(few_files(placed.where("a <> b")), "new-links")
    if new.isEmpty():
        return comps
    joined = components(new)
    moved = comps.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("now")),
                       "comp", "left").select("node", F.coalesce("now", "comp").alias("comp"))
    return stage(few_files(moved.unionByName(joined.join(comps.select("node"), "node",
                                                         "left_anti"))), "components")
