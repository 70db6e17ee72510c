"""Connected components of a graph of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_kept, kept


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after links (a, b) have joined what they link; a kept table.

    Links with a null end join nothing; an empty graph has no labels.

    ``label`` is the smallest node of a component and stays so.  Nodes that
    ``labels`` lacks are their own label.  Links are mapped to labels once; each
    round then points each label at its smallest neighbour, and at that one's
    target, and maps labels and links by these pointers, until no link joins two
    labels.  The links left shrink with every round.  Minima are combined before
    they are shuffled, so a node with very many links is a row for each task.
    """
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).where("node is not null").distinct()
    labels = kept(labels.join(ends, "node", "full").select("node", F.coalesce("label", "node").alias("label")), "labels")

    def mapped(edges: DataFrame, by: DataFrame) -> DataFrame:
        """Distinct edges between what ``by`` (from, to) makes of the ends."""
        a, b = by.toDF("a", "ta"), by.toDF("b", "tb")
        crossing = edges.join(a, "a").join(b, "b").where("ta != tb")
        return kept(crossing.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")

    edges = mapped(links, labels)
    while not edges.isEmpty():
        near = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("label"), F.least("a", "b").alias("to"))
        near = kept(near, "pointers")
        further = kept(near.join(near.toDF("to", "then"), "to").select("label", F.col("then").alias("to")), "pointers")
        new = kept(labels.join(further, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        left = mapped(edges, further)
        for old in (labels, edges, near, further):
            drop_kept(old)
        labels, edges = new, left
    drop_kept(edges)
    return labels
