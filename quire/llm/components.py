"""Connected components of a link table, as joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, free_driver


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node id reachable from every node of ``links(a, b)``.

    Each round takes the least label around a node and then the label of that
    label, so labels travel over doubling distances; it ends when no label
    changes.  Links and labels stay in stored tables, the driver only sees a
    count a round.
    """
    scratch = Scratch(links.sparkSession)
    stored = scratch.stored
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .where("a <> b").distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")),
                    "labels")
    while True:
        near = (edges.join(labels.select(F.col("node").alias("b"), "root"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near")))
        # also the root learns what its followers see
        told = (labels.join(near, "node").groupBy(F.col("root").alias("node")).agg(F.min("near").alias("told")))
        hooked = (labels.join(near, "node").join(told, "node", "left")
                  .select("node", F.col("root").alias("old"), F.least("root", "near", "told").alias("root")))
        hooked = stored(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("at"), F.col("root").alias("further"))
        moved = stored(hooked.join(jump, hooked["root"] == jump["at"])
                       .select("node", "old", F.least("root", "further").alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.where("root <> old").isEmpty():
            scratch.drop("edges", "hooked")
            free_driver(links.sparkSession)
            return labels
