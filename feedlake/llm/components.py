"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hint, release, written


def components(links: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest node it reaches.

    Links stay distributed. Each round takes the least label among a node's neighbours and then the label of that label,
    so chains halve; rounds are written tables. Nodes and bytes are counted: few labels are broadcast, beyond that joins between
    the tables are plain exchanges that Spark can split where skewed.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = written(both, "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    how = join_hint(labels, broadcast_rows)
    while True:
        near = edges.join(labels.hint(how), F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near.hint(how), F.col("node") == F.col("a"), "left").select("node", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("via"), F.col("comp").alias("beyond"))
        step = step.join(jump.hint(how), F.col("next") == F.col("via"), "left").select("node", "comp", F.least("next", "beyond").alias("next"))
        step = written(step, "labels")
        labels = step.select("node", F.col("next").alias("comp"))
        if step.where(F.col("comp") != F.col("next")).isEmpty():
            release(links.sparkSession)
            return labels
