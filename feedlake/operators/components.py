"""Connected components by star contraction, and links that arrive later merged into stored groups."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.sources.scratch import written



def _least_by(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with m, the least of u and its v. Minima are combined before the shuffle; the join back is a merge join right on its exchanges, which Spark
    splits where one u holds a large share of all pairs."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return pairs.join(least.hint("merge"), F.col("u") == F.col("w")).drop("w")


def star_rounds(links: DataFrame) -> Iterator[DataFrame]:
    """The link table (u, v), u > v, after each round: a large star (all larger neighbours of a node move to its least neighbour), then a
    small star (a node and its smaller neighbours do). It ends with stars: each u once, no v that is a u.

    Rounds are written tables, and a path of n nodes takes about log2(n) of them. u and v are of any type that has an order.
    """
    edges = links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "links")
    while True:
        yield edges
        doubled = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if doubled.isEmpty() and edges.join(edges.select(F.col("u").alias("v")).hint("merge"), "v", "left_semi").isEmpty():
            return
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_by(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least_by(large)
        moved = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        edges = written(moved.distinct(), "links")


def star_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): root is the least node that it reaches. Null ends and loops are no links; an empty table gives an empty table."""
    for edges in star_rounds(links):
        last = edges
    return last.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(last.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Stored (node, root) after new ``links`` (u, v): what star_components() gives for the links behind ``labels`` and these together.

    Only links between stored roots are contracted, so the rounds work on the size of the batch; the stored table is joined twice.
    """
    known = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")).hint("merge")
    raised = links.join(known("u"), "u", "left").join(known("v"), "v", "left")
    raised = written(raised.select("u", "v", F.coalesce("u_root", "u").alias("u_root"), F.coalesce("v_root", "v").alias("v_root")), "raised")
    roots = star_components(raised.select(F.col("u_root").alias("u"), F.col("v_root").alias("v")))
    ends = raised.select(F.col("u").alias("node"), F.col("u_root").alias("root")).unionByName(raised.select(F.col("v").alias("node"), F.col("v_root").alias("root")))
    every = labels.unionByName(ends).distinct()
    every = every.join(roots.select(F.col("node").alias("root"), F.col("root").alias("to")).hint("merge"), "root", "left")
    return every.select("node", F.coalesce("to", "root").alias("root"))
