"""Connected components of a table of edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.session import pin


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the least node of the component.

    In each round every node moves to its least neighbour, if that is less, and on to where that one moves; edges
    then join the places moved to, and those within one place are gone. The graph shrinks from round to round,
    sorted paths too, and nothing but the moves is kept. Moves and edges are pinned, so lineage does not grow.
    Repeated edges and edges from a node to itself do no harm; no edges give an empty table.
    """
    given = pin(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    left, moves = given.where("a <> b"), []
    while not left.isEmpty():
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = ends.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to"))
        step = pin(step, "steps")
        onward = step.select(F.col("node").alias("to"), F.col("to").alias("root"))
        move = pin(step.join(onward, "to").select("node", "root"), "moves")
        moves.append(move)
        left = left.join(move.select(F.col("node").alias("a"), F.col("root").alias("x")), "a") \
            .join(move.select(F.col("node").alias("b"), F.col("root").alias("y")), "b").where("x <> y") \
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = pin(left, "edges")
    labels = given.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    for move in moves:
        labels = labels.join(move.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left") \
            .select("node", F.coalesce("next", "root").alias("root"))
    return pin(labels, "labels")
