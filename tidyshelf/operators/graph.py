"""Groups of things that are linked, and what can be reached along links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.session import pin


def linked_groups(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(member, group)`` for every end of a link: the group is the least member that links lead to, in whatever direction.

    Each round sends every member to the least of its neighbours and on to where that one goes, then joins the places that
    still differ, so the graph halves at least about every other round; a chain of n ends in some log(n) rounds. Null ends
    take no part. Rounds are pinned, so the plan does not grow with them.
    """
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    given = pin(ends.distinct(), "links")
    left, moves = given.where("a <> b"), []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = pin(both.groupBy(F.col("a").alias("member")).agg(F.least(F.col("member"), F.min("b")).alias("to")), "nearest")
        then = nearest.select(F.col("member").alias("to"), F.col("to").alias("group"))
        move = pin(nearest.join(then, "to").select("member", "group"), "moves")
        moves.append(move)
        for end in ("a", "b"):
            left = left.join(move.select(F.col("member").alias(end), F.col("group").alias(f"_{end}")), end).drop(end).withColumnRenamed(f"_{end}", end)
        left = pin(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    groups = given.select(F.explode(F.array("a", "b")).alias("member")).distinct().withColumn("group", F.col("member"))
    for move in moves:
        groups = groups.join(move.select(F.col("member").alias("group"), F.col("group").alias("_to")), "group", "left") \
            .select("member", F.coalesce("_to", "group").alias("group"))
    return groups


def reachable(roots: DataFrame, links: DataFrame, start: str, end: str) -> DataFrame:
    """``(node, depth)``: the fewest links from any root, roots at 0. Cycles and repeated links do no harm.

    ``roots`` has one column of nodes. A round joins the frontier with the links and leaves out what was seen before, so a node
    is followed once; it ends when nothing new is found. Rounds are pinned.
    """
    edges = pin(links.select(F.col(start).alias("_from"), F.col(end).alias("node")).where("_from is not null and node is not null").distinct(), "edges")
    depth = 0
    frontier = pin(roots.select(F.col(roots.columns[0]).alias("node")).where("node is not null").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen = frontier
    while not frontier.isEmpty():
        depth += 1
        step = frontier.select(F.col("node").alias("_from")).join(edges, "_from").select("node").distinct()
        frontier = pin(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(frontier)
    return seen
