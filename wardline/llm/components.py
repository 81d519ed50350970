"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.scratch import Scratch


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the links (a, b); nodes of a component share a root.

    Every node moves to the smallest node among itself and its neighbours and
    the links are contracted along these moves until none is left.  Nodes must
    be random numbers such as hashes: then each round leaves about half of the
    nodes of a chain, and a star vanishes at once.  All steps are aggregates
    and joins; nothing is collected but one flag for each round.
    """
    edges = links.where("a <> b").select("a", "b")
    moves, step = None, 0
    while True:
        both = scratch.write(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                             f"{name}-edges-{step}")
        if both.isEmpty():
            break
        to = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to")),
                           f"{name}-moves-{step}")
        moves = to.withColumnRenamed("to", "root") if moves is None else scratch.write(
            moves.join(to.withColumnRenamed("node", "root"), "root", "left")
            .select("node", F.coalesce("to", "root").alias("root")), f"{name}-roots-{step}")
        if step:  # the tables of the step before are consumed
            scratch.drop(f"{name}-edges-{step - 1}", f"{name}-moves-{step - 1}", f"{name}-roots-{step - 1}")
        edges = (both.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
                 .join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
                 .where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        step += 1
    scratch.drop(f"{name}-edges-{step}", f"{name}-edges-{step - 1}")
    if moves is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return moves
