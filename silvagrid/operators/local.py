"""Attributes from finite windows: a rule on which pixels of a window a node holds, summed over the node's pixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silvagrid.operators.attributes import beside
from silvagrid.plans.tree import Tree


def checked_window(offsets: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if not 1 <= len(offsets) <= 32 or (0, 0) not in offsets or len(set(offsets)) != len(offsets):
        raise ValueError("a window has 1 to 32 offsets, the origin among them, none twice")
    return offsets


def entries(tree: Tree, offsets: list[tuple[int, int]]) -> DataFrame:
    """(tree_id, pixel, node_id, depth, bits): the nodes at which samples of a pixel's window enter, from the
    innermost; bits tells which enter there. A sample enters where its owner meets the pixel's."""
    b = beside(tree, checked_window(offsets)).where("meet IS NOT NULL")
    e = b.groupBy("tree_id", "pixel", F.col("meet").alias("node_id")).agg(F.sum(F.expr("shiftleft(1L, CAST(side AS INT))")).alias("bits"))
    return e.join(tree.nodes.select("tree_id", "node_id", "depth"), ["tree_id", "node_id"])


#: Rules on windows up to this size are tabled for all sets of samples; larger ones for the sets that occur.
TABLED = 12


def increments(tree: Tree, offsets: list[tuple[int, int]], rule: Callable[[int], float]) -> DataFrame:
    """(tree_id, node_id, value): what the rule changes by where samples enter. For small windows the rule is a
    table of all sets of samples (at most 2**TABLED rows), so it runs as a join, not as Python."""
    w = Window.partitionBy("tree_id", "pixel").orderBy(F.desc("depth"))
    e = entries(tree, offsets).withColumn("state", F.sum("bits").over(w))
    if len(offsets) <= TABLED:
        rows = [(s, float(rule(s))) for s in range(1 << len(offsets))]
        e = e.join(F.broadcast(tree.nodes.sparkSession.createDataFrame(rows, "state long, score double")), "state")
    else:
        e = e.withColumn("score", F.pandas_udf(lambda x: x.map(lambda s: float(rule(int(s)))), "double")("state"))
    e = e.withColumn("value", F.col("score") - F.coalesce(F.lag("score").over(w), F.lit(float(rule(0)))))
    return e.groupBy("tree_id", "node_id").agg(F.sum("value").alias("value"))


def compute(tree: Tree, offsets: list[tuple[int, int]], rule: Callable[[int], float]) -> DataFrame:
    """The rule's sum over the pixels of each node's support."""
    return tree.subtree_sums(increments(tree, offsets, rule), ["value"])
