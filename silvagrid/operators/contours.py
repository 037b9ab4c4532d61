"""Contours of node supports, from where each pixel meets its four neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvagrid.kernels import trees as K
from silvagrid.operators.attributes import SIDES, beside
from silvagrid.operators.topology import supports
from silvagrid.plans.tree import Tree


def _reach(tree: Tree) -> DataFrame:
    b = beside(tree, list(SIDES.values()))
    depth = tree.nodes.select("tree_id", F.col("node_id").alias("meet"), F.col("depth").alias("_d"))
    return b.join(depth, ["tree_id", "meet"], "left").withColumn("_d", F.coalesce("_d", F.lit(-1)))


def contour_pixels(tree: Tree) -> DataFrame:
    """(tree_id, node_id, pixel): a pixel lies on the contour of its holders below the outermost meeting."""
    out = _reach(tree).groupBy("tree_id", "pixel", "path").agg(F.min("_d").alias("_d"))
    return out.select("tree_id", F.explode(F.slice("path", (F.col("_d") + 2).cast("int"), F.size("path"))).alias("node_id"), "pixel")


def contour_deltas(tree: Tree) -> DataFrame:
    """(tree_id, node_id, pixel, delta): +1 where a pixel joins a contour, on the way to the root, and -1 where it
    leaves it."""
    r = _reach(tree)
    add = tree.owners.select("tree_id", "node_id", "pixel", F.lit(1).alias("delta"))
    last = r.groupBy("tree_id", "pixel").agg(F.min_by(F.struct("meet"), "_d").alias("m")).select("tree_id", F.col("m.meet").alias("node_id"), "pixel", F.lit(-1).alias("delta"))
    both = add.union(last.where("node_id IS NOT NULL")).groupBy("tree_id", "node_id", "pixel").agg(F.sum("delta").alias("delta"))
    return both.where("delta <> 0")


def trace_edges(tree: Tree) -> DataFrame:
    """(tree_id, node_id, pixel, side): the exposed sides of each node's support."""
    names = F.array(*(F.lit(n) for n in SIDES))
    r = _reach(tree)
    return r.select("tree_id", F.explode(F.slice("path", (F.col("_d") + 2).cast("int"), F.size("path"))).alias("node_id"), "pixel", F.get(names, F.col("side")).alias("side"))


def loops(tree: Tree, cols: int) -> DataFrame:
    """(tree_id, node_id, loop_id, kind, n_sides, area2): closed walks along each support's contour; one group per
    node."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = {divmod(int(p), cols) for p in frame["pixel"]}
        rows = [(frame["tree_id"].iloc[0], int(frame["node_id"].iloc[0]), i, "outer" if area > 0 else "hole", len(sides), area) for i, sides, area in K.loops(own)]
        rows = [(a, b, c, d, e, f) for a, b, c, d, e, f in rows]
        return pd.DataFrame(rows, columns=["tree_id", "node_id", "loop_id", "kind", "n_sides", "area2"])

    return supports(tree).groupBy("tree_id", "node_id").applyInPandas(run, "tree_id string, node_id long, loop_id int, kind string, n_sides long, area2 long")
