"""Edge maps: values on pairs of neighbouring pixels, taken from the node where the two meet."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvagrid.kernels import trees as K
from silvagrid.operators.attributes import topology
from silvagrid.operators.topology import lowest_common, support_metadata
from silvagrid.plans.tree import Tree

KEYS = ["tree_id", "node_id"]


def forward(offsets) -> list[tuple[int, int]]:
    """Half of a stencil, so that every edge comes once."""
    return [(r, c) for r, c in offsets if r > 0 or (r == 0 and c > 0)]


def adjacency(pixels: DataFrame, offsets, once: bool = False) -> DataFrame:
    """(tree_id, source, target) of pixels (tree_id, pixel, row, col): an equi-join on shifted places."""
    steps = forward(offsets) if once else [o for o in offsets if o != (0, 0)]
    a = pixels.select("tree_id", F.col("pixel").alias("source"), "row", "col", F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps))).alias("o"))
    a = a.select("tree_id", "source", (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"))
    return a.join(pixels.select("tree_id", F.col("pixel").alias("target"), "row", "col"), ["tree_id", "row", "col"]).select("tree_id", "source", "target")


def projection_offsets(tree: Tree) -> list:
    if tree.kind == "shapes" and tree.extra.get("immersion") != "selfdual":
        raise ValueError("a tree of shapes with two adjacencies has no single one to project on")
    return tree.offsets or K.stencil(1.0)


def edges(tree: Tree, offsets=None) -> DataFrame:
    """(tree_id, source, target, lca, same): every edge once, with the node where its pixels meet."""
    tree.require(grid=True)
    e = adjacency(tree.owners, offsets or projection_offsets(tree), once=True)
    p = tree.pixels(["path"]).select("tree_id", "pixel", "node_id", "path")
    j = e.join(p.toDF("tree_id", "source", "u", "pu"), ["tree_id", "source"]).join(p.toDF("tree_id", "target", "v", "pv"), ["tree_id", "target"])
    return j.select("tree_id", "source", "target", "u", "v", "pu", "pv", lowest_common("pu", "pv").alias("lca"), (F.col("u") == F.col("v")).alias("same"))


def edge_map(tree: Tree, values: DataFrame, column: str | Column, offsets=None) -> DataFrame:
    """The node value where an edge's pixels meet, also for pixels of one node."""
    c = F.col(column) if isinstance(column, str) else column
    return edges(tree, offsets).join(values.select("tree_id", F.col("node_id").alias("lca"), c.cast("double").alias("value")), ["tree_id", "lca"]).select("tree_id", "source", "target", "value")


def saliency(tree: Tree, values: DataFrame, column: str, offsets=None, appearance: bool = False) -> DataFrame:
    """As edge_map(), but 0 within a node; appearance levels count from 1 and are lowered by it."""
    c = F.col(column).cast("double") - (1 if appearance else 0)
    v = values.select("tree_id", F.col("node_id").alias("lca"), c.alias("_v"))
    return edges(tree, offsets).join(v, ["tree_id", "lca"]).select("tree_id", "source", "target", F.when(F.col("same"), 0.0).otherwise(F.col("_v")).alias("value"), "same")


def ranked_saliency(tree: Tree, values: DataFrame, column: str, offsets=None) -> DataFrame:
    """Dense ranks of the values between different nodes, from 1 if any edge lies within a node, else from 0.
    Ranks come from the distinct values of a tree, not from a window over its edges."""
    s = saliency(tree, values, column, offsets)
    levels = s.where("NOT same").select("tree_id", "value").distinct()
    levels = levels.withColumn("_r", F.dense_rank().over(Window.partitionBy("tree_id").orderBy("value")) - 1)
    any_same = s.groupBy("tree_id").agg(F.max(F.col("same").cast("int")).alias("_s"))
    out = s.join(levels, ["tree_id", "value"], "left").join(any_same, "tree_id")
    return out.select("tree_id", "source", "target", F.when(F.col("same"), 0).otherwise(F.col("_r") + F.col("_s")).cast("double").alias("value"))


def rank_edges(edge_values: DataFrame) -> DataFrame:
    levels = edge_values.select("tree_id", "value").distinct().withColumn("_r", F.dense_rank().over(Window.partitionBy("tree_id").orderBy("value")) - 1)
    return edge_values.join(levels, ["tree_id", "value"]).select("tree_id", "source", "target", F.col("_r").cast("double").alias("value"))


def topological_levels(tree: Tree, appearance: bool = False) -> DataFrame:
    return topology(tree).select(*KEYS, (F.col("SUBTREE_HEIGHT") + (1 if appearance else 0)).alias("level"))


def topological_edge_map(tree: Tree, offsets=None) -> DataFrame:
    return ranked_saliency(tree, topological_levels(tree), "level", offsets)


def normalized_altitude_edge_map(tree: Tree, offsets=None) -> DataFrame:
    """Altitudes turned to rise towards the root and scaled to [0, 1]."""
    tree.require(monotone=True)
    a = -F.col("altitude") if tree.order == "increasing" else F.col("altitude")
    n = tree.nodes.select(*KEYS, a.alias("_a"))
    span = n.groupBy("tree_id").agg(F.min("_a").alias("_lo"), F.max("_a").alias("_hi"))
    n = n.join(span, "tree_id").select(*KEYS, F.when(F.col("_hi") > F.col("_lo"), (F.col("_a") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0).alias("_v"))
    return saliency(tree, n, "_v", offsets).drop("same")


def to_pixels(edge_values: DataFrame, pixels: DataFrame, how: str = "max") -> DataFrame:
    """Largest or mean value of the edges at each pixel; 0 where there are none."""
    ends = edge_values.select("tree_id", F.explode(F.array("source", "target")).alias("pixel"), "value")
    got = ends.groupBy("tree_id", "pixel").agg({"max": F.max, "mean": F.avg}[how]("value").alias("value"))
    return pixels.select("tree_id", "pixel").join(got, ["tree_id", "pixel"], "left").fillna(0.0, ["value"])


def threshold_cut(edge_values: DataFrame, level: float) -> DataFrame:
    return edge_values.where(F.col("value") >= level)


def node_contour_edges(tree: Tree, offsets=None) -> DataFrame:
    """Edges between different nodes, under the node where they meet."""
    return edges(tree, offsets).where("NOT same").select("tree_id", F.col("lca").alias("node_id"), "source", "target")


def contour_edges_by_node(tree: Tree, offsets=None) -> DataFrame:
    return node_contour_edges(tree, offsets).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("source", "target"))).alias("edges"))


def projected_valuation(tree: Tree, values: DataFrame, column: str, least: float | None = None, offsets=None) -> DataFrame:
    out = node_contour_edges(tree, offsets).join(values.select(*KEYS, F.col(column).alias("value")), KEYS)
    return out if least is None else out.where(F.col("value") >= least)


def contour_scores(tree: Tree, scores: DataFrame, column: str, offsets=None) -> DataFrame:
    """Largest score on the two ways from an edge's owners up to, and without, the node where they meet."""
    e = edges(tree, offsets)
    k = F.size(F.array_intersect("pu", "pv"))
    way = F.concat(F.slice("pu", k + 1, F.size("pu")), F.slice("pv", k + 1, F.size("pv")))
    rows = e.select("tree_id", "source", "target", F.explode_outer(way).alias("node_id"))
    return rows.join(scores.select(*KEYS, F.col(column).cast("double").alias("_s")), KEYS, "left").groupBy("tree_id", "source", "target").agg(F.coalesce(F.max("_s"), F.lit(0.0)).alias("value"))


def shape_space(tree: Tree, attribute: DataFrame, column: str, minima: bool = True) -> DataFrame:
    """(tree_id, node_id, score): persistence of the attribute's extrema over the tree."""
    meta = support_metadata(tree)
    packed = attribute.select(*KEYS, F.col(column).cast("double").alias("v"))
    order = meta.withColumn("_o", F.row_number().over(Window.partitionBy("tree_id").orderBy("first_pixel", "cardinality")))
    ranks = tree.with_nodes(tree.nodes.drop("sibling").join(order.select(*KEYS, F.col("_o").cast("long").alias("sibling")), KEYS))

    def run(h, a, top, nodes):
        canon = [(int(top["sibling"][i]), 0, int(top["depth"][i])) for i in range(len(a))]
        return pd.DataFrame({"node_id": nodes["node_id"], "score": K.shape_space(h, a, minima, canon)})

    return ranks.on_kernel(run, "node_id long, score double", packed, "v")


def shape_space_saliency(tree: Tree, attribute: DataFrame, column: str, minima: bool = True, offsets=None) -> DataFrame:
    return contour_scores(tree, shape_space(tree, attribute, column, minima), "score", offsets)


def watershed_saliency(tree: Tree, records: DataFrame, ranked: bool = False, offsets=None) -> DataFrame:
    """Hierarchical watershed of the leaves' extinctions: an edge's value is the persistence at which its pixels
    meet in the dendrogram of merges."""
    e = edges(tree, offsets).groupBy("tree_id").agg(F.sort_array(F.collect_list(F.struct("source", "target", "lca"))).alias("e"))
    first = tree.owners.groupBy(*KEYS).agg(F.min("pixel").alias("pixel"))
    leaf = records.select("tree_id", F.col("leaf").alias("node_id"), "extinction").join(first, KEYS).groupBy("tree_id").agg(F.collect_list("pixel").alias("lp"), F.collect_list("extinction").alias("lx"))
    o = tree.owners.groupBy("tree_id").agg(F.sort_array(F.collect_list(F.struct("pixel", "node_id"))).alias("o"))
    n = tree.nodes.groupBy("tree_id").agg(F.collect_list("node_id").alias("ids"), F.collect_list("altitude").alias("alt"))
    j = e.join(leaf, "tree_id").join(o, "tree_id").join(n, "tree_id")
    j = j.select("tree_id", F.col("e.source").alias("s"), F.col("e.target").alias("t"), F.col("e.lca").alias("m"), "lp", "lx", F.col("o.node_id").alias("own"), "ids", "alt")
    rising = tree.order == "increasing"

    def run(frames):
        import numpy as np

        for f in frames:
            for r in f.itertuples(index=False):
                number = {x: i for i, x in enumerate(r.ids)}
                h = K.Hierarchy(np.zeros(len(r.ids), int), np.array([number[x] for x in r.own]), np.asarray(r.alt))
                pairs = list(zip(map(int, r.s), map(int, r.t), strict=True))
                merges = K.watershed_dendrogram(pairs, [number[x] for x in r.m], h.owner, h, dict(zip(map(int, r.lp), map(float, r.lx), strict=True)), rising)
                level = K.dendrogram_levels(merges, len(h.owner), pairs)
                yield pd.DataFrame({"tree_id": r.tree_id, "source": [p[0] for p in pairs], "target": [p[1] for p in pairs], "value": level})

    out = j.mapInPandas(run, "tree_id string, source long, target long, value double")
    return rank_edges(out) if ranked else out


def monotone_projection(tree: Tree, extinction_attribute: DataFrame, ranked: bool = False, offsets=None) -> DataFrame:
    return ranked_saliency(tree, extinction_attribute, "extinction", offsets) if ranked else saliency(tree, extinction_attribute, "extinction", offsets).drop("same")
