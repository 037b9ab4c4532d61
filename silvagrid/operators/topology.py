"""Topology queries over a Tree; each returns a DataFrame for all trees at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvagrid.plans.tree import Tree

KEYS = ["tree_id", "node_id"]


def children(tree: Tree) -> DataFrame:
    """tree_id, node_id, children (by sibling rank), n_children, first_child."""
    kids = tree.nodes.where("node_id <> parent_id").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.sort_array(F.collect_list(F.struct("sibling", F.col("node_id").alias("child")))).alias("k"))
    out = tree.nodes.select(*KEYS).join(kids, KEYS, "left").withColumn("k", F.coalesce("k", F.array().cast("array<struct<sibling: long, child: long>>")))
    return out.select(*KEYS, F.col("k.child").alias("children"), F.size("k").cast("long").alias("n_children"), F.get(F.col("k.child"), F.lit(0)).alias("first_child"))


def siblings(tree: Tree) -> DataFrame:
    """tree_id, node_id, n_siblings, next_sibling."""
    w = Window.partitionBy("tree_id", "parent_id", F.col("node_id") == F.col("parent_id"))
    return tree.nodes.select(*KEYS, (F.count(F.lit(1)).over(w) - 1).alias("n_siblings"), F.lead("node_id").over(w.orderBy("sibling")).alias("next_sibling"))


def leaves(tree: Tree) -> DataFrame:
    """Leaves, with their rank in breadth-first order."""
    return tree.nodes.where("size = 1").select(*KEYS, F.row_number().over(Window.partitionBy("tree_id").orderBy("bfs")).alias("leaf_rank"))


def ancestors(tree: Tree) -> DataFrame:
    """(tree_id, node_id, anc, dist), the node itself at dist 0."""
    return tree.closure().select(*KEYS, "anc", "dist")


def descendants(tree: Tree, strict: bool = True) -> DataFrame:
    c = tree.closure().select("tree_id", F.col("anc").alias("node_id"), F.col("node_id").alias("descendant"), "dist")
    return c.where("dist > 0") if strict else c


def lowest_common(path_u: str | Column, path_v: str | Column) -> Column:
    """The deepest ancestor that two paths share: paths begin at the root, so what they share is a prefix."""
    return F.element_at(path_u, F.size(F.array_intersect(path_u, path_v)))


def lca(tree: Tree, pairs: DataFrame) -> DataFrame:
    """pairs (tree_id, u, v) with lca."""
    n = tree.nodes.select("tree_id", "node_id", "path")
    j = pairs.join(n.withColumnsRenamed({"node_id": "u", "path": "_pu"}), ["tree_id", "u"]).join(n.withColumnsRenamed({"node_id": "v", "path": "_pv"}), ["tree_id", "v"])
    return j.withColumn("lca", lowest_common("_pu", "_pv")).drop("_pu", "_pv")


def paths_between(tree: Tree, pairs: DataFrame) -> DataFrame:
    """pairs (tree_id, u, v) with path: from u up to the common ancestor and down to v."""
    n = tree.nodes.select("tree_id", "node_id", "path")
    j = pairs.join(n.withColumnsRenamed({"node_id": "u", "path": "_pu"}), ["tree_id", "u"]).join(n.withColumnsRenamed({"node_id": "v", "path": "_pv"}), ["tree_id", "v"])
    k = F.size(F.array_intersect("_pu", "_pv"))
    up = F.reverse(F.slice("_pu", k, F.size("_pu") - k + 1))
    return j.select("tree_id", "u", "v", F.concat(up, F.slice("_pv", k + 1, F.size("_pv"))).alias("path"))


def is_ancestor(entry_u: Column, exit_u: Column, entry_v: Column, exit_v: Column, strict: bool = False) -> Column:
    """Whether u holds v, from the shared event counter."""
    return (entry_u < entry_v) & (exit_u > exit_v) if strict else (entry_u <= entry_v) & (exit_u >= exit_v)


def supports(tree: Tree) -> DataFrame:
    """(tree_id, node_id, pixel): every node with every pixel of its support."""
    return tree.owners.join(tree.nodes.select("tree_id", "node_id", "path"), KEYS).select("tree_id", F.explode("path").alias("node_id"), "pixel")


def reconstruct_node(tree: Tree, node: int) -> DataFrame:
    """Binary image of one node's support."""
    inside = F.array_contains("path", F.lit(node).cast("long")).cast("int").alias("value")
    return tree.pixels(["path"]).select("tree_id", "pixel", inside)


def proper_parts(tree: Tree) -> DataFrame:
    """(tree_id, node_id, proper, empty): pixels that no child holds."""
    own = tree.owners.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("proper"))
    out = tree.nodes.select(*KEYS).join(own, KEYS, "left")
    return out.select(*KEYS, F.coalesce("proper", F.lit(0)).cast("long").alias("proper"), F.col("proper").isNull().alias("empty"))


def support_metadata(tree: Tree) -> DataFrame:
    """(tree_id, node_id, cardinality, first_pixel)."""
    own = tree.owners.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.min("pixel").alias("_p"))
    return tree.subtree_agg(own, F.sum("_n").alias("cardinality"), F.min("_p").alias("first_pixel"))


def counts(tree: Tree) -> DataFrame:
    n = tree.nodes.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum((F.col("size") == 1).cast("long")).alias("n_leaves"), F.max("depth").alias("height"))
    return n.join(tree.owners.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_pixels")), "tree_id")


def residues(tree: Tree) -> DataFrame:
    """(tree_id, node_id, residue): the root's altitude, or the altitude less the parent's."""
    up = tree.nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("altitude").alias("_up"))
    return tree.nodes.join(up, ["tree_id", "parent_id"]).select(*KEYS, F.when(F.col("node_id") == F.col("parent_id"), F.col("altitude")).otherwise(F.col("altitude") - F.col("_up")).alias("residue"))


def with_parent(tree: Tree, *columns: str) -> DataFrame:
    """Nodes with columns of their parent, as parent_<column>."""
    up = tree.nodes.select("tree_id", F.col("node_id").alias("parent_id"), *(F.col(c).alias(f"parent_{c}") for c in columns))
    return tree.nodes.join(up, ["tree_id", "parent_id"])


def polarity(tree: Tree) -> DataFrame:
    """Shapes brighter (upper) or darker (lower) than their parent; none at the root."""
    a, b = F.col("altitude"), F.col("parent_altitude")
    return with_parent(tree, "altitude").select(*KEYS, F.when(F.col("node_id") == F.col("parent_id"), None).when(a > b, "upper").when(a < b, "lower").alias("polarity"))
