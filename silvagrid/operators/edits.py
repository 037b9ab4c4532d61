"""Edits: a new Tree from an old one. The old one stays as it is, which is what a rollback needs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvagrid.kernels import trees as K
from silvagrid.plans.tree import Tree, _paths, from_native, max_tree, min_tree, validate
from silvagrid.sources.shared import saved

KEYS = ["tree_id", "node_id"]


def _again(tree: Tree, nodes: DataFrame, owners: DataFrame) -> Tree:
    out = from_native(nodes, owners, tree.order, tree.grid)
    about = {k: v for k, v in (tree.extra or {}).items() if k != "vertices"}  # an edited tree has left the compact layout
    return Tree(out.nodes, out.owners, tree.kind, tree.order, tree.offsets, tree.grid, about)


def prune(tree: Tree, chosen: DataFrame) -> Tree:
    """Chosen nodes (tree_id, node_id) go with all below them; their pixels fall to the nearest node that stays."""
    cut = chosen.select("tree_id", F.col("node_id").alias("anc"), F.lit(True).alias("_c"))
    gone = tree.closure().join(cut, ["tree_id", "anc"]).where("anc_depth > 0").groupBy(*KEYS).agg(F.min("anc_depth").alias("_top"))
    n = tree.nodes.join(gone, KEYS, "left")
    to = F.when(F.col("_top").isNull(), F.col("node_id")).otherwise(F.element_at("path", F.col("_top").cast("int")))
    moved = n.select(*KEYS, to.alias("_to"))
    owners = tree.owners.join(moved, KEYS).select("tree_id", "pixel", "row", "col", "value", F.col("_to").alias("node_id"))
    return _again(tree, n.where("_top IS NULL").select("tree_id", "node_id", "parent_id", "altitude"), owners)


def prune_pair(tree: Tree, chosen: DataFrame) -> tuple[Tree, Tree]:
    """A max-tree (or min-tree) pruned at the chosen nodes, and the other tree of the image that is left: both stand for
    the same pixels. The other tree is made anew, one kernel call an image; its ids are its own."""
    other = {"max": min_tree, "min": max_tree}.get(tree.kind)
    if other is None:
        raise ValueError("only max-trees and min-trees have a dual tree")
    left = prune(tree, chosen)
    levels = left.nodes.select(*KEYS, F.col("altitude").alias("_a"))
    owners = saved(left.owners.join(levels, KEYS).select("tree_id", "pixel", "row", "col", F.col("_a").alias("value"), "node_id"))
    return Tree(left.nodes, owners, left.kind, left.order, left.offsets, left.grid, left.extra), other(owners.drop("node_id").withColumnRenamed("tree_id", "image_id"), offsets=tree.offsets)


def merge_into_parent(tree: Tree, chosen: DataFrame) -> Tree:
    """Chosen nodes dissolve: their pixels and children go to the nearest ancestor that stays."""
    cut = chosen.select(*KEYS, F.lit(True).alias("_c"))
    n = tree.nodes.join(cut, KEYS, "left").withColumn("_c", F.coalesce("_c", F.lit(False)) & (F.col("node_id") != F.col("parent_id")))
    stay = n.where("NOT _c").select("tree_id", F.col("node_id").alias("anc"))
    up = tree.closure().join(stay, ["tree_id", "anc"])
    to = up.groupBy(*KEYS).agg(F.min_by("anc", "dist").alias("_to"))
    above = up.where("dist > 0").groupBy(*KEYS).agg(F.min_by("anc", "dist").alias("_up"))
    nodes = n.where("NOT _c").join(above, KEYS, "left").select("tree_id", "node_id", F.coalesce("_up", "node_id").alias("parent_id"), "altitude")
    owners = tree.owners.join(to, KEYS).select("tree_id", "pixel", "row", "col", "value", F.col("_to").alias("node_id"))
    return _again(tree, nodes, owners)


def set_altitudes(tree: Tree, values: DataFrame, column: str = "altitude") -> Tree:
    """New altitudes for the nodes of values; validate() tells whether they keep the order."""
    new = values.select(*KEYS, F.col(column).cast("double").alias("_a"))
    nodes = tree.nodes.join(new, KEYS, "left").withColumn("altitude", F.coalesce("_a", "altitude")).drop("_a")
    return tree.with_nodes(nodes.select(*tree.nodes.columns))


def commit(tree: Tree) -> Tree:
    """The tree, if all its invariants hold; else an error, and the tree it came from is untouched."""
    bad = validate(tree).where("extra_roots <> 0 OR missing_parents <> 0 OR broken_paths <> 0 OR order_breaches <> 0 OR empty_supports <> 0").limit(3).collect()
    if bad:
        raise ValueError(f"not a valid tree: {bad}")
    return tree


class Editor:
    """Staged edits over immutable tables. In between, nodes may be detached (they have no parent, and keep what is
    below them), so only commit() asks for a whole tree; prune() and merge_into_parent() need one as well."""

    def __init__(self, tree: Tree):
        self.start = tree
        self.rollback()

    def rollback(self) -> Tree:
        self.nodes = self.start.nodes.select(*KEYS, "parent_id", "altitude")
        self.owners = self.start.owners
        return self.start

    def _whole(self) -> Tree:
        return _again(self.start, self.nodes, self.owners)

    def _take(self, tree: Tree) -> Editor:
        self.nodes, self.owners = tree.nodes.select(*KEYS, "parent_id", "altitude"), tree.owners
        return self

    def _parents(self, moves: DataFrame, parent: Column) -> Editor:
        """New parents for the nodes that moves names, by node_id or by parent_id."""
        n = self.nodes.join(moves.withColumn("_hit", F.lit(True)), [c for c in moves.columns if c in self.nodes.columns], "left")
        self.nodes = saved(n.select(*KEYS, F.when(F.col("_hit"), parent).otherwise(F.col("parent_id")).alias("parent_id"), "altitude"))
        return self

    def _detached(self, chosen: DataFrame) -> None:
        if bad := chosen.join(self.nodes.where("parent_id IS NULL"), KEYS, "left_anti").limit(3).collect():
            raise ValueError(f"not detached nodes: {bad}")

    def prune(self, chosen: DataFrame) -> Editor:
        return self._take(prune(self._whole(), chosen))

    def merge_into_parent(self, chosen: DataFrame) -> Editor:
        return self._take(merge_into_parent(self._whole(), chosen))

    def reparent(self, moves: DataFrame) -> Editor:
        """moves: tree_id, node_id, new_parent; a cycle is an error."""
        self._parents(moves.select(*KEYS, "new_parent"), F.col("new_parent"))
        _paths(self.nodes.withColumn("parent_id", F.coalesce("parent_id", "node_id")))
        return self

    def detach(self, chosen: DataFrame) -> Editor:
        """chosen: tree_id, node_id; no roots."""
        if bad := self.nodes.join(chosen.select(*KEYS), KEYS, "left_semi").where("node_id = parent_id").limit(3).collect():
            raise ValueError(f"a root can't be detached: {bad}")
        return self._parents(chosen.select(*KEYS), F.lit(None).cast("long"))

    def attach(self, moves: DataFrame) -> Editor:
        """moves: tree_id, node_id (detached), new_parent."""
        self._detached(moves.select(*KEYS))
        return self.reparent(moves)

    def move_children(self, moves: DataFrame) -> Editor:
        """moves: tree_id, source, target; the children of source go under target, but for target itself. Cycles show at
        commit()."""
        staying = (F.col("node_id") == F.col("target")) | (F.col("node_id") == F.col("parent_id"))
        return self._parents(moves.select("tree_id", F.col("source").alias("parent_id"), "target"), F.when(staying, F.col("parent_id")).otherwise(F.col("target")))

    def move_pixels(self, moves: DataFrame) -> Editor:
        """moves: tree_id, pixel, new_node."""
        o = self.owners.join(moves.select("tree_id", "pixel", "new_node"), ["tree_id", "pixel"], "left")
        self.owners = saved(o.withColumn("node_id", F.coalesce("new_node", "node_id")).drop("new_node"))
        return self

    def merge_proper_parts(self, moves: DataFrame) -> Editor:
        """moves: tree_id, source, target; all pixels that source owns itself go to target."""
        to = moves.select("tree_id", F.col("source").alias("node_id"), "target")
        self.owners = saved(self.owners.join(to, KEYS, "left").withColumn("node_id", F.coalesce("target", "node_id")).select(*self.owners.columns))
        return self

    def create(self, new: DataFrame) -> Editor:
        """new: tree_id, node_id, parent_id, altitude; pixels or children must follow before commit()."""
        self.nodes = saved(self.nodes.unionByName(new.select(*KEYS, F.col("parent_id").cast("long").alias("parent_id"), F.col("altitude").cast("double").alias("altitude"))))
        return self

    def create_detached(self, new: DataFrame) -> Editor:
        """new: tree_id, node_id, altitude."""
        return self.create(new.withColumn("parent_id", F.lit(None)))

    def release(self, chosen: DataFrame) -> Editor:
        """chosen: tree_id, node_id; detached nodes without pixels or children go."""
        own = chosen.select(*KEYS)
        self._detached(own)
        below = self.nodes.select("tree_id", F.col("parent_id").alias("node_id"))
        if bad := own.join(below.union(self.owners.select(*KEYS)), KEYS, "left_semi").limit(3).collect():
            raise ValueError(f"nodes that hold pixels or children: {bad}")
        self.nodes = saved(self.nodes.join(own, KEYS, "left_anti"))
        return self

    def remove_children(self, chosen: DataFrame, release: bool = False) -> Editor:
        """chosen: tree_id, node_id; detached and, if asked for, released."""
        self.detach(chosen)
        return self.release(chosen) if release else self

    def set_root(self, chosen: DataFrame) -> Editor:
        """chosen: tree_id, node_id; the node becomes its tree's root, and the old root is detached."""
        new = chosen.select("tree_id", F.col("node_id").alias("_root"))
        n = self.nodes.join(new, "tree_id", "left")
        old = (F.col("node_id") == F.col("parent_id")) & F.col("_root").isNotNull()
        parent = F.when(F.col("node_id") == F.col("_root"), F.col("_root")).when(old, None).otherwise(F.col("parent_id"))
        self.nodes = saved(n.select(*KEYS, parent.alias("parent_id"), "altitude"))
        return self

    def set_altitudes(self, values: DataFrame) -> Editor:
        """values: tree_id, node_id, altitude."""
        new = values.select(*KEYS, F.col("altitude").cast("double").alias("_a"))
        self.nodes = saved(self.nodes.join(new, KEYS, "left").select(*KEYS, "parent_id", F.coalesce("_a", "altitude").alias("altitude")))
        return self

    def commit(self) -> Tree:
        """The tree, if all is attached and its invariants hold; the editor goes on from where it is."""
        return commit(self._whole())


# ---------------------------------------------------------------- alternating filters


def alternating(pixels: DataFrame, thresholds: list[float], measure: str = "AREA", radius: float = 1.5) -> DataFrame:
    """(image_id, pixel, value): for each threshold both trees are pruned in turn; one kernel call an image."""
    if measure not in ("AREA", "BOUNDING_BOX_WIDTH", "BOUNDING_BOX_HEIGHT", "BOUNDING_BOX_DIAGONAL"):
        raise ValueError("measure is AREA or one of the bounding box's")
    offsets = K.stencil(radius)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pixel")
        image = frame["value"].to_numpy().reshape(int(frame["row"].max()) + 1, -1)
        out = K.alternating_filter(image, thresholds, measure, offsets)
        return pd.DataFrame({"image_id": frame["image_id"].to_numpy(), "pixel": frame["pixel"].to_numpy(), "value": out.reshape(-1).astype(float)})

    return pixels.groupBy("image_id").applyInPandas(run, "image_id string, pixel long, value double")


# ---------------------------------------------------------------- compact layout


def export_compact(tree: Tree) -> DataFrame:
    """(tree_id, vertex, parent, altitude, node_id): pixels 0..P-1, then nodes so that children come before their
    parents: by altitude away from the root's end, then post-order; for other trees post-order alone."""
    p = tree.owners.groupBy("tree_id").agg(F.count(F.lit(1)).alias("_p"))
    order = {"increasing": [F.desc("altitude"), F.col("post")], "decreasing": [F.asc("altitude"), F.col("post")]}.get(tree.order, [F.col("post")])
    n = tree.nodes.join(p, "tree_id").withColumn("vertex", F.row_number().over(Window.partitionBy("tree_id").orderBy(*order)) - 1 + F.col("_p"))
    ids = n.select("tree_id", F.col("node_id").alias("parent_id"), F.col("vertex").alias("parent"))
    inner = n.join(ids, ["tree_id", "parent_id"]).select("tree_id", "vertex", "parent", "altitude", "node_id")
    units = tree.owners.select("tree_id", "pixel", "node_id").join(n.select("tree_id", "node_id", "vertex", "altitude"), KEYS).select("tree_id", F.col("pixel").cast("long").alias("vertex"), F.col("vertex").alias("parent"), "altitude", F.lit(None).cast("long").alias("node_id"))
    return units.unionByName(inner)


def import_compact(rows: DataFrame, n_pixels: int, cols: int | None, order: str = "unconstrained") -> Tree:
    """From (tree_id, vertex, parent, altitude): node_id is vertex - n_pixels."""
    nodes = rows.where(F.col("vertex") >= n_pixels).select("tree_id", (F.col("vertex") - n_pixels).alias("node_id"), (F.col("parent") - n_pixels).alias("parent_id"), "altitude")
    owners = rows.where(F.col("vertex") < n_pixels).select("tree_id", F.col("vertex").alias("pixel"), (F.col("parent") - n_pixels).alias("node_id"), F.col("altitude").cast("double").alias("value"))
    if cols:
        owners = owners.withColumn("row", F.floor(F.col("pixel") / cols).cast("int")).withColumn("col", (F.col("pixel") % cols).cast("int"))
    made = from_native(nodes, owners, order, cols is not None)
    return Tree(made.nodes, made.owners, made.kind, made.order, made.offsets, made.grid, {"vertices": n_pixels})


def as_vertices(tree: Tree, rows: DataFrame, column: str = "node_id") -> DataFrame:
    """rows with node ids in the ids of the compact layout that the tree was imported from; an error once it was edited."""
    n_pixels = (tree.extra or {}).get("vertices")
    if n_pixels is None:
        raise ValueError("the tree has no compact layout: it wasn't imported from one, or was edited since")
    return rows.withColumn(column, F.col(column) + n_pixels)


def project_compact(tree: Tree, values: DataFrame, columns: list[str], units: dict[str, float]) -> DataFrame:
    """Node values in the compact layout, with unit rows for the pixels."""
    v = export_compact(tree).join(values.select(*KEYS, *columns), KEYS, "left")
    return v.select("tree_id", "vertex", *(F.when(F.col("node_id").isNull(), F.lit(float(units[c]))).otherwise(F.col(c)).alias(c) for c in columns))
