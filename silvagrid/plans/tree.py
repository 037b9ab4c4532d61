"""A forest of hierarchies as two DataFrames, and the roll-up idioms over them.

``nodes``   tree_id, node_id, parent_id, altitude, depth, sibling, pre, size, entry, exit, post, bfs, path
``owners``  tree_id, pixel, row, col, value, node_id (the smallest node that holds the pixel)

``path`` holds the ancestors from the root to the node itself. It is short (an image's max-tree is no higher than
its number of levels), and it turns ancestor joins into an explode or an array function that needs no shuffle.
Roll-ups that have an inverse (sums, counts) use the pre-order rank instead and cost one window: a subtree is a
contiguous range of pre-order ranks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silvagrid.kernels import trees as K
from silvagrid.sources.shared import dropped, saved

NODE_COLUMNS = ("depth", "sibling", "pre", "size", "entry", "exit", "post", "bfs")
_MADE = "tree_id string, tag string, id long, ref long, altitude double, value double, row int, col int, " + ", ".join(f"{c} long" for c in NODE_COLUMNS) + ", path array<long>"


@dataclass
class Tree:
    nodes: DataFrame
    owners: DataFrame
    kind: str = "generic"
    order: str = "unconstrained"  # of altitudes from root to leaf: increasing, decreasing, unconstrained
    offsets: list | None = None
    grid: bool = True
    extra: dict = field(default_factory=dict)

    def require(self, grid: bool = False, monotone: bool = False) -> None:
        if grid and not self.grid:
            raise ValueError("this operation needs a grid")
        if monotone and self.order == "unconstrained":
            raise ValueError("this operation needs altitudes that are monotone along paths")

    def with_nodes(self, nodes: DataFrame) -> Tree:
        return Tree(nodes, self.owners, self.kind, self.order, self.offsets, self.grid, self.extra)

    # ------------------------------------------------------------ idioms

    def closure(self, *columns: str) -> DataFrame:
        """(tree_id, node_id, *columns, anc, anc_depth, dist): every node with each ancestor, itself included."""
        return self.nodes.select("tree_id", "node_id", *columns, F.col("depth").alias("own_depth"), F.posexplode("path").alias("anc_depth", "anc")).withColumn("dist", F.col("own_depth") - F.col("anc_depth"))

    def subtree_sums(self, per_node: DataFrame, columns: list[str]) -> DataFrame:
        """Sums of the columns over each node's subtree. One shuffle by tree; linear."""
        rows = self.nodes.select("tree_id", "node_id", "pre", "size").join(per_node, ["tree_id", "node_id"], "left").fillna(0, columns)
        upto = Window.partitionBy("tree_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = rows.select("tree_id", "node_id", "pre", "size", *columns, *(F.sum(c).over(upto).alias(f"_{c}") for c in columns))
        ends = sums.select("tree_id", F.col("pre").alias("_last"), *(F.col(f"_{c}").alias(f"_end_{c}") for c in columns))
        out = sums.withColumn("_last", F.col("pre") + F.col("size") - 1).join(ends, ["tree_id", "_last"])
        return out.select("tree_id", "node_id", *((F.col(f"_end_{c}") - F.col(f"_{c}") + F.col(c)).alias(c) for c in columns))

    def subtree_agg(self, per_node: DataFrame, *aggregates: Column) -> DataFrame:
        """Any aggregate over each node's subtree: rows go to all ancestors, combined on the map side."""
        rows = self.nodes.select("tree_id", "node_id", F.explode("path").alias("_anc")).join(per_node, ["tree_id", "node_id"])
        return rows.groupBy("tree_id", F.col("_anc").alias("node_id")).agg(*aggregates)

    def pixels(self, node_columns: list[str]) -> DataFrame:
        """Owners with columns of their smallest node."""
        return self.owners.join(self.nodes.select("tree_id", "node_id", *node_columns), ["tree_id", "node_id"])

    def on_kernel(self, function, schema: str, attribute: DataFrame | None = None, column: str = "value") -> DataFrame:
        """function(hierarchy, attribute, topology, frame of nodes) -> frame, once per tree."""
        rows = self.nodes.select("tree_id", "node_id", "parent_id", "altitude", *NODE_COLUMNS)
        rows = rows.join(attribute.select("tree_id", "node_id", F.col(column).cast("double").alias("attribute")), ["tree_id", "node_id"]) if attribute is not None else rows.withColumn("attribute", F.lit(0.0))
        owners = self.owners.groupBy("tree_id").agg(F.sort_array(F.collect_list(F.struct("pixel", "node_id"))).alias("_owners"))
        names = ["node_id", "parent_id", "altitude", "attribute", *NODE_COLUMNS]
        grouped = rows.groupBy("tree_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("nodes")).join(owners, "tree_id")
        grouped = grouped.select("tree_id", *(F.col(f"nodes.{c}").alias(c) for c in names), F.col("_owners.node_id").alias("owned"))

        def run(frames):
            for frame in frames:
                for i in range(len(frame)):
                    nodes = pd.DataFrame({c: np.asarray(frame[c].iloc[i]) for c in names})
                    number = {n: k for k, n in enumerate(nodes["node_id"].tolist())}
                    h = K.Hierarchy(np.array([number[p] for p in nodes["parent_id"]]), np.array([number[o] for o in frame["owned"].iloc[i]]), nodes["altitude"].to_numpy())
                    out = function(h, nodes["attribute"].to_numpy(), {c: nodes[c].to_numpy() for c in NODE_COLUMNS}, nodes)
                    out.insert(0, "tree_id", frame["tree_id"].iloc[i])
                    yield out

        return grouped.mapInPandas(run, "tree_id string, " + schema)


def _rows(tree_id: str, h: K.Hierarchy, cols: int, values: np.ndarray) -> pd.DataFrame:
    top, path = K.topology(h), K.paths(h)
    n, p = len(h.parent), len(h.owner)
    nodes = pd.DataFrame({"tag": "n", "id": np.arange(n), "ref": h.parent, "altitude": h.altitude.astype(float), "value": 0.0, "row": 0, "col": 0, **top, "path": path})
    zeros = np.zeros(p, np.int64)
    pixels = pd.DataFrame({"tag": "p", "id": np.arange(p), "ref": h.owner, "altitude": 0.0, "value": values.reshape(-1).astype(float), "row": np.arange(p) // cols, "col": np.arange(p) % cols, **dict.fromkeys(NODE_COLUMNS, zeros), "path": [None] * p})
    out = pd.concat([nodes, pixels])
    out.insert(0, "tree_id", tree_id)
    return out


def _from_kernel(made: DataFrame, **about) -> Tree:
    made = saved(made)  # both halves come from one run of the kernel
    nodes = made.where("tag = 'n'").select("tree_id", F.col("id").alias("node_id"), F.col("ref").alias("parent_id"), "altitude", *NODE_COLUMNS, "path")
    owners = made.where("tag = 'p'").select("tree_id", F.col("id").alias("pixel"), "row", "col", "value", F.col("ref").alias("node_id"))
    return Tree(nodes, owners, **about)


def _images(pixels: DataFrame, build, *columns: str | None) -> DataFrame:
    """build(image) -> hierarchy, for each image_id of (image_id, pixel, row, col, value); the columns named besides
    are handed to build in pixel order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pixel")
        rows, cols = int(frame["row"].max()) + 1, int(frame["col"].max()) + 1
        if len(frame) != rows * cols:
            raise ValueError(f"image {frame['image_id'].iloc[0]} isn't dense")
        values = frame["value"].to_numpy()
        if values.dtype.kind == "f" and not np.isfinite(values).all():
            raise ValueError("pixel values must be finite")
        image = values.reshape(rows, cols)
        return _rows(str(frame["image_id"].iloc[0]), build(image, *(frame[c].to_numpy() for c in columns if c)), cols, image)

    return pixels.groupBy("image_id").applyInPandas(run, _MADE)


def _linked(build, offsets):
    """build, for images whose pixels the offsets join into one."""

    def run(image, *more):
        if not K.connects(offsets, *image.shape):
            raise ValueError("the structuring element doesn't connect the image")
        return build(image, *more)

    return run


def max_tree(pixels: DataFrame, radius: float = 1.5, offsets=None) -> Tree:
    offsets = K.checked_stencil(offsets) if offsets else K.stencil(radius)
    return _from_kernel(_images(pixels, _linked(lambda im: K.component_tree(im, offsets, True), offsets)), kind="max", order="increasing", offsets=offsets)


def min_tree(pixels: DataFrame, radius: float = 1.5, offsets=None) -> Tree:
    offsets = K.checked_stencil(offsets) if offsets else K.stencil(radius)
    return _from_kernel(_images(pixels, _linked(lambda im: K.component_tree(im, offsets, False), offsets)), kind="min", order="decreasing", offsets=offsets)


def tree_of_shapes(pixels: DataFrame, immersion: str = "selfdual", exterior: bool = True, infinity: int = 0) -> Tree:
    if immersion not in ("selfdual", "min4max8", "min8max4"):
        raise ValueError("immersion is selfdual, min4max8 or min8max4")
    return _from_kernel(_images(pixels, lambda im: K.tree_of_shapes(im, immersion, exterior, infinity)), kind="shapes", offsets=K.stencil(1.0), extra={"immersion": immersion})


def residual_tree(pixels: DataFrame, radius: float = 1.0, saturated: bool = False, infinity: int = 0, offsets=None, place: str | None = None) -> Tree:
    """``place`` names a column with each pixel's place in the order that breaks ties: a permutation in each image."""
    offsets = K.checked_stencil(offsets) if offsets else K.stencil(radius)
    build = lambda im, at=None: K.residual_tree(im, offsets, saturated, infinity, at)[0]
    return _from_kernel(_images(pixels, _linked(build, offsets), place), kind="residual", offsets=offsets)


def _sound(base: DataFrame, owners: DataFrame) -> None:
    """An error for what no hierarchy can hold, with some of the rows."""
    one = lambda c: F.sum(F.col(c).cast("int"))
    keys = ["tree_id", "node_id"]
    trees = base.withColumn("root", F.col("node_id") == F.col("parent_id")).groupBy("tree_id").agg(one("root").alias("roots"))
    up = base.select("tree_id", F.col("node_id").alias("parent_id"))
    for what, rows in (
        ("ids that are null or an altitude that isn't finite", base.where("tree_id IS NULL OR node_id IS NULL OR parent_id IS NULL OR altitude IS NULL OR isnan(altitude) OR abs(altitude) = double('Infinity')")),
        ("repeated node ids", base.groupBy(*keys).count().where("count > 1")),
        ("trees without just one root", trees.where("roots <> 1")),
        ("parents that aren't there", base.join(up, ["tree_id", "parent_id"], "left_anti")),
        ("pixels of nodes that aren't there", owners.join(base, keys, "left_anti")),
    ):
        if bad := rows.limit(3).collect():
            raise ValueError(f"not a hierarchy: {what}: {bad}")


def _paths(base: DataFrame) -> DataFrame:
    """base with each node's path from the root. Paths double in each round: what is known of a node's way up is put
    behind what is known of the node where it ends, so a chain of n nodes takes log2(n) rounds. A round in which no
    node gets to its root shows a cycle."""
    root = F.col("node_id") == F.col("parent_id")
    now = saved(base.select("*", F.array("node_id").alias("path"), F.when(~root, F.col("parent_id")).alias("top")))
    left = now.where("top IS NOT NULL").count()
    while left:
        above = now.select("tree_id", F.col("node_id").alias("top"), F.col("path").alias("_path"), F.col("top").alias("_top"))
        done = now.where("top IS NULL")
        grown = now.where("top IS NOT NULL").join(above, ["tree_id", "top"]).select(*base.columns, F.concat("_path", "path").alias("path"), F.col("_top").alias("top"))
        after = saved(done.unionByName(grown))
        dropped(now)
        now, before = after, left
        left = now.where("top IS NOT NULL").count()
        if left >= before:
            raise ValueError(f"not a hierarchy: nodes that no root is above: {[tuple(r)[:2] for r in now.where('top IS NOT NULL').limit(3).collect()]}")
    return now.drop("top")


def from_native(nodes: DataFrame, owners: DataFrame, order: str = "unconstrained", grid: bool = False) -> Tree:
    """A hierarchy that a table already holds: nodes (tree_id, node_id, parent_id, altitude), the root its own
    parent, and owners (tree_id, pixel, node_id), of any depth. Paths come from joins, ranks from sorting paths; no
    kernel. Missing parents, repeated ids, several roots, cycles and pixels of unknown nodes are errors."""
    base, owners = saved(nodes.select("tree_id", "node_id", "parent_id", "altitude")), saved(owners)
    _sound(base, owners)
    n = _paths(base)
    kids = Window.partitionBy("tree_id", "parent_id", F.col("node_id") == F.col("parent_id")).orderBy("node_id")
    n = n.withColumn("depth", (F.size("path") - 1).cast("long")).withColumn("sibling", (F.row_number().over(kids) - 1).cast("long"))
    # children are in rising node_id, so pre-order is the order of paths, and post-order that of paths with an end mark
    order_by = Window.partitionBy("tree_id")
    n = n.withColumn("pre", (F.row_number().over(order_by.orderBy("path")) - 1).cast("long"))
    sizes = n.select("tree_id", F.explode("path").alias("node_id")).groupBy("tree_id", "node_id").agg(F.count(F.lit(1)).alias("size"))
    n = n.join(sizes, ["tree_id", "node_id"])
    n = n.withColumn("entry", 2 * F.col("pre") - F.col("depth")).withColumn("exit", F.col("entry") + 2 * F.col("size") - 1).withColumn("post", F.col("pre") + F.col("size") - 1 - F.col("depth"))
    n = n.withColumn("bfs", (F.row_number().over(order_by.orderBy("depth", "path")) - 1).cast("long"))
    n = saved(n)
    p = owners
    for c, t in (("row", "int"), ("col", "int"), ("value", "double")):
        if c not in p.columns:
            p = p.withColumn(c, F.lit(None).cast(t))
    return Tree(n.select("tree_id", "node_id", "parent_id", F.col("altitude").cast("double").alias("altitude"), *NODE_COLUMNS, "path"), p.select("tree_id", "pixel", "row", "col", "value", "node_id"), order=order, grid=grid)


def validate(tree: Tree) -> DataFrame:
    """One row per tree with the number of breaches of each invariant; all are 0 for a valid tree."""
    n = tree.nodes
    up = n.select("tree_id", F.col("node_id").alias("parent_id"), F.col("altitude").alias("_up"), F.col("depth").alias("_depth"))
    j = n.join(up, ["tree_id", "parent_id"], "left")
    inner = F.col("node_id") != F.col("parent_id")
    wrong = {"increasing": F.col("altitude") <= F.col("_up"), "decreasing": F.col("altitude") >= F.col("_up")}.get(tree.order, F.lit(False))
    own = tree.owners.groupBy("tree_id", "node_id").agg(F.count(F.lit(1)).alias("_own"))
    support = tree.subtree_agg(own, F.sum("_own").alias("_support"))
    j = j.join(support, ["tree_id", "node_id"], "left")
    one = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    return j.groupBy("tree_id").agg((F.sum(F.when(~inner, 1).otherwise(0)) - 1).alias("extra_roots"), one(F.col("_up").isNull(), "missing_parents"), one(inner & (F.col("_depth") + 1 != F.col("depth")), "broken_paths"), one(inner & wrong, "order_breaches"), one(F.coalesce("_support", F.lit(0)) == 0, "empty_supports"))


def empty_like(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], _MADE)
