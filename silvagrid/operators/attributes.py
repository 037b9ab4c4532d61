"""Node attributes: one wide projection over a few roll-ups, of which Catalyst drops what nobody asks for."""

from __future__ import annotations

import difflib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvagrid.functions.scalar import safe_divide, safe_sqrt, truncated
from silvagrid.kernels import trees as K
from silvagrid.operators.topology import lowest_common, with_parent
from silvagrid.plans.tree import Tree

KEYS = ["tree_id", "node_id"]
GROUPS = {
    "GRAY_LEVEL": ["VOLUME", "RELATIVE_VOLUME", "LEVEL", "MEAN_GRAY_LEVEL", "GRAY_LEVEL_VARIANCE", "GRAY_LEVEL_HEIGHT"],
    "BOX": ["BOX_COLUMN_MIN", "BOX_COLUMN_MAX", "BOX_ROW_MIN", "BOX_ROW_MAX", "BOX_WIDTH", "BOX_HEIGHT", "DIAGONAL_LENGTH", "RECTANGULARITY", "RATIO_WH"],
    "MOMENTS": [*(f"CENTRAL_MOMENT_{k}" for k in ("20", "02", "11", "30", "03", "21", "12")), *(f"HU_MOMENT_{k}" for k in range(1, 8)), "INERTIA", "COMPACTNESS", "ECCENTRICITY", "LENGTH_MAJOR_AXIS", "LENGTH_MINOR_AXIS", "AXIS_ORIENTATION", "CIRCULARITY"],
    "BOUNDARY": [
        *(f"BITQUAD_{k}" for k in ("AREA", "NUMBER_EULER", "NUMBER_HOLES", "PERIMETER", "PERIMETER_CONTINUOUS", "CIRCULARITY", "PERIMETER_AVERAGE", "LENGTH_AVERAGE", "WIDTH_AVERAGE")),
        *(f"CONTOUR_SIDE_{k}" for k in ("NORTH", "WEST", "EAST", "SOUTH")), "CONTOUR_PERIMETER", "CONTOUR_PIXELS",
    ],
    "TREE_TOPOLOGY": ["SUBTREE_HEIGHT", "DEPTH_NODE", "IS_LEAF_NODE", "IS_ROOT_NODE", "NUM_CHILDREN_NODE", "NUM_SIBLINGS_NODE", "NUM_DESCENDANTS_NODE", "NUM_LEAF_DESCENDANTS_NODE", "LEAF_RATIO_NODE", "BALANCE_NODE", "AVG_CHILD_HEIGHT_NODE"],
}
GROUPS["SHAPE"] = ["AREA", *GROUPS["BOX"], *GROUPS["MOMENTS"], *GROUPS["BOUNDARY"], "MAX_DIST"]
GROUPS["ALL"] = [*GROUPS["SHAPE"], *GROUPS["GRAY_LEVEL"], *GROUPS["TREE_TOPOLOGY"]]
NEEDS_GRID = frozenset(GROUPS["SHAPE"]) - {"AREA"}


def expanded(names: str | list[str]) -> list[str]:
    """Attributes of a request, groups opened, each once; an unknown name brings the nearest known ones."""
    out: dict[str, None] = {}
    for n in [names] if isinstance(names, str) else names:
        if n in GROUPS:
            out.update(dict.fromkeys(GROUPS[n]))
        elif n in GROUPS["ALL"]:
            out[n] = None
        else:
            near = difflib.get_close_matches(n, [*GROUPS, *GROUPS["ALL"]], 3)
            raise ValueError(f"no attribute {n!r}" + (f"; near it: {', '.join(near)}" if near else ""))
    return list(out)


def describe(name: str) -> dict:
    """What an attribute needs."""
    (name,) = expanded(name)
    return {"name": name, "groups": [g for g, m in GROUPS.items() if name in m], "grid": name in NEEDS_GRID, "altitude": name in GROUPS["GRAY_LEVEL"]}


def area(tree: Tree) -> DataFrame:
    own = tree.owners.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("AREA"))
    return tree.subtree_sums(own, ["AREA"])


def gray_level(tree: Tree) -> DataFrame:
    own = tree.owners.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    per = tree.nodes.join(own, KEYS, "left").select(*KEYS, "altitude", "parent_id", F.coalesce("_n", F.lit(0)).alias("_n"))
    sums = tree.subtree_sums(per.select(*KEYS, F.col("_n").alias("AREA"), (F.col("_n") * F.col("altitude")).alias("VOLUME"), (F.col("_n") * F.col("altitude") ** 2).alias("_sq")), ["AREA", "VOLUME", "_sq"])
    # what a node adds to its ancestors' relative volume, and to its own
    up = tree.nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("altitude").alias("_up"))
    step = sums.join(tree.nodes.select(*KEYS, "parent_id", "altitude"), KEYS).join(up, ["tree_id", "parent_id"]).withColumn("_rise", F.col("AREA") * F.abs(F.col("altitude") - F.col("_up")))
    rel = tree.subtree_sums(step.select(*KEYS, (F.col("AREA") + F.col("_rise")).alias("_rv")), ["_rv"])
    span = tree.subtree_agg(tree.nodes.select(*KEYS, "altitude"), F.min("altitude").alias("_lo"), F.max("altitude").alias("_hi"))
    j = step.join(rel, KEYS).join(span, KEYS)
    mean = safe_divide(F.col("VOLUME"), F.col("AREA"))
    return j.select(
        *KEYS, "AREA", "VOLUME", (F.col("_rv") - F.col("_rise")).alias("RELATIVE_VOLUME"), F.col("altitude").alias("LEVEL"), mean.alias("MEAN_GRAY_LEVEL"),
        F.greatest(F.lit(0.0), safe_divide(F.col("_sq"), F.col("AREA")) - mean * mean).alias("GRAY_LEVEL_VARIANCE"),
        F.greatest(F.abs(F.col("altitude") - F.col("_lo")), F.abs(F.col("_hi") - F.col("altitude"))).alias("GRAY_LEVEL_HEIGHT"),
    )


def box(tree: Tree) -> DataFrame:
    tree.require(grid=True)
    own = tree.owners.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"))
    b = tree.subtree_agg(own, F.sum("_n").alias("AREA"), F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.min("r0").alias("r0"), F.max("r1").alias("r1"))
    w, h = F.col("c1") - F.col("c0") + 1, F.col("r1") - F.col("r0") + 1
    return b.select(
        *KEYS, "AREA", *(F.col(a).cast("double").alias(n) for a, n in (("c0", "BOX_COLUMN_MIN"), ("c1", "BOX_COLUMN_MAX"), ("r0", "BOX_ROW_MIN"), ("r1", "BOX_ROW_MAX"))), w.cast("double").alias("BOX_WIDTH"), h.cast("double").alias("BOX_HEIGHT"),
        F.sqrt((w * w + h * h).cast("double")).alias("DIAGONAL_LENGTH"), (F.col("AREA") / (w * h)).alias("RECTANGULARITY"), (F.greatest(w, h) / F.least(w, h)).alias("RATIO_WH"),
    )


def moments(tree: Tree) -> DataFrame:
    """x is the column, y the row. Raw sums are exact whole numbers; they are expanded about the centroid in double."""
    tree.require(grid=True)
    x, y = F.col("col").cast("long"), F.col("row").cast("long")
    raw = {"m00": F.lit(1), "m10": x, "m01": y, "m20": x * x, "m02": y * y, "m11": x * y, "m30": x * x * x, "m03": y * y * y, "m21": x * x * y, "m12": x * y * y}
    own = tree.owners.groupBy(*KEYS).agg(*(F.sum(e).alias(k) for k, e in raw.items()))
    s = tree.subtree_sums(own, list(raw))
    m = {k: F.col(k).cast("double") for k in raw}
    s = s.withColumn("cx", m["m10"] / m["m00"]).withColumn("cy", m["m01"] / m["m00"])
    cx, cy = F.col("cx"), F.col("cy")
    mu = {
        "20": m["m20"] - cx * m["m10"], "02": m["m02"] - cy * m["m01"], "11": m["m11"] - cx * m["m01"],
        "30": m["m30"] - 3 * cx * m["m20"] + 2 * cx * cx * m["m10"], "03": m["m03"] - 3 * cy * m["m02"] + 2 * cy * cy * m["m01"],
        "21": m["m21"] - 2 * cx * m["m11"] - cy * m["m20"] + 2 * cx * cx * m["m01"], "12": m["m12"] - 2 * cy * m["m11"] - cx * m["m02"] + 2 * cy * cy * m["m10"],
    }
    s = s.select(*KEYS, F.col("m00").alias("AREA"), *(e.alias(f"CENTRAL_MOMENT_{k}") for k, e in mu.items()))
    a = F.col("AREA").cast("double")
    c = {k: F.col(f"CENTRAL_MOMENT_{k}") for k in mu}
    n = {k: c[k] / a ** ((int(k[0]) + int(k[1]) + 2) / 2) for k in mu}
    p, q, r, t = n["30"] + n["12"], n["21"] + n["03"], n["30"] - 3 * n["12"], 3 * n["21"] - n["03"]
    hu = [
        n["20"] + n["02"], (n["20"] - n["02"]) ** 2 + 4 * n["11"] ** 2, r**2 + t**2, p**2 + q**2, r * p * (p**2 - 3 * q**2) + t * q * (3 * p**2 - q**2),
        (n["20"] - n["02"]) * (p**2 - q**2) + 4 * n["11"] * p * q, t * p * (p**2 - 3 * q**2) - r * q * (3 * p**2 - q**2),
    ]
    both, diff = c["20"] + c["02"], F.sqrt((c["20"] - c["02"]) ** 2 + 4 * c["11"] ** 2)
    l1, l2 = both + diff, both - diff
    eps = 1e-9
    round_ = (F.abs(l1) <= eps) & (F.abs(l2) <= eps)
    even = (F.abs(c["11"]) <= eps) & (F.abs(c["20"] - c["02"]) <= eps)
    return s.select(
        *KEYS, "AREA", *(F.col(f"CENTRAL_MOMENT_{k}") for k in mu), *(e.alias(f"HU_MOMENT_{i + 1}") for i, e in enumerate(hu)), ((c["20"] + c["02"]) / (a * a)).alias("INERTIA"),
        safe_divide(a, 2 * math.pi * both).alias("COMPACTNESS"), safe_sqrt(2 * l1 / a).alias("LENGTH_MAJOR_AXIS"), safe_sqrt(2 * l2 / a).alias("LENGTH_MINOR_AXIS"),
        F.when(round_, 1.0).when(l2 <= eps, 1e6).otherwise(F.least(l1 / F.when(l2 > eps, l2).otherwise(1.0), F.lit(1e6))).alias("ECCENTRICITY"),
        F.when(even, 0.0).otherwise(F.abs(F.atan2(2 * c["11"], c["20"] - c["02"]) / 2 * 180 / math.pi) % 360).alias("AXIS_ORIENTATION"),
        F.when(round_, 1.0).when((l1 <= eps) | (l2 <= eps), 0.0).otherwise(l2 / F.when(l1 > eps, l1).otherwise(1.0)).alias("CIRCULARITY"),
    )


SIDES = {"NORTH": (-1, 0), "WEST": (0, -1), "EAST": (0, 1), "SOUTH": (1, 0)}


def beside(tree: Tree, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each pixel with its place's owner path, and per offset the deepest node that holds it and that neighbour
    too (null outside the image): (tree_id, pixel, node_id, path, side, meet)."""
    tree.require(grid=True)
    p = tree.pixels(["path"]).select("tree_id", "pixel", "row", "col", "node_id", "path")
    o = p.select("*", F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for i, (dr, dc) in enumerate(offsets)))).alias("o"))
    o = o.select("tree_id", "pixel", "node_id", "path", "o.side", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
    q = p.select("tree_id", "row", "col", F.col("path").alias("other"), F.col("pixel").alias("neighbour"))
    return o.join(q, ["tree_id", "row", "col"], "left").select("tree_id", "pixel", "node_id", "path", "side", "neighbour", F.when(F.col("other").isNotNull(), lowest_common("path", "other")).alias("meet"))


def contour(tree: Tree) -> DataFrame:
    """Exposed sides and contour pixels by events: a pixel's side shows from its owner up to below the node where
    it meets its neighbour."""
    names = list(SIDES)
    b = beside(tree, list(SIDES.values()))
    on = b.groupBy("tree_id", "node_id", "side").agg(F.count(F.lit(1)).alias("d"))
    off = b.where("meet IS NOT NULL").groupBy("tree_id", F.col("meet").alias("node_id"), "side").agg((-F.count(F.lit(1))).alias("d"))
    per = on.union(off).groupBy(*KEYS).agg(*(F.sum(F.when(F.col("side") == i, F.col("d")).otherwise(0)).alias(f"CONTOUR_SIDE_{n}") for i, n in enumerate(names)))
    depth = tree.nodes.select("tree_id", F.col("node_id").alias("meet"), F.col("depth").alias("_d"))
    outer = b.where("meet IS NOT NULL").join(depth, ["tree_id", "meet"]).groupBy("tree_id", "pixel").agg(F.count(F.lit(1)).alias("n"), F.min_by("meet", "_d").alias("node_id")).where("n = 4")
    pix = tree.owners.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("d")).union(outer.groupBy(*KEYS).agg((-F.count(F.lit(1))).alias("d"))).groupBy(*KEYS).agg(F.sum("d").alias("CONTOUR_PIXELS"))
    cols = [f"CONTOUR_SIDE_{n}" for n in names]
    all_ = tree.nodes.select(*KEYS).join(per, KEYS, "left").join(pix, KEYS, "left").fillna(0)
    s = tree.subtree_sums(all_, [*cols, "CONTOUR_PIXELS"])
    return s.select(*KEYS, *cols, sum((F.col(c) for c in cols[1:]), F.col(cols[0])).alias("CONTOUR_PERIMETER"), "CONTOUR_PIXELS")


def _bitquad_states(tree: Tree) -> DataFrame:
    """(tree_id, node_id, code, n): 2x2 cells of the framed image by what of them a node holds (1 top left, 2 top
    right, 4 bottom left, 8 bottom right). A cell counts for the ancestors of its pixels' owners; equal sets of owners
    are counted once, with their number."""
    tree.require(grid=True)
    p = tree.owners.select("tree_id", "row", "col", "node_id")
    corners = F.array(*(F.struct(F.lit(bit).alias("bit"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for bit, dr, dc in ((8, 0, 0), (4, 0, 1), (2, 1, 0), (1, 1, 1))))
    c = p.select("*", F.explode(corners).alias("k")).select("tree_id", (F.col("row") + F.col("k.dr")).alias("cr"), (F.col("col") + F.col("k.dc")).alias("cc"), "k.bit", "node_id")
    cells = c.groupBy("tree_id", "cr", "cc").agg(F.sort_array(F.collect_list(F.struct("bit", "node_id"))).alias("who")).groupBy("tree_id", "who").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("cell", F.xxhash64("who"))
    rows = cells.select("tree_id", "who", "n", F.explode("who").alias("k")).join(tree.nodes.select("tree_id", F.col("node_id").alias("_n"), "path"), (cells.tree_id == tree.nodes.tree_id) & (F.col("k.node_id") == F.col("_n"))).drop(tree.nodes.tree_id)
    return rows.select("tree_id", "who", "n", "k.bit", F.explode("path").alias("node_id")).groupBy("tree_id", "who", "n", "node_id").agg(F.sum("bit").alias("code"))


def bitquad_histogram(tree: Tree) -> DataFrame:
    """h0 .. h15: the framed image's 2x2 cells in each state of a node's support; h0 is what the others leave."""
    bins = [F.sum(F.when(F.col("code") == k, F.col("n")).otherwise(0)).alias(f"h{k}") for k in range(1, 16)]
    held = _bitquad_states(tree).groupBy(*KEYS).agg(F.sum("n").alias("_all"), *bins)
    size = tree.owners.groupBy("tree_id").agg(((F.max("row") + 2) * (F.max("col") + 2)).cast("long").alias("_cells"))
    return held.join(size, "tree_id").select(*KEYS, (F.col("_cells") - F.col("_all")).alias("h0"), *(f"h{k}" for k in range(1, 16)))


def bitquad_counts(tree: Tree) -> DataFrame:
    """q1, q2, qd, q3, q4 of each support: the states by the number of pixels, diagonals apart."""
    states = _bitquad_states(tree)
    bits = F.bit_count("code")
    diagonal = F.col("code").isin(6, 9)
    count = lambda cond, name: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name)
    return states.groupBy(*KEYS).agg(count(bits == 1, "q1"), count((bits == 2) & ~diagonal, "q2"), count(diagonal, "qd"), count(bits == 3, "q3"), count(bits == 4, "q4"))


def _eight(tree: Tree) -> DataFrame | bool:
    """Whether supports hang together over corners too: as the tree was built; in a tree of shapes by polarity, and
    over corners at a root whose shapes differ. As rows (tree_id, node_id, eight) where nodes differ."""
    if tree.kind == "shapes":
        lower, upper = {"min4max8": (False, True), "min8max4": (True, False)}.get(tree.extra.get("immersion"), (False, False))
        if lower == upper:
            return lower
        up = F.col("altitude") > F.col("parent_altitude")
        root = F.col("node_id") == F.col("parent_id")
        return with_parent(tree, "altitude").select(*KEYS, F.when(root, True).when(up, F.lit(upper)).otherwise(F.lit(lower)).alias("eight"))
    for radius, eight in ((1.0, False), (1.5, True)):
        if tree.offsets is not None and set(map(tuple, tree.offsets)) == set(K.stencil(radius)):
            return eight
    raise ValueError("bitquad attributes need a tree of 4- or 8-connected pixels, or a choice of eight")


def bitquad(tree: Tree, eight: bool | None = None) -> DataFrame:
    """Scalars of the bitquad counts. ``eight`` sets the connectivity; None takes it from how the tree was built."""
    b, how = bitquad_counts(tree), _eight(tree) if eight is None else eight
    b, eight = (b.withColumn("eight", F.lit(how)), F.col("eight")) if isinstance(how, bool) else (b.join(how, KEYS), F.col("eight"))
    q1, q2, qd, q3, q4 = (F.col(c).cast("double") for c in ("q1", "q2", "qd", "q3", "q4"))
    zero = F.lit(0.0)
    c14, c1, cd = (F.when(eight, a).otherwise(b) for a, b in ((zero, q1 + 2 * qd), (q1, zero), (qd, zero)))
    euler = truncated((c14 - q3) / 4).cast("double")
    area_, per, cont = c1 / 4 + q2 / 2 + q3 * 7 / 8 + q4 + cd * 3 / 4, c1 + q2 + q3 + 2 * cd, q2 + (c1 + q3) / 1.5
    return b.select(
        *KEYS, area_.alias("BITQUAD_AREA"), euler.alias("BITQUAD_NUMBER_EULER"), (1 - euler).alias("BITQUAD_NUMBER_HOLES"), per.alias("BITQUAD_PERIMETER"), cont.alias("BITQUAD_PERIMETER_CONTINUOUS"),
        safe_divide(4 * math.pi * area_, cont * cont).alias("BITQUAD_CIRCULARITY"), safe_divide(cont, euler).alias("BITQUAD_PERIMETER_AVERAGE"), safe_divide(cont, 2 * euler).alias("BITQUAD_LENGTH_AVERAGE"), safe_divide(2 * area_, cont).alias("BITQUAD_WIDTH_AVERAGE"),
    )


def topology(tree: Tree) -> DataFrame:
    n = tree.nodes.select(*KEYS, "parent_id", "depth", "size")
    deep = tree.subtree_agg(n.select(*KEYS, "depth"), F.max("depth").alias("_deep"))
    leaf = tree.subtree_sums(n.select(*KEYS, (F.col("size") == 1).cast("long").alias("_leaves")), ["_leaves"])
    n = n.join(deep, KEYS).join(leaf, KEYS).withColumn("_h", F.col("_deep") - F.col("depth"))
    kids = n.where("node_id <> parent_id").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("_k"), F.max("_h").alias("_hi"), F.min("_h").alias("_lo"), F.avg("_h").alias("_mean"))
    same = Window.partitionBy("tree_id", "parent_id", F.col("node_id") == F.col("parent_id"))
    n = n.withColumn("_sib", F.count(F.lit(1)).over(same) - 1).join(kids, KEYS, "left")
    d = lambda c: c.cast("double")
    return n.select(
        *KEYS, d(F.col("_h")).alias("SUBTREE_HEIGHT"), d(F.col("depth")).alias("DEPTH_NODE"), d(F.col("size") == 1).alias("IS_LEAF_NODE"), d(F.col("node_id") == F.col("parent_id")).alias("IS_ROOT_NODE"), d(F.coalesce("_k", F.lit(0))).alias("NUM_CHILDREN_NODE"),
        d(F.col("_sib")).alias("NUM_SIBLINGS_NODE"), d(F.col("size") - 1).alias("NUM_DESCENDANTS_NODE"), d(F.col("_leaves")).alias("NUM_LEAF_DESCENDANTS_NODE"), (F.col("_leaves") / F.col("size")).alias("LEAF_RATIO_NODE"),
        d(F.coalesce(F.col("_hi") - F.col("_lo"), F.lit(0))).alias("BALANCE_NODE"), F.coalesce("_mean", F.lit(0.0)).alias("AVG_CHILD_HEIGHT_NODE"),
    )


def max_dist(tree: Tree) -> DataFrame:
    """Largest squared distance of a support's pixels to its contour (exact distances)."""
    tree.require(grid=True)
    size = tree.owners.groupBy("tree_id").agg(F.max("row").alias("rows"), F.max("col").alias("cols"))

    def run(h, _, __, nodes):
        cols = int(nodes["attribute"].iloc[0])
        return pd.DataFrame({"node_id": nodes["node_id"], "MAX_DIST": K.max_distance(-(-len(h.owner) // cols), cols, K.supports(h))})

    wide = tree.nodes.select(*KEYS).join(size, "tree_id").select(*KEYS, (F.col("cols") + 1).alias("value"))
    return tree.on_kernel(run, "node_id long, MAX_DIST double", wide)


FAMILIES = ((area, ["AREA"]), (gray_level, GROUPS["GRAY_LEVEL"]), (box, GROUPS["BOX"]), (moments, GROUPS["MOMENTS"]), (bitquad, [a for a in GROUPS["BOUNDARY"] if a.startswith("BIT")]), (contour, [a for a in GROUPS["BOUNDARY"] if a.startswith("CON")]), (topology, GROUPS["TREE_TOPOLOGY"]), (max_dist, ["MAX_DIST"]))


def compute(tree: Tree, names: str | list[str], dtype: str = "double") -> DataFrame:
    """(tree_id, node_id, one column per attribute). Only families that are asked for are planned."""
    wanted = expanded(names)
    if any(w in NEEDS_GRID for w in wanted):
        tree.require(grid=True)
    out = tree.nodes.select(*KEYS)
    for make, members in FAMILIES:
        if own := [w for w in wanted if w in members]:
            out = out.join(make(tree).select(*KEYS, *own), KEYS)
    return out.select(*KEYS, *(F.col(w).cast(dtype).alias(w) for w in wanted))


def unit_rows(names: str | list[str], eight: bool = True) -> dict[str, float]:
    """Attributes of a single pixel (altitude-bound ones with altitude 0), for the compact layout's pixel rows."""
    ones = {"AREA": 1, "RELATIVE_VOLUME": 1, "BOX_WIDTH": 1, "BOX_HEIGHT": 1, "DIAGONAL_LENGTH": math.sqrt(2), "RECTANGULARITY": 1, "RATIO_WH": 1, "ECCENTRICITY": 1, "CIRCULARITY": 1, "IS_LEAF_NODE": 1, "NUM_LEAF_DESCENDANTS_NODE": 1, "LEAF_RATIO_NODE": 1, "CONTOUR_PERIMETER": 4, "CONTOUR_PIXELS": 1, **{f"CONTOUR_SIDE_{s}": 1 for s in SIDES}}
    quads = {"BITQUAD_AREA": 1, "BITQUAD_NUMBER_HOLES": 1, "BITQUAD_PERIMETER": 4, "BITQUAD_PERIMETER_CONTINUOUS": 8 / 3, "BITQUAD_CIRCULARITY": 9 * math.pi / 16, "BITQUAD_WIDTH_AVERAGE": 0.75} if eight else {"BITQUAD_NUMBER_EULER": 1}
    return {n: float((ones | quads).get(n, 0)) for n in expanded(names)}


def mapped(tree: Tree, attributes: DataFrame, name: str) -> DataFrame:
    """An attribute as an image: each pixel gets its smallest node's value."""
    return tree.owners.select("tree_id", "pixel", *KEYS[1:]).join(attributes.select(*KEYS, name), KEYS).select("tree_id", "pixel", F.col(name).alias("value"))


def sampled(tree: Tree, attribute: DataFrame, name: str, step: float, radius: int, missing: str = "repeat") -> DataFrame:
    """The attribute at ancestors and descendants k altitude steps away, k up to radius: columns <name>,
    <name>_ANCESTOR_k and <name>_DESCENDANT_k. An ancestor is the first one whose altitude differs by k steps or
    more; of the nodes whose ancestor is this one, the descendant is the one with the largest support, ties to the
    smallest pixel. Where there is none: repeat the step before, nan, or zero."""
    if step <= 0 or radius < 0 or missing not in ("repeat", "nan", "zero"):
        raise ValueError("step is positive, radius isn't negative, missing is repeat, nan or zero")
    if radius:
        tree.require(monotone=True)
    out = attribute.select(*KEYS, F.col(name).cast("double").alias(name))
    value = out.select("tree_id", F.col("node_id").alias("_at"), F.col(name).alias("_v"))
    for k in range(1, radius + 1):
        reach = neighbourhood(tree, k * step)
        for side, col in (("ANCESTOR", "anc"), ("DESCENDANT", "desc")):
            got = reach.select(*KEYS, F.col(col).alias("_at")).join(value, ["tree_id", "_at"]).select(*KEYS, F.col("_v").alias(f"{name}_{side}_{k}"))
            out = out.join(got, KEYS, "left")
            before = F.col(name if k == 1 else f"{name}_{side}_{k - 1}")
            out = out.withColumn(f"{name}_{side}_{k}", F.coalesce(f"{name}_{side}_{k}", {"repeat": before, "nan": F.lit(float("nan")), "zero": F.lit(0.0)}[missing]))
    return out


def neighbourhood(tree: Tree, step: float | None = None, levels: int | None = None) -> DataFrame:
    """(tree_id, node_id, anc, desc): the ancestor at an altitude or depth distance, and the representative
    descendant (largest support, then smallest pixel); null where there is none."""
    if step is not None:
        a = tree.closure("altitude").where("dist > 0").join(tree.nodes.select("tree_id", F.col("node_id").alias("anc"), F.col("altitude").alias("_up")), ["tree_id", "anc"])
        up = a.where(F.abs(F.col("altitude") - F.col("_up")) >= step).groupBy(*KEYS).agg(F.min_by("anc", "dist").alias("anc"))
    else:
        up = tree.closure().where(F.col("dist") == levels).select(*KEYS, "anc")
    own = tree.owners.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.min("pixel").alias("_p"))
    size = tree.subtree_agg(own, F.sum("_n").alias("_n"), F.min("_p").alias("_p"))
    down = up.join(size, KEYS).groupBy("tree_id", F.col("anc").alias("node_id")).agg(F.max_by("node_id", F.struct(F.col("_n"), -F.col("_p"))).alias("desc"))
    return tree.nodes.select(*KEYS).join(up, KEYS, "left").join(down, KEYS, "left")


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
