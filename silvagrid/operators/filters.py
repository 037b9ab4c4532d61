"""Filters: decisions on nodes, and the images they leave. Attributes come as (tree_id, node_id, column)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silvagrid.kernels import trees as K
from silvagrid.operators.attributes import neighbourhood
from silvagrid.operators.topology import residues
from silvagrid.plans.tree import Tree

KEYS = ["tree_id", "node_id"]


def reconstruct(tree: Tree, values: DataFrame | None = None, column: str = "altitude") -> DataFrame:
    """(tree_id, pixel, value): each pixel takes its smallest node's value."""
    values = tree.nodes if values is None else values
    return tree.owners.select(*KEYS, "pixel").join(values.select(*KEYS, F.col(column).alias("value")), KEYS).select("tree_id", "pixel", "value")


def path_sums(tree: Tree, values: DataFrame, column: str) -> DataFrame:
    """Sums of a node value from the root to each node."""
    v = values.select("tree_id", F.col("node_id").alias("anc"), F.col(column).alias("_v"))
    return tree.closure().join(v, ["tree_id", "anc"]).groupBy(*KEYS).agg(F.sum("_v").alias("value"))


def reconstruct_contributions(tree: Tree, values: DataFrame, column: str) -> DataFrame:
    return reconstruct(tree, path_sums(tree, values, column), "value")


def preservation_mask(attribute: DataFrame, column: str, threshold: float) -> DataFrame:
    return attribute.select(*KEYS, (F.col(column) >= threshold).alias("keep"))


def pruning_mask(mask: DataFrame) -> DataFrame:
    return mask.select(*KEYS, (~F.col("keep")).alias("prune"))


def to_preservation(mask: DataFrame) -> DataFrame:
    return mask.select(*KEYS, (~F.col("prune")).alias("keep"))


def _nearest_kept(tree: Tree, keep: DataFrame) -> DataFrame:
    """(tree_id, node_id, altitude of the nearest ancestor-or-self that stays)."""
    up = keep.where("keep").join(tree.nodes.select(*KEYS, "altitude"), KEYS).select("tree_id", F.col("node_id").alias("anc"), F.col("altitude").alias("_a"))
    return tree.closure().join(up, ["tree_id", "anc"]).groupBy(*KEYS).agg(F.min_by("_a", "dist").alias("value"))


def direct(tree: Tree, keep: DataFrame) -> DataFrame:
    """Rejected nodes take their nearest kept ancestor's altitude. The root must be kept."""
    root = tree.nodes.where("node_id = parent_id").select(*KEYS).join(keep, KEYS).where("NOT keep")
    checked = keep.join(root.select("tree_id", F.lit(True).alias("_bad")).distinct(), "tree_id", "left")
    checked = checked.select(*KEYS, F.when(F.col("_bad"), F.raise_error(F.lit("the root must be kept")).cast("boolean")).otherwise(F.col("keep")).alias("keep"))
    return reconstruct(tree, _nearest_kept(tree, checked), "value")


def subtractive(tree: Tree, keep: DataFrame) -> DataFrame:
    """Sums of the kept nodes' residues, the root's included."""
    r = residues(tree).join(keep, KEYS).select(*KEYS, F.when(F.col("keep"), F.col("residue")).otherwise(0.0).alias("_r"))
    return reconstruct_contributions(tree, r, "_r")


def soft_subtractive(tree: Tree, scores: DataFrame, column: str) -> DataFrame:
    s = F.col(column)
    ok = F.when((s < 0) | (s > 1) | F.isnan(s), F.raise_error(F.lit("scores lie in [0, 1]")).cast("double")).otherwise(s)
    r = residues(tree).join(scores.select(*KEYS, column), KEYS).select(*KEYS, (ok * F.col("residue")).alias("_r"))
    return reconstruct_contributions(tree, r, "_r")


def pruning_min(tree: Tree, prune: DataFrame) -> DataFrame:
    """From the root down, a pruned node's whole subtree takes its parent's altitude. The root stays."""
    cut = prune.where("prune").select("tree_id", F.col("node_id").alias("anc"))
    gone = tree.closure().where("anc_depth > 0").join(cut, ["tree_id", "anc"]).select(*KEYS).distinct()
    keep = tree.nodes.select(*KEYS).join(gone.withColumn("_g", F.lit(True)), KEYS, "left").select(*KEYS, F.col("_g").isNull().alias("keep"))
    return reconstruct(tree, _nearest_kept(tree, keep), "value")


def pruning_min_by(tree: Tree, attribute: DataFrame, column: str, threshold: float) -> DataFrame:
    a = F.col(column)
    return pruning_min(tree, attribute.select(*KEYS, (~F.coalesce((a > threshold) & ~F.isnan(a.cast("double")), F.lit(False))).alias("prune")))


def pruning_max(tree: Tree, prune: DataFrame) -> DataFrame:
    """A subtree all of whose nodes are rejected collapses to the altitude of its own top."""
    whole = tree.subtree_agg(prune, F.min("prune").alias("_all")).where("_all").select("tree_id", F.col("node_id").alias("anc"))
    tops = tree.closure().join(whole, ["tree_id", "anc"]).groupBy(*KEYS).agg(F.min_by("anc", "anc_depth").alias("anc"))
    level = tree.nodes.select("tree_id", F.col("node_id").alias("anc"), F.col("altitude").alias("_a"))
    value = tree.nodes.select(*KEYS, "altitude").join(tops.join(level, ["tree_id", "anc"]), KEYS, "left").select(*KEYS, F.coalesce("_a", "altitude").alias("value"))
    return reconstruct(tree, value, "value")


def pruning_max_by(tree: Tree, attribute: DataFrame, column: str, threshold: float) -> DataFrame:
    return pruning_max(tree, attribute.select(*KEYS, (F.col(column) <= threshold).alias("prune")))


def viterbi_mask(tree: Tree, attribute: DataFrame, column: str, threshold: float) -> DataFrame:
    return tree.on_kernel(lambda h, a, top, nodes: pd.DataFrame({"node_id": nodes["node_id"], "keep": K.viterbi(h, a, threshold, top)}), "node_id long, keep boolean", attribute, column)


def viterbi(tree: Tree, attribute: DataFrame, column: str, threshold: float) -> DataFrame:
    return direct(tree, viterbi_mask(tree, attribute, column, threshold))


# ---------------------------------------------------------------- extinction


def extinction(tree: Tree, attribute: DataFrame, column: str) -> DataFrame:
    """(tree_id, leaf, cutoff_node, extinction, is_dominant, rank), the strongest first."""

    def run(h, a, top, nodes):
        ids = nodes["node_id"].to_numpy()
        rows = K.extinction(h, a, top)
        return pd.DataFrame({"leaf": [ids[r[0]] for r in rows], "cutoff_node": [ids[r[1]] for r in rows], "extinction": [r[2] for r in rows], "is_dominant": [r[3] for r in rows], "rank": range(len(rows))})

    return tree.on_kernel(run, "leaf long, cutoff_node long, extinction double, is_dominant boolean, rank int", attribute, column)


def selected(records: DataFrame, top_k: int | None = None, threshold: float | None = None) -> DataFrame:
    if (top_k is None) == (threshold is None) or (top_k is not None and top_k < 0):
        raise ValueError("give top_k, not negative, or threshold")
    return records.where(F.col("rank") < top_k) if top_k is not None else records.where(F.col("extinction") >= threshold)


def extinction_attribute(tree: Tree, records: DataFrame) -> DataFrame:
    """Largest extinction among the leaves below each node, and its dense rank."""
    per = records.select("tree_id", F.col("leaf").alias("node_id"), "extinction")
    out = tree.subtree_agg(per, F.max("extinction").alias("extinction"))
    return out.withColumn("ranked", F.dense_rank().over(Window.partitionBy("tree_id").orderBy("extinction")) - 1)


def extinction_filter(tree: Tree, records: DataFrame, **selection) -> DataFrame:
    """Selected leaves and all their ancestors stay."""
    some = selected(records, **selection).select("tree_id", F.col("leaf").alias("node_id"), F.lit(True).alias("_s"))
    stay = tree.subtree_agg(some, F.max("_s").alias("keep"))
    keep = tree.nodes.select(*KEYS, "parent_id").join(stay, KEYS, "left").select(*KEYS, (F.coalesce("keep", F.lit(False)) | (F.col("node_id") == F.col("parent_id"))).alias("keep"))
    return reconstruct(tree, _nearest_kept(tree, keep), "value")


def extinction_contours(tree: Tree, records: DataFrame, contour_pixels: DataFrame, by_rank: bool = True, **selection) -> DataFrame:
    """Contours of the cutoff nodes, painted in the order of selection; later ones cover earlier ones."""
    some = selected(records, **selection)
    n = some.groupBy("tree_id").agg(F.count(F.lit(1)).alias("_n"))
    s = some.join(n, "tree_id").withColumn("score", (F.col("_n") - F.col("rank")).cast("double") if by_rank else F.col("extinction"))
    best = s.groupBy("tree_id", F.col("cutoff_node").alias("node_id")).agg(F.max("score").alias("score"), F.min("rank").alias("order"))
    painted = best.join(contour_pixels, KEYS).groupBy("tree_id", "pixel").agg(F.max_by("score", "order").alias("value"))
    return tree.owners.select("tree_id", "pixel").join(painted, ["tree_id", "pixel"], "left").fillna(0.0, ["value"])


def ultimate_opening(tree: Tree, attribute: DataFrame, column: str, most: float, chosen: DataFrame | None = None) -> DataFrame:
    """(tree_id, pixel, contrast, associated): largest contrast of a primitive, and where it is reached."""
    if chosen is not None:
        packed = attribute.join(chosen.select(*KEYS, "selected"), KEYS, "left").select(*KEYS, F.col(column).cast("double").alias("v"), F.coalesce("selected", F.lit(False)).alias("s"))
        # the choice travels as the sign of zero's complement: v or -1 - v
        attribute, column = packed.select(*KEYS, F.when(F.col("s"), F.col("v")).otherwise(-1 - F.col("v")).alias("v")), "v"

    signed = chosen is not None

    def run(h, a, top, nodes):
        sel = None
        if signed:
            sel = a >= 0
            a = pd.Series(a).where(sel, -1 - a).to_numpy()
        c, r = K.ultimate_opening(h, a, most, sel, top)
        return pd.DataFrame({"node_id": nodes["node_id"], "contrast": c, "associated": r})

    got = tree.on_kernel(run, "node_id long, contrast double, associated long", attribute, column)
    return tree.owners.select(*KEYS, "pixel").join(got, KEYS).select("tree_id", "pixel", "contrast", "associated")


# ---------------------------------------------------------------- stability


def stability(tree: Tree, attribute: DataFrame, column: str, step: float | None = None, levels: int | None = None, max_variation: float = 10.0, min_attribute: float = 0.0, max_attribute: float | None = None) -> DataFrame:
    """(tree_id, node_id, anc, desc, variation, stable): (attribute at anc - at desc) / own; stable is a strict
    minimum against both, within the bounds. Windows by altitude step or by depth levels."""
    if (step is None) == (levels is None) or (step or levels) <= 0:
        raise ValueError("give a positive step or levels")
    a = attribute.select(*KEYS, F.col(column).cast("double").alias("_v"))
    w = neighbourhood(tree, step, levels).join(a, KEYS)
    for c in ("anc", "desc"):
        w = w.join(a.select("tree_id", F.col("node_id").alias(c), F.col("_v").alias(f"_{c}")), ["tree_id", c], "left")
    w = w.withColumn("variation", F.when(F.col("_v") > 0, (F.col("_anc") - F.col("_desc")) / F.col("_v")))
    var = w.select("tree_id", "node_id", "variation")
    for c in ("anc", "desc"):
        w = w.join(var.select("tree_id", F.col("node_id").alias(c), F.col("variation").alias(f"_w{c}")), ["tree_id", c], "left")
    area = tree.owners.groupBy("tree_id").agg(F.count(F.lit(1)).alias("_all"))
    w = w.join(area, "tree_id")
    most = F.col("_all") if max_attribute is None else F.lit(max_attribute)
    ok = (F.col("variation") < F.col("_wanc")) & (F.col("variation") < F.col("_wdesc")) & (F.col("variation") < max_variation) & (F.col("_v") >= min_attribute) & (F.col("_v") <= most)
    return w.select(*KEYS, "anc", "desc", "variation", F.col("_wanc").alias("anc_variation"), F.col("_wdesc").alias("desc_variation"), F.coalesce(ok, F.lit(False)).alias("stable"))


def adjusted_mask(tree: Tree, keep: DataFrame, stable: DataFrame) -> DataFrame:
    """Each rejection moves to the node of least variation among itself, its descendant and its ancestor, the
    first on a tie; a node without a window keeps its own."""
    inf = F.lit(float("inf"))
    v, d, a = (F.coalesce(c, inf) for c in ("variation", "desc_variation", "anc_variation"))
    to = F.when(F.col("variation").isNull(), F.col("node_id")).when((v <= d) & (v <= a), F.col("node_id")).when(d <= a, F.col("desc")).otherwise(F.col("anc"))
    hit = keep.where("NOT keep").join(stable, KEYS).select("tree_id", to.alias("node_id"), F.lit(True).alias("_h")).distinct()
    return tree.nodes.select(*KEYS).join(hit, KEYS, "left").select(*KEYS, F.col("_h").isNull().alias("keep"))
