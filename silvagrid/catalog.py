"""Named queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvagrid.kernels import trees as K
from silvagrid.operators import attributes as A
from silvagrid.operators import contours as C
from silvagrid.operators import edits as E
from silvagrid.operators import filters as X
from silvagrid.operators import local as L
from silvagrid.operators import saliency as S
from silvagrid.operators import topology as T
from silvagrid.plans import tree as P
from silvagrid.sources import raster as R
from silvagrid.streaming import images as I

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------- the SQL that trees are recomputed with

_PX = """cells AS (SELECT i AS p, i // 16 AS r, i % 16 AS c FROM range(256) t(i)),
val AS (SELECT l_partkey % 16 AS r, l_suppkey % 16 AS c, CAST(floor(sum(l_quantity)) AS BIGINT) % 8 AS v FROM lineitem GROUP BY 1, 2),
px AS (SELECT cells.p, cells.r, cells.c, {sign} * coalesce(val.v, 0) AS v FROM cells LEFT JOIN val ON cells.r = val.r AND cells.c = val.c)"""
_TREE = """, adj AS (SELECT a.p, b.p AS q, least(a.v, b.v) AS lv FROM px a JOIN px b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.p <> b.p),
lvs AS (SELECT DISTINCT v AS t FROM px),
reach AS (SELECT lvs.t, px.p, px.p AS root FROM px JOIN lvs ON px.v >= lvs.t UNION SELECT reach.t, adj.q, reach.root FROM reach JOIN adj ON adj.p = reach.p AND adj.lv >= reach.t AND reach.root < adj.q),
comp AS (SELECT t, p, min(root) AS k FROM reach GROUP BY t, p),
nd AS (SELECT comp.t, comp.k, min(px.p) AS mpp FROM comp JOIN px ON px.p = comp.p AND px.v = comp.t GROUP BY 1, 2),
nodes0 AS (SELECT row_number() OVER (ORDER BY t, mpp) - 1 AS node_id, t, k, mpp FROM nd),
anc0 AS (SELECT d.node_id, a.node_id AS anc, a.t AS anc_t FROM nodes0 d JOIN comp ON comp.p = d.mpp AND comp.t <= d.t JOIN nodes0 a ON a.t = comp.t AND a.k = comp.k),
anc AS (SELECT node_id, anc, row_number() OVER (PARTITION BY node_id ORDER BY anc_t) - 1 AS anc_depth, row_number() OVER (PARTITION BY node_id ORDER BY anc_t DESC) - 1 AS dist FROM anc0),
nodes AS (SELECT n.node_id, coalesce(u.anc, n.node_id) AS parent_id, CAST({sign} * n.t AS DOUBLE) AS altitude, d.anc_depth AS depth
 FROM nodes0 n JOIN anc d ON d.node_id = n.node_id AND d.dist = 0 LEFT JOIN anc u ON u.node_id = n.node_id AND u.dist = 1),
own AS (SELECT px.p, px.r, px.c, {sign} * px.v AS v, n.node_id FROM px JOIN comp ON comp.p = px.p AND comp.t = px.v JOIN nodes0 n ON n.t = px.v AND n.k = comp.k),
sup AS (SELECT a.anc AS node_id, o.p, o.r, o.c, o.v FROM own o JOIN anc a ON a.node_id = o.node_id),
kids AS (SELECT parent_id AS node_id, node_id AS kid FROM nodes WHERE node_id <> parent_id),
area AS (SELECT node_id, count(*) AS n, min(p) AS mp FROM sup GROUP BY 1)"""
MAX = "WITH RECURSIVE " + (_PX + _TREE).format(sign="1")
MIN = "WITH RECURSIVE " + (_PX + _TREE).format(sign="-1")


def _left(most: int, of: int = 0, sign: int = 1) -> str:
    """CTEs for the image without the nodes of tree number ``of`` with an area up to ``most``, and for its next tree."""
    old, new = (str(x) if x else "" for x in (of, of + 1))
    image = f""", px{new} AS (SELECT o.p, o.r, o.c, CAST({sign} * arg_min(n.altitude, a.dist) AS BIGINT) AS v FROM own{old} o JOIN anc{old} a USING (node_id)
JOIN nodes{old} n ON n.node_id = a.anc{old} JOIN area{old} ar ON ar.node_id = n.node_id WHERE ar.n > {most} OR n.depth = 0 GROUP BY 1, 2, 3)"""
    return image + re.sub(r"\b(px|adj|lvs|reach|comp|nd|nodes0|nodes|anc0|anc|own|sup|kids|area)\b", rf"\g<1>{new}", _TREE.format(sign=sign))


WORLD = """WITH own AS (SELECT o_orderkey AS p, o_custkey + 1000 AS node_id FROM orders),
cust AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)),
nat AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM cust)),
reg AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nat)),
nodes AS (SELECT CAST(0 AS BIGINT) AS node_id, CAST(0 AS BIGINT) AS parent_id, CAST(0 AS DOUBLE) AS altitude, CAST(0 AS BIGINT) AS depth
 UNION ALL SELECT r_regionkey + 1, 0, r_regionkey + 10, 1 FROM reg UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, n_nationkey + 100, 2 FROM nat
 UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, c_custkey % 50 + 1000, 3 FROM cust),
up AS (SELECT a.node_id, a.parent_id AS p1, b.parent_id AS p2, c.parent_id AS p3, a.depth FROM nodes a JOIN nodes b ON b.node_id = a.parent_id JOIN nodes c ON c.node_id = b.parent_id),
anc AS (SELECT node_id, node_id AS anc, depth AS anc_depth, CAST(0 AS BIGINT) AS dist FROM up UNION ALL SELECT node_id, p1, depth - 1, 1 FROM up WHERE depth >= 1
 UNION ALL SELECT node_id, p2, depth - 2, 2 FROM up WHERE depth >= 2 UNION ALL SELECT node_id, p3, depth - 3, 3 FROM up WHERE depth >= 3),
sup AS (SELECT a.anc AS node_id, o.p FROM own o JOIN anc a ON a.node_id = o.node_id),
kids AS (SELECT parent_id AS node_id, node_id AS kid FROM nodes WHERE node_id <> parent_id),
area AS (SELECT node_id, count(*) AS n, min(p) AS mp FROM sup GROUP BY 1)"""


def image(spark: SparkSession, d: str) -> DataFrame:
    return R.lineitem_raster(spark, d)


def big(spark: SparkSession, d: str) -> P.Tree:
    return P.max_tree(image(spark, d))


def small(spark: SparkSession, d: str) -> P.Tree:
    return P.min_tree(image(spark, d))


world = R.customer_hierarchy


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Raster, max-tree, area, keep areas of 4 or more, direct reconstruction."""
    tree = big(spark, d)
    return X.direct(tree, X.preservation_mask(A.area(tree), "AREA", 4)).select("pixel", "value")


def _round(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.round(F.col(c).cast("double"), 6).alias(c.lower()) for c in df.columns if c not in keys and c != "tree_id"))


# ---------------------------------------------------------------- sources, sinks, adjacency

_query("raster", "WITH " + _PX.format(sign="1") + " SELECT p AS pixel, v AS value FROM px")(lambda s, d: image(s, d).select("pixel", "value"))
_query("flagship_area_filter", MAX + ", kept AS (SELECT n.node_id, n.altitude FROM nodes n JOIN area USING (node_id) WHERE area.n >= 4) SELECT o.p AS pixel, arg_min(k.altitude, a.dist) AS value FROM own o JOIN anc a USING (node_id) JOIN kept k ON k.node_id = a.anc GROUP BY 1")(flagship)
for _n, _tree, _sql in (("max_tree", big, MAX), ("min_tree", small, MIN)):
    _query(_n, _sql + " SELECT node_id, parent_id, altitude, depth FROM nodes")(lambda s, d, t=_tree: t(s, d).nodes.select("node_id", "parent_id", "altitude", "depth"))
    _query(f"{_n}_owners", _sql + " SELECT p AS pixel, node_id FROM own")(lambda s, d, t=_tree: t(s, d).owners.select("pixel", "node_id"))
    _query(f"{_n}_reconstruct", _sql + " SELECT p AS pixel, CAST(v AS DOUBLE) AS value FROM own")(lambda s, d, t=_tree: X.reconstruct(t(s, d)).select("pixel", "value"))
_query("native_hierarchy", WORLD + " SELECT node_id, parent_id, altitude, depth FROM nodes")(lambda s, d: world(s, d).nodes.select("node_id", "parent_id", "altitude", "depth"))
_query("validate_tree", "SELECT CAST(0 AS BIGINT) AS extra_roots, CAST(0 AS BIGINT) AS missing_parents, CAST(0 AS BIGINT) AS broken_paths, CAST(0 AS BIGINT) AS order_breaches, CAST(0 AS BIGINT) AS empty_supports")(lambda s, d: P.validate(world(s, d)).drop("tree_id"))


def _adjacent(s, d, offsets, once=False):
    return S.adjacency(image(s, d).withColumnRenamed("image_id", "tree_id"), offsets, once).select("source", "target")


_query("adjacency_8", "WITH " + _PX.format(sign="1") + " SELECT a.p AS source, b.p AS target FROM px a JOIN px b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.p <> b.p")(lambda s, d: _adjacent(s, d, K.stencil(1.5)))
_query("adjacency_4", "WITH " + _PX.format(sign="1") + " SELECT a.p AS source, b.p AS target FROM px a JOIN px b ON abs(a.r - b.r) + abs(a.c - b.c) = 1")(lambda s, d: _adjacent(s, d, K.stencil(1.0)))
_query("adjacency_rectangle", "WITH " + _PX.format(sign="1") + " SELECT a.p AS source, b.p AS target FROM px a JOIN px b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 2 AND a.p <> b.p")(lambda s, d: _adjacent(s, d, K.rectangle(1, 2)))
_query("adjacency_line", "WITH " + _PX.format(sign="1") + " SELECT a.p AS source, b.p AS target FROM px a JOIN px b ON a.r = b.r AND abs(a.c - b.c) <= 3 AND a.p <> b.p")(lambda s, d: _adjacent(s, d, K.line(0, 1, 3)))
_query("forward_edges", "WITH " + _PX.format(sign="1") + " SELECT a.p AS source, b.p AS target FROM px a JOIN px b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (b.r > a.r OR (b.r = a.r AND b.c > a.c))")(lambda s, d: _adjacent(s, d, K.stencil(1.5), True))
_query("grid_boundary", "WITH " + _PX.format(sign="1") + " SELECT p AS pixel, r IN (0, 15) OR c IN (0, 15) AS on_frame FROM px")(lambda s, d: image(s, d).select("pixel", (F.col("row").isin(0, 15) | F.col("col").isin(0, 15)).alias("on_frame")))

# ---------------------------------------------------------------- topology

_query("ancestors", WORLD + " SELECT node_id, anc, dist FROM anc")(lambda s, d: T.ancestors(world(s, d)).select("node_id", "anc", "dist"))
_query("descendants", MAX + " SELECT anc AS node_id, node_id AS descendant, dist FROM anc WHERE dist > 0")(lambda s, d: T.descendants(big(s, d)).select("node_id", "descendant", "dist"))
_query("children", MAX + " SELECT n.node_id, count(k.kid) AS n_children, min(k.kid) AS first_child FROM nodes n LEFT JOIN kids k USING (node_id) GROUP BY 1")(lambda s, d: T.children(big(s, d)).select("node_id", "n_children", "first_child"))
_query("siblings", WORLD + " SELECT node_id, count(*) OVER (PARTITION BY parent_id, node_id = parent_id) - 1 AS n_siblings, lead(node_id) OVER (PARTITION BY parent_id, node_id = parent_id ORDER BY node_id) AS next_sibling FROM nodes")(lambda s, d: T.siblings(world(s, d)).select("node_id", "n_siblings", "next_sibling"))
_query("leaves", MAX + " SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT node_id FROM kids)")(lambda s, d: T.leaves(big(s, d)).select("node_id"))
_query("node_support", MAX + " SELECT node_id, p AS pixel FROM sup")(lambda s, d: T.supports(big(s, d)).select("node_id", "pixel"))
_query("support_metadata", WORLD + " SELECT node_id, n AS cardinality, mp AS first_pixel FROM area")(lambda s, d: T.support_metadata(world(s, d)).select("node_id", "cardinality", "first_pixel"))
_query("proper_parts", MAX + " SELECT n.node_id, count(o.p) AS proper, count(o.p) = 0 AS empty FROM nodes n LEFT JOIN own o USING (node_id) GROUP BY 1")(lambda s, d: T.proper_parts(big(s, d)).select("node_id", "proper", "empty"))
_query("tree_counts", WORLD + " SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM nodes WHERE node_id NOT IN (SELECT node_id FROM kids)) AS n_leaves, (SELECT max(depth) FROM nodes) AS height, (SELECT count(*) FROM own) AS n_pixels")(lambda s, d: T.counts(world(s, d)).select("n_nodes", "n_leaves", "height", "n_pixels"))
_query("residue", MAX + " SELECT n.node_id, CASE WHEN n.node_id = n.parent_id THEN n.altitude ELSE n.altitude - u.altitude END AS residue FROM nodes n JOIN nodes u ON u.node_id = n.parent_id")(lambda s, d: T.residues(big(s, d)).select("node_id", "residue"))
_query("reconstruct_node", MAX + " SELECT o.p AS pixel, CAST(max(CASE WHEN a.anc = 3 THEN 1 ELSE 0 END) AS INTEGER) AS value FROM own o JOIN anc a USING (node_id) GROUP BY 1")(lambda s, d: T.reconstruct_node(big(s, d), 3).select("pixel", "value"))


def _pairs(tree):
    n = tree.nodes.select("tree_id", F.col("node_id").alias("u"))
    return n.withColumn("v", (F.col("u") * 7 + 3) % 13).join(tree.nodes.select("tree_id", F.col("node_id").alias("v")), ["tree_id", "v"])


def _on_pairs(f, column):
    def run(s, d):
        t = big(s, d)
        return f(t, _pairs(t)).select("u", "v", column)

    return run


_PAIRS = ", pairs AS (SELECT a.node_id AS u, b.node_id AS v FROM nodes a JOIN nodes b ON b.node_id = (a.node_id * 7 + 3) % 13), met AS (SELECT u, v, arg_max(x.anc, x.anc_depth) AS lca, max(x.anc_depth) AS d FROM pairs JOIN anc x ON x.node_id = u JOIN anc y ON y.node_id = v AND y.anc = x.anc GROUP BY 1, 2)"
_query("lowest_common_ancestor", MAX + _PAIRS + " SELECT u, v, lca FROM met")(_on_pairs(T.lca, "lca"))
_query("path_between", MAX + _PAIRS + " SELECT u, v, nodes.depth + w.depth - 2 * d + 1 AS n_path FROM met JOIN nodes ON nodes.node_id = u JOIN nodes w ON w.node_id = v")(lambda s, d: _on_pairs(T.paths_between, "path")(s, d).select("u", "v", F.size("path").cast("long").alias("n_path")))
_query("is_ancestor", MAX + " SELECT anc AS u, node_id AS v FROM anc")(lambda s, d: _interval(big(s, d)))


def _interval(t):
    """Ancestor pairs from the event counter alone, against what the paths say."""
    n = t.nodes.select("tree_id", F.col("node_id").alias("u"), F.col("entry").alias("e"), F.col("exit").alias("x"))
    j = T.ancestors(t).withColumnRenamed("anc", "u").join(n, ["tree_id", "u"]).join(t.nodes.select("tree_id", "node_id", "entry", "exit"), ["tree_id", "node_id"])
    return j.where(T.is_ancestor(F.col("e"), F.col("x"), F.col("entry"), F.col("exit"))).select("u", F.col("node_id").alias("v"))


# ---------------------------------------------------------------- attributes

_query("area", WORLD + " SELECT node_id, CAST(n AS DOUBLE) AS area FROM area")(lambda s, d: _round(A.area(world(s, d)), "node_id"))
_GRAY = """, vol AS (SELECT a.anc AS node_id, sum(o.n * n.altitude) AS volume, sum(o.n * n.altitude * n.altitude) AS sq, sum(o.n) AS area, min(n.altitude) AS lo, max(n.altitude) AS hi
 FROM anc a JOIN nodes n ON n.node_id = a.node_id LEFT JOIN (SELECT node_id, count(*) AS n FROM own GROUP BY 1) o0 ON o0.node_id = n.node_id, LATERAL (SELECT coalesce(o0.n, 0) AS n) o GROUP BY 1),
rise AS (SELECT n.node_id, area.n AS a, area.n * abs(n.altitude - u.altitude) AS up FROM nodes n JOIN area USING (node_id) JOIN nodes u ON u.node_id = n.parent_id),
rel AS (SELECT a.anc AS node_id, sum(r.a) + sum(CASE WHEN a.dist > 0 THEN r.up ELSE 0 END) AS rv FROM anc a JOIN rise r ON r.node_id = a.node_id GROUP BY 1)
SELECT n.node_id, CAST(v.area AS DOUBLE) AS area, round(v.volume, 6) AS volume, round(rv, 6) AS relative_volume, n.altitude AS level, round(v.volume / v.area, 6) AS mean_gray_level,
round(greatest(0, v.sq / v.area - (v.volume / v.area) * (v.volume / v.area)), 6) AS gray_level_variance, greatest(abs(n.altitude - lo), abs(hi - n.altitude)) AS gray_level_height FROM nodes n JOIN vol v USING (node_id) JOIN rel USING (node_id)"""
_query("gray_level", MAX + _GRAY)(lambda s, d: _round(A.gray_level(big(s, d)), "node_id"))
_query("gray_level_hierarchy", WORLD + _GRAY)(lambda s, d: _round(A.gray_level(world(s, d)), "node_id"))
_query("bounding_box", MAX + ", b AS (SELECT node_id, count(*) AS a, min(c) AS c0, max(c) AS c1, min(r) AS r0, max(r) AS r1, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h FROM sup GROUP BY 1) SELECT node_id, CAST(a AS DOUBLE) AS area, CAST(c0 AS DOUBLE) AS box_column_min, CAST(c1 AS DOUBLE) AS box_column_max, CAST(r0 AS DOUBLE) AS box_row_min, CAST(r1 AS DOUBLE) AS box_row_max, CAST(w AS DOUBLE) AS box_width, CAST(h AS DOUBLE) AS box_height, round(sqrt(w * w + h * h), 6) AS diagonal_length, round(a / (w * h), 6) AS rectangularity, round(greatest(w, h) / least(w, h), 6) AS ratio_wh FROM b")(lambda s, d: _round(A.box(big(s, d)), "node_id"))
_MU = ", cen AS (SELECT node_id, count(*) AS a, avg(c) AS mx, avg(r) AS my FROM sup GROUP BY 1), mu AS (SELECT node_id, any_value(a) AS a, " + ", ".join(f"sum((c - mx)**{k[0]} * (r - my)**{k[1]}) AS m{k}" for k in ("20", "02", "11", "30", "03", "21", "12")) + " FROM sup JOIN cen USING (node_id) GROUP BY 1)"
_MOM = [f"CENTRAL_MOMENT_{k}" for k in ("20", "02", "11", "30", "03", "21", "12")]
_query("central_moments", MAX + _MU + " SELECT node_id, " + ", ".join(f"round(m{k}, 4) + 0.0 AS central_moment_{k}" for k in ("20", "02", "11", "30", "03", "21", "12")) + " FROM mu")(lambda s, d: A.moments(big(s, d)).select("node_id", *((F.round(c, 4) + 0.0).alias(c.lower()) for c in _MOM)))
_query("moment_shape", MAX + _MU + ", l AS (SELECT *, m20 + m02 AS s, sqrt((m20 - m02)**2 + 4 * m11**2) AS q FROM mu) SELECT node_id, round((m20 + m02) / (a * a), 5) AS inertia, round(CASE WHEN s > 1e-9 THEN a / (2 * pi() * s) ELSE 0 END, 5) AS compactness, round(sqrt(greatest(0, 2 * (s + q) / a)), 4) AS length_major_axis FROM l")(lambda s, d: A.moments(big(s, d)).select("node_id", F.round("INERTIA", 5).alias("inertia"), F.round("COMPACTNESS", 5).alias("compactness"), F.round("LENGTH_MAJOR_AXIS", 4).alias("length_major_axis")))
_query("hu_moments", MAX + _MU + ", e AS (SELECT node_id, " + ", ".join(f"m{k} / a**{(int(k[0]) + int(k[1]) + 2) / 2} AS n{k}" for k in ("20", "02", "11", "30", "03", "21", "12")) + " FROM mu) SELECT node_id, round(n20 + n02, 6) + 0.0 AS hu_moment_1, round((n20 - n02)**2 + 4 * n11**2, 6) + 0.0 AS hu_moment_2, round((n30 - 3 * n12)**2 + (3 * n21 - n03)**2, 6) + 0.0 AS hu_moment_3, round((n30 + n12)**2 + (n21 + n03)**2, 6) + 0.0 AS hu_moment_4 FROM e")(lambda s, d: A.moments(big(s, d)).select("node_id", *((F.round(f"HU_MOMENT_{i}", 6) + 0.0).alias(f"hu_moment_{i}") for i in range(1, 5))))
_TOPO = """, dp AS (SELECT a.anc AS node_id, max(n.depth) AS deep, count(*) - 1 AS nd, sum(CASE WHEN n.node_id NOT IN (SELECT node_id FROM kids) THEN 1 ELSE 0 END) AS nl FROM anc a JOIN nodes n ON n.node_id = a.node_id GROUP BY 1),
h AS (SELECT n.node_id, dp.deep - n.depth AS h FROM nodes n JOIN dp USING (node_id)),
k AS (SELECT kids.node_id, count(*) AS k, max(h) AS hi, min(h) AS lo, avg(h) AS mean FROM kids JOIN h ON h.node_id = kids.kid GROUP BY 1)
SELECT n.node_id, CAST(h.h AS DOUBLE) AS subtree_height, CAST(n.depth AS DOUBLE) AS depth_node, CAST(dp.nd = 0 AS DOUBLE) AS is_leaf_node, CAST(n.node_id = n.parent_id AS DOUBLE) AS is_root_node, CAST(coalesce(k.k, 0) AS DOUBLE) AS num_children_node,
CAST(count(*) OVER (PARTITION BY n.parent_id, n.node_id = n.parent_id) - 1 AS DOUBLE) AS num_siblings_node, CAST(dp.nd AS DOUBLE) AS num_descendants_node, CAST(dp.nl AS DOUBLE) AS num_leaf_descendants_node, round(dp.nl / (dp.nd + 1), 6) AS leaf_ratio_node,
CAST(coalesce(k.hi - k.lo, 0) AS DOUBLE) AS balance_node, round(coalesce(k.mean, 0), 6) AS avg_child_height_node FROM nodes n JOIN dp USING (node_id) JOIN h USING (node_id) LEFT JOIN k USING (node_id)"""
_query("tree_topology", WORLD + _TOPO)(lambda s, d: _round(A.topology(world(s, d)), "node_id"))
_query("tree_topology_raster", MAX + _TOPO)(lambda s, d: _round(A.topology(big(s, d)), "node_id"))
_SIDES = "(VALUES (0, -1, 0), (1, 0, -1), (2, 0, 1), (3, 1, 0)) s(side, dr, dc)"
_query("contour_sides", MAX + f""", ex AS (SELECT a.node_id, s.side, a.p FROM sup a CROSS JOIN {_SIDES} LEFT JOIN sup b ON b.node_id = a.node_id AND b.r = a.r + s.dr AND b.c = a.c + s.dc WHERE b.p IS NULL)
SELECT node_id, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS contour_side_north, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS contour_side_west, CAST(count(*) FILTER (side = 2) AS DOUBLE) AS contour_side_east, CAST(count(*) FILTER (side = 3) AS DOUBLE) AS contour_side_south, CAST(count(*) AS DOUBLE) AS contour_perimeter, CAST(count(DISTINCT p) AS DOUBLE) AS contour_pixels FROM ex GROUP BY 1""")(lambda s, d: _round(A.contour(big(s, d)), "node_id"))
_query("contour_pixels", MAX + f" SELECT DISTINCT a.node_id, a.p AS pixel FROM sup a CROSS JOIN {_SIDES} LEFT JOIN sup b ON b.node_id = a.node_id AND b.r = a.r + s.dr AND b.c = a.c + s.dc WHERE b.p IS NULL")(lambda s, d: C.contour_pixels(big(s, d)).select("node_id", "pixel"))
_query("contour_trace_edges", MAX + f" SELECT a.node_id, a.p AS pixel, ['NORTH', 'WEST', 'EAST', 'SOUTH'][s.side + 1] AS side FROM sup a CROSS JOIN {_SIDES} LEFT JOIN sup b ON b.node_id = a.node_id AND b.r = a.r + s.dr AND b.c = a.c + s.dc WHERE b.p IS NULL")(lambda s, d: C.trace_edges(big(s, d)).select("node_id", "pixel", "side"))
_QUADS = MAX + """, cell AS (SELECT x.node_id, x.r + k.dr AS cr, x.c + k.dc AS cc, sum(k.bit) AS code FROM sup x CROSS JOIN (VALUES (8, 0, 0), (4, 0, 1), (2, 1, 0), (1, 1, 1)) k(bit, dr, dc) GROUP BY 1, 2, 3),
q AS (SELECT node_id, count(*) FILTER (bit_count(code) = 1) AS q1, count(*) FILTER (bit_count(code) = 2 AND code NOT IN (6, 9)) AS q2, count(*) FILTER (code IN (6, 9)) AS qd, count(*) FILTER (bit_count(code) = 3) AS q3, count(*) FILTER (bit_count(code) = 4) AS q4 FROM (SELECT node_id, CAST(code AS INTEGER) AS code FROM cell) GROUP BY 1)"""
_query("bitquad_counts", _QUADS + " SELECT node_id, CAST(q1 AS DOUBLE) AS q1, CAST(q2 AS DOUBLE) AS q2, CAST(qd AS DOUBLE) AS qd, CAST(q3 AS DOUBLE) AS q3, CAST(q4 AS DOUBLE) AS q4 FROM q")(lambda s, d: _round(A.bitquad_counts(big(s, d)), "node_id"))
_query("bitquad_histogram", _QUADS + " SELECT node_id, CAST(289 - count(*) AS DOUBLE) AS h0, " + ", ".join(f"CAST(count(*) FILTER (code = {k}) AS DOUBLE) AS h{k}" for k in range(1, 16)) + " FROM cell GROUP BY 1")(lambda s, d: _round(A.bitquad_histogram(big(s, d)), "node_id"))
_query("bitquad_scalars", _QUADS + ", v AS (SELECT *, q1 / 4 + q2 / 2 + q3 * 7 / 8 + q4 + qd * 3 / 4 AS ar, q2 + (q1 + q3) / 1.5 AS pc, trunc(-q3 / 4) AS eu FROM q) SELECT node_id, round(ar, 6) AS bitquad_area, CAST(eu AS DOUBLE) + 0.0 AS bitquad_number_euler, CAST(1 - eu AS DOUBLE) AS bitquad_number_holes, CAST(q1 + q2 + q3 + 2 * qd AS DOUBLE) AS bitquad_perimeter, round(pc, 6) AS bitquad_perimeter_continuous, round(4 * pi() * ar / (pc * pc), 6) AS bitquad_circularity, round(2 * ar / pc, 6) AS bitquad_width_average FROM v")(
    lambda s, d: _round(A.bitquad(big(s, d)).drop("BITQUAD_PERIMETER_AVERAGE", "BITQUAD_LENGTH_AVERAGE").withColumn("BITQUAD_NUMBER_EULER", F.col("BITQUAD_NUMBER_EULER") + 0.0), "node_id")
)
_query("attribute_mapping", MAX + " SELECT o.p AS pixel, CAST(a.n AS DOUBLE) AS value FROM own o JOIN area a USING (node_id)")(lambda s, d: (lambda t: _round(A.mapped(t, A.area(t), "AREA"), "pixel"))(big(s, d)))
_query("max_dist", MAX + f", e AS (SELECT DISTINCT a.node_id, a.r, a.c FROM sup a CROSS JOIN {_SIDES} LEFT JOIN sup b ON b.node_id = a.node_id AND b.r = a.r + s.dr AND b.c = a.c + s.dc WHERE b.p IS NULL), dd AS (SELECT x.node_id, x.p, min((x.r - e.r)**2 + (x.c - e.c)**2) AS q FROM sup x JOIN e USING (node_id) GROUP BY 1, 2) SELECT node_id, CAST(max(q) AS DOUBLE) AS max_dist FROM dd GROUP BY 1")(lambda s, d: _round(A.max_dist(big(s, d)), "node_id"))
_query("all_attributes")(lambda s, d: A.compute(big(s, d), "ALL").drop("tree_id"))
_SAMPLE = ", st AS (SELECT a.node_id, arg_min(a.anc, a.dist) AS anc FROM anc a JOIN nodes n ON n.node_id = a.node_id JOIN nodes u ON u.node_id = a.anc WHERE a.dist > 0 AND abs(n.altitude - u.altitude) >= 2 GROUP BY 1), dn AS (SELECT st.anc AS node_id, arg_max(st.node_id, ROW(area.n, -area.mp)) AS dsc FROM st JOIN area USING (node_id) GROUP BY 1), wd AS (SELECT n.node_id, st.anc, dn.dsc FROM nodes n LEFT JOIN st USING (node_id) LEFT JOIN dn USING (node_id))"
_query("sampled_attribute", MAX + _SAMPLE + " SELECT w.node_id, CAST(a.n AS DOUBLE) AS area, CAST(coalesce(u.n, a.n) AS DOUBLE) AS area_ancestor_1, CAST(coalesce(x.n, a.n) AS DOUBLE) AS area_descendant_1 FROM wd w JOIN area a USING (node_id) LEFT JOIN area u ON u.node_id = w.anc LEFT JOIN area x ON x.node_id = w.dsc")(lambda s, d: (lambda t: _round(A.sampled(t, A.area(t), "AREA", 2, 1), "node_id"))(big(s, d)))
_query("local_window_attribute", MAX + " SELECT x.node_id, CAST(sum((SELECT 1) + 0) + count(b.p) AS DOUBLE) AS value FROM sup x LEFT JOIN sup b ON b.node_id = x.node_id AND b.r = x.r AND b.c = x.c + 1 GROUP BY 1")(lambda s, d: _round(L.compute(big(s, d), [(0, 0), (0, 1)], lambda bits: bin(bits).count("1")), "node_id"))

# ---------------------------------------------------------------- filters

_KEEP = ", keep AS (SELECT n.node_id, area.n >= 6 AS keep FROM nodes n JOIN area USING (node_id))"


def _with_area(f, tree=big):
    def run(s, d):
        t = tree(s, d)
        return f(t, A.area(t))

    return run


_query("preservation_mask", MAX + _KEEP + " SELECT node_id, keep FROM keep")(_with_area(lambda t, a: X.preservation_mask(a, "AREA", 6).select("node_id", "keep")))
_query("direct_filter_min_tree", MIN + _KEEP + " SELECT o.p AS pixel, arg_min(n.altitude, a.dist) AS value FROM own o JOIN anc a USING (node_id) JOIN keep k ON k.node_id = a.anc AND k.keep JOIN nodes n ON n.node_id = a.anc GROUP BY 1")(_with_area(lambda t, a: X.direct(t, X.preservation_mask(a, "AREA", 6)).select("pixel", "value"), small))
_RES = ", res AS (SELECT n.node_id, CASE WHEN n.node_id = n.parent_id THEN n.altitude ELSE n.altitude - u.altitude END AS res FROM nodes n JOIN nodes u ON u.node_id = n.parent_id)"
_query("subtractive_filter", MAX + _KEEP + _RES + " SELECT o.p AS pixel, sum(CASE WHEN k.keep THEN r.res ELSE 0 END) AS value FROM own o JOIN anc a USING (node_id) JOIN keep k ON k.node_id = a.anc JOIN res r ON r.node_id = a.anc GROUP BY 1")(_with_area(lambda t, a: X.subtractive(t, X.preservation_mask(a, "AREA", 6)).select("pixel", "value")))
_query("soft_subtractive_filter", MAX + _RES + " SELECT o.p AS pixel, round(sum(ar.n / 256 * r.res), 6) AS value FROM own o JOIN anc a USING (node_id) JOIN area ar ON ar.node_id = a.anc JOIN res r ON r.node_id = a.anc GROUP BY 1")(_with_area(lambda t, a: _round(X.soft_subtractive(t, a.select("tree_id", "node_id", (F.col("AREA") / 256).alias("s")), "s"), "pixel")))
_query("pruning_min", MAX + ", gone AS (SELECT DISTINCT a.node_id FROM anc a JOIN area ar ON ar.node_id = a.anc WHERE a.anc_depth > 0 AND ar.n <= 5) SELECT o.p AS pixel, arg_min(n.altitude, a.dist) AS value FROM own o JOIN anc a USING (node_id) JOIN nodes n ON n.node_id = a.anc WHERE a.anc NOT IN (SELECT node_id FROM gone) GROUP BY 1")(_with_area(lambda t, a: X.pruning_min_by(t, a, "AREA", 5).select("pixel", "value")))
_query("pruning_max", MAX + ", col AS (SELECT a.anc AS node_id FROM anc a JOIN area ar ON ar.node_id = a.node_id GROUP BY 1 HAVING bool_and(ar.n <= 5)), tp AS (SELECT a.node_id, arg_min(a.anc, a.anc_depth) AS top FROM anc a JOIN col ON col.node_id = a.anc GROUP BY 1) SELECT o.p AS pixel, coalesce(u.altitude, n.altitude) AS value FROM own o JOIN nodes n USING (node_id) LEFT JOIN tp USING (node_id) LEFT JOIN nodes u ON u.node_id = tp.top")(_with_area(lambda t, a: X.pruning_max_by(t, a, "AREA", 5).select("pixel", "value")))
_query("reconstruct_contributions", MAX + " SELECT o.p AS pixel, CAST(sum(ar.n) AS DOUBLE) AS value FROM own o JOIN anc a USING (node_id) JOIN area ar ON ar.node_id = a.anc GROUP BY 1")(_with_area(lambda t, a: _round(X.reconstruct_contributions(t, a, "AREA"), "pixel")))
# kept: the least cost below a node that stays, level by level from the deepest (values under 8 give depths under 8)
_COST = ", cost AS (SELECT n.node_id, n.parent_id, n.depth, greatest(0, 6 - ar.n) AS kc, d.g FROM nodes n JOIN area ar USING (node_id) JOIN (SELECT a.anc AS node_id, sum(greatest(0, ar.n - 6)) AS g FROM anc a JOIN area ar USING (node_id) GROUP BY 1) d USING (node_id)), k8 AS (SELECT 0 AS parent_id, 0 AS kept, 0 AS g WHERE false)"
_COST += "".join(f", k{i} AS (SELECT c.node_id, c.parent_id, c.kc + coalesce(sum(least(k.kept, k.g)), 0) AS kept, c.g FROM cost c LEFT JOIN k{i + 1} k ON k.parent_id = c.node_id WHERE c.depth = {i} GROUP BY c.node_id, c.parent_id, c.kc, c.g)" for i in range(7, -1, -1))
_COST += ", bad AS (" + " UNION ALL ".join(f"SELECT node_id FROM k{i} WHERE kept >= g" for i in range(1, 8)) + "), gone AS (SELECT DISTINCT a.node_id FROM anc a JOIN bad ON bad.node_id = a.anc)"
_query("viterbi_filter", MAX + _COST + " SELECT o.p AS pixel, arg_min(n.altitude, a.dist) AS value FROM own o JOIN anc a USING (node_id) JOIN nodes n ON n.node_id = a.anc WHERE a.anc NOT IN (SELECT node_id FROM gone) GROUP BY 1")(_with_area(lambda t, a: X.viterbi(t, a, "AREA", 6).select("pixel", "value")))
_query("extinction_values")(_with_area(lambda t, a: X.extinction(t, a, "AREA").drop("tree_id")))
_query("extinction_filter")(_with_area(lambda t, a: X.extinction_filter(t, X.extinction(t, a, "AREA"), top_k=4).select("pixel", "value")))
_query("extinction_attribute")(_with_area(lambda t, a: X.extinction_attribute(t, X.extinction(t, a, "AREA")).drop("tree_id")))
_query("extinction_contour_map")(_with_area(lambda t, a: X.extinction_contours(t, X.extinction(t, a, "AREA"), C.contour_pixels(t), top_k=4).select("pixel", "value")))
_VAR = ", va AS (SELECT w.node_id, w.anc, w.dsc, (u.n - x.n) / a.n AS v FROM wd w JOIN area a USING (node_id) LEFT JOIN area u ON u.node_id = w.anc LEFT JOIN area x ON x.node_id = w.dsc), sb AS (SELECT p.node_id, p.anc, p.dsc, p.v, q.v AS vu, r.v AS vd FROM va p LEFT JOIN va q ON q.node_id = p.anc LEFT JOIN va r ON r.node_id = p.dsc)"
_DEEP = ", st AS (SELECT node_id, anc FROM anc WHERE dist = 1), dn AS (SELECT st.anc AS node_id, arg_max(st.node_id, ROW(area.n, -area.mp)) AS dsc FROM st JOIN area USING (node_id) GROUP BY 1), wd AS (SELECT n.node_id, st.anc, dn.dsc FROM nodes n LEFT JOIN st USING (node_id) LEFT JOIN dn USING (node_id))"
_STABLE = " SELECT node_id, round(v, 6) AS variation, coalesce(v < vu AND v < vd AND v < 10, false) AS stable FROM sb"
_query("mser", MAX + _SAMPLE + _VAR + _STABLE)(_with_area(lambda t, a: X.stability(t, a, "AREA", step=2).select("node_id", F.round("variation", 6).alias("variation"), "stable")))
_query("depth_stability", MAX + _DEEP + _VAR + _STABLE)(_with_area(lambda t, a: X.stability(t, a, "AREA", levels=1).select("node_id", F.round("variation", 6).alias("variation"), "stable")))
_ADJ = ", moved AS (SELECT CASE WHEN v IS NULL THEN sb.node_id WHEN v <= coalesce(vd, 1e300) AND v <= coalesce(vu, 1e300) THEN sb.node_id WHEN coalesce(vd, 1e300) <= coalesce(vu, 1e300) THEN dsc ELSE sb.anc END AS node_id FROM sb JOIN area USING (node_id) WHERE area.n < 6) SELECT node_id, node_id NOT IN (SELECT node_id FROM moved) AS keep FROM nodes"
_query("adjust_mask_altitude", MAX + _SAMPLE + _VAR + _ADJ)(_with_area(lambda t, a: X.adjusted_mask(t, X.preservation_mask(a, "AREA", 6), X.stability(t, a, "AREA", step=2)).select("node_id", "keep")))
_query("adjust_mask_depth", MAX + _DEEP + _VAR + _ADJ)(_with_area(lambda t, a: X.adjusted_mask(t, X.preservation_mask(a, "AREA", 6), X.stability(t, a, "AREA", levels=1)).select("node_id", "keep")))
# areas rise strictly towards the root, so each node is a primitive of its own; of growth that goes on from node to node the first area is told
_OPENED = """, way AS (SELECT a.node_id, a.anc_depth, ar.n, CASE WHEN {counts} THEN n.altitude - u.altitude ELSE 0 END AS rest FROM anc a JOIN area ar ON ar.node_id = a.anc JOIN nodes n ON n.node_id = a.anc JOIN nodes u ON u.node_id = n.parent_id WHERE n.depth > 0 AND ar.n <= 64),
gr AS (SELECT *, rest > coalesce(max(rest) OVER (PARTITION BY node_id ORDER BY anc_depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grown FROM way),
ga AS (SELECT *, grown AND NOT coalesce(lag(grown) OVER (PARTITION BY node_id ORDER BY anc_depth), false) AS opens FROM gr),
rs AS (SELECT node_id, max(rest) AS contrast, arg_max(n + 1, anc_depth) FILTER (WHERE opens) AS associated FROM ga GROUP BY 1)
SELECT o.p AS pixel, CAST(coalesce(contrast, 0) AS DOUBLE) AS contrast, CAST(coalesce(associated, 0) AS BIGINT) AS associated FROM own o LEFT JOIN rs USING (node_id)"""
_query("ultimate_opening", MAX + _OPENED.format(counts="true"))(_with_area(lambda t, a: X.ultimate_opening(t, a, "AREA", 64).select("pixel", "contrast", "associated")))
_query("ultimate_opening_mser", MAX + _SAMPLE.replace(">= 2", ">= 1") + _VAR + _OPENED.format(counts="a.anc IN (SELECT node_id FROM sb WHERE v < vu AND v < vd AND v < 10)"))(_with_area(lambda t, a: X.ultimate_opening(t, a, "AREA", 64, X.stability(t, a, "AREA", step=1).withColumnRenamed("stable", "selected")).select("pixel", "contrast", "associated")))
_ALTERNATED = MAX + _left(2, 0, -1) + _left(2, 1, 1) + _left(6, 2, -1) + _left(6, 3, 1)
_query("alternating_filter", _ALTERNATED + " SELECT p AS pixel, CAST(v AS DOUBLE) AS value FROM px4")(lambda s, d: E.alternating(image(s, d), [2, 6]).select("pixel", "value"))

# ---------------------------------------------------------------- saliency

_EDGE = ", ed AS (SELECT a.p AS source, b.p AS target, a.node_id AS u, b.node_id AS v FROM own a JOIN own b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (b.r > a.r OR (b.r = a.r AND b.c > a.c))), em AS (SELECT source, target, any_value(u) AS u, any_value(v) AS v, arg_max(x.anc, x.anc_depth) AS lca, max(x.anc_depth) AS d FROM ed JOIN anc x ON x.node_id = u JOIN anc y ON y.node_id = v AND y.anc = x.anc GROUP BY 1, 2)"
_query("edge_map", MAX + _EDGE + " SELECT source, target, n.altitude AS value FROM em JOIN nodes n ON n.node_id = lca")(lambda s, d: (lambda t: S.edge_map(t, t.nodes, "altitude").drop("tree_id"))(big(s, d)))
_query("saliency", MAX + _EDGE + " SELECT source, target, CASE WHEN u = v THEN 0 ELSE CAST(a.n AS DOUBLE) END AS value FROM em JOIN area a ON a.node_id = lca")(_with_area(lambda t, a: S.saliency(t, a, "AREA").select("source", "target", "value")))
_RANK = " lv AS (SELECT source, target, u = v AS same, x FROM em JOIN val2 ON val2.node_id = lca), rk AS (SELECT x, dense_rank() OVER (ORDER BY x) - 1 AS r FROM (SELECT DISTINCT x FROM lv WHERE NOT same)) SELECT source, target, CAST(CASE WHEN same THEN 0 ELSE r + (SELECT max(CAST(same AS INTEGER)) FROM lv) END AS DOUBLE) AS value FROM lv LEFT JOIN rk USING (x)"
_query("saliency_ranked", MAX + _EDGE + ", val2 AS (SELECT node_id, n AS x FROM area)," + _RANK)(_with_area(lambda t, a: S.ranked_saliency(t, a, "AREA").drop("tree_id")))
_query("topological_edge_map", MAX + _EDGE + ", val2 AS (SELECT a.anc AS node_id, max(a.dist) AS x FROM anc a GROUP BY 1)," + _RANK)(lambda s, d: S.topological_edge_map(big(s, d)).drop("tree_id"))
_query("normalized_altitude_edge_map", MAX + _EDGE + ", sp AS (SELECT min(altitude) AS lo, max(altitude) AS hi FROM nodes) SELECT source, target, CASE WHEN u = v THEN 0 ELSE round((hi - n.altitude) / (hi - lo), 6) END AS value FROM em JOIN nodes n ON n.node_id = lca, sp")(lambda s, d: S.normalized_altitude_edge_map(big(s, d)).select("source", "target", F.round("value", 6).alias("value")))
_query("threshold_cut", MAX + _EDGE + " SELECT source, target, n.altitude AS value FROM em JOIN nodes n ON n.node_id = lca WHERE n.altitude >= 2")(lambda s, d: (lambda t: S.threshold_cut(S.edge_map(t, t.nodes, "altitude"), 2).drop("tree_id"))(big(s, d)))
for _how, _agg in (("max", "max(value)"), ("mean", "round(avg(value), 6)")):
    _query(f"edge_to_pixel_{_how}", MAX + _EDGE + f", ev AS (SELECT source, target, n.altitude AS value FROM em JOIN nodes n ON n.node_id = lca) SELECT pixel, {_agg} AS value FROM (SELECT source AS pixel, value FROM ev UNION ALL SELECT target, value FROM ev) GROUP BY 1")(lambda s, d, h=_how: (lambda t: _round(S.to_pixels(S.edge_map(t, t.nodes, "altitude"), t.owners, h), "pixel"))(big(s, d)))
_query("node_contour_edges", MAX + _EDGE + " SELECT lca AS node_id, source, target FROM em WHERE u <> v")(lambda s, d: S.node_contour_edges(big(s, d)).drop("tree_id"))
_query("incremental_node_contours", MAX + _EDGE + " SELECT lca AS node_id, count(*) AS n_edges FROM em WHERE u <> v GROUP BY 1")(lambda s, d: S.contour_edges_by_node(big(s, d)).select("node_id", F.size("edges").cast("long").alias("n_edges")))
_query("projected_valuation", MAX + _EDGE + " SELECT lca AS node_id, source, target, CAST(a.n AS DOUBLE) AS value FROM em JOIN area a ON a.node_id = lca WHERE u <> v AND a.n >= 20")(_with_area(lambda t, a: S.projected_valuation(t, a, "AREA", 20).select("node_id", "source", "target", F.col("value").cast("double").alias("value"))))
_query("contour_score_projection", MAX + _EDGE + ", way AS (SELECT em.source, em.target, ar.n FROM em JOIN anc x ON x.node_id IN (u, v) AND x.anc_depth > em.d JOIN area ar ON ar.node_id = x.anc) SELECT em.source, em.target, CAST(coalesce(max(way.n), 0) AS DOUBLE) AS value FROM em LEFT JOIN way ON way.source = em.source AND way.target = em.target GROUP BY 1, 2")(_with_area(lambda t, a: S.contour_scores(t, a, "AREA").drop("tree_id")))
_query("watershed_saliency")(_with_area(lambda t, a: S.watershed_saliency(t, X.extinction(t, a, "AREA"), ranked=True).drop("tree_id")))
_query("monotone_projection")(_with_area(lambda t, a: S.monotone_projection(t, X.extinction_attribute(t, X.extinction(t, a, "AREA")), ranked=True).drop("tree_id")))
_query("shape_space_saliency")(_with_area(lambda t, a: S.shape_space_saliency(t, a, "AREA").drop("tree_id")))
_query("contour_loops")(lambda s, d: C.loops(big(s, d), 16).drop("tree_id"))
_query("contour_deltas", MAX + f""", ct AS (SELECT DISTINCT a.node_id, a.p FROM sup a CROSS JOIN {_SIDES} LEFT JOIN sup b ON b.node_id = a.node_id AND b.r = a.r + s.dr AND b.c = a.c + s.dc WHERE b.p IS NULL),
ch AS (SELECT node_id, p, 1 AS d FROM ct UNION ALL SELECT n.parent_id, ct.p, -1 FROM ct JOIN nodes n USING (node_id) WHERE n.node_id <> n.parent_id) SELECT node_id, p AS pixel, CAST(sum(d) AS BIGINT) AS delta FROM ch GROUP BY 1, 2 HAVING sum(d) <> 0""")(lambda s, d: C.contour_deltas(big(s, d)).drop("tree_id"))

# ---------------------------------------------------------------- edits, compact layout, other constructions

_query("prune_node", WORLD + ", g AS (SELECT a.node_id, n1.parent_id AS t FROM anc a JOIN nodes n1 ON n1.node_id = a.anc WHERE n1.depth = 2 AND n1.node_id % 3 = 0) SELECT o.p AS pixel, coalesce(g.t, o.node_id) AS node_id FROM own o LEFT JOIN g USING (node_id)")(lambda s, d: (lambda t: E.prune(t, t.nodes.where("depth = 2 AND node_id % 3 = 0")).owners.select("pixel", "node_id"))(world(s, d)))
for _n, _tree, _sql, _sign in (("max", big, MAX, -1), ("min", small, MIN, 1)):
    _pair = lambda s, d, t=_tree: (lambda tree: E.prune_pair(tree, A.area(tree).where("AREA <= 5")))(t(s, d))
    _query(f"pruned_{_n}_tree_dual", _sql + _left(5, 0, _sign) + " SELECT node_id, parent_id, altitude, depth FROM nodes1")(lambda s, d, pair=_pair: pair(s, d)[1].nodes.select("node_id", "parent_id", "altitude", "depth"))
    _query(f"pruned_{_n}_tree_image", _sql + _left(5, 0, _sign) + f" SELECT p AS pixel, CAST({_sign} * v AS DOUBLE) AS value FROM px1")(lambda s, d, pair=_pair: X.reconstruct(pair(s, d)[0]).select("pixel", "value"))
_query("merge_into_parent", WORLD + ", m AS (SELECT node_id, parent_id FROM nodes WHERE depth = 2 AND node_id % 3 = 0) SELECT n.node_id, coalesce(m.parent_id, n.parent_id) AS parent_id FROM nodes n LEFT JOIN m ON m.node_id = n.parent_id WHERE n.node_id NOT IN (SELECT node_id FROM m)")(lambda s, d: (lambda t: E.merge_into_parent(t, t.nodes.where("depth = 2 AND node_id % 3 = 0")).nodes.select("node_id", "parent_id"))(world(s, d)))
_query("set_altitudes", WORLD + " SELECT node_id, altitude * 2 AS altitude FROM nodes")(lambda s, d: (lambda t: E.set_altitudes(t, t.nodes.select("tree_id", "node_id", (F.col("altitude") * 2).alias("altitude"))).nodes.select("node_id", "altitude"))(world(s, d)))
_query("compact_export", MAX + """, way AS (SELECT node_id, list(anc ORDER BY anc_depth) AS way FROM anc GROUP BY 1), sz AS (SELECT anc AS node_id, count(*) AS size FROM anc GROUP BY 1),
po AS (SELECT n.node_id, n.parent_id, n.altitude, row_number() OVER (ORDER BY way.way) - 1 + sz.size - 1 - n.depth AS post FROM nodes n JOIN way USING (node_id) JOIN sz USING (node_id)),
vx AS (SELECT *, row_number() OVER (ORDER BY altitude DESC, post) - 1 + 256 AS vertex FROM po)
SELECT a.vertex, b.vertex AS parent, a.altitude FROM vx a JOIN vx b ON b.node_id = a.parent_id UNION ALL SELECT own.p, vx.vertex, vx.altitude FROM own JOIN vx USING (node_id)""")(lambda s, d: E.export_compact(big(s, d)).select("vertex", "parent", "altitude"))
_query("compact_roundtrip", MAX + " SELECT n.depth, n.altitude, ar.n AS area FROM nodes n JOIN area ar USING (node_id)")(lambda s, d: (lambda t: t.nodes.join(A.area(t), ["tree_id", "node_id"]).select("depth", "altitude", F.col("AREA").alias("area")))(E.import_compact(E.export_compact(big(s, d)).drop("node_id"), 256, 16, "increasing")))
_query("compact_attributes", MAX + " SELECT CAST(n AS DOUBLE) AS area FROM area UNION ALL SELECT 1.0 FROM own")(_with_area(lambda t, a: E.project_compact(t, a, ["AREA"], A.unit_rows(["AREA"])).select(F.col("AREA").cast("double").alias("area"))))
_EXACT = "WITH " + _PX.format(sign="1") + " SELECT p AS pixel, CAST({f} * v AS DOUBLE) AS value FROM px"
_query("tree_of_shapes_reconstruct", _EXACT.format(f=2))(lambda s, d: X.reconstruct(P.tree_of_shapes(image(s, d))).select("pixel", "value"))
_query("tree_of_shapes_complementary_reconstruct", _EXACT.format(f=1))(lambda s, d: X.reconstruct(P.tree_of_shapes(image(s, d), "min4max8")).select("pixel", "value"))
_query("tree_of_shapes")(lambda s, d: P.tree_of_shapes(image(s, d)).nodes.select("node_id", "parent_id", "altitude", "depth"))
_query("shape_polarity")(lambda s, d: T.polarity(P.tree_of_shapes(image(s, d))).select("node_id", "polarity"))
_query("residual_unrestricted_reconstruct", _EXACT.format(f=1))(lambda s, d: X.reconstruct(P.residual_tree(image(s, d))).select("pixel", "value"))
_query("residual_saturated_reconstruct", _EXACT.format(f=1))(lambda s, d: X.reconstruct(P.residual_tree(image(s, d), saturated=True)).select("pixel", "value"))
_query("residual_tree_column_order_reconstruct", _EXACT.format(f=1))(lambda s, d: X.reconstruct(P.residual_tree(image(s, d).withColumn("place", F.col("col") * 16 + F.col("row")), place="place")).select("pixel", "value"))
_query("residual_tree")(lambda s, d: P.residual_tree(image(s, d)).nodes.select("node_id", "parent_id", "altitude", "depth"))
_query("event_grid", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS image_id, CAST(hour(ts) AS INTEGER) AS \"row\", CAST(user_id % 24 AS INTEGER) AS col, count(*) AS value FROM events GROUP BY 1, 2, 3")(lambda s, d: I.event_grid(s.read.parquet(f"{d}/events.parquet")))
_query("many_images_area", None)(lambda s, d: (lambda t: A.area(t).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("AREA").alias("area")))(P.max_tree(R.lineitem_raster(s, d, 32, 64, F.date_format("l_shipdate", "yyyy-MM")))))
