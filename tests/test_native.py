"""Hierarchies that a table holds: any depth, and errors for what is none."""

import pytest

from silvagrid.operators import edits
from silvagrid.plans.tree import from_native, validate

NODES, OWNERS = "tree_id string, node_id long, parent_id long, altitude double", "tree_id string, pixel long, node_id long"


def made(spark, parents, pixels=None, altitude=None):
    nodes = [("t", v, p, float(v) if altitude is None else altitude) for v, p in parents]
    return from_native(spark.createDataFrame(nodes, NODES), spark.createDataFrame([("t", i, v) for i, v in enumerate(pixels or [v for v, _ in parents])], OWNERS))


def test_a_chain_of_any_depth(spark):
    tree = made(spark, [(0, 0)] + [(v, v - 1) for v in range(1, 70)])
    rows = {r.node_id: r for r in tree.nodes.collect()}
    assert len(rows) == 70 and all(r.depth == v and list(r.path) == list(range(v + 1)) and r["size"] == 70 - v for v, r in rows.items())
    cut = edits.prune(tree, tree.nodes.where("node_id = 40"))
    assert cut.nodes.count() == 40 and cut.owners.where("node_id = 39").count() == 31
    assert validate(cut).drop("tree_id").first() == (0, 0, 0, 0, 0)


@pytest.mark.parametrize(
    "parents,pixels,what",
    [
        ([(0, 0), (1, 2), (2, 3), (3, 1)], None, "no root is above"),
        ([(0, 0), (1, 0), (1, 0)], None, "repeated"),
        ([(0, 0), (1, 1)], None, "root"),
        ([(0, 1), (1, 0)], None, "root"),
        ([(0, 0), (1, 7)], None, "parents"),
        ([(0, 0), (1, 0)], [0, 1, 9], "pixels"),
        ([(0, 0), (None, 0)], [0], "null"),
    ],
)
def test_what_is_no_hierarchy_is_an_error(spark, parents, pixels, what):
    with pytest.raises(ValueError, match=what):
        made(spark, parents, pixels, 1.0)


def test_reparenting_into_a_cycle_is_an_error(spark):
    tree = made(spark, [(0, 0), (1, 0), (2, 1)])
    moves = spark.createDataFrame([("t", 1, 2)], "tree_id string, node_id long, new_parent long")
    with pytest.raises(ValueError, match="no root is above"):
        edits.Editor(tree).reparent(moves)


def rows_of(spark, columns, *rows):
    return spark.createDataFrame([("t", *r) for r in rows], "tree_id string, " + ", ".join(f"{c} long" for c in columns))


def test_staged_edits_with_detached_nodes(spark):
    """0 over 1 and 4; 1 over 2 and 3: a new node takes 1's children and pixels, 1 goes, and 5 becomes the root."""
    tree = made(spark, [(0, 0), (1, 0), (2, 1), (3, 1), (4, 0)], altitude=1.0)
    e = edits.Editor(tree)
    node = lambda *ids: rows_of(spark, ["node_id"], *((i,) for i in ids))
    with pytest.raises(ValueError, match="root can't"):
        e.detach(node(0))
    e.create_detached(node(5).selectExpr("*", "1.0D AS altitude"))
    with pytest.raises(ValueError, match="null"):
        e.commit()
    e.detach(node(1)).move_children(rows_of(spark, ["source", "target"], (1, 5)))
    with pytest.raises(ValueError, match="hold pixels"):
        e.release(node(1))
    e.merge_proper_parts(rows_of(spark, ["source", "target"], (1, 5))).release(node(1))
    e.set_root(node(5))
    with pytest.raises(ValueError, match="not detached"):
        e.attach(rows_of(spark, ["node_id", "new_parent"], (4, 5)))
    e.attach(rows_of(spark, ["node_id", "new_parent"], (0, 5)))
    got = e.commit()
    assert {(r.node_id, r.parent_id) for r in got.nodes.collect()} == {(5, 5), (2, 5), (3, 5), (0, 5), (4, 0)}
    assert {(r.pixel, r.node_id) for r in got.owners.collect()} == {(0, 0), (1, 5), (2, 2), (3, 3), (4, 4)}
    assert e.rollback() is tree and e.nodes.count() == 5


def test_children_moved_under_their_own_sibling_and_removed(spark):
    tree = made(spark, [(0, 0), (1, 0), (2, 0)], [0, 1], 1.0)
    e = edits.Editor(tree)
    e.remove_children(rows_of(spark, ["node_id"], (2,)), release=True).move_children(rows_of(spark, ["source", "target"], (0, 1)))
    assert {(r.node_id, r.parent_id) for r in e.commit().nodes.collect()} == {(0, 0), (1, 0)}


def test_ids_of_the_compact_layout_end_with_an_edit(spark):
    rows = [("t", 0, 3, 2.0), ("t", 1, 4, 1.0), ("t", 2, 4, 1.0), ("t", 3, 4, 2.0), ("t", 4, 4, 1.0)]
    tree = edits.import_compact(spark.createDataFrame(rows, "tree_id string, vertex long, parent long, altitude double"), 3, 3, "increasing")
    assert sorted(r.node_id for r in edits.as_vertices(tree, tree.nodes).collect()) == [3, 4]
    cut = edits.prune(tree, tree.nodes.where("node_id = 0"))
    for other in (cut, made(spark, [(0, 0), (1, 0)])):
        with pytest.raises(ValueError, match="compact layout"):
            edits.as_vertices(other, other.nodes)


def test_only_component_trees_have_a_dual(spark):
    tree = made(spark, [(0, 0), (1, 0)])
    with pytest.raises(ValueError, match="dual"):
        edits.prune_pair(tree, tree.nodes.limit(0))
