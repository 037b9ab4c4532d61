"""Connectivity: structuring elements that don't join an image, and which one bitquads count with."""

import numpy as np
import pytest

from silvagrid.operators import attributes as A
from silvagrid.operators import topology as T
from silvagrid.plans import tree as P

IMAGE = np.array([[2, 2, 2, 2, 2], [2, 5, 2, 0, 2], [2, 2, 5, 2, 0], [2, 2, 2, 2, 2]])


@pytest.fixture(scope="module")
def pixels(spark):
    rows, cols = IMAGE.shape
    cells = [("a", r * cols + c, r, c, int(IMAGE[r, c])) for r in range(rows) for c in range(cols)]
    return spark.createDataFrame(cells, "image_id string, pixel long, row int, col int, value int")


def test_a_stencil_that_leaves_pixels_apart_is_an_error(pixels):
    with pytest.raises(Exception, match="doesn't connect"):
        P.max_tree(pixels, offsets=[(0, 0), (0, 1), (0, -1)]).nodes.count()


def by_node(frame):
    return {r.node_id: (r.BITQUAD_AREA, r.BITQUAD_NUMBER_EULER, r.BITQUAD_PERIMETER) for r in frame.collect()}


@pytest.mark.parametrize(("immersion", "lower", "upper", "root"), [("min4max8", 4, 8, 8), ("min8max4", 8, 4, 8), ("selfdual", 4, 4, 4)])
def test_bitquads_of_shapes_go_by_polarity(pixels, immersion, lower, upper, root):
    tree = P.tree_of_shapes(pixels, immersion)
    got, of = by_node(A.bitquad(tree)), {4: by_node(A.bitquad(tree, eight=False)), 8: by_node(A.bitquad(tree, eight=True))}
    kinds = {r.node_id: {"lower": lower, "upper": upper}.get(r.polarity, root) for r in T.polarity(tree).collect()}
    assert len(set(kinds.values())) == (1 if lower == upper else 2)
    assert got == {n: of[k][n] for n, k in kinds.items()}
    assert of[4] != of[8]


def test_bitquads_without_a_known_connectivity_need_a_choice(pixels):
    tree = P.max_tree(pixels, offsets=[(0, 0), *[(r, c) for r in range(-2, 3) for c in range(-2, 3) if (r, c) != (0, 0)]])
    with pytest.raises(ValueError, match="choice of eight"):
        A.bitquad(tree)
    assert A.bitquad(tree, eight=True).count() == tree.nodes.count()
    assert by_node(A.bitquad(P.max_tree(pixels, 1.0))) == by_node(A.bitquad(P.max_tree(pixels, 1.0), eight=False))


def test_state_histogram_covers_the_framed_image(pixels):
    tree = P.max_tree(pixels)
    rows = {r.node_id: [r[f"h{k}"] for k in range(16)] for r in A.bitquad_histogram(tree).collect()}
    assert all(sum(h) == 5 * 6 for h in rows.values())
    support = {}
    for r in T.supports(tree).collect():
        support.setdefault(r.node_id, set()).add(r.pixel)
    for node, held in support.items():
        frame = np.zeros((6, 7), int)
        for p in held:
            frame[p // 5 + 1, p % 5 + 1] = 1
        code = frame[:-1, :-1] + 2 * frame[:-1, 1:] + 4 * frame[1:, :-1] + 8 * frame[1:, 1:]
        assert rows[node] == np.bincount(code.reshape(-1), minlength=16).tolist()
