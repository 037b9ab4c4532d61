"""Kernels on small images with known trees, and properties on random ones."""

import numpy as np
import pytest

from silvagrid.kernels import trees as K

F1 = np.array([[3, 3, 2, 2], [3, 4, 4, 2], [1, 4, 5, 2], [1, 1, 5, 0]])
RANDOM = [np.random.default_rng(s).integers(0, 6, (5 + s % 4, 6)) for s in range(12)]


def sets(h):
    return sorted((tuple(s.tolist()), float(a)) for s, a in zip(K.supports(h), h.altitude, strict=True))


def test_max_tree_of_a_known_image():
    h = K.component_tree(F1)
    assert h.parent.tolist() == [0, 0, 1, 2, 3, 4]
    assert h.altitude.tolist() == [0, 1, 2, 3, 4, 5]
    assert h.owner.tolist() == [3, 3, 2, 2, 3, 4, 4, 2, 1, 4, 5, 2, 1, 1, 5, 0]
    assert [len(s) for s in K.supports(h)] == [16, 15, 12, 8, 5, 2]


def test_min_tree_of_a_known_image():
    h = K.component_tree(F1, maximum=False)
    assert h.parent.tolist() == [0, 0, 1, 2, 2, 3]
    assert h.altitude.tolist() == [5, 4, 3, 2, 1, 0]
    assert h.owner.tolist() == [2, 2, 3, 3, 2, 1, 1, 3, 4, 1, 0, 3, 4, 4, 0, 5]


@pytest.mark.parametrize("image", RANDOM)
def test_component_trees_hold_the_level_sets(image):
    for maximum in (True, False):
        h = K.component_tree(image, maximum=maximum)
        got = {s for s, _ in sets(h)}
        want = set()
        for t in np.unique(image):
            mask = image >= t if maximum else image <= t
            todo = set(np.flatnonzero(mask.reshape(-1)).tolist())
            while todo:
                part, edge = set(), [todo.pop()]
                while edge:
                    p = edge.pop()
                    part.add(p)
                    for q in K.neighbours(p, *image.shape, K.stencil()):
                        if q in todo:
                            todo.discard(q)
                            edge.append(q)
                want.add(tuple(sorted(part)))
        assert got == want


@pytest.mark.parametrize("image", RANDOM)
def test_contrast_inversion_swaps_the_trees(image):
    a, b = K.component_tree(image), K.component_tree(-image, maximum=False)
    assert [s for s, _ in sets(a)] == [s for s, _ in sets(b)]


@pytest.mark.parametrize("image", RANDOM)
def test_every_construction_gives_the_image_back(image):
    for h, f in ((K.component_tree(image), 1), (K.tree_of_shapes(image), 2), (K.tree_of_shapes(image, "min4max8"), 1), (K.tree_of_shapes(image, "min8max4"), 1), (K.residual_tree(image)[0], 1), (K.residual_tree(image, saturated=True)[0], 1)):
        assert (h.altitude[h.owner].reshape(image.shape) == f * image).all()
        assert all(len(s) for s in K.supports(h))


def test_tree_of_shapes_with_an_empty_root():
    h = K.tree_of_shapes(np.array([[1, 1], [0, 0]]))
    assert len(h.parent) == 3 and h.altitude[h.root] == 1
    assert not (h.owner == h.root).any()
    i = K.tree_of_shapes(np.array([[1, 1], [2, 2]]))
    assert [s for s, _ in sets(h)] == [s for s, _ in sets(i)]


def test_residual_inversion():
    a, b = K.residual_tree(np.array([[0, 2, 0, 2, 1, 3]]))[0], K.residual_tree(np.array([[3, 1, 3, 1, 2, 0]]))[0]
    assert a.parent.tolist() == b.parent.tolist() and a.owner.tolist() == b.owner.tolist()


@pytest.mark.parametrize("saturated", [False, True])
def test_residual_tree_by_columns_is_that_of_the_transposed_image(saturated):
    for image in RANDOM:
        rows, cols = image.shape
        turned = np.arange(rows * cols).reshape(cols, rows).T.reshape(-1)  # each pixel's place, column by column
        one, events = K.residual_tree(image, saturated=saturated, places=turned)
        two, same = K.residual_tree(image.T.copy(), saturated=saturated)
        assert events == same and one.parent.tolist() == two.parent.tolist() and one.owner.tolist() == two.owner[turned].tolist()
        plain = K.residual_tree(image, saturated=saturated, places=np.arange(rows * cols))
        assert plain[1] == K.residual_tree(image, saturated=saturated)[1]


@pytest.mark.parametrize("places", [[0, 1, 2], [0, 1, 2, 2], [1, 2, 3, 4], [0.0, 1.0, 2.0, 3.0]])
def test_places_must_be_a_permutation(places):
    with pytest.raises(ValueError, match="permutation"):
        K.residual_tree(np.array([[0, 1], [2, 3]]), places=places)


def test_topology_counters():
    h = K.component_tree(F1, maximum=False)
    t = K.topology(h)
    assert t["size"].tolist() == [6, 5, 4, 2, 1, 1]
    assert t["depth"].tolist() == [0, 1, 2, 3, 3, 4]
    assert ((t["exit"] - t["entry"] - 1) // 2 == t["size"] - 1).all()


def test_stencils():
    assert len(K.stencil(1.0)) == 5 and len(K.stencil(1.5)) == 9
    with pytest.raises(ValueError):
        K.checked_stencil([(0, 0), (0, 1)])
    assert not K.connects([(0, 0), (0, 1), (0, -1)], 2, 2)
    assert K.connects(K.stencil(1.0), 3, 4)


def test_viterbi_decisions():
    h = K.Hierarchy(np.array([1, 2, 2]), np.array([0]), np.array([5, 3, 0]))
    assert K.viterbi(h, np.array([1.1, 0, 2]), 1.0, K.topology(h)).tolist() == [False, False, True]
    assert K.viterbi(h, np.array([10, 0.9, 2]), 1.0, K.topology(h)).tolist() == [True, True, True]


def test_alternating_filter_without_work_is_the_identity():
    for image in RANDOM:
        assert (K.alternating_filter(image, []) == image).all()
        assert (K.alternating_filter(image, [0]) == image).all()


def test_flat_leaves_tie():
    h = K.Hierarchy(np.array([3, 3, 3, 3]), np.array([0, 1, 2]), np.array([5, 5, 5, 0]))
    got = K.extinction(h, np.ones(4), K.topology(h))
    assert [r[3] for r in got].count(True) == 1 and sorted(r[2] for r in got)[:2] == [1.0, 1.0]


def test_two_equal_leaves_leave_one_dominant():
    h = K.Hierarchy(np.array([2, 2, 2]), np.array([0, 1]), np.array([5, 5, 0]))
    assert K.extinction(h, np.array([1.0, 1.0, 4.0]), K.topology(h)) == [(0, 2, float(np.finfo(np.float64).max), True), (1, 1, 1.0, False)]


def random_trees(n=120):
    rng = np.random.default_rng(21)
    for _ in range(n):
        h = K.component_tree(rng.integers(0, 6, (8, 8)), K.stencil(1.5), True)
        area = np.bincount(h.owner, minlength=len(h.parent)).astype(float)
        for v in np.argsort(K.topology(h)["post"]).tolist():
            if h.parent[v] != v:
                area[h.parent[v]] += area[v]
        yield h, area, np.minimum(area, rng.integers(5, 40))  # the second has ties from the root down


def test_extinction_on_random_trees():
    for h, *attributes in random_trees():
        for a in attributes:
            t, kids = K.topology(h), h.children()
            want, marked = {}, set()
            for leaf in sorted((v for v in range(len(kids)) if not kids[v]), key=lambda v: t["bfs"][v]):
                v = leaf
                while h.parent[v] != v:
                    family = kids[int(h.parent[v])] if len(kids[int(h.parent[v])]) > 1 else []
                    stops = [i for i, s in enumerate(family) if s != v and (a[s] > a[v] or (a[s] == a[v] and s in marked))]
                    marked.update(family[: stops[0] + 1] if stops else family)
                    if stops:
                        break
                    v = int(h.parent[v])
                want[leaf] = v
            got = K.extinction(h, a, t)
            assert {r[0]: r[1] for r in got} == want
            assert all(r[3] == (r[1] == h.parent[r[1]]) and (r[3] or r[2] == a[r[1]]) for r in got) and any(r[3] for r in got)
            # without ties there is one dominant leaf, and a larger extinction never ranks behind
            assert [r[2] for r in got] == sorted((r[2] for r in got), reverse=True)


def test_ultimate_opening_on_random_trees():
    rng = np.random.default_rng(22)
    for h, *attributes in random_trees(60):
        for a in attributes:
            most, chosen, kids = float(rng.integers(1, 60)), rng.random(len(h.parent)) < 0.7, h.children()
            contrast, related = np.zeros(len(a)), np.zeros(len(a), np.int64)
            root = next(v for v in range(len(a)) if h.parent[v] == v)

            def holds(v):
                return chosen[v] or any(holds(c) for c in kids[v] if a[c] == a[v])  # noqa: B023

            todo = [(c, float(h.altitude[root]), False, False) for c in kids[root]]
            while todo:
                v, base, grew, counts = todo.pop()
                p = int(h.parent[v])
                if a[v] != a[p]:
                    base = float(h.altitude[p])
                    counts = holds(v) if a[v] <= most else counts
                grows = False
                if a[v] <= most:
                    rest = abs(h.altitude[v] - base) * counts
                    grows = rest > contrast[p]
                    contrast[v] = rest if grows else contrast[p]
                    related[v] = a[v] + 1 if grows and not grew else related[p]
                todo += [(c, base, grows, counts) for c in kids[v]]
            got = K.ultimate_opening(h, a, most, chosen, K.topology(h))
            assert (got[0] == contrast).all() and (got[1] == related).all()


def test_ultimate_opening_of_a_chain():
    h = K.Hierarchy(np.array([1, 2, 3, 3]), np.array([0, 1, 2, 3]), np.array([9, 5, 4, 0]))
    a = np.array([1.0, 2.0, 2.0, 4.0])
    contrast, related = K.ultimate_opening(h, a, 3.0, None, K.topology(h))
    assert contrast.tolist() == [5.0, 5.0, 4.0, 0.0] and related.tolist() == [3, 3, 3, 0]
    flat = K.ultimate_opening(h, np.full(4, 2.0), 3.0, None, K.topology(h))
    assert not flat[0].any() and not flat[1].any()


def test_loops_of_a_ring():
    ring = {(r, c) for r in range(3) for c in range(3)} - {(1, 1)}
    areas = sorted(a for _, _, a in K.loops(ring))
    assert len(areas) == 2 and abs(areas[0]) + abs(areas[1]) == 18 + 2 and areas[0] * areas[1] < 0


def test_shape_space_of_a_chain():
    h = K.Hierarchy(np.array([1, 2, 2]), np.array([0, 0, 1, 2]), np.array([3, 2, 1]))
    canon = [(0, 1, 2), (0, 2, 1), (0, 3, 0)]
    assert K.shape_space(h, np.array([1, 4, 10]), True, canon).tolist() == [9, 0, 0]
    assert K.shape_space(h, np.array([1, 5, 2]), False, canon).tolist() == [0, 4, 0]
    assert K.shape_space(h, np.array([1, 5, 2]), True, canon).tolist() == [4, 0, 3]
