"""Hierarchies of one grid image, in numpy and plain Python, without recursion and without Spark.

Everything here works on one image and is called once per image from a grouped map; the cluster's parallelism is
across images. A hierarchy is (parent, owner, altitude): the parent of each node (the root is its own), the
smallest node that owns each pixel, and each node's altitude.
"""

from __future__ import annotations

import heapq
from collections import deque
from dataclasses import dataclass

import numpy as np


@dataclass
class Hierarchy:
    parent: np.ndarray
    owner: np.ndarray
    altitude: np.ndarray

    @property
    def root(self) -> int:
        return int(np.flatnonzero(self.parent == np.arange(len(self.parent)))[0])

    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.parent]
        for n, p in enumerate(self.parent.tolist()):
            if p != n:
                out[p].append(n)
        return out


def stencil(radius: float = 1.5) -> list[tuple[int, int]]:
    """Offsets (row, column) of a disk, the origin first, then by angle and distance."""
    r = int(radius)
    disk = [(dr, dc) for dr in range(-r, r + 1) for dc in range(-r, r + 1) if 0 < dr * dr + dc * dc <= radius * radius]
    return [(0, 0), *sorted(disk, key=lambda o: (np.arctan2(o[0], o[1]) % (2 * np.pi), o[0] ** 2 + o[1] ** 2))]


def rectangle(row_radius: int, col_radius: int) -> list[tuple[int, int]]:
    return [(0, 0), *[(r, c) for r in range(-row_radius, row_radius + 1) for c in range(-col_radius, col_radius + 1) if (r, c) != (0, 0)]]


def line(row_step: int, col_step: int, length: int) -> list[tuple[int, int]]:
    """A symmetric digital line of ``length`` steps to each side."""
    out = [(0, 0)]
    for k in range(1, length + 1):
        m = max(abs(row_step), abs(col_step), 1)
        o = (round(k * row_step / m), round(k * col_step / m))
        out += [o, (-o[0], -o[1])]
    return out


def checked_stencil(offsets: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A structuring element: the origin once, no repeats, symmetric about the origin."""
    seen = set(offsets)
    if len(seen) != len(offsets) or (0, 0) not in seen:
        raise ValueError("a structuring element holds the origin and no offset twice")
    if any((-r, -c) not in seen for r, c in seen):
        raise ValueError("a structuring element is symmetric about the origin")
    return offsets


def connects(offsets, rows: int, cols: int) -> bool:
    """Whether the stencil joins all pixels of the grid."""
    if any((1, 0) == o for o in offsets) and any((0, 1) == o for o in offsets):
        return True
    seen, todo = {0}, [0]
    while todo:
        p = todo.pop()
        for q in neighbours(p, rows, cols, offsets):
            if q not in seen:
                seen.add(q)
                todo.append(q)
    return len(seen) == rows * cols


def neighbours(p: int, rows: int, cols: int, offsets) -> list[int]:
    r, c = divmod(p, cols)
    return [(r + dr) * cols + c + dc for dr, dc in offsets if (dr or dc) and 0 <= r + dr < rows and 0 <= c + dc < cols]


def _neighbour_lists(rows: int, cols: int, offsets) -> list[list[int]]:
    return [neighbours(p, rows, cols, offsets) for p in range(rows * cols)]


def _union_find(order: list[int], near) -> np.ndarray:
    """Visits pixels from the last of ``order`` to the first; each becomes the root of what it touches."""
    n = len(order)
    up, top = [-1] * n, [-1] * n
    for p in reversed(order):
        up[p] = top[p] = p
        for q in near[p]:
            if top[q] >= 0:
                r = q
                while top[r] != r:
                    top[r] = top[top[r]]
                    r = top[r]
                if r != p:
                    up[r] = top[r] = p
    return np.array(up)


def component_tree(image: np.ndarray, offsets=None, maximum: bool = True) -> Hierarchy:
    """Max-tree (or min-tree): nodes numbered by level from the root's, then by their first pixel."""
    rows, cols = image.shape
    offsets = stencil() if offsets is None else offsets
    flat = image.reshape(-1)
    order = np.argsort(flat if maximum else -flat.astype(np.float64 if flat.dtype.kind == "f" else np.int64), kind="stable").tolist()
    up = _union_find(order, _neighbour_lists(rows, cols, offsets))
    values = flat.tolist()
    for p in order:  # from the root outwards: point to the first pixel of the parent's node
        q = int(up[p])
        if values[up[q]] == values[q]:
            up[p] = up[q]
    return _numbered(order, up.tolist(), values)


def _numbered(order, up, values) -> Hierarchy:
    number: dict[int, int] = {}
    parent, altitude = [], []
    owner = np.zeros(len(order), np.int64)
    for p in order:
        q = up[p]
        if p == q or values[q] != values[p]:
            number[p] = len(parent)
            parent.append(number[q] if q != p else number[p])
            altitude.append(values[p])
            owner[p] = number[p]
        else:
            owner[p] = number[q]
    return Hierarchy(np.array(parent), owner, np.array(altitude))


# ---------------------------------------------------------------- topology


def topology(h: Hierarchy) -> dict[str, np.ndarray]:
    """Columns of each node: depth, rank among its siblings, pre-order rank and subtree size, the shared event
    counter of entries and exits, post-order and breadth-first ranks."""
    n = len(h.parent)
    kids = h.children()
    out = {k: np.zeros(n, np.int64) for k in ("depth", "sibling", "pre", "size", "entry", "exit", "post", "bfs")}
    events = pre = post = 0
    stack = [(h.root, 0)]
    while stack:
        node, k = stack.pop()
        if not k:
            out["entry"][node], out["pre"][node] = events, pre
            events, pre = events + 1, pre + 1
        if k < len(kids[node]):
            child = kids[node][k]
            out["depth"][child], out["sibling"][child] = out["depth"][node] + 1, k
            stack += [(node, k + 1), (child, 0)]
        else:
            out["exit"][node], out["post"][node] = events, post
            out["size"][node] = pre - out["pre"][node]
            events, post = events + 1, post + 1
    todo = deque([h.root])
    for i in range(n):
        node = todo.popleft()
        out["bfs"][node] = i
        todo.extend(kids[node])
    return out


def paths(h: Hierarchy) -> list[list[int]]:
    """Ancestors of each node from the root to itself."""
    out: list[list[int] | None] = [None] * len(h.parent)
    out[h.root] = [h.root]
    for n in range(len(h.parent)):
        chain = []
        while out[n] is None:
            chain.append(n)
            n = int(h.parent[n])
        base = out[n]
        for c in reversed(chain):
            base = [*base, c]
            out[c] = base
    return out  # type: ignore[return-value]


# ---------------------------------------------------------------- tree of shapes


def tree_of_shapes(image: np.ndarray, immersion: str = "selfdual", exterior: bool = True, infinity: int = 0) -> Hierarchy:
    """Shapes by a flood from outside over an immersed grid; then only nodes that own source pixels, or join
    two or more branches, stay. Altitudes are doubled levels for "selfdual", source levels for "min4max8" and
    "min8max4"."""
    rows, cols = image.shape
    img = image.astype(np.int64)
    level = 2 * img if immersion == "selfdual" else img
    low, high, links = _immersed(level, immersion)
    shift = 1 if exterior else 0
    if not exterior:
        low, high = low[1:-1, 1:-1], high[1:-1, 1:-1]
        links = [((a - 1, b - 1), (c - 1, d - 1)) for (a, b), (c, d) in links]
    big_r, big_c = low.shape
    n = big_r * big_c
    lo, hi = low.reshape(-1).tolist(), high.reshape(-1).tolist()
    near = _neighbour_lists(big_r, big_c, [(-1, 0), (0, -1), (1, 0), (0, 1)])
    diagonal: dict[int, set[int]] = {}
    for (a, b), (c, d) in links:
        p, q = a * big_c + b, c * big_c + d
        diagonal.setdefault(p, set()).add(q)
        diagonal.setdefault(q, set()).add(p)
    for p, more in diagonal.items():  # down left, up right, down right, up left
        near[p] += [q for q in (p + big_c - 1, p - big_c + 1, p + big_c + 1, p - big_c - 1) if q in more]
    # the flood: nearest level first, the lower one on a tie, first in first out within a level
    queue: dict[int, deque] = {}
    below, above = [], []  # heaps of levels at or below, and above, the current one
    start = infinity
    current = lo[start]
    seen = [False] * n
    values = [0] * n
    order: list[int] = []

    def push(p: int) -> None:
        at = min(max(current, lo[p]), hi[p])
        if at not in queue or not queue[at]:
            queue.setdefault(at, deque())
            heapq.heappush(below, -at) if at <= current else heapq.heappush(above, at)
        queue[at].append(p)

    seen[start] = True
    push(start)
    left = 1
    while left:
        while above and above[0] <= current:
            heapq.heappush(below, -heapq.heappop(above))
        while below and -below[0] > current:
            heapq.heappush(above, -heapq.heappop(below))
        while below and not queue.get(-below[0]):
            heapq.heappop(below)
        while above and not queue.get(above[0]):
            heapq.heappop(above)
        if below and (not above or current + below[0] <= above[0] - current):
            current = -below[0]
        else:
            current = above[0]
        p = queue[current].popleft()
        left -= 1
        values[p] = current
        order.append(p)
        for q in near[p]:
            if not seen[q]:
                seen[q] = True
                push(q)
                left += 1
    up = _union_find(order, near).tolist()
    for p in order:
        q = up[p]
        if values[up[q]] == values[q]:
            up[p] = up[q]
    full = _numbered(order, up, values)
    source = np.array([(2 * r + shift) * big_c + 2 * c + shift for r in range(rows) for c in range(cols)])
    return _contracted(full, full.owner[source])


def _immersed(level: np.ndarray, immersion: str):
    """Interval [low, high] of each cell of the (2n + 1) grid, pixels at odd places, and pairs of cells that
    touch at a saddle's corner. The ring outside repeats the border's intervals; for "selfdual" all of it has the
    border pixels' median level."""
    padded = np.pad(level, 1, mode="edge")
    r, c = padded.shape
    low, high = np.zeros((2 * r - 1, 2 * c - 1), np.int64), np.zeros((2 * r - 1, 2 * c - 1), np.int64)
    low[::2, ::2] = high[::2, ::2] = padded
    for a, b, where in ((padded[:-1], padded[1:], (slice(1, None, 2), slice(0, None, 2))), (padded[:, :-1], padded[:, 1:], (slice(0, None, 2), slice(1, None, 2)))):
        low[where], high[where] = np.minimum(a, b), np.maximum(a, b)
    tl, tr, bl, br = padded[:-1, :-1], padded[:-1, 1:], padded[1:, :-1], padded[1:, 1:]
    low[1::2, 1::2] = np.minimum(np.minimum(tl, tr), np.minimum(bl, br))
    high[1::2, 1::2] = np.maximum(np.maximum(tl, tr), np.maximum(bl, br))
    links: list[tuple[tuple[int, int], tuple[int, int]]] = []
    if immersion == "selfdual":
        frame = np.zeros(level.shape, bool)
        frame[0], frame[-1], frame[:, 0], frame[:, -1] = True, True, True, True
        s = np.sort(level[frame])
        middle = (int(s[(len(s) - 1) // 2]) + int(s[len(s) // 2])) // 2
        for x in (low, high):
            x[1], x[-2], x[:, 1], x[:, -2] = middle, middle, middle, middle
    else:
        for i, j in np.argwhere((np.minimum(tl, br) > np.maximum(tr, bl)) | (np.maximum(tl, br) < np.minimum(tr, bl))).tolist():
            falling = min(tl[i, j], br[i, j]) > max(tr[i, j], bl[i, j])  # the high diagonal falls from left to right
            if immersion == "min8max4":
                falling = not falling
            y, x = 2 * i, 2 * j  # the saddle's cell, once the outermost cells are cut off
            pair = (tl[i, j], br[i, j]) if falling else (tr[i, j], bl[i, j])
            low[y + 1, x + 1], high[y + 1, x + 1] = min(pair), max(pair)
            if falling:
                links += [((y - 1, x - 1), (y, x)), ((y, x), (y + 1, x + 1)), ((y, x - 1), (y + 1, x)), ((y - 1, x), (y, x + 1))]
            else:
                links += [((y - 1, x + 1), (y, x)), ((y, x), (y + 1, x - 1)), ((y, x - 1), (y - 1, x)), ((y + 1, x), (y, x + 1))]
    return low[1:-1, 1:-1], high[1:-1, 1:-1], links


def _contracted(full: Hierarchy, owner: np.ndarray) -> Hierarchy:
    """Keeps nodes that own one of the pixels, or at which two kept branches meet."""
    n = len(full.parent)
    owns = np.bincount(owner, minlength=n) > 0
    branches = np.zeros(n, np.int64)
    keep = np.zeros(n, bool)
    for v in range(n - 1, -1, -1):  # children have larger numbers
        keep[v] = owns[v] or branches[v] >= 2
        carries = keep[v] or branches[v] == 1
        if v and carries:
            branches[full.parent[v]] += 1
    number = np.cumsum(keep) - 1
    above = np.zeros(n, np.int64)
    parent = []
    for v in range(n):
        p = int(full.parent[v])
        above[v] = v if keep[v] else above[p]
        if keep[v]:
            parent.append(number[above[p]] if v and keep[above[p]] and parent else number[v])
    return Hierarchy(np.array(parent), number[owner], full.altitude[keep])


# ---------------------------------------------------------------- residual trees


def checked_places(places, n: int) -> list[int]:
    """places as a list, if they are a permutation of range(n)."""
    out = np.asarray(places)
    if out.shape != (n,) or out.dtype.kind not in "iu" or not np.array_equal(np.sort(out), np.arange(n)):
        raise ValueError("the places of pixels must be a permutation of 0 to their number")
    return out.tolist()


def residual_tree(image: np.ndarray, offsets=None, saturated: bool = False, infinity: int = 0, places=None):
    """Self-dual residual tree: leaves of the max- and min-tree of the current image are levelled, the smallest
    support first, ties by the pixel that comes first. Pixels come in row-major order, or in that of their
    ``places``, a permutation. Saturated: only supports without the pixel at infinity whose
    complement is connected. Returns the tree and its events (polarity, altitude, merging level)."""
    rows, cols = image.shape
    offsets = stencil(1.0) if offsets is None else offsets
    near = _neighbour_lists(rows, cols, offsets)
    n = rows * cols
    place = range(n) if places is None else checked_places(places, n)
    at = np.empty(n, np.int64)
    at[np.asarray(place)] = np.arange(n)  # the pixel of each place
    value = image.reshape(-1).astype(np.int64).tolist()
    zone = [-1] * n  # flat zone of each pixel
    members: dict[int, set[int]] = {}
    fresh = 0

    def flood(p: int) -> set[int]:
        out, todo = {p}, [p]
        while todo:
            x = todo.pop()
            for q in near[x]:
                if q not in out and value[q] == value[x]:
                    out.add(q)
                    todo.append(q)
        return out

    for p in range(n):
        if zone[p] < 0:
            members[fresh] = flood(p)
            for q in members[fresh]:
                zone[q] = fresh
            fresh += 1

    def extremum(z: int):
        """(levels outside, polarity) if the zone is a leaf of one of the two trees."""
        own = members[z]
        out = {value[q] for p in own for q in near[p] if q not in own}
        level = value[next(iter(own))]
        if not out:
            return None
        if all(v < level for v in out):
            return max(out), 1
        if all(v > level for v in out):
            return min(out), -1
        return None

    def fits(own: set[int]) -> bool:
        if not saturated:
            return True
        if infinity in own:
            return False
        seen, todo = {infinity}, [infinity]
        while todo:
            x = todo.pop()
            for q in near[x]:
                if q not in seen and q not in own:
                    seen.add(q)
                    todo.append(q)
        return len(seen) == n - len(own)

    heap = []
    for z in list(members):
        if extremum(z):
            heapq.heappush(heap, (len(members[z]), min(map(place.__getitem__, members[z])), z))
    parent_of: dict[int, int] = {}
    tops: dict[int, list[int]] = {z: [] for z in members}  # open event nodes inside a zone
    unowned: dict[int, set[int]] = {z: set(m) for z, m in members.items()}
    owner = np.zeros(n, np.int64)
    events = []
    while heap:
        size, first, z = heapq.heappop(heap)
        if z not in members or len(members[z]) != size:
            continue
        found = extremum(z)
        if not found or not fits(members[z]):
            continue
        to, polarity = found
        own = members[z]
        node = len(events) + 1
        events.append((polarity, value[at[first]], to))
        for p in unowned[z]:
            owner[p] = node
        for c in tops[z]:
            parent_of[c] = node
        for p in own:
            value[p] = to
        touched = {zone[q] for p in own for q in near[p] if q not in own and value[q] == to}
        around = {zone[q] for p in own for q in near[p] if q not in own}
        merged, opened, free = set(own), [node], set()
        for t in touched:
            merged |= members.pop(t)
            opened += tops.pop(t)
            free |= unowned.pop(t)
        del members[z], tops[z], unowned[z]
        members[fresh], tops[fresh], unowned[fresh] = merged, opened, free
        for p in merged:
            zone[p] = fresh
        again = {fresh} | (around - touched) | {zone[q] for p in merged for q in near[p]}
        for t in again:
            if t in members and extremum(t):
                heapq.heappush(heap, (len(members[t]), min(map(place.__getitem__, members[t])), t))
        fresh += 1
    parent = [0] * (len(events) + 1)
    for c, p in parent_of.items():
        parent[c] = p
    # what no event owns belongs to the last level
    last = value[infinity]
    altitude = [last] + [e[1] for e in events]
    return Hierarchy(np.array(parent), owner, np.array(altitude)), events


# ---------------------------------------------------------------- kernels over a tree and a node attribute


def extinction(h: Hierarchy, attribute: np.ndarray, top: dict[str, np.ndarray]) -> list[tuple[int, int, float, bool]]:
    """(leaf, cutoff node, extinction, dominant). Leaves climb in breadth-first order. In each family of two or more
    the climber's siblings are looked at in order, itself among them: a larger one ends the climb, and so does an equal one
    that a climb has looked at before. All that were looked at up to there are remembered. Sorted by extinction
    falling, cutoff, leaf."""
    kids, seen = h.children(), set()
    leaves = sorted((n for n in range(len(kids)) if not kids[n]), key=lambda n: top["bfs"][n])

    def beaten(node: int, family: list[int]) -> bool:
        mine = attribute[node]
        for s in family:
            lost = s != node and (attribute[s] > mine or (attribute[s] == mine and s in seen))
            seen.add(s)
            if lost:
                return True
        return False

    out = []
    for leaf in leaves:
        node, dominant = leaf, True
        while node != h.parent[node]:
            family = kids[int(h.parent[node])]
            if len(family) > 1 and beaten(node, family):
                dominant = False
                break
            node = int(h.parent[node])
        out.append((leaf, node, float(np.finfo(np.float64).max) if dominant else float(attribute[node]), dominant))
    return sorted(out, key=lambda r: (-r[2], r[1], r[0]))


def viterbi(h: Hierarchy, attribute: np.ndarray, threshold: float, top: dict[str, np.ndarray]) -> np.ndarray:
    """Kept nodes of the cheapest decision in which what is below a removed node is removed; ties remove, the
    root stays."""
    n = len(h.parent)
    keep_cost, drop_cost = np.maximum(0, threshold - attribute), np.maximum(0, attribute - threshold)
    kept, gone = keep_cost.astype(float), drop_cost.astype(float)
    order = np.argsort(top["post"])
    for v in order.tolist():
        p = int(h.parent[v])
        if p != v:
            kept[p] += min(kept[v], gone[v])
            gone[p] += gone[v]
    out = np.zeros(n, bool)
    for v in order[::-1].tolist():
        p = int(h.parent[v])
        out[v] = p == v or (out[p] and kept[v] < gone[v])
    return out


def ultimate_opening(h: Hierarchy, attribute: np.ndarray, most: float, selected: np.ndarray | None, top) -> tuple[np.ndarray, np.ndarray]:
    """Largest contrast over the attribute's primitives, and the attribute (plus one) at which it is reached."""
    n = len(h.parent)
    selected = np.ones(n, bool) if selected is None else selected
    contrast, related = np.zeros(n), np.zeros(n, np.int64)
    outside, grown, counts = h.altitude.astype(float).copy(), np.zeros(n, bool), np.zeros(n, bool)
    order = np.argsort(top["pre"]).tolist()
    # the primitive of a node: the chain above it with one attribute value, and whether it holds a selected node
    head = np.arange(n)
    for v in order:
        p = int(h.parent[v])
        if p != v and attribute[v] == attribute[p]:
            head[v] = head[p]
    chosen = np.bincount(head, selected.astype(float), n) > 0
    for v in order:
        p = int(h.parent[v])
        if p == v:
            continue
        # a primitive within the bound decides whether residues count from there down; the root's never counts
        begins, small = head[v] == v, attribute[v] <= most
        outside[v] = h.altitude[p] if begins else outside[p]
        counts[v] = chosen[v] if begins and small else counts[p]
        if not small:
            continue
        rest = abs(float(h.altitude[v]) - outside[v]) if counts[v] else 0.0
        grown[v] = rest > contrast[p]
        contrast[v] = max(rest, contrast[p])
        # where the parent's contrast has just grown too, its attribute stays the one that is told
        related[v] = int(attribute[v] + 1) if grown[v] and not grown[p] else related[p]
    return contrast, related


def watershed_dendrogram(edges: list[tuple[int, int]], lca: list[int], owner: np.ndarray, h: Hierarchy, component: dict[int, float], rising: bool):
    """Kruskal over edges (same owner first, then by altitude of the meeting node, source, target); a merge
    persists by the smaller of the two sides' extinctions. Returns the dendrogram over pixels by (persistence,
    edge order): a list of (persistence, left, right) with pixels 0..P-1 and merges from P on."""
    n = len(owner)
    key = lambda i: (owner[edges[i][0]] != owner[edges[i][1]], -h.altitude[lca[i]] if rising else h.altitude[lca[i]], edges[i])
    order = sorted(range(len(edges)), key=key)
    top = list(range(n))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    best = [component.get(p, 0.0) for p in range(n)]
    merges = []
    for rank, i in enumerate(order):
        a, b = find(edges[i][0]), find(edges[i][1])
        if a != b:
            merges.append((min(best[a], best[b]), rank, *edges[i]))
            top[b] = a
            best[a] = max(best[a], best[b])
    top, node, out = list(range(n)), list(range(n)), []
    for persistence, _, p, q in sorted(merges):
        a, b = find(p), find(q)
        out.append((persistence, node[a], node[b]))
        top[b] = a
        node[a] = n + len(out) - 1
    return out


def dendrogram_levels(merges, n: int, pairs: list[tuple[int, int]]) -> list[float]:
    """The persistence at which the two pixels of each pair meet."""
    up = list(range(n + len(merges)))
    for k, (_, a, b) in enumerate(merges):
        up[a] = up[b] = n + k
    out = []
    for p, q in pairs:
        seen = set()
        while True:
            seen.add(p)
            if up[p] == p:
                break
            p = up[p]
        while q not in seen:
            q = up[q]
        out.append(float(merges[q - n][0]) if q >= n else 0.0)
    return out


def shape_space(h: Hierarchy, score: np.ndarray, minima: bool, canon: list[tuple]) -> np.ndarray:
    """Persistence of the score's extrema over the tree taken as a graph; plateaus count once, at their node of
    least depth. At a merge the older extremum stays; ties by the canonical order."""
    n = len(h.parent)
    value = score.astype(float) if minima else -score.astype(float)
    near: list[list[int]] = [[] for _ in range(n)]
    for v, p in enumerate(h.parent.tolist()):
        if p != v:
            near[v].append(p)
            near[p].append(v)
    top = list(range(n))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    born: dict[int, tuple] = {}  # of a component's root: (birth level, canonical order, plateau node)
    out = np.zeros(n)
    done = np.zeros(n, bool)
    order = sorted(range(n), key=lambda v: value[v])
    i = 0
    while i < n:
        j = i
        while j < n and value[order[j]] == value[order[i]]:
            j += 1
        batch, level = order[i:j], value[order[i]]
        inside = set(batch)
        plateaus, seen = [], set()
        for v in batch:
            if v not in seen:
                plateau, todo = [v], [v]
                seen.add(v)
                while todo:
                    for q in near[todo.pop()]:
                        if q in inside and q not in seen:
                            seen.add(q)
                            plateau.append(q)
                            todo.append(q)
                plateaus.append(plateau)
        for plateau in plateaus:
            older = {find(q) for v in plateau for q in near[v] if done[q]}
            rep = min(plateau, key=lambda v: (canon[v][2], canon[v]))
            if not older:
                for v in plateau:
                    top[v] = plateau[0]
                born[plateau[0]] = (level, canon[rep], rep)
            else:
                ranked = sorted(older, key=lambda r: born[r][:2])
                for r in ranked[1:]:
                    out[born[r][2]] = abs(level - born[r][0])
                    top[r] = ranked[0]
                for v in plateau:
                    top[v] = ranked[0]
        for v in batch:
            done[v] = True
        i = j
    last = born[find(h.root)]
    out[last[2]] = abs(value.max() - last[0])
    return out


# ---------------------------------------------------------------- contours, distances, alternating filters

SIDES = {"N": ((-1, 0), (0, 0), (0, 1)), "E": ((0, 1), (0, 1), (1, 1)), "S": ((1, 0), (1, 1), (1, 0)), "W": ((0, -1), (1, 0), (0, 0))}
_TURN = {"right": 0, "straight": 1, "left": 2, "back": 3}


def loops(support: set[tuple[int, int]]) -> list[tuple[int, list[tuple[int, int, str]], int]]:
    """Closed walks along the exposed sides of a support, with it on the right: (loop, sides, doubled area).
    At a corner a walk turns right if it can, else goes straight, left or back."""
    edges = []
    for r, c in sorted(support):
        for side, ((dr, dc), (ar, ac), (br, bc)) in SIDES.items():
            if (r + dr, c + dc) not in support:
                edges.append(((r + ar, c + ac), (r + br, c + bc), (r, c, side)))
    leaving: dict[tuple[int, int], list[int]] = {}
    for i, e in enumerate(edges):
        leaving.setdefault(e[0], []).append(i)
    used, out = [False] * len(edges), []
    for i in range(len(edges)):
        if used[i]:
            continue
        walk, at = [], i
        while True:
            used[at] = True
            walk.append(at)
            if edges[at][1] == edges[i][0]:
                break
            (r0, c0), (r1, c1), _ = edges[at]
            dr, dc = r1 - r0, c1 - c0

            def turn(k: int) -> int:
                er, ec = edges[k][1][0] - edges[k][0][0], edges[k][1][1] - edges[k][0][1]
                cross = dc * er - dr * ec  # noqa: B023
                return _TURN["right"] if cross > 0 else _TURN["left"] if cross < 0 else _TURN["straight"] if dr * er + dc * ec > 0 else _TURN["back"]  # noqa: B023

            at = min((k for k in leaving[edges[at][1]] if not used[k]), key=lambda k: (turn(k), k))
        area = sum(edges[k][0][1] * edges[k][1][0] - edges[k][1][1] * edges[k][0][0] for k in walk)
        out.append((len(out), [edges[k][2] for k in walk], area))
    return out


def max_distance(rows: int, cols: int, supports: list[np.ndarray]) -> list[float]:
    """Largest squared distance of a support's pixels to its contour pixels (exact)."""
    out = []
    for own in supports:
        mask = np.zeros((rows + 2, cols + 2), bool)
        r, c = np.divmod(own, cols)
        mask[r + 1, c + 1] = True
        inner = mask[:-2, 1:-1] & mask[2:, 1:-1] & mask[1:-1, :-2] & mask[1:-1, 2:] & mask[1:-1, 1:-1]
        edge = np.argwhere(mask[1:-1, 1:-1] & ~inner)
        most = 0.0
        for a in range(0, len(r), 1024):
            d = (r[a : a + 1024, None] - edge[:, 0]) ** 2 + (c[a : a + 1024, None] - edge[:, 1]) ** 2
            most = max(most, float(d.min(1).max()))
        out.append(most)
    return out


def supports(h: Hierarchy) -> list[np.ndarray]:
    """Pixels of each node's support."""
    out: list[list[int]] = [[] for _ in h.parent]
    for p, v in enumerate(h.owner.tolist()):
        while True:
            out[v].append(p)
            if h.parent[v] == v:
                break
            v = int(h.parent[v])
    return [np.array(x, np.int64) for x in out]


def _measure(h: Hierarchy, cols: int, kind: str, top) -> np.ndarray:
    n = len(h.parent)
    area = np.bincount(h.owner, minlength=n).astype(np.int64)
    r, c = np.divmod(np.arange(len(h.owner)), cols)
    lo_r, hi_r, lo_c, hi_c = np.full(n, 1 << 30), np.full(n, -1), np.full(n, 1 << 30), np.full(n, -1)
    np.minimum.at(lo_r, h.owner, r), np.maximum.at(hi_r, h.owner, r), np.minimum.at(lo_c, h.owner, c), np.maximum.at(hi_c, h.owner, c)
    for v in np.argsort(top["post"]).tolist():
        p = int(h.parent[v])
        if p != v:
            area[p] += area[v]
            lo_r[p], hi_r[p], lo_c[p], hi_c[p] = min(lo_r[p], lo_r[v]), max(hi_r[p], hi_r[v]), min(lo_c[p], lo_c[v]), max(hi_c[p], hi_c[v])
    height, width = hi_r - lo_r + 1, hi_c - lo_c + 1
    return {"AREA": area, "BOUNDING_BOX_WIDTH": width, "BOUNDING_BOX_HEIGHT": height, "BOUNDING_BOX_DIAGONAL": np.sqrt(width**2.0 + height**2.0)}[kind]


def pruned(image: np.ndarray, maximum: bool, kind: str, threshold: float, offsets=None) -> np.ndarray:
    """The image without the topmost nodes whose measure is at most the threshold."""
    h = component_tree(image, offsets, maximum)
    top = topology(h)
    measure = _measure(h, image.shape[1], kind, top)
    value = h.altitude.copy()
    cut = np.zeros(len(value), bool)
    for v in np.argsort(top["pre"]).tolist():
        p = int(h.parent[v])
        if p != v and (cut[p] or measure[v] <= threshold):
            cut[v], value[v] = True, value[p]
    return value[h.owner].reshape(image.shape)


def alternating_filter(image: np.ndarray, thresholds, kind: str = "AREA", offsets=None) -> np.ndarray:
    """For each threshold the max-tree's, then the min-tree's nodes up to it are pruned."""
    for t in thresholds:
        image = pruned(pruned(image, True, kind, t, offsets), False, kind, t, offsets)
    return image
