"""Whole builds of many small maps of one size at once: ``kernels.build`` of each map of a stack, its stages on arrays.

Distances, thinning, collisions, simplification and the triangulation go over all maps together; branches, contours and merging are
walked on numbers. Nodes are numbered row * (2 * width) + column, as by ``kernels.crossings``.
"""

from __future__ import annotations

import math

import numpy as np

from .kernels import Config, Graph, crossings, merge_sweeps, sample_free, squared_distance, thin
from .packed import walks

NEAR = ((-1, 0), (0, -1), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1))
TOO_WIDE = 20_000  # cells across, from which circles don't fit 64 bits


def _next(h: np.ndarray) -> np.ndarray:
    return h + 1 - 3 * (h % 3 == 2)


def _strips(k: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sides (their first corners, three to a triangle; the opposite sides, -1 at the rim) of triangles between neighbouring
    rows of points, and of fans to two points far to the left (n) and right (n + 1)."""
    n = len(k)
    new = np.ones(n, bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    row = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    strip = k[first[1:]] == k[first[:-1]]  # between a row and the next
    above, below = np.append(False, strip), np.append(strip, False)
    seg = np.flatnonzero(~new[1:])  # from a point to the next of its row
    down, up = seg[below[row[seg]]], seg[above[row[seg]]]
    where = np.concatenate([row[down], row[up] - 1])
    kind = np.repeat([0, 1], [len(down), len(up)])
    point = np.concatenate([down, up])
    order = np.lexsort((kind, c[point] + c[point + 1], where))
    where, kind, point = where[order], kind[order], point[order]
    t, s = len(order), np.flatnonzero(strip)
    start = np.searchsorted(where, where)
    before = np.append(0, np.cumsum(kind))
    b = first[where + 1] + before[:-1] - before[start]
    a = first[where] + np.arange(t) - start - (before[:-1] - before[start])
    org = np.empty(3 * (t + 2 * len(s)), np.int64)
    twin = np.full(len(org), -1)
    # a side along the row, from the left side, to the right side: (a + 1, a, b) under the upper row, (b, b + 1, a) over the lower
    org[0 : 3 * t : 3] = np.where(kind == 0, a + 1, b)
    org[1 : 3 * t : 3] = np.where(kind == 0, a, b + 1)
    org[2 : 3 * t : 3] = np.where(kind == 0, b, a)
    at = 3 * np.arange(t)
    side = np.full((2, n), -1)
    side[kind, point] = at

    def tie(x: np.ndarray, y: np.ndarray) -> None:
        twin[x], twin[y] = y, x

    both = (side >= 0).all(axis=0)
    tie(side[0, both], side[1, both])
    left, right = at + 1 + kind, at + 2 - kind
    same = np.flatnonzero(where[1:] == where[:-1])
    tie(right[same], left[same + 1])
    f = 3 * (t + np.arange(len(s)))  # (b, a, left), then (a, b, right)
    g = f + 3 * len(s)
    org[f], org[f + 1], org[f + 2] = first[s + 1], first[s], n
    org[g], org[g + 1], org[g + 2] = last[s], last[s + 1], n + 1
    begin, end = np.searchsorted(where, s), np.searchsorted(where, s, "right")
    some = end > begin
    tie(f[some], left[begin[some]])
    tie(g[some], right[end[some] - 1])
    tie(f[~some], g[~some])
    on = np.flatnonzero(s[1:] == s[:-1] + 1)
    tie(f[on] + 2, f[on + 1] + 1)
    tie(g[on] + 1, g[on + 1] + 2)
    return org, twin


def triangulated(k: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i < j) of ``kernels.triangulate`` of the points of each map k; points are distinct, in order of k, r, c.

    Rows of points are joined to strips, then sides whose opposite corners lie in each other's circles are flipped, all that
    share no triangle at once. Of four points on a circle the last counts as higher, so its diagonal is flipped.
    """
    n = len(k)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    org, twin = _strips(k, r, c)
    r, c = (np.append(x, [0, 0]).astype(np.int64) for x in (r, c))
    open_ = np.flatnonzero(np.arange(len(twin)) < twin)
    claim = np.empty(len(org) // 3, np.int64)
    while len(open_):
        h, g = open_, twin[open_]
        a, b, x, y = org[h], org[g], org[_next(_next(h))], org[_next(_next(g))]
        far = (a >= n) | (b >= n)
        # corners a, b, x in turn; y lies beyond a to b
        ar, ac, br, bc, xr, xc = r[a] - r[y], c[a] - c[y], r[b] - r[y], c[b] - c[y], r[x] - r[y], c[x] - c[y]
        det = (ar * ar + ac * ac) * (br * xc - bc * xr) - (br * br + bc * bc) * (ar * xc - ac * xr) + (xr * xr + xc * xc) * (ar * bc - ac * br)
        bad = (det > 0) | ((det == 0) & (np.maximum(a, b) > np.maximum(x, y)))
        # towards a far point a corner goes that lies within the others' hull: (a, y, x) or (y, b, x) turns as all triangles do
        bad = np.where(far, np.where(b >= n, ac * xr - ar * xc, br * xc - bc * xr) > 0, bad & (x < n) & (y < n))
        h, g = h[bad], g[bad]
        if not len(h):
            break
        # a side flips if both of its triangles are its own; the last one's are
        claim[np.stack([h // 3, g // 3], axis=1).ravel()] = np.repeat(h, 2)
        mine = (claim[h // 3] == h) & (claim[g // 3] == h)
        later, h, g = h[~mine], h[mine], g[mine]
        h1, g1 = _next(h), _next(g)
        h2, g2 = _next(h1), _next(g1)
        x, y = org[h2], org[g2]
        moved = np.concatenate([h2, g2])
        to = np.concatenate([g, h])
        opposite = twin[moved]
        # an opposite side that moves itself is where it goes to
        place = np.arange(len(org)) if len(h) * 8 > len(org) else None
        if place is not None:
            place[moved] = to
            known = np.where(opposite >= 0, place[opposite], -1)
        else:
            o = np.argsort(moved)
            at = np.minimum(np.searchsorted(moved[o], opposite), len(o) - 1)
            known = np.where(moved[o][at] == opposite, to[o][at], opposite)
        org[h], org[g] = y, x
        twin[to] = known
        there = known >= 0
        twin[known[there]] = to[there]
        twin[h2], twin[g2] = g2, h2
        around = np.concatenate([later, h, h1, g, g1])
        around = around[twin[around] >= 0]
        open_ = np.unique(np.minimum(around, twin[around]))
    real = np.repeat((org.reshape(-1, 3) < n).all(axis=1), 3)
    h = np.flatnonzero(real)
    h = h[~real[twin[h]] | (twin[h] < 0) | (h < twin[h])]
    a, b = org[h], org[_next(h)]
    return np.minimum(a, b), np.maximum(a, b)


def _skeleton_lines(skeleton: np.ndarray, gap: int) -> np.ndarray:
    """(map, r0, c0, r1, c1) of the lines along ``kernels.branches`` of each map of a stack, about ``gap`` cells a line, in order."""
    m, h, w = skeleton.shape
    cell = np.argwhere(skeleton)
    n = len(cell)
    name = np.full((m, h + 2, w + 2), -1)
    name[:, 1:-1, 1:-1][skeleton] = np.arange(n)
    k, r, c = cell.T
    beside = np.stack([name[k, r + 1 + a, c + 1 + b] for a, b in NEAR], axis=1)
    there = beside >= 0
    degree = there.sum(axis=1)
    ends = np.append(0, np.cumsum(degree)).tolist()
    near = beside[there].tolist()
    stop = (degree != 2).tolist()
    # a cell between two others is on one path; two neighbouring ends are walked from the first
    seen, paths = [False] * n, []
    for start in [*np.flatnonzero(degree != 2).tolist(), *np.flatnonzero(degree == 2).tolist()]:
        ended = stop[start]
        if not ended and seen[start]:
            continue
        for here in near[ends[start] : ends[start + 1]]:
            if (here < start) if stop[here] else seen[here]:
                continue
            if not ended and seen[start]:
                break
            path, prev = [start], start
            while True:
                path.append(here)
                if stop[here]:
                    break
                seen[here] = True
                if here == start:
                    break
                at = ends[here]
                prev, here = here, near[at + 1] if near[at] == prev else near[at]
            paths.append(path)
    paths.sort(key=lambda p: k[p[0]])
    pairs = []
    for path in paths:
        size = len(path)
        parts = max(1, size // gap)
        seg = size // parts
        pairs += [(path[j * seg], path[min((j + 1) * seg, size - 1)]) for j in range(parts)]
    p, q = np.array(pairs, np.int64).reshape(-1, 2).T
    return np.stack([k[p], r[p], c[p], r[q], c[q]], axis=1)


#: ``kernels.contours``: for a square's corner pattern, its lines from one side's middle to another's, in half cells.
SQUARES = {1: [(2, 1, 1, 0)], 2: [(1, 2, 2, 1)], 3: [(1, 2, 1, 0)], 4: [(0, 1, 1, 2)], 5: [(0, 1, 1, 2), (2, 1, 1, 0)], 6: [(0, 1, 2, 1)], 7: [(0, 1, 1, 0)], 8: [(1, 0, 0, 1)], 9: [(2, 1, 0, 1)], 10: [(1, 0, 0, 1), (1, 2, 2, 1)], 11: [(1, 2, 0, 1)], 12: [(1, 0, 1, 2)], 13: [(2, 1, 1, 2)], 14: [(1, 0, 2, 1)]}


def _rings(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(map of each ring, rings' bounds, points) of ``kernels.contours`` of each map of a stack."""
    f = np.pad(mask, ((0, 0), (1, 1), (1, 1)))
    case = f[:, :-1, :-1] * 8 + f[:, :-1, 1:] * 4 + f[:, 1:, 1:] * 2 + f[:, 1:, :-1]
    m, up, across = case.shape[0], 2 * case.shape[1] + 2, 2 * case.shape[2] + 2
    starts, goals = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for pattern, lines in SQUARES.items():
        k, r, c = np.nonzero(case == pattern)
        for a, b, x, y in lines:
            starts.append((k * up + 2 * r + a) * across + 2 * c + b)
            goals.append((k * up + 2 * r + x) * across + 2 * c + y)
    starts, goals = np.concatenate(starts), np.concatenate(goals)
    order = np.argsort(starts)
    follow = np.searchsorted(starts[order], goals[order]).tolist()
    seen, points, bounds = [False] * len(follow), [], [0]
    for start in range(len(follow)):
        if seen[start]:
            continue
        here = start
        while not seen[here]:
            seen[here] = True
            points.append(here)
            here = follow[here]
        points.append(start)
        bounds.append(len(points))
    at = starts[order][np.array(points, np.int64)]
    k, left = np.divmod(at, up * across)
    bounds = np.array(bounds)
    return k[bounds[:-1]], bounds, np.stack([left // across / 2 - 1, left % across / 2 - 1], axis=1)


def _kept(bounds: np.ndarray, points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points ``kernels.simplify`` keeps of each ring: all open spans are split at once."""
    keep = np.zeros(len(points), bool)
    i, j = bounds[:-1], bounds[1:] - 1
    keep[i] = keep[j] = True
    while True:
        long = j - i >= 2
        i, j = i[long], j[long]
        if not len(i):
            return keep
        n = j - i - 1
        start = np.cumsum(n) - n
        span = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(span)) - start[span] + i[span] + 1
        d = points[j] - points[i]
        size = np.array([math.hypot(a, b) for a, b in d.tolist()])
        p = points[at] - points[i][span]
        whole = size[span]
        flat = np.abs(p[:, 0] * d[span, 1] - p[:, 1] * d[span, 0])
        far = np.where(whole > 0, flat / np.where(whole > 0, whole, 1), np.hypot(p[:, 0], p[:, 1]))
        top = np.maximum.reduceat(far, start)
        best = np.flatnonzero(far == top[span])
        first = best[np.append(True, span[best][1:] != span[best][:-1])]
        split = top > tolerance
        k = at[first][split]
        keep[k] = True
        i, j = np.concatenate([i[split], k]), np.concatenate([k, j[split]])


def _boundary(wide: np.ndarray, h: int, w: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(map, row, col) of the nodes along the simplified contours of a padded stack, and the number of the next node of its ring."""
    ring_map, bounds, points = _rings(wide)
    keep = _kept(bounds, points - 1, 0.6)
    ring = np.repeat(np.arange(len(ring_map)), np.diff(bounds))
    keep[bounds[1:] - 1] = False  # the first again
    p, ring = np.clip((points - 1)[keep], 0, (h - 1, w - 1)), ring[keep]
    many = np.bincount(ring, minlength=len(ring_map))[ring] >= 2
    p, ring = p[many], ring[many]

    def following(ring: np.ndarray) -> np.ndarray:
        new = np.append(True, ring[1:] != ring[:-1])[: len(ring)]
        first = np.flatnonzero(new)
        nxt = np.arange(1, len(ring) + 1)
        nxt[np.append(first[1:], len(ring))[: len(first)] - 1] = first
        return nxt

    d = p[following(ring)] - p
    n = np.maximum(1, np.array([int(math.hypot(a, b) / gap) for a, b in d.tolist()], np.int64))
    at = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(at)) - (np.cumsum(n) - n)[at]
    cells = (p[at] + d[at] * i[:, None] / n[at][:, None]).astype(int)
    return np.column_stack([ring_map[ring[at]], cells]), following(ring[at])


def _open(blocked: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Which (map, r0, c0, r1, c1) meet no blocked cell; ends lie on the map."""
    out = np.ones(len(lines), bool)
    for a in range(0, len(lines), 20_000):
        part = lines[a : a + 20_000]
        line, row, col = walks(*part[:, 1:].T)
        out[a : a + 20_000] = np.bincount(line, blocked[part[line, 0], row, col], len(part)) == 0
    return out


def _dealt(m: int, key: np.ndarray, *columns: np.ndarray) -> list[tuple[list, ...]]:
    """The columns as lists for each of ``m`` maps; rows stay in order."""
    order = np.argsort(key, kind="stable")
    cuts = np.searchsorted(key[order], np.arange(m + 1)).tolist()
    held = [c[order].tolist() for c in columns]
    return [tuple(c[a:b] for c in held) for a, b in zip(cuts, cuts[1:], strict=False)]


def _pruned(near: dict[int, dict[int, str]], stride: int, shortest: float) -> None:
    """``kernels.prune`` after the merge: nodes without edges go, and components of less total length."""
    for p in [p for p, q in near.items() if not q]:
        del near[p]
    left = set(near)
    while left:
        part, todo = set(), [next(iter(left))]
        while todo:
            p = todo.pop()
            if p not in part:
                part.add(p)
                todo += near[p]
        left -= part
        if sum(math.hypot(p // stride - q // stride, p % stride - q % stride) for p in part for q in near[p]) / 2 < shortest:
            for p in part:
                del near[p]


def built(free: np.ndarray, resolution: float, safety: float, cfg: Config) -> list[tuple[dict[int, dict[int, str]], dict[int, str | None]]]:
    """(kinds of the edges of each node, kinds of the nodes) of ``kernels.build`` of a stack of maps, none of which is all free."""
    m, h, w = free.shape
    stride = 2 * w
    px = lambda x: max(1, math.ceil(x / resolution))
    dist = np.sqrt(squared_distance(np.pad(free, ((0, 0), (1, 1), (1, 1))))).astype(np.float32)
    blocked = (dist < np.float32(safety / resolution))[:, 1:-1, 1:-1]
    lines = _skeleton_lines(thin(~blocked), px(cfg.skeleton_distance)) if cfg.use_skeleton else np.zeros((0, 5), np.int64)
    at, nxt = _boundary(dist >= np.float32(safety * cfg.boundary_inflation / resolution), h, w, px(cfg.boundary_distance)) if cfg.use_boundary else (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
    lines = lines[_open(blocked, lines)]
    rim = np.column_stack([at, at[nxt, 1:]])
    rim = rim[(rim[:, 1:3] != rim[:, 3:]).any(axis=1)]
    rim = rim[_open(blocked, rim)]
    ends = lambda x: (x[:, 0], x[:, 1] * stride + x[:, 2], x[:, 3] * stride + x[:, 4])
    out = []
    for (p0, q0), (ring,), (p1, q1) in zip(_dealt(m, *ends(lines)), _dealt(m, at[:, 0], at[:, 1] * stride + at[:, 2]), _dealt(m, *ends(rim)), strict=True):
        kinds: dict[int, str | None] = dict.fromkeys(x for pair in zip(p0, q0, strict=True) for x in pair)
        kinds.update(dict.fromkeys(ring, "boundary"))
        near: dict[int, dict[int, str]] = {p: {} for p in kinds}
        for p, q in zip(p0, q0, strict=True):
            near[p][q] = near[q][p] = "skeleton"
        for p, q in zip(p1, q1, strict=True):
            near[p][q] = near[q][p] = "contour"
        out.append((near, kinds))
    if cfg.use_free:
        limit = px(cfg.free_distance)
        # nodes only bring a cell nearer to something
        for k in np.flatnonzero((np.sqrt(squared_distance(free)).astype(np.float32) > np.float32(limit)).any(axis=(1, 2))).tolist():
            near, kinds = out[k]
            graph = Graph()
            graph.nodes = {divmod(p, stride): kind for p, kind in kinds.items()}
            sample_free(graph, free[k], limit)
            for r, c in list(graph.nodes)[len(near) :]:
                near[r * stride + c], kinds[r * stride + c] = {}, None
    if cfg.use_delaunay:
        names = np.sort(np.array([k * h * stride + p for k, (near, _) in enumerate(out) for p in near], np.int64))
        k, p = np.divmod(names, h * stride)
        r, c = np.divmod(p, stride)
        i, j = triangulated(k, r, c)
        free_of = _open(blocked, np.column_stack([k[i], r[i], c[i], r[j], c[j]]))
        i, j = i[free_of], j[free_of]
        for (near, _), (a, b) in zip(out, _dealt(m, k[i], p[i], p[j]), strict=True):
            for x, y in zip(a, b, strict=True):
                if y not in near[x]:
                    near[x][y] = near[y][x] = "delaunay"
    if cfg.prune:
        for (near, kinds), wall in zip(out, blocked, strict=True):
            for again in merge_sweeps(near, crossings(wall), px(cfg.merge_distance), h, w):
                kinds.update(dict.fromkeys(again))
            _pruned(near, stride, px(cfg.min_subgraph_length))
    return out
