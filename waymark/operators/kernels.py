"""Sequential kernels on one map, plain numpy: used inside grouped maps, one task for a map."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from heapq import heappop, heappush

import numpy as np


@dataclass(frozen=True)
class Config:
    """Build parameters in metres (inflation: a factor). Stage flags switch parts off."""

    skeleton_distance: float = 1.5
    boundary_inflation: float = 1.5
    boundary_distance: float = 2.5
    free_distance: float = 1.5
    merge_distance: float = 0.25
    min_subgraph_length: float = 0.25
    use_skeleton: bool = True
    use_boundary: bool = True
    use_free: bool = True
    use_delaunay: bool = True
    prune: bool = True

    def __post_init__(self) -> None:
        for name in ("skeleton_distance", "boundary_distance", "free_distance", "merge_distance", "min_subgraph_length"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.boundary_inflation <= 1.0:
            raise ValueError("boundary_inflation must be over 1")


WAREHOUSE = Config(skeleton_distance=1.0, boundary_distance=2.0, free_distance=1.5)
OFFICE = Config(skeleton_distance=0.5, boundary_distance=1.0, free_distance=0.5, merge_distance=0.15)


def squared_distance(free: np.ndarray) -> np.ndarray:
    """Squared distance to the nearest cell that isn't free; very large where there is none. Axes before the last two are maps."""
    h, w = free.shape[-2:]
    big = 4 * (h + w) ** 2
    gap = np.where(free, big, 0).astype(np.int64)
    for r in range(1, h):
        gap[..., r, :] = np.minimum(gap[..., r, :], gap[..., r - 1, :] + 1)
    for r in range(h - 2, -1, -1):
        gap[..., r, :] = np.minimum(gap[..., r, :], gap[..., r + 1, :] + 1)
    g2 = gap * gap
    out, k = g2.copy(), 1
    while k < w and k * k < out.max():  # columns k apart; no farther than the greatest distance left
        np.minimum(out[..., k:], g2[..., :-k] + k * k, out=out[..., k:])
        np.minimum(out[..., :-k], g2[..., k:] + k * k, out=out[..., :-k])
        k += 1
    return out


@lru_cache(maxsize=50_000)
def _walk(down: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    dr, dc = abs(down), abs(right)
    n, m = max(dr, dc), min(dr, dc)
    i = np.arange(n + 1)
    k = (2 * i * m + n - 1) // (2 * n) if n else i
    a, b = (k, i) if dc >= dr else (i, k)
    return (-a if down < 0 else a), (-b if right < 0 else b)


def line(r0: int, c0: int, r1: int, c1: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the walk between two cells; not symmetric."""
    a, b = _walk(r1 - r0, c1 - c0)
    return r0 + a, c0 + b


@lru_cache(maxsize=50_000)
def _steps(down: int, right: int, width: int) -> tuple[int, ...]:
    """The places of a walk's cells from its first, in a raster of ``width``."""
    a, b = _walk(down, right)
    return tuple((a * width + b).tolist())


class Walls:
    """Blocked cells as bytes, for many short walks."""

    def __init__(self, blocked: np.ndarray) -> None:
        self.h, self.w = blocked.shape
        self.at = np.ascontiguousarray(blocked, bool).tobytes()

    def meets(self, p: tuple[float, float], q: tuple[float, float]) -> bool:
        """``collides`` of these cells."""
        r0, c0, r1, c1 = round(p[0]), round(p[1]), round(q[0]), round(q[1])
        h, w, at = self.h, self.w, self.at
        if not (0 <= r0 < h and 0 <= c0 < w and 0 <= r1 < h and 0 <= c1 < w):
            return True
        first = r0 * w + c0
        for k in _steps(r1 - r0, c1 - c0, w):
            if at[first + k]:
                return True
        return False


def collides(blocked: np.ndarray, p: tuple[float, float], q: tuple[float, float]) -> bool:
    """Whether the walk from p to q leaves the map or meets a blocked cell."""
    (r0, c0), (r1, c1) = (round(p[0]), round(p[1])), (round(q[0]), round(q[1]))
    h, w = blocked.shape
    if not (0 <= r0 < h and 0 <= c0 < w and 0 <= r1 < h and 0 <= c1 < w):
        return True
    return bool(blocked[line(r0, c0, r1, c1)].any())


def around(mask: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours' values, clockwise from above; False outside. Axes before the last two are maps."""
    p = np.pad(mask, [(0, 0)] * (mask.ndim - 2) + [(1, 1)] * 2)
    h, w = mask.shape[-2:]
    return [p[..., 1 + a : 1 + a + h, 1 + b : 1 + b + w] for a, b in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]


def thin(mask: np.ndarray) -> np.ndarray:
    """Skeleton by parallel thinning in two alternating passes, until nothing changes."""
    mask = mask.copy()
    while True:
        before = int(mask.sum())
        for odd in (False, True):
            n = [x.astype(np.int8) for x in around(mask)]
            total = sum(n)
            turns = sum((n[i] == 0) & (n[(i + 1) % 8] == 1) for i in range(8))
            up, right, down, left = n[0], n[2], n[4], n[6]
            side = (up * right * left == 0) & (up * down * left == 0) if odd else (up * right * down == 0) & (right * down * left == 0)
            mask &= ~((total >= 2) & (total <= 6) & (turns == 1) & side)
        if int(mask.sum()) == before:
            return mask


def branches(skeleton: np.ndarray) -> list[list[tuple[int, int]]]:
    """Pixel paths between ends and junctions, and closed loops, in row-major order of their starts."""
    cells = {(int(r), int(c)) for r, c in np.argwhere(skeleton)}
    steps = ((-1, 0), (0, -1), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1))
    near = {p: [q for a, b in steps if (q := (p[0] + a, p[1] + b)) in cells] for p in cells}
    stops = {p for p in cells if len(near[p]) != 2}
    used: set[frozenset] = set()
    out = []
    for start in [*sorted(stops), *sorted(cells - stops)]:
        for nxt in near[start]:
            if frozenset((start, nxt)) in used or (start not in stops and any(frozenset((start, x)) in used for x in near[start])):
                continue
            path, here, prev = [start], nxt, start
            used.add(frozenset((start, nxt)))
            while True:
                path.append(here)
                if here in stops or here == start:
                    break
                ahead = [q for q in near[here] if q != prev and frozenset((here, q)) not in used]
                if not ahead:
                    break
                used.add(frozenset((here, ahead[0])))
                prev, here = here, ahead[0]
            out.append(path)
    return out


def contours(mask: np.ndarray) -> list[np.ndarray]:
    """Closed lines between True and False cells at half height (cell centres as grid points), as (row, col) arrays.

    Each 2x2 square gives up to two segments between the middles of its sides, the True side on the left; segments are
    then joined end to end. The mask is padded by False, so every line closes.
    """
    m = np.pad(mask, 1)
    follow: dict[tuple[float, float], tuple[float, float]] = {}
    a, b, d, c = m[:-1, :-1], m[:-1, 1:], m[1:, :-1], m[1:, 1:]
    case = a * 8 + b * 4 + c * 2 + d * 1
    top, right, bottom, left = (0.0, 0.5), (0.5, 1.0), (1.0, 0.5), (0.5, 0.0)
    # fixed values: for each corner pattern (above left 8, above right 4, below right 2, below left 1) the segments
    table = {1: [(bottom, left)], 2: [(right, bottom)], 3: [(right, left)], 4: [(top, right)], 5: [(top, right), (bottom, left)], 6: [(top, bottom)], 7: [(top, left)], 8: [(left, top)], 9: [(bottom, top)], 10: [(left, top), (right, bottom)], 11: [(right, top)], 12: [(left, right)], 13: [(bottom, right)], 14: [(left, bottom)]}
    for r, col in np.argwhere((case > 0) & (case < 15)).tolist():
        for p, q in table[int(case[r, col])]:
            follow[r - 1 + p[0], col - 1 + p[1]] = (r - 1 + q[0], col - 1 + q[1])
    out = []
    while follow:
        start = min(follow)
        ring, here = [start], follow.pop(start)
        while here != start:
            ring.append(here)
            here = follow.pop(here)
        out.append(np.array([*ring, start]))
    return out


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Fewest points by recursive splitting at the farthest point; a closed ring is split at its farthest point first."""
    keep, todo = {0, len(ring) - 1}, [(0, len(ring) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        p, d = ring[i + 1 : j] - ring[i], ring[j] - ring[i]
        size = math.hypot(*d)
        far = np.abs(p[:, 0] * d[1] - p[:, 1] * d[0]) / size if size else np.hypot(p[:, 0], p[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return ring[sorted(keep)]


def triangles(points: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """The Delaunay triangulation of distinct points, in integers: each directed side with the corner on its left.

    Points are inserted in order, lexicographically; a point on a circle doesn't count as inside, so ties on lattices
    always fall the same way. Corners from len(points) on are three far points around all others, too far to lie in a
    circle through three of them.
    """
    n = len(points)
    r0, c0 = (min(p[k] for p in points) for k in (0, 1))
    pts = [(r - r0, c - c0) for r, c in points]
    span = 64 * (max(map(max, pts)) + 1) ** 3
    pts += [(-3 * span, -3 * span), (3 * span, -3 * span), (0, 3 * span)]

    third: dict[tuple[int, int], int] = {}  # a directed side -> the corner on its left

    def add(a: int, b: int, c: int) -> None:
        third[a, b], third[b, c], third[c, a] = c, a, b

    (ar, ac), (br, bc), (cr, cc) = pts[n:]
    add(*((n, n + 1, n + 2) if (br - ar) * (cc - ac) - (bc - ac) * (cr - ar) > 0 else (n, n + 2, n + 1)))
    side = next(iter(third))
    for p in sorted(range(n), key=lambda i: points[i]):
        # walk to the triangle around the point from the newest one; triangles whose circles hold it are connected
        pr, pc = pts[p]
        while True:
            a, b = side
            c = third[side]
            (ar, ac), (br, bc), (cr, cc) = pts[a], pts[b], pts[c]
            if (br - ar) * (pc - ac) < (bc - ac) * (pr - ar):
                side = (b, a)
            elif (cr - br) * (pc - bc) < (cc - bc) * (pr - br):
                side = (c, b)
            elif (ar - cr) * (pc - cc) < (ac - cc) * (pr - cr):
                side = (a, c)
            else:
                break
        rim, todo = [], [(a, b, c)]
        bad = {(a, b), (b, c), (c, a)}
        while todo:
            a, b, c = todo.pop()
            for x, y in ((a, b), (b, c), (c, a)):
                over = (y, x)
                if over in bad:
                    continue
                z = third.get(over)
                if z is not None:
                    (ar, ac), (br, bc), (cr, cc) = pts[y], pts[x], pts[z]
                    ar, ac, br, bc, cr, cc = ar - pr, ac - pc, br - pr, bc - pc, cr - pr, cc - pc
                    if (ar * ar + ac * ac) * (br * cc - bc * cr) - (br * br + bc * bc) * (ar * cc - ac * cr) + (cr * cr + cc * cc) * (ar * bc - ac * br) > 0:
                        bad.add(over)
                        bad.add((x, z))
                        bad.add((z, y))
                        todo.append((y, x, z))
                        continue
                rim.append((x, y))
        for e in bad:
            del third[e]
        for a, b in rim:
            third[a, b], third[b, p], third[p, a] = p, a, b
        side = rim[0]
    return third


def joined(third: dict[tuple[int, int], int], n: int, a: int, b: int) -> bool:
    """Whether a and b are ends of a side of a triangle of the first ``n`` points."""
    return max(a, b) < n and min(third[a, b], third[b, a]) < n


def triangulate(points: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Edges (i < j) of the Delaunay triangulation of distinct points; none where all lie on one line."""
    if len(points) < 3:
        return set()
    third = triangles(points)
    return {(a, b) for a, b in third if a < b and joined(third, len(points), a, b)}


class Graph:
    """An undirected simple graph on pixels; nodes keep their order of arrival."""

    def __init__(self) -> None:
        self.nodes: dict[tuple[int, int], str | None] = {}
        self.near: dict[tuple[int, int], dict[tuple[int, int], tuple[float, str]]] = {}

    def node(self, p: tuple[int, int], kind: str | None = None) -> None:
        if p not in self.nodes or kind:
            self.nodes[p] = kind
        self.near.setdefault(p, {})

    def edge(self, p: tuple[int, int], q: tuple[int, int], kind: str) -> None:
        for x in (p, q):
            if x not in self.nodes:
                self.node(x)
        w = math.hypot(p[0] - q[0], p[1] - q[1])
        self.near[p][q] = self.near[q][p] = (w, kind)

    def drop(self, p: tuple[int, int]) -> None:
        for q in self.near.pop(p):
            self.near.get(q, {}).pop(p, None)
        del self.nodes[p]


def sample_free(graph: Graph, free: np.ndarray, limit: int) -> None:
    """Add nodes at distance maxima over ``limit`` from obstacles and nodes, until none is left."""
    placed: dict[tuple[int, int], list[tuple[int, int]]] = {}
    half, size = limit / 2, max(1, limit)
    while True:
        open_ = free.copy()
        for r, c in graph.nodes:
            if 0 <= r < open_.shape[0] and 0 <= c < open_.shape[1]:
                open_[r, c] = False
        d2 = squared_distance(open_)
        p = np.pad(d2, 1, mode="edge")
        h, w = d2.shape
        top = np.max([p[a : a + h, b : b + w] for a in range(3) for b in range(3)], axis=0)
        peaks = np.argwhere((d2 == top) & (np.sqrt(d2).astype(np.float32) > np.float32(limit)) & open_)
        added = False
        for r, c in peaks.tolist():
            k = (r // size, c // size)
            close = any(abs(r - a) <= half and abs(c - b) <= half for i in (-1, 0, 1) for j in (-1, 0, 1) for a, b in placed.get((k[0] + i, k[1] + j), ()))
            if not close:
                graph.node((r, c))
                placed.setdefault(k, []).append((r, c))
                added = True
        if not added:
            return


def merge_close(graph: Graph, blocked: np.ndarray, radius: float) -> None:
    """Merge pairs within ``radius``, in node order, as long as the moved lines stay free."""
    crosses = cache(Walls(blocked).meets)  # pairs that can't merge come again each round
    barred: dict[tuple, tuple] = {}  # of a pair that couldn't, the neighbour whose line was blocked
    while True:
        names = list(graph.nodes)
        pts = np.array(names)
        if len(pts) < 2:
            return
        merged, step = False, max(1, (1 << 20) // len(pts))
        pairs = []
        for a in range(0, len(pts), step):
            d2 = ((pts[a : a + step, None] - pts[None, a:]) ** 2).sum(axis=2)
            i, j = np.nonzero(d2 <= radius * radius)
            later = j > i
            pairs += zip((i[later] + a).tolist(), (j[later] + a).tolist(), strict=True)
        for i, j in pairs:
            a, b = names[i], names[j]
            if b not in graph.nodes:
                continue
            near = graph.near[b]
            if (x := barred.get((a, b))) is not None and x in near:
                continue
            others = [q for q in near if q != a]
            hit = next((q for q in others if crosses(a, q)), None)
            if hit is not None:
                barred[a, b] = hit
                continue
            for q in others:
                graph.edge(a, q, "merge")
            graph.drop(b)
            merged = True
        if not merged:
            return


BITS = 8192  # of a map, the width doubled, whose walks are tested as one number


def _trace(down: int, right: int, stride: int) -> tuple[int, int]:
    """(place of the walk's lowest cell from its first, the walk's cells as bits from there)."""
    a, b = _walk(down, right)
    at = (a * stride + b).tolist()
    low = min(at)
    return low, sum(1 << (k - low) for k in at)


@lru_cache(maxsize=4)
def _traces(stride: int) -> dict[int, tuple[int, int]]:
    """``_trace`` of the differences met on maps of this width: fewer than 4 * ``BITS``, of at most a kilobyte."""
    return {}


def crossings(blocked: np.ndarray) -> Callable[[int, int], bool]:
    """``collides`` for cells of the map as numbers, row * (2 * width) + column: their difference says the walk."""
    h, w = blocked.shape
    stride = 2 * w
    if h * stride > BITS:
        meets = Walls(blocked).meets
        return cache(lambda p, q: meets(divmod(p, stride), divmod(q, stride)))
    wall = int.from_bytes(np.packbits(np.pad(blocked, ((0, 0), (0, w))), bitorder="little").tobytes(), "little")

    traces = _traces(stride)

    def crosses(p: int, q: int) -> bool:
        t = traces.get(q - p)
        if t is None:
            t = traces[q - p] = _trace(q // stride - p // stride, q % stride - p % stride, stride)
        return wall >> (p + t[0]) & t[1] > 0

    return crosses


@cache
def _half_disk(radius: float, stride: int) -> np.ndarray:
    """Places, from a cell, of the later cells in row-major order that lie within ``radius``."""
    k = int(radius)
    r, c = np.indices((k + 1, 2 * k + 1))
    c -= k
    near = (r * r + c * c <= radius * radius) & ((r > 0) | (c > 0))
    return (r * stride + c)[near]


def close_pairs(names: list[int], radius: float, height: int, width: int) -> Iterator[tuple[int, int]]:
    """Pairs (i < j) of the cells ``names``, numbered as by ``crossings``, that lie within ``radius``; by i, then j."""
    k, n, stride = int(radius), len(names), width + 2 * int(radius)
    at = np.array(names, np.int64)
    at = at // (2 * width) * stride + at % (2 * width) + k
    place = np.full((height + k + 1) * stride, -1, np.int32)
    place[at] = np.arange(n)
    disk = _half_disk(radius, stride)
    pairs, step = [np.zeros(0, np.int64)], max(1, (1 << 20) // max(1, len(disk)))
    for a in range(0, n, step):
        other = place[at[a : a + step, None] + disk].ravel()
        k = np.flatnonzero(other >= 0)
        i, j = k // len(disk) + a, other[k].astype(np.int64)
        pairs.append(np.minimum(i, j) * n + np.maximum(i, j))
    i, j = np.divmod(np.sort(np.concatenate(pairs)), max(1, n))
    return zip(i.tolist(), j.tolist(), strict=True)


def merge_sweeps(near: dict[int, dict[int, str]], crosses: Callable[[int, int], bool], radius: float, height: int, width: int) -> Iterator[list[int]]:
    """``merge_close`` of nodes numbered as by ``crossings``, in the order of ``near``, which says the kinds of a node's edges.

    Gives, after each sweep that merged something, the nodes that went in it and got edges again, in order.
    """
    barred: dict[tuple[int, int], int] = {}  # of a pair that couldn't, the neighbour whose line was blocked
    while True:
        names, merged, again = list(near), False, []
        for i, j in close_pairs(names, radius, height, width):
            a, b = names[i], names[j]
            if b not in near:
                continue
            own = near[b]
            if barred and (x := barred.get((a, b))) is not None and x in own:
                continue
            for q in own:
                if q != a and crosses(a, q):
                    barred[a, b] = q
                    break
            else:
                del near[b]
                own.pop(a, None)
                mine = near.get(a)
                if mine is None:
                    if own:
                        mine = near[a] = {}
                        again.append(a)
                else:
                    mine.pop(b, None)
                for q in own:
                    theirs = near[q]
                    del theirs[b]
                    mine[q] = theirs[a] = "merge"
                merged = True
        if not merged:
            return
        yield again


def prune(graph: Graph, blocked: np.ndarray, radius: float, shortest: float) -> None:
    """Merge close nodes, then drop nodes without edges and components of less total length."""
    merge_close(graph, blocked, radius)
    for p in [p for p in graph.nodes if not graph.near[p]]:
        graph.drop(p)
    left = set(graph.nodes)
    while left:
        part, todo = set(), [next(iter(left))]
        while todo:
            p = todo.pop()
            if p not in part:
                part.add(p)
                todo += graph.near[p]
        left -= part
        if sum(w for p in part for w, _ in graph.near[p].values()) / 2 < shortest:
            for p in part:
                graph.drop(p)


def build(image: np.ndarray, resolution: float, safety: float, threshold: int = 127, config: Config = Config()) -> tuple[Graph, np.ndarray]:  # noqa: B008
    """(graph in pixels, blocked cells) of one map."""
    free, graph = image > threshold, Graph()
    h, w = free.shape
    px = lambda m: max(1, math.ceil(m / resolution))
    if free.all():
        m = math.ceil(safety / resolution)
        if h <= 2 * m or w <= 2 * m:
            raise ValueError("the map is too small for the safety distance")
        blocked = np.ones((h, w), bool)
        blocked[m : h - m, m : w - m] = False
        step = max(1, min(px(config.free_distance), min(h - 2 * m, w - 2 * m) // 2))
        for r in range(m, h - m, step):
            for c in range(m, w - m, step):
                graph.node((r, c))
                for a, b in ((0, step), (step, 0), (step, step)):
                    if r + a < h - m and c + b < w - m:
                        graph.edge((r, c), (r + a, c + b), "grid")
        return graph, blocked
    padded = squared_distance(np.pad(free, 1))
    dist = np.sqrt(padded).astype(np.float32)
    blocked = (dist < np.float32(safety / resolution))[1:-1, 1:-1]
    meets = Walls(blocked).meets
    if config.use_skeleton:
        d = px(config.skeleton_distance)
        for path in branches(thin(~blocked)):
            n = len(path)
            k = max(1, n // d)
            seg = n // k
            for j in range(k):
                p, q = path[j * seg], path[min((j + 1) * seg, n - 1)]
                if not meets(p, q):
                    graph.edge(p, q, "skeleton")
    if config.use_boundary:
        wide = dist >= np.float32(safety * config.boundary_inflation / resolution)
        gap = px(config.boundary_distance)
        for ring in contours(wide):
            ring = simplify(ring - 1, 0.6)  # back from the padded distance raster
            ring = np.clip(ring[:-1] if (ring[0] == ring[-1]).all() else ring, 0, (h - 1, w - 1))
            if len(ring) < 2:
                continue
            names: list[tuple[int, int]] = []
            for p, q in zip(ring, np.roll(ring, -1, axis=0), strict=True):
                n = int(math.hypot(*(q - p)) / gap)
                for i in range(max(1, n)):
                    r, c = (p + (q - p) * i / max(1, n)).astype(int).tolist()
                    graph.node((r, c), "boundary")  # on a blocked cell too: only its lines are ruled out
                    names.append((r, c))
            for p, q in zip(names, names[1:] + names[:1], strict=True):
                if p != q and not meets(p, q):
                    graph.edge(p, q, "contour")
    if config.use_free:
        sample_free(graph, free, px(config.free_distance))
    if config.use_delaunay:
        names = list(graph.nodes)
        pairs = sorted(tuple(sorted((names[i], names[j]))) for i, j in triangulate(names))
        for p, q in pairs:
            if q not in graph.near[p] and not meets(p, q):
                graph.edge(p, q, "delaunay")
    if config.prune:
        prune(graph, blocked, px(config.merge_distance), px(config.min_subgraph_length))
    return graph, blocked


def node_map(blocked: np.ndarray, nodes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(label, hops): each cell's nearest node by 4-connected steps, -1 unreached, -2 blocked; first come, first served."""
    h, w = blocked.shape
    label, hops = np.where(blocked, -2, -1).astype(np.int32), np.full((h, w), -1, np.int32)
    queue: deque[tuple[int, int]] = deque()
    for i, (r, c) in enumerate(nodes):
        if 0 <= r < h and 0 <= c < w and label[r, c] == -1:
            label[r, c], hops[r, c] = i, 0
            queue.append((r, c))
    while queue:
        r, c = queue.popleft()
        for a, b in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if 0 <= a < h and 0 <= b < w and label[a, b] == -1:
                label[a, b], hops[a, b] = label[r, c], hops[r, c] + 1
                queue.append((a, b))
    return label, hops


def shortest_path(near: dict[int, dict[int, float]], at: dict[int, tuple[float, float]], start: int, goal: int) -> list[int] | None:
    """Nodes of a shortest path, by A* with the straight distance; None if there is none."""
    far = lambda x: math.hypot(at[x][0] - at[goal][0], at[x][1] - at[goal][1])
    best, back, done, heap = {start: 0.0}, {}, set(), [(far(start), start)]
    while heap:
        _, x = heappop(heap)
        if x == goal:
            path = [x]
            while path[-1] in back:
                path.append(back[path[-1]])
            return path[::-1]
        if x in done:
            continue
        done.add(x)
        for y, w in near.get(x, {}).items():
            d = best[x] + w
            if d < best.get(y, math.inf):
                best[y], back[y] = d, x
                heappush(heap, (d + far(y), y))
    return None


def label_regions(free: np.ndarray) -> np.ndarray:
    """8-connected regions of free cells, numbered from 1 in row-major order; 0 elsewhere."""
    out, n = np.zeros(free.shape, np.int32), 0
    h, w = free.shape
    for r, c in np.argwhere(free).tolist():
        if not out[r, c]:
            n += 1
            out[r, c], todo = n, [(r, c)]
            while todo:
                a, b = todo.pop()
                for i in range(max(0, a - 1), min(h, a + 2)):
                    for j in range(max(0, b - 1), min(w, b + 2)):
                        if free[i, j] and not out[i, j]:
                            out[i, j] = n
                            todo.append((i, j))
    return out
