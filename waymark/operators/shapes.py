"""Skeletons, their branches, contour rings and simplified rings over tiles: no task walks or holds a whole map.

* thinning: every tile gets a rim of its neighbours as wide as the sub-passes of a round, does them on its own, and only tiles
  near a change go on;
* branches and rings: steps are followed inside tiles to fragments, and fragments are ranked by pointer doubling, so a chain
  of n fragments takes log n rounds;
* simplification: all open spans of all rings split at their farthest point at once, a round for a level of splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut
from .kernels import around
from .tiles import SIZE, TILE, each, mask, tiles

STATE = "map_id long, tr int, tc int, h int, w int, bits binary"
SHIFT = 1 << 32


def packed(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """STATE rows of cells(map_id, row, col, free): the free cells of each tile, a bit a cell."""

    def make(t) -> pd.DataFrame:
        return pd.DataFrame({"map_id": [t.map_id], "tr": [t.tr], "tc": [t.tc], "h": [t.h], "w": [t.w], "bits": [np.packbits(mask(t.free, t.h, t.w, size)).tobytes()]})

    return each(tiles(cells, size), make, STATE)


def _bits(raw: bytes, h: int, w: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=h * w).astype(bool).reshape(h, w)


def windows(state: DataFrame, halo: int, size: int, only: DataFrame | None = None) -> DataFrame:
    """STATE's keys and sizes of each tile (of ``only``), and parts(dr, dc, h, w, bits): its own and its neighbours' rims.

    ``halo`` is at most ``size``. A neighbour sends what lies within ``halo`` cells of the tile.
    """

    def send(t) -> pd.DataFrame:
        own, out = _bits(t.bits, t.h, t.w), []
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):  # to the tile at (tr - dr, tc - dc), for which this one lies at (dr, dc)
                part = own[slice(max(0, t.h - halo), None) if dr < 0 else slice(0, halo) if dr > 0 else slice(None)]
                # an upper neighbour is a whole tile, so its last rows are next to this tile's first
                part = part[:, slice(max(0, t.w - halo), None) if dc < 0 else slice(0, halo) if dc > 0 else slice(None)]
                out.append((t.map_id, t.tr - dr, t.tc - dc, dr, dc, *part.shape, np.packbits(part).tobytes()))
        return pd.DataFrame(out, columns=["map_id", "tr", "tc", "dr", "dc", "ph", "pw", "part"])

    sent = each(state, send, "map_id long, tr int, tc int, dr int, dc int, ph int, pw int, part binary")
    if only is not None:
        sent = sent.join(only, TILE, "left_semi")
    rims = sent.groupBy(*TILE).agg(F.collect_list(F.struct("dr", "dc", "ph", "pw", "part")).alias("parts"))
    return rims.join(state.select(*TILE, "h", "w"), TILE)


def window(t, halo: int) -> np.ndarray:
    """The cells of a row of ``windows``, (h + 2 halo) x (w + 2 halo), False outside the map."""
    out = np.zeros((t.h + 2 * halo, t.w + 2 * halo), bool)
    for p in t.parts:
        part = _bits(p["part"], p["ph"], p["pw"])
        r = halo - p["ph"] if p["dr"] < 0 else halo + t.h if p["dr"] > 0 else halo
        c = halo - p["pw"] if p["dc"] < 0 else halo + t.w if p["dc"] > 0 else halo
        out[r : r + p["ph"], c : c + p["pw"]] = part
    return out


def clear(dist: DataFrame, least: float) -> DataFrame:
    """STATE of the cells of ``tiles.distances`` that lie ``least`` or more from an obstacle, compared in 32-bit floats."""

    def make(t) -> pd.DataFrame:
        far = np.sqrt(np.frombuffer(t.d2, np.int64)).astype(np.float32) >= np.float32(least)
        return pd.DataFrame({"map_id": [t.map_id], "tr": [t.tr], "tc": [t.tc], "h": [t.h], "w": [t.w], "bits": [np.packbits(far).tobytes()]})

    return each(dist, make, STATE)


# --- thinning -----------------------------------------------------------------------------------------------------


def sub_pass(cells: np.ndarray, odd: bool) -> np.ndarray:
    """The cells that one sub-pass of parallel thinning takes away."""
    n = [x.astype(np.int8) for x in around(cells)]
    total = sum(n)
    turns = sum((n[i] == 0) & (n[(i + 1) % 8] == 1) for i in range(8))
    up, right, down, left = n[0], n[2], n[4], n[6]
    side = (up * right * left == 0) & (up * down * left == 0) if odd else (up * right * down == 0) & (right * down * left == 0)
    return cells & (total >= 2) & (total <= 6) & (turns == 1) & side


def thinned(state: DataFrame, size: int = SIZE) -> DataFrame:
    """STATE of the skeleton: two alternating sub-passes until nothing changes anywhere."""
    halo = max(2, min(size, 16) // 2 * 2)  # so many sub-passes a round, an even number

    def make(t) -> pd.DataFrame:
        cells = window(t, halo)
        inner = (slice(halo, halo + t.h), slice(halo, halo + t.w))
        before = cells[inner].copy()
        for k in range(halo):  # what is wrong at the window's edge moves in by a cell a pass, never to the tile
            cells &= ~sub_pass(cells, k % 2 == 1)
        after = cells[inner]
        return pd.DataFrame({"map_id": [t.map_id], "tr": [t.tr], "tc": [t.tc], "h": [t.h], "w": [t.w], "bits": [np.packbits(after).tobytes()], "changed": [bool((before != after).any())]})

    now = cut(state.withColumn("changed", F.lit(True)))
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    while not (moved := now.filter("changed").select(*TILE)).isEmpty():
        awake = moved.withColumn("n", F.explode(near)).select("map_id", (F.col("tr") + F.col("n.a")).alias("tr"), (F.col("tc") + F.col("n.b")).alias("tc")).distinct()
        done = each(windows(now.drop("changed"), halo, size, awake), make, STATE + ", changed boolean")
        now = cut(done.unionByName(now.join(awake, TILE, "left_anti").withColumn("changed", F.lit(False))))
    return now.drop("changed")


def state_cells(state: DataFrame, size: int = SIZE) -> DataFrame:
    """map_id, row, col of the cells that are set."""

    def make(t) -> pd.DataFrame:
        r, c = np.nonzero(_bits(t.bits, t.h, t.w))
        return pd.DataFrame({"map_id": t.map_id, "row": (r + t.tr * size).astype(np.int32), "col": (c + t.tc * size).astype(np.int32)})

    return each(state, make, "map_id long, row int, col int")


# --- chains -------------------------------------------------------------------------------------------------------


def rank_chains(pieces: DataFrame) -> DataFrame:
    """Adds name, start, total and ring to pieces(map_id, entry, exit, length, low, low_at) of chains.

    ``exit`` is the next piece's entry, null at an end; ``low`` is the least step of the piece, ``low_at`` its place. name: the
    last piece's entry, or a ring's least step. start: the place of the piece's first step in the chain, a ring counted from
    its least step. total: the chain's steps. Pointers double: each piece learns of twice as many pieces a round.
    """
    p = cut(pieces)

    def doubled(state: DataFrame) -> DataFrame:
        ahead = state.select("map_id", F.col("entry").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("d").alias("d2"), F.col("m").alias("m2"), F.col("last").alias("last2"))
        got = state.join(ahead, ["map_id", "nxt"], "left")
        moves = F.col("last2").isNotNull()
        return got.select("map_id", "entry", F.when(moves, F.col("nxt2")).alias("nxt"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), F.least("m", "m2").alias("m"), F.coalesce("last2", "last").alias("last"), (moves & (F.col("nxt2").isNull() | (F.col("m2") < F.col("m")))).alias("moved"))

    def ranked(state: DataFrame) -> DataFrame:
        """Doubled until every piece sees its end, or its whole ring."""
        state = cut(state)
        while True:
            after = cut(doubled(state))
            # while any piece of a line is open, one next to an ended one ends; a ring's least step stands once no piece learns of a lesser
            if after.filter("moved").isEmpty():
                return after
            state = after.drop("moved")

    first = ranked(p.select("map_id", "entry", F.col("exit").alias("nxt"), F.col("length").alias("d"), F.col("low").alias("m"), F.col("entry").alias("last")))
    lines = first.filter("nxt IS NULL").select("map_id", "entry", F.col("last").alias("name"), "d", F.lit(0).cast("long").alias("at"), F.lit(False).alias("ring"))
    rings = cut(p.join(first.filter("nxt IS NOT NULL").select("map_id", "entry", "m"), ["map_id", "entry"]))
    lead = F.col("low") == F.col("m")
    again = ranked(rings.select("map_id", "entry", F.when(~lead, F.col("exit")).alias("nxt"), F.when(lead, F.lit(0)).otherwise(F.col("length")).cast("long").alias("d"), "m", F.col("entry").alias("last")))
    at = rings.filter(lead).select("map_id", "m", F.col("low_at").alias("at"))
    turns = again.select("map_id", "entry", "d", "m").join(at, ["map_id", "m"]).select("map_id", "entry", F.col("m").alias("name"), "d", "at", F.lit(True).alias("ring"))
    named = p.join(cut(lines.union(turns)), ["map_id", "entry"])
    total = named.groupBy("map_id", "name", "ring").agg(F.sum("length").alias("total"))
    out = named.join(total, ["map_id", "name", "ring"])
    return out.withColumn("start", F.when(F.col("ring"), F.pmod(F.col("total") - F.col("d") - F.col("at"), F.col("total"))).otherwise(F.col("total") - F.col("d"))).drop("d", "at")


def fragments(keys: np.ndarray, follow: np.ndarray) -> list[np.ndarray]:
    """Runs of steps inside a tile, as indices: ``follow`` is each step's next in the tile, -1 if none."""
    n = len(keys)
    headless = np.ones(n, bool)
    headless[follow[follow >= 0]] = False
    nxt, out, seen = follow.tolist(), [], np.zeros(n, bool)
    for start in [*np.flatnonzero(headless).tolist(), *np.argsort(keys, kind="stable").tolist()]:
        if not seen[start]:
            run = []
            while start >= 0 and not seen[start]:
                seen[start] = True
                run.append(start)
                start = nxt[start]
            out.append(np.array(run))
    return out


PIECE = "map_id long, entry long, exit long, length long, low long, low_at long, steps binary"


def _pieces(map_id: int, key: np.ndarray, after: np.ndarray) -> pd.DataFrame:
    """PIECE rows of steps ``key`` and the steps ``after`` them (-1: an end), of which some lie in other tiles."""
    order = np.argsort(key)
    at = np.minimum(np.searchsorted(key[order], after), len(key) - 1)
    follow = np.where((after >= 0) & (key[order][at] == after), order[at], -1)
    rows = []
    for run in fragments(key, follow):
        k = key[run]
        exit_ = int(after[run[-1]])
        rows.append((map_id, int(k[0]), exit_, len(k), int(k.min()), int(k.argmin()), k.astype(np.int64).tobytes()))
    out = pd.DataFrame(rows, columns=["map_id", "entry", "exit", "length", "low", "low_at", "steps"])
    out["exit"] = out["exit"].astype("Int64")
    out.loc[out["exit"] < 0, "exit"] = pd.NA
    return out


def numbered(names: DataFrame, *order: str, shift: int = 38) -> DataFrame:
    """Adds number, from 0, by map; counts of blocks of the first order column (2^shift, 64 rows of cells) are summed first."""
    block = F.shiftright(order[0], shift)
    n = names.withColumn("block", block)
    before = n.groupBy("map_id", "block").agg(F.count("*").alias("n"))
    before = before.select("map_id", "block", F.coalesce(F.sum("n").over(Window.partitionBy("map_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("map_id", "block").orderBy(*order)) - 1
    return n.withColumn("place", place).join(before, ["map_id", "block"]).withColumn("number", (F.col("place") + F.col("before")).cast("int")).drop("block", "place", "before")


def stepped(pieces: DataFrame, make: Callable[..., dict], schema: str) -> DataFrame:
    """The columns that ``make`` gives for (batch, row of each step, step, place in its chain) of ranked pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                n = b["length"].to_numpy()
                at = np.repeat(np.arange(len(b)), n)
                place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                i = (b["start"].to_numpy()[at] + place) % b["total"].to_numpy()[at]
                yield pd.DataFrame(make(b, at, np.frombuffer(b"".join(b["steps"]), np.int64), i))

    return pieces.mapInPandas(run, schema)


# --- rings --------------------------------------------------------------------------------------------------------

#: For each corner pattern (above left 8, above right 4, below right 2, below left 1), segments between sides (top 0, right 1,
#: bottom 2, left 3), the set side on the left.
SEGMENTS = {1: [(2, 3)], 2: [(1, 2)], 3: [(1, 3)], 4: [(0, 1)], 5: [(0, 1), (2, 3)], 6: [(0, 2)], 7: [(0, 3)], 8: [(3, 0)], 9: [(2, 0)], 10: [(3, 0), (1, 2)], 11: [(1, 0)], 12: [(3, 1)], 13: [(2, 1)], 14: [(3, 2)]}
SIDES = np.array([(0, 1), (1, 2), (2, 1), (1, 0)])  # twice the place within a square


def ring_points(state: DataFrame, size: int = SIZE) -> DataFrame:
    """map_id, ring, i, row, col: the closed lines around the set cells at half height, a point a step, the first repeated last.

    Rings are numbered in the order of their first points, the least of each; the set side lies on the left.
    """

    def make(t) -> pd.DataFrame | None:
        a = window(t, 1)
        case = a[:-1, :-1] * 8 + a[:-1, 1:] * 4 + a[1:, 1:] * 2 + a[1:, :-1]
        case[: t.tr > 0] = 0  # squares of the tile above, and to the left
        case[:, : t.tc > 0] = 0
        head, tail = [], []
        for kind, segments in SEGMENTS.items():
            r, c = np.nonzero(case == kind)
            base = np.stack([2 * (r + t.tr * size), 2 * (c + t.tc * size)], axis=1)  # twice the square's first cell, from -1 on: +2
            for p, q in segments:
                head.append(base + SIDES[p])
                tail.append(base + SIDES[q])
        key, after = (np.concatenate(x) for x in (head, tail))
        return _pieces(t.map_id, key[:, 0] * SHIFT + key[:, 1], after[:, 0] * SHIFT + after[:, 1]) if len(key) else None

    ranked = cut(rank_chains(each(windows(state, 1, size), make, PIECE)))
    numbers = numbered(ranked.select("map_id", "name").distinct(), "name").select("map_id", "name", F.col("number").alias("ring"))

    def show(b: pd.DataFrame, at: np.ndarray, steps: np.ndarray, i: np.ndarray) -> dict:
        first = np.flatnonzero(i == 0)
        steps, i, at = np.r_[steps, steps[first]], np.r_[i, b["total"].to_numpy()[at[first]]], np.r_[at, at[first]]
        return {"map_id": b["map_id"].to_numpy()[at], "ring": b["number"].to_numpy()[at], "i": i.astype(np.int32), "row": (steps // SHIFT - 2) / 2, "col": (steps % SHIFT - 2) / 2}

    return stepped(ranked.drop("ring").join(numbers.withColumnRenamed("ring", "number"), ["map_id", "name"]), show, "map_id long, ring int, i int, row double, col double")


def simplified(points: DataFrame, tolerance: float, key: tuple[str, ...] = ("map_id", "ring")) -> DataFrame:
    """The points (..., i, row, col) of lines that remain when each span is split at its farthest point while that lies over
    ``tolerance`` away; the first of equally far ones counts. i are the places in the whole line, from 0 without gaps.
    """
    ends = points.groupBy(*key).agg(F.min(F.struct("i", "row", "col")).alias("a"), F.max(F.struct("i", "row", "col")).alias("b"))
    kept = ends.select(*key, F.explode(F.array("a", "b")).alias("p")).select(*key, "p.i", "p.row", "p.col").distinct()
    open_ = points.join(ends, list(key)).filter((F.col("i") > F.col("a.i")) & (F.col("i") < F.col("b.i")))
    open_ = cut(open_.select(*key, "i", "row", "col", "a", "b"))
    found = [cut(kept)]
    pr, pc = F.col("row") - F.col("a.row"), F.col("col") - F.col("a.col")
    dr, dc = F.col("b.row") - F.col("a.row"), F.col("b.col") - F.col("a.col")
    size = F.sqrt(dr * dr + dc * dc)
    far = F.when(size > 0, F.abs(pr * dc - pc * dr) / size).otherwise(F.sqrt(pr * pr + pc * pc))
    while not open_.isEmpty():
        top = open_.groupBy(*key, F.col("a.i").alias("ai")).agg(F.max(F.struct(far.alias("far"), (-F.col("i")).alias("minus"), F.struct("i", "row", "col").alias("p"))).alias("top"))
        split = cut(top.filter(F.col("top.far") > tolerance).select(*key, "ai", F.col("top.p").alias("p")))
        found.append(split.select(*key, "p.i", "p.row", "p.col"))
        both = open_.withColumn("ai", F.col("a.i")).join(split, [*key, "ai"]).filter(F.col("i") != F.col("p.i"))
        left = F.col("i") < F.col("p.i")
        open_ = cut(both.select(*key, "i", "row", "col", F.when(left, F.col("a")).otherwise(F.col("p")).alias("a"), F.when(left, F.col("p")).otherwise(F.col("b")).alias("b")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def rings(state: DataFrame, shape: DataFrame, tolerance: float = 0.6, size: int = SIZE) -> DataFrame:
    """map_id, ring, i, row, col: vertices of the simplified rings, numbered along the ring, clipped to the map.

    ``shape(map_id, height, width)``.
    """
    v = simplified(ring_points(state, size), tolerance)
    i = (F.row_number().over(Window.partitionBy("map_id", "ring").orderBy("i")) - 1).cast("int")
    clip = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0.0)), (F.col(n) - 1).cast("double"))
    return v.withColumn("i", i).join(shape, "map_id").select("map_id", "ring", "i", clip("row", "height").alias("row"), clip("col", "width").alias("col"))


# --- branches -----------------------------------------------------------------------------------------------------

STEPS = ((-1, 0), (0, -1), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1))  # the order in which a cell's ways are taken
BACK = [STEPS.index((-a, -b)) for a, b in STEPS]


def branches(skeleton: DataFrame, size: int = SIZE) -> DataFrame:
    """map_id, branch, i, row, col: pixel paths between cells that have not two neighbours, then closed loops.

    A step is a cell and one of its eight ways; a branch is walked from the end whose first step comes first. Branches
    are numbered in the order of their first steps, loops (from their least cell) after all others.
    """

    def make(t) -> pd.DataFrame | None:
        a = window(t, 2)
        near = np.stack([np.pad(a, 1)[1 + dr : 1 + dr + a.shape[0], 1 + dc : 1 + dc + a.shape[1]] for dr, dc in STEPS])
        near &= a
        degree = near.sum(axis=0)
        own = np.zeros(a.shape, bool)
        own[2:-2, 2:-2] = a[2:-2, 2:-2]
        key, after = [], []
        for d, (dr, dc) in enumerate(STEPS):
            r, c = np.nonzero(own & near[d])
            q = (r + dr, c + dc)
            ways = near[:, q[0], q[1]].copy()
            ways[BACK[d]] = False
            onward = ways.argmax(axis=0)
            place = lambda y, x, way: ((y - 2 + t.tr * size) * SHIFT + (x - 2 + t.tc * size)) * 8 + way
            key.append(place(r, c, d))
            after.append(np.where(degree[q] == 2, place(*q, onward), -1))
        key, after = np.concatenate(key), np.concatenate(after)
        if not len(key):
            return None
        return _pieces(t.map_id, key, after)

    ranked = cut(rank_chains(each(windows(skeleton, 2, size), make, PIECE)))

    def head(b: pd.DataFrame, at: np.ndarray, steps: np.ndarray, i: np.ndarray) -> dict:
        """The first step of each chain, and the first step of the way back."""
        last = i == b["total"].to_numpy()[at] - 1
        way, cell = steps % 8, steps // 8
        turn = np.array(STEPS)[way]
        back = ((cell // SHIFT + turn[:, 0]) * SHIFT + cell % SHIFT + turn[:, 1]) * 8 + np.array(BACK)[way]
        ends = np.flatnonzero((i == 0) | last)
        own = {c: b[c].to_numpy()[at[ends]] for c in ("map_id", "name", "ring")}
        return own | {"first": pd.Series(steps[ends], dtype="Int64").where(i[ends] == 0), "back": pd.Series(back[ends], dtype="Int64").where(last[ends])}

    ends = stepped(ranked, head, "map_id long, name long, ring boolean, first long, back long").groupBy("map_id", "name", "ring").agg(F.max("first").alias("first"), F.max("back").alias("back"))
    # both directions are chains of their own: the one that starts with the lesser step stays
    chosen = ends.filter("first <= back").withColumn("order", F.shiftright("first", 3))
    lines, loops = chosen.filter("NOT ring"), chosen.filter("ring")
    count = lines.groupBy("map_id").agg(F.count("*").cast("int").alias("more"))
    numbers = numbered(lines, "order", "first").select("map_id", "name", "ring", "number")
    numbers = numbers.union(numbered(loops, "order", "first").join(count, "map_id", "left").select("map_id", "name", "ring", (F.col("number") + F.coalesce("more", F.lit(0))).alias("number")))

    def show(b: pd.DataFrame, at: np.ndarray, steps: np.ndarray, i: np.ndarray) -> dict:
        r, c, total = steps // 8 // SHIFT, steps // 8 % SHIFT, b["total"].to_numpy()
        last = np.flatnonzero(i == total[at] - 1)
        turn = np.array(STEPS)[steps[last] % 8]
        r, c, i, at = np.r_[r, r[last] + turn[:, 0]], np.r_[c, c[last] + turn[:, 1]], np.r_[i, total[at[last]]], np.r_[at, at[last]]
        return {"map_id": b["map_id"].to_numpy()[at], "branch": b["number"].to_numpy()[at], "i": i.astype(np.int32), "row": r.astype(np.int32), "col": c.astype(np.int32)}

    return stepped(ranked.join(numbers, ["map_id", "name", "ring"]), show, "map_id long, branch int, i int, row int, col int")
