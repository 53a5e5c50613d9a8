"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits; a bit is one if set in over half of the XXH64 (seed 42) of the text's three-word shingles.
Fingerprints that differ in at most ``TAU`` bits are linked, and links are closed to components.

Search: correlated bits are grouped into partitions. A partition gets a threshold t (-1: not probed) and the thresholds
of all partitions sum to TAU - partitions + 1; then of any linked pair one partition at least differs in no more than
its own threshold. The thresholds come from dynamic programming over candidate counts, estimated on at most
``SAMPLE`` distinct fingerprints (this bound changes the speed alone, never the result). Each distinct fingerprint
goes under the value of each probed partition, and under each value one bit off where the threshold is one, and so on.
Within a bucket the rest of the bits is split again by the plain pigeonhole, and candidates are verified on all bits.
A bucket returns a spanning forest of its links, never all pairs.

Equal fingerprints are one row from the start, so a bucket holds distinct fingerprints alone, whatever the copies. A
bucket over ``HOT_ROWS`` is dealt to tasks by slices of its other bits.

Defined results: null and wordless texts have fingerprint zero and are linked like any other; rows with a null
``doc_id`` are linked too, and name a component only by others' ids (null where there are none); repeated rows and ids
give a row each; very long texts are taken whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hashed_part

TAU = 2
PARTITIONS = 4
SAMPLE = 20_000
MOST_CHANGED = 2  # bits in which a probe differs, at most
HOT_ROWS = 20_000  # fingerprints of a bucket, from which on it is dealt by further bits
MOST_HOT = 100_000
SMALL = 48  # a bucket up to this size is compared directly


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words)
    if n <= shingle:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    else:
        h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))), np.uint64, n - shingle + 1)
    total, ones = len(h), np.zeros(64, np.int64)
    for i in range(0, total, 65_536):
        bits = np.unpackbits(h[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def group_bits(bits: np.ndarray, parts: int = PARTITIONS) -> list[list[int]]:
    """Put correlated bits together, from a sample (fingerprints, bits) of zeros and ones.

    Each partition grows from a free bit by the bits most correlated with those it has.
    """
    count = bits.shape[1] if bits.ndim == 2 and bits.shape[1] else 64
    if len(bits) < 2:
        return [list(range(i * count // parts, (i + 1) * count // parts)) for i in range(parts)]
    x = bits.astype(np.float32)
    x -= x.mean(axis=0)
    norm = np.sqrt((x**2).sum(axis=0)) + 1e-9
    near = np.abs(x.T @ x) / np.outer(norm, norm)
    free, out = np.ones(count, bool), []
    for i in range(parts):
        size = int(free.sum()) // (parts - i)
        own = [int(np.argmax(free))]
        free[own[0]] = False
        pull = near[own[0]].copy()
        while len(own) < size:
            best = int(np.argmax(np.where(free, pull, -1)))
            free[best] = False
            own.append(best)
            pull += near[best]
        out.append(sorted(own))
    return out


def _project(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    key = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(bits):
        key |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return key


def thresholds(values: list[np.ndarray], widths: list[int], tau: int = TAU) -> list[int]:
    """Thresholds of least estimated cost with sum tau - partitions + 1, by dynamic programming.

    ``values`` are a sample's projections on each partition of ``widths`` bits. A partition's cost at t is the number
    of sampled pairs whose projections differ in at most t bits, plus the keys that must be written for it. Thresholds
    over MOST_CHANGED are not considered where a smaller one serves: their keys would outnumber all candidates.
    """
    parts = len(values)
    top = max(min(tau, MOST_CHANGED), -(-(tau - parts + 1) // parts))
    costs = []
    for value, width in zip(values, widths, strict=True):
        seen, counts = np.unique(value, return_counts=True)
        row, pairs, ball = [0.0], 0.0, 0
        for t in range(top + 1):
            if t < 2:
                for mask in (sum(1 << i for i in c) for c in combinations(range(width), t)):
                    at = np.minimum(np.searchsorted(seen, seen ^ np.uint64(mask)), max(len(seen) - 1, 0))
                    hit = seen[at] == seen ^ np.uint64(mask) if len(seen) else np.zeros(0, bool)
                    pairs += float((counts * counts[at])[hit].sum()) if len(seen) else 0.0
            else:
                pairs *= width
            ball += comb(width, t)
            row.append(pairs + ball * max(1, len(value)))
        costs.append(row)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t, c in enumerate(row, start=-1):
                if total + t not in step or cost + c < step[total + t][0]:
                    step[total + t] = (cost + c, [*chosen, t])
        best = step
    return best[tau - parts + 1][1]


def _pairs_within(fp: np.ndarray, bits: list[int], tau: int, link) -> None:
    """Call link(i, j arrays) for enough verified pairs to connect all fingerprints within tau in this bucket."""
    n = len(fp)
    if n < 2:
        return
    if n <= SMALL or len(bits) < tau + 1:
        for i in range(0, n, 1024):
            near = np.bitwise_count(fp[i : i + 1024, None] ^ fp[None, :]) <= tau
            a, b = np.nonzero(near)
            link(a[a + i < b] + i, b[a + i < b])
        return
    size = -(-len(bits) // (tau + 1))
    for k in range(tau + 1):
        own = bits[k * size : (k + 1) * size]
        rest = [b for b in bits if b not in own]
        key = _project(fp, own)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for run in np.split(order, cuts):
            if len(run) > 1:
                _pairs_within(fp[run], rest, tau, lambda a, b, run=run: link(run[a], run[b]))


class Forest:
    """Union-find over the rows of one bucket."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def links(fps: DataFrame, tau: int = TAU, parts: int = PARTITIONS) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fps(fp)`` within ``tau`` bits."""
    total = fps.count()
    sample = np.array([r[0] for r in hashed_part(fps, "fp", SAMPLE, total).collect()], np.int64).view(np.uint64)
    groups = group_bits(np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), parts)
    limits = thresholds([_project(sample, g) for g in groups], [len(g) for g in groups], tau)
    probed = [(i, groups[i], t) for i, t in enumerate(limits) if t >= 0]
    others = [[b for i, g in enumerate(groups) if i != own or limits[own] for b in g] for own in range(len(groups))]

    def values(fp: np.ndarray):
        for i, bits, t in probed:
            base = _project(fp, bits)
            for k in range(t + 1):
                for c in combinations(range(len(bits)), k):
                    yield i, base ^ np.uint64(sum(1 << x for x in c))

    def sampled(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, key in values(fp):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int32)), pa.array(key.view(np.int64))], ["part", "key"])

    # buckets over the limit, as a sample shows them (a miss costs time alone), at most total / HOT_ROWS for each key of a row
    every = max(1, min(16, total // 10_000))
    limit = max(HOT_ROWS, total // MOST_HOT)
    some = fps.filter(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(every)) == 0).mapInArrow(sampled, "part int, key long")
    hot = {(r["part"], r["key"]) for r in some.groupBy("part", "key").count().filter(F.col("count") * every > limit).collect()}

    def keys(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, key in values(fp):
                signed = key.view(np.int64)
                of_part = [k for p, k in hot if p == i]
                big = np.isin(signed, of_part) if of_part else np.zeros(len(fp), bool)
                todo = [(~big, np.zeros(len(fp), np.int64))]
                if big.any():  # dealt by the plain pigeonhole on the other bits: linked ones agree on a slice
                    size = -(-len(others[i]) // (tau + 1))
                    todo += [(big, ((s + 1) << 56) | _project(fp, others[i][s * size : (s + 1) * size]).view(np.int64)) for s in range(tau + 1)]
                for rows, sub in todo:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(rows.sum()), i, np.int32)), pa.array(signed[rows]), pa.array(sub[rows]), pa.array(fp[rows].view(np.int64))], ["part", "key", "sub", "fp"])

    def shard(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        part, key, sub, fp = (t.column(c).to_numpy() for c in ("part", "key", "sub", "fp"))
        order = np.lexsort((sub, key, part))
        part, key, sub, fp = part[order], key[order], sub[order], fp[order].view(np.uint64)
        forest = Forest(len(fp))
        cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0) | (np.diff(sub) != 0)) + 1
        for run in np.split(np.arange(len(fp)), cuts):
            if len(run) > 1:
                _pairs_within(fp[run], others[part[run[0]]], tau, lambda a, b, run=run: forest.link(run[a], run[b]))
        root = np.array([forest.root(x) for x in range(len(fp))], np.int64)
        away = fp[root] != fp
        yield pa.RecordBatch.from_arrays([pa.array(fp[away].view(np.int64)), pa.array(fp[root[away]].view(np.int64))], ["a", "b"])

    dealt = fps.mapInArrow(keys, "part int, key long, sub long, fp long").repartition("part", "key", "sub")
    return dealt.mapInArrow(shard, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, by alternating large and small stars.

    Each round is a few joins-free aggregations over the edges, checkpointed; rounds grow with the logarithm of a
    component's size. Nothing of the graph reaches the driver but one count and one hash a round.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.filter("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def simhash_components(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) of every document."""
    rows = cut(fingerprints(docs))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = links(distinct.select("fp"), tau)
    roots = components(edges)
    cls = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = cls.groupBy("root").agg(F.min("first").alias("component_id"))
    of = cls.join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
