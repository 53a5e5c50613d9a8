"""Near copies of texts: SimHash fingerprints, generalised pigeonhole search, and an exact check of the similarity.

A text's set holds the hashes of its five-word shingles. Texts whose sets have a Jaccard similarity of at least that of a
``Rule`` (0.8 unless asked otherwise) are linked, and links are closed to components; of each component one row is kept.

Two texts at that similarity differ in about 15 % of the bits of a SimHash, so 64 bits tell too little. A fingerprint
here has ``parts * WIDTH`` bits; parts follows from the similarity and the wanted recall of pairs that are just alike enough,
and from nothing else: a text has as many keys in a corpus of any size, and which pairs meet doesn't depend on the others.
A bucket's texts by chance grow with the corpus, and are dealt in blocks. The search is that of ``simhash_gph``: correlated bits
are grouped, thresholds come from dynamic programming over estimated candidate counts and sum to zero, so a pair within
parts - 1 bits is found for sure, and one just alike enough with probability ``RECALL`` (tests and README measure it).
Only those links are missed that no chain of found links closes.

* A bucket compares 128 bits of its fingerprints. Those within ``Rule.within`` bits form groups; a forest of each is returned.
* Groups are joined over all buckets. The texts of groups alone are fetched, and a group's sets are joined exactly, in
  one task, by their rarest shingles; again a forest is returned, never all pairs.
* A bucket or group over its limit is dealt in blocks: each row goes to as many blocks as the bucket has chunks, so any
  two rows meet in one. Which are so large is read from a sample of the keys; a miss costs time alone.

Texts of equal sets are one row from the start.

Defined results: null and wordless texts have the empty set and are alike; a text of fewer than five words is one
shingle; rows with a null ``doc_id`` are grouped like any other and kept after those that have one; repeated rows are
alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks
from .blocks import heavy as heavy_keys
from .common import cut, hashed_part, map_texts, written
from .pieces import Memo
from .simhash_gph import Forest, components, group_bits, thresholds

SHINGLE = 5
WIDTH = 16  # bits of a partition
RECALL = 0.99
SAMPLE = 4_000  # fingerprints for bit groups and thresholds
BUCKET_ROWS = 10_000
TASK_ENTRIES = 200_000
GROUP_HASHES = 2_000_000
GROUP_ROWS = 20_000  # texts of a block, however short
PAIRS = 1 << 21  # of sets that are compared at once
KEPT_WORDS = 60_000  # words whose hashes a task keeps in each of two generations
LAG = 48
BLOCK = 1024
U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


STEPS = _mixed(np.arange(1, 65, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


class Shingler:
    """Texts to sorted distinct shingle hashes. Words are hashed once and kept in bounded memory."""

    def __init__(self, width: int = SHINGLE) -> None:
        self.width, self.words = width, Memo(lambda w: xxhash.xxh64_intdigest(w, 42), KEPT_WORDS)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.width + 1)
        out = np.full(n, U(min(len(h), self.width)))
        for i in range(min(self.width, len(h))):
            out = _mixed(out * STEPS[0] + h[i : i + n])
        out.sort()
        return out[np.r_[True, out[1:] != out[:-1]]]


@dataclass(frozen=True)
class Rule:
    """Which sets are alike: those with a Jaccard similarity of num / den at least."""

    num: int = 4
    den: int = 5

    def __post_init__(self) -> None:
        if not 0 < self.num <= self.den:
            raise ValueError("a similarity is over 0 and at most 1")

    @property
    def apart(self) -> float:
        """The share of bits in which SimHashes of sets that are just alike enough differ."""
        return acos(min(1.0, 2 * self.num / (self.num + self.den))) / pi

    @property
    def parts(self) -> int:
        """Partitions of WIDTH bits, of which such a pair shares one with probability RECALL."""
        return max(8, ceil(log(1 - RECALL) / log(1 - min(0.999, (1 - self.apart) ** WIDTH))))

    @property
    def within(self) -> int:
        """Of 128 bits, five standard deviations more than the mean of such pairs."""
        return ceil(128 * self.apart + 5 * sqrt(128 * self.apart * (1 - self.apart)))

    def sizes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets of so many members can be alike."""
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)


def fingerprints(h: np.ndarray, size: np.ndarray, words: int) -> np.ndarray:
    """(texts, words) of 64-bit words, for hashes ``h`` of texts of ``size`` hashes each; all zero without any."""
    out = np.zeros((len(size), words), np.uint64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    start = (np.cumsum(size) - size)[full]
    runs = -(-size[full] // 255)  # a byte counts to 255
    of = np.repeat(np.arange(len(full)), runs)
    within = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
    cuts, texts = start[of] + 255 * within, np.cumsum(runs) - runs
    x = _mixed(h[:, None] + STEPS[None, :words])
    bits = np.empty((len(full), words * 8, 8), np.uint8)
    for i in range(8):
        lanes = np.add.reduceat((x >> U(i)) & U(0x0101010101010101), cuts, axis=0)
        ones = np.add.reduceat(lanes.view(np.uint8).astype(np.int32), texts, axis=0)
        bits[:, :, i] = 2 * ones > size[full][:, None]
    out[full] = np.packbits(bits, axis=2, bitorder="little").reshape(len(full), -1).view(np.uint64)
    return out


def sets(texts: DataFrame, words: int) -> DataFrame:
    """row, doc_id, sig (of the whole set), n and fp of (row, doc_id, text)."""

    def run(batches):
        shingles = Shingler()
        for b in batches:
            sig, size, fp, held, mass = [], [], [], [], 0

            def take():
                n = np.array([len(x) for x in held], np.int64)
                fp.extend(x.tobytes() for x in fingerprints(np.concatenate(held), n, words))
                size.extend(n.tolist())
                held.clear()

            for x in b.column(2):
                h = shingles(x.as_py())
                sig.append(xxhash.xxh3_128_digest(h.tobytes()))
                held.append(h)
                mass += len(h)
                if mass >= 100_000:
                    take()
                    mass = 0
            if held:
                take()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sig, pa.binary()), pa.array(size, pa.int32()), pa.array(fp, pa.binary())], ["row", "doc_id", "sig", "n", "fp"])

    return map_texts(texts.select("row", F.col("doc_id").cast("long"), "text"), run, "row long, doc_id long, sig binary, n int, fp binary")


def _bits(fp: np.ndarray, count: int) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(len(fp), 8 * fp.shape[1]), axis=1, bitorder="little")[:, :count]


def _matrix(column) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(len(column), -1)


class Buckets:
    """The keys of fingerprints: for each probed partition its value, and that with up to t bits changed."""

    def __init__(self, sample: np.ndarray, width: int, parts: int) -> None:
        self.width, self.parts = width, parts
        bits = _bits(sample, width * parts)
        self.groups = group_bits(bits, parts)
        values = [bits[:, g].astype(np.uint64) @ (U(1) << np.arange(len(g), dtype=np.uint64)) for g in self.groups]
        self.limits = thresholds(values, [len(g) for g in self.groups], parts - 1)

    def keys(self, fp: np.ndarray) -> Iterator[np.ndarray]:
        bits = _bits(fp, self.width * self.parts)
        for i, (group, t) in enumerate(zip(self.groups, self.limits, strict=True)):
            if t < 0:
                continue
            value = (bits[:, group].astype(np.int64) << np.arange(self.width)).sum(axis=1)
            for k in range(t + 1):
                for c in combinations(range(self.width), k):
                    yield (value ^ sum(1 << x for x in c)) + (i << self.width)


ENTRY = "key long, block long, node long, n int, f0 long, f1 long"


def _dealt(batch: pa.RecordBatch, chunks: dict[int, int]) -> pa.RecordBatch:
    """The batch (key, node, ...) with blocks after the key."""
    row, block = blocks(batch.column(0).to_numpy(), batch.column(1).to_numpy(), chunks)
    t = batch.take(pa.array(row)) if chunks else batch
    return pa.RecordBatch.from_arrays([t.column(0), pa.array(block), *t.columns[1:]], ["key", "block", *batch.schema.names[1:]])


def _close(f0: np.ndarray, f1: np.ndarray, n: np.ndarray, rule: Rule, a, b) -> np.ndarray:
    apart = np.bitwise_count(f0[a] ^ f0[b]) + np.bitwise_count(f1[a] ^ f1[b])
    return (apart <= rule.within) & rule.sizes(n[a], n[b])


def _bucket_groups(batches, rule: Rule = Rule()):  # noqa: B008
    """(a, b): a forest of the groups of fingerprints that are close, by bucket."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    c = {name: t.column(name).to_numpy() for name in t.column_names}
    order = np.lexsort((c["node"], c["block"], c["key"]))
    key, block, node, n = (c[x][order] for x in ("key", "block", "node", "n"))
    n, f0, f1 = n.astype(np.int64), c["f0"][order].view(np.uint64), c["f1"][order].view(np.uint64)
    new = np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])]
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, len(key)])
    run = np.cumsum(new) - 1
    a, b = [], []
    short = size[run] <= LAG
    for lag in range(1, min(LAG, int(size.max()))):  # all pairs of short buckets at once
        i = np.flatnonzero((run[lag:] == run[:-lag]) & short[lag:])
        i = i[_close(f0, f1, n, rule, i, i + lag)]
        a.append(i)
        b.append(i + lag)
    for s, z in zip(start[size > LAG].tolist(), size[size > LAG].tolist(), strict=True):
        # what is close to the first is one group; the others are compared with all
        rest = np.arange(s + 1, s + z)
        near = _close(f0, f1, n, rule, np.full(z - 1, s), rest)
        a.append(np.full(int(near.sum()), s))
        b.append(rest[near])
        rest = rest[~near]
        for k in range(0, len(rest), BLOCK):
            x, y = np.nonzero(_close(f0, f1, n, rule, rest[k : k + BLOCK, None], np.arange(s, s + z)[None, :]))
            x, y = rest[k + x], s + y
            a.append(np.minimum(x, y)[x != y])
            b.append(np.maximum(x, y)[x != y])
    x, y = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
    if len(x):
        # one row of the partition may stand for a node; the forest is over nodes
        names, at = np.unique(np.r_[node[x], node[y]], return_inverse=True)
        forest = Forest(len(names))
        pairs = np.unique(np.stack([at[: len(x)], at[len(x) :]]), axis=1)
        forest.link(pairs[0], pairs[1])
        root = np.array([forest.root(i) for i in range(len(names))])
        away = root != np.arange(len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[root[away]]), pa.array(names[away])], ["a", "b"])


def alike(a: np.ndarray, b: np.ndarray, rule: Rule = Rule()) -> bool:  # noqa: B008
    """Whether two sorted sets are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return rule.den * common >= rule.num * (len(a) + len(b) - common)


def exact_forest(held: list[np.ndarray], rule: Rule = Rule()) -> Forest:  # noqa: B008
    """The components of sorted sets that are alike: an exact join by prefixes.

    Shingles are ordered by their number of sets, rarest first. Of two sets that are alike the first n - ceil(n * num /
    den) + 1 shingles of each have one in common, so a set is looked for under these alone; sizes and the place of the
    shingle rule out more. First each set is checked with one other of each shingle, then those that are still apart.
    """
    forest = Forest(len(held))
    n = np.array([len(x) for x in held], np.int64)
    flat = np.concatenate(held)
    _, back, count = np.unique(flat, return_inverse=True, return_counts=True)
    ends = np.cumsum(n)
    sets_, ids, places = [], [], []
    for k, (z, size) in enumerate(zip(ends.tolist(), n.tolist(), strict=True)):
        own = back[z - size : z]
        first = own[np.lexsort((own, count[own]))][: size - -(-rule.num * size // rule.den) + 1]
        places.append(np.flatnonzero(count[first] > 1))
        ids.append(first[places[-1]])
        sets_.append(np.full(len(places[-1]), k))
    ids, of, place = np.concatenate(ids), np.concatenate(sets_), np.concatenate(places)
    order = np.lexsort((of, n[of], ids))
    ids, of, place = ids[order], of[order], place[order]
    runs = np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids)) + 1) if len(ids) else []
    runs = [r for r in runs if len(r) > 1]
    seen: set[tuple[int, int]] = set()

    def check(x: int, y: int) -> None:
        if forest.root(x) != forest.root(y):
            pair = (min(x, y), max(x, y))
            if pair not in seen:
                seen.add(pair)
                if alike(held[x], held[y], rule):
                    forest.link(np.array([x]), np.array([y]))

    def possible(a, b):
        na, nb = n[of[a]], n[of[b]]
        need = -(-rule.num * (na + nb) // (rule.num + rule.den))
        return rule.sizes(na, nb) & (1 + np.minimum(na - place[a], nb - place[b]) - 1 >= need)

    for r in runs:
        for b in r[1:][possible(r[0], r[1:])].tolist():
            check(int(of[r[0]]), int(of[b]))
    for r in runs:
        root, size = np.array([forest.root(x) for x in of[r].tolist()]), n[of[r]]
        far = np.searchsorted(size, rule.den * size // rule.num, side="right")  # sets come by size: none beyond can be alike
        k = 0
        while k < len(r):
            some = max(1, min(BLOCK, PAIRS // max(1, int(far[min(len(r), k + BLOCK) - 1]) - k)))
            own, others = r[k : k + some], r[k : far[min(len(r), k + some) - 1]]
            if len(np.unique(root[k : k + len(others)])) > 1:
                ok = (root[k : k + some, None] != root[None, k : k + len(others)]) & possible(own[:, None], others[None, :])
                for i, j in zip(*np.nonzero(ok), strict=True):
                    if i < j:
                        check(int(of[own[i]]), int(of[others[j]]))
            k += some
    return forest


def _group_links(batches, rule: Rule = Rule()):  # noqa: B008
    """Rows (key, block, node, text), ordered by key and block: (a, b), a forest of each group's sets that are alike."""
    shingles, at, nodes, held = Shingler(), None, [], []

    def take():
        forest = exact_forest(held, rule)
        root = [forest.root(i) for i in range(len(held))]
        away = [i for i in range(len(held)) if root[i] != i]
        return pa.RecordBatch.from_arrays([pa.array([nodes[root[i]] for i in away], pa.int64()), pa.array([nodes[i] for i in away], pa.int64())], ["a", "b"])

    for b in batches:
        for key, block, node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            if (key, block) != at:
                if len(held) > 1:
                    yield take()
                at, nodes, held = (key, block), [], []
            nodes.append(node)
            held.append(shingles(text.as_py()))
    if len(held) > 1:
        yield take()


def close_groups(distinct: DataFrame, width: int, parts: int, total: int, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """(a, b): links that connect all close fingerprints of ``distinct(node, n, fp)``."""
    sample = [bytes(r[0]) for r in hashed_part(distinct.filter("n > 0").select("node", "fp"), "node", SAMPLE, total).select("fp").collect()]
    buckets = Buckets(np.frombuffer(b"".join(sample), np.uint64).reshape(len(sample), -1) if sample else np.zeros((0, -(-width * parts // 64)), np.uint64), width, parts)
    every = max(1, min(16, total // 10_000))

    def entries(dealt: Callable[[pa.RecordBatch], pa.RecordBatch]):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    fp, node, n = _matrix(b.column(2)), b.column(0), b.column(1)
                    f = [pa.array(np.ascontiguousarray(fp[:, i]).view(np.int64)) for i in (0, 1)]
                    for key in buckets.keys(fp):
                        yield dealt(pa.RecordBatch.from_arrays([pa.array(key), node, n, *f], ["key", "node", "n", "f0", "f1"]))

        return run

    own = distinct.filter("n > 0").select("node", "n", "fp")
    some = own.filter(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(every)) == 0).mapInArrow(entries(lambda b: b), "key long, node long, n int, f0 long, f1 long")
    heavy = heavy_keys(cut(some.groupBy("key").agg(F.count("*").alias("weight")).filter(F.col("weight") * every > BUCKET_ROWS // 4)), BUCKET_ROWS, every)
    dealt = own.mapInArrow(entries(lambda b: _dealt(b, heavy)), ENTRY)
    # a stated number of tasks, as Spark would put small partitions together by bytes and so many rows into one
    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * parts // TASK_ENTRIES))
    return dealt.repartition(tasks, "key", "block").mapInArrow(partial(_bucket_groups, rule=rule), "a long, b long").distinct()


def alike_links(groups: DataFrame, texts: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """(a, b): a forest of the rows of ``groups(node, root, n)`` whose texts are alike, within their group."""
    heavy = heavy_keys(groups.select(F.col("root").alias("key"), F.greatest(F.col("n").cast("long"), F.lit(GROUP_HASHES // GROUP_ROWS)).alias("weight")), GROUP_HASHES, 1)
    # a written table has a known size: Spark broadcasts it where that is small, and sorts both sides where it isn't
    members = written(groups.select(F.col("node").alias("row"), F.col("root").alias("key")), "near-groups")
    fetched = texts.select("row", "text").join(members, "row").select("key", F.col("row").alias("node"), "text")
    dealt = map_texts(fetched, lambda batches: (_dealt(b, heavy) for b in batches), "key long, block long, node long, text string")
    return map_texts(dealt.repartition("key", "block").sortWithinPartitions("key", "block", "node"), partial(_group_links, rule=rule), "a long, b long")


def near_rows(texts: DataFrame, bits: tuple[int, int] | None = None, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """(row, root, kept) of every row of ``texts`` (row: a stable distinct long, doc_id, text); root names the component.

    Of each component the row of the smallest doc_id is kept: null after numbers, of equal ones the smallest row.
    """
    total = texts.count()
    width, parts = bits or (WIDTH, rule.parts)
    rows = cut(sets(texts, -(-max(128, width * parts) // 64)))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    distinct = cut(rows.groupBy("sig").agg(best.alias("best"), F.first("n").alias("n"), F.first("fp").alias("fp")).select("sig", F.col("best.row").alias("node"), F.col("best.doc_id").alias("doc_id"), "n", "fp"))
    groups = cut(components(close_groups(distinct, width, parts, total, rule)))
    groups = groups.union(groups.select(F.col("root").alias("node"), "root").distinct())
    groups = cut(groups.join(distinct.select("node", "n"), "node").select("node", "root", "n"))
    roots = components(alike_links(groups, texts, rule))
    of = distinct.select("sig", "node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("node").alias("row"))).alias("best")).select("root", F.col("best.row").alias("keep"))
    named = of.select("sig", "root").join(kept, "root")
    return rows.select("row", "sig").join(named, "sig").select("row", "root", (F.col("row") == F.col("keep")).alias("kept"))
