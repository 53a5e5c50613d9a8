"""Hard-negative mining: exact searches over k-means inverted lists, bounded by Cauchy and Schwarz.

Vectors become whole numbers; scores are integer inner products. Centroids are fitted on a bounded sample; every row then
goes to the list of its nearest centroid, and each list is dealt in blocks of about ``BLOCK_BYTES`` with their own radius
(greatest distance to the centroid) and range of scores: an anchor a with centroid c scores between a.c - |a| r and
a.c + |a| r in a block of radius r. An ask is an anchor with a window of scores; it wants the best ``k`` rows of its label
(positives), or of other labels (negatives), inside the window. Asks visit the lists by falling upper bound, in two waves:
first the ``FIRST`` best lists, then every list whose bound isn't strictly below the kth score so far; lists whose range misses
the window are never visited. Whatever the lists, the result is exact; they only save work. Blocks and groups of asks meet by
an equi-join on (list, block), so a list that holds most of the rows is many tasks.

Left out: null labels, null or empty vectors, and any null or non-finite entry. A null vec_id is neither anchor nor result.
Vectors of another length than the most frequent (of equal ones the greatest) are left out too. Rows that share a vec_id are
rows of their own, but none is a result of an anchor of its own id; of anchors that share one, the least (label, vector)
counts. Inner products must fit a long. Ties go to the smaller vec_id; further columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_part, written

LISTS = 64
SAMPLE = 20_000  # distinct vectors on which the centroids are fitted, about
BLOCK_BYTES = 2 << 20  # of a block's vectors
GROUP_BYTES = 1 << 20  # of the vectors of a group of asks
FIRST = 6
RAISED = 1.0 + 1e-9  # bounds are floats; this is more than their error
EXACT = 2.0**53
NOTHING = -(2**62)


def whole(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and x (array<double> of whole numbers) of the rows that take part."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = e.filter("vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL").filter((F.size("e") > 0) & ~bad)
    return good.select("vec_id", "label", F.transform("e", lambda c: F.floor(c * scale).cast("double")).alias("x"))


def kmeans(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from rows spread over the sample; an empty list keeps its centroid."""
    sample = sample[np.lexsort(sample.T[::-1])]
    centre = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(sample, centre)
        count = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre * centre).sum(axis=1) - 2 * (x @ centre.T)).argmin(axis=1)


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, 0))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as longs."""
    most = np.sqrt((a * a).sum(axis=1).max(initial=0.0) * (b * b).sum(axis=1).max(initial=0.0))
    return (a @ b.T).astype(np.int64) if most < EXACT else a.astype(np.int64) @ b.astype(np.int64).T


INDEX = "list int, block long, radius double, ids binary, labels binary, vectors binary"


def build_index(rows: DataFrame, centre: np.ndarray) -> tuple[DataFrame, DataFrame, dict[int, float]]:
    """(written index of INDEX rows, (list, blocks), {list: radius}) of rows(vec_id, label, x); a list is a centroid."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["list"] = nearest(stacked(b["x"]), centre).astype(np.int32) if len(b) else np.zeros(0, np.int32)
            yield b

    dealt = written(rows.mapInPandas(assign, "vec_id long, label long, x array<double>, list int"), "lists")
    blocks = written(dealt.groupBy("list").agg(F.ceil(F.count("*") * (8 * centre.shape[1]) / BLOCK_BYTES).cast("long").alias("blocks")), "blocks")  # a row a list
    dealt = dealt.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("vec_id", "label"), F.col("blocks")))

    def pack(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("vec_id", kind="stable")
        x = stacked(b["x"])
        radius = float(np.sqrt(((x - centre[key[0]]) ** 2).sum(axis=1)).max())
        return pd.DataFrame({"list": [key[0]], "block": [key[1]], "radius": [radius], "ids": [b["vec_id"].to_numpy(np.int64).tobytes()], "labels": [b["label"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()]})

    index = written(dealt.select("vec_id", "label", "x", "list", "block").groupBy("list", "block").applyInPandas(pack, INDEX), "index")
    return index, blocks, {r["list"]: r["radius"] for r in index.groupBy("list").agg(F.max("radius").alias("radius")).collect()}


ASKS = "ask long, anchor_id long, label long, x array<double>, low long, high long"


def search(asks: DataFrame, index: DataFrame, blocks: DataFrame, radii: dict[int, float], centre: np.ndarray, *, same: bool, k: int) -> DataFrame:
    """ask, vec_id, score, rank of the best ``k`` rows of each of ASKS: of the anchor's label if ``same``, else of others, with
    low <= score <= high, and not of the anchor's own id."""
    lists = np.array(sorted(radii), np.int64)
    radius = np.array([radii[i] for i in lists.tolist()])
    groups = max(1, -(-asks.count() * 8 * centre.shape[1] // GROUP_BYTES))
    grouped = asks.withColumn("group", F.pmod(F.xxhash64("anchor_id"), F.lit(groups)))

    def visits(first: bool):
        def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            x = stacked(b["x"])
            at, reach = x @ centre[lists].T, np.sqrt((x * x).sum(axis=1))[:, None] * radius
            slack = (np.abs(at) + reach) * (RAISED - 1) + 1e-6
            upper, lower = at + reach + slack, at - reach - slack
            best = np.argsort(-upper, axis=1, kind="stable")[:, :FIRST]
            early = np.zeros(upper.shape, bool)
            np.put_along_axis(early, best, True, axis=1)
            low = np.maximum(b["low"].to_numpy(np.int64), b["kth"].to_numpy(np.int64))[:, None].astype(float)
            go = (upper >= low) & (lower <= b["high"].to_numpy(float)[:, None]) & (early if first else ~early)
            out = []
            for j in np.flatnonzero(go.any(axis=0)).tolist():
                part = b[go[:, j]].sort_values("anchor_id", kind="stable")
                ids, back, place = np.unique(part["anchor_id"].to_numpy(np.int64), return_index=True, return_inverse=True)
                plain = [part[c].to_numpy(np.int64).tobytes() for c in ("ask", "anchor_id", "label", "low", "high", "kth")]
                vectors = stacked(part["x"].iloc[back]).tobytes()
                out.append((int(lists[j]), *plain, place.astype(np.int64).tobytes(), vectors))
            return pd.DataFrame(out, columns=["list", "ask", "anchor", "label_", "low", "high", "kth", "place", "asked"])

        return run

    dim = centre.shape[1]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ask, anchor, label, low, high, kth, place = (np.frombuffer(v, np.int64) for v in (r.ask, r.anchor, r.label_, r.low, r.high, r.kth, r.place))
                asked, x = np.frombuffer(r.asked).reshape(-1, dim), np.frombuffer(r.vectors).reshape(-1, dim)
                ids, labels = np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64)
                to = asked @ centre[r.list]
                reach = np.sqrt((asked * asked).sum(axis=1)) * r.radius
                slack = (np.abs(to) + reach) * (RAISED - 1) + 1e-6
                floor = np.maximum(low, kth)
                go = np.flatnonzero(((to + reach + slack)[place] >= floor) & ((to - reach - slack)[place] <= high))  # by the block's own radius
                found: list[tuple] = []
                for a in range(0, len(go), 256):
                    some = go[a : a + 256]
                    used, row = np.unique(place[some], return_inverse=True)
                    scores = inner(asked[used], x)
                    for i, j in zip(some.tolist(), row.tolist(), strict=True):
                        s = scores[j]
                        hit = np.flatnonzero((s >= floor[i]) & (s <= high[i]) & ((labels == label[i]) == same) & (ids != anchor[i]))
                        if len(hit) > k:
                            hit = hit[np.lexsort((ids[hit], -s[hit]))[:k]]
                        found += [(int(ask[i]), int(ids[h]), int(s[h])) for h in hit.tolist()]
                if found:
                    yield pd.DataFrame(found, columns=["ask", "vec_id", "score"])

    best = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")

    def wave(state: DataFrame, first: bool) -> DataFrame:
        schema = "list int, ask binary, anchor binary, label_ binary, low binary, high binary, kth binary, place binary, asked binary"
        calls = state.groupBy("group").applyInPandas(visits(first), schema).join(F.broadcast(blocks), "list")
        # a list's blocks are asked apart: both sides meet by (list, block)
        met = calls.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).join(index, ["list", "block"]).mapInPandas(meet, "ask long, vec_id long, score long")
        return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    one = written(wave(grouped.withColumn("kth", F.lit(NOTHING)), True), "found")
    kth = one.filter(F.col("rank") == k).select("ask", F.col("score").alias("kth"))
    two = wave(grouped.join(kth, "ask", "left").fillna({"kth": NOTHING}), False)
    return one.unionByName(two).select("ask", "vec_id", "score").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(embeddings: DataFrame, *, every: int = 100, k: int = 5, low: int = 80, labels: int = 10, moved: int = 7) -> DataFrame:
    """RESULT rows: for each anchor (vec_id divisible by ``every``) and each of its ``k`` positives, its ``k`` hard negatives.

    Labels of ids divisible by ``moved`` go up by one, modulo ``labels``. A negative scores from ``low`` hundredths of the
    positive's score up to that score.
    """
    spark = embeddings.sparkSession
    rows = whole(embeddings)
    rows = rows.withColumn("label", F.when(F.col("vec_id") % moved == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label")))
    lengths = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], RESULT)
    dim, total = lengths[0]["dim"], lengths[0]["n"]
    rows = rows.filter(F.size("x") == dim)
    sample = hashed_part(rows, "x", SAMPLE, total).select("x").distinct().limit(2 * SAMPLE).toPandas()["x"]
    if not len(sample):  # a few vectors repeated so often that the part by hash has none
        sample = rows.select("x").limit(1).toPandas()["x"]
    centre = kmeans(stacked(sample), LISTS)
    index, blocks, radii = build_index(rows, centre)
    anchors = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("a"))
    anchors = written(anchors.select(F.col("vec_id").alias("anchor_id"), F.col("a.label").alias("label"), F.col("a.x").alias("x")), "anchors")
    asks = anchors.select(F.col("anchor_id").alias("ask"), "anchor_id", "label", "x", F.lit(NOTHING).alias("low"), F.lit(2**62).alias("high"))
    positives = search(asks, index, blocks, radii, centre, same=True, k=k).withColumnRenamed("vec_id", "positive_id").withColumnRenamed("score", "positive_score")
    positives = written(positives.select(F.col("ask").alias("anchor_id"), "positive_id", "positive_score", F.monotonically_increasing_id().alias("ask")), "positives")
    # low hundredths, rounded up; a negative score leaves no window
    least = F.expr(f"({low} * positive_score + 99) div 100")
    windows = positives.filter("positive_score >= 0").join(anchors, "anchor_id").withColumn("low", least).withColumn("high", F.col("positive_score"))
    found = search(windows.select("ask", "anchor_id", "label", "x", "low", "high"), index, blocks, radii, centre, same=False, k=k)
    out = found.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").join(positives, "ask")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: Fixed parameters of ``mine`` in SQL; casts keep the columns' kinds.
ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 5
"""
