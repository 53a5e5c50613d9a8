"""The near-dedup stage against all pairs: every near copy of five-word Jaccard 0.8 or more is found."""

import random

import corpus_pipeline
import numpy as np
import pytest

from waymark.llm import simhash_near

SCHEMA = "doc_id long, text string"


def brute(rows):
    """Root of each row by all pairs, with sets of plain strings."""
    words = [(t or "").encode().lower().split() for t in rows]
    sets = [{b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    n = 0
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                n += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))], n


def near_copies():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage, out = [word() for _ in range(60)], [None, "", "one two", "ONE  two", "one two three", " "]
    for _ in range(30):
        base = [word() for _ in range(rng.randint(5, 300))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 6)):
            x = list(base)
            for _ in range(rng.randint(0, 8)):
                x[rng.randrange(len(x))] = word()
            out.append(" ".join(x))
    base = [word() for _ in range(200)]
    for _ in range(60):  # one large group, many of whose pairs are not alike themselves
        x = list(base)
        for _ in range(rng.randint(1, 4)):
            x[rng.randrange(len(x))] = word()
        out.append(" ".join(x))
    return out


@pytest.mark.parametrize(("bucket", "hashes"), [(10_000, 2_000_000), (8, 2_000)])
def test_near_stage_finds_all_pairs(spark, monkeypatch, bucket, hashes):
    monkeypatch.setattr(simhash_near, "BUCKET_ROWS", bucket)  # the small limits deal buckets and groups in blocks
    monkeypatch.setattr(simhash_near, "GROUP_HASHES", hashes)
    rows = near_copies()
    want, pairs = brute(rows)
    assert pairs > 500
    got = corpus_pipeline.near(spark, spark.createDataFrame(list(enumerate(rows)), SCHEMA).repartition(3), "")
    assert got.columns == ["doc_id", "text"]
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i, x in enumerate(want) if i == x]


def pairs_near(least, count, low, high):
    """(texts two by two, whether each pair's similarity is ``least`` or more), of similarities from low to high."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, alike = [], []
    while len(alike) < count:
        n = rng.randint(60, 400)
        a = [word() for _ in range(n)]
        b = list(a)
        for k in rng.sample(range(5, n - 5), max(1, round(n * 0.2 * (1 - least) / (1 + least)))):
            b[k] = word()
        s, t = ({tuple(x[i : i + 5]) for i in range(n - 4)} for x in (a, b))
        j = len(s & t) / len(s | t)
        if low <= j <= high:
            alike.append(j >= least)
            rows += [" ".join(a), " ".join(b)]
    return rows, alike


@pytest.mark.parametrize(("least", "rule", "others"), [(0.8, simhash_near.Rule(), 0), (0.8, simhash_near.Rule(), 6000), (0.9, simhash_near.Rule(9, 10), 0)])
def test_pairs_just_alike_enough_are_found(spark, least, rule, others):
    """Recall of pairs just over the similarity, in 400 pairs, is near RECALL, alone and among other texts; none below is linked."""
    rows, alike = pairs_near(least, 400, least - 0.03, least + 0.03)
    texts = spark.createDataFrame([(i, i, x) for i, x in enumerate(rows)], "row long, doc_id long, text string")
    more = spark.range(10_000, 10_000 + others).selectExpr("id AS row", "id AS doc_id", "array_join(transform(sequence(1, 40), i -> sha2(concat(id, '-', i), 256)), ' ') AS text")
    kept = {r["row"]: r["kept"] for r in simhash_near.near_rows(texts.union(more), rule=rule).collect()}
    assert len(kept) == 800 + others and sum(not v for v in kept.values()) <= sum(alike)
    assert all(kept[2 * i] for i in range(400))
    assert all(kept[2 * i + 1] for i in range(400) if not alike[i])
    found = sum(not kept[2 * i + 1] for i in range(400) if alike[i])
    assert sum(alike) > 100 and found >= 0.97 * sum(alike)


def test_templates_that_are_close_but_not_alike():
    """Sets that share 8 of 10 shingles are not alike (8 of 12); comparing thousands of them takes little memory."""
    import tracemalloc

    shared = np.arange(8, dtype=np.uint64)
    held = [np.r_[shared, np.array([100 + 2 * i, 101 + 2 * i], np.uint64)] for i in range(400)] + [np.arange(5000 + 30 * i, 5020 + 30 * i, dtype=np.uint64) for i in range(20)]
    held += [np.r_[np.uint64(0), np.arange(10_000 + 100 * i, 10_000 + 100 * i + 20 + i % 60, dtype=np.uint64)] for i in range(6000)]
    tracemalloc.start()
    forest = simhash_near.exact_forest(held)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    assert all(forest.root(i) == i for i in range(len(held)))


def test_fingerprints_equal_plain_counting():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 5, 255, 256, 700, 0]
    h = rng.integers(0, 2**63, sum(sizes)).astype(np.uint64)
    got, at = simhash_near.fingerprints(h, np.array(sizes), 3), 0
    for i, n in enumerate(sizes):
        ones = np.zeros(192, int)
        for x in h[at : at + n]:
            words = simhash_near._mixed(x + simhash_near.STEPS[:3])
            ones += np.unpackbits(words.view(np.uint8), bitorder="little")
        assert (np.unpackbits(got[i].view(np.uint8), bitorder="little") == (2 * ones > n)).all()
        at += n


def test_near_stage_keeps_one_row_and_null_ids(spark):
    words = [f"w{i}" for i in range(200)]
    near = " ".join([*words[:100], "changed", *words[101:]])
    rows = [(None, " ".join(words)), (3, near), (None, "alone " * 3), (None, "alone " * 3), (7, "x y"), (7, "x y"), (7, "other")]
    got = corpus_pipeline.near(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "alone " * 3), (3, near), (7, "other"), (7, "x y")]
    assert corpus_pipeline.near(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
