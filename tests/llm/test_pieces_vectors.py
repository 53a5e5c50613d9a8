"""Pieces against the library; whitening and hard negatives against brute force; nulls, ties, repeats, empty and odd rows."""

import hashlib
import random

import numpy as np
import pytest

from waymark.llm import hard_negatives, piece_rounds, welford_whiten
from waymark.llm.vector_packing import vocabulary_file

PIECES = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_file(PIECES))


def odd_texts():
    rng = random.Random(5)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "▁", "é", "0", "漢", "😀", "\t", "\r", "<s>", "tion", "​", "     ", "\0", "xx", "</s>", "<0x41>"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    out += [" " * k for k in range(1, 70)] + ["x" + " " * k + "the" for k in range(1, 70)] + [" " * k + "\n" + " " * (k % 17) + "of " for k in range(60)]
    return [*out, "", "aaaa" * 300, "ab" * 2000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz+/0123456789") for _ in range(30_000)), "word " * 5000, " " * 100_000 + "end"]


def test_pieces_equal_the_library(library):
    enc = piece_rounds.Encoder(vocabulary_file(PIECES))
    for text in odd_texts():
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert enc.encode(text) == ids, text[:80]
        assert enc.model.decode(ids) == library.decode(ids), text[:80]


def test_decoding_any_ids_equals_the_library(library):
    m, rng = piece_rounds.model(vocabulary_file(PIECES)), random.Random(3)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(259, 275), rng.randrange(3)]) for _ in range(rng.randint(0, 12))]
        assert m.decode(ids) == library.decode(ids), ids


def test_pieces_of_a_table(spark, library):
    texts = [None, "", *odd_texts()[:200], "same text", "same text", "x" * 70_000]
    docs = spark.createDataFrame([(i if i != 7 else None, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    got = piece_rounds.encode_documents(docs.repartition(3), vocabulary_file(PIECES)).collect()
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i if i != 7 else None, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    back = piece_rounds.texts(piece_rounds.tokens(docs.filter("doc_id IS NOT NULL"), vocabulary_file(PIECES)), vocabulary_file(PIECES))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: library.decode(library.encode(t or "")) for i, t in enumerate(texts) if i != 7}
    assert piece_rounds.encode_documents(docs.filter("false"), vocabulary_file(PIECES)).count() == 0


def test_words_are_kept_within_a_bound(library, monkeypatch):
    monkeypatch.setattr(piece_rounds, "WORDS_KEPT", 20)
    monkeypatch.setattr(piece_rounds, "ROUND_SYMBOLS", 100)
    enc, texts = piece_rounds.Encoder(vocabulary_file(PIECES)), [f"word{i % 37} other{i} text" for i in range(300)]
    got = enc.digests(texts)
    assert [g[0] for g in got] == [len(library.encode(t)) + 2 for t in texts]
    assert len(enc.kept) <= 21 and len(enc.kept.older) <= 21


VECTORS = "vec_id long, embedding array<float>, label int, x string, list int"


def vectors(n=700, dim=12, seed=4):
    rng = np.random.default_rng(seed)
    v = (rng.normal(size=(8, dim))[rng.integers(0, 8, n)] + rng.normal(size=(n, dim)) * np.linspace(0.2, 1, dim)).astype(np.float32)
    v[50:290] = v[50]  # a third of all rows are copies
    rows = [(i, v[i].tolist(), int(rng.integers(0, 10)), "clash", 3) for i in range(n)]
    odd = [(None, v[0].tolist(), 1, "a", 1), (n, None, 1, "a", 1), (n + 1, [], 1, "a", 1), (n + 2, [1.0, None] + [0.0] * (dim - 2), 1, "a", 1), (n + 3, [float("nan")] * dim, 1, "a", 1), (n + 4, [float("inf")] * dim, 1, "a", 1), (n + 5, [0.5], 1, "a", 1), (n + 6, v[3].tolist(), None, "a", 1), (200, v[7].tolist(), 2, "a", 1), (35, v[35].tolist(), 9, "a", 1)]
    return rows + odd


def plain(rows, dim=12):
    return [(i, np.array(e, np.float32).astype(float), label) for i, e, label, *_ in rows if e is not None and len(e) == dim and all(c is not None and np.isfinite(c) for c in e)]


def test_whitening_equals_brute_force(spark):
    rows = vectors()
    got = welford_whiten.whiten(spark.createDataFrame(rows, VECTORS).repartition(5)).toPandas()
    kept = plain(rows)
    x = np.array([np.floor(64 * e).astype(np.int64) + 1_000_000 for _, e, _ in kept])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    cov = (fit - sums / n).T @ (fit - sums / n) / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    assert len(got) == len(kept) * 12 and set(got["n"]) == {n}
    dev = ((n * x - sums) ** 2).sum(axis=1)
    want = sorted((str(i), int(d)) for (i, _, _), d in zip(kept, dev, strict=True))
    one = got[got["component"] == 1]
    assert sorted((str(None if np.isnan(i) else int(i)), int(d)) for i, d in zip(one["vec_id"], one["deviation"], strict=True)) == want
    w = (x - sums / n) @ vecs / np.sqrt(values)
    for c in range(12):
        mine = got[got["component"] == c + 1]
        a, b = np.sort(mine["whitened"].to_numpy()), w[:, c]
        assert min(np.abs(a - np.sort(b)).max(), np.abs(a - np.sort(-b)).max()) < 1e-8
        assert np.allclose(mine["explained"], values[c] / values.sum(), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-10


def test_whitening_of_few_or_no_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i < 4 else [1.0, 2.5, 3.0], 1, "", 1) for i in range(6)]
    got = welford_whiten.whiten(spark.createDataFrame(rows, VECTORS)).toPandas()
    assert len(got) == 18 and set(got["n"]) == {2} and (got[got["component"] > 1]["whitened"] == 0).all()
    assert np.allclose(got[got["component"] == 1]["whitened"].abs(), 1) and np.allclose(got[got["component"] == 1]["explained"], 1)
    assert welford_whiten.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert welford_whiten.whiten(spark.createDataFrame(rows[:1], VECTORS)).filter("whitened != 0 OR identity_error != 0").count() == 0


def test_states_merge_to_the_whole(spark, monkeypatch):
    x = np.random.default_rng(1).integers(-50, 50, (1000, 5))
    monkeypatch.setattr(welford_whiten, "FAN", 2)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(13)
    got = welford_whiten.fit(df, 5, shift=0)
    assert got.n == 1000 and (got.sums == x.sum(axis=0)).all()
    assert np.allclose(got.mean, x.mean(axis=0)) and np.allclose(got.scatter / 1000, np.cov(x.T, bias=True))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_eigen_solve(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.diag(np.repeat([3.0, 1.0], n)[:n]), np.ones((n, n)), np.zeros((n, n)), 10.0 ** -np.add.outer(np.arange(n), np.arange(n))):
        a = a + a.T
        d, q = welford_whiten.symmetric_qr(a)
        assert np.allclose(d, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, np.abs(a).max() * n))
        assert np.allclose(q @ np.diag(d) @ q.T, a, atol=1e-11 * max(1, np.abs(a).max() * n)) and np.allclose(q.T @ q, np.eye(n), atol=1e-12)


def test_deviations_beyond_a_long():
    x, sums = np.array([[3_000_000_000, 0], [5, 1]]), np.array([3_000_000_005, 1])
    assert welford_whiten.deviations(x, 2, sums) == [(6_000_000_000 - 3_000_000_005) ** 2 + 1 if (6_000_000_000 - 3_000_000_005) ** 2 + 1 < 2**63 else None, (10 - 3_000_000_005) ** 2 + 1]


def mined(rows, dim=12):
    kept = [(i, np.floor(256 * e).astype(np.int64), (label + 1) % 10 if i % 7 == 0 else label) for i, e, label in plain(rows, dim) if i is not None and label is not None]
    anchors = {}
    for i, x, label in kept:
        if i % 100 == 0 and (i not in anchors or (label, x.tolist()) < (anchors[i][0], anchors[i][1].tolist())):
            anchors[i] = (label, x)
    out = []
    for a, (label, x) in anchors.items():
        scored = [(-int(x @ y), i, other) for i, y, other in kept if i != a]
        for p, pid, _ in sorted(s for s in scored if s[2] == label)[:5]:
            ps = -p
            hard = sorted(s for s in scored if s[2] != label and 80 * ps <= -100 * s[0] <= 100 * ps)[:5]
            out += [(a, pid, k + 1, i, ps, -s) for k, (s, i, _) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("block", [2 << 20, 4000])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    monkeypatch.setattr(hard_negatives, "GROUP_BYTES", block)
    monkeypatch.setattr(hard_negatives, "LISTS", 12)
    rows = vectors()
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(5))
    assert got.columns == [c.split()[0] for c in hard_negatives.RESULT.split(", ")]
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_hard_negatives_of_copies_and_of_nothing(spark):
    rows = [(i, [0.25, 0.5], i % 3, "", 1) for i in range(250)]
    assert sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, VECTORS)).collect())) == mined(rows, 2)
    rows = [(i, [-0.25, 0.5] if i % 2 else [0.25, -0.5], 1, "", 1) for i in range(120)]
    assert sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, VECTORS)).collect())) == mined(rows, 2)
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0


def test_long_inner_products_stay_exact():
    a = np.array([[2.0**40 + 1, 3.0]])
    assert hard_negatives.inner(a, np.array([[2.0**20 + 7, 1.0]])).tolist() == [[(2**40 + 1) * (2**20 + 7) + 3]]
