"""Exact removal of repeated byte strings by a logarithmic family of sparse suffix arrays.

A string of MATCH bytes that occurs at two places holds, at both, the same anchor: the GRAM bytes whose hash is least
of all the string's grams. So the family indexes the suffixes at anchors alone, about one in 70 bytes, and still
misses no match. A suffix is ordered by the hash of its first GRAM bytes, then by that of its surroundings: the union
of the MATCH-byte windows that this anchor stands for. (A suffix array in hash order: it is only asked for equality.)

The family: texts arrive in batches. A batch's suffixes are sorted, merge-scanned against each level for entries with
equal grams, and form a level of their own; levels of about equal size are merged, so there are logarithmically many.
Suffixes are dealt to shards by their gram's hash. Entries with equal surroundings are matches over all their windows
("full"). An entry with an equal gram and surroundings of its own is "open": some windows may match. For these alone
(and one entry for each full group beside them) the bytes are fetched, and all their windows compared; those of a frequent gram are
dealt in blocks.

Repeats inside a batch of the scan are settled on the spot, with one entry passed on for each group: a passage that a
third of all texts hold reaches a shard once for each batch. Results are byte intervals by document; no pairs are made.

Full matches are told by 128 bits, from two polynomial hashes of different tables and bases (of the gram, and of all its
windows' bytes); windows of open entries are compared byte by byte. Memory: a piece of PIECE bytes at a time while hashing
(a longer text is taken whole), 28 bytes an anchor in a shard.

Suffixes are ordered by hash, not by their bytes: a match here is an equality of 200 bytes, so the order among unequal
suffixes says nothing, and to ship the bytes that a byte order compares would take several times the corpus.

Rows are told apart by a number of their own, not by doc_id. Defined results: a null text equals the empty text; texts
under MATCH bytes lose nothing; rows with a null ``doc_id`` are searched and returned like any other; rows that repeat
an id or a whole row are places of their own (so both lose what they share); very long texts are taken whole; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, heavy
from .common import numbered, written

MATCH, GRAM = 200, 64
SPAN = MATCH - GRAM + 1  # grams of a window
PIECE = 1 << 20
OPEN_ROWS = 2_000  # open entries of one gram, from which on they are dealt in blocks
U = np.uint64


def _tables(seed: int) -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1, 2**63)) * 2 + 1
    return rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1), base, pow(base, -1, 2**64)


FIRST, SECOND = _tables(20240611), _tables(20240612)
_POWERS: dict[int, np.ndarray] = {}


def _powers(of: int, n: int) -> np.ndarray:
    """of**i modulo 2**64 for i below n."""
    if of not in _POWERS or len(_POWERS[of]) < n:
        out = np.ones(max(n, PIECE + 1), np.uint64)
        done = 1
        while done < len(out):
            k = min(done, len(out) - done)
            out[done : done + k] = out[:k] * U(pow(of, done, 2**64))
            done += k
        _POWERS[of] = out
    return _POWERS[of][:n]


def prefix(data: np.ndarray, of=FIRST) -> np.ndarray:
    """Sums of table[byte] * base**i before each place; wraps modulo 2**64."""
    table, base, _ = of
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _powers(base, len(data)), out=out[1:])
    return out


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ U(salt)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def span_hash(p: np.ndarray, at: np.ndarray, length: np.ndarray | int, of=FIRST) -> np.ndarray:
    """The hash of data[at : at + length] from its prefix sums; the same wherever the bytes stand."""
    return (p[at + length] - p[at]) * _powers(of[2], len(p))[at]


def _minima(key: np.ndarray, n: int) -> np.ndarray:
    """The least key of each of ``n`` windows of SPAN places, by minima of blocks from both sides."""
    padded = np.full(-(-len(key) // SPAN) * SPAN, ~U(0))
    padded[: len(key)] = key
    padded = padded.reshape(-1, SPAN)
    out = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()[:n].copy()
    return np.minimum(out, np.minimum.accumulate(padded, axis=1).ravel()[SPAN - 1 : SPAN - 1 + n], out=out)


def anchors(texts: list[bytes]) -> dict[str, np.ndarray]:
    """For each anchor: text (index), lo, hi (first and last window start), gram and around (hashes)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    empty = {k: np.zeros(0, np.int64) for k in ("text", "lo", "hi")} | {k: np.zeros(0, np.uint64) for k in ("gram", "around")}
    n = len(data) - MATCH + 1
    if n < 1:
        return empty
    p = prefix(data)
    grams = mix((p[GRAM:] - p[:-GRAM]) * _powers(FIRST[2], len(p))[: len(p) - GRAM])
    # the least gram of each window, the first of equals: place in the low bits of a key
    low = U(max(1, int(len(grams)).bit_length()))
    least = (_minima((grams >> low << low) | np.arange(len(grams), dtype=np.uint64), n) & ((U(1) << low) - U(1))).astype(np.int64)
    # whole grams decide: where a lesser one has the same high bits, it is the one, however long the text
    for w in np.flatnonzero(_minima(grams, n) != grams[least]).tolist():
        least[w] = w + int(grams[w : w + SPAN].argmin())
    # windows that stay in their text
    ok = np.zeros(n + 1, np.int32)
    for s, z in zip(start[size >= MATCH].tolist(), size[size >= MATCH].tolist(), strict=True):
        ok[s] += 1
        ok[s + z - MATCH + 1] -= 1
    places = np.flatnonzero(np.cumsum(ok[:n]))
    if not len(places):
        return empty
    at = least[places]
    first = np.r_[True, (at[1:] != at[:-1]) | (places[1:] != places[:-1] + 1)]
    lo = places[first]
    hi = places[np.r_[np.flatnonzero(first)[1:] - 1, len(places) - 1]]
    m = at[first]
    text = np.searchsorted(start, lo, "right") - 1
    around = mix(span_hash(prefix(data, SECOND), lo, hi - lo + MATCH, SECOND), 0x51ED) + (U(0x9E3779B97F4A7C15) * ((m - lo).astype(np.uint64) * U(4096) + (hi - lo).astype(np.uint64)))
    return {"text": text, "lo": lo - start[text], "hi": hi - start[text], "gram": grams[m], "around": around}


def _contains(held: tuple[np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which pairs (gram, around) of ``asked`` are in ``held``; both words are compared."""
    gram, around = np.r_[held[0], asked[0]], np.r_[held[1], asked[1]]
    order = np.lexsort((around, gram))
    gram, around, mine = gram[order], around[order], order < len(held[0])
    new = np.r_[True, (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])]
    group = np.cumsum(new) - 1
    out = np.zeros(len(order), bool)
    out[order] = (np.bincount(group, mine) > 0)[group]
    return out[len(held[0]) :]


class Family:
    """Levels of sorted entries. Entry columns: gram, around, doc, lo, hi, many; and what has been found: full, near."""

    def __init__(self) -> None:
        self.levels: list[dict[str, np.ndarray]] = []

    @staticmethod
    def _sorted(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        order = np.lexsort((e["around"], e["gram"]))
        return {k: v[order] for k, v in e.items()}

    @staticmethod
    def _scan(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> None:
        """Mark entries of either sorted level whose gram, and whose surroundings, the other holds."""
        for x, y in ((a, b), (b, a)):
            i = np.searchsorted(y["gram"], x["gram"])
            x["near"] |= (i < len(y["gram"])) & (y["gram"][np.minimum(i, len(y["gram"]) - 1)] == x["gram"])
            both = np.flatnonzero(x["near"] & ~x["full"])
            if len(both):
                beside = np.isin(y["gram"], x["gram"][both])
                x["full"][both] |= _contains((y["gram"][beside], y["around"][beside]), (x["gram"][both], x["around"][both]))

    def add(self, e: dict[str, np.ndarray]) -> None:
        new = self._sorted(e | {"full": e["many"].copy(), "near": e["many"].copy()})
        g, a = new["gram"], new["around"]
        same = g[1:] == g[:-1]
        alike = same & (a[1:] == a[:-1])
        for name, hit in (("near", same), ("full", alike)):
            new[name][1:] |= hit
            new[name][:-1] |= hit
        for level in self.levels:
            self._scan(level, new)
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]["gram"]) < 2 * len(self.levels[-1]["gram"]):
            x, y = self.levels.pop(), self.levels.pop()
            self.levels.append(self._sorted({k: np.concatenate([y[k], x[k]]) for k in x}))

    def found(self) -> dict[str, np.ndarray]:
        """All levels as one."""
        while len(self.levels) > 1:
            x, y = self.levels.pop(), self.levels.pop()
            self.levels.append({k: np.concatenate([y[k], x[k]]) for k in x})
        return self._sorted(self.levels[0])


ENTRY = "doc long, lo int, hi int, gram long, around long, many boolean, mark boolean"
NAMES = ["doc", "lo", "hi", "gram", "around", "many", "mark"]


def _batch(doc, lo, hi, gram, around, many, mark) -> pa.RecordBatch:
    arrays = [pa.array(doc.astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)), pa.array(many), pa.array(np.full(len(doc), mark))]
    return pa.RecordBatch.from_arrays(arrays, NAMES)


def _entries(batches):
    """Scan: a batch's anchors, with repeats inside it settled. Marks (settled) and entries (for the shards)."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        parts, texts, of, held = [], [], [], 0

        def take():
            got = anchors(texts)
            got["doc"] = ids[np.array(of, np.int64)[got["text"]]] if len(got["text"]) else np.zeros(0, np.int64)
            parts.append(got)

        for k in range(b.num_rows):
            raw = (b.column(1)[k].as_py() or "").encode("utf-8", "surrogatepass")
            if len(raw) >= MATCH:
                texts.append(raw)
                of.append(k)
                held += len(raw)
            if held >= PIECE or (k == b.num_rows - 1 and texts):
                take()
                texts, of, held = [], [], 0
        if not parts:
            continue
        e = {k: np.concatenate([p[k] for p in parts]) for k in ("doc", "lo", "hi", "gram", "around")}
        order = np.lexsort((e["lo"], e["doc"], e["around"], e["gram"]))
        e = {k: v[order] for k, v in e.items()}
        first = np.r_[True, (e["gram"][1:] != e["gram"][:-1]) | (e["around"][1:] != e["around"][:-1])] if len(order) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        many = np.bincount(group)[group] > 1
        # the first of a group goes on for all; the others are settled here
        if (many & ~first).any():
            r = many & ~first
            yield _batch(*(e[k][r] for k in ("doc", "lo", "hi", "gram", "around")), many[r], True)
        yield _batch(*(e[k][first] for k in ("doc", "lo", "hi", "gram", "around")), many[first], False)


def _shard(batches):
    """A shard: family of its entries. Marks pass; then full entries as marks, and what must be looked at in bytes."""
    family, waiting, held = Family(), [], 0

    def insert():
        t = pa.Table.from_batches(waiting)
        e = {k: t.column(k).to_numpy() for k in ("doc", "lo", "hi", "gram", "around", "many")}
        family.add({k: (v.astype(np.int64).view(np.uint64) if k in ("gram", "around") else np.array(v)) for k, v in e.items()})
        waiting.clear()

    def out(e, rows, mark):
        return _batch(*(e[k][rows] for k in ("doc", "lo", "hi", "gram", "around")), e["full"][rows], mark)

    for b in batches:
        settled = b.column(6)
        if settled.true_count:
            yield b.filter(settled)
        rest = b.filter(pa.compute.invert(settled)) if settled.true_count else b
        if rest.num_rows:
            waiting.append(rest)
            held += rest.num_rows
            if held >= 50_000:
                insert()
                held = 0
    if waiting:
        insert()
    if not family.levels:
        return
    e = family.found()
    if e["full"].any():
        yield out(e, np.flatnonzero(e["full"]), True)
    wanted = e["near"] & ~e["full"]
    if wanted.any():
        g = e["gram"]
        group = np.cumsum(np.r_[False, g[1:] != g[:-1]])
        has = np.bincount(group, wanted)[group] > 0
        # of each full group beside an open entry, one entry
        new = np.r_[True, (g[1:] != g[:-1]) | (e["around"][1:] != e["around"][:-1])]
        yield out(e, np.flatnonzero(wanted | (has & e["full"] & new)), False)


FETCHED = "doc long, lo int, hi int, gram long, full boolean, raw binary, block long"


def _fetch(batches, chunks: dict[int, int]):
    """The bytes of the wanted entries' surroundings, and their blocks."""
    for b in batches:
        doc, lo, hi, gram, full, raw = [], [], [], [], [], []
        for k in range(b.num_rows):
            wanted = b.column(2)[k].as_py()
            if not wanted:
                continue
            text = (b.column(1)[k].as_py() or "").encode("utf-8", "surrogatepass")
            for w in wanted:
                doc.append(b.column(0)[k].as_py())
                lo.append(w["lo"])
                hi.append(w["hi"])
                gram.append(w["gram"])
                full.append(w["many"])
                raw.append(text[w["lo"] : w["hi"] + MATCH])
        t = pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(gram, pa.int64()), pa.array(full, pa.bool_()), pa.array(raw, pa.binary())], ["doc", "lo", "hi", "gram", "full", "raw"])
        key = np.array(gram, np.int64)
        row, block = blocks(key, (np.array(doc, np.int64).view(np.uint64) * U(1_000_003) + np.array(lo, np.int64).view(np.uint64)).view(np.int64), chunks)
        t = t.take(pa.array(row)) if chunks else t
        yield pa.RecordBatch.from_arrays([*t.columns, pa.array(block)], [*t.schema.names, "block"])


def _windows(batches):
    """A shard's open entries: windows that another entry of the same gram also has, as marks."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    order = np.lexsort((t.column("block").to_numpy(), t.column("gram").to_numpy()))
    doc, lo, hi, gram, block = (t.column(k).to_numpy()[order] for k in ("doc", "lo", "hi", "gram", "block"))
    full, raw = np.array(t.column("full").to_numpy(zero_copy_only=False))[order], t.column("raw").to_pylist()
    raw = [raw[i] for i in order.tolist()]
    edges = np.r_[0, np.flatnonzero((gram[1:] != gram[:-1]) | (block[1:] != block[:-1])) + 1, len(gram)]
    size = np.cumsum([0, *map(len, raw)])
    i = 0
    while i < len(edges) - 1:  # whole groups, about PIECE bytes at a time
        j = i + 1
        while j < len(edges) - 1 and size[edges[j + 1]] - size[edges[i]] <= PIECE:
            j += 1
        a, z = int(edges[i]), int(edges[j])
        i = j
        data = np.frombuffer(b"".join(raw[a:z]), np.uint8)
        p = prefix(data)
        count = (hi[a:z] - lo[a:z] + 1).astype(np.int64)
        own = np.repeat(np.arange(a, z), count)
        within = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        h = mix(span_hash(p, (size[a:z] - size[a])[own - a] + within, MATCH)) ^ mix(gram[own].astype(np.int64).view(np.uint64) + block[own].astype(np.uint64), 0x77)
        by = np.argsort(h, kind="stable")
        s = h[by]
        # neighbours of one hash are compared byte by byte; a window that differs from both stays
        same = np.flatnonzero(s[1:] == s[:-1])
        windows, begin = np.lib.stride_tricks.sliding_window_view(data, MATCH), ((size[a:z] - size[a])[own - a] + within)[by]
        equal = np.zeros(len(same), bool)
        for k in range(0, len(same), 1 << 16):
            x = same[k : k + (1 << 16)]
            equal[k : k + (1 << 16)] = (windows[begin[x]] == windows[begin[x + 1]]).all(axis=1)
        twin = np.zeros(len(s), bool)
        twin[same[equal] + 1] = True
        twin[same[equal]] = True
        hit = np.zeros(len(s), bool)
        hit[by] = twin
        hit &= ~full[own]
        at = np.flatnonzero(hit)
        if len(at):
            first = np.r_[True, (at[1:] != at[:-1] + 1) | (own[at[1:]] != own[at[:-1]])]
            last = np.r_[np.flatnonzero(first)[1:] - 1, len(at) - 1]
            o = own[at[first]]
            yield pa.RecordBatch.from_arrays([pa.array(doc[o].astype(np.int64)), pa.array((lo[o] + within[at[first]]).astype(np.int32)), pa.array((lo[o] + within[at[last]]).astype(np.int32))], ["doc", "lo", "hi"])


def _removal(batches):
    """Each document less its covered bytes."""
    for b in batches:
        n_bytes, n_removed, n_spans, sha = [], [], [], []
        for k in range(b.num_rows):
            raw = (b.column(1)[k].as_py() or "").encode("utf-8", "surrogatepass")
            at, kept, spans, removed = 0, [], 0, 0
            for lo, end in merged(b.column(2)[k].as_py() or []):
                kept.append(raw[at:lo])
                at, spans, removed = end, spans + 1, removed + end - lo
            kept.append(raw[at:])
            n_bytes.append(len(raw))
            n_removed.append(removed)
            n_spans.append(spans)
            sha.append(hashlib.sha256(b"".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def merged(marks: list[dict]) -> list[tuple[int, int]]:
    """Disjoint byte intervals, in order, of marks (lo, hi: first and last window start)."""
    out: list[list[int]] = []
    for lo, end in sorted((m["lo"], m["hi"] + MATCH) for m in marks):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([lo, end])
    return [(a, z) for a, z in out]


def repeated(texts: DataFrame) -> DataFrame:
    """(doc, marks): the window intervals of every row of (row, doc_id, text) that occur at another place too; doc is the
    row. The texts' exchange by row reads the same columns as that of ``remove_repeats``, so Spark makes it once."""
    # settled marks are spread, entries go to their gram's shard
    entries = texts.select("row", "text").mapInArrow(_entries, ENTRY)
    dealt = entries.repartition(F.when(F.col("mark"), F.xxhash64("doc", "lo")).otherwise(F.col("gram")))
    found = written(dealt.mapInArrow(_shard, ENTRY), "repeats")
    chunks = heavy(found.filter("NOT mark").select(F.col("gram").alias("key"), F.lit(1).alias("weight")), OPEN_ROWS)
    wanted = found.filter("NOT mark").groupBy("doc").agg(F.collect_list(F.struct("lo", "hi", "gram", "many")).alias("wanted"))
    fetched = texts.join(wanted, texts.row == wanted.doc).select("row", "text", "wanted", "doc_id").mapInArrow(lambda batches: _fetch(batches, chunks), FETCHED)
    more = fetched.repartition("gram", "block").mapInArrow(_windows, "doc long, lo int, hi int")
    marks = found.filter("mark").select("doc", "lo", "hi").union(more)
    return marks.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    texts = numbered(docs.select(F.col("doc_id").cast("long"), "text")).filter("row IS NOT NULL")  # as an inner join asks
    marks = repeated(texts)
    return texts.join(marks, texts.row == marks.doc, "left").select("doc_id", "text", "marks").mapInArrow(_removal, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
