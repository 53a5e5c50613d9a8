"""Exact dedup against a minimal perfect hash over historical distinct digests.

The history's distinct digests are dealt to shards. Each shard gets a minimal perfect hash (levels of bit
arrays, as many bits as keys times ``GAMMA`` on each level; a key's slot is the rank of its bit). A slot holds the
full digest and the winner's locator. A new digest is looked up, the slot's digest is compared byte by byte, and
either joins that winner or, as a nonmember, forms a group of its own.

Before any of that, both sides are aggregated to one row for each digest, so a group of copies of any size is one
row of a shard, and shards hold about ``SHARD_ROWS`` digests whatever the input.

The index is a Parquet table, one row a shard, written once and read by any later call. Only the last join, of rows with
their group's result, meets a large group of copies as one key; it holds digests alone, and Spark deals skewed joins anew.

Defined results: a null text equals the empty text, and texts of any length are hashed whole; rows with a null ``doc_id``
are a group member like any other, but never win over a number (a group without any has a null keep_id); exactly one row
of each group is kept, of rows that repeat the winning id the first; further columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, written

GAMMA = 2.0
SHARD_ROWS = 200_000
LEAST = -(2**63)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash over distinct digests (32 bytes each, as four 64-bit words)."""

    def __init__(self, digests: np.ndarray, locators: np.ndarray) -> None:
        keys = digests.view(np.uint64).reshape(-1, 4)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        slot, left, base = np.empty(len(keys), np.int64), np.arange(len(keys)), 0
        while len(left):
            bits = max(64, int(GAMMA * len(left)))
            at = (self._hash(keys[left], len(self.levels)) % np.uint64(bits)).astype(np.int64)
            hits = np.bincount(at, minlength=bits)
            alone = hits[at] == 1
            taken = hits == 1
            rank = np.cumsum(taken) - taken + base
            slot[left[alone]] = rank[at[alone]]
            base += int(taken.sum())
            self.levels.append((taken, rank))
            left = left[~alone]
        self.digests, self.locators = np.empty_like(keys), np.empty_like(locators)
        self.digests[slot], self.locators[slot] = keys, locators

    @staticmethod
    def _hash(keys: np.ndarray, level: int) -> np.ndarray:
        return _mix(keys[:, level % 4] ^ _mix(keys[:, (level + 1) % 4], level + 1), level + 77)

    def lookup(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for a nonmember; the slot's digest is compared in full."""
        keys = digests.view(np.uint64).reshape(-1, 4)
        slot, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (taken, rank) in enumerate(self.levels):
            if not len(left):
                break
            at = (self._hash(keys[left], level) % np.uint64(len(taken))).astype(np.int64)
            hit = taken[at]
            slot[left[hit]] = rank[at[hit]]
            left = left[~hit]
        found = slot >= 0
        if found.any():
            found[found] = (self.digests[slot[found]] == keys[found]).all(axis=1)
        return np.where(found, slot, -1)


    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"taken{i}": np.packbits(t) for i, (t, _) in enumerate(self.levels)} | {"sizes": np.array([len(t) for t, _ in self.levels], np.int64)}
        np.savez(out, digests=self.digests, locators=self.locators, **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        self, z, base = cls.__new__(cls), np.load(io.BytesIO(data), allow_pickle=False), 0
        self.digests, self.locators, self.levels = z["digests"], z["locators"], []
        for i, n in enumerate(z["sizes"].tolist()):
            taken = np.unpackbits(z[f"taken{i}"], count=n).astype(bool)
            self.levels.append((taken, np.cumsum(taken) - taken + base))
            base += int(taken.sum())
        return self


def _raw(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).copy()


GROUP = "digest binary, best long, first long, n long"


def digests(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text (A-Z lower-cased, null as empty), and the columns ``more``."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    return docs.select(*more, F.col("doc_id").cast("long"), F.unhex(F.sha2(text, 256)).alias("digest"))


def groups(rows: DataFrame) -> DataFrame:
    """One row for each digest of (row, doc_id, digest): its largest doc_id (LEAST for null), the first row with it, and its size."""
    best = F.max(F.struct(F.coalesce("doc_id", F.lit(LEAST)).alias("best"), (-F.col("row")).alias("first")))
    return rows.groupBy("digest").agg(best.alias("b"), F.count("*").alias("n")).select("digest", "b.best", (-F.col("b.first")).alias("first"), "n")


def _dealt(found: DataFrame, shards: int) -> DataFrame:
    return found.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def write_index(history: DataFrame, path: str, rows: int | None = None) -> None:
    """Write the perfect hashes over ``history(digest, best, first, n)`` of distinct digests: one row for each shard.

    ``rows``, if known, is their number or more.
    """
    shards = max(8, -(-(history.count() if rows is None else rows) // SHARD_ROWS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        table = PerfectHash(_raw(pdf["digest"]), pdf[["best", "first", "n"]].to_numpy(np.int64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iat[0])], "shards": [shards], "table": [table.to_bytes()]})

    _dealt(history, shards).groupBy("shard").applyInPandas(build, "shard int, shards int, table binary").write.parquet(path)


def look_up(index: DataFrame, new: DataFrame, rows: int | None = None) -> DataFrame:
    """The groups of history and ``new(digest, best, first, n)`` together, by a stored index (any earlier call's).

    Shards are the index's; where the new side has more than SHARD_ROWS for each, its rows are dealt in chunks by their
    digests' first bytes, and every chunk has the shard's hash, so no group grows with the delivery. A chunk answers for
    the history's digests with its own first bytes.
    """
    shards = (index.agg(F.max("shards")).first()[0]) or 8
    chunks = max(1, -(-(new.count() if rows is None else rows) // (shards * SHARD_ROWS)))
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")

    def shard(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        parts = []
        rest = np.ones(len(new), bool)
        if len(old):
            table = PerfectHash.from_bytes(old["table"].iat[0])
            held = table.locators.copy()
            if len(new):
                slot = table.lookup(_raw(new["digest"]))
                rest = slot < 0
                at = slot[~rest]  # distinct: a digest occurs once on either side
                b, f, n = (new[c].to_numpy(np.int64)[~rest] for c in ("best", "first", "n"))
                wins = (b > held[at, 0]) | ((b == held[at, 0]) & (f < held[at, 1]))
                held[at[wins], 0], held[at[wins], 1] = b[wins], f[wins]
                held[at, 2] += n
            raw = table.digests.tobytes()
            own = np.frombuffer(raw, ">u4")[::8] % chunks == key[1]
            held = held[own]
            parts.append(pd.DataFrame({"digest": [raw[32 * i : 32 * i + 32] for i in np.flatnonzero(own).tolist()], "best": held[:, 0], "first": held[:, 1], "n": held[:, 2]}))
        parts.append(new.loc[rest, ["digest", "best", "first", "n"]])  # nonmembers: groups of their own
        return pd.concat(parts, ignore_index=True)

    copies = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    dealt = _dealt(new, shards).withColumn("chunk", (head % chunks).cast("int"))
    return copies.groupBy("shard", "chunk").cogroup(dealt.groupBy("shard", "chunk")).applyInPandas(shard, GROUP)


def resolve(rows: DataFrame) -> DataFrame:
    """The groups of (row, doc_id, digest).

    The table is replayed as two deliveries: the first (even ids, and rows without) is the history, whose index is
    written; the second is looked up in the index read back. Both are whole, and so is the result.
    """
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, "digest-index")
    old = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))
    count = rows.agg(F.count(F.when(old, 1)).alias("old"), F.count(F.when(~old, 1)).alias("new")).first()  # distinct digests are no more
    write_index(groups(rows.filter(old)), path, count["old"])
    return look_up(spark.read.schema("shard int, shards int, table binary").parquet(path), groups(rows.filter(~old)), count["new"])


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    Of equal texts the largest ``doc_id`` stays; of rows that repeat it, the first.
    """
    rows = written(digests(docs).withColumn("row", F.monotonically_increasing_id()), "digests")
    out = rows.join(resolve(rows), "digest")
    keep_id = F.when(F.col("best") != LEAST, F.col("best"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def lost_rows(rows: DataFrame) -> DataFrame:
    """The (row) of each row of ``rows`` (row: a stable distinct long, doc_id, text) that is not its group's one to keep."""
    own = written(digests(rows, "row"), "digests")
    return own.join(resolve(own).filter("n > 1").select("digest", "first"), "digest").filter("row <> first").select("row")


ORACLE = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
