"""Token-id output in Re-Pair compressed shards with random access.

File format: a folder of Parquet files with one row for each shard: ``part`` (the range partition), ``shard`` (its
number in there), ``n_docs``, ``n_tokens`` and ``payload``. Parts and shards ascend with doc_id. A payload is
little-endian: a head of eight 64-bit numbers (magic, documents, symbols, rules, first nonterminal, bytes of a symbol,
tokens, 0), the documents' ids (64 bit; NULL_DOC for null) and the places of their first symbol and token (64 bit, one
more than documents), the rules' left and right symbols, their expansion lengths (32 bit), then the symbols.

Re-Pair on a shard: count the adjacent pairs, give the most frequent ones a nonterminal each, replace their occurrences
from left to right, and repeat on the shorter sequence until no pair is frequent. A round takes up to ROUND_RULES
pairs (of two that fall on one slot of its table, the other waits for the next round). ``Stop`` says when a shard is done:
by default after 12 rounds, when no pair occurs 12 times, when a round gains under 1 %, or when 16-bit symbols are used
up; with ``EXHAUSTIVE`` when no pair occurs twice. Decoded ids are the same. No rule spans two documents, so a document is decoded alone from its symbols: expansion lengths say where a
token lies without expanding what comes before.

Texts go through one range partitioning by doc_id; a shard closes at SHARD_IDS ids, so memory does not depend on the
corpus (a single longer text is one longer shard). The files are written and committed by Spark in the shared folder.

Defined results: a null text is empty and holds the end id alone; null doc_ids sort first and keep their row; repeated
rows are written as often as they occur, rows of one doc_id in the order of their texts' hash and text; very long texts
are encoded whole; further columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder
from .pieces import Memo, json_tokenizer, no_gc
from .vector_packing import vocabulary_file

END_ID = 2
SHARD_IDS = 1_000_000
TEXT_PART = 16_000_000  # bytes of text encoded at once
ROUND_RULES = 2048
KEPT = 450_000  # pieces whose ids a worker keeps in each of two generations
MAGIC = 0x52455041
NULL_DOC = -(2**63)
HEAD = 8
# Fixed value: the pieces that this vocabulary's tokenizer cuts normalised text into.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_MARKS = frozenset(",.;:!?")  # after letters alone each of these is a piece
_HIGH = re.compile("[\u0250-\U0010ffff]")

# Byte-level letters: printable bytes stand for themselves, the others, in order, for code points from 256 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


# --- encoding -----------------------------------------------------------------------------------------------------


class ChunkEncoder:
    """Ids of texts by the tokenizers library, called on distinct chunks between spaces.

    This vocabulary's tokenizer drops white space and never joins over it, so chunks can be encoded alone. ``probe``
    checks that on construction; otherwise whole texts are encoded.
    """

    def __init__(self, path: str) -> None:
        self.tok = json_tokenizer(path)
        self.model = self.tok.model
        self.pieces = Memo(self._piece, KEPT)
        probe = "It's a b\nc d.. 12 a-b\tE"
        self.apart = self._whole(probe) == b"".join(self._whole(x) for w in probe.split() for x in _PIECE.findall(w.lower()))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, p: str) -> bytes:
        """Ids of one piece by the library's merges alone, on its byte letters."""
        letters = p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_LETTERS)
        return array("I", [k.id for k in self.model.tokenize(letters)]).tobytes()

    def _ids(self, distinct: list[str]) -> list[bytes]:
        """Ids of distinct chunks: of their pieces, as the tokenizer cuts them.

        Only texts below U+0250 are cut here: they're composed already, and have simple lower case.
        """
        kept, high, out = self.pieces, _HIGH.search, []
        for c in distinct:
            if not c.isascii() and high(c):
                out.append(self._whole(c))
                continue
            low = c.lower()
            if low.isalpha():
                out.append(kept[low])
            elif low[-1:] in _MARKS and low[:-1].isalpha():
                out.append(kept[low[:-1]] + kept[low[-1]])
            elif "<|" in low:
                out.append(self._whole(c))
            else:
                out.append(b"".join([kept[p] for p in _PIECE.findall(low)]))
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of texts without nulls: cut and numbered by Arrow, so Python meets each distinct chunk once a call."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not self.apart:
            return [self._whole(t) for t in column.to_pylist()]
        words = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        numbered = words.flatten().dictionary_encode()
        each = self._ids(numbered.dictionary.to_pylist())
        # every word's ids, gathered from its chunk's place in the distinct chunks' ids
        ids, size = np.frombuffer(b"".join(each), "<u4"), np.fromiter(map(len, each), np.int64, len(each)) // 4
        which = numbered.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[which])])
        shift = (np.cumsum(size) - size)[which] - ends[:-1]
        out = ids[np.repeat(shift, size[which]) + np.arange(ends[-1])]
        at = ends[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        return [out[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]


# --- Re-Pair ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Stop:
    """When Re-Pair ends on a shard. ``EXHAUSTIVE`` goes on until no pair occurs twice; the others trade size for time."""

    rounds: int | None = 12
    least: int = 12  # occurrences a pair needs
    gain: float = 0.01  # a round that shortens the sequence by less is the last
    narrow: bool = True  # symbols of 16 bits where the vocabulary leaves room: 65,536 of them at most


EXHAUSTIVE = Stop(None, 2, 0.0, narrow=False)


def repair(ids: np.ndarray, end_id: int, base: int, stop: Stop = Stop()) -> tuple[np.ndarray, np.ndarray]:  # noqa: B008
    """(symbols, rules as pairs); symbol base + i stands for rule i. No rule holds ``end_id``."""
    a = ids.astype(np.uint32)
    limit = 65_536 if stop.narrow and base < 60_000 else 2**32 - 1
    wide = limit > 65_536
    rules: list[np.ndarray] = []
    made = 0
    for _ in count() if stop.rounds is None else range(stop.rounds):
        room = min(ROUND_RULES, limit - base - made)
        if len(a) < 2 or room < 1:
            break
        codes = (a[:-1].astype(np.uint64) << np.uint64(32)) | a[1:] if wide else (a[:-1] << np.uint32(16)) | a[1:]
        free = (a[:-1] != end_id) & (a[1:] != end_id)
        s = np.sort(codes[free])
        if not len(s):
            break
        at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        counts = np.diff(np.r_[at, len(s)])
        top = np.flatnonzero(counts >= stop.least)
        if not len(top):
            break
        top = top[np.argsort(-counts[top], kind="stable")[:room]]
        pairs = s[at[top]]
        # a hash table of the chosen pairs; of pairs that share a slot the more frequent one is taken
        slots = _slot(pairs)
        _, firsts = np.unique(slots, return_index=True)
        pairs, slots = pairs[np.sort(firsts)], slots[np.sort(firsts)]
        table = np.full(1 << 20, -1, np.int16)  # ROUND_RULES fit; the smaller table stays in cache
        table[slots] = np.arange(len(pairs))
        which = table[_slot(codes)]
        hit = np.flatnonzero((which >= 0) & free)
        hit = hit[pairs[which[hit]] == codes[hit]]
        if not len(hit):
            break
        # of overlapping occurrences every second one of a run, from the left
        start = np.r_[True, np.diff(hit) != 1]
        first = hit[np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))]
        hit = hit[(hit - first) % 2 == 0]
        a[hit] = which[hit].astype(np.uint32) + np.uint32(base + made)
        keep = np.ones(len(a), bool)
        keep[hit + 1] = False
        before, a = len(a), a[keep]
        rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32) if wide else np.stack([pairs >> np.uint32(16), pairs & np.uint32(0xFFFF)], 1))
        made += len(pairs)
        if before - len(a) < stop.gain * before:
            break
    return a, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def _slot(codes: np.ndarray) -> np.ndarray:
    if codes.dtype == np.uint32:
        return (codes * np.uint32(2654435761)) >> np.uint32(12)
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def write_shard(docs: list[int], ids: list[bytes], end_id: int, vocab: int, stop: Stop = Stop()) -> bytes:  # noqa: B008
    """A payload of documents in order; ``ids`` are little-endian 32-bit ids with the end id."""
    a = np.frombuffer(b"".join(ids), "<u4")
    base = max(vocab, int(a.max()) + 1 if len(a) else 0)
    symbols, rules = repair(a, end_id, base, stop)
    width = 2 if base + len(rules) <= 65_536 else 4
    # the end id stays a symbol of its own, so each document's symbols are found by its tokens
    lengths = rule_lengths(rules, base)
    size = np.ones(len(symbols), np.int64)
    size[symbols >= base] = lengths[symbols[symbols >= base] - base]
    token_at = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("<i8")
    symbol_at = np.searchsorted(np.cumsum(np.r_[0, size]), token_at).astype("<i8")
    head = np.array([MAGIC, len(docs), len(symbols), len(rules), base, width, len(a), 0], "<i8")
    kind = f"<u{width}"
    return b"".join(x.tobytes() for x in (head, np.array(docs, "<i8"), symbol_at, token_at, rules.astype(kind).T.copy(), lengths.astype("<u4"), symbols.astype(kind)))


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule expands to; rules only name earlier ones."""
    length: list[int] = []
    for x, y in rules.tolist():
        length.append((length[x - base] if x >= base else 1) + (length[y - base] if y >= base else 1))
    return np.array(length, np.int64)


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all rules' expansions in a row, their lengths, their starts)."""
    parts: list[list[int]] = []
    for x, y in rules.tolist():
        parts.append((parts[x - base] if x >= base else [x]) + (parts[y - base] if y >= base else [y]))
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter(chain.from_iterable(parts), np.uint32, int(length.sum())), length, np.cumsum(length) - length


class Shard:
    """A payload read back."""

    def __init__(self, payload: bytes) -> None:
        head = np.frombuffer(payload, "<i8", HEAD)
        assert head[0] == MAGIC
        n, m, r, self.base, width, self.tokens = (int(x) for x in head[1:7])
        at = 8 * HEAD

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(payload, kind, count, at)
            at += got.nbytes
            return got

        self.docs, self.symbol_at, self.token_at = take("<i8", n), take("<i8", n + 1), take("<i8", n + 1)
        kind = f"<u{width}"
        self.rules = take(kind, 2 * r).reshape(2, r).T
        self.length, self.symbols = take("<u4", r), take(kind, m)
        self.flat, _, self.starts = expansions(self.rules, self.base)

    def decode(self, first: int, last: int) -> np.ndarray:
        """The ids of documents first..last-1."""
        s = self.symbols[self.symbol_at[first] : self.symbol_at[last]]
        rule = s >= self.base
        size = np.ones(len(s), np.int64)
        size[rule] = self.length[s[rule] - self.base]
        out = np.empty(int(size.sum()), "<u4")
        at = np.cumsum(size) - size
        out[at[~rule]] = s[~rule]
        size, at = size[rule], at[rule]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(at, size) + within] = self.flat[np.repeat(self.starts[s[rule] - self.base], size) + within]
        return out


# --- Spark --------------------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, stop: Stop = Stop()) -> None:  # noqa: B008
    """Write the ids of all texts, each with ``end_id``, in ascending order of doc_id (nulls first), then text hash and text."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        with no_gc():
            yield from written(batches)

    def written(batches) -> Iterator[pa.RecordBatch]:
        enc, part, shard = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        names: list[int] = []
        held = 0
        end, vocab = np.array([end_id], "<u4").tobytes(), enc.tok.get_vocab_size()

        def close():
            nonlocal shard, held
            row = [[part], [shard], [len(names)], [held], [write_shard(names, ids, end_id, vocab, stop)]]
            shard, held = shard + 1, 0
            names.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1], pa.int32()), *(pa.array(x, pa.int64()) for x in row[2:4]), pa.array(row[4], pa.binary())], ["part", "shard", "n_docs", "n_tokens", "payload"])

        for b in batches:
            docs_of, texts = b.column(0).fill_null(NULL_DOC).to_pylist(), b.column(1).fill_null("")
            sizes, first, size = pc.binary_length(texts).to_pylist(), 0, 0
            for k, more in enumerate(sizes):
                size += more
                if size >= TEXT_PART or k == len(sizes) - 1:
                    for d, x in zip(docs_of[first : k + 1], enc.encode(texts[first : k + 1]), strict=True):
                        names.append(d)
                        ids.append(x + end)
                        held += len(x) // 4 + 1
                        if held >= SHARD_IDS:
                            yield close()
                    first, size = k + 1, 0
        if names:
            yield close()

    # the hash parts rows of one doc_id, or of none, over ranges, in an order of their own
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered.drop("h").mapInArrow(run, "part int, shard int, n_docs long, n_tokens long, payload binary").write.parquet(path)


_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                shard = Shard(b.column(2)[k].as_py())
                ids, n = shard.decode(0, len(shard.docs)), len(shard.docs)
                at = shard.token_at.tolist()
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, b.column(0)[k].as_py(), np.int32)), pa.array(np.full(n, b.column(1)[k].as_py(), np.int32)), pa.array(shard.docs.astype(np.int64), mask=shard.docs == NULL_DOC), pa.array(at[:-1], pa.int64()), pa.array(np.diff(shard.token_at).astype(np.int64)), pa.array(crc, pa.int64())],
                    ["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    rows = files.select("part", "shard", "payload").mapInArrow(run, "part int, shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # places of parts, then of shards within parts: sums over the file's own small columns
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_at"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.select("part", "shard", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("shard_at")).join(parts, "part")
    out = rows.join(shards, ["part", "shard"])
    return out.select("doc_id", (F.col("part_at") + F.col("shard_at") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files_roundtrip(docs: DataFrame) -> DataFrame:
    """Write the files in the shared folder and return each document as read back from them."""
    spark = docs.sparkSession
    path = new_folder(spark, "token-files")
    write_token_files(docs, vocabulary_file("word_bpe_49k.json"), path)
    return read_token_files(spark.read.parquet(path))
