"""BPE encoding through a minimal acyclic transducer over frequent words, and decoding.

Words are the tokenizer's own pieces (a space stays with the word that follows). The corpus' word counts give the
``LEXICON_WORDS`` most frequent words of ``MIN_COUNT`` or more occurrences (at the bound, a part of equally frequent ones). They are compiled, sorted, into a minimal
acyclic automaton: equal suffix states are shared, and each state carries the number of words below it, so the path of
a word adds up to its rank, which is its output: an index into the id lists. The automaton is one flat file of
32-bit arrays in the shared folder; executors fetch it once and map it into memory. A word that isn't in it is merged
exactly, by the ranks. Results by chunk are kept in a bounded dict.

The word counts cover all texts; the lexicon has a fixed bound, so the file does not grow with the corpus.

Defined results: a null text equals the empty text and has no ids (the hash of the empty string); rows with a null
``doc_id``, repeated rows and ids are encoded each; very long texts are encoded whole, in time that grows with their length
(a word of its own with its logarithm beside); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import mmap
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hashed_part, put_shared
from .pieces import END_OF_TEXT, Memo, chunks, no_gc

LEXICON_WORDS = 50_000
MIN_COUNT = 4
SHOWN = 320_000  # chunks whose results a worker keeps in each of two generations
COUNT_ITEMS = 400_000  # words counted in a task's memory before they're passed on
MAGIC = 0x4D414C31


@lru_cache(maxsize=4)
def vocabulary(json_path: str) -> tuple[dict[bytes, int], list[bytes], dict[str, int], str]:
    """(token bytes -> id, id -> bytes, special tokens, pattern) of a byte-level BPE in the tokenizers' JSON format.

    Ids of merged tokens rise with the merges' order, so ids serve as ranks.
    """
    import json

    import public_tokenizers

    with open(json_path) as f:
        data = json.load(f)
    if (data.get("decoder") or {}).get("type") != "ByteLevel":
        raise ValueError(f"{json_path} is no byte-level vocabulary")
    # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    ids = {bytes(letters[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
    names = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for t, i in [*ids.items(), *((k.encode(), v) for k, v in special.items())]:
        names[i] = t
    return ids, names, special, public_tokenizers.PATTERN


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact BPE of one word: the adjacent pair of least rank is merged, the first of equals, until none is left."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 64:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same over a heap and a linked list, for long words."""
    from heapq import heapify, heappop, heappush

    n = len(parts)
    right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapify(heap)
    while heap:
        _, i, a, b = heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], right[i] = a + b, False, right[j]
        if right[i] < n:
            left[right[i]] = i
        for k in (left[i], i):
            if k >= 0 and right[k] < n and (r := ranks.get(parts[k] + parts[right[k]])) is not None:
                heappush(heap, (r, k, parts[k], parts[right[k]]))
    return [ranks[p] for p, ok in zip(parts, alive, strict=True) if ok]


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The minimal automaton of sorted distinct words as one flat file.

    Built from the sorted list by keeping a register of frozen states: when the next word leaves a branch, that
    branch's states are looked up by (final, arcs), and an equal state is shared.
    """
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key]

    path: list[list] = [[False, []]]
    before = b""
    for word in words:
        common = 0
        while common < min(len(word), len(before)) and word[common] == before[common]:
            common += 1
        while len(path) > common + 1:
            target = freeze(path.pop())
            path[-1][1].append((before[len(path) - 1], target))
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        before = word
    while len(path) > 1:
        target = freeze(path.pop())
        path[-1][1].append((before[len(path) - 1], target))
    root = freeze(path[0])
    below = np.zeros(len(frozen), np.int64)  # targets are frozen before their sources
    first, label, to, skip = [0], [], [], []
    for s, (final, arcs) in enumerate(frozen):
        total = int(final)
        for c, t in arcs:
            label.append(c)
            to.append(t)
            skip.append(total)
            total += int(below[t])
        below[s] = total
        first.append(len(label))
    flat, starts = [i for x in ids for i in x], np.cumsum([0, *map(len, ids)])
    arrays = [np.array(x, np.uint32) for x in (first, [int(f) for f, _ in frozen], label, to, skip, starts, flat)]
    head = np.array([MAGIC, root, *map(len, arrays)], np.uint32)
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon mapped into memory."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self.map).cast("I")
        assert view[0] == MAGIC
        self.root, at, arrays = view[1], 9, []
        for n in view[2:9]:
            arrays.append(view[at : at + n])
            at += n
        self.first, self.final, self.label, self.to, self.skip, self.starts, self.ids = arrays
        self.arcs: dict[int, tuple[int, int]] = {}  # arcs met so far: state and byte to (target, words skipped)

    def _arc(self, s: int, c: int) -> tuple[int, int]:
        """The arc of a state for a byte, found by bisection among its sorted arcs; (-1, 0) if there is none."""
        lo, hi = self.first[s], self.first[s + 1]
        end, label = hi, self.label
        while lo < hi:
            mid = (lo + hi) // 2
            if label[mid] < c:
                lo = mid + 1
            else:
                hi = mid
        if lo >= end or label[lo] != c:
            return -1, 0
        found = self.arcs[s << 8 | c] = (self.to[lo], self.skip[lo])
        return found

    def lookup(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None if it isn't in the lexicon."""
        s, out, arcs = self.root, 0, self.arcs
        for c in word:
            to, skipped = arcs.get(s << 8 | c) or self._arc(s, c)
            if to < 0:
                return None
            out += skipped
            s = to
        if not self.final[s]:
            return None
        return self.ids[self.starts[out] : self.starts[out + 1]].tolist()


def word_counts(docs: DataFrame, json_path: str) -> DataFrame:
    """(word, n) of all texts; each task adds up before it passes on."""

    def run(batches):
        pattern, seen = regex.compile(vocabulary(json_path)[3]), Counter()

        def flush():
            words: Counter[str] = Counter()
            for chunk, n in seen.items():
                if chunk.isalpha() or (chunk[:1] == " " and chunk[1:].isalpha()):  # one word to the pattern
                    words[chunk] += n
                else:
                    for w in pattern.findall(chunk):
                        words[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for text in b.column(0):
                seen.update(chunks(text.as_py() or ""))
                if len(seen) > COUNT_ITEMS:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, json_path: str, words: int = LEXICON_WORDS, least: int = MIN_COUNT) -> bytes:
    """Count, choose at most ``words`` words and compile them; the bound holds for any corpus."""
    counted = cut(word_counts(docs, json_path).filter(F.col("n") >= least))
    # counts by steps of a sixteenth of a doubling: about a thousand rows at most, whatever the corpus
    step = F.floor(16 * F.log2("n"))
    have, bar = 0, -1
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), reverse=True):
        if have + r["k"] > words:
            bar = r["step"]
            break
        have += r["k"]
    sure = counted.filter(step > bar).select("word").collect()  # at most ``words`` rows
    rest = counted.filter(step == bar)  # of the step that doesn't fit in whole, a part chosen by hash, below the bound
    room = words - have
    ties = hashed_part(rest, "word", max(0, int(room - 4 * room**0.5)), rest.count()).select("word").collect() if bar >= 0 else []
    chosen = sorted(r["word"].encode() for r in [*sure, *ties])
    ranks = vocabulary(json_path)[0]
    return compile_lexicon(chosen, [merge(w, ranks) for w in chosen])


class Encoder:
    """Texts to (number of ids, SHA-256 of the ids, ids) by lexicon, exact merges and a bounded dict."""

    def __init__(self, json_path: str, lexicon: Lexicon | None) -> None:
        self.ranks, self.names, self.special, pattern = vocabulary(json_path)
        self.pattern, self.lexicon = regex.compile(pattern), lexicon
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.kept = Memo(self._chunk)
        self.shown = Memo(self._show, SHOWN)
        self.core = _core(json_path)
        self.words = Memo(lambda w: self.word(w.encode("utf-8", "surrogatepass")), SHOWN // 4)

    def word(self, word: bytes) -> list[int]:
        found = self.lexicon.lookup(word) if self.lexicon else None
        return self.core._encode_single_piece(word) if found is None else found

    def _chunk(self, chunk: str) -> list[int]:
        if chunk.isalpha() or (chunk[:1] == " " and chunk[1:].isalpha()):  # one word to the pattern
            return self.word(chunk.encode("utf-8", "surrogatepass"))
        return [i for w in self.pattern.findall(chunk) for i in self.words[w]]

    def encode(self, text: str) -> list[int]:
        if self.split and any(s in text for s in self.special):
            return [i for part in self.split.split(text) if part for i in ([self.special[part]] if part in self.special else self.encode(part))]
        out: list[int] = []
        for ids in map(self.kept.__getitem__, chunks(text)):
            out += ids
        return out

    def digests(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the text decoded from the ids), put together by chunk."""
        if self.split and any(s in text for s in self.special):
            ids = self.encode(text)
            n, joined, raw = len(ids), ",".join(map(str, ids)), b"".join(map(self.names.__getitem__, ids))
        else:
            found = [x for x in map(self.shown.__getitem__, chunks(text)) if x[0]]
            n, joined, raw = sum([x[0] for x in found]), ",".join([x[1] for x in found]), b"".join([x[2] for x in found])
        return n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest()

    def _show(self, chunk: str) -> tuple[int, str, bytes]:
        ids = self._chunk(chunk)
        return len(ids), ",".join(map(str, ids)), b"".join(map(self.names.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.names.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _core(json_path: str):
    """Exact merges by the ranks, compiled; the same as ``merge``."""
    import tiktoken

    return tiktoken.Encoding("merge", pat_str=vocabulary(json_path)[3], mergeable_ranks=vocabulary(json_path)[0], special_tokens={})


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(json_path: str, file: str) -> Encoder:
    """One encoder for a worker process; the file is on this machine once for all its tasks."""
    if (json_path, file) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[json_path, file] = Encoder(json_path, Lexicon(SparkFiles.get(file)))
    return _ENCODERS[json_path, file]


def encode_documents(docs: DataFrame, json_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    spark = docs.sparkSession
    data = build_lexicon(docs, json_path)
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    if name not in {str(x).rpartition("/")[2] for x in spark.sparkContext.listFiles}:  # the same words give the same file
        spark.sparkContext.addFile(put_shared(spark, name, data))

    def run(batches):
        with no_gc():
            yield from encoded(batches)

    def encoded(batches):
        enc = _encoder(json_path, name)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column(1):
                k, x, y = enc.digests(text.as_py() or "")
                n.append(k)
                ids_sha.append(x)
                text_sha.append(y)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


__all__ = ["END_OF_TEXT", "Encoder", "Lexicon", "build_lexicon", "compile_lexicon", "encode_documents", "merge"]
