"""Piece encoding and decoding by vectorised merge rounds: SentencePiece BPE models with byte fallback.

A text gets a space in front, spaces become U+2581, and it is cut into words where no piece of the model goes across. New
words of a batch lie one after another in flat numpy arrays of symbols. A round finds the best pair of each word (a segmented
minimum over the ranks of its pairs), merges the pair's leftmost places that don't overlap, all words at once, and closes
the gaps; words without a pair are done. Words already met are kept in a bounded dict.

One round merges all places of a word's best pair where the library takes one at a time. That is the same unless the merged
piece starts or ends another piece of the same or a better rank, which the library would take before the pair's next place;
such pieces are known from the model, and a round merges a word's places up to the first where that happens.

Null texts are empty; an empty text gives the begin and end ids alone. Texts of any length are encoded whole: within long
words further cuts go where two characters never meet inside a piece. Repeated rows give equal rows, an empty table none;
other columns are ignored, whatever their names; a null doc_id stays null. A text must be valid Unicode, as Spark's are.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .pieces import Memo, no_gc

SPACE = "▁"
WORDS_KEPT = 300_000
NONE = np.iinfo(np.int32).max
LONG = 48  # words of more characters are cut wherever no piece can go across
SPAN = 1 << 21  # more than any symbol: ids below, then code points of characters that are no piece
ROUND_SYMBOLS = 1 << 20  # new words are encoded once they have so many characters


class Model:
    """Tables of one model file: pieces, ranks, pairs, and how ids are shown."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk, self.size = sp.bos_id(), sp.eos_id(), sp.unk_id(), n
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.bytes = np.zeros(256, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(names[i][1:-1], 16)] = i
        self.byte_of = {int(i): k for k, i in enumerate(self.bytes)}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.shown = [b"" if i in self.control else names[i].replace(SPACE, " ").encode() for i in range(n)]
        for k, i in enumerate(self.bytes):
            self.shown[i] = bytes([k])
        if self.unk >= 0:
            self.shown[self.unk] = " ⁇ ".encode()

        scores = np.array([sp.get_score(i) for i in plain])
        rank = np.full(n, NONE, np.int64)
        rank[plain] = np.searchsorted(np.unique(-scores), -scores)  # equal scores rank equally
        self.ranks = np.append(rank, NONE).astype(np.int32)  # at -1: no piece

        left, right, made, near, wary = [], [], [], set(), set()
        for name, i in self.ids.items():
            near.update(ord(a) << 21 | ord(b) for a, b in zip(name, name[1:], strict=False))
            for k in range(1, len(name)):
                a, b = self._symbol(name[:k]), self._symbol(name[k:])
                if a >= 0 and b >= 0:
                    left.append(a)
                    right.append(b)
                    made.append(i)
                    wary.update(x for x in (a, b) if x < n and rank[i] <= rank[x])
        keys = np.array(left, np.int64) * SPAN + np.array(right, np.int64)
        # open addressing: a key lies at its hash or in one of the next few slots
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.slot_keys, self.slot_made = np.full((1 << self.bits) + 64, -1, np.int64), np.full((1 << self.bits) + 64, -1, np.int32)
        self.steps = 0
        for key, at, x in zip(keys.tolist(), self._slot(keys).tolist(), made, strict=True):
            k = 0
            while self.slot_keys[at + k] not in (-1, key):
                k += 1
            self.slot_keys[at + k], self.slot_made[at + k] = key, x
            self.steps = max(self.steps, k)
        self.near = np.sort(np.fromiter(near, np.int64, len(near)))
        self.wary = np.zeros(n, bool)
        self.wary[list(wary)] = True
        self.single = np.arange(0x110000, dtype=np.int32) + np.int32(n)
        for name, i in self.ids.items():
            if len(name) == 1:
                self.single[ord(name)] = i
        self.breaks = not any("\n" in name for name in self.ids if len(name) > 1)
        self.words = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if self.breaks else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.splits = not any(SPACE in name.lstrip(SPACE) for name in self.ids)
        self.run = 0  # so many spaces at the start of a longer run are always one piece; 0: not known to be
        longest = max((len(x) for x in self.ids if not x.strip(SPACE)), default=0)
        if longest > 1 and all(ids[:2] == [self.ids[SPACE * longest]] * 2 for ids in self.encode([SPACE * (k + 2 * longest) for k in range(1, longest + 1)])):
            self.run = longest
            self.runs = re.compile(f"(?:{SPACE}{{{longest}}})+(?={SPACE}{{{longest + 1}}})")

    def _symbol(self, text: str) -> int:
        found = self.ids.get(text, -1)
        return self.size + ord(text) if found < 0 and len(text) == 1 else found

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, -1 if none."""
        keys = left.astype(np.int64) * SPAN + right
        at = self._slot(keys)
        seen = self.slot_keys[at]
        out = np.where(seen == keys, self.slot_made[at], np.int32(-1))
        more = np.flatnonzero((seen != keys) & (seen != -1))
        for _ in range(self.steps):
            if not len(more):
                break
            at[more] += 1
            seen = self.slot_keys[at[more]]
            hit = seen == keys[more]
            out[more[hit]] = self.slot_made[at[more[hit]]]
            more = more[~hit & (seen != -1)]
        return out

    def cut(self, text: str) -> list[str]:
        """Words of a text; no piece goes across two of them."""
        if not text:
            return []
        if "\0" in text or "  " in text or SPACE in text or text[0] == " " or not (self.breaks and self.splits):
            text = SPACE + text.replace(" ", SPACE)
            if not self.splits:
                return [text]
            found = self.words.findall(text)
            return [part for w in found for part in self._runs(w)] if self.run and SPACE * (2 * self.run + 1) in text else found
        return (SPACE + text.replace(" ", "\0" + SPACE).replace("\n", "\0\n\0")).split("\0")

    def _runs(self, word: str) -> list[str]:
        """A long run of spaces in pieces: its start goes by the longest piece whatever follows."""
        head = self.runs.match(word)
        return [SPACE * self.run] * (head.end() // self.run) + [word[head.end() :]] if head else [word]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (spaces as U+2581)."""
        ids, ends = self.flat(words)
        flat, ends = ids.tolist(), ends.tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, each word's end), by merge rounds over all of them."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        if not len(code):
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        start = np.zeros(len(code), bool)
        start[(np.cumsum(lens) - lens)[lens > 0]] = True
        if lens.max() > LONG:  # cut long words where their characters can't meet in a piece
            far = np.flatnonzero(np.repeat(lens > LONG, lens) & ~start)
            meet = code[far - 1].astype(np.int64) << 21 | code[far]
            at = np.minimum(np.searchsorted(self.near, meet), len(self.near) - 1)
            start[far[self.near[at] != meet]] = True
        first = np.flatnonzero(start)
        done_sym, done_seg = self._rounds(self.single[code], np.diff(first, append=len(code)))
        # symbols in the order of their segments; those of a segment came out together, in order
        order = np.argsort(done_seg, kind="stable")
        sym, own = done_sym[order], np.repeat(np.arange(len(words)), lens)[first[done_seg[order]]]
        plain = sym < self.size
        if not plain.all():
            sym, own = self._spell(sym, own, plain)
        return sym, np.cumsum(np.bincount(own, minlength=len(words)))

    def _rounds(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, segments) once no pair is left, for segments of ``size`` symbols (one at least) one after another."""
        out_sym, out_seg = [], []
        live = np.arange(len(size))
        ends = np.cumsum(size)
        made = np.full(len(sym), -1, np.int32)
        inner = np.ones(len(sym), bool)
        inner[ends - 1] = False  # the last symbol of a segment starts no pair
        same = np.flatnonzero(inner)
        made[same] = self.pairs(sym[same], sym[same + 1])
        rank = self.ranks[made]
        while len(sym):
            best = np.minimum.reduceat(rank, ends - size)
            if (best == NONE).any():
                going = best < NONE
                keep = np.repeat(going, size)
                over = ~keep
                out_sym.append(sym[over])
                out_seg.append(np.repeat(live[~going], size[~going]))
                sym, made, rank, live, best, size = sym[keep], made[keep], rank[keep], live[going], best[going], size[going]
                ends = np.cumsum(size)
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            if len(at) > len(live):
                # leftmost places that don't overlap: every other one of a row of neighbours, from its start
                new_run = np.ones(len(at), bool)
                new_run[1:] = at[1:] != at[:-1] + 1
                run = np.flatnonzero(new_run)
                at = at[(np.arange(len(at)) - run[np.cumsum(new_run) - 1]) % 2 == 0]
                own = np.searchsorted(ends, at, side="right")
                at, own = self._calm(sym, made, rank, at, own, ends)
                size = size - np.bincount(own, minlength=len(size))
            else:  # one place in each segment
                size = size - 1
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, made, rank = sym[keep], made[keep], rank[keep]
            at = at - np.arange(len(at))
            ends = np.cumsum(size)
            touched = np.zeros(len(sym) + 1, bool)
            touched[at] = touched[at - 1] = True
            touched[-1] = False
            last = ends - 1
            made[last], rank[last] = -1, NONE
            touched[last] = False
            again = np.flatnonzero(touched)
            new = self.pairs(sym[again], sym[again + 1])
            made[again], rank[again] = new, self.ranks[new]
        return (np.concatenate(out_sym), np.concatenate(out_seg)) if out_sym else (sym, np.zeros(0, np.int64))

    def _calm(self, sym: np.ndarray, made: np.ndarray, rank: np.ndarray, at: np.ndarray, own: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of each segment up to the first whose merge makes a pair that ranks as well or better."""
        piece = made[at]
        ask = np.flatnonzero(self.wary[piece])
        ask = ask[ask < len(at) - 1]
        ask = ask[own[ask] == own[ask + 1]]  # a segment's last place has nothing after it
        if not len(ask):
            return at, own
        k, x = at[ask], piece[ask]
        start = np.where(own[ask] > 0, ends[own[ask] - 1], 0)
        before = np.maximum(k - 1, 0)
        merged = (ask > 0) & (at[np.maximum(ask - 1, 0)] == k - 2)  # the neighbour is the place just merged
        left = np.where(merged, piece[np.maximum(ask - 1, 0)], sym[before])
        worst = np.where(k > start, self.ranks[self.pairs(left, x)], NONE)
        worst = np.minimum(worst, self.ranks[self.pairs(x, sym[k + 2])])  # there is one: another place follows
        stop = ask[worst <= rank[k]]
        if not len(stop):
            return at, own
        until = np.full(len(ends), len(at))
        np.minimum.at(until, own[stop], stop)
        keep = np.arange(len(at)) <= until[own]
        return at[keep], own[keep]

    def _spell(self, sym: np.ndarray, own: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece, as the pieces of their bytes."""
        code = np.where(plain, 0, sym - self.size)
        count = np.where(plain, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        at = np.repeat(np.arange(len(sym)), count)
        k = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)  # the byte's place
        tail = count[at] - 1 - k  # bytes after it
        bits = code[at] >> (6 * tail)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[count[at]]
        byte = np.where(k == 0, lead | bits, 0x80 | (bits & 0x3F))
        return np.where(plain[at], sym[at], self.bytes[byte & 0xFF]), own[at]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, without the space in front; bytes that are no UTF-8 as U+FFFD, one each."""
        out, held, first = [], bytearray(), True
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
                first = False
            shown = self.shown[i]
            if first and i not in self.control and i != self.unk:
                shown, first = shown.removeprefix(b" "), False
            elif i == self.unk:
                first = False
            out.append(shown.decode())
        return "".join(out) + (_utf8(bytes(held)) if held else "")


def _utf8(raw: bytes) -> str:
    out = []
    while raw:
        try:
            return "".join(out) + raw.decode()
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


class Encoder:
    """Texts to ids, with words of earlier texts kept: word -> (its ids as bytes, the text of the ids as bytes)."""

    def __init__(self, path: str) -> None:
        self.model = model(path)
        self.kept = Memo(items=WORDS_KEPT)

    def learn(self, words: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """Entries of words, those not kept by rounds over all of them; short ones are kept."""
        have, new, kept, older = {}, [], self.kept, self.kept.older
        for w in words:
            entry = kept.get(w) or older.get(w)
            if entry is None:
                new.append(w)
            else:
                have[w] = entry
        if new:
            ids, ends = self.model.flat(new)
            raw, flat, shown = ids.astype("<u4").tobytes(), ids.tolist(), self.model.shown.__getitem__
            a = 0
            for w, b in zip(new, ends.tolist(), strict=True):
                have[w] = kept.put(w, (raw[4 * a : 4 * b], b"".join(map(shown, flat[a:b]))))
                a = b
        return have

    def encode(self, text: str) -> list[int]:
        """All ids of a text, with begin and end."""
        return [self.model.bos, *self.model.flat(self.model.cut(text))[0].tolist(), self.model.eos]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them) of texts."""
        m, out = self.model, []
        begin, end = (np.array([i], "<u4").tobytes() for i in (m.bos, m.eos))
        held: list[list[str]] = []
        fresh: set[str] = set()
        chars = 0

        def flush() -> None:
            entry = self.learn(fresh).__getitem__
            for words in held:
                ids, raw = zip(*map(entry, words), strict=True) if words else ((), ())
                coded = begin + b"".join(ids) + end
                # the ids of a word hold whole characters, so words decode apart; the space in front goes
                out.append((len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(b"".join(raw).removeprefix(b" ")).hexdigest()))
            held.clear()
            fresh.clear()

        for text in texts:
            words = m.cut(text)
            held.append(words)
            fresh.update(words)
            chars += len(text)
            if chars >= ROUND_SYMBOLS:
                flush()
                chars = 0
        flush()
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""

    def run(batches):
        with no_gc():
            enc = _encoder(path)
            for b in batches:
                got = enc.digests([t or "" for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>, with begin and end) of every whole text."""

    def run(batches):
        enc = Encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>")


def texts(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text of ids(doc_id, ids); null ids give a null text."""

    def run(batches):
        m = model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else m.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
