"""Packing by vector bin packing with the dot-product heuristic.

A piece demands (tokens, one segment, loss-bearing tokens); a sequence offers ``limits``. Which tokens bear loss comes from
the data: ``pack`` takes a column of character spans (a token bears loss if it begins in one), and ``pack_conversations``
gives those of the answers. ``documents`` have no prompts, so there every token bears loss. An arriving piece goes to
the open sequence with room in all three dimensions whose remaining room has the largest dot product with the demand,
both scaled by the limits. Texts over the token limit are cut into full pieces and a rest; a sequence is closed when a
limit is met. When ``OPEN`` sequences are
open, the fullest is closed: it's filled up to the last token by a cut of the next piece. What is left at a partition's
end is dealt out in lengths that are powers of two, which need no padding.

Each partition of the input packs its own rows, streaming, with ``OPEN`` sequences in memory: no shuffle, and a lost
task is run again with the same result (sequence ids hold the partition's number). Any number of rows is fine.

Defined results: a null or empty text is one piece that holds the end id alone; null spans mean that every token bears
loss, an empty list that none does but the end id; rows with a null ``doc_id`` are packed too; repeated rows are packed
as often as they occur; very long texts are encoded whole; further columns, whatever their names, are ignored; an empty
table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_lexicon import vocabulary
from .common import map_texts
from .pieces import json_tokenizer

MAX_TOKENS = 2048
MAX_SEGMENTS = 8
OPEN = 64
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass
class Piece:
    doc: int | None
    start: int
    length: int
    loss: int
    whole: int
    crc: object  # crc(from, to) of the document's ids
    bearing: np.ndarray | None = None  # loss-bearing ids before each place; None: all bear loss


@dataclass
class Sequence:
    tokens: int = 0
    loss: int = 0
    pieces: list[tuple[Piece, int]] = field(default_factory=list)


def _loss(piece: Piece, a: int, b: int) -> int:
    return b - a if piece.bearing is None else int(piece.bearing[b] - piece.bearing[a])


class Packer:
    """The open sequences of one task. ``add`` and ``finish`` yield closed sequences."""

    def __init__(self, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, loss_of=None) -> None:
        self.limits = np.array([max_tokens, max_segments, max_loss or max_tokens], float)
        self.max_tokens, self.max_segments, self.max_loss = max_tokens, max_segments, max_loss or max_tokens
        self.loss_of = loss_of or _loss  # loss-bearing tokens of a piece's part
        self.open: list[Sequence] = []
        self.room = np.zeros((OPEN, 3))

    def _cut(self, p: Piece, n: int) -> tuple[Piece, Piece | None]:
        """The first n tokens of a piece, and the rest."""
        if n >= p.length:
            return p, None
        a = self.loss_of(p, p.start, p.start + n)
        return replace(p, length=n, loss=a), replace(p, start=p.start + n, length=p.length - n, loss=p.loss - a)

    def _put(self, i: int, p: Piece) -> None:
        s = self.open[i]
        s.pieces.append((p, s.tokens))
        s.tokens += p.length
        s.loss += p.loss
        self.room[i] -= (p.length, 1, p.loss)

    def _close(self, i: int) -> Sequence:
        s = self.open.pop(i)
        self.room[i:-1] = self.room[i + 1 :]
        return s

    def add(self, p: Piece | None) -> Iterator[Sequence]:
        while p is not None:
            piece, rest = self._cut(p, self.max_tokens)
            if piece.loss > self.max_loss:  # a part that keeps the loss limit too
                n = piece.length
                while n > 1 and self.loss_of(piece, piece.start, piece.start + n) > self.max_loss:
                    n = max(1, n - (self.loss_of(piece, piece.start, piece.start + n) - self.max_loss))
                piece, rest = self._cut(p, n)
            if piece.length == self.max_tokens:
                yield Sequence(piece.length, piece.loss, [(piece, 0)])
                p = rest
                continue
            demand = np.array([piece.length, 1, piece.loss], float)
            room = self.room[: len(self.open)]
            fits = (room >= demand).all(axis=1)
            if fits.any():
                score = np.where(fits, (room / self.limits) @ (demand / self.limits), -1.0)
                # most room in the demanded dimensions among those that an exact fit doesn't serve
                exact = np.flatnonzero(fits & (room[:, 0] == demand[0]))
                i = int(exact[0]) if len(exact) else int(np.argmax(score))
                self._put(i, piece)
                if self.open[i].tokens == self.max_tokens:
                    yield self._close(i)
                elif self.room[i, 1] < 1 or self.room[i, 2] < 1:
                    yield from self._finish(self._close(i))
                p = rest
            elif len(self.open) < OPEN:
                self.open.append(Sequence())
                self.room[len(self.open) - 1] = self.limits
                self._put(len(self.open) - 1, piece)
                p = rest
            else:
                able = (room[:, 1] >= 1) & (room[:, 2] >= 1)
                if able.any():  # fill the fullest up by a cut of this piece
                    i = int(np.argmin(np.where(able, room[:, 0], np.inf)))
                    n = int(min(room[i, 0], room[i, 2], p.length))
                    part, p = self._cut(p, n)
                    self._put(i, part)
                else:
                    i = int(np.argmin(room[:, 0]))
                yield from self._finish(self._close(i))

    def _finish(self, s: Sequence) -> Iterator[Sequence]:
        """A sequence that won't be filled: in lengths of powers of two."""
        if s.tokens == self.max_tokens:
            yield s
            return
        left, todo = s.tokens, list(reversed(s.pieces))
        while left:
            size, out = 1 << (left.bit_length() - 1), Sequence()
            while out.tokens < size:
                p, _ = todo.pop()
                part, rest = self._cut(p, size - out.tokens)
                out.pieces.append((part, out.tokens))
                out.tokens += part.length
                out.loss += part.loss
                if rest is not None:
                    todo.append((rest, 0))
            left -= size
            yield out

    def finish(self) -> Iterator[Sequence]:
        """What is still open: joined to full sequences, the last one in powers of two."""
        todo = [p for s in self.open for p, _ in s.pieces]
        self.open = []
        s = Sequence()
        for piece in todo:
            p: Piece | None = piece
            while p is not None:
                n = min(self.max_tokens - s.tokens, self.max_loss - s.loss)
                if n < 1 or len(s.pieces) >= self.max_segments:
                    yield from self._finish(s)
                    s = Sequence()
                    continue
                part, p = self._cut(p, n)
                s.pieces.append((part, s.tokens))
                s.tokens += part.length
                s.loss += part.loss
        if s.tokens:
            yield from self._finish(s)


class TokenEncoder:
    """text -> little-endian 32-bit ids, as the tokenizers library encodes with this file.

    A byte-level vocabulary's ranks are read from the file itself and merged by compiled code (tests hold this against
    the library); any other file is left to the library.
    """

    def __init__(self, path: str) -> None:
        try:
            self.ranks, self.names, self.special, pattern = vocabulary(path)
        except ValueError:
            self.names, self.tok = None, json_tokenizer(path)
            return
        import tiktoken

        self.enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens=self.special)

    def __call__(self, text: str) -> np.ndarray:
        if self.names is None:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")
        if any(t in text for t in self.special):
            return np.array(self.enc.encode(text, allowed_special="all"), "<u4")
        return np.array(self.enc.encode_ordinary(text), "<u4")

    def begins(self, text: str, ids: np.ndarray) -> np.ndarray:
        """The byte of the text at which each id begins."""
        if self.names is None:
            code_points = [a for a, _ in self.tok.encode(text, add_special_tokens=False).offsets]
            return byte_places(text)[np.array(code_points, np.int64)]
        size = np.fromiter((len(self.names[i]) for i in ids.tolist()), np.int64, len(ids))
        return np.cumsum(size) - size


def byte_places(text: str) -> np.ndarray:
    """The byte of each code point, and the text's length, in UTF-8."""
    size = np.fromiter(map(len, (c.encode("utf-8", "surrogatepass") for c in text)), np.int64, len(text)) if not text.isascii() else np.ones(len(text), np.int64)
    return np.r_[0, np.cumsum(size)]


def bearing(encode: TokenEncoder, text: str, ids: np.ndarray, spans: list[dict]) -> np.ndarray:
    """Loss-bearing ids before each place, the end id (which bears loss) included."""
    at, place = encode.begins(text, ids), byte_places(text)
    on = np.zeros(int(place[-1]) + 1, np.int64)
    for span in spans:
        a, b = (int(place[min(max(0, span[k]), len(text))]) for k in ("start", "end"))
        if a < b:
            on[a] += 1
            on[b] -= 1
    return np.r_[0, np.cumsum(np.r_[np.cumsum(on)[at] > 0, True])].astype(np.int64)


def pack(docs: DataFrame, tokenizer: str, *, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, end_id: int = END_ID, loss: str | None = None) -> DataFrame:
    """One row for each piece of each document; see SCHEMA. ``loss`` names a column of spans, array<struct<start, end>>."""

    def run(batches):
        encode, packer = TokenEncoder(tokenizer), Packer(max_tokens, max_segments, max_loss)
        base, made, rows = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, 0, []

        def flush():
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"])

        def emit(sequences):
            nonlocal made
            for s in sequences:
                for p, offset in s.pieces:
                    rows.append((p.doc, p.start, p.length, p.crc(p.start, p.start + p.length), p.whole, base + made, offset, p.loss))
                made += 1

        for b in batches:
            for doc, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                text, spans = text.as_py() or "", spans.as_py()
                own = encode(text)
                marks = None if spans is None else bearing(encode, text, own, spans)
                ids = np.append(own, np.uint32(end_id)).astype("<u4")
                crc = lambda x, y, ids=ids: zlib.crc32(ids[x:y].tobytes())
                emit(packer.add(Piece(doc, 0, len(ids), len(ids) if marks is None else int(marks[-1]), len(ids), crc, marks)))
                if len(rows) >= 20_000:
                    yield flush()
        emit(packer.finish())
        yield flush()

    spans = F.col(loss) if loss else F.lit(None)
    return map_texts(docs.select(F.col("doc_id").cast("long"), "text", spans.cast("array<struct<start:long,end:long>>").alias("loss")), run, SCHEMA)


def pack_conversations(conversations: DataFrame, tokenizer: str, *, answers: tuple[str, ...] = ("assistant",), **limits) -> DataFrame:
    """Pack whole conversations (conv_id, turn, role, text), turns joined by line breaks; only answers bear loss.

    doc_id is the conv_id. Turns of equal number stand in the order of role and text; a null text is an empty turn. One
    conversation is one document and lies in one row.
    """
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    convs = conversations.groupBy("conv_id").agg(turns.alias("turns"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(acc, t):
        end = acc["at"] + F.length(t["text"])
        own = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["role"].isin(*answers), F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    docs = convs.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("text"), F.aggregate("turns", start, step)["spans"].alias("loss"))
    return pack(docs, tokenizer, loss="loss", **limits)


def vocabulary_file(name: str) -> str:
    """The place of a public vocabulary file; the same on driver and executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Packing with the production parameters."""
    return pack(docs, vocabulary_file("byte_bpe_50k.json"))
