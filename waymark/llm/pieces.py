"""Cutting texts where a byte-level tokenizer always cuts, so that results can be kept by chunk.

A chunk starts at white space that follows other text, so no token spans two chunks. Results by chunk are kept in a
dict of at most twice ``MEMO_ITEMS`` chunks, so memory is bounded whatever the corpus.
"""

from __future__ import annotations

import gc
import re
from contextlib import contextmanager
from functools import lru_cache

import regex

MEMO_ITEMS = 400_000
MEMO_CHARS = 64  # longer chunks aren't kept
END_OF_TEXT = "<|endoftext|>"
_CHUNK = regex.compile(r"\s*\S+|\s+")
_INDENT = re.compile(r"\n\s")


def chunks(text: str) -> list[str]:
    """The chunks of a text; joined they are the text.

    A cut before a space, and around a line break, is always one of the tokenizer's own, unless white space follows
    the space's or break's own place; such texts are cut by a slower pattern.
    """
    if "  " in text or " \n" in text or "\0" in text or _INDENT.search(text):
        return _CHUNK.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


class Memo(dict):
    """chunk -> make(chunk). Holds at most two generations of ``items``; what the older one still serves moves up."""

    def __init__(self, make=None, items: int = MEMO_ITEMS) -> None:
        super().__init__()
        self.make, self.items, self.older = make, items, {}

    def put(self, chunk: str, value):
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= self.items:
                self.older = dict(self)
                self.clear()
            self[chunk] = value
        return value

    def rotate(self, drop=()) -> None:
        """After an update from outside: leave out some chunks, and keep to the bound."""
        for c in list(drop):
            self.pop(c, None)
        if len(self) > self.items:
            self.older = dict(self)
            self.clear()

    def __missing__(self, chunk: str):
        value = self.older.get(chunk)
        return self.put(chunk, self.make(chunk) if value is None else value)


@contextmanager
def no_gc():
    """Without garbage collection: large dicts without cycles are kept, and walking them costs more than the work."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


@lru_cache(maxsize=4)
def json_tokenizer(path: str):
    """A tokenizers-library tokenizer, without truncation and padding, on one thread."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok
