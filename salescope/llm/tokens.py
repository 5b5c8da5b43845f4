"""Token ids of whole texts, with the public tokenizers library, piece by piece.

The tokenizer normalises character by character, turns white space into blanks
and cuts at it, so the ids of a text are those of its blank-separated pieces one
after the other. Pieces repeat, so each worker keeps the ids of those it has
seen. Two more rules of this tokenizer save work: it lower-cases, and a full
stop or comma after a letter starts a token of its own. Both are used only for
characters below U+0100, where lower-casing is one to one. The ids are the ones
the library gives; ``tests/llm`` compares with whole texts encoded at once.
"""

from __future__ import annotations

import os
import sys
import types

import numpy as np
from pyspark.sql import SparkSession

#: A worker forgets its pieces when it holds so many; longer pieces are not kept.
MAX_PIECES = 1_000_000
MAX_PIECE_CHARS = 48


class PieceIds(dict):
    """Ids, as little-endian unsigned 32-bit bytes, by piece of text without blanks."""

    def __init__(self, tokenizer_json: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_str(tokenizer_json)

    def of(self, text: str | None) -> bytes:
        """Ids of ``text``; null counts as empty. Only blanks and line ends part the pieces."""
        pieces = (text or "").replace("\n", " ").split(" ")
        if len(self) > MAX_PIECES:
            self.clear()
        missing = {p for p in pieces if p not in self}
        if missing:
            self._learn(missing)
        ids = b"".join(map(self.__getitem__, pieces))
        for p in missing:
            if len(p) > MAX_PIECE_CHARS:
                self.pop(p, None)
        return ids

    def _learn(self, pieces: set[str]) -> None:
        cores = {p: _core(p) for p in pieces}
        needed = {c for c, _ in cores.values()} | {end for _, end in cores.values() if end}
        needed = [c for c in needed if c not in self]
        for c, e in zip(needed, self._tokenizer.encode_batch_fast(needed, add_special_tokens=False), strict=True):
            self[c] = np.array(e.ids, "<u4").tobytes()
        for p, (core, end) in cores.items():
            if p not in self:
                self[p] = self[core] + (self[end] if end else b"")
        for c in needed:
            if len(c) > MAX_PIECE_CHARS and c not in pieces:
                del self[c]


def _core(piece: str) -> tuple[str, str]:
    """A piece with the same ids and one that follows it, or "" if none follows."""
    if not piece or "<" in piece or max(piece) >= "Ā":  # "<" may start a special token
        return piece, ""
    low = piece.lower()
    if len(low) > 1 and low[-1] in ".," and low[-2].isalpha():
        return low[:-1], low[-1]
    return low, ""


def worker_pieces(tokenizer_json: str) -> PieceIds:
    """The pieces of this worker process, kept from task to task."""
    home = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    known = home.__dict__.setdefault("pieces", {})
    if tokenizer_json not in known:
        known.clear()
        known[tokenizer_json] = PieceIds(tokenizer_json)
    return known[tokenizer_json]


def broadcast_tokenizer(spark: SparkSession, path: str):
    """The tokenizer's file, read where the driver runs: one to two megabytes."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())
