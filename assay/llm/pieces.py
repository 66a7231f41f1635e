"""A unigram piece vocabulary, read from a SentencePiece model file.

Only normal pieces take part in the lattice; characters without a piece of their own fall back to their UTF-8 bytes. No
piece has a space mark after another character, nor a line break, nor a Latin letter before a stop or comma, so the lattice of a text falls apart at those places into
words that may be handled one by one: `words` cuts there. (This is checked as the file is read.)
"""

from __future__ import annotations

import os
import re
from functools import cache

import ahocorasick
import numpy as np
import sentencepiece

MARK = "▁"
#: Where the public tokenizer files lie; the file is a parameter of all operators.
DEFAULT = os.environ.get("ASSAY_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: As in SentencePiece, an unknown character scores so much less than the least piece.
UNKNOWN = 10.0
#: No piece has a letter before one of these, so a word of Latin letters ends there.
_WORD = re.compile(r" *+[A-Za-zÀ-ÖØ-öø-ɏ]++(?=[.,;:!?])| *[^ \n]+| +|\n")
_ACROSS = re.compile(r"[^ ] |\n|[A-Za-zÀ-ÖØ-öø-ɏ][.,;:!?]")
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words(text: str) -> list[str]:
    """The words of a text with its leading space, in order and whole; a space stands for the space mark."""
    return _WORD.findall(f" {text}")


class Vocabulary:
    def __init__(self, file: str) -> None:
        p = sentencepiece.SentencePieceProcessor(model_file=file)
        n = p.get_piece_size()
        self.pieces = [p.id_to_piece(i) for i in range(n)]
        self.bytes = [-1] * 256
        self.normal: dict[str, tuple[int, float]] = {}
        for i, piece in enumerate(self.pieces):
            if p.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (p.is_unknown(i) or p.is_control(i) or p.is_unused(i)):
                self.normal[piece.replace(MARK, " ")] = (i, p.get_score(i))
        if -1 in self.bytes:
            raise ValueError(f"{file} has no byte fallback")
        if bad := [x for x in self.normal if _ACROSS.search(x)]:
            raise ValueError(f"pieces reach across words: {bad[:3]}")
        self.unknown = min(s for _, s in self.normal.values()) - UNKNOWN
        self.single = {x for x in self.normal if len(x) == 1}
        self.automaton = ahocorasick.Automaton()
        for x, (i, s) in self.normal.items():
            self.automaton.add_word(x, (len(x), s, i))
        self.automaton.make_automaton()
        self._table()

    def _table(self) -> None:
        """Hashes of the pieces, for matches()."""
        self.longest = max(map(len, self.normal))
        hashes = np.array([self._hash(np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32))[-1] for x in self.normal], dtype=np.uint64)
        ids = np.array([i for i, _ in self.normal.values()], dtype=np.int64)
        order = np.argsort(hashes)
        self._hashes, self._ids = hashes[order], ids[order]
        self._cells = np.zeros(1 << 20, dtype=bool)
        self._cells[(self._hashes >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _hash(codes: np.ndarray) -> list[np.uint64]:
        """Of the first 1, 2 .. code points, as matches() has them."""
        h, out = np.zeros(1, dtype=np.uint64), []
        for k, c in enumerate(codes):
            h = h * _PRIME + np.uint64(c)
            out.append(((h ^ np.uint64(k)) * _MIX)[0])
        return out

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the last code point, lengths and ids of all pieces in a text, by end, the longest first."""
        c = np.where(codes == 0, 0x110000, codes).astype(np.uint64)  # zeros would hash like nothing before a piece; no piece holds one
        h, found = np.zeros(len(c), dtype=np.uint64), []
        for k in range(min(self.longest, len(c))):
            h = h[: len(c) - k] * _PRIME + c[k:]
            x = (h ^ np.uint64(k)) * _MIX
            at = np.flatnonzero(self._cells[x >> np.uint64(44)])
            place = np.minimum(np.searchsorted(self._hashes, x[at]), len(self._hashes) - 1)
            same = self._hashes[place] == x[at]
            at = at[same]
            found.append((at + k, np.full(len(at), k + 1), self._ids[place[same]]))
        end, size, piece = (np.concatenate(x) for x in zip(*reversed(found), strict=True))
        order = np.argsort(end, kind="stable")
        return end[order], size[order], piece[order]


@cache
def vocabulary(file: str) -> Vocabulary:
    return Vocabulary(file)
