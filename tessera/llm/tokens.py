"""Token ids by the tokenizers library, with a bounded memo of space-delimited pieces.

In the vocabularies used here a single space between two texts is always a boundary of pre-tokens, so
the ids of a text are the ids of its pieces in a row, each piece with the space before it. Words repeat,
so most pieces are found in the memo, which lives as long as the Python worker. Texts in which a space stands
inside or at the end of a longer run of white space, or that hold the string of an added token, go to the library whole.

A piece that isn't in the memo is a word, a word with punctuation behind it (two pre-tokens) or anything else. A
word of Latin letters goes straight to the library's BPE model, without the other steps of the tokenizer that
leave it as it is; whether that holds for a vocabulary is tried on PROBES when it is loaded.
"""

from __future__ import annotations

import re
import string

import numpy as np

from tessera.llm.shared import begin_task, keep_memo

#: Pieces that the memo of one Python worker holds before it starts anew (about 120 MB), and places that tell which
#: pieces came before: most words of a large corpus come once, and only a piece that comes again is kept.
MEMO_PIECES, SEEN = 600_000, 1 << 22
RUNS = re.compile(r"\s \s|\s \Z|  ")
PAIR = re.compile(r"\s\s")
#: One pre-token when they stand behind a letter; the apostrophe can begin a contraction and is left out.
PUNCTUATION = string.punctuation.replace("'", "")
PROBES = ["word", " word", " Straße", "Été", " x", " ÀÉÎ", " supercalifragilistic"]


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder(dict):
    """Maps a piece to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.added = [t.content for t in added]
        self.pieces = not any(t.normalized or t.lstrip or t.rstrip for t in added)
        self.memo_pieces = memo_pieces
        self.seen = bytearray(SEEN)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.prepare = next((f for f in (str, lambda w: w.strip(" ").lower()) if all(self.word(p, f) == self.whole(p) for p in PROBES)), None)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, piece: str, prepare) -> bytes:
        said = prepare(piece)
        mapped = said.replace(" ", "Ġ") if said.isascii() else said.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > 64:  # not a word that comes again
            return self.whole(piece)
        ids = None
        if self.prepare:
            stem = piece.rstrip(PUNCTUATION)
            plain = stem[stem[:1] == " " :]
            if plain.isalpha() and (plain.isascii() or max(plain) < "\u0100"):
                ids = self.word(piece, self.prepare) if len(stem) == len(piece) else self[stem] + self[piece[len(stem) :]]
        if ids is None:
            ids = self.whole(piece)
        place = hash(piece) & (SEEN - 1)
        if not self.seen[place]:
            self.seen[place] = 1
            return ids
        if len(self) >= self.memo_pieces:
            self.clear()
            self[""] = b""
            self.seen = bytearray(SEEN)
        self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text (null: empty) as bytes, those that the library gives: strings of added tokens in a text are these tokens."""
        if not text:
            return b""
        if "\0" in text or not self.pieces or any(a in text for a in self.added):
            return self.whole(text)
        if not PAIR.search(text):  # a line break by itself is a pre-token
            text = text.replace("\n", "\0\n\0")
        elif RUNS.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").split("\0")))


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, memo_pieces: int = MEMO_PIECES) -> PieceEncoder:
    """The encoder of this Python worker for a vocabulary; the memo of another vocabulary or size is dropped."""
    begin_task("tokens")
    if (path, memo_pieces) not in _encoders:
        _encoders.clear()
        _encoders[path, memo_pieces] = PieceEncoder(path, memo_pieces)
        keep_memo("tokens", _encoders.clear)
    return _encoders[path, memo_pieces]
