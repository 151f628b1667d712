"""Token ids of the byte-level BPE vocabulary, with a bounded cache of space-delimited pieces.

The pattern that cuts a text into words always cuts between a visible character and the white space that
follows it, and a single space joins the word behind it. So a text in which every space stands between visible
characters is the concatenation of its pieces between spaces, each but the first with its space, and every
piece can be encoded by itself. Other texts are cut in front of every run of blanks, which holds for the same
reason. A line feed between visible characters is a word of its own and begins a piece. The tests compare the ids with those of the tokenizers library.

The added tokens of the JSON file beside the vocabulary are no text: each is its own id, wherever it stands, and what
lies between is encoded by itself.
"""

from __future__ import annotations

import base64
import json
import os
import re
import sys
from array import array

#: Pieces kept per worker; rarer pieces are encoded anew each time.
CACHE_PIECES = 300_000
#: White space of Unicode besides the space.
OTHER_BLANKS = "\t\n\x0b\x0c\r\x85\xa0                　"
RUN = re.compile(f"[ {OTHER_BLANKS}]+")
MARKS = frozenset(".,!?;:")


def encoding(path: str):
    """The vocabulary as a tiktoken encoding in which no string is special."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of the JSON file of the same vocabulary, if there is one."""
    path = f"{os.path.splitext(path)[0]}.json"
    if not os.path.exists(path):
        return {}
    with open(path, "rb") as f:
        found = json.load(f).get("added_tokens") or []
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in found):
        raise ValueError("added tokens that take in blanks or need a word's bounds are not handled")
    return {t["content"]: t["id"] for t in found}


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class PieceIds(dict):
    """piece -> ids of a space and the piece; of the piece alone where it begins with a line feed."""

    def __init__(self, path: str, limit: int = CACHE_PIECES):
        super().__init__()
        encoder = encoding(path)
        self.encode, self.word, self.limit = encoder.encode_ordinary, encoder._encode_single_piece, limit
        self.marks = {m: packed(self.encode(m)) for m in MARKS}
        self.line = packed(self.encode("\n"))
        self.added = {t: packed([i]) for t, i in added_tokens(path).items()}
        self.cut = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})")

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():  # one word of the pattern, and so the space and a word
            ids = packed(self.word(f" {piece}".encode()))
        elif piece[-1] in MARKS and piece[:-1].isalpha():  # the mark is a word of its own
            ids = self[piece[:-1]] + self.marks[piece[-1]]
        elif piece[0] == "\n":
            ids = self.line + packed(self.word(piece[1:].encode())) if piece[1:].isalpha() else packed(self.encode(piece))
        else:
            ids = packed(self.encode(f" {piece}"))
        if len(self) < self.limit and len(piece) < 64:
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """All ids of a text with its added tokens, as little-endian 32-bit integers."""
        if not any(t in text for t in self.added):
            return self.text_ids(text)
        return b"".join(self.added[part] if k % 2 else self.text_ids(part) for k, part in enumerate(self.cut.split(text)))

    def text_ids(self, text: str) -> bytes:
        """All ids of a text in which no string is special, as little-endian 32-bit integers."""
        pieces = text.replace("\n", " \n").split(" ")
        if "" in pieces or "\n" in pieces or any(
                b in text and (f" {b}" in text or f"{b} " in text or f"{b}\n" in text or f"\n{b}" in text
                               or text[0] == b or text[-1] == b) for b in OTHER_BLANKS):
            return self._any_blanks(text)
        rest = iter(pieces)
        return packed(self.encode(next(rest))) + b"".join(map(self.__getitem__, rest))

    def _any_blanks(self, text: str) -> bytes:
        out, at = [], 0
        for m in RUN.finditer(text):
            if m.start() > at:
                out.append(self._run(text[at:m.start()]))
            at = m.start()
        if at < len(text):
            out.append(self._run(text[at:]))
        return b"".join(out)

    def _run(self, piece: str) -> bytes:
        if piece[0] == " " and len(piece) > 1 and piece[1] != " " and piece[1] not in OTHER_BLANKS:
            return self[piece[1:]]
        return packed(self.encode(piece))
