"""Token ids of a byte-level vocabulary, by white-space pieces that are remembered within a task.

The vocabulary's split rule never joins what stands on two sides of white space, except one space before a
word, so a text's ids are the ids of its pieces in a row.
"""

from __future__ import annotations

import base64
import json
import re
from array import array

import tiktoken

from lmprep.llm.bpe import byte_symbols

#: Entries of a task's piece memory; when full it starts anew.
MEMORY = 400_000
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = re.compile(f" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]")
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_vocabulary(path: str) -> dict:
    """Ids by token bytes and special tokens, from a tokenizer file with byte-level symbols."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {s: b for b, s in enumerate(byte_symbols())}
    special = {a["content"]: a["id"] for a in spec["added_tokens"]}
    ids = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    rank = {b: i for i, b in enumerate(byte_symbols())}
    # merging goes by rank: single bytes first, then the merges in their order
    order = {bytes([byte_of[c]]): rank[c] for c in byte_of}
    for n, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        order.setdefault(bytes(byte_of[c] for c in a + b), 256 + n)
    return {"order": order, "ids": {order[t]: i for t, i in ids.items() if t in order}, "special": special}


class ByteTokenizer(dict):
    """Piece to ids, four bytes each; missing pieces are encoded and remembered."""

    def __init__(self, vocabulary: dict):
        super().__init__()
        self.encoding = tiktoken.Encoding(
            "pieces", pat_str=_WORDS, mergeable_ranks=vocabulary["order"], special_tokens={}
        )
        self.ids, self.special = vocabulary["ids"], vocabulary["special"]
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def __missing__(self, piece: str) -> bytes:
        value = array("I", [self.ids[t] for t in self.encoding.encode_ordinary(piece)]).tobytes()
        if len(piece) < 64:
            self[piece] = value
        return value

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special tokens written out in the text become their ids."""
        if len(self) > MEMORY:
            self.clear()
        out = []
        for i, part in enumerate(self.split.split(text)):
            if i % 2:
                out.append(array("I", [self.special[part]]).tobytes())
            else:
                out += map(self.__getitem__, _PIECES.findall(part))
        return b"".join(out)
