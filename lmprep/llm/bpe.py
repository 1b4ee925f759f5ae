"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

The vocabulary's merges are compiled once on the driver. To encode a word, an Aho-Corasick automaton gives the tokens
that match at each position. The encoder takes the longest one, keeps it if the pair with the token before is compatible
(merging the two joined strings would give these two tokens again), else tries the next shorter one, and steps
back where none is left. A position that was left behind is never tried again, so the work is linear in the word.
All adjacent pairs compatible means the exact merge result.

A pair is compatible if no merge reaches across its border. A part of the left token that ends at the border lives until
the merge that consumes it, likewise a part of the right token that starts there; a merge of two such parts happens when
its rank comes first (on equal ranks the leftmost merge goes first). The verdicts fill a table as pairs are met.

A word's last symbol carries the end-of-word mark, so it is a symbol of its own here: its character moved by ``_END``.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from lmprep.llm.arrow import struct, text_list

_END = 0xE000
_NEVER = 1 << 30
#: Entries of a task's word memory and pair table; when full they start anew, which changes no result.
MEMORY = 400_000
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPLIT = re.compile(f"[{_SPACES}]+")


def byte_symbols() -> str:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in plain else chr(next(rest)) for b in range(256))


def _marked(token: str, suffix: str) -> str:
    if suffix and token.endswith(suffix):
        token = token[: -len(suffix)]
        return token[:-1] + chr(_END + ord(token[-1]))
    return token


#: A character of each kind that the split pattern knows; none takes part in a contraction.
_KINDS = {"letter": "a", "number": "0", "other": "!"}


@lru_cache
def _shapes(pattern: str) -> dict[int, str]:
    """Code points that Python or ``regex`` files under another kind than the library does, each with a stand-in of the
    library's kind: they hold different versions of Unicode.

    The library is asked about every code point between ``!`` and ``a``: it joins the one, the other, or neither.
    """
    split = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True)
    letter, number, space = map(regex.compile, (r"\p{L}", r"\p{N}", f"[{_SPACES}]"))
    found = {}
    for first in range(0x80, 0x110000, 0x800):
        block = [c for c in range(first, min(first + 0x800, 0x110000)) if not 0xD800 <= c < 0xE000]
        edges = {edge for _, spans in split.pre_tokenize_str("".join(f"!{chr(c)}a " for c in block)) for edge in spans}
        for i, c in enumerate(block):
            char, cut_before, cut_after = chr(c), 4 * i + 1 in edges, 4 * i + 2 in edges
            kind = "number" if cut_before and cut_after else "letter" if cut_before else "other"
            known = "letter" if letter.match(char) else "number" if number.match(char) else "other"
            if not space.match(char) and (kind != known or char.isalpha() != (kind == "letter")):
                found[c] = _KINDS[kind]
    return found


@lru_cache
def _unsettled(pattern: str) -> re.Pattern:
    """Finds a character whose composition, lower case or kind may depend on the version of Unicode.

    Normal forms are stable for what version 3.2 holds; lower case and kind are compared with the library's. A capital
    sigma is among the characters found, as Python lower-cases it by its place in a word.
    """
    lower, old, moved = normalizers.Lowercase().normalize_str, unicodedata.ucd_3_2_0, _shapes(pattern)
    named = [c for c in map(chr, range(0x20000)) if old.category(c) not in ("Cn", "Cs") and c != "Σ"]
    settled = [c for c in named if lower(c) == c.lower() and moved.keys().isdisjoint(map(ord, c + c.lower()))]
    return re.compile(f"[^{re.escape(''.join(settled))}]")


def compile_bpe(path: str) -> dict:
    """Plain tables of a tokenizer file with an end-of-word suffix, a split pattern and byte-level symbols."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    suffix = model["end_of_word_suffix"] or ""
    ids = {_marked(t, suffix): i for t, i in model["vocab"].items()}
    names = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
    parts, ranks = {}, {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        # inside a merge only the right part can hold the end of the word
        left, right = ids[a], ids[_marked(b, suffix)]
        ranks[left, right] = rank
        parts.setdefault(ids[_marked(a + b, suffix)], (left, right, rank))
    pairs = _Pairs(parts, ranks)
    # a token whose own parts would merge otherwise never results from merging
    usable = {s: t for s, t in ids.items() if t not in parts or pairs.free(*parts[t])}
    lengths, shorter = [0] * (max(ids.values()) + 1), [-1] * (max(ids.values()) + 1)
    for s, token in usable.items():
        lengths[token] = len(s)
        shorter[token] = next((usable[s[:cut]] for cut in range(len(s) - 1, 0, -1) if s[:cut] in usable), -1)
    return {
        "names": [names[i] for i in range(max(names) + 1)],
        "parts": parts,
        "ranks": ranks,
        "lengths": lengths,
        "shorter": shorter,
        "matcher": _matcher(usable),
        "special": {a["content"]: a["id"] for a in spec["added_tokens"]},
        "pattern": pattern.replace(r"\s", _SPACES),
        "shapes": _shapes(pattern),
        "unsettled": _unsettled(pattern),
    }


def _matcher(tokens: dict[str, int]) -> tuple[dict[int, int], list[int], list[int]]:
    """Aho-Corasick over the reversed tokens: (moves by state and symbol, fallback, longest token of each state).

    Read from the right, a word's state at a position tells the longest token that starts there.
    """
    moves: dict[int, int] = {}
    fall, best, depth_first = [0], [-1], []
    for s, token in tokens.items():
        state = 0
        for c in reversed(s):
            key = state << 16 | ord(c)
            after = moves.get(key)
            if after is None:
                after = moves[key] = len(fall)
                fall.append(0)
                best.append(-1)
                depth_first.append((state, ord(c), after))
            state = after
        best[state] = token
    below: dict[int, list[tuple[int, int]]] = {}
    for state, c, after in depth_first:
        below.setdefault(state, []).append((c, after))
    level = [after for _, after in below.get(0, [])]
    while level:
        following = []
        for state in level:
            if best[state] < 0:
                best[state] = best[fall[state]]
            for c, after in below.get(state, ()):
                back = fall[state]
                while back and (back << 16 | c) not in moves:
                    back = fall[back]
                fall[after] = moves.get(back << 16 | c, 0)
                following.append(after)
        level = following
    return moves, fall, best


_FALL, _BEST = -1, -2  # keys beside the symbols of a node


def _nodes(matcher: tuple[dict[int, int], list[int], list[int]]) -> dict:
    """The automaton as linked dicts; at the root every unknown symbol leads nowhere else."""
    moves, fall, best = matcher
    nodes: list[dict] = [{} for _ in fall]
    for key, after in moves.items():
        nodes[key >> 16][key & 0xFFFF] = nodes[after]
    for node, back, token in zip(nodes, fall, best):
        node[_FALL], node[_BEST] = nodes[back], token
    return nodes[0]


class _Pairs:
    """Which tokens may stand side by side."""

    def __init__(self, parts: dict, ranks: dict):
        self.parts, self.ranks = parts, ranks
        self.spines: tuple[dict, dict] = ({}, {})

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token's parts at one border, latest first, each with the rank of the merge that consumes it."""
        found = self.spines[side].get(token)
        if found is None:
            found, until, part = [(token, _NEVER)], _NEVER, token
            while part in self.parts:
                until, part = self.parts[part][2], self.parts[part][side]
                found.append((part, until))
            found.append((-1, -1))
            self.spines[side][token] = found
        return found

    def free(self, left: int, right: int, before: int = _NEVER) -> bool:
        """No merge with a rank below ``before`` crosses the border. Runs back in time through the parts that
        live together."""
        ending, starting = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            a, a_until = ending[i]
            b, b_until = starting[j]
            rank = self.ranks.get((a, b))
            if rank is not None and rank < a_until and rank <= b_until and rank < before:
                return False
            a_made, b_made = ending[i + 1][1], starting[j + 1][1]
            if a_made < 0 and b_made < 0:
                return True
            if a_made > b_made:
                i += 1
            else:  # of two merges with one rank the left one came first, so the right one is undone first
                j += 1


class Encoder:
    def __init__(self, tables: dict):
        self.pairs = _Pairs(tables["parts"], tables["ranks"])
        self.special = tables["special"]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words_in, self.shapes = regex.compile(tables["pattern"]), tables["shapes"]
        # the library's own tables of Unicode; Python's are of another version
        self.unsettled = tables["unsettled"].search
        self.normalized = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.symbols = dict(enumerate(byte_symbols()))
        self.lengths, self.shorter = tables["lengths"], tables["shorter"]
        self.root = _nodes(tables["matcher"])
        self.table: dict[int, bool] = {}
        self.words = _Memory(self._word_bytes)
        self.ready, self.chunks = _Memory(self._ready_bytes), _Memory(self._chunk_bytes)

    def _resolve(self, node: dict, c: int) -> dict:
        """The move that falls back, kept in the node so that it is looked for once."""
        back = node
        while (after := back.get(c)) is None:
            back = back[_FALL]
        node[c] = after
        return after

    def word_ids(self, word: str) -> list[int]:
        """Tokens of one word in symbols."""
        lengths, shorter, table = self.lengths, self.shorter, self.table
        node, longest = self.root, []
        for c in array("H", word.encode("utf-16-le"))[::-1]:
            node = node.get(c) or self._resolve(node, c)
            longest.append(node[_BEST])
        longest.append(-1)
        size = last = len(word)
        last -= 1  # the longest token at a position stands at last - position
        closed = None
        out: list[int] = []
        before, at, token = -1, 0, longest[last]
        while True:
            end = at + lengths[token]
            if closed is None or end not in closed:
                key = before << 32 | token
                fits = before < 0 or table.get(key)
                if fits is None:
                    fits = table[key] = self.pairs.free(before, token)
                if fits:
                    out.append(token)
                    if end == size:
                        return out
                    before, at, token = token, end, longest[last - end]
                    continue
            while shorter[token] < 0:
                closed = closed or set()
                closed.add(at)
                token = out.pop()
                before = out[-1] if out else -1
                at -= lengths[token]
            token = shorter[token]

    def _word_bytes(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbols)
        return array("I", self.word_ids(word[:-1] + chr(_END + ord(word[-1])))).tobytes()

    def _ready_bytes(self, chunk: str) -> bytes:
        """Ids, four bytes each, of a piece without white space that is composed and lower-cased."""
        if chunk.isalpha():
            return self.words[chunk]
        return b"".join([self.words[w] for w in self.words_in.findall(chunk)])

    def _chunk_bytes(self, chunk: str) -> bytes:
        """The same of a piece as it stands in the text: neither composition nor lower-casing reaches across white space."""
        chunk = self.normalized(chunk)
        shape = chunk.translate(self.shapes)
        return b"".join([self.words[chunk[m.start() : m.end()]] for m in self.words_in.finditer(shape)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special tokens written out in the text become their ids."""
        if not text:
            return b""
        parts = self.split.split(text) if "<" in text else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(np.uint32(self.special[part]).tobytes())
            elif part:
                for full in (self.ready, self.chunks, self.words, self.table):
                    if len(full) > MEMORY:
                        full.clear()
                if part.isascii():
                    out += map(self.ready.__getitem__, _SPLIT.split(part.lower()))
                elif not self.unsettled(part):
                    out += map(self.ready.__getitem__, _SPLIT.split(unicodedata.normalize("NFC", part).lower()))
                else:
                    out += map(self.chunks.__getitem__, _SPLIT.split(part))
        return b"".join(out)


class _Memory(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) < 64:
            self[key] = value
        return value


class Decoder:
    """Token texts in one buffer, each with the space that joins it to the next; offsets give their places."""

    def __init__(self, names: list[str]):
        joined = [n.encode() + b" " for n in names]
        self.data = np.frombuffer(b"".join(joined), np.uint8)
        self.offsets = np.r_[0, np.cumsum([len(x) for x in joined])]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) == 0:
            return b""
        starts = self.offsets[ids]
        sizes = self.offsets[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        return self.data[place].tobytes()[:-1]


_FACTS = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def encode(docs: DataFrame, path: str, text: str = "text") -> Column:
    """Array of token ids of each text; a null text has none."""
    shipped = docs.sparkSession.sparkContext.broadcast(compile_bpe(path))

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shipped.value)
        for texts in batches:
            yield pa.array([np.frombuffer(encoder.encode(t), "<u4").astype(np.int32) for t in text_list(texts)], pa.list_(pa.int32()))

    return run(F.col(f"`{text}`"))


def decode(docs: DataFrame, path: str, ids: str = "ids") -> Column:
    """Text of each array of token ids: token texts joined by spaces. A null array is an empty text."""
    names = docs.sparkSession.sparkContext.broadcast(compile_bpe(path)["names"])

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(names.value)
        for rows in batches:
            yield pa.array([decoder.decode(np.array(r or [], np.int64)).decode() for r in rows.to_pylist()], pa.string())

    return run(F.col(f"`{ids}`"))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> Column:
    """A struct column: number of tokens, SHA-256 of the ids and of the decoded text. A null text is empty."""
    shipped = docs.sparkSession.sparkContext.broadcast(compile_bpe(path))

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = shipped.value
        encoder, decoder = Encoder(tables), Decoder(tables["names"])
        for texts in batches:
            rows = []
            for t in text_list(texts):
                ids = encoder.encode(t)
                decoded = decoder.decode(np.frombuffer(ids, "<u4"))
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield struct(dict(zip(_FACTS, zip(*rows) if rows else [[]] * 3)), _FACTS)

    return run(F.col(f"`{text}`"))
