"""Secrets in texts, found by one automaton for all rules in one pass over the bytes.

The combined automaton reads each byte once and reports where some rule may end. Only there does a rule's
own mirrored automaton walk back to the leftmost start, and its forward automaton on to the longest end. Matches
of a kind do not overlap: the next search starts behind the last match, kept or not. A rule's ``tail`` is the least
number of bytes from the shortest to the longest end of a match, which is how many value bytes it has at least, less one.

Rules are ASCII, so offsets in bytes and in code points differ only by the characters before; spans are in code
points, end exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lmprep.llm.arrow import byte_list, struct
from lmprep.llm.automaton import Automaton, compile_rules, mirrored, parse


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    tail: int = 0


#: Kinds whose results are fixed; ``hex`` matches of 24 characters at least, the others by their tail.
BASE_RULES = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=\-]+", 5),
    Rule("access", r"AKIA[A-Z0-9]+", 15),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds that this scan adds: web tokens, code-host tokens and private keys, to the line that ends them where there is one.
ADDED_RULES = (
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", 15),
    Rule("host_token", r"(ghp|gho|ghs|ghu|ghr|glpat)[_\-][A-Za-z0-9_]+", 19),
    Rule(
        "private_key",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(([A-Za-z0-9+/=:,\x20\x09\x0A\x0D]|-[A-Za-z0-9])*-----END [A-Z ]*PRIVATE KEY-----)?",
    ),
)
RULES = BASE_RULES + ADDED_RULES


@dataclass(frozen=True)
class Compiled:
    kinds: list[str]
    tails: list[int]
    scan: Automaton
    forward: list[Automaton]
    back: list[Automaton]


def compile_scan(rules: Sequence[Rule]) -> Compiled:
    nodes = [parse(r.pattern) for r in rules]
    return Compiled(
        [r.kind for r in rules],
        [r.tail for r in rules],
        compile_rules(nodes, anywhere=True),
        [compile_rules([n], anywhere=False) for n in nodes],
        [compile_rules([mirrored(n)], anywhere=False) for n in nodes],
    )


class Scanner:
    """A compiled scan unfolded for the byte loop; made once for each task."""

    def __init__(self, compiled: Compiled):
        self.kinds, self.tails = compiled.kinds, compiled.tails
        self.scan = compiled.scan.rows()[0]
        self.forward = [a.rows()[0] for a in compiled.forward]
        self.back = [a.rows()[0] for a in compiled.back]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule number) in bytes, by start, then rule.

        Behind a match the search for the rule starts afresh, so that no end is met whose start lies before: each byte is read a fixed
        number of times for each rule that matches at all.
        """
        ends = self._first_ends(data)
        found = []
        for rule, end in ends.items():
            bit, behind, tail = 1 << rule, 0, self.tails[rule]
            while end is not None:
                start = self._start(rule, data, end, behind)
                first, behind = self._reach(rule, data, start)
                if behind - first >= tail:
                    found.append((start, behind, rule))
                end = self._next_end(data, behind, bit)
        return sorted(found, key=lambda x: (x[0], x[2]))

    def _first_ends(self, data: bytes) -> dict[int, int]:
        """Where each rule that matches may end first: the one pass of the combined automaton."""
        row, seen, out = self.scan, 0, {}
        for i, b in enumerate(data):
            row = row[b]
            if row[256] & ~seen:
                fresh, seen = row[256] & ~seen, seen | row[256]
                out |= {rule: i + 1 for rule in range(len(self.tails)) if fresh >> rule & 1}
        return out

    def _next_end(self, data: bytes, behind: int, bit: int) -> int | None:
        row = self.scan
        for i in range(behind, len(data)):
            row = row[data[i]]
            if row[256] & bit:
                return i + 1
        return None

    def _start(self, rule: int, data: bytes, end: int, least: int) -> int | None:
        row, start = self.back[rule], None
        for i in range(end - 1, least - 1, -1):
            row = row[data[i]]
            if row[256]:
                start = i
            elif row[257]:
                break
        return start

    def _reach(self, rule: int, data: bytes, start: int) -> tuple[int, int]:
        row, first, last = self.forward[rule], 0, 0
        for i in range(start, len(data)):
            row = row[data[i]]
            if row[256]:
                first, last = first or i + 1, i + 1
            elif row[257]:
                break
        return first, last

    def named(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points."""
        found = self.spans(data)
        if not found or data.isascii():
            return [(self.kinds[r], s, e) for s, e, r in found]
        cuts = sorted({x for s, e, _ in found for x in (s, e)})
        points, total, before = {}, 0, 0
        for cut in cuts:
            total += len(data[before:cut].decode("utf-8", "replace"))
            points[cut], before = total, cut
        return [(self.kinds[r], points[s], points[e]) for s, e, r in found]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_FOUND = {
    "n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(),
    "spans": pa.string(), "n_added": pa.int64(),
}


def find_secrets(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> Column:
    """A struct column for ``docs``: counts of the base kinds, SHA-256 of the base spans, all spans, count of added ones.

    Spans are ``kind:start:end`` by start, then kind in the order of ``rules``. A null text is empty and has none.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(_plain(rules))
    base = [r.kind for r in BASE_RULES]

    @F.arrow_udf("struct<n_assign: long, n_access: long, n_hex: long, base_sha256: string, spans: string, n_added: long>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(_compiled(shipped.value))
        for texts in batches:
            rows = []
            for data in byte_list(texts):
                spans = scanner.named(data)
                kept = [x for x in spans if x[0] in base]
                digest = hashlib.sha256(_joined(kept).encode()).hexdigest()
                counts = [sum(x[0] == k for x in kept) for k in base]
                rows.append((*counts, digest, _joined(spans), len(spans) - len(kept)))
            yield struct(dict(zip(_FOUND, zip(*rows) if rows else [[]] * len(_FOUND))), _FOUND)

    return scan(F.col(f"`{text}`"))


def redact(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> Column:
    """The text with every secret replaced by ``[kind]``; spans that overlap are replaced together. Null stays null."""
    shipped = docs.sparkSession.sparkContext.broadcast(_plain(rules))

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(_compiled(shipped.value))
        for texts in batches:
            rows = [_replaced(scanner, data) for data in byte_list(texts)]
            yield pa.array([r if ok else None for r, ok in zip(rows, texts.is_valid().to_pylist())], pa.string())

    return clean(F.col(f"`{text}`"))


def _replaced(scanner: Scanner, data: bytes) -> str:
    out, done = [], 0
    for start, end, rule in scanner.spans(data):
        if start >= done:
            out += [data[done:start], f"[{scanner.kinds[rule]}]".encode()]
        done = max(done, end)
    return b"".join([*out, data[done:]]).decode("utf-8", "replace")


def _plain(rules: Sequence[Rule]) -> tuple:
    """The compiled rules as plain arrays, which any Python worker can read."""
    c = compile_scan(rules)
    flat = lambda a: (a.table, a.byte_class, a.marks, a.dead)
    return c.kinds, c.tails, flat(c.scan), [flat(a) for a in c.forward], [flat(a) for a in c.back]


def _compiled(plain: tuple) -> Compiled:
    kinds, tails, scan, forward, back = plain
    return Compiled(kinds, tails, Automaton(*scan), [Automaton(*a) for a in forward], [Automaton(*a) for a in back])
