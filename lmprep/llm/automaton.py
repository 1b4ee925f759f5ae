"""Regular expressions over bytes compiled to minimal deterministic automata.

Syntax: literals, ``\\xHH`` and escaped characters, ``[classes]`` with ranges, groups, ``(?i:...)`` for either case of
ASCII letters, ``|``, ``?``, ``*``, ``+`` and ``{m,}``. Subset construction runs over classes of bytes that no
rule tells apart, then partition refinement merges equal states.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ANY = frozenset(range(256))


class _Parser:
    def __init__(self, pattern: str):
        self.text, self.at, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, expected: str | None = None) -> str:
        c = self.peek()
        if not c or (expected and c != expected):
            raise ValueError(f"{expected or 'a character'} expected at {self.at} in {self.text!r}")
        self.at += 1
        return c

    def alternatives(self) -> tuple:
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self) -> tuple:
        node = self.atom()
        while self.peek() in ("?", "*", "+", "{"):
            mark = self.take()
            if mark == "{":
                digits = ""
                while self.peek() != ",":
                    digits += self.take()
                self.take(",")
                self.take("}")
                node = ("seq", [node] * int(digits) + [("star", node)])
            elif mark == "?":
                node = ("or", [node, ("seq", [])])
            else:
                node = ("star", node) if mark == "*" else ("seq", [node, ("star", node)])
        return node

    def atom(self) -> tuple:
        c = self.take()
        if c == "(":
            before = self.fold
            if self.text.startswith("?i:", self.at):
                self.at, self.fold = self.at + 3, True
            node = self.alternatives()
            self.take(")")
            self.fold = before
            return node
        if c == "[":
            return self.bytes_of(self.char_class())
        return self.bytes_of({self.escaped() if c == "\\" else ord(c)})

    def escaped(self) -> int:
        c = self.take()
        return int(self.take() + self.take(), 16) if c == "x" else ord(c)

    def char_class(self) -> set[int]:
        found: set[int] = set()
        while self.peek() != "]":
            c = self.take()
            low = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                c = self.take()
                found.update(range(low, (self.escaped() if c == "\\" else ord(c)) + 1))
            else:
                found.add(low)
        self.take("]")
        return found

    def bytes_of(self, values: set[int]) -> tuple:
        if self.fold:
            values = {ord(x) for v in values for x in (chr(v).lower(), chr(v).upper())}
        return ("set", frozenset(values))


def parse(pattern: str) -> tuple:
    parser = _Parser(pattern)
    node = parser.alternatives()
    if parser.peek():
        raise ValueError(f"unbalanced ) in {pattern!r}")
    return node


def mirrored(node: tuple) -> tuple:
    kind, body = node
    if kind == "seq":
        return (kind, [mirrored(x) for x in reversed(body)])
    if kind == "or":
        return (kind, [mirrored(x) for x in body])
    return (kind, mirrored(body)) if kind == "star" else node


class _Nfa:
    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []
        self.marks: dict[int, int] = {}

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, node: tuple, start: int) -> int:
        """Wire ``node`` behind ``start``; returns where it ends."""
        kind, body = node
        if kind == "set":
            end = self.state()
            self.moves[start].append((body, end))
        elif kind == "seq":
            end = start
            for part in body:
                end = self.add(part, end)
        elif kind == "or":
            end = self.state()
            for part in body:
                first = self.state()
                self.free[start].append(first)
                self.free[self.add(part, first)].append(end)
        else:
            end = self.state()
            self.free[start].append(end)
            self.free[self.add(body, end)].append(end)
        return end

    def closed(self, states: set[int]) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """State 0 is the start. ``table[state, byte_class[b]]`` is the next state, ``marks[state]`` a bit for each rule that
    ends here; ``dead[state]`` tells that no rule can end any more."""

    table: np.ndarray
    byte_class: np.ndarray
    marks: np.ndarray
    dead: np.ndarray

    def rows(self) -> list[list]:
        """One list for each state: 256 references to next states' lists, then the state's mark, then ``dead``."""
        rows: list[list] = [[] for _ in self.marks]
        for row, moves, mark, dead in zip(rows, self.table[:, self.byte_class].tolist(), self.marks.tolist(), self.dead.tolist()):
            row.extend(rows[m] for m in moves)
            row += [mark, dead]
        return rows


def compile_rules(nodes: list[tuple], anywhere: bool) -> Automaton:
    """All rules in one automaton; ``anywhere`` lets a match begin at any byte."""
    nfa = _Nfa()
    start = nfa.state()
    if anywhere:
        nfa.moves[start].append((_ANY, start))
    for bit, node in enumerate(nodes):
        first = nfa.state()
        nfa.free[start].append(first)
        nfa.marks[nfa.add(node, first)] = 1 << bit

    sets = {s for moves in nfa.moves for s, _ in moves}
    kinds: dict[tuple, int] = {}
    ordered = sorted(sets, key=sorted)
    byte_class = np.array([kinds.setdefault(tuple(b in s for s in ordered), len(kinds)) for b in range(256)])
    sample = [int(np.flatnonzero(byte_class == k)[0]) for k in range(len(kinds))]

    first = nfa.closed({start})
    numbers, todo, table = {first: 0}, [first], []
    while todo:
        states, row = todo.pop(0), []
        for b in sample:
            after = nfa.closed({t for s in states for on, t in nfa.moves[s] if b in on})
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            row.append(numbers[after])
        table.append(row)
    marks = np.array([sum(nfa.marks.get(s, 0) for s in states) for states in numbers])
    return _minimal(np.array(table), byte_class, marks)


def _minimal(table: np.ndarray, byte_class: np.ndarray, marks: np.ndarray) -> Automaton:
    block = np.unique(marks, return_inverse=True)[1]
    while True:
        finer = np.unique(np.c_[block, block[table]], axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    first = np.zeros(block.max() + 1, int)
    first[block[::-1]] = np.arange(len(block))[::-1]
    order = np.argsort(first)  # the start keeps number 0
    number = np.empty_like(order)
    number[order] = np.arange(len(order))
    table, marks = number[block[table[first[order]]]], marks[first[order]]
    alive = marks > 0
    while True:
        more = alive | alive[table].any(axis=1)
        if (more == alive).all():
            return Automaton(table.astype(np.int32), byte_class.astype(np.int16), marks, ~alive)
        alive = more
