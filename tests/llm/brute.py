"""Plain-Python versions of the operators, and awkward texts."""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}

#: Null, empty, blank, ties, repeats and non-ASCII.
TEXTS = [
    None, "", " \n\t", "a", "a b c d", "a b c d", "A b C d", "é ü 中文 😀 password = 'sécret' token: abcdef12", "x\u2028y\x85z",
    "one two three four five six seven eight nine ten", "one two three four five six seven eight nine TEN",
    "word " * 200, "<|endoftext|> and <|startoftext|> don't", "\x00\x1c control \x7f",
]


def secrets(text: str) -> list[tuple[str, int, int]]:
    assign = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    found = [("assign", *m.span()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def repeats(text: str, least: int) -> tuple[int, int, int]:
    """Words in repeated 3-word windows, words in repeats of ``least`` words, longest such repeat."""
    words = WORD.findall(text)
    n = len(words)
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    seen, covered, longest = set(), set(), 0
    for i in range(n):
        if i < n - 2 and windows[tuple(words[i : i + 3])] > 1:
            seen.update((i, i + 1, i + 2))
        best = 0
        for j in range(n):
            size = 0
            while i != j and i + size < n and j + size < n and words[i + size] == words[j + size]:
                size += 1
            best = max(best, size)
        if best >= least:
            longest = max(longest, best)
            covered.update(range(i, i + best))
    return len(seen), len(covered), longest


def shingles(text: str | None) -> frozenset:
    words = WORD.findall((text or "").translate(UPPER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(1, len(words)))))


def components(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in texts.items()}
    at = {i: i for i in sets}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for h in holders.values() for a in h for b in h if a < b)
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            one, two = sorted((top(a), top(b)))
            at[two] = one
    return {i: top(i) for i in sets}


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """Rooms left by best-fit decreasing."""
    rooms: list[int] = []
    for size in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, size)
        bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - size)
    return rooms
