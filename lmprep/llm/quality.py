"""Quality rules on repetition, by a suffix array over the words of each text.

The words of a batch of texts form one sequence in which no two texts share a word number, so a suffix never matches beyond its
text. All positions are sorted by their next three words; only those whose three words occur again are sorted
further, by doubling. Rank arrays of every doubling give the longest common prefix of neighbours in the array. A
suffix's longest repeated prefix is the larger of its two neighbours' values, and the spans of all maximal
repeated substrings have the same union as these. The verdict limits the share of words inside repeats and the length of the
longest one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lmprep.llm.arrow import byte_list, chunks, struct, text_buffer
from lmprep.llm.words import mix, word_hashes, word_spans

_WINDOW = 3
_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
_SPACE = b"\t\n\x0b\x0c\r "


@dataclass(frozen=True)
class Limits:
    """``min_repeat``: words that a repeat has at least to count; ``max_covered``: share of words inside such repeats;
    ``max_repeat``: words in the longest one, as a share of the text but never less than ``free_repeat`` words."""

    min_words: int = 50
    max_window_share: float = 0.5
    min_repeat: int = 8
    max_covered: float = 0.4
    max_repeat: float = 0.25
    free_repeat: int = 30


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def _group_starts(order: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each place of a sorted order the place where its run of equal keys starts."""
    sorted_keys = keys[order]
    new = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
    return np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def longest_repeats(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next three words occur again, in suffix order, and each one's longest repeated prefix.

    ``words`` are dense word numbers.
    """
    n = len(words)
    if n < _WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # number 0 stands for "behind the end", so shorter windows differ from all others and sort first
    w = np.zeros(n + _WINDOW, np.int64)
    w[:n] = words + 1
    bits = int(w.max()).bit_length()
    if bits * _WINDOW <= 63:
        key = (w[:n] << (2 * bits)) | (w[1 : n + 1] << bits) | w[2 : n + 2]
    else:
        key = (_dense((w[:n] << bits) | w[1 : n + 1]) << bits) | w[2 : n + 2]
    order = np.argsort(key)
    starts = _group_starts(order, key)
    rank = np.empty(n, np.int64)
    rank[order] = starts
    alone = np.bincount(starts, minlength=n)
    active = np.sort(order[alone[starts] > 1])
    repeated = active
    levels = [rank.copy()]
    length = _WINDOW
    while len(active):
        ahead = active + length
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = (rank[active] << 32) | second
        order = np.argsort(key)
        inner = _group_starts(order, key)
        # a group keeps its first place; its parts take the places behind
        old = rank[active][order]
        base = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], np.arange(len(order)), 0))
        rank[active[order]] = old + inner - base
        counts = np.bincount(inner, minlength=len(order))
        active = np.sort(active[order][counts[inner] > 1])
        length *= 2
        levels.append(rank.copy())
    suffixes = repeated[np.argsort(rank[repeated])]
    if not len(suffixes):
        return suffixes, suffixes
    left, right = suffixes[:-1], suffixes[1:]
    common = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a < n) & (b < n)
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        common += np.where(inside & (levels[k][a] == levels[k][b]), _WINDOW << k, 0)
    for _ in range(_WINDOW - 1):  # at most two words more
        a, b = w[np.minimum(left + common, n)], w[np.minimum(right + common, n)]
        going = (a == b) & (a > 0)
        common += going
        left, right = np.where(going, left, n), np.where(going, right, n)  # a suffix that stopped stays stopped
    return suffixes, np.maximum(np.r_[0, common], np.r_[common, 0])


def _covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:n]) > 0


_FACTS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "covered_words": pa.int64(),
    "longest_repeat": pa.int64(), "n_repeats": pa.int64(),
}
_TYPES = {pa.int64(): "long", pa.bool_(): "boolean"}


def measure(texts: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    """All facts of some texts, a null one being empty."""
    data, offsets = text_buffer(texts)
    starts, ends, counts = word_spans(data, offsets)
    n_words = np.diff(counts)
    owner = np.repeat(np.arange(len(n_words), dtype=np.uint64), n_words)
    words = _dense(mix(word_hashes(data, starts, ends) ^ mix(owner, 7)))
    suffixes, repeats = longest_repeats(words)
    total = len(words)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(flags)][counts])

    window = _covered(total, suffixes, np.full(len(suffixes), _WINDOW))
    long = repeats >= limits.min_repeat
    covered = per_text(_covered(total, suffixes[long], repeats[long]))
    text_of = np.searchsorted(counts, suffixes, side="right") - 1
    longest = np.zeros(len(n_words), np.int64)
    np.maximum.at(longest, text_of[long], repeats[long])
    # an interval of the array is a run of neighbours that share min_repeat words; it is counted at its first one
    opens = long & ~np.r_[False, long[:-1] & (text_of[1:] == text_of[:-1])] if len(long) else long
    n_repeats = np.bincount(text_of[opens], minlength=len(n_words))

    rows = [_plain_counts(t) for t in byte_list(texts)]
    word_chars, n_symbols, n_dup_lines = np.array(rows, np.int64).reshape(-1, 3).T
    n_repeat_words = per_text(window)
    base_failed = (n_words < limits.min_words) | (n_repeat_words > limits.max_window_share * n_words)
    repetitive = (covered > limits.max_covered * n_words) | (
        longest > np.maximum(limits.free_repeat, limits.max_repeat * n_words)
    )
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words, "base_failed": base_failed, "kept": ~(base_failed | repetitive),
        "covered_words": covered, "longest_repeat": longest, "n_repeats": n_repeats,
    }


def _plain_counts(text: bytes) -> tuple[int, int, int]:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(text.translate(None, _CONTINUED + _SPACE)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
    )


def quality(text: Column, limits: Limits = Limits()) -> Column:
    """A struct column of word and repetition counts and the verdict ``kept``.

    A null or empty text has no words and fails. The whole text counts, however long: texts are taken in groups of
    a few megabytes, a longer one alone. Each row is judged by its own text, so ids, ties and repeated rows play no part.
    """
    fields = ", ".join(f"{n}: {_TYPES[t]}" for n, t in _FACTS.items())

    @F.arrow_udf(f"struct<{fields}>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [measure(part, limits) for part in chunks(texts)]
            columns = {n: np.concatenate([p[n] for p in parts]) if parts else [] for n in _FACTS}
            yield struct(columns, _FACTS)

    return judge(text)


def keep_good(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows whose text is kept, columns unchanged."""
    return docs.where(quality(F.col(f"`{text}`"), limits)["kept"])
