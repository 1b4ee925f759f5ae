"""The best few entries of many slots, fed by parts of a score matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LOWEST = np.iinfo(np.int64).min
#: Rows of a part; parts grow up to it, so that the first few raise the bar for the rest.
PART = 512


def growing(count: int) -> Iterator[slice]:
    start, size = 0, 32
    while start < count:
        yield slice(start, min(count, start + size))
        start, size = start + size, min(2 * size, PART)


class Best:
    """The best ``k`` (score, id) of each slot: higher scores first, then lower ids."""

    def __init__(self, slots: int, k: int, kind: type = float):
        self.scores = np.full((slots, k), LOWEST if kind is np.int64 else -np.inf, kind)
        self.ids = np.full((slots, k), np.iinfo(np.int64).max, np.int64)

    def bar(self) -> np.ndarray:
        return self.scores[:, -1]

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Entries in any order, as many per slot as wanted."""
        if not len(slots):
            return
        touched, at = np.unique(slots, return_inverse=True)
        k = self.scores.shape[1]
        at = np.r_[at, np.repeat(np.arange(len(touched)), k)]
        scores = np.r_[scores, self.scores[touched].ravel()]
        ids = np.r_[ids, self.ids[touched].ravel()]
        order = np.lexsort((ids, ~scores if scores.dtype == np.int64 else -scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < k
        self.scores[touched[at[kept]], place[kept]] = scores[kept]
        self.ids[touched[at[kept]], place[kept]] = ids[kept]
