"""Sets of word shingles of texts, as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from relata.llm.arrow import SPACED, Words, find_words, mix, text_blocks

SHINGLE = 5
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other, and how many each has.

    A text of fewer words than a shingle has its whole word sequence as the only one; without words it has none.
    """
    n = len(w.hash)
    run = np.zeros(n, np.uint64)
    for k in range(size):  # of words k places on
        run[: n - k] += w.hash[k:] * _STEP ** np.uint64(k)
    hashed = mix(run)
    counts = w.counts
    parts, sizes = [], np.zeros(len(counts), np.int64)
    for row in np.flatnonzero(counts):
        a, m = int(w.first[row]), int(counts[row])
        if m >= size:
            own = np.sort(hashed[a : a + m - size + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own
        else:
            short = w.hash[a : a + m] * _STEP ** np.arange(m, dtype=np.uint64)
            own = mix(np.array([short.sum(dtype=np.uint64) + np.uint64(m)], np.uint64))
        parts.append(own)
        sizes[row] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), sizes


def sets_of(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, sizes) of blocks of a text column."""
    for lo, _, data, offsets in text_blocks(column):
        yield lo, *shingle_sets(find_words(data, offsets, SPACED), size)


def set_list(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The set of each row."""
    return [own for _, hashes, sizes in sets_of(column, size) for own in np.split(hashes, np.cumsum(sizes)[:-1])]


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets that aren't both empty."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
