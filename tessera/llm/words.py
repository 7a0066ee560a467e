"""Words, word digests and window digests that several operators share.

A word is a maximal run of characters outside U+0020 and U+0009 to U+000D.  In UTF-8
that is what ``bytes.split()`` gives, and ``bytes.lower()`` lowers A to Z alone.
Digests of windows are built by doubling with a non-linear mix, so a window's digest
depends on its words and their order only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

WORD = r"[^\x20\x09-\x0D]+"
#: Entries that a task's word cache may hold; beyond that it starts anew.
CACHE_ENTRIES = 400_000


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class WordDigests(dict):
    """Word (bytes or text) to unsigned 64-bit digest, computed at first use."""

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        raw = word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass")
        value = self[word] = xxhash.xxh64_intdigest(raw, 42)
        return value

    def of(self, words: list[bytes] | list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def encoded(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x632BE59BD9B4E019), np.uint64(0xBF58476D1CE4E5B9)
_S29, _S32 = np.uint64(29), np.uint64(32)


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A digest of two digests, not symmetric and not linear."""
    x = (left * _A) ^ (right + _B)
    x ^= x >> _S29
    x *= _C
    x ^= x >> _S32
    return x


def window_digests(digests: np.ndarray, size: int) -> np.ndarray:
    """Digests of all windows of ``size`` consecutive words (none if there are fewer)."""
    n = len(digests) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, level = None, 0, 1, digests
    while True:
        if size & power:
            part = level[done : done + n]
            out = part.copy() if out is None else mix(out, part)
            done += power
        if done == size:
            return out
        level = mix(level[:-power], level[power:])
        power *= 2


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values the place of its leftmost smallest value."""
    n = len(values) - width + 1
    best, place, reach = values, np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = best[: len(best) - step], best[step:]
        take = b < a
        best = np.where(take, b, a)
        place = np.where(take, place[step:], place[: len(place) - step])
        reach += step
    return place[:n]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def batches(frames: Iterator[pd.DataFrame], characters: int = 4_000_000, column: str = "text") -> Iterator[pd.DataFrame]:
    """Join small frames and cut large ones so that a piece holds about ``characters`` of text, a single row at least."""
    held: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        if not len(frame):
            continue
        own = int(frame[column].str.len().fillna(0).sum())
        if held and size + own > characters:
            yield from _cut(held, characters, column)
            held, size = [], 0
        held.append(frame)
        size += own
    if held:
        yield from _cut(held, characters, column)


def _cut(held: list[pd.DataFrame], characters: int, column: str) -> Iterator[pd.DataFrame]:
    frame = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
    sizes = frame[column].str.len().fillna(0).to_numpy(np.int64).cumsum()
    start = 0
    while start < len(frame):
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + characters, "right")))
        yield frame.iloc[start:end]
        start = end
