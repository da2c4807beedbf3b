"""Hashed character n-grams of words, and a table of what a model needs of each distinct word."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable

import numpy as np

_STEP = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[str], low: int, high: int, buckets: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n from `low` to `high`: (words that have n-grams, where each one's n-grams start, the n-grams' buckets).

    A word is taken with < before and > after it.
    """
    points = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    found = []
    for n in range(low, high + 1):
        total = len(points) - n + 1
        if total <= 0:
            continue
        value = np.full(total, n, np.uint64)
        for k in range(n):
            value = value * _STEP + points[k : k + total]
        inside = owner[:total] == owner[n - 1 :]
        value = (value[inside] * _MIX) >> np.uint64(64 - buckets.bit_length() + 1)
        having = np.flatnonzero(size >= n)
        starts = np.r_[0, np.cumsum(size[having] - n + 1)[:-1]] if len(having) else having
        if len(having):
            found.append((having, starts, value.astype(np.int64)))
    return found


def gram_sums(words: list[str], table: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of `table` over each word's n-grams, their number). The table has a power of two rows."""
    out, count = np.zeros((len(words), table.shape[1]), np.float32), np.zeros(len(words), np.int64)
    for having, starts, bucket in grams(words, low, high, len(table)):
        out[having] += np.add.reduceat(table[bucket], starts, axis=0)
        count[having] += np.diff(np.r_[starts, len(bucket)])
    return out, count


class WordTable:
    """Rows of numbers for distinct words, worked out once for each and forgotten when there are more than `limit`."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], limit: int) -> None:
        self._compute, self._limit = compute, limit
        self._clear()

    def _clear(self) -> None:
        new: list[str] = []

        class Places(dict):
            def __missing__(self, word: str) -> int:
                self[word] = place = len(self)
                new.append(word)
                return place

        self._places, self._new, self._used = Places(), new, 0
        self.rows = np.zeros((0, 0), np.float32)

    def places(self, texts: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(place in `rows` of every word of all texts, number of words of each text)."""
        if len(self._places) > self._limit:
            self._clear()
        found, counts, get = array("i"), [], self._places.__getitem__
        for words in texts:
            found.extend(map(get, words))
            counts.append(len(words))
        if self._new:
            rows = self._compute(self._new)
            need = self._used + len(rows)
            if need > len(self.rows):
                grown = np.zeros((max(need, 2 * self._used), rows.shape[1]), np.float32)
                if self._used:
                    grown[: self._used] = self.rows[: self._used]
                self.rows = grown
            self.rows[self._used : need] = rows
            self._used = need
            self._new.clear()
        return np.array(found, np.int64), np.array(counts, np.int64)


def chunks(texts: list[str | None], chars: int) -> Iterable[tuple[int, list[str]]]:
    """(first row, texts) in runs of about `chars` characters; null as empty."""
    run, size, first = [], 0, 0
    for k, text in enumerate(texts):
        run.append(text or "")
        size += len(run[-1])
        if size >= chars:
            yield first, run
            run, size, first = [], 0, k + 1
    if run:
        yield first, run


def add_rows(out: np.ndarray, place: np.ndarray, rows: np.ndarray) -> None:
    """out[place] += rows, with repeated places, column by column."""
    for k in range(out.shape[1]):
        out[:, k] += np.bincount(place, rows[:, k], len(out)).astype(out.dtype)
