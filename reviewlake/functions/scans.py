"""Counts and word places of many texts at once, as Arrow column functions.

A regular expression costs tens of nanoseconds a character and a string for every word it parts. Here the characters of
some texts lie in one numpy array, a table gives the class of each, and counts and places follow from steps over the
whole array. Spark sends the texts in batches; a batch is looked at in slices of bounded size.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

SLICE = 1 << 18  # characters looked at together, more if one text is longer
# Classes of a character, which add up.
SPACE, CONTROL = 1, 2
# Classes of the search for words, below those of the letters: what patterns have to clean, other letters.
PATTERN, OTHER = 1, 2
# Texts with one of these, or with the beginning of a URL, are left to the patterns: e-mail addresses, the two symbols
# among the letters, and the only character that becomes two when lowered.
PATTERNED = "@×÷İ"
URL_BEGINNINGS = ("http", "www")
LETTERS = frozenset(map(chr, (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x180))))
ACCENTS = str.maketrans("áàâãäéèêëíìîïóòôõöúùûüñç", "aaaaaeeeeiiiiooooouuuunc")


def _strings(column: pa.Array) -> list[str]:
    try:
        return [t or "" for t in column.to_pylist()]
    except UnicodeDecodeError:
        return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def _slices(texts: list[str]) -> Iterable[list[str]]:
    begin = size = 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= SLICE:
            yield texts[begin:end]
            begin, size = end, 0
    if begin < len(texts):
        yield texts[begin:]


def _classes(texts: list[str], table: np.ndarray, beyond: Callable[[str], int]) -> tuple[np.ndarray, np.ndarray]:
    """The class of every character, with a line feed before each text and three at the end, and the places of these."""
    points = np.frombuffer("\n".join(["", *texts, "\n\n"]).encode("utf-32-le"), np.uint32)
    classes = table.take(points, mode="clip")
    if points.max() >= len(table):
        high = np.flatnonzero(points >= len(table))
        kinds, kind = np.unique(points[high], return_inverse=True)
        classes[high] = np.array([beyond(chr(p)) for p in kinds], np.uint8)[kind]
    return classes, np.cumsum([0, *(len(t) + 1 for t in texts)])


def _per_text(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(mask), edges))


def _places(classes: np.ndarray, code: bytes) -> np.ndarray:
    """Where the classes of a piece of text begin."""
    at = np.flatnonzero(classes[len(code) - 1:] == code[-1])
    for i, c in enumerate(code[:-1]):
        at = at[classes[at + i] == c]
    return at


def _struct(rows: list[dict[str, np.ndarray]], names: Iterable[str]) -> pa.Array:
    whole = {n: np.concatenate([r[n] for r in rows]) if rows else np.zeros(0) for n in names}
    return pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in whole.values()], list(whole))


# --- counts -----------------------------------------------------------------------------


def _blank_class(c: str) -> int:
    control = c <= "\x1f" or "\x7f" <= c <= "\x9f"
    return SPACE * c.isspace() | CONTROL * (control and not c.isspace())


@lru_cache(maxsize=1)
def _blank_table() -> np.ndarray:
    return np.fromiter(map(_blank_class, map(chr, range(1 << 16))), np.uint8, 1 << 16)


def cleaned_counts(text: Column) -> Column:
    """``struct<text_length, word_count>`` of the text that ``clean_text`` makes; both 0 for null."""
    table, names = _blank_table(), ("text_length", "word_count")

    def count(texts: list[str]) -> dict[str, np.ndarray]:
        classes, edges = _classes(texts, table, _blank_class)
        solid = (classes & SPACE) == 0
        begins = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
        tokens = words = np.diff(np.searchsorted(begins, edges))
        kept = solid & ((classes & CONTROL) == 0)
        if begins.size and (classes & CONTROL).any():  # a token of control characters alone leaves no word
            words = np.diff(np.searchsorted(begins[np.logical_or.reduceat(kept, begins)], edges))
        return {"text_length": _per_text(kept, edges) + np.maximum(tokens - 1, 0), "word_count": words}

    @F.arrow_udf(", ".join(f"{n} int" for n in names))
    def count_cleaned(column: pa.Array) -> pa.Array:
        return _struct([count(s) for s in _slices(_strings(column))], names)

    return count_cleaned(text)


# --- cleaned texts --------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _lowered_table(fold_accents: bool) -> np.ndarray:
    """The small letter of every letter, 0 for what parts words."""
    table = np.zeros(1 << 16, np.uint16)
    for point in range(1 << 16):
        low = chr(point).lower()
        if low in LETTERS:
            table[point] = ord(low.translate(ACCENTS) if fold_accents else low)
    return table


def joined_words(text: Column, fold_accents: bool = False) -> Column:
    """Words of letters in lower case with single blanks between them; empty for null.

    It isn't marked as deterministic, so that a filter on it stays above and doesn't make it again.
    """
    table = _lowered_table(fold_accents)

    def join(texts: list[str]) -> pa.Array:
        points = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le"), np.uint32)
        low = table.take(np.minimum(points, len(table) - 1))  # the last one parts words, as all beyond
        letter = low != 0
        edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
        kept, ends = letter.copy(), np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        kept[ends] = True  # one blank after each word but a text's last
        last = np.searchsorted(ends, edges + 1)  # a word that ends a text ends at the next one's edge
        kept[ends[last[1:][np.diff(last) > 0] - 1]] = False
        low[~letter] = ord(" ")
        size = np.where(kept, 1 + (low >= 0x80), 0)
        offsets = np.concatenate([[0], np.cumsum(size)])[np.append(edges[:-1] + 1, len(points))]
        offsets[0] = 0
        data = low[kept].astype(np.uint32).tobytes().decode("utf-32-le").encode()
        return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))

    @F.arrow_udf("string")
    def join_words(column: pa.Array) -> pa.Array:
        parts = [join(s) for s in _slices(_strings(column))]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return join_words.asNondeterministic()(text)


# --- words of a list ----------------------------------------------------------------------------


@lru_cache(maxsize=16)
def _letter_table(letters: str, fold_accents: bool) -> np.ndarray:
    """The class of a character: its own number if it is one of the letters, 0 if it parts words. Capitals count as small."""
    own = {c: i for i, c in enumerate(letters, OTHER + 1)}
    table = np.zeros(1 << 16, np.uint8)
    for point in range(1 << 16):
        low = chr(point).lower()
        if low in LETTERS:
            table[point] = own.get(low.translate(ACCENTS) if fold_accents else low, OTHER)
    table[[ord(c) for c in PATTERNED]] = PATTERN
    return table


def find(text: Column, words: Iterable[str], phrases: Iterable[str] = (), fold_accents: bool = False) -> Column:
    """Where the words of ``ml_words(text)`` are listed ones, and which phrases stand in ``clean_ml(text)``.

    ``struct<marks: array<struct<at, word>>, phrases: array<string>, length: int>``, the length that of the cleaned text.
    The whole struct is null for the few texts that only the patterns can clean; the caller has to do these.
    """
    words = [w for w in words if w and LETTERS.issuperset(w)]
    phrases = [p for p in phrases if p and LETTERS.issuperset(p.replace(" ", ""))]
    letters = "".join(sorted(set("".join((*words, *phrases, *URL_BEGINNINGS))) - {" "}))
    table, size = _letter_table(letters, fold_accents), len(letters) + OTHER + 1
    own = {c: i for i, c in enumerate(letters, OTHER + 1)} | {" ": 0}
    coded = lambda s: bytes(own[c] for c in s)
    known, sought, urls = {coded(w): w for w in words}, [(coded(p), p) for p in phrases], [coded(u) for u in URL_BEGINNINGS]
    # which three first letters a listed word has; what follows a shorter word is 0, then anything
    likely = np.zeros((size, size, size), bool)
    for w in known:
        likely[(*w, 0)[:3]] = True

    def look(texts: list[str]) -> tuple[np.ndarray, ...]:
        classes, edges = _classes(texts, table, lambda c: 0)
        blob, letter = classes.tobytes(), classes != 0
        begins = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        bounds = np.searchsorted(begins, edges)  # the words of a text
        length = _per_text(letter, edges) + np.maximum(np.diff(bounds) - 1, 0)
        hit = np.flatnonzero(likely[classes[begins], classes[begins + 1], classes[begins + 2]])
        found = [(i, known[w]) for i, b in zip(hit.tolist(), begins[hit].tolist()) if (w := blob[b:blob.index(0, b)]) in known]
        spots = np.array([i for i, _ in found], np.int64)
        owner = np.searchsorted(bounds, spots, "right") - 1
        stood: list[list[str]] = [[] for _ in texts]
        if sought:
            kept = letter.copy()
            kept[1:] |= letter[:-1]  # one blank after each word, as in the cleaned text
            single, lows = classes[kept], np.cumsum(np.append(0, length + (length > 0)))
            for code, phrase in sought:
                at = _places(single, code)
                inside = np.searchsorted(lows, at, "right") - 1
                for k in np.unique(inside[at + len(code) <= lows[inside] + length[inside]]).tolist():
                    stood[k].append(phrase)
        spare = np.zeros(len(texts), bool)
        for at in (np.flatnonzero(classes == PATTERN), *(_places(classes, u) for u in urls)):
            spare[np.searchsorted(edges, at, "right") - 1] = True
        return (
            np.bincount(owner, minlength=len(texts)), spots - bounds[owner], np.array([w for _, w in found], object),
            stood, length, spare,
        )

    @F.arrow_udf("marks array<struct<at int, word string>>, phrases array<string>, length int")
    def find_words(column: pa.Array) -> pa.Array:
        looks = [look(s) for s in _slices(_strings(column))]
        whole = [np.concatenate([x[i] for x in looks]) if looks else np.zeros(0, kind) for i, kind in ((0, int), (1, int), (2, object), (4, int), (5, bool))]
        counts, at, word, length, spare = whole
        marks = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(word.tolist(), pa.string())], ["at", "word"])
        offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
        stood = pa.array([p for x in looks for p in x[3]], pa.list_(pa.string()))
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, marks), stood, pa.array(length.astype(np.int32))],
            ["marks", "phrases", "length"], mask=pa.array(spare),
        )

    return find_words(text)
