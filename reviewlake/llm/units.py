"""Token ids of whole texts from the ids of their units, each distinct unit being encoded once.

A unit is a run that a tokenizer never joins with its neighbours, so a text's ids are those of its units in a row. Tests
hold them equal to the tokenizers' own ids of whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Distinct units kept; when full, the cache starts anew.
CACHE_UNITS = 1_000_000
#: Characters that Python takes for white space and the tokenizers don't.
_ODD = re.compile("[\x1c-\x1f]")


def gather(flat: np.ndarray, starts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slices of `flat` that begin at starts[place] and end at starts[place + 1], in a row; end of each in that row)."""
    size = starts[place + 1] - starts[place]
    ends = np.cumsum(size)
    at = np.repeat(starts[place] - (ends - size), size)
    at += np.arange(len(at))
    return flat[at], ends


class _Places(dict):
    """Place of each unit; a unit that has none gets the next one and waits to be encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = place = len(self)
        self.fresh.append(unit)
        return place


class UnitEncoder:
    """Ids of texts by units. Subclasses say how a text splits, how units are encoded and which texts go whole."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self._places = _Places()
        self._flat, self._starts = array("I"), array("q", [0])

    def split(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode_units(self, units: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def encode_whole(self, text: str) -> list[int] | None:
        """Ids of a text that units can't give, else None."""
        return None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, number of ids of each text)."""
        if len(self._places) > CACHE_UNITS:
            self._clear()
        found, counts, whole = array("q"), [], {}
        place_of = self._places.__getitem__
        for k, text in enumerate(texts):
            if (ids := self.encode_whole(text)) is not None:
                whole[k] = np.array(ids, np.uint32)
                counts.append(0)
            else:
                units = self.split(text)
                found.extend(map(place_of, units))
                counts.append(len(units))
        if fresh := self._places.fresh:
            for ids in self.encode_units(fresh):
                self._flat.extend(ids)
                self._starts.append(len(self._flat))
            self._places.fresh = []
        ids, ends = gather(np.array(self._flat, np.uint32), np.array(self._starts, np.int64), np.array(found, np.int64))
        bounds = np.r_[0, ends][np.cumsum([0, *counts])]
        lengths = np.diff(bounds)
        if whole:
            parts = [whole.get(k, ids[bounds[k] : bounds[k + 1]]) for k in range(len(texts))]
            ids, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, lengths


def byte_alphabet() -> dict[str, int]:
    """Byte that each character of a byte-level vocabulary stands for: visible Latin-1 itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)).difference(plain)))}


class WordEncoder(UnitEncoder):
    """A vocabulary whose tokenizer drops white space and splits at it, as ids of `tokenizers` with add_special_tokens=False.

    Texts with a special token's string or a control character that the two split differently go through it as they are.
    Units of Latin-1 characters alone are split and lower-cased here and merged by the same vocabulary given as ranks, where
    its ids are in the order of its merges; a word's end is the byte WORD_END, which such units don't hold.
    """

    WORD_END = "\x01"
    _END = "</w>"
    #: Letters and numbers of Latin-1, lower-cased.
    _L, _N = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
    _latin = re.compile(r"[\x02-\xff]+")
    _part = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_L}{_N}]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self.size = self._tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as file:
            self._ranked = self._by_ranks(json.load(file)["model"])

    def _by_ranks(self, model: dict):
        """An encoder of the same merges by rank, or None where ids aren't in the order of the merges."""
        import tiktoken

        vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        alphabet, first = byte_alphabet(), 2 * 256
        if model.get("end_of_word_suffix") != self._END or any(vocabulary.get(a + b) != first + k for k, (a, b) in enumerate(merges)):
            return None
        ranks = {}
        for token, rank in vocabulary.items():
            if rank < first + len(merges):
                body, end = (token[: -len(self._END)], self.WORD_END.encode()) if token.endswith(self._END) else (token, b"")
                ranks[bytes(map(alphabet.__getitem__, body)) + end] = rank
        if len(ranks) != first + len(merges):
            return None
        return tiktoken.Encoding("words", pat_str=f"[^{self.WORD_END}]+{self.WORD_END}", mergeable_ranks=ranks, special_tokens={})

    def split(self, text: str) -> list[str]:
        return text.split()

    def encode_units(self, units: list[str]) -> list[list[int]]:
        if self._ranked is None:
            return [e.ids for e in self._tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        latin, part, merge, end = self._latin.fullmatch, self._part.findall, self._ranked.encode_ordinary, self.WORD_END
        found = [merge(end.join(part(u.lower())) + end) if latin(u) else None for u in units]
        rest = [k for k, ids in enumerate(found) if ids is None]
        for k, e in zip(rest, self._tokenizer.encode_batch_fast([units[k] for k in rest], add_special_tokens=False), strict=True):
            found[k] = e.ids
        return found

    def encode_whole(self, text: str) -> list[int] | None:
        if _ODD.search(text) or any(s in text for s in self._special):
            return self._tokenizer.encode(text, add_special_tokens=False).ids
        return None


class PieceEncoder(UnitEncoder):
    """A vocabulary of pieces that hold a space mark at their start or alone. Texts are given with the space that it adds."""

    _unit = re.compile(" +[^ ]*")

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__()
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._space = self._model.piece_to_id("▁")

    def split(self, text: str) -> list[str]:
        return self._unit.findall(text)

    def encode_units(self, units: list[str]) -> list[list[int]]:
        found = self._model.encode([u[1:] for u in units], num_threads=1)
        return [ids if unit != " " else [self._space] for unit, ids in zip(units, found, strict=True)]

    def token_bytes(self) -> list[bytes]:
        """What each piece stands for."""
        model = self._model
        return [
            bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k)
            else model.id_to_piece(k).replace("▁", " ").encode()
            for k in range(model.get_piece_size())
        ]
