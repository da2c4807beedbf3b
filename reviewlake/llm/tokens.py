"""Byte-level BPE ids of whole texts by a public vocabulary, with a cache of words."""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np

#: Runs that the vocabulary's own split pattern never joins: a word with the space before it, or white space.
_UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters that Python's \s holds and the tokenizer's doesn't.
_ODD = re.compile("[\x1c-\x1f]")
#: Distinct words kept; when full, the cache starts anew.
CACHE_WORDS = 1_000_000


class Encoder:
    """Ids equal to those of `tokenizers` with add_special_tokens=False.

    A word's ids don't depend on its surroundings, so each distinct word is encoded once, from the same vocabulary given
    as ranks. Texts that hold a special token's string or a control character that the two split differently go through
    `tokenizers` as they are.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._whole = Tokenizer.from_file(tokenizer_path)
        self._special = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._word = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._clear()

    def _clear(self) -> None:
        encode, flat, starts = self._word.encode_ordinary, array("I"), array("q", [0])

        class Units(dict):
            def __missing__(self, unit: str) -> int:
                self[unit] = place = len(starts) - 1
                flat.extend(encode(unit))
                starts.append(len(flat))
                return place

        self._units, self._flat, self._starts = Units(), flat, starts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, number of ids of each text)."""
        if len(self._units) > CACHE_WORDS:
            self._clear()
        places, counts = array("q"), []
        get, odd = self._units.__getitem__, {}
        for k, text in enumerate(texts):
            if _ODD.search(text) or any(s in text for s in self._special):
                odd[k] = np.array(self._whole.encode(text, add_special_tokens=False).ids, np.uint32)
                counts.append(0)
                continue
            units = _UNIT.findall(text)
            places.extend(map(get, units))
            counts.append(len(units))
        place = np.array(places, np.int64)
        starts = np.array(self._starts, np.int64)
        size = starts[place + 1] - starts[place]
        ends = np.cumsum(size)
        at = np.repeat(starts[place] - (ends - size), size)
        at += np.arange(len(at))
        ids = np.array(self._flat, np.uint32)[at] if len(at) else np.zeros(0, np.uint32)
        bounds = np.r_[0, ends][np.cumsum([0, *counts])]
        lengths = np.diff(bounds)
        if odd:
            parts = [odd.get(k, ids[bounds[k] : bounds[k + 1]]) for k in range(len(texts))]
            ids, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, lengths
