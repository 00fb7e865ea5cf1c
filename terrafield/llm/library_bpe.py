"""Encoding with the tokenizers library: slices the library's own pre-tokeniser would cut, each merged by it once."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from .pretokens import PLAIN, SliceEncoder, Splitter


def byte_letters() -> list[str]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes (a fixed rule of that format)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class LibraryBpe:
    """``encode(texts)`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)`` for every text.

    Texts of code points below ``PLAIN`` are cut here and each new slice is merged by the library's model; for such
    texts the library's normaliser does no more than fold case and white space.  All other texts, and those that may hold
    an added token, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.lower = self.library.normalizer is not None
        self.letters = byte_letters()
        splitter = Splitter(attach_space=not self.lower, single_numbers=self.lower)
        self.encoder = SliceEncoder(self._merge, splitter, keep_white=not self.lower)

    def _merge(self, slices: list[bytes]) -> list[list[int]]:
        tokenize, letters = self.library.model.tokenize, self.letters
        return [[t.id for t in tokenize("".join(map(letters.__getitem__, s)))] for s in slices]

    def _odd(self, text: str) -> bool:
        # a code point from PLAIN on begins with a byte of at least 0xCC
        if not text.isascii() and np.frombuffer(text.encode(), np.uint8).max() >= 0xCC:
            return True
        low = text.lower()
        return any(a in low for a in self.added)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, t in enumerate(texts) if self._odd(t)]
        own = list(texts)
        for i in odd:
            own[i] = ""
        ids, bounds = self.encoder.encode([t.lower() for t in own] if self.lower else own)
        if not odd:
            return ids, bounds
        whole = dict(zip(odd, self.library.encode_batch([texts[i] for i in odd], add_special_tokens=False)))
        parts = [np.array(whole[i].ids, np.uint32) if i in whole else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@lru_cache(maxsize=None)
def model(path: str) -> LibraryBpe:
    """One per Python worker, so that its cache lasts over batches and tasks."""
    return LibraryBpe(path)


assert PLAIN == 0x300


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same documents with ``end_id`` after each."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    new = bounds + np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[new[1:] - 1] = False
    out[keep] = ids
    return out, new
