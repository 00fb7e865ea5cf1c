"""Vectorised pre-tokenisation and cached encoding of the resulting slices, for batches of texts inside a task.

Texts are code point arrays.  A class table and a look at the next two classes turn every code point into one of a few
symbols; each symbol is a transition function on a handful of states, and a slice begins where the function says so.
Functions compose associatively, so the states at the borders of blocks come from a scan over block functions and all
blocks then run side by side.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, END = range(7)
#: Code points of the Unicode property White_Space (fixed values).
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Stands between texts; no code point has this number.
BORDER = 0x110000
#: Below this every code point is its own composed form and has been assigned since long.
PLAIN = 0x300

_tables: dict[int, np.ndarray] = {}


def class_table(n: int) -> np.ndarray:
    """Classes of the code points below ``n``; ``BORDER`` is kept apart."""
    if n not in _tables:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(n)), np.uint8, n)
        table[[c for c in WHITE_SPACE if c < n]] = WHITE
        table[0x20], table[0x27] = SPACE, QUOTE
        _tables[n] = table
    return _tables[n]


# symbols: what a code point means given the next ones
S_LETTER, S_NUMBER, S_OTHER, S_INSIDE, S_SPACE, S_WHITE, S_SHORT, S_LONG, S_END = range(9)
# states: what slice is open
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)
BLOCK = 64


class Splitter:
    """Boundaries of the slices that the usual pattern of byte-level tokenizers matches.

    ``attach_space``: one space joins the run after it.  ``single_numbers``: every number is a slice of its own.
    """

    def __init__(self, attach_space: bool = True, single_numbers: bool = False):
        step, start = np.zeros((9, 8), np.uint8), np.zeros((9, 8), bool)
        runs = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS}
        for sym in range(9):
            for st in range(8):
                if st in (ONE_MORE, TWO_MORE) and sym == S_LETTER:
                    step[sym, st] = FRESH if st == ONE_MORE else ONE_MORE
                elif sym in runs or (sym in (S_SHORT, S_LONG) and st in (IN_OTHERS, AFTER_SPACE)):
                    run = runs.get(sym, IN_OTHERS)
                    step[sym, st] = run
                    start[sym, st] = st not in (run, AFTER_SPACE) or (single_numbers and sym == S_NUMBER)
                elif sym == S_INSIDE:
                    step[sym, st], start[sym, st] = IN_WHITE, st != IN_WHITE
                else:
                    step[sym, st] = {S_SPACE: AFTER_SPACE if attach_space else FRESH, S_SHORT: ONE_MORE, S_LONG: TWO_MORE}.get(sym, FRESH)
                    start[sym, st] = True
        self.step, self.start = step.ravel(), start.ravel()

    @staticmethod
    def symbols(cps: np.ndarray) -> np.ndarray:
        """``cps`` ends with ``BORDER``."""
        top = PLAIN if cps[cps != BORDER].max(initial=0) < PLAIN else BORDER
        kind = class_table(top)[np.where(cps == BORDER, 0, cps)]
        kind[cps == BORDER] = END
        white = (kind == SPACE) | (kind == WHITE)
        ends_run = np.append(~white[1:] & (kind[1:] != END), False)
        of = np.array([S_LETTER, S_NUMBER, S_OTHER, S_INSIDE, S_INSIDE, S_OTHER, S_END], np.uint8)
        sym = of[kind]
        last = white & ends_run
        sym[last] = np.where(kind[last] == SPACE, S_SPACE, S_WHITE)
        q = np.flatnonzero(kind == QUOTE)
        if len(q):
            one, two = cps[q + 1], cps[np.minimum(q + 2, len(cps) - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
            sym[q[short]] = S_SHORT
            sym[q[long]] = S_LONG
        return sym

    def starts(self, cps: np.ndarray) -> np.ndarray:
        """Whether a slice begins at each code point; every ``BORDER`` is a slice."""
        sym = self.symbols(cps)
        n = len(sym)
        rows = -(-n // BLOCK)
        grid = np.full(rows * BLOCK, S_END, np.uint8)
        grid[:n] = sym
        grid = grid.reshape(rows, BLOCK).T.astype(np.intp) * 8  # grid[t]: symbol t of every block
        state = self._entries(grid)
        out = np.empty((BLOCK, rows), bool)
        for t in range(BLOCK):
            at = grid[t] + state
            out[t] = self.start[at]
            state = self.step[at]
        return out.T.ravel()[:n]

    def _entries(self, grid: np.ndarray) -> np.ndarray:
        """The state in which each block begins: an exclusive scan over the blocks' functions."""
        rows = grid.shape[1]
        fixed = np.isin(grid, [S_SPACE * 8, S_WHITE * 8, S_END * 8]).any(axis=0)  # these lead to one state from all
        out = np.zeros(rows, np.uint8)
        for t in range(BLOCK):
            out = self.step[grid[t] + out]
        if fixed.all():
            return np.append(np.uint8(FRESH), out[:-1])
        fn = np.repeat(out[:, None], 8, axis=1)
        loose = np.flatnonzero(~fixed)
        cur = np.repeat(np.arange(8, dtype=np.uint8)[None], len(loose), axis=0)
        for t in range(BLOCK):
            cur = self.step[grid[t, loose][:, None] + cur]
        fn[loose] = cur
        fn[0] = fn[0, FRESH]
        d = 1
        while d < rows and not (fn == fn[:, :1]).all():
            fn[d:] = np.take_along_axis(fn[d:], fn[:-d].astype(np.intp), axis=1)
            d *= 2
        return np.append(np.uint8(FRESH), fn[:-1, FRESH])


class Fingerprints:
    """64-bit polynomial fingerprints of many slices of one byte array, by prefix sums."""

    def __init__(self, seed: int = 2024):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = rng.integers(0, 2**64, dtype=np.uint64) | np.uint64(1)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    #: Powers that are kept.  Slices are taken in runs that this many bytes hold; a longer slice has powers of its own.
    KEPT = 1 << 18

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up, self.down
        size = max(n, min(self.KEPT, 1 << (n - 1).bit_length()))
        with np.errstate(over="ignore"):
            up, down = (np.concatenate([[np.uint64(1)], np.full(size - 1, x)]).cumprod(dtype=np.uint64) for x in (self.base, self.inverse))
        if size <= self.KEPT:
            self.up, self.down = up, down
        return up, down

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``starts`` and ``ends`` ascend."""
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            lo = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, lo + self.KEPT - 1, side="right")))
            out[i:j] = self._run(data[lo : int(ends[j - 1])], starts[i:j] - lo, ends[i:j] - lo)
            i = j
        return out

    def _run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self._powers(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.value[data] * up[: len(data)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return np.maximum(h, np.uint64(1))


class SliceCache:
    """Ids of slices by fingerprint: an open-addressing table in arrays.  When it is full it starts anew."""

    def __init__(self, bits: int = 20):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.key, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.n, self.used = 0, 0
        self.first, self.length, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry numbers, -1 where unknown."""
        out, todo = np.full(len(h), -1, np.int32), np.arange(len(h))
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            k, want = self.key[slot], h[todo]
            hit = k == want
            out[todo[hit]] = self.entry[slot[hit]]
            go = ~hit & (k != 0)
            todo, slot = todo[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        """``h``: distinct and unknown."""
        flat = np.fromiter((x for y in ids for x in y), np.uint32)
        length = np.fromiter(map(len, ids), np.int32, len(ids))
        while self.n + len(h) > len(self.first):
            self.first, self.length = np.resize(self.first, 2 * len(self.first)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        new = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.first[new], self.length[new] = self.used + np.cumsum(length) - length, length
        self.ids[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(h), self.used + len(flat)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.key[slot] == 0
            _, pick = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            pick = pick[free[pick]]
            self.key[slot[pick]], self.entry[slot[pick]] = h[pick], new[pick]
            rest = np.ones(len(h), bool)
            rest[pick] = False
            h, new, slot = h[rest], new[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the entries in order, and how many each has."""
        length = self.length[entries].astype(np.int64)
        before = np.cumsum(length) - length
        return self.ids[np.repeat(self.first[entries] - before, length) + np.arange(length.sum())], length


class SliceEncoder:
    """Encodes texts slice by slice; ``merge`` gives the ids of slices (bytes) that the cache does not know.

    Memory: a few arrays over ``piece_chars`` code points (more only for a single longer text) and the cache.
    """

    def __init__(self, merge: Callable[[list[bytes]], list[list[int]]], splitter: Splitter, keep_white: bool = True, piece_chars: int = 1 << 19, cache_bits: int = 20):
        self.merge, self.splitter, self.keep_white, self.piece_chars = merge, splitter, keep_white, piece_chars
        self.cache, self.prints = SliceCache(cache_bits), Fingerprints()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the bounds of each text in them (one more than there are texts)."""
        parts, counts, group, size = [], [], [], 0
        for i, t in enumerate(texts):
            group.append(t)
            size += len(t) + 1
            if size >= self.piece_chars or i == len(texts) - 1:
                ids, n = self._encode(group)
                parts.append(ids)
                counts.append(n)
                group, size = [], 0
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def slices(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes with a border byte after each text, starts and ends of the slices, and each slice's text."""
        border = np.array([BORDER], np.uint32)
        cps = np.concatenate([x for t in texts for x in (np.frombuffer(t.encode("utf-32-le"), np.uint32), border)])
        starts = np.flatnonzero(self.splitter.starts(cps))
        width = 1 + (cps > 0x7F).astype(np.int8) + (cps > 0x7FF) + (cps > 0xFFFF)
        width[cps == BORDER] = 1
        first = cps[starts]
        at = (np.cumsum(width, dtype=np.int64) - width)[starts]
        ends = np.append(at[1:], at[-1] + 1)
        real = first != BORDER
        text = np.cumsum(~real) - ~real
        if not self.keep_white:
            real &= ~np.isin(first, WHITE_SPACE)
        return b"\xff".join([*(t.encode() for t in texts), b""]), at[real], ends[real], text[real]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, at, ends, text = self.slices(texts)
        h = self.prints.of(np.frombuffer(data, np.uint8), at, ends)
        entries = self.cache.find(h)
        lost = np.flatnonzero(entries < 0)
        if len(lost):
            new, where = np.unique(h[lost], return_index=True)
            if self.cache.n + len(new) > len(self.cache.key) // 2:
                self.cache.clear()
                new, where = np.unique(h, return_index=True)
                lost = np.arange(len(h))
                while len(new) > len(self.cache.key) // 2:
                    self.cache.bits += 1  # one very long text
                    self.cache.clear()
            where = lost[where]
            self.cache.add(new, self.merge([data[s:e] for s, e in zip(at[where].tolist(), ends[where].tolist())]))
            entries = self.cache.find(h)
        ids, length = self.cache.gather(entries)
        return ids, np.bincount(text, weights=length, minlength=len(texts)).astype(np.int64)
