"""Fast exact token ids for a BPE vocabulary with word ends that drops white space.

The tokenizer file (read at run time, never copied) lower-cases, composes to NFC, cuts a text into units
(contractions, letter runs, single digits, runs of other signs) and merges the bytes of each unit by rank.
Units never span white space. This module finds the units of many texts at once in one byte array, looks each up
by a 64-bit hash in a table that the worker process keeps, and merges all units that it has not met in one
vectorised pass. White-space separated chunks with an apostrophe, a special string or a character outside ASCII
and the Latin-1 letters go through the library itself, so that every id equals the library's.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

#: Units that the table holds at most, and bytes of a unit that it holds at most.
MOST_UNITS, MOST_BYTES = 1_500_000, 96
#: Chunks outside the fast path that are held at most.
MOST_CHUNKS = 100_000
_NONE = np.int32(2**31 - 1)
_EMPTY = np.uint64(2**64 - 1)
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)


def _classes() -> np.ndarray:
    """Class of each byte; lead and trail bytes of two-byte letters are told apart later."""
    out = np.full(256, _ODD, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[0x21:0x7F] = _SIGN
    out[0x30:0x3A] = _DIGIT
    out[0x61:0x7B] = _LETTER
    out[ord("'")] = _ODD
    return out


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_random = np.random.default_rng(20)
_VALUE = _random.integers(1, 2**63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
_POWER = np.cumprod(np.full(4096, np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    lens = lens.astype(np.int64)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(total)


class Table:
    """64-bit keys to int32 values: open addressing, probed in step for whole arrays."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.key = np.full(1 << bits, _EMPTY)
        self.value = np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, default: int = -1) -> np.ndarray:
        slot = self._slot(keys)
        found = self.key[slot]
        out = np.where(found == keys, self.value[slot], np.int32(default))
        todo = np.flatnonzero((found != keys) & (found != _EMPTY))
        at = slot[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.key[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.value[at[hit]]
            on = ~hit & (found != _EMPTY)
            todo, at = todo[on], at[on]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """``keys`` are distinct and new."""
        if (self.n + len(keys)) * 2 > 1 << self.bits:
            used = self.key != _EMPTY
            old = self.key[used], self.value[used]
            self.__init__(self.bits + 1)
            self.add(*old)
            return self.add(keys, values)
        self.n += len(keys)
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.key[at] == _EMPTY
            first = np.flatnonzero(free)[np.unique(at[free], return_index=True)[1]] if free.any() else np.zeros(0, np.int64)
            self.key[at[first]], self.value[at[first]] = keys[todo[first]], values[todo[first]]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        return None


def scan(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes of all texts, unit starts, unit ends, text of each unit, whether it is an odd chunk).

    An odd chunk stands for all units of a chunk that the fast path does not understand."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    offsets = np.cumsum(sizes + 1)
    low = _LOWER[raw]
    kind = _CLASS[low]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    trail = raw[lead + 1]
    letter = (trail >= 0x80) & (trail <= 0xBF) & (trail != 0x97) & (trail != 0xB7)
    lead, trail = lead[letter], trail[letter]
    kind[lead] = kind[lead + 1] = _LETTER
    low[lead[trail < 0x9F] + 1] += 0x20
    # "<|" may open a special string
    bar = np.flatnonzero(raw[:-1] == ord("<"))
    kind[bar[raw[bar + 1] == ord("|")]] = _ODD
    space = kind == _SPACE
    cut = np.empty(len(kind), bool)
    cut[0] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    cut |= kind == _DIGIT
    starts = np.flatnonzero(cut & ~space)
    del cut
    # ends: the next start or space
    bound = np.flatnonzero(space)
    nxt = bound[np.searchsorted(bound, starts)]
    ends = np.minimum(nxt, np.r_[starts[1:], len(kind)]) if len(starts) else starts
    odd = np.zeros(len(starts), bool)
    strange = np.flatnonzero(kind == _ODD)
    if len(strange):
        k = np.unique(np.searchsorted(bound, strange))  # the chunk ends before bound[k]
        first = np.where(k > 0, bound[k - 1] + 1, 0)
        lo, hi = np.searchsorted(starts, first), np.searchsorted(starts, bound[k])
        drop = np.zeros(len(starts) + 1, np.int32)
        np.add.at(drop, lo, 1)
        np.add.at(drop, hi, -1)
        keep = np.cumsum(drop[:-1]) == 0
        keep[lo] = True
        odd[lo] = True
        ends[lo] = bound[k]
        starts, ends, odd = starts[keep], ends[keep], odd[keep]
    low[strange] = raw[strange]
    return low, starts, ends, np.searchsorted(offsets, starts, side="right"), odd


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each unit (of at most 4096 bytes)."""
    lens = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = ragged(starts, lens)
    inside = at - np.repeat(starts, lens)
    out = np.add.reduceat(_VALUE[low[at]] * _POWER[inside], np.cumsum(lens) - lens)
    out ^= out >> np.uint64(29)
    return np.where(out == _EMPTY, np.uint64(0), out)


class Memory:
    """What a worker knows of units: a ragged array of int32 values for each."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], odd: Callable[[bytes], np.ndarray]):
        self.learn, self.odd = learn, odd
        self._clear()

    def _clear(self) -> None:
        self.table = Table(18)
        self.chunks: dict[bytes, int] = {}
        self.starts, self.lens, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)
        self.n_entries = self.n_pool = 0

    def _add(self, values: np.ndarray, lens: np.ndarray) -> np.ndarray:
        k, n = self.n_entries, self.n_pool
        while k + len(lens) > len(self.starts):
            self.starts = np.r_[self.starts, np.zeros_like(self.starts)]
            self.lens = np.r_[self.lens, np.zeros_like(self.lens)]
        while n + len(values) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        self.pool[n : n + len(values)] = values
        self.lens[k : k + len(lens)] = lens
        self.starts[k : k + len(lens)] = n + np.cumsum(lens) - lens
        self.n_entries += len(lens)
        self.n_pool += len(values)
        return np.arange(k, k + len(lens), dtype=np.int32)

    def look_up(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(values of all units in order, how many each has, the text of each, their ends in the joined bytes)."""
        if self.table.n > MOST_UNITS or len(self.chunks) > MOST_CHUNKS:
            self._clear()
        low, starts, ends, owner, odd = scan(texts)
        entry = np.full(len(starts), -1, np.int32)
        plain = np.flatnonzero(~odd & (ends - starts <= MOST_BYTES))
        keys = hashes(low, starts[plain], ends[plain])
        found = self.table.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            data = low.tobytes()
            at = plain[new[first]]
            units = [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            numbers = self._add(*self.learn(units))
            self.table.add(fresh, numbers)
            found[new] = numbers[back]
        entry[plain] = found
        rest = np.flatnonzero(entry < 0)
        kept = self.n_entries, self.n_pool
        if len(rest):
            data, base = low.tobytes(), np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)]
            later: list[tuple[int, bytes]] = []
            for k in rest[odd[rest]].tolist():
                own = owner[k]
                chunk = texts[own][starts[k] - base[own] : ends[k] - base[own]]
                e = self.chunks.get(chunk, -1)
                if e < 0 and len(chunk) <= MOST_BYTES:
                    values = self.odd(chunk)
                    e = self.chunks[chunk] = int(self._add(values, np.array([len(values)]))[0])
                elif e < 0:
                    later.append((k, chunk))
                entry[k] = e
            kept = self.n_entries, self.n_pool
            for k, chunk in later:
                values = self.odd(chunk)
                entry[k] = self._add(values, np.array([len(values)]))[0]
            longs = rest[~odd[rest]]
            if len(longs):
                entry[longs] = self._add(*self.learn([data[a:b] for a, b in zip(starts[longs].tolist(), ends[longs].tolist(), strict=True)]))
        size = self.lens[entry]
        values = self.pool[ragged(self.starts[entry], size)]
        self.n_entries, self.n_pool = kept  # long ones are not held
        return values, size, owner, ends


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes that print as Latin-1 signs stand
    for themselves, the others for the code points from 256 on."""
    printable = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    extra = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(extra)) for b in range(256)]


class WordBpe:
    """Ids of units, chunks and texts for the tokenizer file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special: list[str] = [t["content"] for t in spec["added_tokens"]]
        self.chars = byte_chars()
        self.first = np.array([self.vocab[c] for c in self.chars], np.int32)
        self.last = np.array([self.vocab[c + self.end] for c in self.chars], np.int32)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        keys = np.array([self.vocab[a] << 20 | self.vocab[b] for a, b in pairs], np.uint64)
        keys, first = np.unique(keys, return_index=True)
        self.ranks = Table(18)
        self.ranks.add(keys, first.astype(np.int32))
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int32)
        self.memory = Memory(self.merge_units, self._by_library)

    def _by_library(self, chunk: bytes) -> np.ndarray:
        return np.array(self.library.encode(chunk.decode(), add_special_tokens=False).ids, np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.ranks.find(left.astype(np.uint64) << np.uint64(20) | right.astype(np.uint64), int(_NONE))

    def merge_units(self, units: list[bytes], ended: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after the other, how many each has). ``ended``: the last byte ends a word.

        In each round every unit merges all places of its pair of least rank, from the left and without overlap.
        That is what merging one place at a time does, as a new symbol's own pairs have later ranks."""
        n_units = len(units)
        lens = np.fromiter(map(len, units), np.int64, n_units)
        raw = np.frombuffer(b"".join(units), np.uint8)
        ids = self.first[raw]
        stops = np.cumsum(lens)
        if ended and n_units:
            ids[stops[lens > 0] - 1] = self.last[raw[stops[lens > 0] - 1]]
        owner = np.repeat(np.arange(n_units), lens)
        counts = lens.copy()
        done_ids: list[np.ndarray] = []
        done_owner: list[np.ndarray] = []
        rank = np.full(len(ids), _NONE)
        if len(ids) > 1:
            at = np.flatnonzero(owner[1:] == owner[:-1])
            rank[at] = self._rank(ids[at], ids[at + 1])
        while len(ids):
            cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, cut)
            per = np.diff(np.r_[cut, len(ids)])
            spread = np.repeat(best, per)
            over = spread == _NONE
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                on = ~over
                ids, owner, rank, spread = ids[on], owner[on], rank[on], spread[on]
                if not len(ids):
                    break
            place = np.flatnonzero(rank == spread)
            # of places that follow one another every second one
            run = np.r_[True, place[1:] != place[:-1] + 1]
            start = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - start) % 2 == 0]
            ids[place] = self.made[rank[place]]
            keep = np.ones(len(ids), bool)
            keep[place + 1] = False
            new = np.zeros(len(ids), bool)
            new[place] = True
            ids, owner, rank, new = ids[keep], owner[keep], rank[keep], new[keep]
            # pairs that start with a new symbol or end with one
            again = new.copy()
            again[:-1] |= new[1:]
            at = np.flatnonzero(again)
            rank[at] = _NONE
            at = at[at + 1 < len(ids)]
            at = at[owner[at] == owner[at + 1]]
            rank[at] = self._rank(ids[at], ids[at + 1])
        ids, owner = np.concatenate(done_ids or [ids]), np.concatenate(done_owner or [owner])
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=n_units)
        return ids[order], counts

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each text has)."""
        values, size, owner, _ = self.memory.look_up(texts)
        return values, np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)


_held: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The tokenizer of this process for ``path``; workers that Spark uses again keep what they learned."""
    if path not in _held:
        _held[path] = WordBpe(path)
    return _held[path]
