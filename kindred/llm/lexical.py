"""Words of letters and digits in many texts at once: runs of a-z, 0-9 and all characters outside ASCII, A-Z lower-cased."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np

from .wordbpe import _LOWER, hashes

#: The same words for engines with regular expressions, after A-Z are lower-cased.
LEXICAL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a word up to which words are hashed together.
SHORT = 4096
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


class Words(NamedTuple):
    """Words of texts joined into ``low``; those of text i stand from ``bounds[i]`` to ``bounds[i + 1]``."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def split(texts: list[bytes]) -> Words:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    low = _LOWER[raw]
    edges = np.flatnonzero(np.diff(_WORD[low].view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]  # the last byte is no word's, so edges come in pairs
    offsets = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return Words(low, starts, ends, np.r_[0, np.searchsorted(starts, offsets)])


def word_hashes(w: Words) -> np.ndarray:
    """64-bit hash of each word, with fixed seeds."""
    lens = w.ends - w.starts
    long = np.flatnonzero(lens > SHORT)
    if not len(long):
        return hashes(w.low, w.starts, w.ends)
    out = np.zeros(len(lens), np.uint64)
    short = np.flatnonzero(lens <= SHORT)
    out[short] = hashes(w.low, w.starts[short], w.ends[short])
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(w.low[w.starts[i] : w.ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out
