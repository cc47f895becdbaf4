"""Token counts by prefix dynamic programming: the exact count at every prefix of every text, stored once.

A sequence of tokens is what byte-pair merging makes of its bytes exactly when every two neighbours are: merging
their joined bytes gives the two back. So for each prefix of a unit there is one last token that agrees with the
last token of the prefix before it, and count(prefix) = count(shorter prefix) + 1. Here a prefix that ends a text
also ends a word, so two recurrences run side by side: tokens inside a word, and the closing token with its
word-end mark. Counts of units are remembered by each worker; a text stores the change of its count at each code
point, so that truncation and budget questions need sums only.

Defined results: a null text is empty (0 tokens, no changes stored); repeated rows give repeated results; other
columns of the input are not read. A prefix that ends inside a special string counts it as ordinary text, which
is what encoding that prefix gives. Texts of any length are processed whole; runs of decomposed characters
without any break cost time with the square of their length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, slices, utf8
from .wordbpe import _POWER, _VALUE, Memory, Table, WordBpe, word_bpe

SLICE = 2 << 20
_MOST_PAIRS = 2_000_000


@cache
def _second() -> frozenset[str]:
    """Characters that may compose with one before them."""
    found = {chr(k) for k in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for k in range(0x110000):
        parts = unicodedata.decomposition(chr(k)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


@cache
def starts_afresh(c: str) -> bool:
    """Whether composition never joins the character with what stands before it."""
    d = unicodedata.normalize("NFD", c)[0]
    return not unicodedata.combining(d) and d not in _second()


class Units:
    """Token count of a growing text without white space, special strings taken as ordinary text: one normalised
    character more at a time, and back to a mark."""

    def __init__(self, counter: PrefixCounts):
        self.of = counter
        self.done, self.kind, self.before = 0, "", (0, "")
        self.fresh()

    def fresh(self, kind: str = "") -> None:
        self.kind, self.raw, self.counts, self.last = kind, bytearray(), [0], [-1]

    def mark(self) -> tuple:
        return self.done, self.kind, self.before, self.raw, self.counts, self.last, len(self.raw)

    def back(self, mark: tuple) -> None:
        self.done, self.kind, self.before, self.raw, self.counts, self.last, n = mark
        del self.raw[n:], self.counts[n + 1 :], self.last[n + 1 :]

    def _grow(self, c: str) -> None:
        inside, agree, longest = self.of.inside, self.of._agree, self.of.longest
        for b in c.encode():
            self.raw.append(b)
            i = len(self.raw)
            near = bytes(self.raw[max(0, i - longest) :])
            for k in range(len(near)):
                t = inside.get(near[k:])
                if t is not None:
                    j = i - len(near) + k
                    if self.last[j] < 0 or agree(self.last[j], t):
                        break
            self.counts.append(self.counts[j] + 1)
            self.last.append(t)

    def _closed(self) -> int:
        """Tokens of the open unit, as one that ends here."""
        i = len(self.raw)
        near = bytes(self.raw[max(0, i - self.of.longest) :])
        for k in range(len(near)):
            t = self.of.closing.get(near[k:])
            j = i - len(near) + k
            if t is not None and (self.last[j] < 0 or self.of._agree(self.last[j], t)):
                return self.counts[j] + 1
        return 0

    def count(self) -> int:
        return self.done + self._closed()

    def add(self, c: str) -> None:
        kind = self.of.kind_of(c)
        if self.kind == "quote" and c in "stmd" or self.kind == "quote?" and self.before[1] + c in ("re", "ve", "ll"):
            start = self.done if self.kind == "quote" else self.before[0]
            whole = "'" + (self.before[1] if self.kind == "quote?" else "") + c
            self.fresh()
            self._grow_all(whole)
            self.done = start + self._closed()
            self.fresh()
        elif self.kind == "quote" and c in "rvl":  # a letter, unless the next one makes a contraction
            self.before = (self.done, c)
            self.done += self._closed()
            self.fresh("quote?")
            self._grow(c)
        elif kind == "sign" and self.kind in ("sign", "quote") or kind == "letter" and self.kind in ("letter", "quote?"):
            self.kind = kind
            self._grow(c)
        else:
            self.done += self._closed()
            self.fresh("quote" if c == "'" else kind)
            if kind != "space":
                self._grow(c)
            if kind in ("digit", "space"):
                self.done += self._closed()
                self.fresh()

    def _grow_all(self, text: str) -> None:
        for c in text:
            self._grow(c)


class PrefixCounts:
    """Counts at every prefix, for the tokenizer of a :class:`WordBpe`."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        raw = {c: b for b, c in enumerate(bpe.chars)}
        spelled: list[tuple[int, bytes, bool]] = []
        for token, k in bpe.vocab.items():
            ended = token.endswith(bpe.end) and token not in bpe.special
            body = token[: -len(bpe.end)] if ended else token
            if body and all(c in raw for c in body) and token not in bpe.special:
                spelled.append((k, bytes(map(raw.__getitem__, body)), ended))
        self.inside: dict[bytes, int] = {}
        self.closing: dict[bytes, int] = {}
        for ended, held in ((False, self.inside), (True, self.closing)):
            some = [(k, b) for k, b, e in spelled if e == ended]
            ids, lens = bpe.merge_units([b for _, b in some], ended)
            first = ids[np.cumsum(lens) - lens]
            held.update({b: k for (k, b), n, f in zip(some, lens.tolist(), first.tolist(), strict=True) if n == 1 and f == k})
        self.spelling = {k: (b, e) for k, b, e in spelled}
        self.longest = max(len(b) for _, b, _ in spelled)
        at = np.flatnonzero(bpe.ranks.key != np.uint64(2**64 - 1))
        self.rank = dict(zip(bpe.ranks.key[at].tolist(), bpe.ranks.value[at].tolist(), strict=True))
        self.agreeing: dict[int, bool] = {}
        self.agreed = Table(18)
        self.ends = np.zeros(1 << 17, bool)
        self.ends[[k for k, (_, e) in self.spelling.items() if e]] = True
        begun: dict[bytes, int] = {}
        for b in (*self.inside, *self.closing):
            for n in range(1, len(b) + 1):
                begun.setdefault(b[:n], len(begun))
        self.begun = np.full((len(begun), 2), -1, np.int32)
        for column, held in enumerate((self.inside, self.closing)):
            self.begun[[begun[b] for b in held], column] = list(held.values())
        keys = np.array([sum(int(_VALUE[c]) * int(_POWER[k]) for k, c in enumerate(b)) & (2**64 - 1) for b in begun], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two token beginnings share a hash; change the seed of _VALUE")
        self.beginnings = Table(18)
        self.beginnings.add(keys, np.arange(len(keys), dtype=np.int32))
        self.memory = Memory(self.learn, self.odd_chunk)
        self.kinds: dict[str, str] = {}

    def kind_of(self, c: str) -> str:
        """How the tokenizer cuts around a normalised character: letter, digit, sign or space."""
        kind = self.kinds.get(c)
        if kind is None:
            cut = self.bpe.library.pre_tokenizer.pre_tokenize_str
            kind = "space" if not cut(c) else "letter" if len(cut("a" + c)) == 1 else "sign" if len(cut("!" + c)) == 1 else "digit"
            self.kinds[c] = kind
        return kind

    def _agree(self, a: int, b: int) -> bool:
        """Whether merging the bytes of token ``a`` followed by those of ``b`` gives the two back."""
        known = self.agreeing.get(a << 20 | b)
        if known is None:
            (x, _), (y, ended) = self.spelling[a], self.spelling[b]
            ids = self.bpe.first[list(x + y)].tolist()
            if ended:
                ids[-1] = int(self.bpe.last[y[-1]])
            while len(ids) > 1:
                ranks = [self.rank.get(p << 20 | q, 1 << 40) for p, q in zip(ids, ids[1:])]
                best = min(ranks)
                if best == 1 << 40:
                    break
                k = ranks.index(best)
                ids[k : k + 2] = [int(self.bpe.made[best])]
            known = ids == [a, b]
            if len(self.agreeing) > _MOST_PAIRS:
                self.agreeing.clear()
            self.agreeing[a << 20 | b] = known
        return known

    def unit(self, s: bytes) -> list[int]:
        """Tokens of each prefix of a unit that ends at a code point, as a text that ends there."""
        counts, last, out = [0], [-1], []
        n, inside, closing, longest, agree = len(s), self.inside, self.closing, self.longest, self._agree
        known = self.agreeing
        for i in range(1, n + 1):
            low = max(0, i - longest)
            if i < n:
                for j in range(low, i):
                    t = inside.get(s[j:i])
                    if t is not None:
                        p = last[j]
                        ok = True if p < 0 else known.get(p << 20 | t)
                        if ok or ok is None and agree(p, t):
                            break
                counts.append(counts[j] + 1)
                last.append(t)
                if s[i] & 0xC0 == 0x80:
                    continue
            for j in range(low, i):
                t = closing.get(s[j:i])
                if t is not None:
                    p = last[j]
                    ok = True if p < 0 else known.get(p << 20 | t)
                    if ok or ok is None and agree(p, t):
                        break
            out.append(counts[j] + 1)
        return out

    def learn(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Values of many units: the short ones by the recurrences over whole arrays, the others one by one."""
        lens = np.fromiter(map(len, units), np.int64, len(units))
        points = np.fromiter((len(u) if u.isascii() else len(u.decode()) for u in units), np.int64, len(units))
        starts = np.cumsum(points) - points
        out = np.zeros(int(points.sum()), np.int32)
        short = np.flatnonzero(lens <= 40)
        short = short[np.argsort(-lens[short], kind="stable")]
        for k in range(0, len(short), 16384):
            part = short[k : k + 16384]
            self._together([units[i] for i in part.tolist()], lens[part], starts[part], out)
        for i in np.flatnonzero(lens > 40).tolist():
            out[starts[i] : starts[i] + points[i]] = self.unit(units[i])
        return out, points

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a[i], b[i] agree; a[i] < 0 (nothing before) agrees with any."""
        keys = a.astype(np.uint64) << np.uint64(20) | b.astype(np.uint64)
        known = self.agreed.find(keys)
        new = np.flatnonzero((known < 0) & (a >= 0))
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            x, y = (fresh >> np.uint64(20)).astype(np.int64), (fresh & np.uint64(0xFFFFF)).astype(np.int64)
            result = np.zeros(len(fresh), np.int32)
            for ended in (False, True):
                at = np.flatnonzero(self.ends[y] == ended)
                if len(at):
                    ids, n = self.bpe.merge_units([self.spelling[p][0] + self.spelling[q][0] for p, q in zip(x[at].tolist(), y[at].tolist(), strict=True)], ended)
                    two = np.flatnonzero(n == 2)
                    first = (np.cumsum(n) - n)[two]
                    result[at[two]] = (ids[first] == x[at[two]]) & (ids[first + 1] == y[at[two]])
            if self.agreed.n > _MOST_PAIRS:
                self.agreed = Table(18)
                self.agreed.add(fresh, result)
            else:
                self.agreed.add(fresh, result)
            known[new] = result[back]
        return (known == 1) | (a < 0)

    def _together(self, units: list[bytes], lens: np.ndarray, out_at: np.ndarray, out: np.ndarray) -> None:
        """``units`` from the longest to the shortest; their values go to ``out`` from ``out_at`` on."""
        raw = np.frombuffer(b"".join(units), np.uint8)
        start = np.cumsum(lens) - lens
        left = np.repeat(start + lens, lens) - np.arange(len(raw))  # bytes of the unit from here on
        most = int(lens[0]) if len(lens) else 0
        value, power = _VALUE[raw], _POWER
        spot = np.arange(len(raw))
        running = np.zeros(len(raw), np.uint64)
        inside, closing = [None], [None]
        for width in range(1, min(most, self.longest) + 1):
            on = left[spot] >= width
            spot, running = spot[on], running[on]
            running = running + value[spot + width - 1] * power[width - 1]
            found = self.beginnings.find(running)
            on = found >= 0
            spot, running, found = spot[on], running[on], found[on]
            if not len(spot):
                break
            for held, column in ((inside, 0), (closing, 1)):
                ids = np.full(len(raw), -1, np.int32)
                ids[spot] = self.begun[found, column]
                held.append(ids)
        width = len(inside) - 1
        counts = np.zeros((len(units), most + 1), np.int32)
        last = np.full((len(units), most + 1), -1, np.int64)
        ends_point = np.ones(len(raw) + 1, bool)
        ends_point[:-1] = (raw & 0xC0) != 0x80
        written = np.zeros(len(units), np.int64)
        for i in range(1, most + 1):
            active = int(np.searchsorted(-lens, -i, side="right"))
            stop = start[:active] + i
            at_end = ends_point[stop] | (lens[:active] == i)
            for held, who in ((closing, np.flatnonzero(at_end)), (inside, np.flatnonzero(lens[:active] > i))):
                todo = who
                for w in range(min(i, width), 0, -1):
                    t = held[w][stop[todo] - w]
                    some = np.flatnonzero(t >= 0)
                    if not len(some):
                        continue
                    u = todo[some]
                    ok = self._pairs(last[u, i - w], t[some])
                    u, t = u[ok], t[some[ok]]
                    if held is inside:
                        counts[u, i] = counts[u, i - w] + 1
                        last[u, i] = t
                    else:
                        out[out_at[u] + written[u]] = counts[u, i - w] + 1
                    rest = np.ones(len(todo), bool)
                    rest[some[ok]] = False
                    todo = todo[rest]
                    if not len(todo):
                        break
                if held is closing:
                    written[who] += 1

    # chunks outside the fast path

    def _ordinary(self, text: str) -> list[int]:
        """Counts at each code point of a text without white space, special strings taken as ordinary text."""
        normal = self.bpe.library.normalizer.normalize_str
        low = normal(text)
        if len(low) != len(text) or any(normal(c) != x for c, x in zip(text, low, strict=True)):
            return self._unsteady(text)
        out: list[int] = []
        back = {c: b for b, c in enumerate(self.bpe.chars)}
        for shown, (a, b) in self.bpe.library.pre_tokenizer.pre_tokenize_str(low):
            base = out[-1] if out else 0
            out += [base] * (a - len(out))  # white space outside ASCII
            counts = self.unit(bytes(map(back.__getitem__, shown)))
            if low[a:b] in ("'re", "'ve", "'ll"):  # its first two characters are no contraction
                counts[1] = self.unit(b"'")[-1] + self.unit(low[a + 1].encode())[-1]
            out += [base + x for x in counts]
        return out + [out[-1] if out else 0] * (len(low) - len(out))

    def _unsteady(self, text: str) -> list[int]:
        """The same where composing characters changes what was before: what follows the last sure start is taken back
        and done again, the rest stands."""
        normal, run, out = self.bpe.library.normalizer.normalize_str, Units(self), []
        start, tail, kept = 0, "", run.mark()
        for e in range(1, len(text) + 1):
            if starts_afresh(text[e - 1]):
                start, tail, kept = e - 1, "", run.mark()
            now = normal(text[start:e])
            if not now.startswith(tail):
                run.back(kept)
                tail = ""
            for c in now[len(tail) :]:
                run.add(c)
            tail = now
            out.append(run.count())
        return out

    def odd_chunk(self, chunk: bytes) -> np.ndarray:
        text = chunk.decode()
        out: list[int] = []
        plain = ""
        at = 0
        while at < len(text):
            found = [(k, -len(s), s) for s in self.bpe.special if (k := text.find(s, at)) >= 0]
            if not found:
                plain = text[at:]
                base = out[-1] if out else 0
                out += [base + x for x in self._ordinary(plain)]
                break
            k, _, s = min(found)
            plain = text[at:k]
            base = out[-1] if out else 0
            part = self._ordinary(plain + s[:-1])
            total = base + (self._ordinary(plain)[-1] if plain else 0)
            out += [base + x for x in part]
            out.append(total + 1)
            at = k + len(s)
        return np.array(out, np.int32)

    def changes(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """(stored form of each text, its token count). Stored: a byte that tells the width of an entry, then for
        each code point the signed little-endian change of the count."""
        values, size, owner, _ = self.memory.look_up(texts)
        step = np.diff(values, prepend=np.int32(0))
        heads = np.cumsum(size) - size
        if len(values):
            step[heads] = values[heads]
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        starts = (joined & 0xC0) != 0x80
        points = np.flatnonzero(starts & ~np.isin(joined, np.array([9, 10, 11, 12, 13, 32], np.uint8)))
        flat = np.zeros(len(joined), np.int32)
        flat[points] = step
        flat = flat[starts]
        lens = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 1
        ends = np.cumsum(np.add.reduceat(starts.astype(np.int64), np.cumsum(lens) - lens)) if len(texts) else lens
        small = flat.astype(np.int8)
        narrow = np.array_equal(small, flat)
        stored, at = [], 0
        for e in ends.tolist():
            if narrow or np.array_equal(small[at : e - 1], flat[at : e - 1]):
                stored.append(b"\1" + small[at : e - 1].tobytes())
            else:
                stored.append(b"\4" + flat[at : e - 1].astype("<i4").tobytes())
            at = e
        totals = np.bincount(owner, weights=step_totals(values, size), minlength=len(texts)).astype(np.int64)
        return stored, totals


def step_totals(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Last value of each run: the count of the whole unit."""
    return values[np.cumsum(size) - 1] if len(values) else np.zeros(0)


def counts_from(stored: bytes) -> np.ndarray:
    """Token count at each prefix of 0, 1, 2, ... code points."""
    kind = "<i1" if stored[:1] == b"\1" else "<i4"
    return np.r_[0, np.cumsum(np.frombuffer(stored, kind, offset=1), dtype=np.int64)]


_held: dict[str, PrefixCounts] = {}


def _for(path: str) -> PrefixCounts:
    if path not in _held:
        _held[path] = PrefixCounts(word_bpe(path))
    return _held[path]


def with_prefix_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, n_tokens long, prefix_changes binary) of every whole text."""
    df = only(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _for(tokenizer)
        for b in slices(batches, text_col, SLICE):
            texts = utf8(b.column(1))
            stored, totals = counter.changes(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(totals), pa.array(stored, pa.binary())], names=[id_col, "n_bytes", "n_tokens", "prefix_changes"])

    return df.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, prefix_changes binary")


def ask(df: DataFrame, budget: int, at: int, id_col: str = "doc_id") -> DataFrame:
    """(id, keep_chars long, tokens_at long): the longest prefix whose count is within ``budget`` tokens (NULL if there is
    none: a budget below 0), and the count of the first ``at`` code points (of the whole text if it is shorter, of
    nothing if ``at`` is negative), from the stored changes alone."""
    df = only(df, id_col, "prefix_changes")
    kind = df.schema[id_col].dataType.simpleString()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "prefix_changes"):
            counts = [counts_from(x or b"\1") for x in b.column(1).to_pylist()]
            keep = [int(np.flatnonzero(c <= budget)[-1]) if budget >= 0 else None for c in counts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keep, pa.int64()), pa.array((int(c[max(0, min(at, len(c) - 1))]) for c in counts), pa.int64())], names=[id_col, "keep_chars", "tokens_at"])

    return df.mapInArrow(answer, f"`{id_col}` {kind}, keep_chars long, tokens_at long")
