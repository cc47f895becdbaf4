"""Best-fit packing by linear grouping.

Documents become pieces of at most ``LIMIT`` tokens. As lengths are whole numbers up to the limit, the packing needs
only the count of pieces of each length. On the driver, the large lengths are dealt in descending order into groups
of equal cardinality and rounded up to the longest of their group; the few-size problem is solved over configurations
(multisets of group sizes that fit) by column generation with a knapsack for pricing; whole numbers of the best
configurations are taken; actual lengths take the place of rounded ones; what remains of the large ones and all small
ones go, from the longest on, to the sequence with the least room that holds them. The plan is a list of runs: pieces
of one length, by rank, fill so many sequences from an offset on. Its size depends on the limit, not on the data. Each
piece then finds its place from its length and its rank among pieces of that length (a distributed running count).

Defined results: a null text is empty and has the end id alone; repeated rows are separate pieces; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, only, slices, starts, utf8
from .wordbpe import word_bpe

LIMIT = 2048
#: Shares of the limit above which a piece is large, each with a number of groups; the plan of fewest sequences counts.
GROUPINGS = ((1 / 3, 100), (0.4, 80), (0.5, 80))
SLICE = 2 << 20

#: (length, first rank, sequences, pieces of it in each, first sequence, offset there)
Run = tuple[int, int, int, int, int, int]


def groups_of(counts: dict[int, int], n_groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count) from the longest on, cut into groups of equal cardinality."""
    total = sum(counts.values())
    most = -(-total // n_groups)
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = most
            n = min(left, room)
            out[-1].append((length, n))
            left -= n
            room -= n
    return out


def _knapsack(sizes: list[int], values: np.ndarray, limit: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within ``limit`` of the greatest total value."""
    best = np.zeros(limit + 1)
    used: list[np.ndarray] = []
    for s, v in zip(sizes, values, strict=True):
        top = best.copy()
        n = np.zeros(limit + 1, np.int64)
        for k in range(1, limit // s + 1):
            cand = np.full(limit + 1, -1.0)
            cand[k * s :] = best[: limit + 1 - k * s] + k * v
            up = cand > top + 1e-12
            top[up], n[up] = cand[up], k
        used.append(n)
        best = top
    counts, c = np.zeros(len(sizes)), limit
    for k in range(len(sizes) - 1, -1, -1):
        counts[k] = used[k][c]
        c -= int(counts[k]) * sizes[k]
    return float(best[limit]), counts


def configurations(sizes: list[int], demand: list[int], limit: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Linear relaxation of the few-size problem: (configuration, how often), by column generation."""
    m = len(sizes)
    basis = np.diag([float(limit // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x = inverse @ need
        price = np.ones(m) @ inverse
        value, column = _knapsack(sizes, np.maximum(price, 0), limit)
        if value <= 1 + 1e-7:
            break
        way = inverse @ column
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
    x = np.linalg.inv(basis) @ need
    return [(basis[:, k].astype(int), float(x[k])) for k in range(m)]


class _Planner:
    def __init__(self, limit: int):
        self.limit = limit
        self.runs: list[Run] = []
        self.used: dict[int, int] = {}
        self.n_bins = 0
        self.rooms: list[int] = []  # rooms that some sequence has, sorted
        self.with_room: dict[int, list[tuple[int, int]]] = {}

    def put(self, length: int, bins: int, per: int, first: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.runs.append((length, rank, bins, per, first, offset))
        self.used[length] = rank + bins * per

    def leave(self, first: int, bins: int, room: int) -> None:
        if room and bins:
            if room not in self.with_room:
                self.with_room[room] = []
                insort(self.rooms, room)
            self.with_room[room].append((first, bins))

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                per = self.limit // length
                bins = -(-count // per)
                first, room = self.n_bins, self.limit
                self.n_bins += bins
            else:
                room = self.rooms[at]
                first, bins = self.with_room[room].pop()
                if not self.with_room[room]:
                    del self.with_room[room]
                    self.rooms.pop(at)
                per = room // length
            whole = min(bins, count // per)
            if whole:
                self.put(length, whole, per, first, self.limit - room)
                self.leave(first, whole, room - per * length)
                count -= whole * per
            if whole < bins:
                if count:  # fewer than a sequence takes
                    self.put(length, 1, count, first + whole, self.limit - room)
                    self.leave(first + whole, 1, room - count * length)
                    whole, count = whole + 1, 0
                self.leave(first + whole, bins - whole, room)


def plan(counts: dict[int, int], limit: int = LIMIT, groupings: tuple[tuple[float, int], ...] = GROUPINGS) -> tuple[list[Run], int]:
    """(runs that place every piece, number of sequences) for so many pieces of each length from 1 to ``limit``."""
    return min((_plan(counts, limit, large, n) for large, n in groupings), key=lambda x: x[1])


def _plan(counts: dict[int, int], limit: int, large: float, n_groups: int) -> tuple[list[Run], int]:
    p = _Planner(limit)
    left = {k: n for k, n in counts.items() if n}
    if limit in left:  # a whole sequence each
        p.put(limit, left[limit], 1, 0, 0)
        p.n_bins = left.pop(limit)
    big = {k: n for k, n in left.items() if k > large * limit}
    if big:
        groups = groups_of(big, n_groups)
        sizes = [g[0][0] for g in groups]
        merged: dict[int, list[tuple[int, int]]] = {}
        for s, g in zip(sizes, groups, strict=True):  # groups of one rounded size are one
            merged.setdefault(s, []).extend(g)
        sizes = sorted(merged, reverse=True)
        stock = [list(merged[s]) for s in sizes]
        found = configurations(sizes, [sum(n for _, n in g) for g in stock], limit)
        for config, often in sorted(found, key=lambda c: -c[1]):
            have = [sum(n for _, n in g) for g in stock]
            bins = min([int(often + 1e-6), *(have[k] // c for k, c in enumerate(config.tolist()) if c)])
            if bins <= 0 or not config.any():
                continue
            slots = []  # for each place of the configuration, runs of actual lengths over its sequences
            for k, c in enumerate(config.tolist()):
                for _ in range(c):
                    runs, want = [], bins
                    while want:
                        length, n = stock[k][0]
                        take = min(n, want)
                        runs.append([length, take])
                        want -= take
                        stock[k][0] = (length, n - take)
                        if n == take:
                            stock[k].pop(0)
                    slots.append(runs)
            first = p.n_bins
            p.n_bins += bins
            done = 0
            while done < bins:
                step = min(r[0][1] for r in slots)
                offset = 0
                for r in slots:
                    p.put(r[0][0], step, 1, first + done, offset)
                    offset += r[0][0]
                    r[0][1] -= step
                    if not r[0][1]:
                        r.pop(0)
                p.leave(first + done, step, limit - offset)
                done += step
        for k in big:
            left[k] = 0
        for g in stock:
            for length, n in g:
                left[length] += n
    for length in sorted(left, reverse=True):
        p.best_fit(length, left[length])
    return p.runs, p.n_bins


def pieces(df: DataFrame, tokenizer: str, end_id: int, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece int, start long, length long, ids_crc32 long): each document's ids with the end id, cut at ``limit``."""
    df = only(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for b in slices(batches, text_col, SLICE):
            ids, lens = bpe.encode(utf8(b.column(1)))
            ids = np.insert(ids, np.cumsum(lens), end_id)
            lens = lens + 1
            n = -(-lens // limit)
            row = np.repeat(np.arange(len(lens)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * limit
            length = np.minimum(limit, lens[row] - start)
            raw = memoryview(ids.astype("<u4").tobytes())
            at = (np.cumsum(lens) - lens)[row] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=[id_col, "piece", "start", "length", "ids_crc32"])

    return df.mapInArrow(cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(df: DataFrame, tokenizer: str, end_id: int, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id long, offset long) of every piece."""
    cut = materialise(pieces(df, tokenizer, end_id, limit, id_col, text_col), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``limit`` rows
    runs, _ = plan(counts, limit)
    table = np.array(sorted(runs) or np.zeros((0, 6)), np.int64).reshape(-1, 6)
    key = table[:, 0] << 40 | table[:, 1]
    ranked = starts(cut.withColumn("_one", F.lit(1).cast("long")), "length", [F.col(f"`{id_col}`"), F.col("piece"), F.col("ids_crc32")], "_one", sum(counts.values()), name="_rank")
    names = [id_col, "piece", "start", "length", "ids_crc32"]
    kind = cut.schema[id_col].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            run = table[np.searchsorted(key, length << 40 | rank, side="right") - 1]
            r = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(run[:, 4] + r // run[:, 3]), pa.array(run[:, 5] + r % run[:, 3] * length)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(place, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
