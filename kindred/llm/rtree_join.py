"""N-gram Jaccard join by count vectors in an R-tree.

A document is the set of its word shingles, each a 64-bit hash (fixed seeds: shingles of equal hash count as equal).
To bring documents that may link into one place, the hash range is cut into so many groups that two sets within the
threshold must agree in some of them: sets of sizes a <= b link only if at most k = (a + b) (1 - t) / (1 + t) shingles
are in one of them alone, so of k + 1 + e groups at least e + 1 hold the same shingles in both. The digest of a
group's shingles is a key; sets that share a key are candidates. Sizes fall in classes that grow by ``STEP``; a set also takes part in classes above its own that hold a
larger partner within reach. Where many sets of one slice of texts share a key, they become candidates of each other
there and then, and one of them stands for them under the key: a hot group does not meet in one task.

Groups without a shingle, or of a common line, are held by thousands of strangers, whose pairs would grow with the
square of the texts. So a set leaves out e groups of a class at most: in order of their digests those without a shingle,
then others by the number of sets under their key. Of the e + 1 groups or more that a linked pair holds in the same way,
the last in this order is left out by neither, as the e before it would have gone first.

The shingles of a set are also hashed into coordinates; the group counts are its point: ``GROUPS`` coordinates, and
for sets of more than ``COARSE`` shingles a finer point as well, of one coordinate for every two to four shingles
(points of different fineness compare after adding coordinates up). The sets under one key (a block; keys with the
same sets make one block) form an R-tree of points. A node's largest counts bound the overlap of a set with anything
below it: the sum over coordinates of the smaller count. Nodes and points whose bound is below the overlap that the
threshold asks for are passed over. Pairs that survive join their sets to clusters (connected components over all
blocks). Clusters with large sets are searched again by the finer points. In a cluster that is left, the pairs whose
bound survives are verified on the shingles. Pairs that are connected already need no test, so blocks and clusters
give spanning forests, never all pairs.

A cluster beyond the limits of a task is cut into chunks. Chunks are first searched by themselves, then one set of
each against one of the first; what is connected then stays together in chunks of its own, and only chunks of
different components, within reach by size, meet in pairs, each pair a task of bounded size. So a large group of near
copies costs what its rows cost.

Exact copies are one set throughout. Defined results: A-Z are lower-cased; a null or wordless text has no shingles,
size 0, links with nothing and is its own component; fewer words than a shingle has make one shingle of all words;
null ids take part, and a component's id is its smallest id that is not null; repeated rows are copies; an empty
table gives an empty result; other columns are not read. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, discard, materialise, only, slices, utf8
from .components import components
from .wordbpe import _LOWER, hashes

#: Growth of size classes; coordinates of a point; shingles up to which it is the only one; points of a leaf, leaves of a node.
STEP, GROUPS, COARSE, LEAF, FANOUT = 1.35, 128, 512, 32, 8
#: Least and most bits of the bitmap of texts to fetch, which has ``SPREAD`` bits for each set at least while it may grow.
LEAST_BITS, MOST_BITS, SPREAD = 1 << 20, 1 << 27, 16
#: Sets that a task remembers; pairs that are tested at a time.
REMEMBERED, SLAB = 500_000, 1 << 14
#: Bits of a key that tell its size class.
CLASS = 0xFE
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


@dataclass(frozen=True)
class Limits:
    """What one task holds at once: sets of a block, and of a chunk of a cluster; bytes of fine points, and shingles, of
    a chunk. ``hot``: sets of one slice under a key from which one stands for all; ``common``: sets under a key up to which
    no set leaves it out."""

    hot: int = 64
    block_sets: int = 8000
    common: int = 32
    chunk_sets: int = 2500
    fine_bytes: int = 4 << 20
    shingles: int = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (one to one)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: list[bytes], k: int, salt: int = 0) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    low = _LOWER[raw]
    blank = _BLANK[raw]
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    ends = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    long = np.flatnonzero(ends - starts > 4096)
    short = np.flatnonzero(ends - starts <= 4096)
    words = np.zeros(len(starts), np.uint64)
    words[short] = hashes(low, starts[short], ends[short])
    for i in long.tolist():
        words[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    offsets = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    bounds = np.r_[0, np.searchsorted(starts, offsets)].tolist()
    if len(words) >= k:
        rolled = mix(words[: len(words) - k + 1] + _U(salt))
        for j in range(1, k):
            rolled = mix(rolled * _U(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j])
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        n = b - a
        if n >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif n:
            whole = mix(words[a : a + 1] + _U(salt + 1000 + n))
            for j in range(1, n):
                whole = mix(whole * _U(0x9E3779B97F4A7C15) + words[a + j : a + j + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Keys:
    """Candidate keys for sets that link at ``num`` / ``den`` or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.classes: list[int] = [1]
        self.edges: dict[int, np.ndarray] = {}

    def groups(self, j: int) -> tuple[int, int]:
        """(groups, weak ones that may be left out) of class j; one group: only equal sets link."""
        top = self.classes[j + 1] - 1
        k = 2 * top * (self.den - self.num) // (self.den + self.num)
        return (k + 2 + k // 8, 1 + k // 8) if k else (1, 0)

    def of(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys, with the number of their class in the bits of ``CLASS``, and how many more keys of its class may be left out."""
        n = len(s)
        while self.classes[-1] <= n * self.den // self.num + 1:
            self.classes.append(max(self.classes[-1] + 1, int(self.classes[-1] * STEP)))
        self.classes += [max(self.classes[-1] + 1, int(self.classes[-1] * STEP))]
        out, left = [], []
        total = np.r_[_U(0), np.cumsum(mix(s + _U(77)))]
        j = int(np.searchsorted(self.classes, n, side="right")) - 1
        while self.classes[j] * self.num <= n * self.den:
            m, spare = self.groups(j)
            if m > 1:
                if m not in self.edges:
                    self.edges[m] = np.array([(g << 64) // m for g in range(m)], np.uint64)
                cut = np.r_[np.searchsorted(s, self.edges[m]), n]
                size = np.diff(cut)
                digest = mix(total[cut[1:]] - total[cut[:-1]] + np.arange(m, dtype=np.uint64) * _U(0xD1B54A32D192ED03) + _U(j * 0x2545F491))
                digest = digest & ~_U(CLASS | 1) | _U(j << 1 & CLASS)
                weak = np.flatnonzero(size == 0)
                weak = weak[np.argsort(digest[weak])][:spare]
                out.append(np.delete(digest, weak))
                left.append(np.full(len(out[-1]), spare - len(weak), np.int32))
            j += 1
        self.classes.pop()
        return (np.concatenate(out), np.concatenate(left)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def places(n: int) -> int:
    """Coordinates of the finest point of a set of ``n`` shingles."""
    g = GROUPS
    while g * (COARSE // GROUPS) < n:
        g *= 2
    return g


def fold(p: np.ndarray, g: int) -> np.ndarray:
    """Points (one a row) with ``g`` coordinates, by adding up those of finer ones."""
    return p.reshape(len(p), -1, g).sum(1) if p.shape[1] > g else p


def fine_point(s: np.ndarray) -> np.ndarray:
    """Group counts of a set, as fine as its size asks for."""
    g = places(len(s))
    return np.bincount((mix(s ^ _U(0x5851F42D4C957F2D)) & _U(g - 1)).astype(np.int64), minlength=g).astype(np.int32)


def pack_point(p: np.ndarray) -> bytes:
    """A point in one byte for each coordinate, or two or four where a count needs them."""
    top = p.max(initial=0)
    return p.astype(np.uint8 if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def unpack_point(packed: bytes, g: int) -> np.ndarray:
    return np.frombuffer(packed, {1: np.uint8, 2: "<u2", 4: "<u4"}[len(packed) // g]).astype(np.int32)


def unpack_points(packed: list[bytes], g: int = GROUPS) -> np.ndarray:
    if all(len(b) == g for b in packed):
        return np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), g).astype(np.int32)
    return np.array([unpack_point(b, g) for b in packed], np.int32).reshape(len(packed), g)


class RTree:
    """Points in leaves of near ones (cut at the median of the widest coordinate), leaves in inner nodes."""

    def __init__(self, at: np.ndarray, sizes: np.ndarray):
        self.at, self.sizes = at, sizes
        self.leaves: list[np.ndarray] = []
        stack = [np.arange(len(at))]
        while stack:
            own = stack.pop()
            if len(own) <= LEAF:
                self.leaves.append(own)
                continue
            axis = int(np.argmax(at[own].var(0)))
            order = own[np.argsort(at[own, axis], kind="stable")]
            stack += [order[len(order) // 2 :], order[: len(order) // 2]]
        self.high = np.array([at[x].max(0) for x in self.leaves])
        self.least = np.array([sizes[x].min() for x in self.leaves])
        self.most = np.array([sizes[x].max() for x in self.leaves])

    def near(self, q: np.ndarray, sizes: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, point numbers) whose bound reaches the overlap that the threshold asks for."""
        step = max(8, (1 << 22) // (q.shape[1] * LEAF))

        def reach(which: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
            n = sizes[which]
            fits = (n[:, None] * den >= least * num) & (most * den >= n[:, None] * num)
            bound = np.minimum(q[which][:, None, :], high[None]).sum(2) if fits.any() else np.zeros(fits.shape)
            lower = np.maximum(least, -(-n[:, None] * num // den))  # no partner is smaller
            return fits & (bound * (num + den) >= (n[:, None] + lower) * num)

        for a in range(0, len(self.leaves), FANOUT):
            part = slice(a, a + FANOUT)
            inner = self.high[part].max(0)[None], self.least[part].min()[None], self.most[part].max()[None]
            for at in range(0, len(q), step):
                who = np.arange(at, min(len(q), at + step))
                who = who[reach(who, *inner)[:, 0]]
                if not len(who):
                    continue
                hit = reach(who, self.high[part], self.least[part], self.most[part])
                for k in np.flatnonzero(hit.any(0)):
                    leaf = self.leaves[a + k]
                    some = who[hit[:, k]]
                    own = self.sizes[leaf]
                    x, y = np.nonzero(reach(some, self.at[leaf], own, own))
                    if len(x):
                        yield some[x], leaf[y]


class Forest:
    """Union-find over any numbers; forgets all when it holds too many, or hands out what it knew if it ``keeps``."""

    def __init__(self, most: int = 1_000_000, keeps: bool = False):
        self.up: dict[int, int] = {}
        self.most, self.keeps = most, keeps
        self.known: list[tuple[int, int]] = []

    def stars(self) -> list[tuple[int, int]]:
        """Edges from the least number of each component to its others, so that tasks that see the same give the same."""
        out = self.known + [(self.find(x), x) for x in self.up if self.up[x] != x]
        self.up.clear()
        self.known = []
        return out

    def find(self, x: int) -> int:
        up = self.up
        top = up.setdefault(x, x)
        while up[top] != top:
            up[top] = top = up[up[top]]
        return top

    def joins(self, x: int, y: int) -> bool:
        """Connect two; False: they were connected."""
        if len(self.up) > self.most:
            self.known = self.stars() if self.keeps else []
            self.up.clear()
        p, q = self.find(x), self.find(y)
        if p == q:
            return False
        self.up[max(p, q)] = min(p, q)
        return True


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def candidates(fine: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the pairs whose bound reaches the threshold, on the coarser of both points; ``left``: of which side each
    set is; only pairs from both sides (all left: all pairs, once)."""
    level = np.fromiter(map(len, fine), np.int64, len(fine))
    within = bool(left.all())
    for g in np.unique(level):
        for own, other, again in [(left, left, True)] if within else [(left, ~left, True), (~left, left, False)]:
            q = np.flatnonzero(own & (level == g))
            if not len(q):
                continue
            top, low = sizes[q].max(), sizes[q].min()
            t = np.flatnonzero(other & ((level >= g) if again else (level > g)) & (sizes * num <= top * den) & (sizes * den >= low * num))
            if not len(t):
                continue
            tree = RTree(np.concatenate([fold(fine[k][None], g) for k in t.tolist()]), sizes[t])
            for x, y in tree.near(np.stack([fine[k] for k in q.tolist()]), sizes[q], num, den):
                i, j = q[x], t[y]
                if within:
                    once = (level[j] > g) | (i < j)
                    i, j = i[once], j[once]
                yield i, j


def near_pairs(nodes: list[int], fine: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, num: int, den: int, forest: Forest) -> list[tuple[int, int]]:
    """Pairs of nodes that pass the bound and that the forest had not connected."""
    out = []
    for i, j in candidates(fine, sizes, left, num, den):
        out += [(nodes[x], nodes[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.joins(nodes[x], nodes[y])]
    return out


def links(nodes: list[int], sets: list[np.ndarray], left: np.ndarray, num: int, den: int, forest: Forest) -> list[tuple[int, int]]:
    """Linked pairs of nodes that the forest had not connected; sides as in :func:`candidates`."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = []
    for i, j in candidates([fine_point(s) for s in sets], sizes, left, num, den):
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if forest.find(nodes[x]) != forest.find(nodes[y]):
                common = overlap(sets[x], sets[y])
                if common * den >= num * (len(sets[x]) + len(sets[y]) - common) and forest.joins(nodes[x], nodes[y]):
                    out.append((nodes[x], nodes[y]))
    return out


def stand_in(keys: np.ndarray, nodes: np.ndarray, left: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (key, node, left) of a slice, where the least node stands for the others under keys of ``hot`` nodes or more;
    nodes with such a key leave none out, as the keys under which others stand for them do not count; rows of an odd key say that its nodes are to be in one cluster untested."""
    keys = keys & ~_U(1)
    order = np.lexsort((nodes, keys))
    k, v, e = keys[order], nodes[order], left[order]
    opens = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    first = np.flatnonzero(opens)
    size = np.diff(np.r_[first, len(k)])
    many = np.repeat(size >= hot, size)
    if not many.any():
        return keys, nodes, left
    pairs = np.unique(np.stack([np.repeat(v[first], size)[many], v[many]]), axis=1)
    own = mix(pairs[0].view(_U) ^ mix(np.bitwise_xor.reduce(np.unique(nodes).view(_U))[None] + _U(5))) | _U(1)
    stays = ~many | opens
    return np.r_[k[stays], own], np.r_[v[stays], pairs[1]], np.r_[np.where(np.isin(v, v[many]), 0, e)[stays], np.zeros(len(own), np.int32)].astype(np.int32)


#: Columns of blocks: those of ``common`` sets or more are rows of a key with what their sets may leave out, before they are blocks.
BLOCKS = "x long, y long, sure boolean, nodes array<long>, key long, lefts array<int>"


def blocks_of(batches: Iterator[pa.RecordBatch], most: int, common: int | None = None) -> Iterator[pa.RecordBatch]:
    """Blocks of two sets or more from rows (key, node, left) sorted by all; x and y stand for the sets of a block. Sets of an
    odd key, or of one with more than ``most`` sets, are sure: one cluster, untested, in parts that share a set. With
    ``common`` an even key of more sets than that keeps its name and its sets theirs, in parts that share none."""

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))

    def out(k: np.ndarray, v: np.ndarray, e: np.ndarray, large: int | None) -> Iterator[pa.RecordBatch]:
        opens = np.r_[True, k[1:] != k[:-1]]
        first = np.flatnonzero(opens)
        size = np.diff(np.r_[first, len(k)])
        h = v.view(_U)
        x, y = np.add.reduceat(mix(h + _U(1)), first), np.add.reduceat(mix(h ^ _U(0xA5A5A5A5A5A5A5A5)), first)
        odd = (k[first] & 1).astype(bool)
        again = ~odd & ((size > common) | (k[first] == large if large is not None else False)) if common is not None else np.zeros(len(size), bool)
        some = (size > 1) | again
        sure = odd | (k[first] == large if large is not None else False)
        kept = np.repeat(some, size)
        named = np.where(again, size, 0)[some]
        yield pa.RecordBatch.from_arrays([pa.array(x[some].view(np.int64)), pa.array(y[some].view(np.int64)), pa.array((sure & ~again)[some]), lists(v[kept], size[some]), pa.array(k[first][some], mask=~again[some]), lists(e[np.repeat(again, size)], named)], names=["x", "y", "sure", "nodes", "key", "lefts"])

    k = v = np.zeros(0, np.int64)
    e = np.zeros(0, np.int32)
    large = None
    for b in batches:
        k, v, e = np.r_[k, b.column(0).to_numpy()], np.r_[v, b.column(1).to_numpy()], np.r_[e, b.column(2).to_numpy()]
        new = np.r_[True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])] if len(k) else np.zeros(0, bool)
        k, v, e = k[new], v[new], e[new]
        at = int(np.searchsorted(k, k[-1])) if len(k) else 0
        if at:
            yield from out(k[:at], v[:at], e[:at], large)
            k, v, e = k[at:], v[at:], e[at:]
        if len(k) > most:
            large = int(k[0])
            stop = len(k) - (common is not None and not large & 1)  # the last set opens the next part, or is shared with it
            yield from out(k[:stop], v[:stop], e[:stop], large)
            k, v, e = k[-1:], v[-1:], e[-1:]
    if len(k):
        yield from out(k, v, e, large)


def without_common(rows: DataFrame) -> DataFrame:
    """Rows (key, node, left) without those that a set leaves out: of each class the first ``left`` keys, by the sets under them."""
    counted = rows.groupBy("key").agg(F.count("*").alias("held"))
    order = Window.partitionBy("node", F.col("key").bitwiseAND(CLASS)).orderBy(F.desc("held"), "key")
    return rows.join(counted, "key").withColumn("nth", F.row_number().over(order)).filter("nth > left").select("key", "node", "left")


def bounded(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[list[tuple[int, int]]]:
    """Stars of the components that the pairs within each block (rows x, y, node, n, point, sorted by x and y) make whose
    bound reaches the threshold. Blocks that are connected already are passed over; those of a leaf at most are tested
    many at a time."""
    forest = Forest(keeps=True)
    held: pa.Table | None = None

    def apart(nodes: np.ndarray) -> np.ndarray:
        """Which blocks (a row each) are not in one component yet."""
        find = forest.find
        top = np.fromiter(map(find, nodes.ravel().tolist()), np.int64, nodes.size).reshape(nodes.shape)
        return (top != top[:, :1]).any(1)

    def run(table: pa.Table) -> None:
        x, y, node, n = (table.column(k).to_numpy() for k in range(4))
        packed = table.column(4).to_pylist()
        small = all(len(b) == GROUPS for b in packed)
        at = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, GROUPS) if small else unpack_points(packed)
        first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        size = np.diff(np.r_[first, len(x)])
        for g in np.unique(size[size > 1]).tolist():
            start = first[size == g]
            if g > LEAF:
                for a in start.tolist():
                    own = slice(a, a + g)
                    if apart(node[own][None])[0]:
                        near_pairs(node[own].tolist(), list(at[own].astype(np.int32)), n[own], np.ones(g, bool), num, den, forest)
                continue
            p, q = np.triu_indices(g, 1)
            step = max(1, SLAB // len(p))
            for a in range(0, len(start), step):
                some = start[a : a + step]
                some = some[apart(node[some[:, None] + np.arange(g)])]
                u, w = (some[:, None] + p).ravel(), (some[:, None] + q).ravel()
                fits = (n[u] * den >= n[w] * num) & (n[w] * den >= n[u] * num)
                u, w = u[fits], w[fits]
                ok = np.minimum(at[u], at[w]).sum(1, dtype=np.int64) * (num + den) >= (n[u] + n[w]) * num
                for e in zip(node[u[ok]].tolist(), node[w[ok]].tolist(), strict=True):
                    forest.joins(*e)

    for b in batches:
        table = pa.Table.from_batches([b])
        held = table if held is None else pa.concat_tables([held, table])
        x, y = held.column(0).to_numpy(), held.column(1).to_numpy()
        last = np.flatnonzero((x != x[-1]) | (y != y[-1])) if len(x) else ()
        if len(last):
            done = int(last[-1]) + 1
            run(held.slice(0, done))
            held = held.slice(done)
            if forest.known or len(forest.up) > forest.most:
                yield forest.stars()
    if held is not None and held.num_rows:
        run(held)
    yield forest.stars()


def pairs_out(found: Iterator[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes in batches."""
    held: list[tuple[int, int]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.int64()), pa.array([y for _, y in held], pa.int64())], names=["a", "b"])

    for pairs in found:
        held += pairs
        if len(held) > 10_000:
            yield batch()
            held = []
    yield batch()


Work = Callable[[list, list, np.ndarray, np.ndarray, Forest], list[tuple[int, int]]]


def dealt(tiles: DataFrame, work: Work) -> DataFrame:
    """Edges (a, b) that ``work(nodes, payloads, sizes, left, forest)`` finds in each tile of (tile, left, node, n, payload); one tile is
    held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list[tuple[int, int]]]:
            forest, at, group = Forest(), None, {}

            def flush() -> list[tuple[int, int]]:
                nodes = list(group)
                left = np.array([group[x][0] for x in nodes], bool)
                return work(nodes, [group[x][2] for x in nodes], np.array([group[x][1] for x in nodes], np.int64), left, forest) if len(nodes) > 1 and left.any() else []

            for b in batches:
                for tile, left, node, n, payload in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                    if tile != at:
                        yield flush()
                        at, group = tile, {}
                    group.setdefault(node, (left, n, payload))
            yield flush()

        return pairs_out(found())

    dealt = tiles.select("tile", "left", "node", "n", "payload").repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(run, "a long, b long")


def bits_for(n: int) -> int:
    """Bits of a bitmap for ``n`` keys, a power of two; 0 where the largest would let most keys through."""
    bits = max(LEAST_BITS, 1 << (SPREAD * n - 1).bit_length())
    return min(bits, MOST_BITS) if n * 2 <= MOST_BITS else 0


def chunks(most_sets: int, most_weight: int):
    """Chunks that the rows of a group need."""
    return F.greatest(F.ceil(F.count("*") / most_sets), F.ceil(F.sum("weight") / most_weight)).cast("int")


def searched(members: DataFrame, work: Work, most_sets: int, most_weight: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) among the sets of each cluster, from a written table (cluster, node, n, weight, payload)."""
    c = members.groupBy("cluster").agg(chunks(most_sets, most_weight).alias("c"))
    placed = members.join(c, "cluster").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
    inside = materialise(dealt(placed.withColumns({"tile": F.xxhash64("cluster", "chunk"), "left": F.lit(True)}), work), "inside")
    large = c.filter("c > 1")
    if not large.head(1):
        return inside

    # of each chunk the least set of its largest component, against that of the first chunk
    def labelled(edges: DataFrame) -> DataFrame:
        return some.join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))

    some = materialise(placed.filter("c > 1").select("cluster", "node", "n", "weight", "chunk", "c"), "large")
    counted = labelled(inside).groupBy("cluster", "c", "chunk", "label").agg(F.count("*").alias("k"), F.min("node").alias("node"))
    chosen = counted.groupBy("cluster", "c", "chunk").agg(F.max(F.struct("k", "label", "node")).alias("x")).select("cluster", "chunk", F.col("x.node").alias("node"), F.ceil(F.col("c") / 512).cast("int").alias("g"))
    group = F.explode(F.when(F.col("chunk") == 0, F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array(F.floor(F.col("chunk") / 512).cast("int"))))
    heads = members.select("node", "n", "payload").join(chosen, "node").withColumn("tile", group).withColumns({"tile": F.xxhash64("cluster", "tile"), "left": F.lit(True)})
    across = materialise(dealt(heads, work), "across")

    # chunks of one component each, the rest by size; pairs of chunks that may hold links between components
    both = inside.unionByName(across)
    rows = materialise(labelled(both).select("cluster", "node", "n", "weight", "label"), "labelled")
    own = rows.groupBy("cluster", "label").agg(F.count("*").alias("k"), F.sum("weight").alias("w"))
    own = own.select("cluster", "label", ((F.col("k") * 2 >= most_sets) | (F.col("w") * 2 >= most_weight)).alias("pure"))
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)))
    rows = rows.join(own, ["cluster", "label"]).withColumn("part", F.when(F.col("pure"), F.col("label")).otherwise(size))
    parts = rows.groupBy("cluster", "pure", "part").agg(chunks(most_sets, most_weight).alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    parts = materialise(parts.withColumn("at", F.struct("pure", "part")), "parts")
    rows = materialise(rows.withColumn("at", F.struct("pure", "part")).select("cluster", "node", "at"), "rows")
    p, q = (parts.select("cluster", F.struct("at", "c", "lo", "hi").alias(x)) for x in "pq")
    reach = (F.col("p.hi") * den >= F.col("q.lo") * num) & (F.col("q.hi") * den >= F.col("p.lo") * num)
    pairs = p.join(q, "cluster").filter(reach & ~((F.col("p.at") == F.col("q.at")) & F.col("p.at.pure")))
    pairs = pairs.select("cluster", F.col("p.at").alias("at"), F.col("p.c").alias("c"), F.col("q.at").alias("met"), F.col("q.c").alias("other"))
    tiles = rows.join(pairs, ["cluster", "at"]).join(members.select("node", "n", "payload"), "node")
    tiles = tiles.withColumns({"chunk": F.pmod(F.xxhash64("node"), F.col("c")), "o": F.explode(F.sequence(F.lit(0).cast("long"), F.col("other").cast("long") - 1))})
    me, it = F.struct("at", "chunk"), F.struct(F.col("met").alias("at"), F.col("o").alias("chunk"))
    tiles = tiles.withColumns({"tile": F.xxhash64("cluster", F.least(me, it), F.greatest(me, it)), "left": me <= it})
    return both.unionByName(materialise(dealt(tiles, work), "pairs"))


def classes(df: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", salt: int = 0, limits: Limits = Limits()) -> DataFrame:
    """(id, text_key long, n_shingles long, component_id) of every row; text_key is a hash of the text."""
    df = only(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(col(text_col), F.lit(""))
    docs = df.select(col(id_col).alias("_id"), F.xxhash64(text).alias("text_key"), text.alias("_text"))

    def digest(s: np.ndarray) -> tuple[int, int]:
        d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
        return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)

    def size_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", 2 << 20):
            sets = shingle_sets(utf8(b.column(2)), k, salt)
            named = [digest(s) if len(s) else (None, None) for s in sets]
            fine = [fine_point(s) for s in sets]
            point = [pack_point(fold(p[None], GROUPS)[0]) for p in fine]
            more = [pack_point(p) if len(p) > GROUPS else None for p in fine]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in named], pa.int64()), pa.array([x for _, x in named], pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(point, pa.binary()), pa.array(more, pa.binary())], names=["_id", "text_key", "node", "check", "n_shingles", "point", "fine"])

    made = docs.mapInArrow(size_up, f"_id {kind}, text_key long, node long, check long, n_shingles long, point binary, fine binary")
    rows = materialise(made, "sets")
    best = F.min(F.struct("text_key", "_id")).alias("of")
    sets = rows.filter("node is not null").groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi"), best, F.min("_id").alias("least"), F.min("n_shingles").alias("n"), F.min("point").alias("point"), F.min("fine").alias("fine"))
    sets = materialise(sets, "nodes")
    if sets.filter("lo <> hi").head(1):  # two sets under one number: hash again
        discard(rows, sets)
        return classes(df, k, num, den, id_col, text_col, salt + 1, limits)

    def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seen = Keys(num, den), set()
        for b in slices(batches, "_text", 2 << 20):
            own, found, left = [], [], []
            for s in shingle_sets(utf8(b.column(0)), k, salt):
                if len(s):
                    node = digest(s)[0]
                    if node not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(node)
                        own.append(node)
                        for x, to in zip(keys.of(s), (found, left), strict=True):
                            to.append(x)
            flat, lefts = (np.concatenate(found), np.concatenate(left)) if found else (np.zeros(0, _U), np.zeros(0, np.int32))
            nodes = np.repeat(np.array(own, np.int64), [len(f) for f in found]) if own else np.zeros(0, np.int64)
            flat, nodes, lefts = stand_in(flat, nodes, lefts, limits.hot)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(nodes), pa.array(lefts)], names=["key", "node", "left"])

    def blocked(rows: DataFrame, common: int | None) -> DataFrame:
        dealt = rows.repartition("key").sortWithinPartitions("key", "node", "left")
        return dealt.mapInArrow(lambda batches: blocks_of(batches, limits.block_sets, common), BLOCKS)

    # keys of two sets or more; common ones again, without the sets that leave them out; the same sets under several keys are one block
    keyed = docs.select("_text").mapInArrow(send_keys, "key long, node long, left int")
    first = materialise(blocked(keyed, limits.common), "blocks")
    shared = first.filter("key is not null").select("key", F.explode(F.arrays_zip("nodes", "lefts")).alias("z")).select("key", F.col("z.nodes").alias("node"), F.col("z.lefts").alias("left"))
    again = materialise(blocked(without_common(shared), None), "blocks")
    blocks = first.filter("key is null").unionByName(again)
    sure = blocks.filter("sure").select(F.col("nodes")[0].alias("a"), F.explode("nodes").alias("b")).filter("a <> b")
    member = blocks.filter("not sure").dropDuplicates(["x", "y"]).select("x", "y", F.explode("nodes").alias("node"))
    pointed = member.join(sets.select("node", "n", "point"), "node").select("x", "y", "node", "n", "point").repartition("x", "y").sortWithinPartitions("x", "y")
    near = materialise(pointed.mapInArrow(lambda batches: pairs_out(bounded(batches, num, den)), "a long, b long").unionByName(sure), "near")
    discard(first, again)
    clusters = components(near).join(sets.select("node", "n", "fine", "of"), "node").withColumnRenamed("label", "cluster")
    clusters = materialise(clusters, "clusters")
    discard(near)

    # clusters with large sets once more, by finer points
    mixed = clusters.groupBy("cluster").agg((F.max("n") > COARSE).alias("large"))
    wide = clusters.join(mixed.filter("large"), "cluster").join(sets.select("node", "point"), "node")
    wide = materialise(wide.select("cluster", "node", "n", F.coalesce("fine", "point").alias("payload")).withColumn("weight", F.length("payload")), "wide")

    def by_points(nodes: list, payloads: list, sizes: np.ndarray, left: np.ndarray, forest: Forest) -> list[tuple[int, int]]:
        return near_pairs(nodes, [unpack_point(p, places(n)) for p, n in zip(payloads, sizes.tolist(), strict=True)], sizes, left, num, den, forest)

    plain = clusters.join(mixed.filter("not large"), "cluster").select("node", "cluster")
    if wide.head(1):
        finer = components(searched(wide, by_points, limits.chunk_sets, limits.fine_bytes, num, den))
        plain = plain.unionByName(finer.select("node", F.col("label").alias("cluster")))
    joined = plain.join(clusters.drop("cluster", "fine"), "node")
    joined = materialise(joined.select("node", "cluster", "n", F.col("of.text_key").alias("_key"), F.col("of._id").alias("_of")), "members")
    discard(wide, clusters)

    # a bitmap sized by the count lets most other texts go before the join; what it lets through by chance the join
    # drops, and so it drops all of them where there are too many sets for a bitmap
    bits = bits_for(joined.count())
    bitmap = np.zeros(bits // 32, np.uint32)
    if bits:
        bit = [F.col("_key").bitwiseAND(bits - 1), F.shiftrightunsigned("_key", 32).bitwiseAND(bits - 1)]
        placed = joined.select(F.explode(F.array(*bit)).alias("p")).groupBy(F.shiftrightunsigned("p", 5).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 31 as int)))").alias("v"))
        words = placed.toArrow()  # at most MOST_BITS / 32 rows
        bitmap[words.column("w").to_numpy()] = words.column("v").to_numpy().astype(np.uint32)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(1).to_numpy().view(_U)
            ok = np.ones(len(key), bool)
            for p in (key & _U(bits - 1), key >> _U(32) & _U(bits - 1)):
                ok &= (bitmap[(p >> _U(5)).astype(np.int64)] >> (p & _U(31)).astype(np.uint32) & 1).astype(bool)
            yield b.filter(pa.array(ok))

    # one text of each set; a copy may come with it and falls out in the task
    held = docs.mapInArrow(wanted, docs.schema) if bits else docs
    held = held.join(joined, (F.col("text_key") == F.col("_key")) & F.col("_id").eqNullSafe(F.col("_of")))
    held = materialise(held.select("cluster", "node", "n", F.col("n").alias("weight"), F.col("_text").alias("payload")), "held")
    discard(joined)

    def by_shingles(nodes: list, payloads: list, sizes: np.ndarray, left: np.ndarray, forest: Forest) -> list[tuple[int, int]]:
        return links(nodes, shingle_sets([t.encode() for t in payloads], k, salt), left, num, den, forest)

    linked = components(searched(held, by_shingles, limits.chunk_sets, limits.shingles, num, den))
    discard(held)
    least = linked.join(sets.select("node", "least"), "node").groupBy("label").agg(F.min("least").alias("least"))
    named = sets.select("node", F.col("least").alias("own")).join(linked, "node", "left").join(least, "label", "left")
    named = named.select("node", F.when(F.col("label").isNull(), F.col("own")).otherwise(F.col("least")).alias("least"))
    out = rows.join(named, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("least")))
    return out.select(F.col("_id").alias(id_col), "text_key", "n_shingles", "component_id")


def keep_one(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``df``, all their columns, that have the smallest id of their group (no words: every row), one each.

    Of several rows with that id, the one of smallest text hash stays; of rows equal in id and text, any one. Rows without
    words all stay, null texts included. Columns may have any names."""
    found = materialise(classes(only(df, id_col, text_col).toDF("id", "text"), k, num, den, "id", "text", limits=limits), "classes")
    first = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "text_key"))
    chosen = found.filter("n_shingles > 0").groupBy("component_id").agg(first.alias("x")).select(F.col("x.id").alias("_id"), F.col("x.text_key").alias("_key"))
    text = F.coalesce(col(text_col), F.lit(""))
    tagged = df.select(F.struct(*[col(n) for n in df.columns]).alias("row"), col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    worded = tagged.join(chosen, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left_semi")
    if found.filter("n_shingles > 0").groupBy("id", "text_key").count().filter("count > 1").head(1):
        worded = worded.dropDuplicates(["id", "key"])
    if found.filter("n_shingles = 0").head(1):
        worded = worded.unionByName(tagged.filter(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) == 0))
    return worded.select("row.*")
