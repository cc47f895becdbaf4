"""Benchmark decontamination with an FM-index for each shard of the documents.

A shard is a slice of documents of bounded bytes. Its words are numbered, every text ends with a sign of its own, and
the sequence is sorted by suffixes (prefix doubling that sorts only what is still tied). The last column of the sorted
rotations is kept as a wavelet matrix, whose ranks answer backward search: from the last word of a phrase to its first,
the rows that start with it stay one interval. Every ``RATE``-th position of the sequence keeps its row's position;
other rows walk back to such a row, one word at a time. Texts that occur several times in a shard are indexed once.

``index`` gives one row for each shard, ``search`` looks phrases up in it. Phrases of a benchmark are the windows of
``window`` consecutive words of its items (an item of fewer words is one window). They are searched in blocks of
bounded size, every block against every shard; with more than one block the index is written to the shared folder
first, so that it is built once. The words of all occurrences are merged into spans.

Defined results: A-Z are lower-cased; words are runs of letters, digits and characters outside ASCII; a null or wordless
text has no words, no hits and no span; an item without words has no window; repeated items and rows count by
themselves, items of one id as one; a null item id is not listed; other columns are not read; an empty table gives an
empty result, an empty benchmark no hits. Texts are read whole: one that is longer than a shard is indexed in pieces
that share the words that a window may cross. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import col, discard, materialise, slices, utf8
from .lexical import LEXICAL_WORD, split, word_hashes

#: Bytes of text of a shard, about; positions between sampled ones; words of a piece of a text; words of a window.
SHARD, RATE, PIECE, WINDOW = 4 << 20, 16, 1 << 20, 10
#: Windows that are searched at a time.
BLOCK = 200_000


def suffix_order(x: np.ndarray) -> np.ndarray:
    """Positions of ``x`` in the order of their suffixes; the last sign must occur once and be the smallest.

    Several signs are packed into the first key; then each round sorts the tied suffixes by the rank of what follows."""
    n = len(x)
    bits = max(1, int(x.max()).bit_length())
    k = max(1, min(n, 62 // bits))
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= bits
        key[: n - j] |= x[j:]
    order = np.argsort(key)
    new = np.r_[True, np.diff(key[order]) != 0]
    rank = np.empty(n, np.int64)
    at = np.flatnonzero(new)
    rank[order] = np.repeat(at, np.diff(np.r_[at, n]))
    tied = np.flatnonzero(~(new & np.r_[new[1:], True]))  # rows of groups of more than one
    width = k
    while len(tied):
        own = order[tied]
        group = rank[own]
        after = own + width
        key = group * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        key, own = key[by], own[by]
        # groups lie in ascending order, so the sorted rows of all groups fill their old places in turn
        order[tied] = own
        new = np.r_[True, np.diff(key) != 0]
        at = np.flatnonzero(new)
        rank[own] = np.repeat(tied[at], np.diff(np.r_[at, len(own)]))
        tied = tied[~(new & np.r_[new[1:], True])]
        width *= 2
    return order


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words))].astype(np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = at >> 6
        return self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class Wavelet:
    """Wavelet matrix: one bit vector a level from the highest bit down, zeros before ones for the next level."""

    def __init__(self, x: np.ndarray):
        self.levels, self.zeros = [], []
        self.depth = max(1, int(x.max()).bit_length()) if len(x) else 1
        x = x.astype(np.uint32)
        for level in range(self.depth - 1, -1, -1):
            one = (x >> np.uint32(level) & np.uint32(1)).astype(bool)
            self.levels.append(Bits(one))
            below = x[~one]
            self.zeros.append(len(below))
            x = np.concatenate([below, x[one]])

    def rank(self, sign: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each sign stands before its place."""
        low = np.zeros(len(at), np.int64)
        for level, bits, zeros in zip(range(self.depth - 1, -1, -1), self.levels, self.zeros, strict=True):
            one = (sign >> level & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(at)
            low = np.where(one, zeros + a, low - a)
            at = np.where(one, zeros + b, at - b)
        return at - low

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sign at each place, how often it stands before)."""
        sign, low = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(at)
            sign = sign << 1 | one
            a, b = bits.rank(low), bits.rank(at)
            low = np.where(one == 1, zeros + a, low - a)
            at = np.where(one == 1, zeros + b, at - b)
        return sign, at - low


@dataclass
class Shard:
    """FM-index of texts given as 64-bit word hashes. Signs: 0 for the end of all, then one for the end of each text, then words."""

    vocabulary: np.ndarray
    column: Wavelet
    first: np.ndarray
    marked: Bits
    positions: np.ndarray
    starts: np.ndarray

    @classmethod
    def build(cls, words: list[np.ndarray], rate: int = RATE) -> Shard:
        n = len(words)
        vocabulary, ids = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]), return_inverse=True)
        lens = np.fromiter(map(len, words), np.int64, n)
        starts = np.cumsum(lens + 1) - lens - 1
        x = np.zeros(int(lens.sum()) + n + 1, np.int64)
        inside = np.ones(len(x), bool)
        inside[starts + lens] = inside[-1] = False
        x[inside] = ids + n + 1
        x[starts + lens] = np.arange(1, n + 1)
        order = suffix_order(x)
        column = x[order - 1]  # the row of the first position has the last sign before it
        kept = order % rate == 0
        counts = np.bincount(x, minlength=len(vocabulary) + n + 1)
        return cls(vocabulary, Wavelet(column), np.r_[0, np.cumsum(counts)], Bits(kept), order[kept].astype(np.uint32), starts)

    def find(self, phrases: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) that start with each phrase: a row of word hashes of which the first ``lens`` count."""
        n_texts = len(self.starts)
        low, high = np.zeros(len(lens), np.int64), np.full(len(lens), self.first[-1])
        if not len(self.vocabulary):
            return low, low
        at = np.minimum(np.searchsorted(self.vocabulary, phrases), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == phrases
        known |= np.arange(phrases.shape[1]) >= lens[:, None]
        live = np.flatnonzero(known.all(1))
        high[~known.all(1)] = 0
        sign = at + n_texts + 1
        for j in range(phrases.shape[1] - 1, -1, -1):
            on = live[(lens[live] > j) & (low[live] < high[live])]
            s = sign[on, j]
            both = self.column.rank(np.r_[s, s], np.r_[low[on], high[on]])
            low[on] = self.first[s] + both[: len(on)]
            high[on] = self.first[s] + both[len(on) :]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position of each row: steps back to the next row whose position is kept."""
        out = np.zeros(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            here = self.marked.get(at) == 1
            out[left[here]] = self.positions[self.marked.rank(at[here])] + steps
            left, at = left[~here], at[~here]
            sign, before = self.column.get(at)
            at = self.first[sign] + before
            steps += 1
        return out

    def dump(self) -> bytes:
        arrays = [self.vocabulary, self.first, self.positions, self.starts, self.marked.words, *(b.words for b in self.column.levels)]
        head = np.array([len(arrays), self.column.depth, *(a.nbytes for a in arrays), *self.column.zeros], "<i8")
        return b"".join([head.tobytes(), *(a.tobytes() for a in arrays)])

    @classmethod
    def load(cls, data: bytes) -> Shard:
        n, depth = np.frombuffer(data, "<i8", 2).tolist()
        head = np.frombuffer(data, "<i8", n + depth, 16).tolist()
        at = 16 + 8 * (n + depth)
        kinds = ["<u8", "<i8", "<u4", "<i8", *["<u8"] * (n - 4)]
        arrays = []
        for size, kind in zip(head[:n], kinds, strict=True):
            arrays.append(np.frombuffer(data, kind, size // int(kind[2]), at))
            at += size
        column = Wavelet(np.zeros(0, np.uint32))
        column.depth, column.zeros, column.levels = depth, head[n:], [_bits(a) for a in arrays[5:]]
        return cls(arrays[0], column, arrays[1], _bits(arrays[4]), arrays[2], arrays[3])


def _bits(words: np.ndarray) -> Bits:
    out = Bits.__new__(Bits)
    out.words, out.before = words, np.r_[0, np.cumsum(np.bitwise_count(words))].astype(np.uint32)
    return out


def _spans(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge spans of each owner that overlap or touch."""
    by = np.lexsort((start, owner))
    owner, start, stop = owner[by], start[by], stop[by]
    if not len(by):
        return owner, start, stop
    far = int(stop.max()) + 1
    reach = np.maximum.accumulate(owner * far + stop)
    new = np.r_[True, owner[1:] * far + start[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return owner[at], start[at], reach[np.r_[at[1:] - 1, len(by) - 1]] - owner[at] * far


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD, rate: int = RATE, piece: int = PIECE, overlap: int = WINDOW - 1) -> DataFrame:
    """One row for each shard: (shard, ids, n_words, text_no, pieces, data).

    ``ids`` and ``n_words`` have an entry for each row of the table, ``text_no`` says which distinct text it has, and
    ``pieces`` gives for each indexed text (its distinct text, the word at which it starts)."""
    kind = df.select(col(id_col)).schema[0].dataType
    schema = StructType([
        StructField("shard", StringType()), StructField("ids", ArrayType(kind)), StructField("n_words", ArrayType(LongType())),
        StructField("text_no", ArrayType(IntegerType())), StructField("pieces", ArrayType(LongType())), StructField("data", BinaryType()),
    ])
    rows = df.select(col(text_col).alias("text"), col(id_col).alias("id"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for b in slices(batches, "text", shard_bytes):
            raw = utf8(b.column(0))
            seen: dict[bytes, int] = {}
            text_no = [seen.setdefault(t, len(seen)) for t in raw]
            w = split(list(seen))
            hashed, bounds = word_hashes(w), w.bounds.tolist()
            words, pieces = [], []
            for k, (a, z) in enumerate(zip(bounds, bounds[1:], strict=False)):
                at = a
                while at < z:
                    words.append(hashed[at : min(z, at + piece + overlap)])
                    pieces += [k, at - a]
                    at += piece
            n_words = np.diff(w.bounds)[text_no]
            name = f"{task}.{number}.{digest(raw)}"
            number += 1
            data = Shard.build(words, rate).dump() if words else b""
            columns = [pa.array([name]), pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), b.column(1)), _listed(n_words, pa.int64()), _listed(text_no, pa.int32()), _listed(pieces, pa.int64()), pa.array([data], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(build, schema)


def digest(texts: list[bytes]) -> str:
    return hashlib.blake2b(b"".join(hashlib.blake2b(t, digest_size=8).digest() for t in texts), digest_size=8).hexdigest()


def _listed(values, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(phrase, ids): distinct windows of the items, words joined by one space, with the ids that have them (as text)."""
    low = F.translate(F.coalesce(col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(col(id_col).cast("string").alias("id"), F.regexp_extract_all(low, F.lit(LEXICAL_WORD), F.lit(0)).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    each = words.select("id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(window)), " "))).alias("phrase"))
    return each.groupBy("phrase").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def _phrases(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of each phrase, how many)."""
    w = split(utf8(found.column("phrase").combine_chunks()))
    lens = np.diff(w.bounds)
    out = np.zeros((len(lens), int(lens.max(initial=1))), np.uint64)
    out[np.arange(out.shape[1]) < lens[:, None]] = word_hashes(w)
    return out, lens


_FOUND = StructType([
    StructField("shard", StringType()), StructField("row", IntegerType()), StructField("starts", ArrayType(LongType())),
    StructField("stops", ArrayType(LongType())), StructField("items", ArrayType(StringType())),
])


def search(indexed: DataFrame, found: pa.Table, slab: int = 1 << 16) -> DataFrame:
    """(id, n_words, starts, stops, items, shard, row) of every indexed row: merged spans of words inside occurrences of the
    phrases (columns phrase, ids), and the ids of phrases that occur."""
    kind = indexed.schema["ids"].dataType.elementType
    schema = StructType([StructField("id", kind), StructField("n_words", LongType()), *_FOUND.fields[2:], *_FOUND.fields[:2]])
    id_lists = found.column("ids").to_pylist()
    phrases, lens = _phrases(found)

    def hits(data: bytes, pieces: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, start, stop, phrase) of merged spans and of each phrase that a text has."""
        shard = Shard.load(data)
        low, high = shard.find(phrases, lens)
        count = high - low
        ends = np.cumsum(count)
        owner, start, stop, text, phrase = [], [], [], [], []
        for a in range(0, int(count.sum()), slab):  # occurrences of all phrases in turn, a slab at a time
            z = min(a + slab, int(ends[-1]))
            which = np.searchsorted(ends, np.arange(a, z), side="right")
            at = shard.locate(low[which] + np.arange(a, z) - (ends - count)[which])
            piece = np.searchsorted(shard.starts, at, side="right") - 1
            own, begin = pieces[piece, 0], at - shard.starts[piece] + pieces[piece, 1]
            for into, made in zip((owner, start, stop), _spans(own, begin, begin + lens[which]), strict=True):
                into.append(made)
            both = np.unique(own * len(lens) + which)
            text.append(both // len(lens))
            phrase.append(both % len(lens))
        if not owner:
            return (np.zeros(0, np.int64),) * 5
        merged = _spans(*map(np.concatenate, (owner, start, stop)))
        both = np.unique(np.concatenate(text) * len(lens) + np.concatenate(phrase))
        return (*merged, both // len(lens), both % len(lens))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                data = one.column(5)[0].as_py()
                text_no = np.asarray(one.column(3).flatten())
                n = len(text_no)
                n_texts = int(text_no.max(initial=-1)) + 1
                starts, stops, items = [[] for _ in range(n_texts)], [[] for _ in range(n_texts)], [set() for _ in range(n_texts)]
                if data and len(lens):
                    owner, start, stop, text, phrase = hits(data, np.asarray(one.column(4).flatten()).reshape(-1, 2))
                    for o, s, e in zip(owner.tolist(), start.tolist(), stop.tolist(), strict=True):
                        starts[o].append(s)
                        stops[o].append(e)
                    for o, p in zip(text.tolist(), phrase.tolist(), strict=True):
                        items[o].update(id_lists[p])
                lists = [pa.array([x[t] for t in text_no], pa.list_(pa.int64())) for x in (starts, stops)]
                named = pa.array([sorted(items[t]) for t in text_no], pa.list_(pa.string()))
                columns = [one.column(1).flatten(), one.column(2).flatten(), *lists, named, pa.array([one.column(0)[0].as_py()] * n, pa.string()), pa.array(np.arange(n), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return indexed.mapInArrow(look, schema)


def _merged(starts: list[int], stops: list[int]) -> tuple[list[int], list[int]]:
    zero = np.zeros(len(starts), np.int64)
    _, a, z = _spans(zero, np.array(starts, np.int64), np.array(stops, np.int64))
    return a.tolist(), z.tolist()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK, shard_bytes: int = SHARD, piece: int = PIECE) -> DataFrame:
    """(id, n_words, starts, stops, items) for every row: spans of words [start, stop) to remove, and the items met."""
    asked = materialise(windows(benchmark, item_col, item_text, window).withColumn("block", F.xxhash64("phrase")), "windows")
    blocks = max(1, -(-asked.count() // block))
    indexed = index(docs, id_col, text_col, shard_bytes, piece=piece, overlap=window - 1)
    if blocks > 1:
        indexed = materialise(indexed, "fm-index", "none")
    part = lambda k: asked.filter(F.pmod("block", F.lit(blocks)) == k).select("phrase", "ids").orderBy("phrase").toArrow()
    results = [search(indexed, part(k)) for k in range(blocks)]  # each a bounded block of windows
    discard(asked)
    found = results[0]
    if blocks > 1:
        results = materialise(reduce(DataFrame.unionByName, results), "hits")
        discard(indexed)
        together = results.groupBy("shard", "row")
        flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
        found = together.agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), flat("starts"), flat("stops"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = _with_merged_spans(found.select("id", "n_words", "starts", "stops", "items"))
    return found.select(F.col("id").alias(id_col), "n_words", "starts", "stops", "items")


def _with_merged_spans(df: DataFrame) -> DataFrame:
    names = df.columns

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_merged(a, z) for a, z in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            lists = [pa.array([m[i] for m in made], pa.list_(pa.int64())) for i in range(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists, b.column(4)], names=names)

    return df.mapInArrow(merge, df.schema)


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every row; ``options`` as for :func:`contamination`."""
    found = contamination(docs, benchmark, id_col, **options)
    n_hit = F.aggregate(F.zip_with("starts", "stops", lambda a, z: z - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select(
        col(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: The query's result over the tables ``documents`` and ``benchmark``.
SQL = r"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
items as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
wins as (
  select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as phrase
  from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from (select item, w, least(len(w), 10) as n from items where len(w) > 0) q) q),
sizes as (select distinct n from wins),
runs as (
  select r, i, n, array_to_string(w[i : i + n - 1], ' ') as phrase
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes) q),
found as (select r, i, n, item from runs join wins using (n, phrase)),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from found) q group by r),
met as (select r, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct r, item from found) q group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (r) left join met using (r)
"""
