"""Ranked lexical search with MaxScore over the inverted index of each shard.

``index`` gives one row for each shard (documents of bounded bytes): lengths of the documents and, for every term, its
postings (document, occurrences). Shards are written to the shared folder once; the corpus counts N and L are sums over
them, and document frequencies are read from their term lists for the terms that the queries have.

``search`` answers queries in blocks of bounded size. A task keeps the best ``k`` documents of each query over all its
shards; the score of the k-th is the query's threshold. In a shard, a term's upper bound is the largest score that it
gives any document there. The terms of least bounds, as long as these add up to less than the threshold, are
non-essential: a document with no other term cannot enter. The essential terms' postings are added up, then the
non-essential ones are probed from the largest bound down, only for documents whose score so far plus all bounds left
reaches the threshold. Equal scores stay in until the id decides, so the result is exact. The best of all tasks are
ranked in two rounds.

A document's score is a sum over the query's terms of whole numbers: weight * (10^9 tf div (1000 tf + 20 m)), with
weight = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 100 - 50 + 50 n N div L for a document of n terms.

Defined results: A-Z are lower-cased; terms are runs of letters, digits and characters outside ASCII; a null text or
query has none; a query without terms, or whose terms no document has, gives no rows; each query row is answered by
itself, so repeated item ids repeat their ranks; repeated document rows each take a rank, null ids come last among
equal scores; other columns are not read; an empty table gives an empty result. Texts are read whole. Terms are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import col, discard, materialise, slices, utf8
from .lexical import split, word_hashes

#: Bytes of text of a shard, about; results for each query; queries of a block, and bytes of their texts, about.
SHARD, BEST, BLOCK, BLOCK_BYTES = 8 << 20, 50, 2000, 8 << 20


@dataclass
class Shard:
    """Inverted index: sorted terms, their postings (document, occurrences), terms of each document."""

    terms: np.ndarray
    offsets: np.ndarray
    docs: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def build(cls, hashed: np.ndarray, bounds: np.ndarray) -> Shard:
        n = len(bounds) - 1
        terms, ids = np.unique(hashed, return_inverse=True)
        key, counts = np.unique(ids * n + np.repeat(np.arange(n), np.diff(bounds)), return_counts=True)
        return cls(terms, np.searchsorted(key, np.arange(len(terms) + 1) * n), (key % max(n, 1)).astype(np.uint32), counts.astype(np.uint32), np.diff(bounds))

    def dump(self) -> tuple[bytes, ...]:
        return tuple(pa.compress(a.astype(kind).tobytes(), "lz4", asbytes=True) for a, kind in zip((self.terms, self.offsets, self.docs, self.counts, self.sizes), _KINDS, strict=True))

    @classmethod
    def load(cls, parts: list[bytes], sizes: list[int]) -> Shard:
        """``sizes``: documents, terms, postings."""
        n, t, p = sizes
        held = [np.frombuffer(pa.decompress(x, m * int(kind[2]), "lz4", asbytes=True), kind) for x, m, kind in zip(parts, (t, t + 1, p, p, n), _KINDS, strict=True)]
        return cls(*held)

    def places(self, asked: np.ndarray) -> np.ndarray:
        """Place of each asked term, -1 where the shard has none."""
        if not len(self.terms):
            return np.full(len(asked), -1)
        at = np.minimum(np.searchsorted(self.terms, asked), len(self.terms) - 1)
        return np.where(self.terms[at] == asked, at, -1)


_KINDS = ("<u8", "<u4", "<u4", "<u4", "<i8")


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD) -> DataFrame:
    """One row for each shard: (ids, n_docs, n_held, n_terms, n_postings, total, terms, offsets, docs, counts, sizes)."""
    kind = df.select(col(id_col)).schema[0].dataType
    numbers = ("n_docs", "n_held", "n_terms", "n_postings", "total")
    parts = ("terms", "offsets", "docs", "counts", "sizes")
    schema = StructType([StructField("ids", ArrayType(kind)), *(StructField(c, LongType()) for c in numbers), *(StructField(c, BinaryType()) for c in parts)])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", shard_bytes):
            w = split(utf8(b.column(0)))
            shard = Shard.build(word_hashes(w), w.bounds)
            own = (b.num_rows, int((shard.sizes > 0).sum()), len(shard.terms), len(shard.docs), int(shard.sizes.sum()))
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(1))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x]) for x in own), *(pa.array([x], pa.binary()) for x in shard.dump())], names=schema.names)

    return df.select(col(text_col).alias("text"), col(id_col).alias("id")).mapInArrow(build, schema)


def frequencies(indexed: DataFrame, asked: np.ndarray) -> dict[int, int]:
    """Documents that hold each asked term (sorted hashes)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for b in batches:
            for n, terms, offsets in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                held = np.frombuffer(pa.decompress(terms, 8 * n, "lz4", asbytes=True), "<u8")
                ends = np.frombuffer(pa.decompress(offsets, 4 * n + 4, "lz4", asbytes=True), "<u4").astype(np.int64)
                at = Shard(held, ends, held, held, held).places(asked)
                total += np.where(at < 0, 0, ends[at + 1] - ends[at]) if n else 0
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["term", "df"])

    # at most a row for each asked term, and those are a block's
    rows = indexed.select("n_terms", "terms", "offsets").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    return {int(asked[t]): n for t, n in zip(rows.column("term").to_pylist(), rows.column("df").to_pylist(), strict=True)}


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The best ``k`` documents of a query so far: (score, shard, document); the threshold is the k-th score."""

    def __init__(self, k: int):
        self.k, self.threshold = k, 1
        self.scores, self.shards, self.docs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, shard: int, docs: np.ndarray, order: list[np.ndarray]) -> None:
        """``order[s][d]``: place of document d of shard s among all ids that the task has met, smaller ids first."""
        scores = np.r_[self.scores, scores]
        shards = np.r_[self.shards, np.full(len(docs), shard)]
        docs = np.r_[self.docs, docs]
        if len(scores) > self.k:
            low = np.partition(scores, -self.k)[-self.k]
            keep = scores >= low
            scores, shards, docs = scores[keep], shards[keep], docs[keep]
            if len(scores) > self.k:  # ties at the end: the smaller id stays
                tied = np.array([order[s][d] for s, d in zip(shards.tolist(), docs.tolist(), strict=True)])
                best = np.lexsort((tied, -scores))[: self.k]
                scores, shards, docs = scores[best], shards[best], docs[best]
            self.threshold = max(1, int(low))
        elif len(scores) == self.k:
            self.threshold = max(1, int(scores.min()))
        self.scores, self.shards, self.docs = scores, shards, docs


def match(postings: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, threshold: int, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) that reach the threshold; ``postings``: (documents, scores, largest score) of each term."""
    postings = sorted(postings, key=lambda p: p[2])
    before = np.cumsum([0, *(p[2] for p in postings)])  # bounds of the terms before each
    first = int(np.searchsorted(before, threshold, side="left")) - 1  # terms before this one add up to less than the threshold
    first = min(max(first, 0), len(postings))
    total = np.zeros(n_docs, np.int64)
    for docs, scores, _ in postings[first:]:
        total[docs] += scores
    if seen is not None:
        seen["added"] = seen.get("added", 0) + sum(len(p[0]) for p in postings[first:])
    live = np.flatnonzero(total)
    for i in range(first - 1, -1, -1):
        live = live[total[live] + before[i + 1] >= threshold]
        if not len(live):
            break
        docs, scores, _ = postings[i]
        at = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
        met = docs[at] == live
        total[live[met]] += scores[at[met]]
        if seen is not None:
            seen["probed"] = seen.get("probed", 0) + len(live)
    live = live[total[live] >= threshold]
    return live, total[live]


def search(indexed: DataFrame, queries: list[tuple[int, list[int]]], weights: dict[int, int], n_docs: int, n_terms: int, k: int = BEST) -> DataFrame:
    """(query, id, score): the best ``k`` documents of each query in each task; ``queries``: (number, term hashes)."""
    kind = indexed.schema["ids"].dataType.elementType
    schema = StructType([StructField("query", LongType()), StructField("id", kind), StructField("score", LongType())])
    asked = np.array(sorted(weights), np.uint64)
    factor = np.array([weights[int(t)] for t in asked.tolist()], np.int64)
    place = {t: i for i, t in enumerate(asked.tolist())}
    wanted = [(q, [place[t] for t in terms if weights.get(t, 0) > 0]) for q, terms in queries]
    columns = ["ids", "n_docs", "n_terms", "n_postings", "terms", "offsets", "docs", "counts", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in wanted]
        ids: list[pa.Array] = []
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1)
                n, t, p = (row.column(i)[0].as_py() for i in (1, 2, 3))
                if not p:
                    ids.append(row.column(0).flatten())
                    continue
                shard = Shard.load([row.column(i)[0].as_py() for i in range(4, 9)], [n, t, p])
                ids.append(row.column(0).flatten())
                order = _Order(ids)
                m = 50 + 50 * shard.sizes * n_docs // n_terms
                at = shard.places(asked)
                lists: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
                for i in np.flatnonzero(at >= 0).tolist():
                    own = slice(shard.offsets[at[i]], shard.offsets[at[i] + 1])
                    docs, tf = shard.docs[own].astype(np.int64), shard.counts[own].astype(np.int64)
                    scores = factor[i] * (1_000_000_000 * tf // (1000 * tf + 20 * m[docs]))
                    lists[i] = docs, scores, int(scores.max())
                for top, (_, terms) in zip(best, wanted, strict=True):
                    held = [lists[i] for i in terms if i in lists]
                    if sum(p[2] for p in held) >= top.threshold:
                        docs, scores = match(held, n, top.threshold)
                        if len(docs):
                            top.add(scores, len(ids) - 1, docs, order)
        starts = np.cumsum([0, *map(len, ids)])
        all_ids = pa.chunked_array(ids) if ids else None
        for top, (q, _) in zip(best, wanted, strict=True):
            if len(top.scores):
                own = all_ids.take(pa.array(starts[top.shards] + top.docs)).combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), q)), own, pa.array(top.scores)], names=schema.names)

    return indexed.select(*columns).mapInArrow(run, schema)


class _Order:
    """Places of the ids of all shards that a task has met, worked out when ties ask for them."""

    def __init__(self, ids: list[pa.Array]):
        self.ids, self.places = list(ids), None

    def __getitem__(self, shard: int) -> np.ndarray:
        if self.places is None:
            together = pa.chunked_array(self.ids)
            by = pc.sort_indices(together, null_placement="at_end").to_numpy()
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            self.places = np.split(place, np.cumsum([len(x) for x in self.ids])[:-1])
        return self.places[shard]


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = BEST, shard_bytes: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(item, rank, id, score): the ``k`` best documents of each item."""
    spark = docs.sparkSession
    indexed = materialise(index(docs, id_col, text_col, shard_bytes), "lexical-index", "none")
    counts = indexed.agg(F.sum("n_held").alias("n"), F.sum("total").alias("l")).first()
    n_docs, n_terms = counts["n"] or 0, counts["l"] or 0
    asked = materialise(items.select(F.monotonically_increasing_id().alias("query"), col(item_col).alias("item"), col(item_text).alias("text")), "queries")
    size = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    found = []
    for part in range(blocks if n_terms else 0):  # each a bounded block of queries
        rows = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == part).select("query", "text").toArrow()
        w = split(utf8(rows.column("text").combine_chunks())) if rows.num_rows else None
        if w is None or not len(w.starts):
            continue
        hashed = word_hashes(w)
        queries = [(q, np.unique(hashed[a:z]).tolist()) for q, a, z in zip(rows.column("query").to_pylist(), w.bounds, w.bounds[1:], strict=False)]
        df = frequencies(indexed, np.unique(hashed))
        found.append(search(indexed, queries, {t: weight(n_docs, n) for t, n in df.items()}, n_docs, n_terms, k))
    own, item = docs.select(col(id_col)).schema[0].dataType, asked.schema["item"].dataType
    if not found:
        discard(indexed, asked)
        fields = ((item_col, item), ("rank", IntegerType()), (id_col, own), ("score", LongType()))
        return spark.createDataFrame([], StructType([StructField(*f) for f in fields]))
    best = materialise(reduce(DataFrame.unionByName, found), "best")
    discard(indexed)
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    # what many tasks have found for one query meets in parts first
    some = Window.partitionBy("query", F.pmod(F.xxhash64("id", "score"), F.lit(32))).orderBy(*order)
    best = best.withColumn("_k", F.row_number().over(some)).filter(F.col("_k") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
    named = best.join(asked.select("query", "item"), "query")
    return named.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


#: The query's result over the tables ``documents`` and ``benchmark``.
SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
q as (
  select row_number() over () as q, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term
  from benchmark),
c as (select count(*) filter (len(w) > 0) as n_docs, cast(sum(len(w)) as bigint) as n_terms from d),
post as (
  select r, term, count(*) as tf from (select r, unnest(w) as term from d) u where term in (select term from q) group by r, term),
weights as (
  select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double)) as bigint) as w
  from (select term, count(*) as df from post group by term) f, c),
scored as (
  select q, item_id, r, cast(sum(weights.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.w) * n_docs) // n_terms)))) as bigint) as score
  from q join post using (term) join weights using (term) join d using (r), c group by q, item_id, r)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select item_id, doc_id, score, row_number() over (partition by q order by score desc, doc_id) as rank
      from scored join d using (r) where score > 0) s
where rank <= 50
"""
