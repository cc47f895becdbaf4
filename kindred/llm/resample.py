"""Importance resampling towards a target distribution, by postings that are dealt out by bucket.

A feature is a run of 1 to ``runs`` consecutive words (joined by one space); the crc32 of its bytes names its bucket.
A bucket's gain tells how much more usual it is in the target than in the documents; a document's weight is the mean
gain of its features. Documents are drawn by weight plus Gumbel noise from a hash of their id: the highest scores are a
sample without replacement in proportion to exp(weight / 1000).

Bucket-partitioned inverted postings: documents are cut into slices of bounded bytes. A slice writes, for each group of
buckets, its postings (bucket, document, count), packed as gaps of the sorted pairs. They are shuffled by group, and
together with them go the bucket totals of both corpora, added up for each task beforehand. A task that gets a group
meets the totals first, works out the gains of its own buckets, then streams the postings and emits for every slice
what the group adds to each document; these rows meet again by slice and are summed. Nothing holds a whole posting
list: a bucket that every document has is a stream, and beyond ``PER_SALT`` rows a group is dealt out over several
tasks, each of which gets the group's totals. A slice's id names its task, place and content and the last step counts
the groups that came in, so that rows which a repeated task cut in another way raise instead of adding up wrongly.

Defined results: a null text has no words; a document without features has weight 0; a null id hashes as the empty
string and comes last among equal scores; rows of equal id and score are ranked one after the other; an empty table
gives an empty result, an empty target only sets t = T = 0; other columns are not read and may have any names. Texts
are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import col, materialise, slices, utf8
from .lexical import LEXICAL_WORD, Words, split

#: Buckets; longest run of words; groups of buckets; rows of a table for which a group stays one task; most tasks of a group.
BUCKETS, RUNS, GROUPS, PER_SALT, MOST_SALTS = 10_000, 2, 100, 1_000_000, 256
#: Bytes of text of a slice, about.
SLICE = 4 << 20
#: Production draw: hundredths of the documents of so many words; seed of the noise.
SHARE, LEAST_WORDS, SEED = 25, 20, 7
_TOTALS, _TARGET, _POSTINGS, _HEAD = range(4)


def _crc_table() -> np.ndarray:
    """What each byte does to a crc32 register."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()
#: Bytes of a word up to which words are added to a crc together.
_SPAN = 64


def _shifts() -> np.ndarray:
    """[n, k, b]: the register with byte b at place k after n zero bytes."""
    out = np.zeros((_SPAN + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(_SPAN):
        out[n + 1] = _CRC[out[n] & 255] ^ (out[n] >> 8)
    return out


_SHIFT = _shifts()


def word_crcs(w: Words) -> np.ndarray:
    """crc32 of each word, a byte of all words at a time."""
    lens = w.ends - w.starts
    order = np.argsort(-lens, kind="stable")
    sizes, at = lens[order], w.starts[order]
    crc = np.full(len(lens), 0xFFFFFFFF, np.uint32)
    alive = np.searchsorted(-sizes, -np.arange(min(_SPAN, sizes[0] if len(sizes) else 0)))
    for j, n in enumerate(alive.tolist()):
        part = crc[:n]
        crc[:n] = _CRC[(part ^ w.low[at[:n] + j]) & 255] ^ (part >> 8)
    out = np.zeros_like(crc)
    out[order] = ~crc
    for i in np.flatnonzero(lens > _SPAN).tolist():
        out[i] = zlib.crc32(w.low[w.starts[i] : w.ends[i]])
    return out


def run_crcs(w: Words, runs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the first word, crc32) of all runs of 1, 2, ... words inside one text."""
    one = word_crcs(w)
    last = np.repeat(w.bounds[1:], np.diff(w.bounds))  # where the text of each word ends
    lens = w.ends - w.starts
    place, crc = np.arange(len(one)), one
    yield place, crc
    for k in range(1, runs):
        on = place + k < last[place]
        place, crc = place[on], crc[on]
        added = place + k
        held = ~crc
        held = ~(_CRC[(held ^ np.uint32(0x20)) & 255] ^ (held >> 8))
        n = np.minimum(lens[added], _SPAN)
        crc = one[added].copy()
        for b in range(4):
            crc ^= _SHIFT[n, b, held >> np.uint32(8 * b) & 255]
        for i in np.flatnonzero(lens[added] > _SPAN).tolist():
            crc[i] = zlib.crc32(w.low[w.starts[added[i]] : w.ends[added[i]]], int(held[i]))
        yield place, crc


def features(texts: list[bytes], runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature, and the words of each text."""
    w = split(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(w.bounds))
    found = list(run_crcs(w, runs))
    return np.concatenate([owner[p] for p, _ in found]), np.concatenate([c % np.uint32(buckets) for _, c in found]).astype(np.int64), np.diff(w.bounds)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them, compressed."""
    kind = np.result_type(np.min_scalar_type(x.min()), np.min_scalar_type(x.max())) if len(x) else np.dtype("u1")
    raw = x.astype(kind.newbyteorder("<")).tobytes()
    return kind.str.encode()[-2:] + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[10:], int.from_bytes(data[2:10], "little"), "zstd", asbytes=True), "<" + data[:2].decode()).astype(np.int64)


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


_SENT = pa.schema([("place", pa.int32()), ("kind", pa.int32()), ("slice", pa.string()), ("data", pa.binary()), ("counts", pa.binary())])
_SENT_DDL = "place int, kind int, slice string, data binary, counts binary"
_ADDED = pa.schema([("slice", pa.string()), ("kind", pa.int32()), ("data", pa.binary())])


def postings(df: DataFrame, text_col: str, id_col: str | None, runs: int, buckets: int, groups: int, salts: int) -> DataFrame:
    """Rows for the shuffle: totals of each task for every task of a group, and, where ``id_col`` is given, packed
    postings of each slice and the head of each slice."""
    texts = df.select(col(text_col).alias("text"), (F.lit(0) if id_col is None else col(id_col)).alias("id"))
    per = -(-buckets // groups)
    target = id_col is None

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        totals = np.zeros(groups * per, np.int64)
        for b in slices(batches, "text", SLICE):
            raw = utf8(b.column(0))
            own, bucket, n_words = features(raw, runs, buckets)
            n = len(raw)
            key, counts = np.unique((bucket % groups * per + bucket // groups) * n + own, return_counts=True)
            totals += np.bincount(key // n, counts, groups * per).astype(np.int64)
            if target:
                continue
            digest = zlib.crc32(b"".join(zlib.crc32(t).to_bytes(4, "little") for t in raw))
            name, salt = f"{task}.{number}.{n}.{digest:08x}", digest % salts
            number += 1
            cuts = np.searchsorted(key, np.arange(groups + 1) * per * n)
            full = np.flatnonzero(np.diff(cuts))
            rows = []
            for g in full.tolist():
                mine = slice(cuts[g], cuts[g + 1])
                rows.append((g * salts + salt, _POSTINGS, name, pack(np.diff(key[mine] - g * per * n, prepend=0)), pack(counts[mine])))
            sink = pa.BufferOutputStream()
            head = pa.RecordBatch.from_arrays([b.column(1), pa.array(np.bincount(own, minlength=n)), pa.array(n_words), pa.array(np.full(n, len(full)))], names=["id", "n_features", "n_words", "groups"])
            with pa.ipc.new_stream(sink, head.schema) as f:
                f.write_batch(head)
            rows.append((digest % groups * salts + salt, _HEAD, name, sink.getvalue().to_pybytes(), None))
            yield _emit(rows, _SENT)
        if totals.any():
            every = int(totals.sum())
            for g in range(groups):
                data = pack(np.r_[every, totals[g * per : (g + 1) * per]])
                yield _emit([(g * salts + s, _TARGET if target else _TOTALS, "", data, None) for s in range(salts)], _SENT)

    return texts.mapInArrow(write, _SENT_DDL)


def gains(s: np.ndarray, t: np.ndarray, n_s: int, n_t: int, buckets: int) -> np.ndarray:
    """Gain of buckets that the documents hold ``s`` times and the target ``t`` times."""
    return np.floor(1000 * np.log(((t + 1) * (n_s + buckets)) / ((s + 1) * (n_t + buckets)))).astype(np.int64)


def contributions(sent: DataFrame, buckets: int, groups: int) -> DataFrame:
    """(slice, kind, data): what each group of buckets adds to the documents of each slice, and the heads."""
    per = -(-buckets // groups)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gain = None, None
        sums = np.zeros((2, per + 1), np.int64)
        for b in batches:
            out = []
            for place, kind, name, data, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if place != now:
                    now, gain, sums = place, None, np.zeros((2, per + 1), np.int64)
                if kind in (_TOTALS, _TARGET):
                    sums[kind] += unpack(data)
                elif kind == _HEAD:
                    out.append((name, _HEAD, data))
                else:
                    if gain is None:
                        gain = gains(sums[0, 1:], sums[1, 1:], int(sums[0, 0]), int(sums[1, 0]), buckets)
                    n = int(name.split(".")[2])
                    key = np.cumsum(unpack(data))
                    added = np.bincount(key % n, gain[key // n] * unpack(counts), n)
                    out.append((name, _POSTINGS, pack(added.astype(np.int64))))
            if out:
                yield _emit(out, _ADDED)

    dealt = sent.repartition("place").sortWithinPartitions("place", "kind")
    return dealt.mapInArrow(add, "slice string, kind int, data binary")


def by_document(added: DataFrame, id_type) -> DataFrame:
    """(id, n_features, n_words, gain): contributions reduced by document."""
    schema = StructType([StructField("id", id_type), *(StructField(c, LongType()) for c in ("n_features", "n_words", "gain"))])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, total, got = None, None, 0, 0

        def done() -> pa.RecordBatch:
            if head is None or got != head.column(3)[0].as_py():
                raise RuntimeError(f"slice {now}: a repeated task read its rows in another order; write the table first")
            sums = total if got else np.zeros(head.num_rows, np.int64)
            return pa.RecordBatch.from_arrays([*head.columns[:3], pa.array(sums)], names=["id", "n_features", "n_words", "gain"])

        for b in batches:
            for name, kind, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != now:
                    if now is not None:
                        yield done()
                    now, head, total, got = name, None, 0, 0
                if kind == _HEAD:
                    head = next(iter(pa.ipc.open_stream(data)))
                else:
                    total, got = total + unpack(data), got + 1
        if now is not None:
            yield done()

    return added.repartition("slice").sortWithinPartitions("slice").mapInArrow(reduce, schema)


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, runs: int = RUNS, groups: int = GROUPS, salts: int | None = None) -> DataFrame:
    """(id, n_features, n_words, weight) for every row of ``docs``: the floored mean gain of its features."""
    if salts is None:
        salts = min(MOST_SALTS, 1 + docs.count() // PER_SALT)
    sent = postings(docs, text_col, id_col, runs, buckets, groups, salts).unionByName(postings(target, target_col, None, runs, buckets, groups, salts))
    found = by_document(contributions(sent, buckets, groups), docs.select(col(id_col)).schema[0].dataType)
    # floor division of whole numbers, down also below zero
    weight = F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(gain - pmod(gain, n_features)) div n_features"))
    return found.select("id", "n_features", "n_words", weight.cast("long").alias("weight"))


def with_rank(scored: DataFrame, take: int) -> DataFrame:
    """``rank`` of the ``take`` highest scores (ties to the smaller id), null for other rows, for rows with ``drawable``.

    Scores are whole numbers of a bounded range, so counts by score place each score, and rows of one score are numbered
    among themselves."""
    drawable = scored.filter("drawable")
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each score: less than 100,000, whatever the number of documents
    places = drawable.groupBy("score").count().select("score", F.coalesce(F.sum("count").over(above), F.lit(0)).alias("_above"))
    inner = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last())
    ranked = drawable.join(places, "score").withColumn("rank", F.col("_above") + F.row_number().over(inner))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank"))).drop("_above")
    return ranked.unionByName(scored.filter("not drawable").withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank) for every row; ``rank`` is null for rows that are not drawn."""
    found = weights(docs, target, id_col, text_col, target_col)
    text_id = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text_id.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = found.select("id", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"), (F.col("n_words") >= least_words).alias("drawable"))
    scored = materialise(scored, "scores")
    take = share * scored.filter("drawable").count() // 100
    return with_rank(scored, take).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def _sql() -> str:
    table = ", ".join(map(str, _CRC.tolist()))
    return rf"""
with w as (
  select corpus, r, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LEXICAL_WORD}'), lambda x: x <> '') as w
  from (select 0 as corpus, row_number() over () as r, doc_id, text from documents union all select 1, row_number() over (), null, text from benchmark) q),
f as (
  select corpus, r, unnest(w) as feature from w
  union all
  select corpus, r, w[i] || ' ' || w[i + 1] from (select corpus, r, w, unnest(range(1, len(w))) as i from w) q),
b as (
  select feature, (4294967295 - list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * octet_length(encode(feature)), 2), lambda k: cast(('0x' || substr(hex(encode(feature)), k, 2)) as bigint))),
                   lambda c, x: xor(([{table}])[(xor(c, x) & 255) + 1], c >> 8))) % {BUCKETS} as bucket
  from (select distinct feature from f) q),
n as (select feature, count(*) filter (corpus = 0) as s, count(*) filter (corpus = 1) as t from f group by feature),
g as (
  select bucket, sum(s) as s, sum(t) as t from n join b using (feature) group by bucket),
total as (select cast(sum(s) as bigint) as s, cast(sum(t) as bigint) as t from g),
gain as (select bucket, floor(1000 * ln(cast((g.t + 1) * (total.s + {BUCKETS}) as double) / cast((g.s + 1) * (total.t + {BUCKETS}) as double))) as gain from g, total),
by_doc as (
  select r, cast(count(*) as bigint) as n_features, cast(sum(gain) as bigint) as gain
  from f join b using (feature) join gain using (bucket) where corpus = 0 group by r),
scored as (
  select w.r, doc_id, len(w) >= {LEAST_WORDS} as drawable, coalesce(n_features, 0) as n_features,
         cast(coalesce(case when gain % n_features < 0 then gain // n_features - 1 else gain // n_features end, 0) as bigint) as weight,
         cast(floor(-1000 * ln(-ln((cast(('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8)) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as noise
  from w left join by_doc on w.r = by_doc.r where corpus = 0),
places as (select r, row_number() over (order by weight + noise desc, doc_id) as rank, count(*) over () as n from scored where drawable)
select doc_id, n_features, weight, weight + noise as score, cast(case when rank <= {SHARE} * n // 100 then rank end as bigint) as rank
from scored left join places using (r)
"""


#: The query's result over the tables ``documents`` and ``benchmark``.
SQL = _sql()
