"""Mixing sources to target weights by blocks.

The words of each source, documents in a fixed hashed order, are packed into blocks of ``BLOCK`` words. Output shards
of ``SHARD`` blocks each draw their source counts from a multinomial law whose weights are the sources' targets, with
a generator of their own (seed and shard number), so shards can be made anywhere and made again. The k-th block that
shards draw from a source is slot k of that source; slot k stands for block perm(k mod n) in round k div n, where n
is the source's number of blocks and perm a pseudorandom permutation of its indices (one for each source and round).
Slots beyond the source's exact number are left out and missing ones follow in closing shards, so every source meets
its target within a block. Slots join the packed documents by block index.

Defined results: sources are ordered by code point, null last; a null text has size 0 and is never taken; repeated
rows are separate rows; an empty table has no plan; rows that agree in id, source and text are exchangeable; null ids
take part; other columns are carried as they are and may have any names. A document that the mix draws in several
rounds gives a row for each, one that it doesn't draw gives none. The list of sources goes to the driver (one row
each: a source is a label of a corpus).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, col, materialise, starts

BLOCK, SHARD = 64, 4096
#: Slots of one range, and slots that a task makes, about.
RANGE, SLOTS = 1 << 14, 1 << 21
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Share out ``share`` of all sizes by the repeating weights; what lies above ``most`` times a size is shared again."""
    w = np.array([weights[k % len(weights)] for k in range(len(sizes))], float)
    cap = most * np.array(sizes, float)
    out = np.zeros(len(sizes))
    free = np.ones(len(sizes), bool)
    left = share * float(sum(sizes))
    while free.any():
        want = left * w / w[free].sum()
        over = free & (want > cap)
        if not over.any():
            out[free] = want[free]
            break
        out[over] = cap[over]
        left -= cap[over].sum()
        free &= ~over
    return out.tolist()


def permute(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0 to n - 1 at ``k``: a four-round Feistel network, walked on until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = k.astype(np.uint64)
    n = n.astype(np.uint64)
    todo = np.arange(len(k))
    while len(todo):
        x, h, m, s = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for turn in range(4):
            mixed = (right + s + np.uint64(turn * 0x632BE5AB)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (mixed >> np.uint64(32)) & m
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


@dataclass
class Mix:
    """``rows``: (id, key, source, size, source_no, source_size, target, start) of every document; ``slots``: (shard,
    place, source_no, slot, round, block) of every output block."""

    rows: DataFrame
    slots: DataFrame
    id_col: str

    def spans(self) -> DataFrame:
        """Each document with words, one row for each block that it reaches into."""
        at, end = F.col("start"), F.col("start") + F.col("size")
        spread = self.rows.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(at / BLOCK), F.floor((end - 1) / BLOCK))))
        low, high = F.greatest(at, F.col("block") * BLOCK), F.least(end, (F.col("block") + 1) * BLOCK)
        return spread.withColumn("first", (low - at).cast("long")).withColumn("words", (high - low).cast("long"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11) -> Mix | None:
    """Plan the mix of a table; None: it has no rows."""
    spark = df.sparkSession
    text = F.coalesce(col(text_col), F.lit(""))
    sized = materialise(
        df.select(
            col(id_col).alias("_id"),
            col(source_col).alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(text).alias("key"),
        ),
        "sizes",
    )
    found = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    if not found:
        return None
    total_rows = sum(r["rows"] for r in found)
    words = [r["words"] for r in found]
    goal = targets(words, weights, share, most)
    blocks = [-(-w // BLOCK) for w in words]
    wanted = [min(int(most * b), round(t * b / w)) if w else 0 for t, b, w in zip(goal, blocks, words, strict=True)]
    table = spark.createDataFrame(
        [(k, r["source"], r["words"], goal[k]) for k, r in enumerate(found)],
        "source_no int, _source string, source_size long, target double",
    )
    rows = sized.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = starts(rows, "source_no", [F.col("_id"), F.col("key"), F.col("size")], "size", total_rows)
    rows = materialise(rows, "starts")

    total = sum(wanted)
    n_shards = -(-total // SHARD)
    chance = np.array(wanted, float) / max(1, total)
    counts, exact = np.array(blocks, np.int64), np.array(wanted, np.int64)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards, which, n = [], [], []
            for shard in b.column(0).to_pylist():
                room = min(SHARD, total - shard * SHARD)
                drawn = np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(room, chance)
                some = np.flatnonzero(drawn)
                shards.append(np.full(len(some), shard))
                which.append(some)
                n.append(drawn[some])
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (shards, which, n)]
            yield pa.RecordBatch.from_arrays([pa.array(flat[0], pa.int64()), pa.array(flat[1].astype(np.int32)), pa.array(flat[2], pa.int64())], names=["shard", "source_no", "n"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(n_shards, max(parts, n_shards // 256)))
    drawn = materialise(spark.range(0, n_shards, 1, tasks).mapInArrow(draw, "shard long, source_no int, n long"), "draws")
    got = {r["source_no"]: r["n"] for r in drawn.groupBy("source_no").agg(F.sum("n").alias("n")).collect()}
    missing = [(n_shards + k, k, int(exact[k]) - got.get(k, 0), got.get(k, 0)) for k in range(len(found)) if got.get(k, 0) < exact[k]]
    ordered = starts(drawn, "source_no", [F.col("shard")], "n", n_shards * len(found))
    closing = spark.createDataFrame(missing, "shard long, source_no int, n long, start long")
    runs = ordered.select("shard", "source_no", "n", "start").unionByName(closing).filter("n > 0")
    # a run of any length in ranges of bounded length, dealt out by number: few rows stand for many slots
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RANGE).cast("long")))
    runs = runs.withColumn("_at", at).select("shard", "source_no", F.least(F.col("n") - F.col("_at"), F.lit(RANGE)).alias("n"), (F.col("start") + F.col("_at")).alias("start"))
    runs = runs.repartition(max(parts, total // SLOTS + 1), "source_no", "start")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, source, n, start = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            n = np.minimum(n, np.maximum(0, exact[source] - start))
            for k in np.flatnonzero(n):
                slot = start[k] + np.arange(int(n[k]))
                own = np.full(len(slot), source[k])
                turn = slot // counts[own]
                block = permute(slot % counts[own], counts[own], (own * 1000003 + turn * 8191 + seed).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), shard[k])), pa.array(own.astype(np.int32)), pa.array(slot), pa.array(turn.astype(np.int32)), pa.array(block)],
                    names=["shard", "source_no", "slot", "round", "block"],
                )

    slots = runs.mapInArrow(fill, "shard long, source_no int, slot long, round int, block long")
    return Mix(rows.withColumnRenamed("_id", id_col), slots, id_col)


def taken(plan: Mix) -> DataFrame:
    """(id, source, size, source_size, target, taken): how many words of each document the mix takes."""
    uses = plan.slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
    keys = [plan.id_col, "source", "size", "source_size", "target", "source_no", "start"]
    met = plan.spans().join(uses, ["source_no", "block"], "left")
    some = met.groupBy(*keys).agg(F.sum(F.col("words") * F.coalesce(F.col("uses"), F.lit(0))).alias("taken"))
    none = plan.rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = [plan.id_col, "source", "size", "source_size", "target", "taken"]
    return some.select(*columns).unionByName(none.select(*columns))


def mixed_documents(df: DataFrame, plan: Mix, text_col: str = "text", source_col: str = "source", n_chars_col: str | None = "n_chars") -> DataFrame:
    """The mix as rows of ``df``: for each document and round in which any of its blocks is drawn, a row whose text is
    the drawn words in their order (the whole text, unchanged, where all of them are)."""
    per = plan.spans().join(plan.slots.select("source_no", "block", "round"), ["source_no", "block"])
    picks = per.groupBy(col(plan.id_col).alias("_id"), "key", "source", "size", "start", "round").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("picks"))
    row = F.struct(*[col(n) for n in df.columns]).alias("row")
    docs = df.select(row, col(plan.id_col).alias("own"), col(source_col).alias("from"), F.xxhash64(F.coalesce(col(text_col), F.lit(""))).alias("hash"))
    if plan.rows.groupBy(col(plan.id_col), "source", "key").count().filter("count > 1").head(1):
        docs = docs.dropDuplicates(["own", "from", "hash"])
    joined = docs.join(picks, F.col("own").eqNullSafe(F.col("_id")) & F.col("from").eqNullSafe(F.col("source")) & (F.col("hash") == F.col("key")))
    joined = joined.withColumn("text", F.col("row").getField(text_col))
    # words as pieces that end before the next word, so that the white space between them stays as it was
    whole = F.expr("aggregate(picks, 0L, (a, x) -> a + x.words) = size")
    pieces = F.expr("regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+[\\\\x20\\\\x09-\\\\x0D]*', 0)")
    drawn = F.trim(F.expr("array_join(flatten(transform(picks, x -> slice(pieces, cast(x.first + 1 as int), cast(x.words as int)))), '')"))
    out = joined.withColumn("pieces", F.when(~whole, pieces)).withColumn("drawn", F.when(whole, F.col("text")).otherwise(drawn))
    made = {text_col: F.col("drawn")} | ({n_chars_col: F.length("drawn").cast(df.schema[n_chars_col].dataType)} if n_chars_col in df.columns else {})
    return out.select(*[made.get(n, F.col("row").getField(n)).alias(n) for n in df.columns])
