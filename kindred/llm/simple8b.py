"""Token ids in a binary file format: Simple-8b word-aligned coding with escapes and per-block offsets.

A 64-bit word holds a 4-bit selector and 60 bits of payload; the selector tells how many ids of which width the
payload has. Ids come in blocks of ``BLOCK``; a block starts a new word, and the file lists the word at which each
block starts, so blocks are coded and decoded all at once, one word of every block at a time, or one by one. An id
of 2**60 or more is an escape: selector 15, its payload the place of the id in a table at the end of the file.

File (little-endian): "S8B1", counts of documents, ids, blocks, words and escapes (u64 each), document ids (i64),
null flags of document ids (u8), ids of each document (u64), word at which each block starts (u64), words, escapes.

``write`` sorts the table by id over many tasks, and each task writes files of bounded size to the shared folder
under a temporary name that a rename makes final, so a task that runs again replaces its files by equal ones.
Defined results: a null text is empty and has the end id alone; null ids come first; repeated rows are all written,
rows of one id in order of a hash of their text; an empty table gives no files and an empty result; other columns
are not read. A single text of any length stands in one file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, only, shared_dir, slices, utf8
from .wordbpe import word_bpe

MAGIC, BLOCK = b"S8B1", 1024
#: (ids, bits) of selectors 0 to 13.
PACKINGS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
#: Ids of a file, about; rows of a task that writes, about; most such tasks.
FILE_IDS, PART_ROWS, MOST_PARTS = 1 << 20, 8000, 20000
SLICE = 2 << 20


def encode_words(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word at which each block starts, escaped ids) of unsigned ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    n_blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    runs = []  # how many ids from here on fit a width, 60 at most
    place = np.arange(n, dtype=np.int64)
    for _, bits in PACKINGS:
        over = np.where(ids >> np.uint64(bits) > 0, place, n)
        runs.append(np.minimum(np.minimum.accumulate(over[::-1])[::-1] - place, 60).astype(np.uint8))
    at = np.arange(n_blocks) * block
    end = np.minimum(at + block, n)
    own = np.arange(n_blocks)
    places, selectors, owners, counts = [], [], [], []
    while len(at):
        left = end - at
        selector = np.full(len(at), ESCAPE)
        count = np.ones(len(at), np.int64)
        open_ = np.ones(len(at), bool)
        for s, (k, _) in enumerate(PACKINGS):
            fits = open_ & (runs[s][at] >= np.minimum(k, left))
            selector[fits] = s
            count[fits] = np.minimum(k, left[fits])
            open_ &= ~fits
        places.append(at)
        selectors.append(selector)
        owners.append(own)
        counts.append(count)
        at = at + count
        on = at < end
        at, end, own = at[on], end[on], own[on]
    places, selectors, owners, counts = map(np.concatenate, (places, selectors, owners, counts))
    order = np.argsort(places, kind="stable")
    places, selectors, owners, counts = places[order], selectors[order], owners[order], counts[order]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for s, (k, bits) in enumerate(PACKINGS):
        of = np.flatnonzero(selectors == s)
        for j in range(k):
            some = of[counts[of] > j]
            words[some] |= ids[places[some] + j] << np.uint64(j * bits)
    of = np.flatnonzero(selectors == ESCAPE)
    words[of] |= np.arange(len(of), dtype=np.uint64)
    return words, np.searchsorted(owners, np.arange(n_blocks)).astype(np.uint64), ids[places[of]]


def decode_words(words: np.ndarray, firsts: np.ndarray, escapes: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ids of :func:`encode_words`."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selectors = (words >> np.uint64(60)).astype(np.int64)
    sizes = np.ones(16, np.int64)
    sizes[: len(PACKINGS)] = [k for k, _ in PACKINGS]
    held = sizes[selectors]
    before = np.cumsum(held) - held
    firsts = firsts.astype(np.int64)
    owner = np.repeat(np.arange(len(firsts)), np.diff(np.r_[firsts, len(words)]))
    at = owner * block + before - before[firsts][owner]
    end = np.minimum((owner + 1) * block, n)
    for s, (k, bits) in enumerate(PACKINGS):
        of = np.flatnonzero(selectors == s)
        mask = np.uint64((1 << bits) - 1)
        for j in range(k):
            some = of[at[of] + j < end[of]]
            out[at[some] + j] = words[some] >> np.uint64(j * bits) & mask
    of = np.flatnonzero(selectors == ESCAPE)
    out[at[of]] = escapes[(words[of] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def to_file(doc_ids: list[int | None], lens: np.ndarray, ids: np.ndarray) -> bytes:
    """File image of documents with ``lens`` ids each."""
    words, firsts, escapes = encode_words(ids)
    head = np.array([len(doc_ids), len(ids), len(firsts), len(words), len(escapes)], "<u8")
    own = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([MAGIC, head.tobytes(), own.tobytes(), null.tobytes(), lens.astype("<u8").tobytes(), firsts.astype("<u8").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def from_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids of each, all ids) of a file image."""
    if data[:4] != MAGIC:
        raise ValueError("not a token-id file")
    n_docs, n_ids, n_blocks, n_words, n_escapes = np.frombuffer(data, "<u8", 5, 4).astype(np.int64).tolist()
    at = 44
    parts = []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs), ("<u8", n_blocks), ("<u8", n_words), ("<u8", n_escapes)):
        parts.append(np.frombuffer(data, kind, n, at))
        at += parts[-1].nbytes
    own, null, lens, firsts, words, escapes = parts
    return [None if z else d for d, z in zip(own.tolist(), null.tolist(), strict=True)], lens.astype(np.int64), decode_words(words, firsts, escapes, n_ids)


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the table's ids to files in ``folder`` in ascending id order; (part, file, name, n_docs, n_ids, start)."""
    spark = df.sparkSession
    df = only(df, id_col, text_col)
    rows = df.select(id_col).count()
    parts = max(1, min(MOST_PARTS, -(-rows // PART_ROWS)))
    tie = F.xxhash64(f"`{text_col}`")
    ordered = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"), tie.alias("_tie"))
    ordered = ordered.repartitionByRange(parts, "_id", "_tie").sortWithinPartitions("_id", "_tie").select("_id", "_text")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        bpe = word_bpe(tokenizer)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        number = n_held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, n_held
            own = [d for x in held for d in x[0]]
            lens, ids = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            name = f"part-{part:06d}-{number:06d}.s8b"
            with store.open_output_stream(f"{root}/.{name}.{attempt}") as f:
                f.write(to_file(own, lens, ids))
            store.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
            out = pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, number, name, len(own), len(ids))], names=["part", "file", "name", "n_docs", "n_ids"])
            held.clear()
            number, n_held = number + 1, 0
            return out.cast(pa.schema([("part", pa.int32()), ("file", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for b in slices(batches, "_text", SLICE):
            ids, lens = bpe.encode(utf8(b.column(1)))
            ends = np.cumsum(lens)
            held.append((b.column(0).to_pylist(), lens + 1, np.insert(ids, ends, end_id)))
            n_held += len(ids) + len(lens)
            if n_held >= FILE_IDS:
                yield flush()
        if held:
            yield flush()

    made = materialise(ordered.mapInArrow(save, "part int, file int, name string, n_docs long, n_ids long"), "files")
    # one row for each part meets in one task: at most MOST_PARTS rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = made.groupBy("part").agg(F.sum("n_ids").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = made.join(bases, "part").withColumn("start", F.col("_base") + F.coalesce(F.sum("n_ids").over(inner), F.lit(0)))
    return placed.select("part", "file", "name", "n_docs", "n_ids", "start")


def read(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files of ``folder``."""
    spark = files.sparkSession
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own, lens, ids = from_file(data.as_py())
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(lens)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(own)), pa.array(own, pa.int64()), pa.array(ends - lens), pa.array(lens), pa.array(crc, pa.int64())],
                    names=["name", "doc_id", "_at", "n_tokens", "ids_crc32"],
                )

    rows = found.mapInArrow(load, "name string, doc_id long, _at long, n_tokens long, ids_crc32 long")
    return rows.join(files.select("name", F.col("start").alias("_base")), "name").select("doc_id", (F.col("_base") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write to a fresh folder beside the session's checkpoints and read back."""
    folder = f"{shared_dir(df.sparkSession)}/kindred-ids-{uuid.uuid4().hex}"
    files = write(df, folder, tokenizer, end_id, id_col, text_col)
    if not files.head(1):
        return df.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(files, folder)
