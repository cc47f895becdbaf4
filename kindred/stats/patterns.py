"""Doses, outcomes and fixed effects of families, laid together by marker and by the covariances of those who have a dose.

Whatever a likelihood with one marker's dose needs of a family is quadratic in its columns Z: sums of z_i z_j', weighted by what
the components and the covariances make of a pair (i, j). Families whose people with a dose have the same covariances therefore
add up before any component is known: of their rows vec(Z) the triangle R with R'R = sum of vec(Z) vec(Z)' is kept, which has no
more rows than columns. Pedigrees repeat, so there are far fewer such patterns than families; where none repeats, each
family and marker keeps its own row."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import apart, cut, discard
from .lmm import MixedModel, slices

#: Doses of a family that are one row; doses taken in at once; numbers that wait in a task until they are laid together.
ROW, STEP, CELLS = 1 << 16, 1 << 16, 1 << 22


def known_doses(model: MixedModel, doses: DataFrame, keys: list[str]) -> DataFrame:
    """(fam, _at, keys, dose) of the complete observations, written out; ``_at`` is the place in the family's block."""
    place = model.complete().select("fam", "id", (F.row_number().over(Window.partitionBy("fam").orderBy("id")) - 1).alias("_at"))
    some = doses.filter("dose is not null").select("fam", "id", *keys, F.col("dose").cast("double").alias("dose"))
    return cut(some.join(apart(place), ["fam", "id"]).select("fam", "_at", *keys, "dose"), "doses")


def gather(model: MixedModel, known: DataFrame, keys: list[str], use_dose: bool = True) -> DataFrame:
    """(keys, size, kind, n, rows, mats): for each marker and pattern the number of families, the rows R as packed doubles, (people,
    columns) each with the outcome last and the dose before it, and the covariances of the pattern, told by ``kind``."""
    q, step, cells = len(model.fixed) + 2 + use_dose, STEP, CELLS
    most = known.groupBy("fam").count().agg(F.max("count")).first()[0] or 0
    by = ["fam"] if most <= ROW else ["fam", F.pmod(F.xxhash64(*keys), F.lit(-(-most // ROW))).alias("_slice")]
    packed = known.groupBy(*by).agg(F.collect_list(F.struct("_at", "dose", *keys)).alias("doses"))
    rows = packed.join(apart(model.blocks()), "fam").select("block", "doses")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.select(*keys).schema)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple, int] = {}
        kinds: dict[bytes, int] = {}
        waiting: dict[int, list[tuple]] = {}
        held, key_types = 0, []

        def flush() -> pa.RecordBatch:
            names, mats, shown, out = list(codes), list(kinds), set(), []
            for size, some in waiting.items():
                code, kind, z = (np.concatenate(x) for x in zip(*some, strict=True))
                for at, n, r in together(code * len(mats) + kind, z, cells):
                    k = int(at % len(mats))
                    out.append((names[at // len(mats)], size, hashlib.sha1(mats[k]).digest(), n, r.tobytes(), None if k in shown else mats[k]))
                    shown.add(k)
            waiting.clear()
            codes.clear()
            kinds.clear()
            key, *rest = zip(*out, strict=True)
            fields = [pa.array(x, t) for x, t in zip(zip(*key, strict=True), key_types, strict=True)]
            fields += [pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays(fields, names=[*keys, "size", "kind", "n", "rows", "mats"])

        for b in slices(batches):
            lengths = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(lengths), 0
            while at < b.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] - lengths[at] + step, "right")))
                blocks = [pickle.loads(x) for x in b.column(0).slice(at, upto - at).to_pylist()]
                place, dose, *named = b.column(1).slice(at, upto - at).flatten().flatten()
                key_types = [f.type for f in named]
                frame = pd.DataFrame({k: f.to_pandas() for k, f in enumerate(named)})
                local = frame.groupby(list(frame.columns), sort=False, dropna=False).ngroup().to_numpy()
                firsts = pa.array(np.unique(local, return_index=True)[1])
                own = zip(*[f.take(firsts).to_pylist() for f in named], strict=True)
                code = np.array([codes.setdefault(k, len(codes)) for k in own], np.int64)[local]
                for size, which, z, mats in families(blocks, lengths[at:upto], place.to_numpy(), dose.to_numpy(), code, use_dose, cells):
                    before = len(kinds)
                    found, back = np.unique(mats.view(np.dtype((np.void, mats.shape[1] * 8))).ravel(), return_inverse=True)
                    number = np.array([kinds.setdefault(x.tobytes(), len(kinds)) for x in found], np.int64)
                    waiting.setdefault(size, []).append((which, number[back], z))
                    held += z.size + (len(kinds) - before) * mats.shape[1]
                if held >= cells:
                    yield flush()
                    held = 0
                at = upto
        if held:
            yield flush()

    parts = cut(rows.mapInArrow(lay, f"{types}, size int, kind binary, n long, rows binary, mats binary"), "parts")
    mats = parts.filter("mats is not null").groupBy("kind").agg(F.first("mats").alias("mats"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spot = b.schema.get_field_index("rows")
            sizes = b.column("size").to_pylist()
            laid = [triangle(np.frombuffer(b"".join(x)).reshape(-1, size * q)).tobytes() for x, size in zip(b.column(spot).to_pylist(), sizes, strict=True)]
            yield b.set_column(spot, "rows", pa.array(laid, pa.binary()))

    met = parts.groupBy(*keys, "size", "kind").agg(F.sum("n").alias("n"), F.collect_list("rows").alias("rows"))
    met = met.mapInArrow(merge, f"{types}, size int, kind binary, n long, rows binary")
    out = cut(met.join(apart(mats), "kind").select(*keys, "size", "kind", "n", "rows", "mats"), "patterns")
    discard(parts)
    return out


def families(blocks: list[tuple], lengths: np.ndarray, place: np.ndarray, dose: np.ndarray, code: np.ndarray, use_dose: bool, cells: int = CELLS) -> Iterator[tuple]:
    """(people, marker codes, vec(Z) and covariances, a row for each family and marker) by number of people with a dose. ``lengths``
    are the numbers of doses of each block, ``place`` their people."""
    people = np.array([len(y) for y, _, _ in blocks])
    x, y = np.concatenate([b[1] for b in blocks]), np.concatenate([b[0] for b in blocks])
    covariances = np.concatenate([np.asarray(m, float).ravel() for _, _, ms in blocks for m in ms])
    effects = len(blocks[0][2])
    person, cell = np.cumsum(people) - people, np.cumsum(people**2 * effects) - people**2 * effects
    family = np.repeat(np.arange(len(blocks)), lengths)
    order = np.lexsort((place, code, family))
    family, place, dose, code = family[order], place[order], dose[order], code[order]
    starts = np.flatnonzero(np.r_[True, (np.diff(family) != 0) | (np.diff(code) != 0)]) if len(code) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(code)])
    for size in np.unique(sizes).tolist():
        every = starts[sizes == size]
        step = max(1, cells // (effects * size * size))
        for first in range(0, len(every), step):
            at = every[first : first + step, None] + np.arange(size)
            f, own = family[at[:, 0]], place[at]
            who = person[f][:, None] + own
            z = np.concatenate([x[who], *([dose[at][:, :, None]] if use_dose else []), y[who][:, :, None]], axis=2)
            n = people[f][:, None, None, None]
            spot = cell[f][:, None, None, None] + np.arange(effects)[:, None, None] * n * n + own[:, None, :, None] * n + own[:, None, None, :]
            yield size, code[at[:, 0]], z.reshape(len(at), -1), np.ascontiguousarray(covariances[spot].reshape(len(at), -1))


def triangle(rows: np.ndarray) -> np.ndarray:
    """Rows with the same sum of outer products, as many as columns at most; dimensions in front of the rows are a stack."""
    return np.linalg.qr(rows, mode="r") if rows.shape[-2] > rows.shape[-1] else rows


def together(group: np.ndarray, z: np.ndarray, cells: int = CELLS) -> Iterator[tuple[int, int, np.ndarray]]:
    """(group, its number of rows, rows that stand for them)."""
    order = np.argsort(group, kind="stable")
    group, z = group[order], z[order]
    starts = np.flatnonzero(np.r_[True, np.diff(group) != 0])
    counts = np.diff(np.r_[starts, len(group)])
    wide = z.shape[1]
    for at, n in zip(starts[counts <= wide].tolist(), counts[counts <= wide].tolist(), strict=True):
        yield int(group[at]), n, z[at : at + n]
    # larger groups are stacked with others of up to twice their rows, filled up with zeros, which add nothing
    steep = np.ceil(np.log2(np.maximum(counts, 1))).astype(int)
    for power in np.unique(steep[counts > wide]).tolist():
        some = np.flatnonzero((steep == power) & (counts > wide))
        step = max(1, cells // (wide << power))
        for first in range(0, len(some), step):
            here = some[first : first + step]
            inside = np.arange(1 << power) < counts[here][:, None]
            stack = np.zeros((len(here), 1 << power, wide))
            stack[inside] = z[(starts[here][:, None] + np.arange(1 << power))[inside]]
            for k, r in zip(here.tolist(), triangle(stack), strict=True):
                yield int(group[starts[k]]), int(counts[k]), r
