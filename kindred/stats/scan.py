"""Marker scan that fits the variance components again for each marker.

Markers take their average-information steps side by side: a round is one pass over (marker, pattern) rows (families laid
together once, see :mod:`.patterns`) that adds up, for every marker still moving, all that its likelihood, gradient and
information need at its own components. The state of a marker (components, step, likelihood) is a row of a table, never held by the driver; rows
that have converged leave the passes that follow.

Defined results (a person has at most one dose of a marker): people without a dose, the outcome or a fixed effect take no part; a marker with one kind of dose, or
whose dose the fixed effects explain in full, is left out; a marker that does not converge in ``most`` rounds has
``converged`` false and its last values; no doses give an empty table."""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..plans.tables import cut, discard
from .lmm import Fit, MixedModel
from .patterns import gather, known_doses

#: Numbers of patterns that are worked on at once.
CELLS = 1 << 21


def pieces(sigma: np.ndarray, n: np.ndarray, z: np.ndarray, mats: np.ndarray) -> np.ndarray:
    """Sums of patterns of one size, a row each: log-determinant, Z'WZ, Z'WMiWZ, Z'WMiWMjWZ (i <= j), tr(WMi). ``sigma``
    (rows, effects), ``n`` families of each, ``z`` (rows, draws, people, columns) with the outcome last, ``mats`` (rows, effects,
    people, people)."""
    rows, count = sigma.shape
    people, q = z.shape[2:]
    v = np.einsum("rk,rkij->rij", sigma, mats)
    sign, logdet = np.linalg.slogdet(v)
    w = np.linalg.inv(v)
    z = np.swapaxes(z, 1, 2).reshape(rows, people, -1)  # the draws side by side
    wz = w @ z
    mwz = mats @ wz[:, None]
    tall = lambda m: m.reshape(*m.shape[:-2], -1, q)
    turned = lambda m: np.swapaxes(tall(m), -1, -2)
    second = [turned(mwz[:, i]) @ tall(w @ mwz[:, j]) for i in range(count) for j in range(i, count)]
    parts = [np.where(sign > 0, logdet, np.nan) * n, turned(wz) @ tall(z), turned(wz)[:, None] @ tall(mwz), *second, np.einsum("rij,rkij->rk", w, mats) * n[:, None]]
    return np.concatenate([np.reshape(p, (rows, -1)) for p in parts], axis=1)


def climb(sums: np.ndarray, n: int, count: int, q: int, bound: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood, beta, inverse of X'WX, step of average information) from the sums over families. Components that
    are ``bound`` from below and would fall stay where they are, and the others step without them."""
    cells = q * q
    first = sums[1 : 1 + cells].reshape(q, q)
    single = sums[1 + cells : 1 + cells * (1 + count)].reshape(count, q, q)
    at = 1 + cells * (1 + count)
    c = np.linalg.pinv(first[:-1, :-1])
    beta = c @ first[:-1, -1]
    rss = float(first[-1, -1] - first[:-1, -1] @ beta)
    value = -0.5 * (n * log(2 * pi) + float(sums[0]) + rss)
    e = np.r_[-beta, 1.0]  # Z e are the residuals
    info = np.zeros((count, count))
    for i in range(count):
        for j in range(i, count):
            info[i, j] = info[j, i] = e @ sums[at : at + cells].reshape(q, q) @ e
            at += cells
    b = (single @ e)[:, :-1]
    info = 0.5 * (info - b @ c @ b.T)
    gradient = 0.5 * ((single @ e) @ e - sums[at : at + count])
    free = np.flatnonzero(~(bound & (gradient < 0)))
    step = np.zeros(count)
    step[free] = np.linalg.lstsq(info[np.ix_(free, free)], gradient[free], rcond=None)[0]
    return value, beta, c, step


def refit(model: MixedModel, starts: np.ndarray, doses: DataFrame, keys: tuple[str, ...], use_dose: bool = True, tol: float = 1e-4, most: int = 100) -> DataFrame:
    """(keys, n, frequency, beta, se, loglikelihood, components, rounds, converged): maximum likelihood of the model with
    each marker's dose (fam, id, keys, dose) as a fixed effect; without ``use_dose`` of the same people without it."""
    names, count = list(keys), len(model.effects) + 1
    starts = np.asarray(starts, float)
    q = len(model.fixed) + 2 + use_dose
    floor = 1e-8 * float(starts.sum())
    known = known_doses(model, doses, names)
    patterns = gather(model, known, names, use_dose)
    markers = known.groupBy(*names).agg(F.count("*").alias("n"), F.sum("dose").alias("total"), F.min("dose").alias("_low"), F.max("dose").alias("_high")).filter("_low < _high")
    zeros = F.array(*[F.lit(0.0)] * count)
    state = cut(markers.select(*names, "n", "total", F.array(*[F.lit(float(x)) for x in starts]).alias("sigma"), zeros.alias("step"), F.lit(1.0).alias("shrink"), F.lit(None).cast("double").alias("value"), F.lit(0.0).alias("beta"), F.lit(0.0).alias("se"), F.lit(0).alias("round"), F.lit(0).alias("done")), "state")
    width = 1 + q * q * (1 + count + count * (count + 1) // 2) + count
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.select(*names).schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_of: dict[tuple, int] = {}
            firsts: list[int] = []
            total: list[np.ndarray] = []
            waiting: dict[tuple[int, int], list[tuple]] = {}

            def flush(shape: tuple[int, int]) -> None:
                some = waiting.pop(shape)
                got = pieces(*(np.array([s[k] for s in some]) for k in range(1, 5)))
                for (k, *_), row in zip(some, got, strict=True):
                    total[k] += row

            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for at, (size, n, laid, raw, sigma, step, shrink, *key) in enumerate(zip(*columns, strict=True)):
                k = key_of.setdefault(tuple(key), len(firsts))
                if k == len(firsts):
                    firsts.append(at)
                    total.append(np.zeros(width))
                z, mats = np.frombuffer(laid).reshape(-1, size, q), np.frombuffer(raw).reshape(count, size, size)
                shape = size, len(z)
                waiting.setdefault(shape, []).append((k, np.maximum(np.array(sigma) + shrink * np.array(step), floor), n, z, mats))
                if len(waiting[shape]) * size * (size * count + len(z) * q) >= CELLS:
                    flush(shape)
            for shape in list(waiting):
                flush(shape)
            rows = batch.select(names).take(pa.array(firsts, pa.int64()))
            values = pa.array([t.tolist() for t in total], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, values], names=[*names, "sums"])

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for at, r in enumerate(batch.to_pylist()):
                sigma, step, shrink, value, beta, se, done = np.array(r["sigma"]), np.array(r["step"]), r["shrink"], r["value"], r["beta"], r["se"], 0
                sums = np.array(r["sums"])
                if use_dose and value is None:
                    square = sums[1 : 1 + q * q].reshape(q, q)
                    gx, c0 = square[q - 2, : q - 2], np.linalg.pinv(square[: q - 2, : q - 2])
                    if square[q - 2, q - 2] - gx @ c0 @ gx <= 1e-9:
                        continue
                new = np.maximum(sigma + shrink * step, floor)
                found, betas, c, way = climb(sums, r["n"], count, q, new <= 2 * floor) if np.isfinite(sums).all() else (np.nan, None, None, None)
                if value is None or (np.isfinite(found) and (found >= value - 1e-9 or shrink < 1e-6)):
                    moved = np.abs(new / new.sum() - sigma / sigma.sum()).max()
                    done = int(value is not None and (moved < tol or abs(found - value) < 1e-3 * tol))
                    sigma, step, shrink, value = new, way, 1.0, found
                    beta, se = float(betas[-1]), sqrt(max(0.0, float(c[-1, -1])))
                elif shrink < 1e-12:
                    done = 2  # no step leads to a finite likelihood
                else:
                    shrink /= 4
                keep.append(at)
                out.append((r["n"], r["total"], sigma.tolist(), step.tolist(), shrink, value, beta, se, r["round"] + 1, done))
            rows = batch.select(names).take(pa.array(keep, pa.int64()))
            types = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.float64()] * 4, pa.int32(), pa.int32()]
            cols = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(x, t) for x, t in zip(cols, types, strict=True)]], names=[*names, *state_names])

    state_names = [c for c in state.columns if c not in names]
    schema = f"{kinds}, n long, total double, sigma array<double>, step array<double>, shrink double, value double, beta double, se double, round int, done int"
    finished = None
    for k in range(1, most + 1):
        rows = patterns.join(state.select(*names, "sigma", "step", "shrink"), names).select("size", "n", "rows", "mats", "sigma", "step", "shrink", *names)
        sums = rows.mapInArrow(add, f"{kinds}, sums array<double>").groupBy(*names).agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        after = cut(sums.join(state, names).mapInArrow(advance, schema), "state")
        ended = after if k == most else after.filter("done > 0")
        finished = ended if finished is None else finished.unionByName(ended)
        state = after.filter("done = 0")
        if k < most and state.isEmpty():
            break
    discard(known, patterns)
    return finished.select(*names, "n", (F.col("total") / (2 * F.col("n"))).alias("frequency"), "beta", "se", F.col("value").alias("loglikelihood"), F.col("sigma").alias("components"), F.col("round").alias("rounds"), (F.col("done") == 1).alias("converged"))


@F.pandas_udf(DoubleType())
def _tail(chi2: pd.Series) -> pd.Series:
    """Upper tail of chi-squared with one degree of freedom."""
    return chi2.map(lambda x: erfc(sqrt(x / 2)))


def association_refit(model: MixedModel, null: Fit, doses: DataFrame, keys: tuple[str, ...] = ("chrom_idx", "marker_idx"), tol: float = 1e-4, most: int = 100) -> DataFrame:
    """(keys, n, frequency, beta, se, components, chi2, lod, pvalue, rounds, converged): likelihood ratio of the models with
    and without each marker's dose, both by maximum likelihood on the same people, from the components of ``null`` on. Where
    all people of the null model have a dose its likelihood is taken, else it is fitted again to those who have."""
    names = list(keys)
    tests = cut(refit(model, null.components, doses, keys, True, tol, most), "tests")
    part = tests.filter(F.col("n") != null.n).select(*names)
    base = refit(model, null.components, doses.join(part, names, "left_semi"), keys, False, tol, most)
    both = tests.join(base.select(*names, F.col("loglikelihood").alias("_null"), F.col("converged").alias("_ok")), names, "left")
    chi2 = F.greatest(F.lit(0.0), 2 * (F.col("loglikelihood") - F.coalesce("_null", F.lit(float(null.loglikelihood)))))
    both = both.withColumns({"chi2": chi2, "converged": F.col("converged") & F.coalesce("_ok", F.lit(True))})
    return both.select(*names, "n", "frequency", "beta", "se", "components", "chi2", (F.col("chi2") / (2 * log(10))).alias("lod"), _tail("chi2").alias("pvalue"), "rounds", "converged")
