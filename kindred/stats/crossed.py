"""Random effects whose levels span families (crossed effects), beside covariance within families.

The covariance is V = V0 + Z D Z': V0 is block-diagonal by family, Z tells the levels of each observation and D holds a
component for each crossed effect. With W0 the inverse of V0, everything follows from sums over families: S = Z'W0Z, Z'W0X
and Z'W0y make the border, and A = (D^-1 + S)^-1, the inverse of its Schur complement, takes W0 to W = W0 - W0 Z A Z'W0. A
family's own work is that of its block and of the levels that it has; what comes back is a row of small sums for each
task and the entries of S, added up by place before they reach the driver. The driver holds matrices of the number of
levels, at most ``MOST_LEVELS``."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Iterator
from math import log, pi
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut

#: Levels of all crossed effects together.
MOST_LEVELS = 2000


def one_thread() -> None:
    """Keep numpy on the driver to one thread: threads that it started before the fork that starts the JVM may be gone, and a
    product of large matrices would wait for them for ever."""
    for lib in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        loaded = ctypes.CDLL(str(lib))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(loaded, name):
                getattr(loaded, name)(1)
                break


class Bordered:
    """Blocks of families with the levels of their observations. Components are those of the effects within families, of the
    crossed effects, and the residual one."""

    def __init__(self, frame: DataFrame, n_within: int, effect_of: np.ndarray, labels: list[tuple[int, str]]):
        self.frame, self.n_within, self.effect_of, self.labels = frame, n_within, effect_of, labels
        self.n_crossed = int(effect_of.max(initial=-1)) + 1
        self.known: tuple[bytes, tuple] | None = None

    def parts(self, components: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(components of a family's matrices, variance of each level)"""
        k = self.n_within
        return np.r_[components[:k], components[-1]], np.asarray(components[k:-1])[self.effect_of]

    def sums(self, work) -> tuple[list[np.ndarray], np.ndarray]:
        """What ``work(y, x, mats, z, levels)`` gives for each family, added up: (list of arrays, square matrix over its levels or None)."""
        size = len(self.effect_of)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total, border = None, np.zeros((size, size))
            for b in batches:
                for raw in b.column(0).to_pylist():
                    y, x, mats, z = pickle.loads(raw)
                    levels = np.unique(z[z >= 0])
                    design = np.zeros((len(y), len(levels)))
                    row, column = np.nonzero(z >= 0)
                    design[row, np.searchsorted(levels, z[row, column])] = 1.0
                    part, square = work(y, x, mats, design, levels)
                    total = part if total is None else [p + q for p, q in zip(total, part, strict=True)]
                    if square is not None:
                        border[np.ix_(levels, levels)] += square
            if total is not None:
                i, j = np.nonzero(border)
                small = pickle.dumps([np.asarray(t) for t in total])
                own = -1 - TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, own], pa.int32()), pa.array(np.r_[j, 0], pa.int32()), pa.array(np.r_[border[i, j], 0.0]), pa.array([*[None] * len(i), small], pa.binary())], names=["i", "j", "v", "small"])

        rows = self.frame.mapInArrow(run, "i int, j int, v double, small binary").groupBy("i", "j").agg(F.sum("v").alias("v"), F.max("small").alias("small")).toArrow()
        i, j, v = (rows.column(n).to_numpy() for n in ("i", "j", "v"))
        parts = [pickle.loads(p) for p in rows.column("small").to_pylist() if p is not None]
        if not parts:
            raise ValueError("there are no complete observations")
        border = np.zeros((size, size))
        border[i[i >= 0], j[i >= 0]] = v[i >= 0]
        return [sum(p[k] for p in parts) for k in range(len(parts[0]))], border

    def moments(self) -> list[np.ndarray]:
        return self.sums(lambda y, x, mats, z, levels: ([np.array(y.sum()), np.array((y * y).sum()), np.array(float(len(y)))], None))[0]

    def first(self, components: np.ndarray) -> tuple:
        """(sums over families, S, A, log-determinant of the whole covariance)"""
        key = np.asarray(components, float).tobytes()
        if self.known is not None and self.known[0] == key:
            return self.known[1]
        own, spread = self.parts(components)
        size = len(spread)

        def work(y, x, mats, z, levels):
            v = sum(c * m for c, m in zip(own, mats, strict=True))
            sign, logdet = np.linalg.slogdet(v)
            w = np.linalg.inv(v)
            zwx, zwy = np.zeros((size, x.shape[1])), np.zeros(size)
            zwx[levels], zwy[levels] = z.T @ w @ x, z.T @ w @ y
            return [np.array(logdet if sign > 0 else np.nan), x.T @ w @ x, x.T @ w @ y, np.array(y @ w @ y), np.array(float(len(y))), zwx, zwy], z.T @ w @ z

        sums, s = self.sums(work)
        schur = np.diag(1 / spread) + s
        logdet = float(sums[0]) + np.linalg.slogdet(schur)[1] + float(np.log(spread).sum())
        self.known = key, (sums, s, np.linalg.inv(schur), logdet)
        return self.known[1]

    def loglikelihood(self, components: np.ndarray, restricted: bool) -> tuple[float, np.ndarray, np.ndarray, int]:
        (_, xwx, xwy, ywy, n, zwx, zwy), _, a, logdet = self.first(components)
        xwx, xwy, ywy = xwx - zwx.T @ a @ zwx, xwy - zwx.T @ a @ zwy, float(ywy - zwy @ a @ zwy)
        c = np.linalg.pinv(xwx)
        beta = c @ xwy
        rss, n = ywy - float(xwy @ beta), int(n)
        if restricted:
            return -0.5 * (logdet + np.linalg.slogdet(xwx)[1] + rss + (n - np.linalg.matrix_rank(xwx)) * log(2 * pi)), beta, c, n
        return -0.5 * (n * log(2 * pi) + logdet + rss), beta, c, n

    def level_sums(self, components: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """Z'W(y - Xb) of each level."""
        (*_, zwx, zwy), s, a, _ = self.first(components)
        r = zwy - zwx @ beta
        return r - s @ (a @ r)

    def derivatives(self, components: np.ndarray, beta: np.ndarray, c: np.ndarray, restricted: bool) -> tuple[np.ndarray, ...]:
        """(gradient, average information, quadratic forms less traces, levels)."""
        (*_, zwx, zwy), s, a, _ = self.first(components)
        own, _ = self.parts(components)
        effect_of, n_crossed, size = self.effect_of, self.n_crossed, len(self.effect_of)
        r = zwy - zwx @ beta
        h, hx = a @ r, a @ zwx
        zu, zx = r - s @ h, zwx - s @ hx

        def work(y, x, mats, z, levels):
            w = np.linalg.inv(sum(k * m for k, m in zip(own, mats, strict=True)))
            u, wx, b = w @ (y - x @ beta - z @ h[levels]), w @ (x - z @ hx[levels]), w @ z
            near = a[np.ix_(levels, levels)]
            through = [m @ u for m in mats] + [z[:, effect_of[levels] == e] @ zu[levels[effect_of[levels] == e]] for e in range(n_crossed)]
            q = np.array(through)
            qwz = np.zeros((len(q), size))
            qwz[:, levels] = q @ b
            return [
                np.array([np.sum(w * m) - np.sum(near * (b.T @ m @ b)) for m in mats]), np.array([u @ v for v in through[: len(mats)]]),
                np.array([wx.T @ m @ wx for m in mats]), q @ w @ q.T, q @ w @ x, qwz, np.array([float(np.count_nonzero(np.diag(m))) for m in mats]),
            ], None

        (trace, quad, t, qq, qx, qz, levels), _ = self.sums(work)
        inner = np.diag(s - s @ a @ s)
        groups = [effect_of == e for e in range(n_crossed)]
        place = [*range(self.n_within), *range(self.n_within + 1, self.n_within + 1 + n_crossed), self.n_within]  # residual last
        trace = np.r_[trace, [inner[g].sum() for g in groups]][place]
        quad = np.r_[quad, [zu[g] @ zu[g] for g in groups]][place]
        t = np.concatenate([t, np.array([zx[g].T @ zx[g] for g in groups]).reshape(n_crossed, *t.shape[1:])])[place]
        levels = np.r_[levels, [float(g.sum()) for g in groups]][place]
        if restricted:
            trace = trace - np.array([np.sum(c * m) for m in t])
        b = qx - qz @ hx
        info = 0.5 * (qq - qz @ a @ qz.T - b @ c @ b.T)[np.ix_(place, place)]
        return -0.5 * (trace - quad), info, quad - trace, levels


def bordered(model) -> Bordered:
    """Blocks of a model with crossed effects; a null level is none."""
    one_thread()
    columns = [c for _, c in model.crossed]
    rows = model.data.select("fam", "id", *dict.fromkeys((model.outcome, *model.fixed, *columns))).dropna(subset=list(dict.fromkeys((model.outcome, *model.fixed))))
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("effect"), F.col(c).cast("string").alias("level")) for k, c in enumerate(columns)]))
    found = rows.select(named.alias("l")).select("l.*").filter("level is not null").distinct().limit(MOST_LEVELS + 1).collect()
    if len(found) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels of crossed effects")
    labels = sorted((r["effect"], r["level"]) for r in found)
    numbers = rows.sparkSession.createDataFrame(pa.table({"_e": pa.array([e for e, _ in labels], pa.int32()), "_l": pa.array([v for _, v in labels], pa.string()), "_n": pa.array(range(len(labels)), pa.int32())}))
    for k, c in enumerate(columns):
        mine = numbers.filter(F.col("_e") == k).select(F.col("_l").alias(f"_l{k}"), F.col("_n").alias(f"_z{k}"))
        rows = rows.withColumn(f"_l{k}", F.col(c).cast("string")).join(mine, f"_l{k}", "left").drop(f"_l{k}")
    z = rows.select("fam", "id", F.array(*[F.coalesce(f"_z{k}", F.lit(-1)) for k in range(len(columns))]).alias("z"))
    place = z.groupBy("fam").agg(F.sort_array(F.collect_list(F.struct("id", "z"))).alias("zs")).select("fam", F.col("zs.z").alias("zs"))
    both = model.blocks().join(place, "fam").select("block", "zs")

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [pickle.dumps((*pickle.loads(raw), np.array(zs, np.int64)), protocol=5) for raw, zs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["block"])

    frame = cut(both.mapInArrow(attach, "block binary"), "bordered")
    return Bordered(frame, len(model.effects), np.array([e for e, _ in labels], np.int64), labels)


def level_effects(model, fit, blocks: Bordered | None = None) -> DataFrame:
    """(effect, level, blup): predicted values of the levels of crossed effects."""
    blocks = blocks or bordered(model)
    values = blocks.parts(fit.components)[1] * blocks.level_sums(fit.components, fit.beta)
    names = [n for n, _ in model.crossed]
    table = {"effect": [names[e] for e, _ in blocks.labels], "level": [v for _, v in blocks.labels], "blup": values.tolist()}
    return model.data.sparkSession.createDataFrame(pa.table(table, pa.schema([("effect", pa.string()), ("level", pa.string()), ("blup", pa.float64())])))
