"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled 1 in the training rows; unlabelled ones are documents of the table, whatever
they are. With the class prior p, the risk of a scorer is p * E_pos[l(+)] + max(0, E_unl[l(-)] - p * E_pos[l(-)]),
l being the logistic loss: the part that stands for the unseen negatives must not fall below zero, so a step that
makes it negative is taken backwards. The prior is the share of label 1 among the labelled training rows; where no
0 is known, it comes from how a positive-against-unlabelled scorer rates held-back positives. The scorer is linear
over features of the writing: bytes, neighbouring byte classes, and how words and lines repeat. Nothing else is read.

Fitting uses a bounded sample: at most ``SAMPLE`` positives and as many unlabelled documents, those of smallest id
hash. Defined results: a null text is empty and gets a score as well; without positives to learn from every score is
0.5; a document id labelled both ways counts as unlabelled; of several texts under one id the sample takes that of
smallest hash, and every row gets its own text's score; repeated rows give repeated results; an empty table gives an
empty result; rows without an id are scored and never learned from; other columns may have any names. Texts are read
whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import col, slices, utf8

#: Most positives, and most unlabelled documents, that the fit takes.
SAMPLE = 6000
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
_CLASS = np.full(256, 7, np.uint8)  # bytes from 128 on are letters of other scripts or marks
_CLASS[:128] = 6
_CLASS[[9, 10, 11, 12, 13, 32]] = (0, 1, 0, 0, 1, 0)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 2, 3, 4
_CLASS[[ord(c) for c in ".,;:'-"]] = 5
N_FEATURES = 256 + 64 + 7


def features(texts: list[bytes]) -> np.ndarray:
    """One row of features for each text, of any length."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n) + 1
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    per = np.maximum(sizes - 1, 1)[:, None]
    hist = np.bincount(owner * 256 + raw, minlength=256 * n).reshape(n, 256).astype(np.float64)
    hist[:, 10] -= 1
    kind = _CLASS[raw].astype(np.int64)
    pair = np.bincount(owner[:-1] * 64 + kind[:-1] * 8 + kind[1:], minlength=64 * n).reshape(n, 64)
    more = np.zeros((n, 7))
    for k, t in enumerate(texts):
        words = t.split()
        w = max(1, len(words))
        lines = [x for x in t.split(b"\n") if x.strip()]
        more[k] = (
            np.log1p(len(words)),
            len(set(words)) / w,
            sum(map(eq, words, words[1:])) / w,
            len(t) / w / 10,
            1 - len(set(lines)) / max(1, len(lines)),
            np.log1p(len(lines)),
            len(words) < 50,
        )
    return np.c_[np.log1p(hist / per * 100), np.log1p(pair / per * 100), more].astype(np.float32)


class Scorer:
    """Linear scorer over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 2000, rate: float = 0.03, decay: float = 1e-3, seed: int = 7) -> Scorer:
    """Minimise the non-negative risk by Adam steps over random batches (fixed seed); the weights of the second half are averaged."""
    both = np.r_[positive, unlabelled]
    mean, scale = both.mean(0), both.std(0) + 1e-2
    p = np.clip((positive - mean) / scale, -8, 8)
    u = np.clip((unlabelled - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    w = np.zeros(both.shape[1] + 1)
    m, v, total = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        a = p[rng.integers(0, len(p), 1024)]
        b = u[rng.integers(0, len(u), 1024)]
        sa = 1 / (1 + np.exp(-np.clip(a @ w[:-1] + w[-1], -30, 30)))
        sb = 1 / (1 + np.exp(-np.clip(b @ w[:-1] + w[-1], -30, 30)))
        unseen = -np.log(1 - sb + 1e-12).mean() + prior * np.log(1 - sa + 1e-12).mean()
        grad_pos = np.r_[-(1 - sa) @ a, -(1 - sa).sum()] / len(a)
        grad_neg = np.r_[sb @ b, sb.sum()] / len(b) - prior * np.r_[sa @ a, sa.sum()] / len(a)
        grad = prior * grad_pos + grad_neg if unseen >= 0 else -grad_neg
        grad[:-1] += decay * w[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if step > rounds // 2:
            total += w
    w = total / (rounds - rounds // 2)
    return Scorer(mean, scale, w[:-1], float(w[-1]))


def prior_from_positives(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior without any known negative: the mean rating of unlabelled documents over that of held-back positives."""
    cut = max(1, len(positive) // 5)
    held, rest = positive[:cut], positive[cut:] if len(positive) > 1 else positive  # a single one is rated by itself
    scorer = fit(rest, unlabelled, 0.5, rounds=200)
    known = scorer(held).mean()
    return float(np.clip(scorer(unlabelled).mean() / max(known, 1e-6), 0.05, 0.95))


def fold(id_col: str) -> Column:
    """crc32 of the id as text, mod FOLDS; a null id is in fold 0."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(HELD_OUT))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> tuple[np.ndarray, np.ndarray, float | None]:
    """(features of positives, features of unlabelled documents, prior or None), from training rows only."""
    known = labels.filter(fold(id_col) != HELD_OUT).groupBy(col(id_col).alias("_id")).agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi")).filter("lo = hi")
    row = known.agg(F.count("*").alias("n"), F.sum(F.when(F.col("lo") == 1, 1).otherwise(0)).alias("n1")).first()
    prior = None if not row["n"] or row["n1"] == row["n"] else float(np.clip(row["n1"] / row["n"], 0.05, 0.95))
    rank = F.xxhash64("_id", F.lit(5))
    positive = known.filter("lo = 1").orderBy(rank, "_id").limit(most).select("_id", F.lit(1).alias("known"))
    other = docs.filter(fold(id_col) != HELD_OUT).select(col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id", F.lit(6)), "_id").limit(most).select("_id", F.lit(0).alias("known"))
    # at most 2 * most ids, whatever the size of the tables
    drawn = positive.unionByName(other)
    texts = docs.select(col(id_col).alias("own"), col(text_col).alias("text"))
    met = texts.join(F.broadcast(drawn), F.col("own") == F.col("_id"))
    rows = met.groupBy("_id", "known").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("x")).select("x.text", "_id", "known")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            x = features(utf8(b.column(0)))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["_id", "known", "x"])

    kind = drawn.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(compute, f"_id {kind}, known int, x binary").toArrow().sort_by([("known", "ascending"), ("_id", "ascending")])
    known_col = np.array(found.column("known").to_pylist(), np.int64)
    x = np.array([np.frombuffer(r, np.float32) for r in found.column("x").to_pylist()], np.float32).reshape(-1, N_FEATURES)
    return x[known_col == 1], x[known_col == 0], prior


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE) -> Scorer:
    """Fit a scorer; see the module's text for what it reads."""
    positive, unlabelled, prior = training_sample(docs, labels, id_col, text_col, label_col, most)
    if not len(positive) or not len(unlabelled):
        return Scorer(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0)
    if prior is None:
        prior = prior_from_positives(positive, unlabelled)
    return fit(positive, unlabelled, prior)


def score(df: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, score double) for every row."""
    own = df.select(col(id_col), *[col(c) for c in carry])
    names = [*own.columns, "score"]
    df = df.select(col(text_col).alias("0"), *[col(c).alias(str(k)) for k, c in enumerate((id_col, *carry), 1)])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "0", 2 << 20):
            scores = scorer(features(utf8(b.column(0)))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(scores)], names=names)

    return df.mapInArrow(rate, StructType([*own.schema.fields, StructField("score", DoubleType())]))


def risk(z_pos: np.ndarray, z_unl: np.ndarray, prior: float) -> float:
    """Non-negative risk of raw scores under the logistic loss."""
    unseen = np.logaddexp(0, z_unl).mean() - prior * np.logaddexp(0, z_pos).mean()
    return float(prior * np.logaddexp(0, -z_pos).mean() + max(0.0, unseen))


def keep(df: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all their columns, whose text scores at least ``threshold``."""
    at = df.columns.index(text_col)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, 2 << 20):
            yield b.filter(pa.array(scorer(features(utf8(b.column(at)))) >= threshold))

    return df.mapInArrow(choose, df.schema)
