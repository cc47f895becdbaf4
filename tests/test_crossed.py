"""Crossed random effects against dense matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.stats import crossed, lmm


@pytest.fixture(scope="module")
def case(spark):
    """Families of one to six with a shared component, crossed with sites and days; some without a site."""
    rng = np.random.default_rng(11)
    rows, cells = [], []
    site_value, day_value = rng.normal(0, 1.2, 5), rng.normal(0, 0.8, 4)
    for f in range(40):
        shared = rng.normal(0, 0.9)
        n = int(rng.integers(1, 7))
        for i in range(n):
            site = None if rng.random() < 0.1 else int(rng.integers(5))
            day = int(rng.integers(4))
            x = float(rng.normal())
            rows.append((f, i, float(2 + 0.5 * x + shared + (0 if site is None else site_value[site]) + day_value[day] + rng.normal()), x, None if site is None else f"s{site}", day))
            cells += [(f, i, j, 1.0 if i == j else 0.5) for j in range(n)]
    rows.append((99, 0, None, 0.0, "s9", 1))  # no outcome: neither the row nor its level counts
    data = spark.createDataFrame(rows, "fam long, id long, y double, x double, site string, day int")
    matrix = spark.createDataFrame(cells, "fam long, id1 long, id2 long, value double")
    model = lmm.MixedModel(data, "y", ("x",)).with_effect("family", matrix).with_crossed("site", "site").with_crossed("day", "day")
    known = [r for r in rows if r[2] is not None]
    same = np.array([[a[0] == b[0] for b in known] for a in known])
    level = lambda k: np.array([[float(a[k] is not None and a[k] == b[k]) for b in known] for a in known])
    mats = [np.where(np.eye(len(known)) == 1, 1.0, np.where(same, 0.5, 0.0)), level(4), level(5), np.eye(len(known))]
    return model, crossed.bordered(model), np.array([r[2] for r in known]), np.array([[1.0, r[3]] for r in known]), mats, known


def dense(components, y, x, mats, restricted):
    v = sum(c * m for c, m in zip(components, mats, strict=True))
    w = np.linalg.inv(v)
    xwx = x.T @ w @ x
    beta = np.linalg.solve(xwx, x.T @ w @ y)
    r = y - x @ beta
    out = np.linalg.slogdet(v)[1] + r @ w @ r
    if restricted:
        return -0.5 * (out + np.linalg.slogdet(xwx)[1] + (len(y) - 2) * math.log(2 * math.pi)), beta, w
    return -0.5 * (out + len(y) * math.log(2 * math.pi)), beta, w


@pytest.mark.parametrize("restricted", [False, True])
def test_likelihood_and_derivatives(case, restricted):
    _, blocks, y, x, mats, _ = case
    for components in (np.array([0.8, 1.1, 0.5, 1.0]), np.array([0.2, 3.0, 1e-6, 0.7])):
        value, beta, c, n = lmm.loglikelihood(blocks, components, restricted)
        want, want_beta, w = dense(components, y, x, mats, restricted)
        assert n == len(y) and abs(value - want) < 1e-8 and np.allclose(beta, want_beta)
        gradient, info, _, levels = lmm.derivatives(blocks, components, beta, c, restricted)
        for k in range(4):
            step = np.eye(4)[k] * 1e-5 * max(components[k], 1e-3)
            slope = (dense(components + step, y, x, mats, restricted)[0] - dense(components - step, y, x, mats, restricted)[0]) / (2 * step[k])
            assert abs(slope - gradient[k]) < 1e-3 * max(1, abs(slope))
        p = w - w @ x @ c @ x.T @ w
        u = p @ y
        assert np.allclose(info, 0.5 * np.array([[u @ a @ p @ b @ u for b in mats] for a in mats]))
        assert levels[1:3].tolist() == [5, 4]


@pytest.mark.parametrize("restricted", [False, True])
def test_fit_is_the_top(case, restricted):
    model, _, y, x, mats, _ = case
    fit = model.fit(restricted, tol=1e-6, most=40)
    assert fit.names == ("family", "site", "day", "residual")
    top = dense(fit.components, y, x, mats, restricted)[0]
    assert abs(top - fit.loglikelihood) < 1e-7
    rng = np.random.default_rng(1)
    for _ in range(60):
        assert dense(fit.components * np.exp(rng.normal(0, 0.05, 4)), y, x, mats, restricted)[0] <= top + 1e-6


def test_level_effects(case):
    model, blocks, y, x, mats, known = case
    components = np.array([0.8, 1.1, 0.5, 1.0])
    _, beta, w = dense(components, y, x, mats, False)
    got = {(r.effect, r.level): r.blup for r in crossed.level_effects(model, lmm.Fit(model.names(), components, beta, 0.0, 0, 0, "given"), blocks).collect()}
    u = w @ (y - x @ beta)
    want = {("site", f"s{k}"): 1.1 * sum(u[i] for i, r in enumerate(known) if r[4] == f"s{k}") for k in range(5)}
    want |= {("day", str(k)): 0.5 * sum(u[i] for i, r in enumerate(known) if r[5] == k) for k in range(4)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_what_crossed_models_do_not_do(case):
    model = case[0]
    with pytest.raises(ValueError):
        model.fit(method="nr")
    with pytest.raises(ValueError):
        lmm.blup(model, None)
    assert model.without("site").names() == ("family", "day", "residual") and model.without().names() == ("residual",)
    with pytest.raises(ValueError):
        crossed.bordered(lmm.MixedModel(model.data.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(2001)))), "y").with_crossed("l", "l"))
