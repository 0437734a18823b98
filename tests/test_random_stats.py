"""Randomised checks of the test statistics against plain-Python formulas."""

import math

import numpy as np
import pytest

from matingstats.operators.chisq import chisq_test
from matingstats.operators.ranksum import rank_sum_test


def chisq_tail_closed_form(x: float, df: int) -> float:
    """Upper chi-square tail for integer df (even: Poisson sum; odd: erfc plus a sum)."""
    h = x / 2.0
    if df % 2 == 0:
        term, total = 1.0, 0.0
        for j in range(df // 2):
            if j:
                term *= h / j
            total += term
        return math.exp(-h) * total
    total = math.erfc(math.sqrt(h))
    term = math.sqrt(h) / math.gamma(1.5)
    for j in range(1, (df - 1) // 2 + 1):
        if j > 1:
            term *= h / (j - 0.5)
        total += math.exp(-h) * term
    return total


def test_chisq_random_tables(spark):
    rng = np.random.default_rng(21)
    rows, ref = [], {}
    for t in range(40):
        r = int(rng.integers(2, 7))
        o = rng.integers(1, 60, (r, 2)).astype(float)
        for i in range(r):
            for j, lvl in enumerate(("Monogamous", "Polygynous")):
                rows.append((t, f"row{i}", lvl, int(o[i, j])))
        e = o.sum(1)[:, None] * o.sum(0)[None, :] / o.sum()
        dev = np.abs(o - e)
        if r == 2:
            dev = dev - np.minimum(0.5, dev)
        x2 = float((dev ** 2 / e).sum())
        ref[t] = (x2, r - 1, chisq_tail_closed_form(x2, r - 1))
    df = spark.createDataFrame(rows, "t int, r string, c string, n long")
    got = {row["t"]: row for row in chisq_test(df, "r", "c", "n", groups=["t"]).collect()}
    for t, (x2, d, p) in ref.items():
        assert got[t]["statistic"] == pytest.approx(x2, rel=1e-12)
        assert got[t]["df"] == d
        assert got[t]["p_value"] == pytest.approx(p, rel=1e-9, abs=1e-15)


def rank_sum_reference(x, y):
    allv = np.concatenate([x, y])
    order = np.argsort(allv, kind="mergesort")
    ranks = np.empty(len(allv))
    i = 0
    sv = allv[order]
    while i < len(sv):
        j = i
        while j + 1 < len(sv) and sv[j + 1] == sv[i]:
            j += 1
        ranks[order[i:j + 1]] = (i + j) / 2.0 + 1.0
        i = j + 1
    nx, ny = len(x), len(y)
    w = ranks[:nx].sum() - nx * (nx + 1) / 2.0
    _, counts = np.unique(allv, return_counts=True)
    n = nx + ny
    sigma = math.sqrt(nx * ny / 12.0 * ((n + 1) - (counts ** 3 - counts).sum() / (n * (n - 1))))
    d = w - nx * ny / 2.0
    z = (d - math.copysign(0.5, d) if d != 0 else 0.0) / sigma
    return w, math.erfc(abs(z) / math.sqrt(2.0))


def test_rank_sum_random_groups_with_ties(spark):
    rng = np.random.default_rng(8)
    rows, ref = [], {}
    for g in range(30):
        x = rng.integers(0, 12, int(rng.integers(3, 15))).astype(float)
        y = rng.integers(2, 14, int(rng.integers(3, 15))).astype(float)
        rows += [(g, "Monogamous", float(v)) for v in x] + [(g, "Polygynous", float(v)) for v in y]
        ref[g] = rank_sum_reference(x, y)
    df = spark.createDataFrame(rows, "g int, lvl string, v double")
    got = {r["g"]: r for r in rank_sum_test(df, "g", "lvl", "v", first_level="Monogamous").collect()}
    for g, (w, p) in ref.items():
        assert got[g]["W"] == pytest.approx(w, abs=1e-9)
        assert got[g]["p_value"] == pytest.approx(p, rel=1e-9, abs=1e-15)
