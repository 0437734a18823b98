"""Logistic and mixed logistic fits against plain numpy references."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matingstats.operators.glm import analysis_of_deviance, fit_logistic, logistic_by_counts, model_summary
from matingstats.operators.glmm import group_modes, laplace_terms, random_intercept_logit


def group_terms(s, n, X, theta):
    """One group: log-likelihood, gradient, Hessian."""
    return tuple(x[0] for x in laplace_terms(s[None], n[None], X, theta))


def irls(x, y, w):
    X = np.column_stack([np.ones_like(x), x])
    b = np.zeros(2)
    for _ in range(100):
        eta = X @ b
        p = 1 / (1 + np.exp(-eta))
        W = w * p * (1 - p)
        z = eta + (y - p) / (p * (1 - p))
        b_new = np.linalg.solve(X.T @ (W[:, None] * X), X.T @ (W * z))
        if np.abs(b_new - b).max() < 1e-12:
            b = b_new
            break
        b = b_new
    p = 1 / (1 + np.exp(-(X @ b)))
    cov = np.linalg.inv(X.T @ ((w * p * (1 - p))[:, None] * X))
    dev = -2 * np.sum(w * (y * np.log(p) + (1 - y) * np.log(1 - p)))
    return b, np.sqrt(np.diag(cov)), dev


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(2000, 2010, 400).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.08 * (x - 2005))))).astype(int)
    return spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "year double, bin int"), x, y


def test_logistic_equals_row_level_irls(data):
    df, x, y = data
    b, se, dev = irls(x, y.astype(float), np.ones_like(x))
    got = {r["term"]: r for r in logistic_by_counts(df, "year", "bin").collect()}
    assert got["(Intercept)"]["estimate"] == pytest.approx(b[0], rel=1e-6)
    assert got["year"]["estimate"] == pytest.approx(b[1], rel=1e-6)
    assert got["year"]["std_error"] == pytest.approx(se[1], rel=1e-5)
    z = b[1] / se[1]
    assert got["year"]["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6)
    an = {r["term"]: r for r in analysis_of_deviance(df, "year", "bin").collect()}
    assert an["year"]["resid_dev"] == pytest.approx(dev, rel=1e-6)
    assert an["year"]["resid_df"] == 398.0 and an["NULL"]["resid_df"] == 399.0
    whole = model_summary(df, "year", "bin").first()
    assert whole["aic"] == pytest.approx(dev + 4, rel=1e-6) and whole["null_deviance"] == pytest.approx(an["NULL"]["resid_dev"], rel=1e-9)


def test_logistic_is_the_same_under_any_partitioning(spark):
    draw = np.random.default_rng(11)
    x = draw.integers(1990, 2010, 3000)
    y = (draw.random(3000) < 1 / (1 + np.exp(-0.05 * (x - 2001)))).astype(int)
    found, steps = [], set()
    for parts in (1, 2, 3, 5, 8, 16):
        order = draw.permutation(3000)
        df = spark.createDataFrame([(int(x[k]), int(y[k])) for k in order], "year int, bin int").repartition(parts)
        fit = fit_logistic(df, "year", "bin")
        assert fit.converged and not fit.separated
        steps.add(fit.steps)
        found.append((fit.intercept, fit.slope, fit.se_intercept, fit.se_slope, fit.deviance))
    assert len(steps) == 1 and max(steps) < 10
    for row in found[1:]:
        assert row == pytest.approx(found[0], rel=1e-10)
    b, se, dev = irls(x - 2000.0, y.astype(float), np.ones(3000))
    assert found[0][1] == pytest.approx(b[1], rel=1e-10) and found[0][3] == pytest.approx(se[1], rel=1e-9)
    assert found[0][0] == pytest.approx(b[0] - 2000 * b[1], rel=1e-10) and found[0][4] == pytest.approx(dev, rel=1e-12)


@pytest.mark.parametrize("rows, want", [
    # complete separation, rising and falling
    ([(1, 0), (2, 0), (3, 1), (4, 1)], dict(intercept=None, slope=math.inf, se_slope=None, deviance=0.0, separated=True)),
    ([(1, 1), (2, 1), (3, 0)], dict(slope=-math.inf, deviance=0.0, separated=True)),
    # a common border value: one of three succeeds there
    ([(1, 0), (2, 0), (2, 0), (2, 1), (3, 1)], dict(slope=math.inf, separated=True, deviance=-2 * (math.log(1 / 3) + 2 * math.log(2 / 3)))),
    # one class, one predictor value, nothing
    ([(1, 1), (2, 1)], dict(intercept=math.inf, slope=None, deviance=0.0, parameters=1, separated=True)),
    ([(1, 0), (2, 0)], dict(intercept=-math.inf, slope=None, separated=True)),
    ([(5, 0), (5, 1), (5, 1)], dict(intercept=math.log(2), slope=None, parameters=1, separated=False, se_intercept=math.sqrt(1.5))),
    ([(None, 1), (5, None)], dict(trials=0.0, intercept=None, slope=None, deviance=None, parameters=0)),
])
def test_logistic_without_a_maximum_is_defined(spark, rows, want):
    df = spark.createDataFrame(rows, "x int, y int")
    fit = fit_logistic(df, "x", "y")
    for name, value in want.items():
        got = getattr(fit, name)
        assert got == value if value is None or isinstance(value, bool) or math.isinf(value) else got == pytest.approx(value, rel=1e-12, abs=1e-12), name
    assert len(logistic_by_counts(df, "x", "y").collect()) == 2
    assert len(analysis_of_deviance(df, "x", "y").collect()) == 2
    summary = model_summary(df, "x", "y").first()
    assert summary["separated"] == fit.separated and summary["converged"]


def test_laplace_group_term_matches_quadrature():
    s, n = np.array([3.0, 7.0]), np.array([10.0, 12.0])
    xb = np.array([[0.2, -0.4]])
    for sigma in (0.0, 0.5, 1.0):
        lap = group_terms(s, n, np.eye(2), np.array([*xb[0], sigma]))[0]
        u = np.linspace(-10, 10, 20001)
        eta = xb[0][None, :] + sigma * u[:, None]
        ll = (s * eta - n * np.logaddexp(0, eta)).sum(1)
        dens = np.exp(ll - u * u / 2) / math.sqrt(2 * math.pi)
        quad = math.log(np.trapezoid(dens, u))
        tol = 1e-9 if sigma == 0 else 0.05
        assert lap == pytest.approx(quad, abs=tol)


def test_mixed_logit_tends_to_plain_logistic(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(8):
        for lvl, base in (("Lower", 0.3), ("Upper", -0.2)):
            for _ in range(60):
                rows.append((g, lvl, int(rng.random() < 1 / (1 + math.exp(-base)))))
    df = spark.createDataFrame(rows, "g int, valley string, y int")
    fit = {r["term"]: r for r in random_intercept_logit(df, "y", "valley", "g").collect()}
    # with no group effect in the data the fixed effects match the pooled logistic fit
    lower = [y for _, v, y in rows if v == "Lower"]
    upper = [y for _, v, y in rows if v == "Upper"]
    b0 = math.log(np.mean(lower) / (1 - np.mean(lower)))
    b1 = math.log(np.mean(upper) / (1 - np.mean(upper))) - b0
    assert fit["(Intercept)"]["estimate"] == pytest.approx(b0, abs=0.05)
    assert fit["valleyUpper"]["estimate"] == pytest.approx(b1, abs=0.05)
    assert fit["sd__(Intercept)|g"]["estimate"] < 0.3


def test_mixed_logit_recovers_group_spread(spark):
    rng = np.random.default_rng(11)
    rows = []
    u = rng.normal(0, 1.0, 40)
    for g in range(40):
        for lvl, base in (("Lower", -0.5), ("Upper", 0.5)):
            eta = base + u[g]
            for y in (rng.random(150) < 1 / (1 + np.exp(-eta))).astype(int):
                rows.append((g, lvl, int(y)))
    df = spark.createDataFrame(rows, "g int, valley string, y int")
    fit = {r["term"]: r for r in random_intercept_logit(df, "y", "valley", "g").collect()}
    assert fit["sd__(Intercept)|g"]["estimate"] == pytest.approx(1.0, abs=0.35)
    assert fit["valleyUpper"]["estimate"] == pytest.approx(1.0, abs=0.25)


def test_mixed_logit_from_counts_equals_rows(spark):
    from matingstats.operators.glmm import random_intercept_logit_counts
    from matingstats.operators.reshape import uncount
    counts = spark.createDataFrame(
        [(g, v, int(20 + 7 * g + (5 if v == "Upper" else 0)), int(9 + 3 * g + (4 if v == "Upper" else 0) - (g % 3)))
         for g in range(6) for v in ("Lower", "Upper")], "g int, valley string, trials long, successes long")
    a = {r["term"]: r["estimate"] for r in random_intercept_logit_counts(counts, "g", "valley", "trials",
                                                                         "successes").collect()}
    rows = uncount(counts.select("g", "valley", F.col("successes").alias("count")), "count") \
        .withColumn("y", F.lit(1)).unionByName(
        uncount(counts.select("g", "valley", (F.col("trials") - F.col("successes")).alias("count")), "count")
        .withColumn("y", F.lit(0)))
    b = {r["term"]: r["estimate"] for r in random_intercept_logit(rows, "y", "valley", "g").collect()}
    for k in ("(Intercept)", "valleyUpper", "logLik"):
        assert a[k] == pytest.approx(b[k], rel=1e-7, abs=1e-9)


def test_laplace_derivatives_match_differences():
    rng = np.random.default_rng(1)
    for _ in range(5):
        n = rng.integers(1, 50, 3).astype(float)
        s = np.floor(n * rng.random(3))
        X = np.array([[1.0, 0, 0], [1, 1, 0], [1, 0, 1]])
        t, h = np.array([0.3, -0.5, 0.8, 0.7 * rng.random()]), 1e-6
        _, g, H = group_terms(s, n, X, t)
        step = h * np.eye(4)
        up, down = [group_terms(s, n, X, t + d) for d in step], [group_terms(s, n, X, t - d) for d in step]
        assert g == pytest.approx(np.array([(a[0] - b[0]) / (2 * h) for a, b in zip(up, down)]), abs=1e-6)
        assert H == pytest.approx(np.array([(a[1] - b[1]) / (2 * h) for a, b in zip(up, down)]), abs=1e-6)


def test_laplace_mode_converges_for_large_groups():
    # the mode lies far from 0: u is about 402
    ll = group_terms(np.array([6e8]), np.array([1e9]), np.array([[1.0]]), np.array([0.0, 0.001]))[0]
    assert ll == pytest.approx(-6.731e8, rel=1e-4)


def test_standard_errors_come_from_the_whole_hessian(spark):
    rng = np.random.default_rng(2)
    cells = [(g, v, 40, int(rng.binomial(40, 1 / (1 + math.exp(-(b + u)))))) for g, u in enumerate(rng.normal(0, 1, 8))
             for v, b in (("Lower", -0.2), ("Upper", 0.6))]
    from matingstats.operators.glmm import random_intercept_logit_counts
    df = spark.createDataFrame(cells, "g int, valley string, n long, s long")
    fit = {r["term"]: r for r in random_intercept_logit_counts(df, "g", "valley", "n", "s").collect()}
    theta = np.array([fit["(Intercept)"]["estimate"], fit["valleyUpper"]["estimate"], fit["sd__(Intercept)|g"]["estimate"]])
    g, H = np.zeros(3), np.zeros((3, 3))
    for k in range(8):
        own = [c for c in cells if c[0] == k]
        X = np.array([[1.0, c[1] == "Upper"] for c in own])
        _, a, b = group_terms(np.array([c[3] for c in own], float), np.array([c[2] for c in own], float), X, theta)
        g, H = g + a, H + b
    assert np.abs(g).max() < 1e-4
    se = np.sqrt(np.diag(np.linalg.inv(-H)))
    assert fit["(Intercept)"]["std_error"] == pytest.approx(se[0], rel=1e-6) and fit["valleyUpper"]["std_error"] == pytest.approx(se[1], rel=1e-6)


def test_mixed_logit_summary_parts(spark):
    draw = np.random.default_rng(21)
    u = draw.normal(0, 0.7, 30)
    counts = [(g, v, int(n), int(draw.binomial(n, 1 / (1 + math.exp(-(b + u[g])))))) for g in range(30) for v, b in (("Lower", -0.3), ("Mid", 0.1), ("Upper", 0.6))
              for n in [draw.integers(0, 40)] if not (g == 4 and v == "Mid")]
    df = spark.createDataFrame(counts, "g int, valley string, trials long, successes long").repartition(3)
    from matingstats.operators.glmm import random_intercept_logit_counts
    got = {(r["effect"], r["term"]): r for r in random_intercept_logit_counts(df, "g", "valley", "trials", "successes").collect()}
    n = sum(c[2] for c in counts)
    ll = got["fit", "logLik"]["estimate"]
    assert got["fit", "observations"]["estimate"] == n and got["fit", "df.resid"]["estimate"] == n - 4
    assert got["fit", "groups"]["estimate"] == len({c[0] for c in counts if c[2]})
    assert got["fit", "BIC"]["estimate"] == pytest.approx(-2 * ll + 4 * math.log(n), rel=1e-12) and got["fit", "deviance"]["estimate"] == pytest.approx(-2 * ll, rel=1e-12)
    # residuals and correlations from the printed estimates, group by group and row by row
    levels = ["Lower", "Mid", "Upper"]
    beta = np.array([got["fixed", t]["estimate"] for t in ("(Intercept)", "valleyMid", "valleyUpper")])
    sigma = got["ran_pars", "sd__(Intercept)|g"]["estimate"]
    X = np.eye(3)
    X[:, 0] = 1
    rows, H = [], np.zeros((4, 4))
    for g in {c[0] for c in counts}:
        s, m = np.zeros(3), np.zeros(3)
        for _, v, a, b in [c for c in counts if c[0] == g]:
            m[levels.index(v)], s[levels.index(v)] = a, b
        mode = group_modes(s[None], m[None], X @ beta, sigma)[0]
        p = 1 / (1 + np.exp(-(X @ beta + sigma * mode)))
        for k in range(3):
            rows += [math.sqrt((1 - p[k]) / p[k])] * int(s[k]) + [-math.sqrt(p[k] / (1 - p[k]))] * int(m[k] - s[k])
        H += group_terms(s, m, X, np.append(beta, sigma))[2]
    for name, q in zip(("Min", "1Q", "Median", "3Q", "Max"), (0, 0.25, 0.5, 0.75, 1)):
        assert got["residuals", name]["estimate"] == pytest.approx(np.quantile(rows, q), rel=1e-6)
    cov = np.linalg.inv(-H)
    assert got["correlation", "valleyUpper:valleyMid"]["estimate"] == pytest.approx(cov[2, 1] / math.sqrt(cov[1, 1] * cov[2, 2]), rel=1e-5)
    assert got["correlation", "valleyMid:(Intercept)"]["estimate"] == pytest.approx(cov[1, 0] / math.sqrt(cov[1, 1] * cov[0, 0]), rel=1e-5)
