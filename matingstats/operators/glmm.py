"""Random-intercept logistic regression, Laplace approximation.

Model: y ~ Bernoulli(logit^-1(x beta + sigma u_g)), u_g ~ N(0, 1), one
intercept per group g (year). Rows are first reduced by Spark to one cell
per (group, level): trials n and successes s. With a 0/1 row response the
reduced log-likelihood equals the row-level one exactly.

Laplace term of group g at (beta, sigma):
    h(u)   = sum_c [s_c eta_c - n_c ln(1 + e^eta_c)] - u^2 / 2,  eta = x beta + sigma u
    l_g    = h(u_hat) - 1/2 ln(1 + sigma^2 sum_c n_c p_c (1 - p_c))
with h'(u_hat) = 0, found by Newton steps kept inside a bracket until they vanish. The log-likelihood, its
gradient and its Hessian are sums over groups of closed forms (u_hat's own derivatives follow from h' = 0);
each evaluation is one Spark job in which the partitions return their sums. The driver only holds the
parameter vector and takes Newton steps; a fit that does not converge raises an error.

The likelihood is even in sigma, so sigma itself is a free parameter (|sigma|
is reported); a fit on the boundary sigma = 0 converges like any interior one.
Standard errors and correlations of the fixed effects come from the inverse of the whole Hessian.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matingstats.functions.special import norm_two_sided_sql
from matingstats.session import reliable_checkpoint

# The group terms below run in Python workers; shipped by value they need no installed package there.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover - older cloudpickle
    pass

INTERCEPT = "(Intercept)"
#: Levels of the fixed factor at most: the parameters are on the driver.
MAX_LEVELS = 200


def _cells(df: DataFrame, y: str, factor: str, group: str) -> DataFrame:
    return (df.where(F.col(y).isNotNull() & F.col(factor).isNotNull() & F.col(group).isNotNull())
              .groupBy(F.col(group).cast("string").alias("g"), F.col(factor).cast("string").alias("lvl"))
              .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y)).cast("double").alias("s")))


def _expit(eta: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * eta))


def group_modes(s: np.ndarray, n: np.ndarray, xb: np.ndarray, sigma: float) -> np.ndarray:
    """u_hat of each group: the root of the falling function h'(u) = sigma sum(s - n p) - u; s and n have a row per group, a column per cell."""
    high = np.abs(sigma) * n.sum(axis=1)  # |s - n p| is at most n
    low = -high
    u = np.zeros(len(s))
    open_ = np.arange(len(s))
    for _ in range(500):
        p = _expit(xb + sigma * u[open_, None])
        own = n[open_]
        slope = sigma * (s[open_] - own * p).sum(axis=1) - u[open_]
        low[open_] = np.where(slope > 0, u[open_], low[open_])
        high[open_] = np.where(slope > 0, high[open_], u[open_])
        new = u[open_] + slope / (1.0 + sigma * sigma * (own * p * (1 - p)).sum(axis=1))
        outside = (new < low[open_]) | (new > high[open_])
        new = np.where(outside, 0.5 * (low[open_] + high[open_]), new)
        moved = np.abs(new - u[open_]) > 1e-13 * (1.0 + np.abs(u[open_]))
        u[open_] = new
        open_ = open_[moved]
        if not len(open_):
            return u
    raise RuntimeError("the mode of a group was not found")


def laplace_terms(s: np.ndarray, n: np.ndarray, X: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Laplace log-likelihoods of groups, gradients and Hessians in (beta, sigma); s and n have a row per group, a column per row of ``X``.

    With z = (beta, sigma, u) and G(z) = h - 1/2 ln I, I = -h_uu: l(theta) = G(theta, u_hat(theta)).
    """
    beta, sigma = theta[:-1], float(theta[-1])
    m, q = len(s), len(beta)
    xb = X @ beta
    u = group_modes(s, n, xb, sigma)
    eta = xb + sigma * u[:, None]
    p = _expit(eta)
    w = p * (1 - p)
    a1, a2, a3, a4 = s - n * p, -n * w, -n * w * (1 - 2 * p), -n * w * (1 - 6 * w)
    J = np.empty((m, len(X), q + 2))  # d eta / d z
    J[:, :, :q], J[:, :, q], J[:, :, q + 1] = X, u[:, None], sigma
    e_s, e_u = np.eye(q + 2)[q], np.eye(q + 2)[q + 1]
    cross = np.outer(e_s, e_u) + np.outer(e_u, e_s)  # d2 eta / d z2

    def along(c: np.ndarray) -> np.ndarray:
        return np.einsum("gl,gla->ga", c, J)

    def outer(c: np.ndarray) -> np.ndarray:
        return np.einsum("gla,gl,glb->gab", J, c, J, optimize=True)

    def each(x: np.ndarray) -> np.ndarray:
        return x[:, None, None]

    def with_s(x: np.ndarray) -> np.ndarray:
        return x[:, :, None] * e_s + e_s[:, None] * x[:, None, :]

    t1, t2, t3 = a1.sum(axis=1), a2.sum(axis=1), a3.sum(axis=1)
    h_z = along(a1) - u[:, None] * e_u
    h_zz = outer(a2) + each(t1) * cross - np.outer(e_u, e_u)
    # d h_zz / d u
    h_uzz = sigma * outer(a3) + with_s(along(a2)) + each(sigma * t2) * cross
    info = 1.0 - sigma * sigma * t2
    i_z = -(sigma * sigma * along(a3) + 2 * sigma * t2[:, None] * e_s)
    i_zz = -(sigma * sigma * (outer(a4) + each(t3) * cross) + 2 * sigma * with_s(along(a3)) + each(2 * t2) * np.outer(e_s, e_s))
    G_z = h_z - 0.5 * i_z / info[:, None]
    G_zz = h_zz - 0.5 * (i_zz / each(info) - i_z[:, :, None] * i_z[:, None, :] / each(info**2))
    h_uu = h_zz[:, -1, -1]
    D = np.zeros((m, q + 2, q + 1))  # d (theta, u_hat) / d theta
    D[:, :q + 1] = np.eye(q + 1)
    D[:, q + 1] = -h_zz[:, -1, :-1] / h_uu[:, None]
    D_t = D.transpose(0, 2, 1)
    u_tt = -(D_t @ h_uzz @ D) / each(h_uu)
    ll = (s * eta - n * np.logaddexp(0.0, eta)).sum(axis=1) - u * u / 2.0 - 0.5 * np.log(info)
    return ll, np.einsum("gab,gb->ga", D_t, G_z), D_t @ G_zz @ D + each(G_z[:, -1]) * u_tt


def _blocks(batch: pd.DataFrame, levels: int, rows: int = 4096):
    """(successes, trials) of some groups at a time; ``batch`` has the trials' columns first."""
    data = batch.to_numpy(dtype=float)
    for at in range(0, len(data), rows):
        yield data[at:at + rows, levels:], data[at:at + rows, :levels]


class _Objective:
    """Log-likelihood, gradient and Hessian at a parameter vector, one Spark job each.

    A group is one row with a column of trials and one of successes per factor level; every partition adds up the terms of its
    groups, a block of them at a time, and returns one row.
    """

    def __init__(self, cells: DataFrame, levels: list[str]):
        self.levels = levels
        n = [F.sum(F.when(F.col("lvl") == v, F.col("n")).otherwise(0.0)).alias(f"n{k}") for k, v in enumerate(levels)]
        s = [F.sum(F.when(F.col("lvl") == v, F.col("s")).otherwise(0.0)).alias(f"s{k}") for k, v in enumerate(levels)]
        self.wide = reliable_checkpoint(cells.groupBy("g").agg(*n, *s)).drop("g")
        self.X = np.eye(len(levels))
        self.X[:, 0] = 1.0

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        q, X = len(self.levels), self.X

        def add(batches):
            ll, g, H = 0.0, np.zeros(q + 1), np.zeros((q + 1, q + 1))
            for batch in batches:
                for s, n in _blocks(batch, q):
                    one = laplace_terms(s, n, X, theta)
                    ll, g, H = ll + one[0].sum(), g + one[1].sum(axis=0), H + one[2].sum(axis=0)
            yield pd.DataFrame({"ll": [ll], "g": [g.tolist()], "h": [H.ravel().tolist()]})

        parts = self.wide.mapInPandas(add, "ll double, g array<double>, h array<double>").collect()  # a row a partition
        return (math.fsum(r["ll"] for r in parts), np.sum([r["g"] for r in parts], axis=0),
                np.sum([r["h"] for r in parts], axis=0).reshape(q + 1, q + 1))

    def residuals(self, theta: np.ndarray) -> DataFrame:
        """(residual, n): Pearson residuals of the 0/1 rows at the modes of their groups, and how many rows have each."""
        q, X = len(self.levels), self.X

        def found(batches):
            for batch in batches:
                for s, n in _blocks(batch, q):
                    xb = X @ theta[:-1]
                    p = _expit(xb + theta[-1] * group_modes(s, n, xb, float(theta[-1]))[:, None])
                    odds = np.sqrt((1 - p) / p)
                    yield pd.DataFrame({"residual": np.concatenate([odds.ravel(), -1 / odds.ravel()]), "n": np.concatenate([s.ravel(), (n - s).ravel()]).astype(np.int64)})

        return self.wide.mapInPandas(found, "residual double, n long").where("n > 0")


def _pooled_start(cells: DataFrame, levels: list[str]) -> np.ndarray:
    """Fixed effects of the pooled logistic fit (sigma = 0): closed form for one factor."""
    tot = {r["lvl"]: (r["s"], r["n"]) for r in
           cells.groupBy("lvl").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}

    def logit(lvl):
        s, n = tot[lvl]
        q = min(max(s / n, 1e-6), 1 - 1e-6)
        return math.log(q / (1 - q))

    b0 = logit(levels[0])
    return np.array([b0] + [logit(lvl) - b0 for lvl in levels[1:]])


def _ascent_direction(g: np.ndarray, H: np.ndarray) -> np.ndarray:
    """Newton direction with the Hessian's eigenvalues forced negative, so it always ascends."""
    w, V = np.linalg.eigh((H + H.T) / 2.0)
    w = -np.maximum(np.abs(w), 1e-8)
    d = -(V @ ((V.T @ g) / w))
    return d if np.all(np.isfinite(d)) else g


def random_intercept_logit(df: DataFrame, y: str, factor: str, group: str, max_iter: int = 100) -> DataFrame:
    """Fit y ~ factor + (1 | group) on row-level 0/1 data; returns a tidy table
    (effect, term, estimate, std_error, z_value, p_value): the fixed effects and their correlations, the group spread, the fit's criteria and
    sizes, and the quantiles of the scaled residuals (Pearson, of the 0/1 rows, at the modes of their groups)."""
    return _fit(_cells(df, y, factor, group), factor, group, max_iter)


def random_intercept_logit_counts(df: DataFrame, group: str, factor: str, trials: str, successes: str,
                                  max_iter: int = 100) -> DataFrame:
    """The same fit from counts (trials and successes per group and level):
    the sufficient statistics, so no row per observation is ever made."""
    cells = (df.where(F.col(group).isNotNull() & F.col(factor).isNotNull())
               .groupBy(F.col(group).cast("string").alias("g"), F.col(factor).cast("string").alias("lvl"))
               .agg(F.sum(trials).cast("double").alias("n"), F.sum(successes).cast("double").alias("s"))
               .where(F.col("n") > 0))
    return _fit(cells, factor, group, max_iter)


def _maximise(f, theta: np.ndarray, max_iter: int) -> tuple[np.ndarray, float, np.ndarray, int]:
    """Newton steps with halving until the predicted gain is lost in the rounding of the log-likelihood."""
    ll, g, H = f(theta)
    for k in range(max_iter):
        d = _ascent_direction(g, H)
        if g @ d <= 1e-10 * (1.0 + abs(ll) * 1e-4) and np.abs(d).max() < 1e-5:
            return theta, ll, H, k
        step = 1.0
        while step > 1e-10:
            new = f(theta + step * d)
            if np.isfinite(new[0]) and new[0] >= ll - 1e-13 * abs(ll):
                break
            step /= 4.0
        else:
            break
        theta, (ll, g, H) = theta + step * d, new
    raise RuntimeError("the mixed model did not converge")


def _fit(cells: DataFrame, factor: str, group: str, max_iter: int) -> DataFrame:
    spark = cells.sparkSession
    cells = reliable_checkpoint(cells)
    found = cells.select("lvl").distinct().limit(MAX_LEVELS + 1).collect()
    if len(found) > MAX_LEVELS:
        raise ValueError(f"the factor {factor} has more than {MAX_LEVELS} levels")
    levels = sorted(r["lvl"] for r in found)
    p = len(levels)
    start = np.append(_pooled_start(cells, levels), 0.2)
    objective = _Objective(cells, levels)
    theta, ll, H, steps = _maximise(objective, start, max_iter)
    try:
        cov = np.linalg.inv(-H)
    except np.linalg.LinAlgError:
        cov = np.full(H.shape, np.nan)
    se = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), np.nan))[:p]
    names = [INTERCEPT] + [f"{factor}{lvl}" for lvl in levels[1:]]
    sigma = float(abs(theta[-1]))
    size = cells.agg(F.sum("n").alias("n"), F.count_distinct("g").alias("g")).first()
    spread = objective.residuals(theta).agg(F.expr("percentile(residual, array(0, 0.25, 0.5, 0.75, 1), n)").alias("q")).first()["q"]
    rows = [("fixed", names[i], float(theta[i]), float(se[i])) for i in range(p)]
    rows += [("correlation", f"{names[i]}:{names[j]}", float(cov[i, j] / (se[i] * se[j])), None) for i in range(p) for j in range(i)]
    rows += [("ran_pars", f"sd__(Intercept)|{group}", sigma, None),
             ("ran_pars", f"var__(Intercept)|{group}", sigma * sigma, None),
             ("fit", "logLik", ll, None),
             ("fit", "AIC", float(-2 * ll + 2 * (p + 1)), None),
             ("fit", "BIC", float(-2 * ll + (p + 1) * math.log(size["n"])), None),
             ("fit", "deviance", float(-2 * ll), None),
             ("fit", "df.resid", float(size["n"] - (p + 1)), None),
             ("fit", "observations", float(size["n"]), None),
             ("fit", "groups", float(size["g"]), None),
             ("fit", "steps to convergence", float(steps), None)]
    rows += [("residuals", name, float(v), None) for name, v in zip(("Min", "1Q", "Median", "3Q", "Max"), spread)]
    schema = T.StructType([T.StructField("effect", T.StringType()), T.StructField("term", T.StringType()),
                           T.StructField("estimate", T.DoubleType()), T.StructField("std_error", T.DoubleType())])
    out = spark.createDataFrame(rows, schema).withColumn("z_value", F.col("estimate") / F.col("std_error"))
    return out.withColumn("p_value", F.when(F.col("std_error").isNotNull(), F.expr(norm_two_sided_sql("z_value"))))
