"""Fisher's exact test for r x 2 tables (T4) and its Monte-Carlo form (T5).

With both margins fixed, a table with first-column counts x_i has
probability prod_i C(r_i, x_i) / C(N, c_1). The p-value sums the
probabilities of all tables no more probable than the observed one (relative
tolerance 1e-7).

* 2 x 2 per group: pure column expressions - bisection for the two tails and
  an ``aggregate`` over the significant part of the support (grows with
  sqrt(n)); no Python.
* r x 2 per group, up to three rows: the first row's counts are exploded over
  the significant window and spread over tasks; the last two rows are a 2 x 2 tail. More rows: ``fisher_network``.
* Monte-Carlo: ``spark.range(B)`` spread over partitions, ``mapInPandas``
  draws random tables with the observed margins (successive hypergeometric
  draws per row); a draw is a hit when it is no more probable than the observed
  one. p = (1 + hits) / (B + 1). Seeds come from the partition id, so a
  re-run task repeats its draws exactly.

Densities are in saddle-point form (deviance plus Stirling remainders): no large
logarithms cancel, whatever the counts. Ends of sums are where ln P falls ``DEPTH`` below
the threshold: the result is at least the threshold's probability, so what is
left out is below its double precision.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matingstats.functions.special import ln_binomial_sql
from matingstats.operators.fisher_network import BROADCAST_GROUPS, network_p
from matingstats.session import reliable_checkpoint

# The Monte-Carlo functions below run in Python workers. Pickling
# this module by value ships their code with the task, so executors need no
# installed copy of the package.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover - older cloudpickle
    pass

REL_TOL = 1e-7
DEPTH = 40.0


def fisher_2x2(tables: DataFrame, groups: Sequence[str], row: str, c1: str, c2: str) -> DataFrame:
    """Per group with exactly two rows: the exact p-value (NULL otherwise).

    Returns groups, n_rows (table rows), p_value.
    """
    g = list(groups)
    t = tables.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min_by(F.col(c1), F.col(row)).cast("bigint").alias("_a"),
        F.min_by(F.col(c2), F.col(row)).cast("bigint").alias("_b"),
        F.max_by(F.col(c1), F.col(row)).cast("bigint").alias("_c"),
        F.max_by(F.col(c2), F.col(row)).cast("bigint").alias("_d"))
    t = with_fisher_2x2(t, "_a", "_b", "_c", "_d", "_p")
    return t.select(*g, F.col("n_rows").cast("int").alias("n_rows"),
                    F.when(F.col("n_rows") == 2, F.col("_p")).alias("p_value"))


def with_fisher_2x2(df: DataFrame, a: str, b: str, c: str, d: str, out: str = "p_value") -> DataFrame:
    """Add the exact two-sided p-value of [[a, b], [c, d]] as column ``out``.

    The first cell is hypergeometric (r1 = a + b, r2 = c + d, k = a + c); the
    p-value is the mass of the cells no more probable than ``a``.
    """
    x = df.withColumns({"_f_a": F.col(a).cast("bigint"), "_f_r1": (F.col(a) + F.col(b)).cast("bigint"),
                        "_f_r2": (F.col(c) + F.col(d)).cast("bigint"), "_f_k": (F.col(a) + F.col(c)).cast("bigint")})
    x = _with_hyper(x, "_f", "_f_r1", "_f_r2", "_f_k")
    x = x.withColumn("_f_thr", F.expr(f"{_ln_hyper('_f', '_f_a')} + {math.log1p(REL_TOL)!r}"))
    x = with_hyper_tail(x, "_f_r1", "_f_r2", "_f_k", "_f_thr", "_f_mass")
    p = F.when(F.col("_f_r1") + F.col("_f_r2") == 0, F.lit(None).cast("double")).otherwise(F.col("_f_mass"))
    return x.withColumn(out, p).drop("_f_a", "_f_r1", "_f_r2", "_f_k", "_f_thr", "_f_mass", *_hyper_columns("_f"))


def _hyper_columns(pre: str) -> list[str]:
    return [f"{pre}_{n}" for n in ("R1", "R2", "K", "P", "Q", "C", "lo", "hi", "mode")]


def _with_hyper(df: DataFrame, pre: str, r1: str, r2: str, k: str) -> DataFrame:
    """Columns of the hypergeometric law (draw k from r1 + r2, r1 marked): margins as doubles, the binomial p and q
    of the saddle point, the constant, the ends of the support and the mode."""
    n = f"({pre}_R1 + {pre}_R2)"
    x = df.withColumns({f"{pre}_R1": F.col(r1).cast("double"), f"{pre}_R2": F.col(r2).cast("double"), f"{pre}_K": F.col(k).cast("double"),
                        f"{pre}_lo": F.expr(f"greatest(CAST(0 AS BIGINT), {k} - {r2})"), f"{pre}_hi": F.expr(f"CAST(least({r1}, {k}) AS BIGINT)")})
    x = x.withColumns({f"{pre}_P": F.expr(f"coalesce(try_divide({pre}_K, {n}), 0D)"), f"{pre}_Q": F.expr(f"coalesce(try_divide({n} - {pre}_K, {n}), 1D)"),
                       f"{pre}_mode": F.expr(f"least({pre}_hi, greatest({pre}_lo, CAST(floor(({pre}_K + 1) * ({pre}_R1 + 1) / ({n} + 2)) AS BIGINT)))")})
    return x.withColumn(f"{pre}_C", F.expr(ln_binomial_sql(f"{pre}_K", n, f"{pre}_P", f"{pre}_Q")))


def _ln_hyper(pre: str, v: str) -> str:
    """ln P(X = v) under the law ``pre``; v is a bigint expression."""
    x = f"CAST({v} AS DOUBLE)"
    return (f"({ln_binomial_sql(x, f'{pre}_R1', f'{pre}_P', f'{pre}_Q')} + "
            f"{ln_binomial_sql(f'({pre}_K - {x})', f'{pre}_R2', f'{pre}_P', f'{pre}_Q')} - {pre}_C)")


def _crossings(pre: str, thr: str, left: tuple[str, str], right: tuple[str, str]) -> str:
    """SQL struct (uL, vL, uR, vR) by bisection: neighbours with ln P(uL) <= thr < ln P(vL) on the rising side between
    ``left`` and ln P(uR) > thr >= ln P(vR) on the falling side between ``right``. Both in one loop."""
    # transform over a one-element array binds the midpoints and their tests once
    step = ("element_at(transform(array(named_struct("
            "'mL', CAST(floor((st.uL + st.vL) / 2) AS BIGINT), 'mR', CAST(floor((st.uR + st.vR) / 2) AS BIGINT))),"
            f" m -> element_at(transform(array(named_struct('mL', m.mL, 'mR', m.mR,"
            f" 'okL', {_ln_hyper(pre, 'm.mL')} <= {thr}, 'okR', {_ln_hyper(pre, 'm.mR')} <= {thr})),"
            " q -> named_struct('uL', IF(q.okL, q.mL, st.uL), 'vL', IF(q.okL, st.vL, q.mL),"
            " 'uR', IF(q.okR, st.uR, q.mR), 'vR', IF(q.okR, q.mR, st.vR))), 1)), 1)")
    steps = f"least(64, CAST(ceil(log2(CAST({pre}_hi - {pre}_lo + 2 AS DOUBLE))) + 1 AS INT))"
    init = f"named_struct('uL', {left[0]}, 'vL', {left[1]}, 'uR', {right[0]}, 'vR', {right[1]})"
    return f"aggregate(sequence(1, {steps}), {init}, (st, i) -> {step})"


def with_hyper_tail(df: DataFrame, r1: str, r2: str, k: str, thr: str, out: str) -> DataFrame:
    """Add ``out`` = sum of P(X = x) over the x with ln P(X = x) <= ``thr``,
    X hypergeometric (draw k from r1 + r2, r1 marked), as column expressions.

    X is log-concave with mode m, so {x : ln P <= thr} is two tails [lo, L]
    and [R, hi]. L and R are found by bisection on ln P, and so are the points outward
    from which ln P is below thr - DEPTH; between them each tail is summed with the ratio recurrence
    P(x -/+ 1) / P(x). The work grows with sqrt(n), not n. Row constants are computed once as
    columns before the ``aggregate`` loops (lambdas are evaluated without
    codegen, so nothing heavy stays inside them). The expressions are written
    as SQL text: one parse per stage instead of thousands of small calls.
    """
    E = F.expr
    x = df.withColumns({"_h_r1": F.col(r1).cast("bigint"), "_h_r2": F.col(r2).cast("bigint"),
                        "_h_k": F.col(k).cast("bigint"), "_h_thr": F.col(thr).cast("double")})
    x = _with_hyper(x, "_h", "_h_r1", "_h_r2", "_h_k")
    # one ln P expansion serves several points
    x = x.withColumn("_h_pts", E(f"transform(array(_h_lo, _h_hi, _h_mode), v -> {_ln_hyper('_h', 'v')})"))
    x = x.withColumn("_h_bis", E(_crossings("_h", "_h_thr", ("_h_lo", "_h_mode"), ("_h_mode", "_h_hi"))))
    x = x.withColumns({"_h_L": E("_h_bis.uL"), "_h_R": E("_h_bis.vR")})
    x = x.withColumn("_h_low", E(f"_h_thr - {DEPTH!r}D"))
    x = x.withColumn("_h_pLR", E(f"transform(array(_h_L, _h_R), v -> {_ln_hyper('_h', 'v')})"))
    x = x.withColumn("_h_far", E(_crossings("_h", "_h_low", ("_h_lo", "_h_L"), ("_h_R", "_h_hi"))))
    D = lambda e: f"CAST({e} AS DOUBLE)"
    left_ratio = f"{D('v')} * {D('_h_r2 - _h_k + v')} / ({D('_h_r1 - v + 1')} * {D('_h_k - v + 1')})"
    right_ratio = f"{D('_h_r1 - v')} * {D('_h_k - v')} / ({D('v + 1')} * {D('_h_r2 - _h_k + v + 1')})"

    def tail(start: str, ln_p: str, stop: str, sign: int, ratio: str) -> str:
        # sum P(x) for x = start, start +/- 1, ..., stop using the pmf ratio
        return (f"aggregate(sequence({start}, {stop}, CAST({sign} AS BIGINT)), named_struct('t', exp({ln_p}), 's', 0.0D),"
                f" (acc, v) -> named_struct('t', acc.t * ({ratio}), 's', acc.s + acc.t)).s")

    left = (f"IF(_h_pts[0] <= _h_thr AND _h_pLR[0] > _h_low, "
            f"{tail('_h_L', '_h_pLR[0]', 'IF(_h_pts[0] <= _h_low, _h_far.vL, _h_lo)', -1, left_ratio)}, 0.0D)")
    right = (f"IF(_h_pts[1] <= _h_thr AND _h_pLR[1] > _h_low, "
             f"{tail('_h_R', '_h_pLR[1]', 'IF(_h_pts[1] <= _h_low, _h_far.uR, _h_hi)', 1, right_ratio)}, 0.0D)")
    # the mode is the most probable point: at or below the threshold means every point is
    total = f"IF(_h_pts[2] <= _h_thr, 1.0D, {left} + {right})"
    return x.withColumn(out, E(f"least(1.0D, {total})")).drop(
        "_h_r1", "_h_r2", "_h_k", "_h_thr", "_h_pts", "_h_bis", "_h_L", "_h_R", "_h_low", "_h_pLR", "_h_far", *_hyper_columns("_h"))


# ---------------------------------------------------------------- r x 2 exact

def fisher_rx2(tables: DataFrame, groups: Sequence[str], row: str, c1: str, c2: str) -> DataFrame:
    """Per group: table rows and exact p-value (NULL when fewer than two rows), whatever the number of rows.

    Tables of up to three rows: the first row's counts are exploded, two rows are a tail (``_exploded``). If any table has more, all are
    solved by the network of partial sums (``fisher_network``).
    """
    g = list(groups)
    t = tables.groupBy(*g).agg(F.sort_array(F.collect_list(  # one table per group: its rows are the levels of a factor
        F.struct((F.col(c1) + F.col(c2)).cast("bigint").alias("r"), F.col(c1).cast("bigint").alias("x")))).alias("_rows"))
    t = reliable_checkpoint(t.withColumn("_g", F.monotonically_increasing_id()))  # one key, never NULL; written, so it stays
    most, found = t.agg(F.max(F.size("_rows")), F.count(F.lit(1))).first()
    most = most or 0
    if most <= 3:
        return _exploded(t.drop("_g"), g, max(most, 2))
    p = network_p(t.select("_g", "_rows"), ["_g"], most, found <= BROADCAST_GROUPS, REL_TOL)
    return t.select("_g", *g, F.size("_rows").alias("n_rows")).join(p, "_g").select(*g, "n_rows", F.when(F.col("n_rows") > 1, F.col("p")).alias("p_value"))


def _exploded(t: DataFrame, groups: Sequence[str], rows: int) -> DataFrame:
    """The test of tables (groups, _rows) of at most ``rows`` rows, by explosion.

    With first-column counts x_1..x_r and row totals r_1..r_r, P(x) is the product of
    hypergeometric laws of x_i given the counts before it. The counts of the first r - 2 rows are
    exploded one after the other over the windows in which the product so far is not below the threshold by more than
    DEPTH; for the last two rows ``with_hyper_tail`` gives the mass at or below the threshold. The points are spread
    over tasks; their number grows with n^((r - 2) / 2). Rows are taken by rising totals, which
    leaves the widest ranges to the tail.
    """
    g = list(groups)
    E = F.expr
    zero = "named_struct('r', CAST(0 AS BIGINT), 'x', CAST(0 AS BIGINT))"
    t = t.withColumn("n_rows", F.size("_rows"))
    t = t.withColumn("_rows", E(f"concat(array_repeat({zero}, greatest(0, {rows} - n_rows)), _rows)"))
    t = t.select(*g, "n_rows", *[F.get(F.col("_rows"), F.lit(i))[f].alias(f"_{f}{i + 1}") for i in range(rows) for f in ("r", "x")])
    # the product of the laws at the observed counts
    terms = []
    t = t.withColumn(f"_k{1}", E(" + ".join(f"_x{i}" for i in range(1, rows + 1))))
    for i in range(1, rows):
        t = t.withColumns({f"_rest{i}": E(" + ".join(f"_r{j}" for j in range(i + 1, rows + 1))), f"_k{i + 1}": E(f"_k{i} - _x{i}")})
        t = _with_hyper(t, "_o", f"_r{i}", f"_rest{i}", f"_k{i}").withColumn(f"_ln{i}", E(_ln_hyper("_o", f"_x{i}"))).drop(*_hyper_columns("_o"))
        terms.append(f"_ln{i}")
    t = t.withColumn("_thr", E(f"{' + '.join(terms)} + {math.log1p(REL_TOL)!r}")).withColumn("_sum", F.lit(0.0))
    t = t.withColumn("_k", F.col("_k1")).select(*g, "n_rows", "_thr", "_sum", "_k", *[f"_r{i}" for i in range(1, rows + 1)], *[f"_rest{i}" for i in range(1, rows)])
    for i in range(1, rows - 1):
        t = _with_hyper(t, "_w", f"_r{i}", f"_rest{i}", "_k").withColumn("_low", E(f"_thr - _sum - {DEPTH!r}D"))
        t = t.withColumn("_pts", E(f"transform(array(_w_lo, _w_hi, _w_mode), v -> {_ln_hyper('_w', 'v')})"))
        t = t.withColumn("_far", E(_crossings("_w", "_low", ("_w_lo", "_w_mode"), ("_w_mode", "_w_hi"))))
        window = ("IF(_pts[2] <= _low, CAST(array() AS array<bigint>), sequence(IF(_pts[0] <= _low, _far.vL, _w_lo), IF(_pts[1] <= _low, _far.uR, _w_hi)))")
        t = t.withColumn("_y", F.explode(E(window))).repartition(*[F.col(c) for c in g], F.col("_k"), F.col("_y"))
        t = t.withColumn("_sum", E(f"_sum + {_ln_hyper('_w', '_y')}")).withColumn("_k", E("_k - _y")) \
             .drop("_y", "_low", "_pts", "_far", *_hyper_columns("_w"))
    t = t.withColumn("_t2", E("_thr - _sum"))
    t = with_hyper_tail(t, f"_r{rows - 1}", f"_r{rows}", "_k", "_t2", "_inner")
    res = t.groupBy(*g).agg(F.first("n_rows").alias("n_rows"), F.sum(F.exp(F.col("_sum")) * F.col("_inner")).alias("_p"))
    p = F.when(F.col("n_rows") > 1, F.least(F.lit(1.0), F.col("_p")))
    return res.select(*g, F.col("n_rows").cast("int").alias("n_rows"), p.alias("p_value"))


# ---------------------------------------------------------------- Monte-Carlo

def _log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n! by Stirling's series, shifted up for small n."""
    z = n.astype(float) + 1.0
    shift = np.zeros_like(z)
    small = z < 16
    for _ in range(16):
        shift[small] += np.log(z[small])
        z[small] += 1.0
        small = small & (z < 16)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - 1 / (1260 * z * z)) / (z * z)) / z - shift


def _stirling_error(x: np.ndarray) -> np.ndarray:
    """ln x! - ln(sqrt(2 pi x) (x / e)^x) for whole x > 0."""
    small = np.array([0.0] + [math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) for k in range(1, 16)])
    w = np.maximum(x, 16.0) ** 2
    return np.where(x < 16, small[np.minimum(x, 15).astype(np.int64)], (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / w) / w) / w) / w) / np.sqrt(w))


def _deviance(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x ln(x / m) + m - x; by its series near m, where the terms cancel."""
    d = x - m
    v = d / (x + m)
    near = np.abs(v) < 0.1
    u = np.where(near, v, 0.0)
    series = np.zeros_like(u)
    for k in range(15, 1, -2):
        series = 1 / k + u * u * series
    return np.where(near, d * v + 2 * x * u ** 3 * series, x * np.log(np.where(near, 1.0, x / m)) - d)


def ln_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """ln P(x successes in n) in saddle-point form, for arrays of equal shape with 0 <= x <= n and 0 < p < 1."""
    inner = (x > 0) & (x < n)
    y, t = np.where(inner, x, 1.0), np.where(inner, n, 2.0)
    out = (_stirling_error(t) - _stirling_error(y) - _stirling_error(t - y) - _deviance(y, t * p) - _deviance(t - y, t * (1 - p))
           + 0.5 * np.log(t / (y * (t - y))) - 0.5 * math.log(2 * math.pi))
    return np.where(inner, out, np.where(x <= 0, n * np.log1p(-p), n * np.log(p)))


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Numbers of good items among ``draws`` from good + bad, one for each entry of the arrays.

    Where the library's generator ends (10^9 items) by ratio of uniforms (Stadlober 1990): the hat around the mode accepts
    a candidate by the square of a uniform against its probability relative to the mode's.
    """
    if good + int(bad.max(initial=0)) < 10**9:
        return rng.hypergeometric(good, bad, draws)
    good_, bad_, k = np.full(len(bad), float(good)), bad.astype(float), draws.astype(float)
    n = good_ + bad_
    low, high = np.maximum(0.0, k - bad_), np.minimum(good_, k)
    p = np.clip(k / n, 1e-300, 1 - 1e-16)

    def ln_p(x, at):
        return ln_binomial(x, good_[at], p[at]) + ln_binomial(k[at] - x, bad_[at], p[at])

    every = np.arange(len(n))
    mode = np.clip(np.floor((k + 1) * (good_ + 1) / (n + 2)), low, high)
    top = ln_p(mode, every)
    spread = np.sqrt(k * (n - k) / n * (good_ / n) * (bad_ / np.maximum(n - 1, 1)) + 0.5)
    centre, width = k * good_ / n + 0.5, 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    out = np.where(low == high, low, -1.0)
    left = np.flatnonzero(out < 0)
    while len(left):
        u = 1.0 - rng.random(len(left))
        x = np.floor(centre[left] + width[left] * (rng.random(len(left)) - 0.5) / u)
        inside = (x >= low[left]) & (x <= high[left])
        ok = np.zeros(len(left), dtype=bool)
        at = left[inside]
        ok[inside] = 2 * np.log(u[inside]) <= ln_p(x[inside], at) - top[at]
        out[left[ok]] = x[ok]
        left = left[~ok]
    return out.astype(np.int64)


def _sim_hits(rows: np.ndarray, observed: np.ndarray, size: int, rng: np.random.Generator) -> int:
    """How many of ``size`` tables drawn with the margins are no more probable than the observed one."""
    k, total = int(observed.sum()), int(rows.sum())
    p = k / total

    def ln_b(x: np.ndarray, r: int) -> np.ndarray:
        return ln_binomial(x.astype(float), np.full(len(x), float(r)), np.full(len(x), p))

    limit = math.fsum(float(ln_b(np.array([x]), int(r))[0]) for x, r in zip(observed, rows) if r) + math.log1p(REL_TOL)
    n_left, k_left = np.full(size, total, dtype=np.int64), np.full(size, k, dtype=np.int64)
    weight = np.zeros(size)
    for r in map(int, rows[:-1]):
        if r:
            x = draw_hypergeometric(rng, r, n_left - r, k_left)
            weight += ln_b(x, r)
            k_left -= x
            n_left -= r
    weight += ln_b(k_left, int(rows[-1]))
    return int((weight <= limit).sum())


def fisher_monte_carlo(spark: SparkSession, table: DataFrame, c1: str, c2: str,
                       B: int = 100_000, seed: int = 20250101, partitions: int = 16) -> DataFrame:
    """Monte-Carlo Fisher test of one r x 2 table (rows with zero total dropped).

    The reduced table (a row per level of the row factor) is packed into one row, in a fixed order, and joined to
    the numbers of the draws; tables are drawn and scored on the executors, whatever the counts. ``seed`` and ``partitions``
    together fix the random stream.
    """
    packed = table.where(F.col(c1) + F.col(c2) > 0).agg(F.sort_array(F.collect_list(
        F.struct(F.col(c1).cast("long").alias("x"), F.col(c2).cast("long").alias("y")))).alias("cells"))
    packed = packed.select(F.transform("cells", lambda c: c["x"]).alias("x"), F.transform("cells", lambda c: c["y"]).alias("y"))

    def sim(it):
        from pyspark import TaskContext
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in it:
            m = len(batch)
            if not m:
                continue
            x, y = (np.array(batch[c].iloc[0], dtype=np.int64) for c in ("x", "y"))
            obs = float((_log_factorial(x) + _log_factorial(y)).sum())
            hits = _sim_hits(x + y, x, m, rng) if len(x) > 1 and x.sum() and y.sum() else m
            yield pd.DataFrame({"hits": [hits], "draws": [m], "statistic": [obs], "rows": [len(x)]})

    draws = spark.range(0, B, numPartitions=partitions).crossJoin(F.broadcast(packed))  # an aggregate without keys: one row
    sims = draws.select("x", "y").mapInPandas(sim, "hits long, draws long, statistic double, rows int")
    res = sims.agg(F.sum("hits").alias("hits"), F.sum("draws").alias("B"), F.max("statistic").alias("statistic"), F.max("rows").alias("n_rows"))
    return res.select(((F.col("hits") + 1.0) / (F.col("B") + 1.0)).alias("p_value"), F.col("B").cast("bigint").alias("B"), "statistic", "n_rows")


def monte_carlo_against_exact(spark: SparkSession, table: DataFrame, c1: str, c2: str, B: int = 100_000, seed: int = 20250101) -> DataFrame:
    """The exact p-value of a table (by the network or explosion), and whether the Monte-Carlo estimate lies within four standard errors of it.

    exact_p, n_rows, statistic, B, within_four_se; one more draw of slack for the estimate's (hits + 1) / (B + 1).
    """
    table = reliable_checkpoint(table.select(F.col(c1).alias("_x"), F.col(c2).alias("_y")).where("_x + _y > 0"))
    exact = fisher_rx2(table.withColumn("_one", F.lit(1)), ["_one"], "_x", "_x", "_y").select(F.col("p_value").alias("exact_p"))
    drawn = fisher_monte_carlo(spark, table, "_x", "_y", B=B, seed=seed)
    both = drawn.crossJoin(F.broadcast(exact))  # one row each
    near = F.abs(F.col("p_value") - F.col("exact_p")) <= 4.0 * F.sqrt(F.col("exact_p") * (1.0 - F.col("exact_p")) / F.col("B")) + 1.0 / F.col("B")
    return both.select("exact_p", "n_rows", "statistic", "B", near.alias("within_four_se"))
