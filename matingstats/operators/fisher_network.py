"""Exact Fisher test of r x 2 tables with many rows: a network of partial sums (T4; Mehta and Patel 1983).

With both margins fixed, a table is a path through the rows: the node after i rows is the sum of the first-column counts so far. A
path's probability is the product of binomial probabilities b(x_i; r_i, c_1 / N) over b(c_1; N, c_1 / N). Wanted is the mass of the
paths no more probable than the observed one.

Paths are the rows of a DataFrame: (group, sum, ln of the past probability, number of paths). Row after row

* a path is expanded by the counts of the next row;
* paths with equal sum and equal past (to 1e-9 of the logarithm) are merged and their numbers added: with equal row totals the paths
  are few, however many tables there are;
* where even the longest remaining path (the most probable completion) keeps the product at or below the threshold, all completions count: their
  mass is that of the node's total, a single binomial probability, and the path is settled;
* where even the shortest remaining path stays above the threshold, none counts, and the path ends;
* a path whose whole mass is below exp(-DEPTH) of the observed table's ends too: what is left out is below the precision of the result.

The second half of the rows is expanded on its own, from the other end. The halves meet in the middle: per sum, the
unsettled paths of the first half are lined up with those of the second by what probability they may still have, and a running total gives each its mass.
So the paths are those of half the rows. They are spread over tasks by all their keys; the middle is dealt by sum.

The bound of the longest path is a dual one (the binomials tilted to the remaining rate), exact where the rows can be
filled in proportion; a looser bound only settles later. The tables of bounds and of row probabilities span the sums that can matter, by Hoeffding's bound: their
size grows with sqrt(n). One row per group and table row, they are computed before the expansion starts.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matingstats.functions.special import let_sql, ln_binomial_sql
from matingstats.session import reliable_checkpoint

DEPTH = 40.0
#: Row expansions between two checkpoints.
STAGES = 4
#: Groups up to which the tables of a row are broadcast; beyond, they are joined by shuffle.
BROADCAST_GROUPS = 1000


def _prepared(tables: DataFrame, g: Sequence[str], rows: int, half: int) -> DataFrame:
    """One row per group and table row i = 1 .. rows: probs (x, ln b) of the row, and from ``s0`` on bounds (tot, lp, sp) of what remains after it.

    Rows 2 .. half continue row 1; the rows from half + 1 on are a second path.
    """
    E = F.expr
    t = tables.select(*g, E("transform(_rows, x -> CAST(x.r AS DOUBLE))").alias("_all"), "_n", "_k", "_p", "_q", "_thr", "_ln_k",
                      F.posexplode(F.expr(f"transform(sequence(1, {rows}), i -> coalesce(get(_rows, i - 1).r, 0L))")).alias("_at", "_r"))
    t = t.withColumns({"_i": E("_at + 1"), "_r": E("CAST(_r AS DOUBLE)")}).drop("_at")
    first = f"IF(_i <= {half}, 1, {half + 1})"
    t = t.withColumn("_done", E(f"aggregate(slice(_all, {first}, _i - {first} + 1), 0D, (a, x) -> a + x)"))
    t = t.withColumn("_rest", E(f"IF(_i <= {half}, slice(_all, _i + 1, {rows}), CAST(array() AS array<double>))"))
    t = t.withColumn("_left", E("_n - _done"))

    def ends(total: str) -> list[str]:
        spread = f"sqrt((_ln_k - _thr + {DEPTH + 1!r}D) * least({total}, _k, _n - _k, _n - {total}) / 2)"
        return [f"CAST(greatest(0D, _k - (_n - {total}), ceil({total} * _p - {spread})) AS BIGINT)",
                f"CAST(least({total}, _k, floor({total} * _p + {spread})) AS BIGINT)"]

    x0, x1 = ends("_r")
    s0, s1 = ends("_done")
    t = t.withColumns({"_x0": E(x0), "_x1": E(x1), "_s0": E(s0), "_s1": E(s1)})
    t = t.withColumn("_probs", E(f"transform(sequence(_x0, _x1), v -> named_struct('x', v, 'lb', {ln_binomial_sql('CAST(v AS DOUBLE)', '_r', '_p', '_q')}))"))
    # what remains: m of the first column in the rows after this one
    total = ln_binomial_sql("nd.m", "_left", "_p", "_q")
    tilt = "(nd.m / _left)"
    mode = f"least(r, floor((r + 1D) * {tilt}))"
    longest = (f"aggregate(_rest, nd.m * ln(_p / {tilt}) + (_left - nd.m) * ln(_q / (1D - {tilt})), (a, r) -> a + "
               f"{ln_binomial_sql(mode, 'r', tilt, f'(1D - {tilt})')})")
    shortest = (f"aggregate(_rest, 0D, (a, r) -> a + least({ln_binomial_sql('greatest(0D, nd.m - (_left - r))', 'r', '_p', '_q')}, "
                f"{ln_binomial_sql('least(r, nd.m)', 'r', '_p', '_q')}))")
    node = (f"named_struct('tot', {total}, 'lp', CASE WHEN size(_rest) = 0 THEN NULL WHEN nd.m <= 0 OR nd.m >= _left THEN {total} ELSE {longest} END, "
            f"'sp', CASE WHEN size(_rest) = 0 THEN NULL ELSE {shortest} END)")
    t = t.withColumn("_nodes", E(f"transform(sequence(_s0, _s1), s -> {let_sql('nd', node, m='_k - CAST(s AS DOUBLE)')})"))
    return t.select(*g, "_i", "_k", "_thr", "_ln_k", "_probs", "_s0", "_nodes")


def _expanded(paths: DataFrame, stage: DataFrame, g: Sequence[str]) -> DataFrame:
    """``paths`` (groups, _s, _key, _v, _c) after one more row; a row without a sum carries the settled mass of its group."""
    E = F.expr
    x = paths.join(stage, list(g)).select(*g, "_s", "_v", "_c", "_thr", "_ln_k", "_s0", "_nodes",
                                          F.inline(E("IF(_s IS NULL, array(named_struct('x', CAST(NULL AS BIGINT), 'lb', CAST(NULL AS DOUBLE))), _probs)")))
    x = x.withColumns({"_v": E("_v + lb"), "_s": E("_s + x")}).withColumn("_b", E("IF(_s < _s0, NULL, get(_nodes, CAST(_s - _s0 AS INT)))"))
    x = x.where(E(f"_s IS NULL OR (_b IS NOT NULL AND ln(_c) + _v + _b.tot >= _thr - {DEPTH!r}D AND NOT coalesce(_v + _b.sp > _thr, false))"))
    x = x.withColumn("_all", E("_s IS NULL OR coalesce(_v + _b.lp <= _thr, false)"))
    return (x.groupBy(*g, E("IF(_all, NULL, _s)").alias("_s"), E("IF(_all, NULL, CAST(round(_v * 1e9) AS BIGINT))").alias("_key"))
             .agg(F.min(E("IF(_all, NULL, _v)")).alias("_v"), F.sum(E("IF(_all AND _s IS NOT NULL, _c * exp(_v + _b.tot - _ln_k), _c)")).alias("_c")))


def network_p(tables: DataFrame, groups: Sequence[str], rows: int, few: bool, rel_tol: float) -> DataFrame:
    """(groups, p): the exact p-value of each group of ``tables`` (groups, _rows: array<struct<r,x>> of at most ``rows`` entries, by rising r).

    ``few``: there are at most ``BROADCAST_GROUPS`` groups."""
    E, g = F.expr, list(groups)
    t = tables.withColumns({"_n": E("CAST(aggregate(_rows, 0L, (a, x) -> a + x.r) AS DOUBLE)"), "_k": E("CAST(aggregate(_rows, 0L, (a, x) -> a + x.x) AS DOUBLE)")})
    t = t.withColumns({"_p": E("try_divide(_k, _n)"), "_q": E("try_divide(_n - _k, _n)")})
    observed = f"aggregate(_rows, 0D, (a, o) -> a + {ln_binomial_sql('CAST(o.x AS DOUBLE)', 'CAST(o.r AS DOUBLE)', '_p', '_q')})"
    t = t.withColumns({"_ln_k": E(ln_binomial_sql("_k", "_n", "_p", "_q")), "_thr": E(f"{observed} + {math.log1p(rel_tol)!r}D")})
    half = (rows + 1) // 2
    net = reliable_checkpoint(_prepared(t.where("_k > 0 AND _k < _n"), g, rows, half))  # otherwise there is one table only
    base = net.where("_i = 1").select(*g, "_k", "_thr", "_ln_k")

    def walked(first: int, last: int) -> DataFrame:
        paths = base.select(*g, F.lit(0).cast("long").alias("_s"), F.lit(0).cast("long").alias("_key"), F.lit(0.0).alias("_v"), F.lit(1.0).alias("_c"))
        for i in range(first, last + 1):
            stage = net.where(F.col("_i") == i).drop("_i", "_k")
            paths = _expanded(paths, F.broadcast(stage) if few else stage, g)
            if (i - first) % STAGES == STAGES - 1 and i < last:
                paths = reliable_checkpoint(paths)
        return paths

    a = reliable_checkpoint(walked(1, half))
    settled = a.where("_s IS NULL").select(*g, F.col("_c").alias("_mass"))
    live = a.where("_s IS NOT NULL")
    if live.limit(1).count():
        b = walked(half + 1, rows)
        known = F.broadcast(base) if few else base
        b = b.join(known, g).select(*g, E("CAST(_k AS BIGINT) - _s").alias("_s"), F.col("_v").alias("_pos"), F.lit(0).alias("_side"), E("_c * exp(_v)").alias("_w"))
        a = live.join(known, g).select(*g, "_s", E("_thr - _v").alias("_pos"), F.lit(1).alias("_side"), E("_c * exp(_v - _ln_k)").alias("_w"))
        order = Window.partitionBy(*g, "_s").orderBy("_pos", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        met = b.unionByName(a).withColumn("_below", F.sum(E("IF(_side = 0, _w, 0D)")).over(order)).where("_side = 1")
        settled = settled.unionByName(met.select(*g, E("_w * _below").alias("_mass")))
    mass = settled.groupBy(*g).agg(F.sum("_mass").alias("_p"))
    return t.select(*g, "_k", "_n").join(mass, g, "left").select(*g, E("least(1D, IF(_k > 0 AND _k < _n, coalesce(_p, 0D), 1D))").alias("p"))
