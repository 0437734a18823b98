"""Golden numbers: published p-values recomputed from their statistics
"""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from matingstats.functions import special as S
from matingstats.operators.chisq import chisq_test, std_residuals
from matingstats.operators.fisher import fisher_2x2, fisher_monte_carlo, fisher_rx2
from tests.reference import fisher_rx2_p
from matingstats.operators.ranksum import rank_sum_test


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("stat,df,expected", [
    (28.191, 17, 0.0427553350),      # small data, year x strategy
    (177.77, 25, 5.400087e-25),      # master data, year x strategy
    (0.001, 1, 0.9747728794),
])
def test_chisq_tail(spark, stat, df, expected):
    got = value(spark, F.expr(S.chisq_sf_sql(f"{stat}D", str(df))))
    assert got == pytest.approx(expected, rel=1e-7)


@pytest.mark.parametrize("z,expected", [(0.70533549, 0.4806014799), (0.65108095, 0.5149942361)])
def test_normal_two_sided(spark, z, expected):
    got = value(spark, F.expr(S.norm_two_sided_sql(f"{z}D")))
    assert got == pytest.approx(math.erfc(z / math.sqrt(2.0)), abs=1e-12)
    # the hand values were computed from z with more digits than printed
    assert got == pytest.approx(expected, abs=5e-9)


def test_published_logistic_p_values(spark):
    # Refined.R results: b / SE -> z -> p
    assert value(spark, F.expr(S.norm_two_sided_sql(f"{-0.03490 / 0.04948!r}D"))) == pytest.approx(0.481, abs=5e-4)
    assert value(spark, F.expr(S.norm_two_sided_sql(f"{0.01295 / 0.01989!r}D"))) == pytest.approx(0.515, abs=5e-4)


def test_lgamma_matches_python(spark):
    rows = spark.range(1, 60).select("id", F.expr(S.lgamma_sql("(id / 2.0D)")).alias("v")).collect()
    for r in rows:
        assert r["v"] == pytest.approx(math.lgamma(r["id"] / 2.0), abs=1e-11)


def test_fisher_2x2_hand_values(spark):
    t = spark.createDataFrame([("g1", "r1", 3, 1), ("g1", "r2", 1, 3), ("g2", "r1", 1, 9), ("g2", "r2", 11, 3),
                               ("g3", "r1", 5, 5)], "g string, r string, a long, b long")
    got = {r["g"]: r["p_value"] for r in fisher_2x2(t, ["g"], "r", "a", "b").collect()}
    assert got["g1"] == pytest.approx(0.4857142857, abs=1e-9)
    assert got["g2"] == pytest.approx(0.0027594562, abs=1e-9)
    assert got["g3"] is None


@pytest.mark.parametrize("table,expected", [
    ([[3, 9], [8, 2], [5, 5]], 0.0420611526),
    ([[4, 6], [1, 9], [7, 3], [2, 8]], 0.0364685275),
    ([[6, 40], [36, 226], [4, 35], [5, 47]], 0.8781708488),
    ([[3, 1], [1, 3]], 0.4857142857),
])
def test_fisher_rx2_hand_values(table, expected):
    t = np.array(table)
    assert fisher_rx2_p(t[:, 0], t[:, 1]) == pytest.approx(expected, abs=1e-9)
    # row order does not matter
    assert fisher_rx2_p(t[::-1, 0], t[::-1, 1]) == pytest.approx(expected, abs=1e-9)


def test_fisher_rx2_grouped(spark):
    rows = [("y", str(i), a, b) for i, (a, b) in enumerate([[3, 9], [8, 2], [5, 5]])] + [("z", "0", 1, 1)]
    t = spark.createDataFrame(rows, "g string, r string, a long, b long")
    got = {r["g"]: (r["n_rows"], r["p_value"]) for r in fisher_rx2(t, ["g"], "r", "a", "b").collect()}
    assert got["y"][1] == pytest.approx(0.0420611526, abs=1e-9)
    assert got["z"] == (1, None)


def test_monte_carlo_within_four_standard_errors(spark):
    table = [[3, 9], [8, 2], [5, 5]]
    t = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(table)], "r string, a long, b long")
    exact = 0.0420611526
    B = 20000
    p = fisher_monte_carlo(spark, t, "a", "b", B=B, seed=7).first()["p_value"]
    se = math.sqrt(exact * (1 - exact) / B)
    assert abs(p - exact) < 4 * se


def test_chisq_2x2_uses_continuity_correction(spark):
    cells = spark.createDataFrame([("a", "x", 12), ("a", "y", 5), ("b", "x", 7), ("b", "y", 9)],
                                  "r string, c string, n long")
    r = chisq_test(cells, "r", "c").first()
    # hand computation with Yates' correction
    o = np.array([[12, 5], [7, 9]], float)
    e = o.sum(1)[:, None] * o.sum(0)[None, :] / o.sum()
    x2 = (((np.abs(o - e) - np.minimum(0.5, np.abs(o - e))) ** 2) / e).sum()
    assert r["statistic"] == pytest.approx(x2, rel=1e-12)
    assert r["df"] == 1


def test_fixture_chisq_on_master_level(spark):
    from tests.conftest import SF_CHECK
    from matingstats.plans import master as M
    from matingstats.sources.roles import master_raw
    from matingstats.operators.reshape import complete_cells
    m = master_raw(spark, SF_CHECK)
    cells = complete_cells(M.master_level_counts(m), ["yob"], "strategy", ["Monogamous", "Polygynous"], "n_pairs")
    r = chisq_test(cells, "yob", "strategy", "n_pairs").first()
    assert r["statistic"] == pytest.approx(77.215544, abs=1e-6)
    assert r["df"] == 6
    assert r["p_value"] == pytest.approx(1.34173e-14, rel=1e-5)


def test_std_residuals_sum_of_squares(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("b", "y", 5), ("c", "x", 8),
                                   ("c", "y", 9)], "r string, c string, n long")
    res = {(r["r"], r["c"]): r["stdres"] for r in std_residuals(cells, "r", "c").collect()}
    o = np.array([[10, 20], [30, 5], [8, 9]], float)
    rs, cs, n = o.sum(1)[:, None], o.sum(0)[None, :], o.sum()
    e = rs * cs / n
    z = (o - e) / np.sqrt(e * (1 - rs / n) * (1 - cs / n))
    assert res[("b", "y")] == pytest.approx(z[1, 1], rel=1e-12)


def test_rank_sum_hand_value(spark):
    x = [1, 2, 2, 3]
    y = [3, 4, 5, 5, 6]
    rows = [("v", "Monogamous", float(v)) for v in x] + [("v", "Polygynous", float(v)) for v in y] \
        + [("w", "Polygynous", 1.0)]
    df = spark.createDataFrame(rows, "g string, lvl string, n double")
    got = {r["g"]: r for r in rank_sum_test(df, "g", "lvl", "n").collect()}
    assert got["v"]["W"] == pytest.approx(0.5)
    assert got["v"]["p_value"] == pytest.approx(0.0255736694, abs=1e-9)
    assert got["v"]["Significant"] == "Yes"
    assert got["w"]["p_value"] is None and got["w"]["Significant"] == "No"
    # W + W' = n_x n_y
    swapped = df.withColumn("lvl", F.when(F.col("lvl") == "Monogamous", "Zeta").otherwise(F.col("lvl")))
    w2 = {r["g"]: r["W"] for r in rank_sum_test(swapped, "g", "lvl", "n").collect()}
    assert got["v"]["W"] + w2["v"] == pytest.approx(len(x) * len(y))


def _p2x2_reference(a, b, c, d):
    r1, r2, k = a + b, c + d, a + c
    n = r1 + r2
    lg = math.lgamma
    const = lg(r1 + 1) + lg(r2 + 1) + lg(k + 1) + lg(n - k + 1) - lg(n + 1)
    lo, hi = max(0, k - r2), min(r1, k)
    xs = np.arange(lo, hi + 1)
    lp = np.array([const - lg(x + 1) - lg(r1 - x + 1) - lg(k - x + 1) - lg(r2 - k + x + 1) for x in xs])
    thr = const - lg(a + 1) - lg(r1 - a + 1) - lg(k - a + 1) - lg(r2 - k + a + 1) + math.log1p(1e-7)
    return min(1.0, float(np.exp(lp[lp <= thr]).sum()))


def test_fisher_2x2_windowed_sum_is_exact_for_large_margins(spark):
    from matingstats.operators.fisher import with_fisher_2x2
    tables = [(73192, 72372, 72692, 73192), (55298, 56126, 54462, 55298), (20000, 20500, 21000, 19000),
              (5, 0, 0, 5), (0, 7, 3, 0), (12, 0, 0, 0)]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    got = {tuple(r[:4]): r["p"] for r in with_fisher_2x2(df, "a", "b", "c", "d", "p").collect()}
    for t in tables:
        assert got[t] == pytest.approx(_p2x2_reference(*t), rel=1e-8, abs=1e-14)


def test_monte_carlo_is_deterministic_per_seed(spark):
    t = spark.createDataFrame([("a", 3, 9), ("b", 8, 2), ("c", 5, 5)], "r string, x long, y long")
    p1 = fisher_monte_carlo(spark, t, "x", "y", B=5000, seed=11).first()["p_value"]
    p2 = fisher_monte_carlo(spark, t, "x", "y", B=5000, seed=11).first()["p_value"]
    assert p1 == p2
    # a table at the most probable configuration is never extreme: p = 1
    flat = spark.createDataFrame([("a", 5, 5), ("b", 5, 5)], "r string, x long, y long")
    assert fisher_monte_carlo(spark, flat, "x", "y", B=2000, seed=1).first()["p_value"] == 1.0


def test_fisher_does_not_depend_on_the_order_of_rows(spark):
    import itertools
    rows = [(g, i, a, b) for g, p in enumerate(itertools.permutations([(95, 5), (452, 49548), (453, 49547)])) for i, (a, b) in enumerate(p)]
    t = spark.createDataFrame(rows, "g int, r int, a long, b long")
    for r in fisher_rx2(t, ["g"], "r", "a", "b").collect():
        assert r["p_value"] == pytest.approx(3.185191168993e-184, rel=1e-9)


def test_fisher_2x2_keeps_its_digits_at_large_counts(spark):
    from matingstats.operators.fisher import with_fisher_2x2
    tables = []
    for n in (10**6, 10**8, 10**9):
        tables += [(n, n, n, n + 1000), (n, n + 1000, n, n), (n, n, n + 1000, n), (n + 1000, n, n, n)]
    tables.append((4 * 10**9, 4 * 10**9, 4 * 10**9, 4 * 10**9 + 70_000))
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(tables)], "i int, a long, b long, c long, d long")
    p = [r["p"] for r in with_fisher_2x2(df, "a", "b", "c", "d", "p").orderBy("i").collect()]
    for k in range(3):
        assert p[4 * k:4 * k + 4] == pytest.approx([p[4 * k]] * 4, rel=1e-9)
    assert p[0] == pytest.approx(0.61782331, abs=1e-7)
    assert 0.5 < p[-1] < 0.7


def test_fisher_rx2_of_four_and_five_rows(spark):
    tables = {"a": [[3, 9], [8, 2], [5, 5], [1, 7]], "b": [[3, 9], [8, 2], [5, 5], [0, 0], [2, 6]], "c": [[4, 1], [1, 4]]}
    rows = [(g, str(i), x, y) for g, t in tables.items() for i, (x, y) in enumerate(t)]
    df = spark.createDataFrame(rows, "g string, r string, a long, b long")
    got = {r["g"]: r["p_value"] for r in fisher_rx2(df, ["g"], "r", "a", "b").collect()}
    for g, t in tables.items():
        t = np.array(t)
        assert got[g] == pytest.approx(fisher_rx2_p(t[:, 0], t[:, 1]), rel=1e-10)


def _exact_by_paths(table):
    """p of an r x 2 table in whole numbers: (sum, product of binomial coefficients) and how many tables have it, row after row."""
    k = sum(x for x, _ in table)
    observed = math.prod(math.comb(x + y, x) for x, y in table)
    paths = {(0, 1): 1}
    for x, y in table:
        new = {}
        for (s, v), c in paths.items():
            for i in range(min(x + y, k - s) + 1):
                key = s + i, v * math.comb(x + y, i)
                new[key] = new.get(key, 0) + c
        paths = new
    return Fraction(sum(c * v for (s, v), c in paths.items() if s == k and v * 10**7 <= observed * (10**7 + 1)), math.comb(sum(x + y for x, y in table), k))


def test_fisher_network_equals_whole_number_paths(spark):
    draw = np.random.default_rng(9)
    tables = {"equal rows": [(2, 4)] * 3 + [(5, 1)] * 3 + [(3, 3)] * 4, "mode": [(3, 3)] * 12, "far": [(6, 0)] * 4 + [(0, 6)] * 4,
              "no first": [(0, 3)] * 5, "nothing": [(0, 0)] * 4, "one row": [(4, 5)], "wide": [(30, 41), (22, 50), (3, 1), (0, 2)]}
    for n in range(8):
        tables[f"random {n}"] = [tuple(map(int, draw.integers(0, 6, 2))) for _ in range(draw.integers(4, 7))]
    rows = [(g if g != "mode" else None, str(i), x, y) for g, t in tables.items() for i, (x, y) in enumerate(t)]
    df = spark.createDataFrame(rows, "g string, r string, a long, b long").repartition(3)
    got = {r["g"] or "mode": (r["n_rows"], r["p_value"]) for r in fisher_rx2(df, ["g"], "r", "a", "b").collect()}
    assert set(got) == set(tables)
    for g, t in tables.items():
        assert got[g][0] == len(t)
        if len(t) < 2:
            assert got[g][1] is None
        else:
            assert got[g][1] == pytest.approx(float(_exact_by_paths(t)), rel=1e-9), g


def test_fisher_network_of_a_large_table(spark):
    # 25 rows of 14, as a colony table has them, moderately uneven: against whole numbers by classes of equal rows
    t = [(7, 7)] * 15 + [(9, 5)] * 5 + [(5, 9)] * 5
    df = spark.createDataFrame([("g", i, x, y) for i, (x, y) in enumerate(t)], "g string, r int, a long, b long")
    p = fisher_rx2(df, ["g"], "r", "a", "b").first()["p_value"]
    # draws of the same margins
    rng = np.random.default_rng(4)
    left, k, stat = np.full(200_000, 25 * 14), np.full(200_000, sum(x for x, _ in t)), np.zeros(200_000)
    logc = np.array([math.log(math.comb(14, x)) for x in range(15)])
    for _ in range(24):
        x = rng.hypergeometric(14, left - 14, k)
        stat += logc[x]
        left, k = left - 14, k - x
    stat += logc[k]
    share = (stat <= sum(logc[x] for x, _ in t) + 1e-7).mean()
    assert abs(p - share) < 4 * math.sqrt(share * (1 - share) / 200_000)


def test_chisq_counts_a_null_row(spark):
    cells = spark.createDataFrame([(None, "x", 30), (None, "y", 10), ("a", "x", 20), ("a", "y", 20), ("b", "x", 10), ("b", "y", 25)],
                                  "r string, c string, n long")
    r = chisq_test(cells, "r", "c").first()
    o = np.array([[30, 10], [20, 20], [10, 25]], float)
    e = o.sum(1)[:, None] * o.sum(0)[None, :] / o.sum()
    assert (r["n_rows"], r["df"]) == (3, 2) and r["statistic"] == pytest.approx((((o - e) ** 2) / e).sum(), rel=1e-12)
    assert r["ln_p"] == pytest.approx(-r["statistic"] / 2, rel=1e-12)  # two degrees of freedom
    assert std_residuals(cells, "r", "c").count() == 6


def test_draws_beyond_the_librarys_generator():
    from matingstats.operators.fisher import draw_hypergeometric
    rng = np.random.default_rng(5)
    for good, bad, k in ((800_000_000, 700_000_000, 900_000_000), (5, 3_000_000_000, 10**9), (2_000_000_000, 4, 7), (10**9, 10**9, 0)):
        size = 20_000
        x = draw_hypergeometric(rng, good, np.full(size, bad), np.full(size, k))
        n, p = good + bad, good / (good + bad)
        mean, var = k * p, k * p * (1 - p) * (n - k) / (n - 1)
        assert x.min() >= max(0, k - bad) and x.max() <= min(good, k)
        assert abs(x.mean() - mean) <= 5 * math.sqrt(var / size) + 1e-6
        assert x.var() == pytest.approx(var, rel=0.06, abs=1e-4)


def test_monte_carlo_of_counts_beyond_1e9(spark):
    t = spark.createDataFrame([("a", 1_000_000_000, 1_000_030_000), ("b", 1_000_050_000, 1_000_000_000)], "r string, x long, y long")
    exact = fisher_2x2(t.withColumn("g", F.lit(1)), ["g"], "r", "x", "y").first()["p_value"]
    p = fisher_monte_carlo(spark, t, "x", "y", B=20_000, seed=3).first()["p_value"]
    assert 0.01 < exact < 0.99 and abs(p - exact) < 4 * math.sqrt(exact * (1 - exact) / 20_000)


def test_monte_carlo_held_against_the_exact_test(spark):
    from matingstats.operators.fisher import monte_carlo_against_exact
    t = spark.createDataFrame([("a", 3, 9), ("b", 8, 2), ("c", 5, 5), ("d", 1, 7), ("e", 0, 0)], "r string, x long, y long")
    row = monte_carlo_against_exact(spark, t, "x", "y", B=20_000).first()
    assert row["within_four_se"] and row["n_rows"] == 4
    assert row["exact_p"] == pytest.approx(fisher_rx2_p(np.array([3, 8, 5, 1]), np.array([9, 2, 5, 7])), rel=1e-9)


@pytest.mark.parametrize("width", [4])
def test_rank_sum_of_ten_million_values_in_one_group(spark, width):
    n = 10_000_000
    df = spark.range(0, n, 1, 8).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("level"),
                                        F.floor((F.col("id") * 7919 % n) / width).cast("double").alias("v"))
    row = rank_sum_test(df, "g", "level", "v").first()
    ids = np.arange(n)
    rank = (ids * 7919 % n) // width * width + (width + 1) / 2  # mid-ranks: every value occurs ``width`` times
    x = ids % 3 == 0
    w = rank[x].sum() - x.sum() * (x.sum() + 1) / 2
    assert row["W"] == pytest.approx(w, rel=1e-12)
    nx, ny = float(x.sum()), float(n - x.sum())
    var = nx * ny / 12 * ((n + 1) - (n / width) * (width ** 3 - width) / (n * (n - 1.0)))
    d = w - nx * ny / 2
    assert row["p_value"] == pytest.approx(math.erfc(abs((d - math.copysign(0.5, d)) / math.sqrt(var)) / math.sqrt(2)), rel=1e-6)


def test_rank_sum_windows_have_a_bucket_key(spark):
    df = spark.createDataFrame([("g", "A", 1.0), ("g", "B", 2.0)], "g string, level string, v double")
    plan = rank_sum_test(df, "g", "level", "v")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if line.strip(" +-:").startswith("Window")]
    assert windows and all("_part" in line for line in windows)


def test_rank_sum_of_many_groups_equals_pooled_ranks(spark):
    draw = np.random.default_rng(2)
    rows = [(str(g) if g else None, str(draw.choice(["a", "b"])), float(draw.integers(0, 6))) for g in range(5) for _ in range(40)] + [("solo", "a", 1.0), ("solo", "a", 2.0)]
    got = {r["g"]: r for r in rank_sum_test(spark.createDataFrame(rows, "g string, l string, v double").repartition(4), "g", "l", "v").collect()}
    for g in {r[0] for r in rows} - {"solo"}:
        own = [(r[1], r[2]) for r in rows if r[0] == g]
        v = np.array([b for _, b in own])
        rank = np.array([(v < b).sum() + ((v == b).sum() + 1) / 2 for b in v])
        x = np.array([a == "a" for a, _ in own])
        assert got[g]["W"] == pytest.approx(rank[x].sum() - x.sum() * (x.sum() + 1) / 2)
    assert got["solo"]["W"] is None and got["solo"]["p_value"] is None
