"""Pearson chi-square test of independence and standardised residuals.

Input is a long cell table ``(group..., row, col, n)`` already reduced and
zero-filled. Margins are grouped sums (map-side combined) joined back to the
cells on the row and the column key; a NULL key is a row of the table like any
other. The statistic is one aggregate, the tail a column expression.

X^2 = sum (O - E)^2 / E with E = r c / N; for a 2 x 2 table the continuity
correction |O - E| - min(0.5, |O - E|) is applied. df = (R - 1)(C - 1).
Standardised residual (Haberman): (O - E) / sqrt(E (1 - r/N) (1 - c/N)).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matingstats.functions.special import chisq_sf_sql, ln_p, safe_div


def _join_null_safe(x: DataFrame, y: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys``, NULL matching NULL; with no keys ``y`` is one row."""
    if not keys:
        return x.crossJoin(F.broadcast(y))  # an aggregate without keys: one row
    y = y.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in y.columns if c not in keys])
    on = None
    for k in keys:
        same = x[k].eqNullSafe(y[f"_on_{k}"])
        on = same if on is None else on & same
    return x.join(y, on).drop(*[f"_on_{k}" for k in keys])


def _with_expected(cells: DataFrame, groups: Sequence[str], row: str, col: str, n: str) -> DataFrame:
    g = list(groups)
    x = cells.select(*g, row, col, F.col(n).cast("double").alias("_o"))
    rows = x.groupBy(*g, row).agg(F.sum("_o").alias("_r"))
    cols = x.groupBy(*g, col).agg(F.sum("_o").alias("_c"))
    total = rows.groupBy(*g).agg(F.sum("_r").alias("_N"), F.count(F.lit(1)).alias("_nr"))
    n_cols = cols.groupBy(*g).agg(F.count(F.lit(1)).alias("_nc"))
    x = _join_null_safe(x, rows, [*g, row])
    x = _join_null_safe(x, cols, [*g, col])
    x = _join_null_safe(x, _join_null_safe(total, n_cols, g), g)
    return x.withColumn("_e", safe_div(F.col("_r") * F.col("_c"), F.col("_N")))


def chisq_test(cells: DataFrame, row: str, col: str, n: str = "n",
               groups: Sequence[str] = (), correct: bool = True) -> DataFrame:
    """One row per group: statistic, df, p_value, ln_p, n_rows, n_cols."""
    x = _with_expected(cells, groups, row, col, n)
    dev = F.abs(F.col("_o") - F.col("_e"))
    if correct:
        two_by_two = (F.col("_nr") == 2) & (F.col("_nc") == 2)
        dev = F.when(two_by_two, dev - F.least(F.lit(0.5), dev)).otherwise(dev)
    x = x.withColumn("_term", safe_div(dev * dev, F.col("_e")))
    out = x.groupBy(*groups).agg(
        F.sum("_term").alias("statistic"),
        F.first("_nr").alias("n_rows"), F.first("_nc").alias("n_cols"))
    out = out.withColumn("df", ((F.col("n_rows") - 1) * (F.col("n_cols") - 1)).cast("int"))
    return out.select(*groups, "statistic", "df",
                      F.expr(chisq_sf_sql("statistic", "df")).alias("p_value"),
                      F.col("n_rows").cast("int").alias("n_rows"),
                      F.col("n_cols").cast("int").alias("n_cols")) \
              .select(*groups, "statistic", "df", "p_value", ln_p("p_value").alias("ln_p"), "n_rows", "n_cols")


def std_residuals(cells: DataFrame, row: str, col: str, n: str = "n",
                  groups: Sequence[str] = ()) -> DataFrame:
    """Per cell: observed, expected and the standardised residual."""
    x = _with_expected(cells, groups, row, col, n)
    var = F.col("_e") * (1.0 - safe_div(F.col("_r"), F.col("_N"))) * (1.0 - safe_div(F.col("_c"), F.col("_N")))
    return x.select(*groups, row, col,
                    F.col("_o").cast("bigint").alias("observed"),
                    F.col("_e").alias("expected"),
                    safe_div(F.col("_o") - F.col("_e"), F.sqrt(var)).alias("stdres"))
