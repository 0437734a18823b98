"""Logistic regression of a 0/1 response on one numeric predictor.

Rows are reduced to (x, trials, successes) first - a row per distinct predictor value - and the model
is fitted by Newton steps on them (iterative reweighting is the same for this link). Each step is one Spark aggregate of
the log-likelihood, the score and the information, merged from partial sums of the tasks. The predictor is centred by
its weighted mean and scaled by its range while fitting, so that the sums lose no digits whatever its origin (birth
years are near 2000) and however the rows are partitioned; the intercept and its variance are carried back afterwards.

The fit ends when the largest component of the score is below ``SCORE_TOL`` per trial. The log-likelihood is concave, and a step that lowers it is halved.
The maximum is finite unless some threshold on the predictor separates the responses. Then, and in the other cases without a maximum, results
are defined instead of the product of however many steps:

* separated (all successes on one side of the failures, a common border value allowed): the slope is infinite, the intercept
  and the standard errors are NULL; the deviance is its limit, which comes from the rows on the border;
* only successes or only failures: the intercept is infinite, the slope NULL, the deviance 0;
* one predictor value: the slope is NULL, as if the predictor were not in the model (one parameter);
* no rows: everything but the counts is NULL.

Coefficients, standard errors and deviances equal the row-level fit; degrees of freedom are the row-level ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matingstats.functions.special import chisq_sf_sql, ln_p, norm_two_sided_sql
from matingstats.session import reliable_checkpoint

INTERCEPT = "(Intercept)"
#: Largest component of the score per trial at the end of a fit; rounding leaves about 1e-16.
SCORE_TOL = 1e-12
MAX_STEPS = 60


@dataclass(frozen=True)
class LogisticFit:
    """``None``: not defined. ``parameters``: how many are in the model; ``steps``: Newton steps taken."""

    trials: float
    intercept: float | None = None
    slope: float | None = None
    se_intercept: float | None = None
    se_slope: float | None = None
    null_deviance: float | None = None
    deviance: float | None = None
    parameters: int = 2
    steps: int = 0
    converged: bool = True
    separated: bool = False


def counts_by_predictor(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, n, s): trials and successes per predictor value; rows with a NULL or NaN on either side are left out."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return (rows.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").groupBy("x")
                .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s")))


def _entropy_deviance(s: float, n: float) -> float:
    """-2 ln likelihood of s successes in n trials at the rate s / n."""
    return -2.0 * sum(k * math.log(k / n) for k in (s, n - s) if k > 0)


def _evaluate(g: DataFrame, centre: float, scale: float, a0: float, a1: float) -> tuple[float, ...]:
    """Log-likelihood, score and information at (a0, a1) on the centred and scaled predictor: one aggregate."""
    z = f"((x - {centre!r}D) / {scale!r}D)"
    rows = g.select("n", "s", F.expr(z).alias("z")).select("n", "s", "z", F.expr(f"{a0!r}D + {a1!r}D * z").alias("e"))
    rows = rows.select("n", "s", "z", "e", F.expr("1D / (1D + exp(-e))").alias("p"))
    return tuple(rows.agg(F.expr("sum(s * e - n * (greatest(e, 0D) + log1p(exp(-abs(e)))))"), F.expr("sum(s - n * p)"), F.expr("sum((s - n * p) * z)"),
                          F.expr("sum(n * p * (1D - p))"), F.expr("sum(n * p * (1D - p) * z)"), F.expr("sum(n * p * (1D - p) * z * z)")).first())


def fit_logistic(df: DataFrame, x: str, y: str) -> LogisticFit:
    """The maximum-likelihood fit of y ~ x; see the module for the cases without a maximum."""
    g = reliable_checkpoint(counts_by_predictor(df, x, y))
    m = g.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.expr("sum(n * x) / sum(n)").alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"),
              F.expr("min(x) FILTER (WHERE s > 0)").alias("low1"), F.expr("max(x) FILTER (WHERE s > 0)").alias("high1"),
              F.expr("min(x) FILTER (WHERE s < n)").alias("low0"), F.expr("max(x) FILTER (WHERE s < n)").alias("high0")).first()
    if m["n"] is None:
        return LogisticFit(0.0, parameters=0)
    n, s = m["n"], m["s"]
    null = _entropy_deviance(s, n)
    if s in (0.0, n):
        return LogisticFit(n, math.inf if s else -math.inf, None, None, None, 0.0, 0.0, 1, separated=True)
    start = math.log(s / (n - s))
    if m["low"] == m["high"]:
        return LogisticFit(n, start, None, math.sqrt(n / (s * (n - s))), None, null, null, 1)
    if m["high0"] <= m["low1"] or m["high1"] <= m["low0"]:
        side = 1.0 if m["high0"] <= m["low1"] else -1.0
        border = m["low1"] if side > 0 else m["high1"]
        tie = g.where(F.col("x") == border).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
        return LogisticFit(n, None, side * math.inf, None, None, null, _entropy_deviance(tie["s"], tie["n"]), separated=True)

    centre, scale = m["mean"], m["high"] - m["low"]
    a0, a1, steps = start, 0.0, 0
    ll, u0, u1, h00, h01, h11 = _evaluate(g, centre, scale, a0, a1)
    while max(abs(u0), abs(u1)) > SCORE_TOL * n and steps < MAX_STEPS:
        det = h00 * h11 - h01 * h01
        d0, d1, part = (h11 * u0 - h01 * u1) / det, (h00 * u1 - h01 * u0) / det, 1.0
        new = _evaluate(g, centre, scale, a0 + d0, a1 + d1)
        while not new[0] >= ll - 1e-12 * abs(ll) and part > 1e-6:
            part /= 2.0
            new = _evaluate(g, centre, scale, a0 + part * d0, a1 + part * d1)
        a0, a1, steps = a0 + part * d0, a1 + part * d1, steps + 1
        ll, u0, u1, h00, h01, h11 = new
    det = h00 * h11 - h01 * h01
    shift = centre / scale
    variance0 = (h11 + 2.0 * h01 * shift + h00 * shift * shift) / det
    return LogisticFit(n, a0 - a1 * shift, a1 / scale, math.sqrt(variance0), math.sqrt(h00 / det) / scale, null, -2.0 * ll, 2, steps,
                       max(abs(u0), abs(u1)) <= SCORE_TOL * n)


def logistic_by_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    """Coefficient table: term, estimate, std_error, z_value, p_value, ln_p."""
    fit = fit_logistic(df, x, y)
    rows = [(INTERCEPT, fit.intercept, fit.se_intercept), (x, fit.slope, fit.se_slope)]
    out = df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double")
    out = out.withColumn("z_value", F.col("estimate") / F.col("std_error")) \
             .withColumn("p_value", F.expr(norm_two_sided_sql("z_value")))
    return out.withColumn("ln_p", ln_p("p_value"))


def model_summary(df: DataFrame, x: str, y: str) -> DataFrame:
    """The fit's null and residual deviance, their degrees of freedom, AIC, Newton steps, and whether it converged and the data are separated (one row).

    The response is 0/1 per row, so the saturated likelihood is 1 and AIC = deviance + 2 * parameters.
    """
    fit = fit_logistic(df, x, y)
    known = fit.deviance is not None
    return df.sparkSession.createDataFrame(
        [(fit.null_deviance, fit.trials - 1.0 if known else None, fit.deviance, fit.trials - fit.parameters if known else None,
          fit.deviance + 2.0 * fit.parameters if known else None, fit.steps, fit.converged, fit.separated)],
        "null_deviance double, null_df double, deviance double, resid_df double, aic double, steps int, converged boolean, separated boolean")


def analysis_of_deviance(df: DataFrame, x: str, y: str) -> DataFrame:
    """``anova(model, test = "Chisq")``: the NULL row and the predictor row."""
    fit = fit_logistic(df, x, y)
    known = fit.deviance is not None
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("df", T.IntegerType()),
                           T.StructField("deviance", T.DoubleType()), T.StructField("resid_df", T.DoubleType()),
                           T.StructField("resid_dev", T.DoubleType())])
    rows = [("NULL", None, None, fit.trials - 1.0 if known else None, fit.null_deviance),
            (x, max(fit.parameters - 1, 0), fit.null_deviance - fit.deviance if known else None, fit.trials - fit.parameters if known else None, fit.deviance)]
    out = df.sparkSession.createDataFrame(rows, schema)
    return out.withColumn("p_value", F.when(F.col("df") > 0, F.expr(chisq_sf_sql("deviance", "df"))))
