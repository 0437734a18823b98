"""Special functions as SQL text over SQL expressions, for ``F.expr``.

Spark SQL has no ``lgamma``, ``erf`` or incomplete gamma, so the distribution
tails the tests need are built here from public formulas and evaluated
JVM-side with ``aggregate`` over ``sequence`` (no Python UDF). As text, a formula is one
parse instead of a call per node.

* ``lgamma_sql(a)``: Stirling's series at ``a + 10`` with four correction terms,
  shifted back with ten logarithms (abs. error below 1e-12 for a > 0).
* ``gamma_q_sql(a, x)``: regularised upper incomplete gamma Q(a, x). For
  ``x < a + 1`` the power series of P(a, x) and Q = 1 - P; otherwise the
  Legendre continued fraction for Q, evaluated backwards to a fixed depth,
  so tiny tails (1e-25) keep full relative precision.
* chi-square upper tail = Q(df/2, x/2); two-sided normal tail = Q(1/2, z^2/2).
* ``ln_binomial_sql``: binomial probabilities in saddle-point form.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)
_SHIFT = 10


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def let_sql(name: str, body: str, **values: str) -> str:
    """``body`` with the struct ``name`` bound to ``values``: each is computed once. (A lambda over one element;
    lambdas are interpreted, so long formulas do not swell the generated code.)"""
    fields = ", ".join(f"'{k}', {v}" for k, v in values.items())
    return f"element_at(transform(array(named_struct({fields})), {name} -> {body}), 1)"


def stirling_error_sql(x: str) -> str:
    """ln x! - ln(sqrt(2 pi x) (x / e)^x) as SQL text; x a non-negative whole double."""
    w = "(se.x * se.x)"
    body = (f"CASE WHEN se.x <= 0 THEN 0.0D WHEN se.x <= 15 THEN ln(CAST(factorial(CAST(se.x AS INT)) AS DOUBLE)) "
            f"- (se.x + 0.5D) * ln(se.x) + se.x - {_HALF_LOG_2PI!r}D ELSE "
            f"(1D / 12 - (1D / 360 - (1D / 1260 - (1D / 1680 - 1D / 1188 / {w}) / {w}) / {w}) / {w}) / se.x END")
    return let_sql("se", body, x=x)


def deviance_sql(x: str, m: str) -> str:
    """x ln(x / m) + m - x, by its series where x is near m so that no digits cancel."""
    series = f"{1 / 17!r}D"
    for k in range(15, 1, -2):
        series = f"({1 / k!r}D + dv.v * dv.v * {series})"
    body = (f"CASE WHEN dv.x <= 0 THEN dv.m WHEN abs(dv.v) < 0.1D "
            f"THEN (dv.x - dv.m) * dv.v + 2D * dv.x * dv.v * dv.v * dv.v * {series} ELSE dv.x * ln(dv.x / dv.m) + dv.m - dv.x END")
    return let_sql("dv", body, x=x, m=m, v=f"coalesce(try_divide({x} - {m}, {x} + {m}), 0D)")


def ln_binomial_sql(x: str, n: str, p: str, q: str) -> str:
    """ln P(x successes in n) in saddle-point form; q = 1 - p; whole doubles x, n with 0 <= x <= n."""
    body = (f"CASE WHEN b.x <= 0 THEN IF(b.p < 1, b.n * log1p(-b.p), 0D) WHEN b.x >= b.n THEN IF(b.p > 0, b.n * ln(b.p), 0D) ELSE "
            f"{stirling_error_sql('b.n')} - {stirling_error_sql('b.x')} - {stirling_error_sql('b.n - b.x')} "
            f"- {deviance_sql('b.x', '(b.n * b.p)')} - {deviance_sql('(b.n - b.x)', '(b.n * b.q)')} "
            f"+ 0.5D * ln(b.n / (b.x * (b.n - b.x))) - {_HALF_LOG_2PI!r}D END")
    return let_sql("b", body, x=x, n=n, p=p, q=q)


def ln_p(p) -> Column:
    """ln p of a p-value, NULL where it is 0 or missing: tells small tails apart."""
    p = _c(p)
    return F.when(p > 0.0, F.log(p))


def safe_div(a, b) -> Column:
    """a / b with R's result for a zero divisor (NaN / Inf) instead of an ANSI error."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return (F.when(b != 0.0, a / b)
            .when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
            .when(a == 0.0, F.lit(float("nan")))
            .when(a > 0.0, F.lit(float("inf")))
            .otherwise(F.lit(float("-inf"))))


def lgamma_sql(a: str) -> str:
    z = f"(CAST({a} AS DOUBLE) + {float(_SHIFT)!r})"
    stirling = (f"(({z} - 0.5) * ln({z}) - {z} + {_HALF_LOG_2PI!r} + 1.0 / (12.0 * {z}) "
                f"- 1.0 / (360.0 * {z} * {z} * {z}) + 1.0 / (1260.0 * {z} * {z} * {z} * {z} * {z}) "
                f"- 1.0 / (1680.0 * {z} * {z} * {z} * {z} * {z} * {z} * {z}))")
    logs = " + ".join(f"ln(CAST({a} AS DOUBLE) + {float(k)!r})" for k in range(_SHIFT))
    return f"({stirling} - ({logs}))"


def gamma_q_sql(a: str, x: str) -> str:
    """Regularised upper incomplete gamma Q(a, x) as SQL text (see ``gamma_q``)."""
    a, x = f"CAST({a} AS DOUBLE)", f"CAST({x} AS DOUBLE)"
    front = f"exp(-{x} + {a} * ln({x}) - {lgamma_sql(a)})"
    series = (f"aggregate(sequence(1, CAST(100.0 + 20.0 * sqrt({a} + {x}) AS INT)), "
              f"named_struct('t', 1.0D / {a}, 's', 1.0D / {a}), "
              f"(gq_acc, gq_n) -> named_struct('t', gq_acc.t * {x} / ({a} + gq_n), "
              f"'s', gq_acc.s + gq_acc.t * {x} / ({a} + gq_n)), gq_acc -> gq_acc.s)")
    depth = f"CAST(120.0 + 20.0 * sqrt({a}) AS INT)"
    cf = (f"aggregate(sequence({depth}, 1, -1), {x} + 2.0 * {depth} + 1.0 - {a}, "
          f"(gq_t, gq_i) -> {x} + 2.0 * (gq_i - 1) + 1.0 - {a} + (-(gq_i * (gq_i - {a}))) / gq_t)")
    return (f"(CASE WHEN {a} IS NULL OR {x} IS NULL THEN CAST(NULL AS DOUBLE) "
            f"WHEN isnan({x}) OR isnan({a}) THEN CAST('NaN' AS DOUBLE) "
            f"WHEN {x} <= 0.0 THEN 1.0D "
            f"WHEN {x} < {a} + 1.0 THEN greatest(0.0D, 1.0D - {series} * {front}) "
            f"ELSE {front} / {cf} END)")


def chisq_sf_sql(stat: str, df: str) -> str:
    return gamma_q_sql(f"(CAST({df} AS DOUBLE) / 2.0)", f"(CAST({stat} AS DOUBLE) / 2.0)")


def norm_two_sided_sql(z: str) -> str:
    return gamma_q_sql("0.5D", f"(CAST({z} AS DOUBLE) * CAST({z} AS DOUBLE) / 2.0)")
