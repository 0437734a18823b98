"""Scalar functions with the missing-value rules of the original analysis.

Every helper returns a Spark ``Column``; nothing here runs Python per row.
The rules that differ from Spark's defaults are spelled out in each helper:
``%in%`` is never NULL, ``paste`` writes NULL as ``"NA"``, ``grepl`` on NULL
is FALSE, ``ifelse`` on a NULL test is NULL, ``is.na`` is also true for NaN.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text tokens of the original data.
NA_TEXT = "NA"
NA_YEAR_TOKEN = "N/A"
ID_PREFIX = "UID_"

# R's whitespace set for trimws(): space, tab, carriage return, line feed.
_WS = " \t\r\n"
# Decimal literal accepted by R's as.numeric (surrounding whitespace allowed).
NUMERIC_TEXT = r"^[ \t\r\n]*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?[ \t\r\n]*$"
# Hexadecimal literal: sign, whole and fractional digits, binary exponent.
HEX_TEXT = r"^([-+]?)0[xX](?=\.?[0-9a-fA-F])([0-9a-fA-F]*)\.?([0-9a-fA-F]*)(?:[pP]([-+]?[0-9]+))?$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_prefix(c, prefix: str = ID_PREFIX, times: int = 1) -> Column:
    """``gsub("^UID_", "", x)`` applied ``times`` times in a row (F1)."""
    return F.regexp_replace(col(c), "^(" + re.escape(prefix) + "){1," + str(times) + "}", "")


def na_if(c, *tokens: str) -> Column:
    """``na_if(x, token)`` for each token in turn."""
    return reduce(lambda acc, t: F.nullif(acc, F.lit(t)), tokens, col(c))


def trimws(c) -> Column:
    """``trimws(x)``: strip space, tab, CR and LF at both ends."""
    return F.btrim(col(c), F.lit(_WS))


def normalise_text(c) -> Column:
    """``trimws(tolower(x))`` (F7 + F8)."""
    return trimws(F.lower(col(c)))


def as_numeric(c) -> Column:
    """``as.numeric(x)`` on text (F3); white space around is allowed, anything that is no number is NULL.

    Decimal literals; hexadecimal ones with an optional fraction and binary exponent (``0x1F``, ``0x1.8p3``); ``Inf``, ``infinity`` and
    ``NaN`` in either case, signed or not.
    """
    c = col(c).cast("string")
    t = trimws(c)
    digits = F.concat(F.regexp_extract(t, HEX_TEXT, 2), F.regexp_extract(t, HEX_TEXT, 3))
    value = F.aggregate(F.regexp_extract_all(F.lower(digits), F.lit("."), F.lit(0)), F.lit(0.0),
                        lambda a, d: a * 16.0 + (F.instr(F.lit("0123456789abcdef"), d) - 1))
    binary = F.coalesce(F.regexp_extract(t, HEX_TEXT, 4).try_cast("double"), F.lit(0.0)) - 4.0 * F.length(F.regexp_extract(t, HEX_TEXT, 3))
    # in two factors, so that neither overflows where the product does not
    scaled = value * F.pow(F.lit(2.0), F.floor(binary / 2)) * F.pow(F.lit(2.0), binary - F.floor(binary / 2))
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    return (F.when(c.rlike(NUMERIC_TEXT), t.try_cast("double"))
            .when(t.rlike(HEX_TEXT), sign * F.when(value == 0.0, 0.0).otherwise(scaled))
            .when(t.rlike(r"(?i)^[-+]?(inf|infinity)$"), sign * float("inf"))
            .when(t.rlike(r"(?i)^[-+]?nan$"), F.lit(float("nan"))))


def as_integer(c) -> Column:
    """``as.integer(x)``: numeric parse, then truncation toward zero; NULL beyond +-(2^31 - 1)."""
    x = as_numeric(c)
    return F.when(F.abs(x) < 2.0**31, x).try_cast("int")


def is_na(c) -> Column:
    """``is.na(x)``: NULL, and for doubles also NaN."""
    c = col(c)
    return c.isNull() | F.isnan(c)


def r_in(c, values: Iterable) -> Column:
    """``x %in% values`` for a literal set: never NULL (P10)."""
    values = list(values)
    has_na = any(v is None for v in values)
    lits = [v for v in values if v is not None]
    hit = F.coalesce(col(c).isin(lits), F.lit(False)) if lits else F.lit(False)
    return (hit | col(c).isNull()) if has_na else hit


def grepl(pattern: str, c) -> Column:
    """``grepl(pattern, x)``: FALSE on NULL, so ``!grepl`` is TRUE there."""
    return F.coalesce(col(c).cast("string").rlike(pattern), F.lit(False))


def paste(*cols, sep: str = "_") -> Column:
    """``paste(a, b, sep=)``: a NULL part is written ``NA``."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.coalesce(col(c).cast("string"), F.lit(NA_TEXT)))
    return F.concat(*parts)


def ifelse(test: Column, yes, no) -> Column:
    """``ifelse(test, yes, no)``: a NULL test gives NULL."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(test.isNull(), F.lit(None)).when(test, yes).otherwise(no)


def case_when(*branches, default=None) -> Column:
    """``case_when(cond ~ value, ...)``: first TRUE wins, NULL is not a match."""
    expr = None
    for cond, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return expr.otherwise(default)


def zero_if_na(c) -> Column:
    """``ifelse(is.na(n), 0, n)``."""
    return F.coalesce(col(c), F.lit(0))


def significance_label(p, alpha: float = 0.05) -> Column:
    """final_table form: NA p gives NA, p < alpha ``Yes``, else ``No``."""
    p = col(p)
    return (F.when(is_na(p), F.lit(None).cast("string"))
            .when(p < alpha, F.lit("Yes")).otherwise(F.lit("No")))


def significance_yes_no(p, alpha: float = 0.05) -> Column:
    """rank-sum form: NA p gives ``No``."""
    p = col(p)
    return F.when(~is_na(p) & (p < alpha), F.lit("Yes")).otherwise(F.lit("No"))


def significance_text_na(p, tested: Column, alpha: float = 0.05) -> Column:
    """per-year Fisher form: untested gives the string ``"NA"`` (F16)."""
    p = col(p)
    return (F.when(~tested, F.lit(NA_TEXT))
            .when(is_na(p), F.lit(None).cast("string"))
            .when(p < alpha, F.lit("Yes")).otherwise(F.lit("No")))


def dominant_level(poly, mono) -> Column:
    """Polygynous / Monogamous / Tie by the larger count."""
    poly, mono = col(poly), col(mono)
    return ifelse(poly > mono, "Polygynous", ifelse(mono > poly, "Monogamous", "Tie"))


def factor_order(c, levels: list[str]) -> Column:
    """Position of ``c`` in ``levels`` (1-based), NULL when outside."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), col(c))
    return F.when(pos > 0, pos.cast("int"))
