"""Mating-strategy classification of (sire, year) groups.

A sire is *Polygynous* in a year when it mated with more than one dam, else
*Monogamous*. Two counting rules occur in the original analysis:

* dam filtered first (``n_distinct`` on known dams only), and
* NA dam kept and counted as one more value (``n_distinct`` counts NA).

Only the test ``n_distinct(dam) > 1`` is needed for a label, and it has a
constant-memory, partial-aggregatable form:
``min(dam) < max(dam)  OR  (0 < count(dam) < count(*))`` (the second part only
when NA counts). Labels are therefore computed with ``groupBy`` (map-side
combine, skew-safe: a hot sire is split over map tasks) and never with a
window over raw rows or ``collect_set``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matingstats.session import reliable_checkpoint

POLY = "Polygynous"
MONO = "Monogamous"
LEVELS = [MONO, POLY]  # factor order (alphabetical, as R sorts levels)
#: Rows of a year table that may be broadcast.
MAX_YEARS = 10_000


def strategy_label(multi: Column) -> Column:
    return F.when(multi, F.lit(POLY)).otherwise(F.lit(MONO))


def strategy_bin(label: Column) -> Column:
    return F.when(label == POLY, F.lit(1)).otherwise(F.lit(0)).cast("int")


def _multi(dmin: Column, dmax: Column, n_dam: Column, n_rows: Column, na_is_value: bool) -> Column:
    multi = F.coalesce(dmin < dmax, F.lit(False))
    if na_is_value:
        multi = multi | ((n_dam > 0) & (n_dam < n_rows))
    return multi


def dam_stats(df: DataFrame, keys: Sequence[str], dam: str) -> DataFrame:
    """Per group: row count and the three dam statistics behind the label."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(dam).alias("_dmin"), F.max(dam).alias("_dmax"), F.count(dam).alias("_ndam"))


def count_dams(matings: DataFrame, sire: str, year: str, dam: str) -> DataFrame:
    """Mating-level classification.

    Rows with an unknown sire, dam or year are dropped, then per (sire, year)
    ``n_dams`` = number of distinct dams and the strategy label. The distinct
    count is planned by Catalyst as a partial aggregate on (sire, year, dam)
    followed by a count per (sire, year): two shuffles, both map-side combined.
    """
    known = matings.where(F.col(sire).isNotNull() & F.col(dam).isNotNull() & F.col(year).isNotNull())
    out = known.groupBy(sire, year).agg(F.count_distinct(dam).alias("n_dams"))
    return out.withColumn("strategy", strategy_label(F.col("n_dams") > 1))


def label_pairs(matings: DataFrame, sire: str, year: str, dam: str) -> DataFrame:
    """Strategy per (sire, year) on known sire, dam and year, without the count.

    Same label as ``count_dams`` (n_distinct(dam) > 1 <=> min(dam) < max(dam)),
    but one map-side-combined aggregate and one shuffle instead of the two of
    a distinct count. Used wherever ``n_dams`` itself is not an output.
    """
    known = matings.where(F.col(sire).isNotNull() & F.col(dam).isNotNull() & F.col(year).isNotNull())
    st = known.groupBy(sire, year).agg(F.min(dam).alias("_dmin"), F.max(dam).alias("_dmax"))
    return st.select(sire, year, strategy_label(F.col("_dmin") < F.col("_dmax")).alias("strategy"))


def label_groups(df: DataFrame, sire: str, year: str, dam: str,
                 na_is_value: bool = True) -> DataFrame:
    """One row per (sire, year): ``n_rows`` (offspring) and ``strategy``.

    The caller filters unknown sire / year first (the filter runs *before*
    the grouped test in the original).
    """
    st = dam_stats(df, [sire, year], dam)
    multi = _multi(F.col("_dmin"), F.col("_dmax"), F.col("_ndam"), F.col("n_rows"), na_is_value)
    return st.select(sire, year, "n_rows", strategy_label(multi).alias("strategy"))


def label_rows(df: DataFrame, sire: str, year: str, dam: str,
               na_is_value: bool = True) -> DataFrame:
    """Every input row with the strategy of its (sire, year) group.

    Group statistics are aggregated (partial + final) and joined back on the
    group key; AQE splits a hot (sire, year) partition of the row side.
    """
    lab = label_groups(df, sire, year, dam, na_is_value).select(sire, year, "n_rows", "strategy")
    return df.join(lab, [sire, year], "inner")


def label_finer_counts(df: DataFrame, sire: str, year: str, dam: str,
                       extra: Sequence[str], na_is_value: bool = True) -> DataFrame:
    """Row counts per (sire, year, *extra) labelled by the (sire, year) strategy.

    Rows are pre-aggregated to (sire, year, *extra) first, so the window that
    combines the dam statistics over (sire, year) sees at most one row per
    distinct ``extra`` value (e.g. per colony) - bounded, whatever the skew.
    """
    keys = [sire, year, *extra]
    pre = dam_stats(df, keys, dam)
    if extra:
        w = Window.partitionBy(sire, year)
        pre = pre.select(
            *keys, "n_rows",
            F.min("_dmin").over(w).alias("_dmin"), F.max("_dmax").over(w).alias("_dmax"),
            F.sum("_ndam").over(w).alias("_ndam"), F.sum("n_rows").over(w).alias("_ngroup"))
        multi = _multi(F.col("_dmin"), F.col("_dmax"), F.col("_ndam"), F.col("_ngroup"), na_is_value)
    else:
        multi = _multi(F.col("_dmin"), F.col("_dmax"), F.col("_ndam"), F.col("n_rows"), na_is_value)
    return pre.select(*keys, "n_rows", strategy_label(multi).alias("strategy"))


def membership_strategy(rows: DataFrame, sire: str, year: str,
                        classified: DataFrame, c_sire: str, c_year: str,
                        mode: str = "independent") -> DataFrame:
    """Label rows by membership in the polygynous / monogamous sets.

    ``classified`` holds one row per (``c_sire``, ``c_year``) with ``strategy``.

    ``independent`` (as written in the original): Polygynous when the sire is
    *some* polygynous sire and the year is *some* polygynous year - two
    separate sets; else Monogamous by the same rule; else dropped.
    ``pair``: one lookup on the (sire, year) pair.

    A NULL sire or year is never a member (the sets hold no NULL). The
    sire flags are a shuffle join (the set grows with the data). The year
    flags are one row per year: written once, counted, and broadcast if there are at most
    ``MAX_YEARS``, so that rows are not shuffled on a few hot years; beyond that the join shuffles.
    """
    if mode not in ("independent", "pair"):
        raise ValueError(f"mode must be 'independent' or 'pair', not {mode!r}")
    flags = classified.select(F.col(c_sire).alias("_s"), F.col(c_year).alias("_y"),
                              (F.col("strategy") == POLY).cast("int").alias("_p"),
                              (F.col("strategy") == MONO).cast("int").alias("_m"))
    if mode == "pair":
        pair = flags.select("_s", "_y", F.col("_p").alias("_pp"), F.col("_m").alias("_mm"))
        j = rows.join(pair, (F.col(sire) == F.col("_s")) & (F.col(year) == F.col("_y")), "left")
        is_p = F.col("_pp") == 1
        is_m = F.col("_mm") == 1
        drop = ["_s", "_y", "_pp", "_mm"]
    else:
        sires = flags.groupBy("_s").agg(F.max("_p").alias("_sp"), F.max("_m").alias("_sm"))
        years = reliable_checkpoint(flags.groupBy("_y").agg(F.max("_p").alias("_yp"), F.max("_m").alias("_ym")))
        if years.count() <= MAX_YEARS:
            years = F.broadcast(years)
        j = (rows.join(sires, F.col(sire) == F.col("_s"), "left")
                 .join(years, F.col(year) == F.col("_y"), "left"))
        is_p = (F.col("_sp") == 1) & (F.col("_yp") == 1)
        is_m = (F.col("_sm") == 1) & (F.col("_ym") == 1)
        drop = ["_s", "_y", "_sp", "_sm", "_yp", "_ym"]
    lab = F.when(F.coalesce(is_p, F.lit(False)), F.lit(POLY)).when(F.coalesce(is_m, F.lit(False)), F.lit(MONO))
    return j.withColumn("strategy", lab).drop(*drop).where(F.col("strategy").isNotNull())
