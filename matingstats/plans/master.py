"""Master data set: one pedigree table.

Input role frame ``master`` (uid, sire, dam, yob, col_area) and the
``places`` dimension (col_area, valley) of allowed colonies.
Two forms exist for the colony chain (D29-D35): ``refined`` (colony text
lower-cased and trimmed, NA dam kept and counted) and ``analysis`` (sire, yob,
dam known, colony text as written).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matingstats.functions import text as T
from matingstats.functions.special import safe_div
from matingstats.operators import classify as C
from matingstats.operators.chisq import chisq_test, std_residuals
from matingstats.operators.joins import POSITION, first_per_key
from matingstats.operators.fisher import fisher_monte_carlo, fisher_rx2
from matingstats.operators.ranksum import rank_sum_test
from matingstats.operators.reshape import (complete_cells, non_integer_audit, pivot_longer,
                                           pivot_wider, uncount)
from matingstats.session import reliable_checkpoint


def _known_sire_year(m: DataFrame) -> DataFrame:
    return m.where(F.col("sire").isNotNull() & F.col("yob").isNotNull())


# ----------------------------------------------------------- D24-D26

def sire_year_labels(m: DataFrame) -> DataFrame:
    """One row per (sire, yob): offspring count and strategy, NA dam counted."""
    return C.label_groups(_known_sire_year(m), "sire", "yob", "dam", na_is_value=True)


def _rows_labelled(m: DataFrame, label: str) -> DataFrame:
    """Rows of the (sire, yob) groups with that label, sorted by sire and year. The input is written once: it feeds
    the label and the rows."""
    known = reliable_checkpoint(_known_sire_year(m))
    rows = C.label_rows(known, "sire", "yob", "dam", na_is_value=True)
    return rows.where(F.col("strategy") == label).select(*m.columns) \
               .orderBy(F.col("sire").asc_nulls_last(), F.col("yob").asc_nulls_last())


def master_polygynous(m: DataFrame) -> DataFrame:
    """Rows of (sire, yob) groups with more than one dam (NA counted) - W1, W3."""
    return _rows_labelled(m, C.POLY)


def master_monogamous(m: DataFrame) -> DataFrame:
    """Rows of (sire, yob) groups with exactly one dam value - W2."""
    return _rows_labelled(m, C.MONO)


def offspring_by_year(m: DataFrame) -> DataFrame:
    """Offspring rows per (yob, type) - counted from per-group totals, no join back."""
    lab = sire_year_labels(m)
    return lab.groupBy("yob", F.col("strategy").alias("type")) \
              .agg(F.sum("n_rows").cast("bigint").alias("count")) \
              .select("yob", "count", "type")


def year_shares(m: DataFrame) -> DataFrame:
    """Share of each type within its year."""
    c = offspring_by_year(m)
    return c.withColumn("prop", safe_div(F.col("count"), F.sum("count").over(Window.partitionBy("yob"))))


def year_cells(m: DataFrame) -> DataFrame:
    return complete_cells(offspring_by_year(m), ["yob"], "type", C.LEVELS, "count")


def year_table(m: DataFrame) -> DataFrame:
    """D26 wide: yob x (Monogamous, Polygynous) offspring counts, absent cells 0."""
    return pivot_wider(offspring_by_year(m), ["yob"], "type", "count", C.LEVELS)


def chisq_master(m: DataFrame) -> DataFrame:
    """T1 on the year x type table of D25."""
    return chisq_test(year_cells(m), "yob", "type", "count")


def master_residuals(m: DataFrame) -> DataFrame:
    """T2 on the year x type table of D25."""
    return std_residuals(year_cells(m), "yob", "type", "count")


# ----------------------------------------------------------- D28

def master_level(m: DataFrame) -> DataFrame:
    """Mating-level classification of every (sire, yob), known dams only."""
    out = C.count_dams(m, "sire", "yob", "dam")
    return out.select("sire", "yob", F.col("n_dams").cast("bigint").alias("n_dams"), "strategy",
                      C.strategy_bin(F.col("strategy")).alias("strategy_bin"))


def master_level_counts(m: DataFrame) -> DataFrame:
    """(sire, yob) pairs per (yob, strategy) - the flagship summary of D28."""
    return master_level(m).groupBy("yob", "strategy").agg(F.count(F.lit(1)).alias("n_pairs"))


# ----------------------------------------------------------- colonies D29-D35

def fixed_master_ped(m: DataFrame, form: str = "refined") -> DataFrame:
    """``refined`` normalises colony text; ``analysis`` keeps rows with
    sire, yob and dam known and leaves the text as written."""
    if form == "refined":
        return m.withColumn("col_area", T.normalise_text("col_area"))
    if form == "analysis":
        return m.where(F.col("sire").isNotNull() & F.col("yob").isNotNull() & F.col("dam").isNotNull())
    raise ValueError(f"form must be 'refined' or 'analysis', not {form!r}")


def colony_list(m: DataFrame, form: str = "refined") -> DataFrame:
    """Distinct normalised colony names, sorted."""
    return fixed_master_ped(m, form).select(T.normalise_text("col_area").alias("col_area")).distinct() \
        .orderBy(F.col("col_area").asc_nulls_last())


def colony_types_master(m: DataFrame, places: DataFrame, form: str = "refined",
                        mode: str = "independent") -> DataFrame:
    """Distinct (dam, sire, yob, colony) in allowed colonies, strategy by
    membership in the D24 sets, valley. One inner join with the dimension is
    both the allowed-colony filter and the valley lookup."""
    distinct_rows = reliable_checkpoint(fixed_master_ped(m, form).select("dam", "sire", "yob", "col_area").distinct())
    if form == "refined":
        # the refined form keeps every row, and the label (some dam known and
        # either two distinct dams or also a missing one) does not change under
        # de-duplication: take it from the distinct rows, one pass over the input
        labels = C.label_groups(_known_sire_year(distinct_rows), "sire", "yob", "dam", na_is_value=True)
    else:
        labels = sire_year_labels(m)
    rows = distinct_rows.join(places.select("col_area", "valley"), "col_area", "inner")
    out = C.membership_strategy(rows, "sire", "yob", labels, "sire", "yob", mode)
    return out.select("dam", "sire", "yob", "col_area", "strategy", "valley")


def colony_year_counts(m: DataFrame, form: str = "refined") -> DataFrame:
    """Offspring per (yob, colony, strategy); the label is per (sire, yob)
    with NA dam counted, computed on rows pre-aggregated by colony."""
    f = _known_sire_year(fixed_master_ped(m, form))
    lab = C.label_finer_counts(f, "sire", "yob", "dam", ["col_area"], na_is_value=True)
    return lab.groupBy("yob", "col_area", "strategy").agg(F.sum("n_rows").cast("bigint").alias("count"))


def colony_year_number(m: DataFrame, form: str = "refined") -> DataFrame:
    """Rows of D32 per (colony, strategy) - i.e. the number of years."""
    return colony_year_counts(m, form).groupBy("col_area", "strategy") \
        .agg(F.count(F.lit(1)).alias("n_individuals"))


def valley_master(types: DataFrame) -> DataFrame:
    """Rows of D31 per (valley, strategy)."""
    return types.groupBy("valley", "strategy").agg(F.count(F.lit(1)).alias("n_individuals"))


def valley_year_master(types: DataFrame) -> DataFrame:
    """Rows of D31 per (valley, yob, strategy)."""
    return types.groupBy("valley", "yob", "strategy").agg(F.count(F.lit(1)).alias("n_individuals"))


def rank_sum_master(types: DataFrame) -> DataFrame:
    """T3 per valley on D35."""
    return rank_sum_test(valley_year_master(types), "valley", "strategy", "n_individuals",
                         first_level=C.MONO)


def valley_year_wide(types: DataFrame) -> DataFrame:
    """(yob, valley, Monogamous, Polygynous): the wide table behind D36 and D39."""
    return pivot_wider(valley_year_master(types), ["yob", "valley"], "strategy", "n_individuals", C.LEVELS)


def int_audit(types: DataFrame) -> DataFrame:
    """Per non-year column, the cells that are not digit strings."""
    return non_integer_audit(valley_year_wide(types), ["valley", C.MONO, C.POLY])


def first_offspring(m: DataFrame) -> DataFrame:
    """G7 on the master pedigree: of each known sire the first row by input order."""
    return first_per_key(m.where(F.col("sire").isNotNull()), "sire", [POSITION]).drop(POSITION)


# ----------------------------------------------------------- tests D37-D39

def colony_table(m: DataFrame, form: str = "refined") -> DataFrame:
    """D37 input: colony x strategy from D33, zero-filled."""
    return pivot_wider(colony_year_number(m, form), ["col_area"], "strategy", "n_individuals", C.LEVELS)


def fisher_colony_mc(m: DataFrame, form: str = "analysis", B: int = 100_000, seed: int = 20250101) -> DataFrame:
    """Monte-Carlo Fisher test of colony x strategy."""
    t = colony_table(m, form)
    return fisher_monte_carlo(m.sparkSession, t, C.MONO, C.POLY, B=B, seed=seed)


def fisher_per_year(types: DataFrame) -> DataFrame:
    """Fisher test of valley x strategy per year; tested only when at
    least two valleys have offspring (G11); label "Yes" / "No" / "NA"."""
    wide = reliable_checkpoint(valley_year_wide(types).where(F.col("yob").isNotNull()))
    res = fisher_rx2(wide, ["yob"], "valley", C.MONO, C.POLY)
    nonzero = wide.groupBy("yob").agg(
        F.sum(F.when(F.col(C.MONO) + F.col(C.POLY) > 0, 1).otherwise(0)).alias("_nz"))
    res = res.join(nonzero, "yob")
    tested = (F.col("n_rows") > 1) & (F.col("_nz") > 1)
    p = F.when(tested, F.col("p_value"))
    return res.select(F.col("yob").alias("year"), p.alias("p_value"),
                      T.significance_text_na(p, tested).alias("Significant")).orderBy(F.col("year").asc_nulls_last())


def long_offspring(types: DataFrame) -> DataFrame:
    """One row per offspring (unpivot + uncount) with a 0/1 response."""
    long = pivot_longer(valley_year_wide(types), ["yob", "valley"], C.LEVELS, "strategy", "count")
    rows = uncount(long, "count")
    return rows.withColumn("strategy_bin", C.strategy_bin(F.col("strategy")))
