"""Small data set: genotype metadata joined to the parentage table.

Inputs are role frames: ``parent`` (id, sire, dam), ``meta`` (uid, sire,
dam, yrborn, col_area, sex) and ``places`` (col_area, valley). Column names
with R's ``.x`` / ``.y`` suffixes are written ``_x`` / ``_y``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matingstats.functions import text as T
from matingstats.operators import classify as C
from matingstats.operators.chisq import chisq_test, std_residuals
from matingstats.operators.fisher import fisher_2x2, fisher_rx2
from matingstats.operators.joins import POSITION, first_per_key, full_join, joined_position
from matingstats.operators.ranksum import rank_sum_test
from matingstats.operators.reshape import complete_cells, pivot_wider
from matingstats.session import reliable_checkpoint
from matingstats.sources.roles import OTHER


# ------------------------------------------------------------ cleaning, D1-D6

def parent_new(parent: DataFrame) -> DataFrame:
    """Id renamed uid, prefix stripped (twice, as the original does), text."""
    rest = [c for c in parent.columns if c != "id"]
    return parent.select(T.strip_prefix(F.col("id").cast("string"), times=2).alias("uid"), *rest)


def small_ped(meta: DataFrame) -> DataFrame:
    """Uid prefix stripped twice, text."""
    return meta.withColumn("uid", T.strip_prefix(F.col("uid").cast("string"), times=2))


def merged_ped(parent: DataFrame, meta: DataFrame) -> DataFrame:
    """D3: full join on uid, NULL uid matching NULL uid, ``_x`` / ``_y`` suffixes."""
    return full_join(parent_new(parent), small_ped(meta), "uid")


def clean_offspring(merged: DataFrame) -> DataFrame:
    """D4: "N/A" year is missing; sire and year known; five columns; uid stripped once more. (And the rows' position, if the join carried it.)"""
    y = T.na_if("yrborn", T.NA_YEAR_TOKEN)
    kept = []
    if f"{POSITION}_x" in merged.columns:
        merged, kept = joined_position(merged), [POSITION]
    return (merged.withColumn("yrborn", y)
                  .where(F.col("sire_x").isNotNull() & F.col("yrborn").isNotNull())
                  .select(T.strip_prefix("uid").alias("uid"), F.col("dam_x").alias("dam"),
                          F.col("sire_x").alias("sire"), "yrborn", "col_area", *kept))


def unique_matings(merged: DataFrame) -> DataFrame:
    """Distinct (uid, sire, dam, year) - offspring level."""
    return merged.select("uid", "sire_x", "dam_x", "yrborn").distinct()


def sire_dam_year(merged: DataFrame) -> DataFrame:
    """Distinct (sire, dam, year) with all three known - mating level."""
    return (merged.where(F.col("sire_x").isNotNull() & F.col("dam_x").isNotNull()
                         & F.col("yrborn").isNotNull())
                  .select("sire_x", "dam_x", "yrborn").distinct())


def sire_classification(merged: DataFrame) -> DataFrame:
    """Per (sire, year) the number of dams and the strategy.

    The year is taken as written, so "N/A" is a year of its own here.
    """
    return C.count_dams(merged, "sire_x", "yrborn", "dam_x") \
            .select("sire_x", "yrborn", F.col("n_dams").cast("bigint").alias("n_dams"), "strategy")


def polygynous_sires(merged: DataFrame) -> DataFrame:
    """The polygynous rows of D7, sorted by sire and year."""
    return sire_classification(merged).where(F.col("strategy") == C.POLY) \
        .orderBy(F.col("sire_x").asc_nulls_last(), F.col("yrborn").asc_nulls_last())


def monogamous_sires(merged: DataFrame) -> DataFrame:
    """The monogamous rows of D7, sorted by sire and year."""
    return sire_classification(merged).where(F.col("strategy") == C.MONO) \
        .orderBy(F.col("sire_x").asc_nulls_last(), F.col("yrborn").asc_nulls_last())


# ------------------------------------------------------- strategy per pup

def sire_strategy_again(clean: DataFrame) -> DataFrame:
    """The D7 rule on the cleaned offspring table."""
    return C.label_pairs(clean, "sire", "yrborn", "dam")


def offspring_strategy(clean: DataFrame) -> DataFrame:
    """Pups with a known strategy, one row per uid.

    ``left_join`` + ``!is.na(strategy)`` is an inner join; the first row per uid is the first by input order where
    ``clean`` carries the position, else the smallest by (yrborn, sire, dam, col_area), NULLs first.
    """
    placed = POSITION in clean.columns
    columns = ["uid", "dam", "sire", "yrborn", "col_area", "strategy"]
    j = clean.join(sire_strategy_again(clean), ["sire", "yrborn"], "inner").select(*columns, *([POSITION] if placed else []))
    return first_per_key(j, "uid", [POSITION] if placed else ["yrborn", "sire", "dam", "col_area"]).select(*columns)


def colony_summary(clean: DataFrame) -> DataFrame:
    """Pups per (colony, strategy)."""
    return offspring_strategy(clean).groupBy("col_area", "strategy") \
        .agg(F.count(F.lit(1)).alias("n_individuals"))


# ------------------------------------------------------------ valleys, D13-D15

def with_valley(df: DataFrame, places: DataFrame, default: str | None = OTHER) -> DataFrame:
    """Valley of each row's colony; colonies outside the dimension (NULL
    included) get ``default``. The dimension is a few rows: the planner
    broadcasts it by its measured size."""
    p = places.select(F.col("col_area").alias("_ca"), F.col("valley"))
    j = df.join(p, df["col_area"] == p["_ca"], "left").drop("_ca")
    return j.withColumn("valley", F.coalesce(F.col("valley"), F.lit(default))) if default else j


def valley_types(merged: DataFrame, places: DataFrame, mode: str = "independent") -> DataFrame:
    """Distinct (dam, sire, year, colony, sex), strategy by membership
    (P14, ``independent`` or ``pair``), valley Upper / Lower / Other."""
    # D7 labels (n_dams is not needed here). min/max of dam per (sire, year) do
    # not change under de-duplication, so they are taken from the distinct rows:
    # the merged table is computed once, written, and feeds both branches.
    rows = reliable_checkpoint(merged.select("dam_x", "sire_x", "yrborn", "col_area", "sex").distinct())
    cls = C.label_pairs(rows, "sire_x", "yrborn", "dam_x")
    lab = C.membership_strategy(rows, "sire_x", "yrborn", cls, "sire_x", "yrborn", mode)
    return with_valley(lab, places)


def valley_summary(types: DataFrame) -> DataFrame:
    """Rows per (valley, strategy)."""
    return types.groupBy("valley", "strategy").agg(F.count(F.lit(1)).alias("n_individuals"))


def valley_year_summary(types: DataFrame) -> DataFrame:
    """Rows per (valley, year, strategy)."""
    return types.groupBy("valley", "yrborn", "strategy").agg(F.count(F.lit(1)).alias("n_individuals"))


# ------------------------------------------------------------ sire level, D16

def clean_year(c, trim: bool) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    if trim:
        return T.as_numeric(T.na_if(T.trimws(c), T.NA_YEAR_TOKEN, ""))
    return T.as_numeric(T.na_if(c, T.NA_YEAR_TOKEN))


def sire_level_offspring(merged: DataFrame) -> DataFrame:
    """D16a (first script): rows of D5 per (sire, year) named n_dams; NA sire kept."""
    um = unique_matings(merged).withColumn("yrborn", clean_year("yrborn", trim=True)) \
                               .where(F.col("yrborn").isNotNull())
    out = um.groupBy("sire_x", "yrborn").agg(F.count(F.lit(1)).alias("n_dams"))
    strategy = C.strategy_label(F.col("n_dams") > 1)
    return out.select("sire_x", "yrborn", "n_dams", strategy.alias("strategy"),
                      C.strategy_bin(strategy).alias("strategy_num"))


def sire_level_mating(merged: DataFrame) -> DataFrame:
    """D16b (second script): numeric year, mating level, distinct dams, 0/1 response."""
    um = unique_matings(merged).withColumn("yrborn", clean_year("yrborn", trim=False))
    out = C.count_dams(um, "sire_x", "yrborn", "dam_x")
    return out.select("sire_x", "yrborn", F.col("n_dams").cast("bigint").alias("n_dams"), "strategy",
                      C.strategy_bin(F.col("strategy")).alias("strategy_bin"))


# ------------------------------------------------------ year tables, D17-D19

def summary_clean(merged: DataFrame) -> DataFrame:
    """D9 with n_dams numeric and NA -> 0."""
    s = sire_classification(merged)
    return s.withColumn("n_dams", T.zero_if_na(T.as_numeric(T.trimws(F.col("n_dams").cast("string")))))


def pairings_by_year(merged: DataFrame) -> DataFrame:
    """Sum of n_dams (pairings) per (year, strategy)."""
    return summary_clean(merged).groupBy("yrborn", "strategy") \
        .agg(F.sum("n_dams").cast("bigint").alias("n_dams"))


def pairings_wide(merged: DataFrame) -> DataFrame:
    """Year x strategy, absent cells 0."""
    return pivot_wider(pairings_by_year(merged), ["yrborn"], "strategy", "n_dams", C.LEVELS)


def chisq_year(merged: DataFrame) -> DataFrame:
    """T1 on D19."""
    cells = complete_cells(pairings_by_year(merged), ["yrborn"], "strategy", C.LEVELS, "n_dams")
    return chisq_test(cells, "yrborn", "strategy", "n_dams")


def valley_cells(types: DataFrame) -> DataFrame:
    """Valley x strategy cells, zero-filled."""
    return complete_cells(valley_summary(types), ["valley"], "strategy", C.LEVELS, "n_individuals")


def valley_table(types: DataFrame) -> DataFrame:
    """D20 wide: valley x (Monogamous, Polygynous), absent cells 0."""
    return pivot_wider(valley_summary(types), ["valley"], "strategy", "n_individuals", C.LEVELS)


def chisq_valley(types: DataFrame) -> DataFrame:
    """T1 on D20."""
    return chisq_test(valley_cells(types), "valley", "strategy", "n_individuals")


def chisq_valley_residuals(types: DataFrame) -> DataFrame:
    """T2 on D20."""
    return std_residuals(valley_cells(types), "valley", "strategy", "n_individuals")


# ------------------------------------------- per-year valley tables, D21-D23

def year_valley_wide(types: DataFrame) -> DataFrame:
    """Rows per (year, valley, strategy), wide over strategy."""
    t = types.groupBy("yrborn", "valley", "strategy").agg(F.count(F.lit(1)).alias("n"))
    return pivot_wider(t, ["yrborn", "valley"], "strategy", "n", C.LEVELS)


def fisher_by_year(wide: DataFrame, exact_rx2: bool = True) -> DataFrame:
    """Fisher test of valley x strategy per year on the wide table of D21; NA when one valley.

    ``exact_rx2`` runs the r x 2 test per year; otherwise
    the "Other" valley is dropped and the 2 x 2 column form is used.
    """
    if exact_rx2:
        res = fisher_rx2(wide, ["yrborn"], "valley", C.POLY, C.MONO)
    else:
        res = fisher_2x2(wide.where(F.col("valley") != OTHER), ["yrborn"], "valley", C.POLY, C.MONO)
    return res.select("yrborn", F.when(F.col("n_rows") > 1, F.col("p_value")).alias("p_value"))


def valid_fisher(wide: DataFrame) -> DataFrame:
    """P11 on D22: years with a finite p-value."""
    r = fisher_by_year(wide)
    return r.where(~T.is_na("p_value"))


def final_table(types: DataFrame) -> DataFrame:
    """D21 + dominant strategy, joined to the per-year test, labelled.

    The wide table (three rows a year) is computed once and written; the test and the
    output both read it.
    """
    wide = reliable_checkpoint(year_valley_wide(types))
    res = fisher_by_year(wide)
    out = wide.withColumn("dominant_strategy", T.dominant_level(C.POLY, C.MONO)).join(res, "yrborn", "left") \
              .withColumn("significant", T.significance_label("p_value"))
    return out.select("yrborn", "valley", C.MONO, C.POLY, "dominant_strategy", "p_value", "significant") \
              .orderBy(F.col("yrborn").asc_nulls_last(), F.col("valley").asc_nulls_last())


# --------------------------------------------------------- rank-sum, D27

def valley_year_small(types: DataFrame) -> DataFrame:
    """D27 counts: drop "Other", numeric year, rows per (valley, year, strategy)."""
    t = (types.where(F.col("strategy").isNotNull() & F.col("valley").isNotNull()
                     & (F.col("valley") != OTHER))
              .withColumn("yrborn", T.as_numeric("yrborn"))
              .where(F.col("yrborn").isNotNull()))
    return t.groupBy("valley", "yrborn", "strategy").agg(F.count(F.lit(1)).alias("n_individuals"))


def rank_sum_small(types: DataFrame) -> DataFrame:
    """T3 per valley on D27."""
    return rank_sum_test(valley_year_small(types), "valley", "strategy", "n_individuals",
                         first_level=C.MONO)
