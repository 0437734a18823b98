"""Both data sets side by side (D40-D45): renamed, tagged, unioned, stacked.

Every table here is a union of reduced counts; the plot tables (W5-W7) add
shares and stack offsets as windows over those few rows per bar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matingstats.functions import text as T
from matingstats.functions.special import safe_div
from matingstats.operators.reshape import bind_rows
from matingstats.plans import master as M
from matingstats.plans import small as S

# Group labels and level order used by the original charts.
SMALL_TAG, MASTER_TAG = "genotype_data", "master_data"
SMALL_TAG_V1, MASTER_TAG_V1 = "small", "master"
COLONY_SOURCES = ["Small", "Master"]
COLONY_FILL_LEVELS = ["Small_Monogamous", "Small_Polygynous", "Master_Monogamous", "Master_Polygynous"]


def mixed_years(merged: DataFrame, m: DataFrame) -> DataFrame:
    """Yearly counts of both sets renamed (year, count, strategy_type) and tagged."""
    df1 = (S.summary_clean(merged)
           .select("sire_x", F.col("yrborn").alias("year"), F.col("n_dams").alias("count"),
                   F.col("strategy").alias("strategy_type"))
           .withColumn("year", T.as_integer("year"))
           .withColumn("source", F.lit("summary_df")))
    df2 = (M.offspring_by_year(m)
           .select(F.col("yob").alias("year"), F.col("count"), F.col("type").alias("strategy_type"))
           .withColumn("year", T.as_integer("year"))
           .withColumn("count", F.col("count").cast("double"))
           .withColumn("source", F.lit("combined_counts")))
    df1 = df1.withColumn("count", F.col("count").cast("double"))
    return bind_rows(df1, df2)


def mixed_sires(merged: DataFrame, m: DataFrame) -> DataFrame:
    """Distinct sires per (year, strategy) in each set, union, fill group.

    The mating-level tables have one row per (sire, year), so a count is the distinct count.
    """
    small = (S.sire_level_mating(merged).groupBy("yrborn", "strategy")
             .agg(F.count("*").alias("n_sires"))
             .withColumn("yrborn", T.as_integer("yrborn"))
             .withColumn("dataset", F.lit(SMALL_TAG)))
    master = (M.master_level(m).groupBy("yob", "strategy")
              .agg(F.count("*").alias("n_sires"))
              .withColumnRenamed("yob", "yrborn")
              .withColumn("yrborn", T.as_integer("yrborn"))
              .withColumn("dataset", F.lit(MASTER_TAG)))
    df = bind_rows(small, master)
    return df.withColumn("fill_group", T.paste("dataset", "strategy"))


def mixed_year_counts(merged: DataFrame, m: DataFrame) -> DataFrame:
    """D42 (first script): D25 and D9 renamed to (yrborn, n_sires, strategy), tagged."""
    master = (M.offspring_by_year(m)
              .select(F.col("yob").alias("yrborn"), F.col("count").alias("n_sires"),
                      F.col("type").alias("strategy"))
              .withColumn("yrborn", T.as_integer("yrborn"))
              .withColumn("dataset", F.lit(MASTER_TAG_V1)))
    small = (S.sire_classification(merged)
             .withColumnRenamed("n_dams", "n_sires")
             .withColumn("yrborn", T.as_integer("yrborn"))
             .withColumn("dataset", F.lit(SMALL_TAG_V1)))
    df = bind_rows(master, small)
    return df.withColumn("fill_group", T.paste("dataset", "strategy"))


def mixed_valleys(types_small: DataFrame, types_master: DataFrame) -> DataFrame:
    """Valley counts of both sets, tagged, fill group."""
    a = S.valley_summary(types_small).withColumn("dataset", F.lit(SMALL_TAG))
    b = M.valley_master(types_master).withColumn("dataset", F.lit(MASTER_TAG))
    return bind_rows(a, b).withColumn("fill_group", T.paste("dataset", "strategy"))


def mixed_colonies(clean: DataFrame, m: DataFrame) -> DataFrame:
    """Colony counts of both sets, ``source_strategy`` with its fixed level order."""
    a = S.colony_summary(clean).withColumn("source", F.lit(COLONY_SOURCES[0]))
    b = M.colony_year_number(m).withColumn("source", F.lit(COLONY_SOURCES[1]))
    df = bind_rows(a, b).withColumn("strategy_fill", T.paste("source", "strategy"))
    return df.withColumn("strategy_fill_order", T.factor_order("strategy_fill", COLONY_FILL_LEVELS))


# ----------------------------------------------------------- plot tables D45

def _bars(df: DataFrame, keys: list[str], fill: str, y: str, order: str | None) -> DataFrame:
    """One segment per (facet, x, fill): rows of the same fill in one bar are
    drawn as adjacent segments, i.e. their sum."""
    cols = [*keys, fill] + ([order] if order and order != fill else [])
    return df.groupBy(*cols).agg(F.sum(F.col(y).cast("double")).alias("y"))


def fill_positions(df: DataFrame, facet: str | None, x: str, fill: str, y: str,
                   order: str | None = None) -> DataFrame:
    """``position = "fill"`` - each bar scaled to 1 and stacked.

    The first fill level is drawn on top (stacking runs over levels in
    reverse order), so offsets accumulate in descending level order
    (``order`` gives an explicit level-order column).
    """
    keys = [facet, x] if facet else [x]
    w = Window.partitionBy(*keys)
    ws = w.orderBy(F.col(order or fill).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _bars(df, keys, fill, y, order)
    out = out.withColumn("prop", safe_div(F.col("y"), F.sum("y").over(w)))
    out = out.withColumn("ymax", F.sum("prop").over(ws))
    return out.withColumn("ymin", F.col("ymax") - F.col("prop"))


def stack_positions(df: DataFrame, facet: str | None, x: str, fill: str, y: str,
                    order: str | None = None) -> DataFrame:
    """``position = "stack"`` - bars stacked in reverse level order."""
    keys = [facet, x] if facet else [x]
    ws = Window.partitionBy(*keys).orderBy(F.col(order or fill).desc()) \
               .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _bars(df, keys, fill, y, order)
    out = out.withColumn("ymax", F.sum("y").over(ws))
    return out.withColumn("ymin", F.col("ymax") - F.col("y"))


def plot_fill(types_master: DataFrame) -> DataFrame:
    """Chart data behind the master valley-by-year proportions."""
    return fill_positions(M.valley_year_master(types_master), "valley", "yob", "strategy", "n_individuals")


def plot_stack(types_small: DataFrame, types_master: DataFrame) -> DataFrame:
    """Chart data behind the stacked valley comparison."""
    return stack_positions(mixed_valleys(types_small, types_master), "dataset", "valley",
                           "fill_group", "n_individuals")


def plot_fill_valley_year_small(types_small: DataFrame) -> DataFrame:
    """Chart data: small-data offspring proportions by year within valley."""
    return fill_positions(S.valley_year_summary(types_small), "valley", "yrborn", "strategy", "n_individuals")


def plot_fill_pairings(merged: DataFrame) -> DataFrame:
    """Chart data: proportion of pairings by year."""
    return fill_positions(S.pairings_by_year(merged), None, "yrborn", "strategy", "n_dams")


def plot_stack_years(merged: DataFrame, m: DataFrame) -> DataFrame:
    """Chart data: yearly counts of both sets stacked by data set and strategy."""
    return stack_positions(mixed_year_counts(merged, m), "dataset", "yrborn", "fill_group", "n_sires")


def plot_stack_sires(merged: DataFrame, m: DataFrame) -> DataFrame:
    """Chart data: distinct sires of both sets stacked."""
    return stack_positions(mixed_sires(merged, m), "dataset", "yrborn", "fill_group", "n_sires")


def plot_stack_colonies(clean: DataFrame, m: DataFrame) -> DataFrame:
    """Chart data: colony counts of both sets stacked in the fixed level order."""
    return stack_positions(mixed_colonies(clean, m), "source", "col_area", "strategy_fill", "n_individuals",
                           order="strategy_fill_order")
