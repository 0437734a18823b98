"""Wilcoxon rank-sum (Mann-Whitney) test per group, normal approximation.

``value ~ level`` within each group: the first level (alphabetical) is the x
sample. Average ranks for ties; W = R_x - n_x (n_x + 1) / 2;
sigma^2 = n_x n_y / 12 ((N + 1) - sum(t^3 - t) / (N (N - 1)));
z = (W - n_x n_y / 2 - sign * 0.5) / sigma (continuity correction);
p = P(|Z| > |z|). Groups with fewer than two levels give NULL p and W.

Mid-ranks come from a histogram: rows are counted per (group, value), the counts range-partitioned by group and value, and
the rank of a value is what the partitions before its own hold of the group, plus a running sum inside the partition. So a group of any size is
spread over all partitions; what one task sorts is a partition's distinct values, and what is gathered of a group is one total per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matingstats.functions.special import ln_p, norm_two_sided_sql, safe_div
from matingstats.functions.text import significance_yes_no
from matingstats.session import reliable_checkpoint


def rank_sum_test(df: DataFrame, group: str, level: str, value: str,
                  first_level: str | None = None, alpha: float = 0.05) -> DataFrame:
    spark = df.sparkSession
    x = df.select(group, level, F.col(value).cast("double").alias("_v"))
    counts = x.groupBy(group, level, "_v").agg(F.count(F.lit(1)).alias("_n"))
    if first_level is None:
        counts = reliable_checkpoint(counts)
        first = counts.groupBy(group).agg(F.min(level).alias("_first"))
        counts = counts.join(first.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    else:
        counts = counts.withColumn("_first", F.lit(first_level))
    is_x = F.col(level) == F.col("_first")
    cells = counts.groupBy(group, "_v").agg(
        F.sum("_n").alias("_t"), F.sum(F.when(is_x, F.col("_n")).otherwise(0)).alias("_x"), F.min(level).alias("_low"), F.max(level).alias("_high"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, so that a value stays in its partition
    cells = reliable_checkpoint(cells.repartitionByRange(parts, group, "_v").withColumn("_part", F.spark_partition_id()))
    totals = cells.groupBy(group, "_part").agg(F.sum("_t").alias("_sum"))
    totals = totals.groupBy(F.col(group).alias("_g")).agg(F.collect_list(F.struct("_part", "_sum")).alias("_parts"))  # one entry per partition at most
    inside = F.sum("_t").over(Window.partitionBy(group, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_t")
    placed = cells.withColumn("_inside", inside).join(totals, F.col(group).eqNullSafe(F.col("_g")))
    below = F.expr("_inside + aggregate(filter(_parts, p -> p._part < _part), 0L, (a, p) -> a + p._sum)")
    placed = placed.withColumn("_below", below)
    t = F.col("_t").cast("double")
    agg = placed.groupBy(group).agg(
        (F.when(F.min("_low") == F.max("_high"), 1).otherwise(2)).alias("_levels"),
        F.sum("_x").cast("double").alias("_nx"),
        F.sum(F.col("_t") - F.col("_x")).cast("double").alias("_ny"),
        F.sum(F.col("_x") * (F.col("_below") + (t + 1) / 2.0)).alias("_rx"),
        F.sum(t * t * t - t).alias("_ties"))
    nx, ny, N = F.col("_nx"), F.col("_ny"), F.col("_nx") + F.col("_ny")
    w = F.col("_rx") - nx * (nx + 1.0) / 2.0
    var = nx * ny / 12.0 * ((N + 1.0) - safe_div(F.col("_ties"), N * (N - 1.0)))
    d = w - nx * ny / 2.0
    z = safe_div(d - F.signum(d) * 0.5, F.sqrt(var))
    tested = F.col("_levels") > 1
    # z is materialised first so the tail expression refers to a column, not a copy of z's tree
    st = agg.select(group, tested.alias("_tested"), w.alias("_w"), z.alias("_z"))
    out = st.select(
        group,
        F.when(F.col("_tested"), F.expr(norm_two_sided_sql("_z"))).alias("p_value"),
        F.when(F.col("_tested"), F.col("_w")).alias("W"))
    return out.withColumn("ln_p", ln_p("p_value")).withColumn("Significant", significance_yes_no("p_value", alpha))
