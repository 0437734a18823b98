"""Join helpers with the original join semantics."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def full_join(x: DataFrame, y: DataFrame, by: str, suffix: Sequence[str] = ("_x", "_y")) -> DataFrame:
    """``full_join(x, y, by)``: NULL keys match each other, clashing non-key
    columns get suffixes, the key is the coalesce of both sides (J1).

    Known keys are one full outer join: each side is read and shuffled once. The NULL keys,
    the only ones that can be hot in a table of ids, are joined on their own as ``x LEFT
    JOIN y`` plus the rows of ``y`` if ``x`` has none, both of which AQE can split.
    """
    common = (set(x.columns) & set(y.columns)) - {by}
    xs = x.select(F.col(by).alias("_kx"),
                  *[F.col(c).alias(c + suffix[0] if c in common else c) for c in x.columns if c != by])
    ys = y.select(F.col(by).alias("_ky"),
                  *[F.col(c).alias(c + suffix[1] if c in common else c) for c in y.columns if c != by])
    known = xs.where(F.col("_kx").isNotNull()).join(ys.where(F.col("_ky").isNotNull()), F.col("_kx") == F.col("_ky"), "full")
    xn, yn = xs.where(F.col("_kx").isNull()), ys.where(F.col("_ky").isNull())
    left = xn.join(yn, F.col("_kx").eqNullSafe(F.col("_ky")), "left")
    none = xn.select(F.col("_kx").alias("_kk")).distinct()
    right_only = yn.join(none, F.col("_ky").eqNullSafe(F.col("_kk")), "left_anti")
    j = known.unionByName(left).unionByName(right_only, allowMissingColumns=True)
    rest = [c for c in xs.columns if c != "_kx"] + [c for c in ys.columns if c != "_ky"]
    return j.select(F.coalesce(F.col("_kx"), F.col("_ky")).alias(by), *rest)


#: Column of a row's place in its input; ``_x`` and ``_y`` after a full join.
POSITION = "position"


def scan_position() -> F.Column:
    """Place of a row in the files of a Parquet scan: file, then row; to be selected from the scan itself."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(POSITION)


def joined_position(df: DataFrame) -> DataFrame:
    """``position`` of a full join's rows from its sides': the rows of x in their order (matches of one row in the order of y), then
    the rows of y without a match in theirs."""
    x, y = F.col(f"{POSITION}_x"), F.col(f"{POSITION}_y")
    return df.withColumn(POSITION, F.struct(x.isNull().alias("only_y"), x.alias("x"), y.alias("y"))).drop(f"{POSITION}_x", f"{POSITION}_y")


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``distinct(key, .keep_all = TRUE)``: one row per key.

    "First" is the smallest row by ``order`` (then the remaining columns), NULLs first: ``[POSITION]`` is the order of the
    input, where the scan carried it. It is an aggregate
    (``min`` of a struct), so a hot key is combined map-side instead of being
    buffered in one window partition.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    fields = [*order, *rest]
    packed = F.min(F.struct(*[F.col(c) for c in fields])).alias("_r")
    return df.groupBy(key).agg(packed).select(key, *[F.col("_r")[c].alias(c) for c in fields]) \
             .select(*df.columns)
