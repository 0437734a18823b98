"""Reshaping and set operators."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_wider(df: DataFrame, keys: Sequence[str], names_from: str, values_from: str,
                levels: Sequence[str], fill=0, cast: str | None = "bigint") -> DataFrame:
    """``pivot_wider(names_from, values_from, values_fill = fill)`` with a fixed level list.

    One aggregate with one conditional sum per level: no job to discover the
    levels, absent cells get ``fill`` (U3, P15), the key columns are not filled.
    """
    aggs = []
    for lvl in levels:
        v = F.sum(F.when(F.col(names_from) == lvl, F.col(values_from)))
        v = F.coalesce(v, F.lit(fill)) if fill is not None else v
        aggs.append((v.cast(cast) if cast else v).alias(lvl))
    return df.groupBy(*keys).agg(*aggs)


def pivot_longer(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
                 names_to: str, values_to: str) -> DataFrame:
    """``pivot_longer(cols, names_to, values_to)`` (NULL values are kept)."""
    return df.unpivot(list(ids), list(cols), names_to, values_to)


def uncount(df: DataFrame, weight: str, chunk: int = 65536) -> DataFrame:
    """``uncount(weight)``: repeat each row ``weight`` times, drop the weight.

    Rows with weight <= 0 or NULL give nothing. A large weight is first split
    into chunks of at most ``chunk`` rows, so no single array grows with the
    data; the chunk rows are spread over tasks before the inner explode.
    """
    w = F.col(weight).cast("bigint")
    keep = [c for c in df.columns if c != weight]
    chunks = (df.where(w > 0)
                .select(*keep, w.alias("_w"),
                        F.explode(F.sequence(F.lit(0).cast("bigint"),
                                             F.ceil(w / F.lit(chunk)).cast("bigint") - 1)).alias("_k")))
    # chunk rows of one heavy row are hashed apart, so its copies are made by many tasks
    chunks = chunks.repartition(*[F.col(c) for c in keep], F.col("_k"))
    size = F.least(F.lit(chunk).cast("bigint"), F.col("_w") - F.col("_k") * chunk)
    return (chunks.select(*keep, F.explode(F.array_repeat(F.lit(1), size.cast("int"))).alias("_one"))
                  .drop("_one"))


def bind_rows(*dfs: DataFrame) -> DataFrame:
    """``bind_rows``: union by name, missing columns NULL, a type clash is an error."""
    types: dict[str, str] = {}
    for d in dfs:
        for name, t in d.dtypes:
            if name in types and types[name] != t and "void" not in (types[name], t):
                raise TypeError(f"column {name!r} is {types[name]} in one input and {t} in another")
            types.setdefault(name, t)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def complete_cells(cells: DataFrame, keys: Sequence[str], level: str, levels: Sequence[str],
                   value: str = "n") -> DataFrame:
    """Long form zero-fill: every key row gets every level, absent cells 0."""
    wide = pivot_wider(cells, keys, level, value, levels)
    return pivot_longer(wide, keys, list(levels), level, value)


def non_integer_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column, the number of cells that are not plain digit strings."""
    from matingstats.functions.text import grepl
    return df.agg(*[F.sum(F.when(~grepl("^[0-9]+$", F.col(c)), 1).otherwise(0)).cast("bigint").alias(c)
                    for c in cols])
