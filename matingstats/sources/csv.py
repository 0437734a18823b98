"""CSV scan and sink of the original: header binding, missing values, column types, and the written format.

Scan. The original reads with ``read.csv(header=TRUE)``. Columns are bound by the names in each file's header, so files of one
folder may have them in any order; missing and surplus columns are reported (``header_report``) and raise or are let pass as
asked. The token ``NA`` is missing, a blank cell in a text column stays ``""``. Spark's reader turns blank (quoted or not)
into NULL and keeps ``NA`` as text, so every column is read as text and normalised afterwards:

* ``blank_as_null=False`` (faithful): ``NA`` -> NULL, blank -> ``""``
* ``blank_as_null=True``  (practical): both -> NULL

Types. ``typed`` gives columns the type that ``read.csv`` would: logical if every known cell is a truth value, else integer if
every one is a whole number, else double if every one is a number, else text. One aggregate over all columns decides; each type's test is an
"all cells" flag, which partial aggregates merge. In columns that are not text, blank cells are missing.

Sink. ``write_csv`` writes parts as they are; ``write_csv_file`` writes the bytes of ``write.csv(row.names = FALSE)`` into one file.
"""

from __future__ import annotations

import csv
import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matingstats.functions.text import NA_TEXT, as_integer, as_numeric, trimws

# The truth values of the original's reader.
TRUE_TEXT, FALSE_TEXT = ("T", "TRUE", "true"), ("F", "FALSE", "false")


# ------------------------------------------------------------------ header binding, S1-S3

def file_headers(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of ``path`` by their header's names (repeated names get .1, .2, ... as in the original).

    The first line of a file is its first line by position in the block that starts the file; an aggregate keeps one line per file. A
    file without a line has no columns.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    first = (lines.where("at = 0").select("file", "value", F.monotonically_increasing_id().alias("k"))
             .groupBy("file").agg(F.min_by("value", "k").alias("header")))
    out: dict[tuple[str, ...], list[str]] = {}
    for r in first.orderBy("file").collect():  # one line per file: the driver lists the files anyway
        out.setdefault(_names(r["header"]), []).append(r["file"])
    return out


def _names(header: str) -> tuple[str, ...]:
    seen: dict[str, int] = {}
    names = []
    for name in next(csv.reader([header.removeprefix("﻿").rstrip("\r")]), []):
        names.append(f"{name}.{seen[name]}" if name in seen else name)
        seen[name] = seen.get(name, 0) + 1
    return tuple(names)


def header_report(spark: SparkSession, path: str | list[str], columns: Sequence[str]) -> DataFrame:
    """(file, column, status): where files differ from ``columns``: missing, surplus, or moved (another position)."""
    rows = []
    for names, files in file_headers(spark, path).items():
        found = [(c, "missing") for c in columns if c not in names] + [(c, "surplus") for c in names if c not in columns]
        found += [(c, "moved") for k, c in enumerate(columns) if c in names and names.index(c) != k]
        rows += [(f, c, status) for f in files for c, status in found]
    return spark.createDataFrame(rows, "file string, column string, status string")


def read_pedigree_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str], blank_as_null: bool = False,
                      missing: str = "error", surplus: str = "drop") -> DataFrame:
    """The columns ``columns`` of header CSV files as text, bound by name, with the NA rule applied.

    ``missing``: "error", or "null" for a column that a file does not have; ``surplus``: "drop", or "error".
    """
    parts = []
    for names, files in file_headers(spark, path).items():
        lacking, extra = [c for c in columns if c not in names], [c for c in names if c not in columns]
        if lacking and missing == "error":
            raise ValueError(f"columns {lacking} are missing in {files[:3]}")
        if extra and surplus == "error":
            raise ValueError(f"columns {extra} are not expected in {files[:3]}")
        schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])
        df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(files)
        cells = [_cell(F.col(f"c{names.index(c)}"), blank_as_null) if c in names else F.lit(None).cast("string") for c in columns]
        parts.append(df.select(*[v.alias(c) for v, c in zip(cells, columns)]))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    out = parts[0]
    for p in parts[1:]:  # as many parts as different headers
        out = out.unionByName(p)
    return out


def _cell(v: Column, blank_as_null: bool) -> Column:
    if blank_as_null:
        return F.nullif(F.nullif(v, F.lit(NA_TEXT)), F.lit(""))
    return F.nullif(F.coalesce(v, F.lit("")), F.lit(NA_TEXT))


# ------------------------------------------------------------------ column types

def column_types(df: DataFrame) -> dict[str, str]:
    """logical, integer, double or text for each text column of ``df``, by one aggregate."""
    flags = []
    for k, c in enumerate(df.columns):
        v = F.col(f"`{c}`")
        blank = v.isNull() | (trimws(v) == "")
        number = as_numeric(v)
        flags += [F.bool_and(blank | v.isin(*TRUE_TEXT, *FALSE_TEXT)).alias(f"l{k}"),
                  F.bool_and(blank | (v.rlike(r"^[ \t\r\n]*[-+]?[0-9]+[ \t\r\n]*$") & as_integer(v).isNotNull())).alias(f"i{k}"),
                  F.bool_and(blank | number.isNotNull()).alias(f"d{k}")]
    r = df.agg(*flags).first()

    def kind(k: int) -> str:
        # an empty table has NULL flags: nothing speaks against logical
        return next((name for name, flag in (("logical", r[f"l{k}"]), ("integer", r[f"i{k}"]), ("double", r[f"d{k}"])) if flag is not False), "text")

    return {c: kind(k) for k, c in enumerate(df.columns)}


def typed(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """``df`` (text columns) with the types of ``column_types``, or given ones."""
    types = types or column_types(df)
    as_type = {"logical": lambda v: F.when(v.isin(*TRUE_TEXT), True).when(v.isin(*FALSE_TEXT), False),
               "integer": as_integer, "double": as_numeric, "text": lambda v: v}
    return df.select(*[as_type[types[c]](F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, **how) -> DataFrame:
    """``read.csv(path, header = TRUE)``: columns by name (default: those of the first file), typed."""
    if columns is None:
        columns = list(next(iter(file_headers(spark, path)), ()))
    return typed(read_pedigree_csv(spark, path, columns, **how))


# ------------------------------------------------------------------ sink, S4

def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A folder of parts with header, NULL written as ``NA``.

    Empty strings are quoted so they read back as ``""`` and not as NULL. Spark quotes other values only when
    needed; ``write_csv_file`` writes them as the original does.
    """
    (df.write.mode(mode)
       .option("header", True)
       .option("nullValue", NA_TEXT)
       .option("emptyValue", '""')
       .csv(path))
    return path


def number_text(c) -> Column:
    """A double as the original prints it: up to 15 significant digits, fixed or scientific, whichever is shorter (fixed on a tie)."""
    v = F.col(c) if isinstance(c, str) else c
    e = F.format_string("%.14e", F.abs(v))
    mantissa = F.regexp_replace(F.replace(F.regexp_extract(e, r"^(.*)e", 1), F.lit("."), F.lit("")), "0+$", "")
    mantissa = F.when(mantissa == "", "0").otherwise(mantissa)
    power = F.regexp_extract(e, r"e(.*)$", 1).try_cast("int")
    n = F.length(mantissa)
    scientific = F.concat(F.substring(mantissa, 1, 1), F.when(n > 1, F.concat(F.lit("."), mantissa.substr(F.lit(2), n - 1))).otherwise(""),
                          F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    scientific = F.when(F.abs(power) >= 100, F.concat(F.regexp_extract(scientific, r"^(.*e.)", 1), F.abs(power).cast("string"))).otherwise(scientific)
    # beyond 15 digits the fixed form shows the value itself; from 2^62 on it is a multiple of 512
    whole = F.when(F.abs(v) < 2.0**62, F.abs(v).try_cast("bigint").cast("string")).otherwise(
        ((F.abs(v) / 512).try_cast("bigint").cast("decimal(20,0)") * F.lit(512).cast("decimal(3,0)")).cast("string"))
    fixed = (F.when(power >= 15, F.when(power <= n + 4, whole).otherwise(F.repeat(F.lit("0"), 400)))
             .when(power >= n - 1, F.concat(mantissa, F.repeat(F.lit("0"), power - n + 1)))
             .when(power >= 0, F.concat(mantissa.substr(F.lit(1), power + 1), F.lit("."), mantissa.substr(power + 2, n)))
             .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), mantissa)))
    shorter = F.when(F.length(fixed) <= F.length(scientific), fixed).otherwise(scientific)
    sign = F.when(v < 0, "-").otherwise("")
    return (F.when(v.isNull(), None).when(F.isnan(v), "NaN").when(F.abs(v) == float("inf"), F.concat(sign, F.lit("Inf")))
            .when(v == 0.0, "0").otherwise(F.concat(sign, shorter)))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(df: DataFrame) -> Column:
    """A row of ``df`` as the original writes it: text quoted and its quotes doubled, TRUE / FALSE, numbers as printed, ``NA`` bare."""
    cells = []
    for f in df.schema.fields:
        v = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            t = F.upper(v.cast("string"))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            t = number_text(v.cast("double"))
        elif isinstance(f.dataType, T.NumericType):
            t = v.cast("string")
        else:
            t = _quoted(v.cast("string"))
        cells.append(F.coalesce(t, F.lit(NA_TEXT)))
    return F.concat_ws(",", *cells)


def write_csv_file(df: DataFrame, path: str, order_by: Sequence[str | Column] = ()) -> str:
    """``write.csv(df, path, row.names = FALSE)``: the file ``path``, rows by ``order_by`` (ascending, NULL last), equal ones in the order of ``df``.

    Rows are formatted by all tasks; one task sorts (it spills) and writes them into a folder beside the target, whose only part is
    then renamed. An existing file is replaced.
    """
    spark = df.sparkSession
    keys = [(F.col(f"`{c}`") if isinstance(c, str) else c).alias(f"k{n}") for n, c in enumerate(order_by)]
    header = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    folder = f"{path}.{uuid.uuid4().hex}"
    lines = df.select(F.lit(1).alias("part"), *keys, F.monotonically_increasing_id().alias("at"), csv_lines(df).alias("value"))
    top = spark.range(1).select(F.lit(0).alias("part"), F.lit(header).alias("value"))
    order = ["part", *[F.asc_nulls_last(f"k{n}") for n in range(len(keys))], "at"]
    lines.unionByName(top, allowMissingColumns=True).repartition(1).sortWithinPartitions(*order).select("value").write.text(folder)
    jvm = spark._jvm.org.apache.hadoop.fs
    source, target = jvm.Path(folder), jvm.Path(path)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = [s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")]
    fs.delete(target, False)
    if len(part) != 1 or not fs.rename(part[0], target):
        raise OSError(f"{path} could not be written")
    fs.delete(source, True)
    return path
