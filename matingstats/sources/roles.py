"""Role views: the driver's parquet tables playing the pedigree roles.

The analysis needs three inputs and one dimension:

* ``master_raw``  (uid, sire, dam, yob, col_area) - master pedigree
* ``gen_parent``  (id, sire, dam)                  - parentage table
* ``gen_meta``    (uid, sire, dam, yrborn, col_area, sex) - genotype metadata
* ``places``      (col_area, valley)               - colony -> valley

The views follow FIXTURES.md section 3. The modulo predicates there plant the
missing values (NA sire, "N/A" year, NA colony) and the one-sided ids the
full join must keep. Every row of the source tables has at least one role.
Only the columns used are selected, so the parquet scans prune to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matingstats.functions.text import ID_PREFIX, NA_YEAR_TOKEN
from matingstats.operators.joins import POSITION, scan_position

UPPER = "Upper Valley"
LOWER = "Lower Valley"
OTHER = "Other"


# Types of the source columns the role views read. Reading with this schema
# skips footer-based schema inference at plan time and reads only these columns.
COLUMN_TYPES = {
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderdate": "timestamp_ntz",
               "o_orderpriority": "string"},
    "customer": {"c_custkey": "bigint", "c_nationkey": "int"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string"},
}


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str, position: bool = False) -> DataFrame:
    """The columns ``cols`` of a table (default: all); ``position``: with the rows' places in the input."""
    if position:
        return table(spark, sf_dir, name, *cols).select(*cols, scan_position())
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    types = COLUMN_TYPES.get(name, {})
    if cols and all(c in types for c in cols):
        ddl = ", ".join(f"{c} {types[c]}" for c in cols)
        return spark.read.schema(ddl).parquet(path)
    df = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def _kept(position: bool) -> list[str]:
    return [POSITION] if position else []


def master_raw(spark: SparkSession, sf_dir: str, position: bool = False) -> DataFrame:
    """Master pedigree: one row per offspring (an order), its sire (customer),
    dam (order priority), year of birth and colony (nation name, half padded)."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", position=position)
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(n, c.c_nationkey == n.n_nationkey))
    return j.select(
        F.col("o_orderkey").alias("uid"),
        F.when(F.col("o_orderkey") % 17 == 0, F.lit(None)).otherwise(F.col("o_custkey")).alias("sire"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("dam"),
        F.year("o_orderdate").cast("int").alias("yob"),
        _written_colony().alias("col_area"), *_kept(position),
    )


def _written_colony() -> F.Column:
    """The colony as the master pedigree has it: half of the names padded and in lower case."""
    return F.when(F.col("n_nationkey") % 2 == 0,
                  F.concat(F.lit("  "), F.lower("n_name"), F.lit(" "))).otherwise(F.col("n_name"))


def gen_parent(spark: SparkSession, sf_dir: str, position: bool = False) -> DataFrame:
    """Parentage table: prefixed offspring id, sire and dam."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", position=position)
    return e.where(F.col("event_id") % 10 != 0).select(
        F.concat(F.lit(ID_PREFIX), F.col("event_id").cast("string")).alias("id"),
        F.when(F.col("event_id") % 19 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("user_id").cast("string")).alias("sire"),
        F.nullif(F.col("event_type"), F.lit("error")).alias("dam"), *_kept(position),
    )


def gen_meta(spark: SparkSession, sf_dir: str, position: bool = False) -> DataFrame:
    """Genotype metadata: prefixed uid, empty parent columns, birth year as
    text ("N/A" and NULL included), colony code and sex. Ids that have no
    parentage row are all here, so every event is on one side at least."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", position=position)
    eid = F.col("event_id")
    return e.where((eid % 7 != 0) | (eid % 10 == 0)).select(
        F.concat(F.lit(ID_PREFIX), eid.cast("string")).alias("uid"),
        F.lit(None).cast("string").alias("sire"),
        F.lit(None).cast("string").alias("dam"),
        F.when(eid % 23 == 0, F.lit(NA_YEAR_TOKEN))
         .when(eid % 29 == 0, F.lit(None).cast("string"))
         .otherwise(F.dayofmonth("ts").cast("string")).alias("yrborn"),
        F.when(eid % 31 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("nation_"), (F.col("user_id") % 25).cast("string"))).alias("col_area"),
        F.when(eid % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("sex"), *_kept(position),
    )


def _valley_of_region() -> F.Column:
    return (F.when(F.col("n_regionkey").isin(0, 1), F.lit(UPPER))
            .otherwise(F.lit(LOWER)))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colony -> valley for the master data: 20 allowed colonies (region 4 is not one)."""
    n = table(spark, sf_dir, "nation", "n_name", "n_regionkey")
    return n.where(F.col("n_regionkey") != 4).select(
        F.lower("n_name").alias("col_area"), _valley_of_region().alias("valley"))


def places_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``places`` keyed by the colony text as written, which the first script's form compares unnormalised."""
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    return n.where(F.col("n_regionkey") != 4).select(_written_colony().alias("col_area"), _valley_of_region().alias("valley"))


def places_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colony -> valley for the small data, keyed by the colony code of ``gen_meta``."""
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    return n.where(F.col("n_regionkey") != 4).select(
        F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("col_area"),
        _valley_of_region().alias("valley"))


# The colony lists of the original study area, in their order.
UPPER_VALLEY_COLONIES = [
    "northpk", "mm_aspen", "picnic_upper", "picnic_middle", "picnic_lower",
    "boulder", "avalanche", "mm_maintalus",
]
LOWER_VALLEY_COLONIES = [
    "gothictown", "river_rivermound", "horsemound", "bench",
    "river_southmound", "river_sagemound", "river",
]


def study_places(spark: SparkSession) -> DataFrame:
    """The study's own colony -> valley dimension (15 rows)."""
    rows = [(c, UPPER) for c in UPPER_VALLEY_COLONIES] + [(c, LOWER) for c in LOWER_VALLEY_COLONIES]
    return spark.createDataFrame(rows, "col_area string, valley string")
