"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matingstats.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Key of a row inside an operator; never returned.
ROW = "__matingstats_row"


def by_value(module: str) -> None:
    """Ship the functions of ``module`` inside the task, so that executors need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    Where text is plain ASCII, ``lower`` does the same and is much faster.
    """
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Only a local session may go without
    the setting; it gets a folder of its own."""
    base = ensure_checkpoint_dir(spark)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="checkpoint-")).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder in the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int, size: int | None = None):
    """Arrow batches of at most ``rows`` rows, and about ``size`` bytes, for jobs that run inside."""
    bounds = {_BATCH: str(rows)} | ({_BATCH_BYTES: str(size)} if size else {})
    before = {k: spark.conf.get(k, None) for k in bounds}
    for k, v in bounds.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def worker_state(name: str, key, make):
    """What ``make`` returns, kept by this Python process under ``name`` until another ``key`` is asked for: tasks that follow each other in a
    worker share it."""
    kept = sys.modules.setdefault("_matingstats_kept", types.ModuleType("_matingstats_kept")).__dict__
    if kept.get(name, (None,))[0] != key:
        kept[name] = key, make()
    return kept[name][1]


def release_memory() -> None:
    """Gives memory that is free in this Python process back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's Arrow batch to ``rows`` rows of text.

    Results are lazy, so their batches follow from the session when they run; executors hold several batches of each
    task outside of the heap.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= rows:
        spark.conf.set(_BATCH, str(rows))


def with_row_key(docs: DataFrame, id_col: str, *keep: str) -> DataFrame:
    """``docs`` with the columns ``keep`` and a unique long key ``ROW``.

    The id itself is the key where it is unique and never null (one cheap scan of that
    column). Otherwise the rows are numbered and stored, so that the numbers stay the same
    when tasks run again.
    """
    cols = [quoted(c) for c in dict.fromkeys([id_col, *keep])]
    if _is_key(docs, id_col):
        return docs.select(*cols, quoted(id_col).cast("long").alias(ROW))
    return stored(docs.select(*cols, F.monotonically_increasing_id().alias(ROW)), "rows")


def quoted(name: str) -> Column:
    """The column called ``name``, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _is_key(docs: DataFrame, id_col: str) -> bool:
    """Whether the column is a whole number, unique and never null: one cheap scan of it."""
    if dict(docs.dtypes)[id_col] not in ("bigint", "int", "smallint", "tinyint"):
        return False
    worst = (docs.groupBy(quoted(id_col).cast("long").alias("k")).count()
             .agg(F.max(F.col("count") + F.col("k").isNull().cast("long")).alias("m")).first()["m"])
    return worst is None or worst == 1


def with_whole_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``whole``, ``ROW``, ``id``, ``text``): all columns of ``docs`` in a struct, whatever they are called, the key of ``with_row_key``, and the two
    columns that operators work on; ``select("whole.*")`` gives the rows back."""
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("whole"))
    if _is_key(docs, id_col):
        rows = rows.withColumn(ROW, F.col("whole").getField(id_col).cast("long"))
    else:
        rows = stored(rows.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    return rows.select("whole", ROW, F.col("whole").getField(id_col).alias("id"), F.col("whole").getField(text_col).alias("text"))


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows: the check before every broadcast hint."""
    return df.limit(max_rows + 1).count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with further columns that are computed once a row.

    Catalyst copies a column's expression to where it is used, also into filters and into lambda functions, which run
    for each element. What a generator puts out stays a column.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def sql_string(s: str) -> str:
    """A SQL literal that Spark reads back as ``s``."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
