"""Operator 7: exact deduplication by a stateful stream.

Every row of the table becomes an event (digest, row, identifier, file) of an ingest log in the shared
folder. A Structured Streaming query reads the log in bounded micro-batches and keeps, for each
digest and without expiry, the identifier and content locator of the row that stays and the
size of the group. The state lives in RocksDB on the executors' disks with its checkpoints in
the shared folder, so a lost executor's part is restored. Events are pre-aggregated in every map task
before they are shuffled: a digest with a third of all rows costs one row per task.

When the log is read to its end the state is joined back to the events. Groups of more than one
row are hits; the full texts of their rows are compared, as the smallest and largest text of the digest
(equal only if all are), and digests whose texts differ are split by the text itself.

Texts are equal when identical after A-Z are lower-cased. Defined results: null text counts as empty; a null identifier
is smaller than any other; of rows equal in text and identifier one stays (the one with the largest
row key); every row gives one row, also repeated ones; an empty table gives an empty result; other columns are ignored by
``decisions`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matingstats.llm.common import ROW, ascii_lower, maybe_broadcast, new_folder, small_enough, stored, with_row_key, with_whole_rows

#: State on disk; no space allocated ahead for each of many small stores.
_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
          "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def _normal(text_col: str):
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def digest_state(log: DataFrame, checkpoint: str) -> DataFrame:
    """Runs the stream ``log`` (digest, id, ROW, file) to its end; returns its state (digest, n, keep).

    ``keep`` is the locator (id, ROW, file) of the row that stays. The state in ``checkpoint`` outlives
    the query: a later run with the same folder goes on from it.
    """
    spark = log.sparkSession
    groups = log.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", ROW, "file")).alias("keep"))
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        query = (groups.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
                 .option("checkpointLocation", checkpoint).start())
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        kept = [f.name for f in state.schema["value"].dataType.fields]  # count, then maximum
        return stored(state.select(F.col("key.digest").alias("digest"), F.col("value")[kept[0]].alias("n"),
                                   F.col("value")[kept[1]].alias("keep")), "state")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _row_decisions(keyed: DataFrame, id_col: str, text_col: str, digest_chars: int, batch_bytes: int, max_broadcast: int) -> DataFrame:
    """(ROW, id, sha, keep, n) of every row of ``keyed``."""
    spark = keyed.sparkSession
    norm = _normal(text_col)
    with_sha = keyed.select(ROW, F.col(id_col).alias("id"), F.sha2(norm, 256).alias("sha"), F.input_file_name().alias("file"))
    events = with_sha.withColumn("digest", F.expr(f"left(sha, {digest_chars})"))
    folder = new_folder(spark, "ingest")
    events.write.parquet(folder)
    events = spark.read.schema(events.schema).parquet(folder)
    if events.isEmpty():
        return events.select(ROW, "id", "sha", F.struct("id", ROW, "file").alias("keep"), F.lit(0).cast("long").alias("n"))
    log = spark.readStream.schema(events.schema).option("maxBytesPerTrigger", batch_bytes).parquet(folder)
    state = digest_state(log, new_folder(spark, "dedup-state"))

    hits = state.where("n > 1").select("digest")
    texts = keyed.select(ROW, F.col(id_col).alias("id"), norm.alias("norm")).withColumn("digest", F.expr(f"left(sha2(norm, 256), {digest_chars})"))
    texts = texts.join(maybe_broadcast(hits, max_broadcast), "digest", "left_semi")
    differ = stored(texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a != b").select("digest"), "differ")
    whole = events.join(state, "digest")
    if not differ.isEmpty():  # one digest, several texts: the text itself is the key
        parts = texts.join(differ, "digest", "left_semi").join(events.select(ROW, "sha", "file"), ROW)
        split = parts.groupBy("digest", "norm").agg(F.count("*").alias("n"), F.max(F.struct("id", ROW, "file")).alias("keep"))
        whole = whole.join(differ, "digest", "left_anti").select(ROW, "id", "sha", "keep", "n").unionByName(
            parts.join(split, ["digest", "norm"]).select(ROW, "id", "sha", "keep", "n"))
    return whole.select(ROW, "id", "sha", "keep", "n")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_chars: int = 64,
              batch_bytes: int = 1 << 30, max_broadcast: int = 200_000) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256.

    ``digest_chars``: hexadecimal digits of SHA-256 in the digest. ``batch_bytes``: bound of a micro-batch
    of the ingest log. ``max_broadcast``: hit digests that may be broadcast; beyond it the text join shuffles.
    """
    found = _row_decisions(with_row_key(docs, id_col, text_col), id_col, text_col, digest_chars, batch_bytes, max_broadcast)
    return found.select(F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
                        (F.col("keep")[ROW] == F.col(ROW)).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 1_000_000, **how) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay."""
    keyed = with_whole_rows(docs, id_col, text_col)
    how = {"digest_chars": 64, "batch_bytes": 1 << 30} | how
    found = _row_decisions(keyed, "id", "text", max_broadcast=200_000, **how)
    dropped = stored(found.where(F.col("keep")[ROW] != F.col(ROW)).select(ROW), "dropped")
    if small_enough(dropped, max_broadcast):
        dropped = F.broadcast(dropped)
    return keyed.join(dropped, ROW, "left_anti").select("whole.*")
