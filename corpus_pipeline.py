"""A corpus pipeline over ``documents``: toxicity, exact dedup, near dedup, decontamination, tokens.

Each stage works on all that the one before kept, and its decisions take effect. Every
stage but the last returns the columns of ``documents``; the last returns the tokens' digests.
Nulls, empty and repeated rows, ties and other columns are treated as the operators in
``matingstats.llm`` define; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matingstats.llm import decontaminate, queries, simhash_vp, stream_dedup, toxicity
from matingstats.llm.common import new_folder

#: Documents with at least this toxicity score are rejected.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the documents that are here and not held out; rejects toxic documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")  # a column of documents may be called like a result
    return toxicity.score(docs.select(whole, "text"), model).where(F.col("score") < TOXIC).select("document.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest id of each group of equal texts."""
    return stream_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of fingerprints within four bits."""
    return simhash_vp.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more are words of benchmark windows."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return queries.bpe_digests(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level bpe", tokenize),
]

#: A learnt model and a fingerprint hash have no SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; the result of each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = new_folder(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
