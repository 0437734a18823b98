"""Contingency tables from the labelled documents (second table family, FIXTURES §3).

The same tests that the pedigree tables use (T1, T4, T5) applied to another
pair of roles: a row factor (document language or quality grade) against a
0/1 outcome (toxic). Only ``doc_id`` and the factor are read from
``documents``, never the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matingstats.operators.chisq import chisq_test
from matingstats.operators.fisher import fisher_2x2, fisher_monte_carlo, fisher_rx2, monte_carlo_against_exact
from matingstats.operators.reshape import pivot_longer
from matingstats.sources.roles import table


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, quality, toxic) for every labelled document."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    docs = table(spark, sf_dir, "documents", "doc_id", "lang")
    return labels.join(docs, "doc_id", "inner")


def outcome_table(docs: DataFrame, by: str, outcome: str = "toxic") -> DataFrame:
    """Rows of ``by`` x (outcome = 1, outcome = 0) counts, tagged with the contrast name."""
    return (docs.groupBy(by)
                .agg(F.sum(F.when(F.col(outcome) == 1, 1).otherwise(0)).cast("bigint").alias("yes"),
                     F.sum(F.when(F.col(outcome) == 0, 1).otherwise(0)).cast("bigint").alias("no"))
                .withColumn("contrast", F.lit(f"{by}_x_{outcome}")))


def fisher_exact(docs: DataFrame, by: str) -> DataFrame:
    t = outcome_table(docs, by)
    return fisher_rx2(t, ["contrast"], by, "yes", "no")


def fisher_exact_2x2(docs: DataFrame, by: str) -> DataFrame:
    t = outcome_table(docs, by)
    return fisher_2x2(t, ["contrast"], by, "yes", "no")


def chisq(docs: DataFrame, by: str) -> DataFrame:
    t = outcome_table(docs, by)
    cells = pivot_longer(t, ["contrast", by], ["yes", "no"], "outcome", "n")
    return chisq_test(cells, by, "outcome", "n", groups=["contrast"])


def fisher_mc(docs: DataFrame, by: str, B: int = 100_000, seed: int = 20250101) -> DataFrame:
    t = outcome_table(docs, by)
    return fisher_monte_carlo(docs.sparkSession, t, "yes", "no", B=B, seed=seed)


def fisher_mc_exact(docs: DataFrame, by: str) -> DataFrame:
    return monte_carlo_against_exact(docs.sparkSession, outcome_table(docs, by), "yes", "no")
