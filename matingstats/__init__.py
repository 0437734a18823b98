"""matingstats: pedigree and mating-strategy analytics on Spark.

Parentage tables (offspring, sire, dam, year, place) are cleaned under explicit
missing-value rules, every (sire, year) is classified as monogamous or
polygynous, offspring and sires are counted by year, colony and valley, and the
counts are tested (chi-square, Fisher, rank-sum, logistic and mixed logistic).

All row-level work is DataFrame aggregation, joins and windows; statistics are
column expressions or grouped jobs on the reduced counts.
"""

from matingstats.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
