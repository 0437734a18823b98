"""Plan guards: the shapes that keep the catalogue scalable (checked on the optimised plans)."""

import re

import pytest

from matingstats.plans.catalog import queries
from tests.conftest import SF_SMALL

# queries that join a one-row total to a reduced table
ONE_ROW = {"chisq_lang_toxic", "chisq_year", "chisq_valley", "chisq_residuals", "chisq_master", "master_residuals"}
# model fits return a tiny result frame; their work happens while fitting
MODELS = {"logit_year", "logit_year_small", "logit_deviance", "logit_summary", "mixed_logit", "mixed_logit_refined"}


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for name, fn in queries().items():
        if name in MODELS or name.startswith(("csv_", "fisher_colony_mc", "fisher_mc_")):
            continue
        out[name] = physical(fn(spark, SF_SMALL))
    return out


def test_no_nested_loop_or_cartesian_joins(plans):
    bad = [n for n, p in plans.items() if re.search(r"BroadcastNestedLoopJoin|CartesianProduct", p)]
    assert set(bad) <= ONE_ROW


def test_no_python_in_plans(plans):
    for name, p in plans.items():
        assert not re.search(r"FlatMapGroupsInPandas|MapInPandas|ArrowEvalPython|BatchEvalPython", p), name


def test_full_join_shuffles_each_side_once(spark):
    from matingstats.plans.catalog import Inputs
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = physical(Inputs(spark, SF_SMALL).merged)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    known = p[:p.index("LeftOuter")]  # the branch of known keys stands first
    assert known.count("FullOuter") == 1 and known.count("Exchange hashpartitioning") <= 3


def test_labels_never_window_over_raw_rows(plans):
    # (sire, year) labels are aggregates; windows appear only over reduced tables
    for name in ["master_polygynous", "master_monogamous", "offspring_by_year", "master_level",
                 "sire_classification", "valley_types_independent", "colony_types_master"]:
        assert "Window" not in plans[name], name


def test_window_over_colony_preaggregate_only(plans):
    # The (sire, yob) window runs on rows already aggregated per colony
    p = plans["colony_year_counts"]
    window_at = p.index("Window")
    assert re.search(r"(Hash|Sort)Aggregate\(key=\[sire#\d+L?, yob#\d+, col_area", p[window_at:]), \
        "window must sit above the per-colony aggregate"


def test_scans_read_only_used_columns(plans):
    p = plans["master_level"]
    orders = re.search(r"FileScan parquet [^\[]*\[([^\]]*)\][^\n]*orders\.parquet", p)
    cols = {re.sub(r"#\d+L?", "", c.strip()) for c in orders.group(1).split(",")}
    assert cols == {"o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"}
    assert "o_totalprice" not in p and "c_acctbal" not in p


def test_no_collect_list_or_collect_set_on_raw_rows(plans):
    for name in ["master_polygynous", "colony_types_master", "offspring_strategy", "merge_pedigree"]:
        assert not re.search(r"collect_(list|set)", plans[name]), name
