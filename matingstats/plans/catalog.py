"""The query catalogue: one callable per dataset / operator, each with its oracle SQL.

``queries()`` maps a name to ``f(spark, sf_dir) -> DataFrame``; ``oracle_sql()``
maps the same name to the DuckDB statement computing the same table from the
same parquet files. Queries without SQL (the Monte-Carlo test and the mixed
model) are checked on rows only; the logistic fits have IRLS as a recursive CTE. Column names and types agree on both sides: counts bigint,
doubles rounded to 6 places.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matingstats.functions.text import as_integer
from matingstats.operators.glm import analysis_of_deviance, logistic_by_counts, model_summary
from matingstats.operators.glmm import random_intercept_logit_counts
from matingstats.plans import contingency as CT
from matingstats.plans import master as M
from matingstats.plans import mixed as X
from matingstats.plans import oracle as O
from matingstats.plans import small as S
from matingstats.session import reliable_checkpoint, remove_dir, shared_dir
from matingstats.sources import roles
from matingstats.sources.csv import read_pedigree_csv, write_csv


class Inputs:
    """Role frames of one data directory, each built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def master(self) -> DataFrame:
        return roles.master_raw(self.spark, self.sf_dir)

    @cached_property
    def parent(self) -> DataFrame:
        return roles.gen_parent(self.spark, self.sf_dir)

    @cached_property
    def meta(self) -> DataFrame:
        return roles.gen_meta(self.spark, self.sf_dir)

    @cached_property
    def places(self) -> DataFrame:
        return roles.places(self.spark, self.sf_dir)

    @cached_property
    def places_written(self) -> DataFrame:
        return roles.places_written(self.spark, self.sf_dir)

    @cached_property
    def places_small(self) -> DataFrame:
        return roles.places_small(self.spark, self.sf_dir)

    @cached_property
    def docs(self) -> DataFrame:
        return CT.labelled_docs(self.spark, self.sf_dir)

    @cached_property
    def merged(self) -> DataFrame:
        return S.merged_ped(self.parent, self.meta)

    @cached_property
    def clean(self) -> DataFrame:
        return S.clean_offspring(self.merged)

    @cached_property
    def clean_placed(self) -> DataFrame:
        """D4 with the rows' position in the input."""
        return S.clean_offspring(S.merged_ped(roles.gen_parent(self.spark, self.sf_dir, position=True), roles.gen_meta(self.spark, self.sf_dir, position=True)))

    def types_small(self, mode: str = "independent") -> DataFrame:
        return S.valley_types(self.merged, self.places_small, mode)

    def types_master(self, form: str = "refined", mode: str = "independent") -> DataFrame:
        places = self.places_written if form == "analysis" else self.places
        return M.colony_types_master(self.master, places, form, mode)

    def wide_small(self) -> DataFrame:
        return reliable_checkpoint(S.year_valley_wide(self.types_small()))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (the oracle does the same)."""
    return df.select(*[F.round(F.col(f.name), places).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def _q(fn: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(fn(Inputs(spark, sf_dir)))
    run.__doc__ = fn.__doc__
    return run


def _through_csv(i: Inputs, df: DataFrame) -> DataFrame:
    """``df`` written as CSV (NA for NULL) and read back; the written folder is removed."""
    path = shared_dir(i.spark, "csv", uuid.uuid4().hex)
    write_csv(df, path)
    back = reliable_checkpoint(read_pedigree_csv(i.spark, path, df.columns))
    remove_dir(i.spark, path)
    return back


def _csv_round_trip(i: Inputs) -> DataFrame:
    """D3 through CSV."""
    return _through_csv(i, i.merged)


def _csv_small_chain(i: Inputs) -> DataFrame:
    """The cleaned small data set from CSV files of its two inputs."""
    return S.clean_offspring(S.merged_ped(_through_csv(i, i.parent), _through_csv(i, i.meta)))


def _csv_master_level(i: Inputs) -> DataFrame:
    """The mating-level table from a CSV file of the master pedigree."""
    m = _through_csv(i, i.master).withColumn("yob", as_integer("yob")).withColumn("sire", F.col("sire").cast("bigint"))
    return M.master_level(m)


def _logit(i: Inputs, which: str) -> DataFrame:
    if which == "master":
        return logistic_by_counts(M.master_level(i.master), "yob", "strategy_bin")
    return logistic_by_counts(S.sire_level_mating(i.merged), "yrborn", "strategy_bin")


def _deviance(i: Inputs) -> DataFrame:
    a = analysis_of_deviance(M.master_level(i.master), "yob", "strategy_bin").withColumn("dataset", F.lit("master"))
    b = analysis_of_deviance(S.sire_level_mating(i.merged), "yrborn", "strategy_bin") \
        .withColumn("dataset", F.lit("small"))
    return a.unionByName(b)


def _logit_summary(i: Inputs) -> DataFrame:
    """Deviances, degrees of freedom and AIC of both fits."""
    a = model_summary(M.master_level(i.master), "yob", "strategy_bin").withColumn("dataset", F.lit("master"))
    b = model_summary(S.sire_level_mating(i.merged), "yrborn", "strategy_bin").withColumn("dataset", F.lit("small"))
    return a.unionByName(b)


def _mixed_logit(i: Inputs, form: str = "analysis") -> DataFrame:
    """T9 on D39: fitted from the (yob, valley) counts of D35 - the sufficient
    statistics of the one-row-per-offspring table, which is never built."""
    wide = M.valley_year_wide(i.types_master(form))
    counts = wide.select("yob", "valley", (F.col("Monogamous") + F.col("Polygynous")).alias("trials"),
                         F.col("Polygynous").alias("successes"))
    fit = random_intercept_logit_counts(counts, "yob", "valley", "trials", "successes")
    # the steps are this optimiser's own; a search ends within 1e-6 of the maximum, so four places are certain
    return rounded(fit.where("term != 'steps to convergence'"), 4).withColumn("z_value", F.round("z_value", 1))


_QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    # small data set
    "parent_new": lambda i: S.parent_new(i.parent),
    "small_ped": lambda i: S.small_ped(i.meta),
    "merge_pedigree": lambda i: i.merged,
    "clean_offspring": lambda i: i.clean,
    "unique_matings": lambda i: S.unique_matings(i.merged),
    "sire_dam_year": lambda i: S.sire_dam_year(i.merged),
    "sire_classification": lambda i: S.sire_classification(i.merged),
    "polygynous_sires": lambda i: S.polygynous_sires(i.merged),
    "monogamous_sires": lambda i: S.monogamous_sires(i.merged),
    "sire_strategy_again": lambda i: S.sire_strategy_again(i.clean),
    "summary_clean": lambda i: S.summary_clean(i.merged),
    "offspring_strategy": lambda i: S.offspring_strategy(i.clean_placed),
    "first_offspring": lambda i: M.first_offspring(roles.master_raw(i.spark, i.sf_dir, position=True)),
    "colony_summary": lambda i: S.colony_summary(i.clean),
    "valley_types_independent": lambda i: i.types_small("independent"),
    "valley_types_pair": lambda i: i.types_small("pair"),
    "valley_summary": lambda i: S.valley_summary(i.types_small()),
    "valley_year_summary": lambda i: S.valley_year_summary(i.types_small()),
    "sire_level_offspring": lambda i: S.sire_level_offspring(i.merged),
    "sire_level_mating": lambda i: S.sire_level_mating(i.merged),
    "pairings_by_year": lambda i: S.pairings_by_year(i.merged),
    "pairings_wide": lambda i: S.pairings_wide(i.merged),
    "chisq_year": lambda i: S.chisq_year(i.merged),
    "valley_table": lambda i: S.valley_table(i.types_small()),
    "chisq_valley": lambda i: S.chisq_valley(i.types_small()),
    "chisq_residuals": lambda i: S.chisq_valley_residuals(i.types_small()),
    "year_valley_table": lambda i: S.year_valley_wide(i.types_small()),
    "fisher_year_2x2": lambda i: S.fisher_by_year(i.wide_small(), exact_rx2=False),
    "fisher_year_rx2": lambda i: S.fisher_by_year(i.wide_small(), exact_rx2=True),
    "valid_fisher": lambda i: S.valid_fisher(i.wide_small()),
    "final_table": lambda i: S.final_table(i.types_small()),
    "rank_sum_small": lambda i: S.rank_sum_small(i.types_small()),
    # master data set
    "master_polygynous": lambda i: M.master_polygynous(i.master),
    "master_monogamous": lambda i: M.master_monogamous(i.master),
    "offspring_by_year": lambda i: M.offspring_by_year(i.master),
    "year_shares": lambda i: M.year_shares(i.master),
    "year_table_master": lambda i: M.year_table(i.master),
    "chisq_master": lambda i: M.chisq_master(i.master),
    "master_residuals": lambda i: M.master_residuals(i.master),
    "master_level": lambda i: M.master_level(i.master),
    "master_level_counts": lambda i: M.master_level_counts(i.master),
    "fixed_master_ped": lambda i: M.fixed_master_ped(i.master),
    "fixed_master_ped_analysis": lambda i: M.fixed_master_ped(i.master, form="analysis"),
    "colony_list": lambda i: M.colony_list(i.master),
    "colony_types_master": lambda i: i.types_master(),
    "colony_year_counts": lambda i: M.colony_year_counts(i.master),
    "colony_year_number": lambda i: M.colony_year_number(i.master),
    "colony_list_analysis": lambda i: M.colony_list(i.master, form="analysis"),
    "colony_year_counts_analysis": lambda i: M.colony_year_counts(i.master, form="analysis"),
    "colony_year_number_analysis": lambda i: M.colony_year_number(i.master, form="analysis"),
    "colony_table": lambda i: M.colony_table(i.master),
    "valley_master": lambda i: M.valley_master(i.types_master()),
    "valley_year_master": lambda i: M.valley_year_master(i.types_master()),
    "rank_sum_master": lambda i: M.rank_sum_master(i.types_master()),
    "colony_types_master_analysis": lambda i: i.types_master("analysis"),
    "valley_master_analysis": lambda i: M.valley_master(i.types_master("analysis")),
    "valley_year_master_analysis": lambda i: M.valley_year_master(i.types_master("analysis")),
    "colony_table_analysis": lambda i: M.colony_table(i.master, form="analysis"),
    # D36-D39 are steps of the first script: its form is the default
    "int_audit": lambda i: M.int_audit(i.types_master("analysis")),
    "int_audit_refined": lambda i: M.int_audit(i.types_master()),
    "fisher_per_year": lambda i: M.fisher_per_year(i.types_master("analysis")),
    "fisher_per_year_refined": lambda i: M.fisher_per_year(i.types_master()),
    "fisher_colony_mc": lambda i: M.fisher_colony_mc(i.master),
    "fisher_colony_mc_refined": lambda i: M.fisher_colony_mc(i.master, form="refined"),
    "fisher_mc_estimates": lambda i: CT.fisher_mc(i.docs, "lang"),
    "long_offspring": lambda i: M.long_offspring(i.types_master("analysis")),
    "long_offspring_refined": lambda i: M.long_offspring(i.types_master()),
    "logit_year": lambda i: _logit(i, "master"),
    "logit_year_small": lambda i: _logit(i, "small"),
    "logit_deviance": _deviance,
    "logit_summary": _logit_summary,
    "mixed_logit": _mixed_logit,
    "mixed_logit_refined": lambda i: _mixed_logit(i, "refined"),
    # both data sets
    "mixed_years": lambda i: X.mixed_years(i.merged, i.master),
    "mixed_sires": lambda i: X.mixed_sires(i.merged, i.master),
    "mixed_year_counts": lambda i: X.mixed_year_counts(i.merged, i.master),
    "mixed_valleys": lambda i: X.mixed_valleys(i.types_small(), i.types_master()),
    "mixed_colonies": lambda i: X.mixed_colonies(i.clean, i.master),
    "plot_fill": lambda i: X.plot_fill(i.types_master()),
    "plot_stack": lambda i: X.plot_stack(i.types_small(), i.types_master()),
    "plot_fill_valley_year_small": lambda i: X.plot_fill_valley_year_small(i.types_small()),
    "plot_fill_pairings": lambda i: X.plot_fill_pairings(i.merged),
    "plot_stack_years": lambda i: X.plot_stack_years(i.merged, i.master),
    "plot_stack_sires": lambda i: X.plot_stack_sires(i.merged, i.master),
    "plot_stack_colonies": lambda i: X.plot_stack_colonies(i.clean, i.master),
    # the same tests on the labelled documents (FIXTURES §3 second table family)
    "toxic_by_lang": lambda i: CT.outcome_table(i.docs, "lang"),
    "chisq_lang_toxic": lambda i: CT.chisq(i.docs, "lang"),
    "fisher_lang_toxic": lambda i: CT.fisher_exact(i.docs, "lang"),
    "fisher_quality_toxic": lambda i: CT.fisher_exact_2x2(i.docs, "quality"),
    "fisher_mc_lang_toxic": lambda i: CT.fisher_mc_exact(i.docs, "lang"),
    # source / sink
    "csv_round_trip": _csv_round_trip,
    "csv_small_chain": _csv_small_chain,
    "csv_master_level": _csv_master_level,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _q(v) for k, v in _QUERIES.items()}


# ------------------------------------------------------------------ oracle SQL

def _sql() -> dict[str, str]:
    b = O.build
    q: dict[str, str] = {}
    q["parent_new"] = b("select * from parent_new")
    q["small_ped"] = b("select * from small_ped")
    q["sire_strategy_again"] = b("select * from ssa")
    q["summary_clean"] = b("select sire_x, yrborn, cast(coalesce(n_dams, 0) as double) as n_dams, strategy from cls")
    q["fixed_master_ped"] = b("select * from fixed")
    q["fixed_master_ped_analysis"] = b("select * from fixed_a")
    q["merge_pedigree"] = b("select * from merged")
    q["clean_offspring"] = b("select * from clean")
    q["unique_matings"] = b("select * from unique_matings")
    q["sire_dam_year"] = b("select * from sdy")
    q["sire_classification"] = b("select * from cls")
    q["polygynous_sires"] = b("select * from cls where strategy = 'Polygynous'")
    q["monogamous_sires"] = b("select * from cls where strategy = 'Monogamous'")
    q["offspring_strategy"] = b("""
select uid, dam, sire, yrborn, col_area, strategy from (
  select c.uid, c.dam, c.sire, c.yrborn, c.col_area, s.strategy,
         row_number() over (partition by c.uid order by case when e.event_id % 10 = 0 then 1 else 0 end, e.place) as rn
  from clean c join ssa s on c.sire = s.sire and c.yrborn = s.yrborn
  join (select event_id, row_number() over () as place from events) e on c.uid = cast(e.event_id as varchar)) where rn = 1""")
    q["first_offspring"] = b("""
select uid, sire, dam, yob, col_area from (
  select m.*, row_number() over (partition by sire order by place) as rn
  from master_raw m join (select o_orderkey, row_number() over () as place from orders) o on m.uid = o.o_orderkey where sire is not null) where rn = 1""")
    q["colony_summary"] = b("select col_area, strategy, count(*) as n_individuals from os group by col_area, strategy")
    q["valley_types_independent"] = b("select * from types_small")
    q["valley_types_pair"] = b("select * from vt_pair")
    q["valley_summary"] = b("select * from vs")
    q["valley_year_summary"] = b(
        "select valley, yrborn, strategy, count(*) as n_individuals from types_small group by valley, yrborn, strategy")
    q["sire_level_offspring"] = b(f"""
select sire_x, yr as yrborn, count(*) as n_dams,
       case when count(*) > 1 then 'Polygynous' else 'Monogamous' end as strategy,
       case when count(*) > 1 then 1 else 0 end as strategy_num
from (select sire_x, try_cast(nullif(nullif({O.trimws('yrborn')}, 'N/A'), '') as double) as yr from unique_matings)
where yr is not null group by sire_x, yr""")
    q["sire_level_mating"] = b("select * from sl_mating")
    q["pairings_by_year"] = b("select * from pby")
    q["pairings_wide"] = b("""
select yrborn, cast(coalesce(sum(case when strategy = 'Monogamous' then n_dams end), 0) as bigint) as Monogamous,
       cast(coalesce(sum(case when strategy = 'Polygynous' then n_dams end), 0) as bigint) as Polygynous
from pby group by yrborn""")
    pw = {"pw": """
  select yrborn, cast(coalesce(sum(case when strategy = 'Monogamous' then n_dams end), 0) as bigint) as Monogamous,
         cast(coalesce(sum(case when strategy = 'Polygynous' then n_dams end), 0) as bigint) as Polygynous
  from pby group by yrborn""", "pw_long": O.long_cells("pw", "yrborn")}
    q["chisq_year"] = b(O.chisq_sql("pw_long", "yrborn", "strategy", "n"), pw)
    vw = {"vw": """
  select valley, cast(coalesce(sum(case when strategy = 'Monogamous' then n_individuals end), 0) as bigint) as Monogamous,
         cast(coalesce(sum(case when strategy = 'Polygynous' then n_individuals end), 0) as bigint) as Polygynous
  from vs group by valley""", "vw_long": O.long_cells("vw", "valley")}
    q["valley_table"] = b("select * from vw", vw)
    q["chisq_valley"] = b(O.chisq_sql("vw_long", "valley", "strategy", "n"), vw)
    q["chisq_residuals"] = b(O.chisq_sql("vw_long", "valley", "strategy", "n", residuals=True), vw)
    q["year_valley_table"] = b("select * from yv_wide")
    f2 = O.fisher_2x2_sql("a", "b", "c", "d")
    q["fisher_year_2x2"] = b(f"""
select yrborn, case when n_rows > 1 then round({f2}, 6) end as p_value from (
  select yrborn, count(*) as n_rows,
         arg_min(Polygynous, valley) as a, arg_min(Monogamous, valley) as b,
         arg_max(Polygynous, valley) as c, arg_max(Monogamous, valley) as d
  from yv_wide where valley <> 'Other' group by yrborn)""")
    rx = O.fisher_rx3_sql("yv_wide", "yrborn", "valley", "Polygynous", "Monogamous")
    fy = {"fy": f"""
  select * from ({rx}
  select t.g as yrborn, case when t.nrows > 1 then p.p end as p_value from t left join p on t.g = p.g)"""}
    q["fisher_year_rx2"] = b("select yrborn, round(p_value, 6) as p_value from fy", fy)
    q["valid_fisher"] = b("select yrborn, round(p_value, 6) as p_value from fy "
                          "where p_value is not null and not isnan(p_value)", fy)
    q["final_table"] = b("""
select w.yrborn, w.valley, w.Monogamous, w.Polygynous,
       case when w.Polygynous > w.Monogamous then 'Polygynous'
            when w.Monogamous > w.Polygynous then 'Monogamous' else 'Tie' end as dominant_strategy,
       round(f.p_value, 6) as p_value,
       case when f.p_value is null or isnan(f.p_value) then null when f.p_value < 0.05 then 'Yes' else 'No' end
         as significant
from yv_wide w left join fy f on w.yrborn = f.yrborn""", fy)
    q["rank_sum_small"] = b("select * from (" + O.rank_sum_sql("svs", "valley", "strategy", "n_individuals") + ")", {
        "svs": """
  select valley, yr as yrborn, strategy, count(*) as n_individuals
  from (select valley, strategy, try_cast(yrborn as double) as yr from types_small
        where strategy is not null and valley is not null and valley <> 'Other')
  where yr is not null group by valley, yr, strategy"""})

    # master
    q["master_polygynous"] = b("""
select m.uid, m.sire, m.dam, m.yob, m.col_area from m_known m
join m_groups g on m.sire = g.sire and m.yob = g.yob where g.strategy = 'Polygynous'""")
    q["master_monogamous"] = b("""
select m.uid, m.sire, m.dam, m.yob, m.col_area from m_known m
join m_groups g on m.sire = g.sire and m.yob = g.yob where g.strategy = 'Monogamous'""")
    q["offspring_by_year"] = b("select * from combined_counts")
    q["year_shares"] = b("select yob, count, type, round(count / sum(count) over (partition by yob), 6) as prop "
                         "from combined_counts")
    yw = {"yw": """
  select yob, cast(coalesce(sum(case when type = 'Monogamous' then count end), 0) as bigint) as Monogamous,
         cast(coalesce(sum(case when type = 'Polygynous' then count end), 0) as bigint) as Polygynous
  from combined_counts group by yob""", "yw_long": O.long_cells("yw", "yob")}
    q["year_table_master"] = b("select * from yw", yw)
    q["chisq_master"] = b(O.chisq_sql("yw_long", "yob", "strategy", "n"), yw)
    q["master_residuals"] = b(
        "select yob, strategy as type, observed, expected, stdres from ("
        + O.chisq_sql("yw_long", "yob", "strategy", "n", residuals=True) + ")", yw)
    q["master_level"] = b("select * from master_level")
    q["master_level_counts"] = b("select yob, strategy, count(*) as n_pairs from master_level group by yob, strategy")
    q["colony_list"] = b(f"select distinct {O.trimws('lower(col_area)')} as col_area from fixed")
    q["colony_types_master"] = b("select dam, sire, yob, col_area, strategy, valley from types_master")
    q["colony_year_counts"] = b("select * from ccm")
    q["colony_year_number"] = b("select * from scm")
    q["colony_table"] = b("""
select col_area, cast(coalesce(sum(case when strategy = 'Monogamous' then n_individuals end), 0) as bigint) as Monogamous,
       cast(coalesce(sum(case when strategy = 'Polygynous' then n_individuals end), 0) as bigint) as Polygynous
from scm group by col_area""")
    q["colony_list_analysis"] = b(f"select distinct {O.trimws('lower(col_area)')} as col_area from fixed_a")
    q["colony_year_counts_analysis"] = b("select * from ccm_a")
    q["colony_year_number_analysis"] = b("select * from scm_a")
    q["colony_types_master_analysis"] = b("select dam, sire, yob, col_area, strategy, valley from types_a")
    q["valley_master_analysis"] = b("select * from svm_a")
    q["valley_year_master_analysis"] = b("select * from svym_a")
    q["colony_table_analysis"] = b("""
select col_area, cast(coalesce(sum(case when strategy = 'Monogamous' then n_individuals end), 0) as bigint) as Monogamous,
       cast(coalesce(sum(case when strategy = 'Polygynous' then n_individuals end), 0) as bigint) as Polygynous
from scm_a group by col_area""")
    for name, wide in (("mixed_logit", "svym_wide_a"), ("mixed_logit_refined", "svym_wide")):
        q[name] = b("select * from (" + O.mixed_logit_sql(wide, "yob", "valley", "Monogamous", "Polygynous") + ")")
    q["valley_master"] = b("select * from svm")
    q["valley_year_master"] = b("select * from svym")
    q["rank_sum_master"] = b("select * from (" + O.rank_sum_sql("svym", "valley", "strategy", "n_individuals") + ")")
    for name, wide in (("int_audit", "svym_wide_a"), ("int_audit_refined", "svym_wide")):
        q[name] = b(f"""
select cast(sum(case when regexp_full_match(coalesce(valley, ''), '[0-9]+') then 0 else 1 end) as bigint) as valley,
       cast(sum(case when regexp_full_match(cast(Monogamous as varchar), '[0-9]+') then 0 else 1 end) as bigint)
         as Monogamous,
       cast(sum(case when regexp_full_match(cast(Polygynous as varchar), '[0-9]+') then 0 else 1 end) as bigint)
         as Polygynous
from {wide}""")
    rxm = O.fisher_rx3_sql("svym_wide_y", "yob", "valley", "Monogamous", "Polygynous")
    for name, wide in (("fisher_per_year", "svym_wide_a"), ("fisher_per_year_refined", "svym_wide")):
        q[name] = b(f"""
select * from ({rxm}
select t.g as year, case when tested then round(p.p, 6) end as p_value,
       case when not tested then 'NA' when p.p < 0.05 then 'Yes' else 'No' end as Significant
from (select g, nrows > 1 and nz > 1 as tested from t
      join (select yob, sum(case when Monogamous + Polygynous > 0 then 1 else 0 end) as nz
            from svym_wide_y group by yob) z on t.g = z.yob) t
left join p on t.g = p.g)""", {"svym_wide_y": f"select * from {wide} where yob is not null"})
    for name, wide in (("long_offspring", "svym_wide_a"), ("long_offspring_refined", "svym_wide")):
        q[name] = b(f"""
select yob, valley, strategy, case when strategy = 'Polygynous' then 1 else 0 end as strategy_bin
from (select yob, valley, strategy, unnest(range(0, count)) as i from (
  select yob, valley, 'Monogamous' as strategy, Monogamous as count from {wide}
  union all select yob, valley, 'Polygynous' as strategy, Polygynous as count from {wide}))""")

    # both data sets
    q["mixed_years"] = b("""
select sire_x, try_cast(yrborn as integer) as year, cast(n_dams as double) as count, strategy as strategy_type,
       'summary_df' as source from cls
union all
select null as sire_x, yob as year, cast(count as double) as count, type as strategy_type,
       'combined_counts' as source from combined_counts""")
    q["mixed_sires"] = b("""
select cast(yrborn as integer) as yrborn, strategy, count(distinct sire_x) as n_sires, 'genotype_data' as dataset,
       'genotype_data_' || strategy as fill_group from sl_mating group by yrborn, strategy
union all
select yob as yrborn, strategy, count(distinct sire) as n_sires, 'master_data' as dataset,
       'master_data_' || strategy as fill_group from master_level group by yob, strategy""")
    q["mixed_year_counts"] = b("""
select yob as yrborn, count as n_sires, type as strategy, 'master' as dataset, null as sire_x,
       'master_' || type as fill_group from combined_counts
union all
select try_cast(yrborn as integer) as yrborn, n_dams as n_sires, strategy, 'small' as dataset, sire_x,
       'small_' || strategy as fill_group from cls""")
    mv = {"mv": """
  select valley, strategy, n_individuals, 'genotype_data' as dataset, 'genotype_data_' || strategy as fill_group
  from vs
  union all
  select valley, strategy, n_individuals, 'master_data' as dataset, 'master_data_' || strategy as fill_group
  from svm"""}
    q["mixed_valleys"] = b("select * from mv", mv)
    q["mixed_colonies"] = b("""
select col_area, strategy, n_individuals, source, source || '_' || strategy as strategy_fill,
       cast(case source || '_' || strategy when 'Small_Monogamous' then 1 when 'Small_Polygynous' then 2
            when 'Master_Monogamous' then 3 when 'Master_Polygynous' then 4 end as integer) as strategy_fill_order
from (select col_area, strategy, count(*) as n_individuals, 'Small' as source from os group by col_area, strategy
      union all select col_area, strategy, n_individuals, 'Master' as source from scm)""")
    q["plot_fill"] = b(_fill_sql("svym", "valley", "yob", "strategy", "n_individuals"))
    q["plot_stack"] = b(_stack_sql("mv", "dataset", "valley", "fill_group", "n_individuals"), mv)
    q["plot_fill_valley_year_small"] = b(_fill_sql("types_small_vys", "valley", "yrborn", "strategy",
                                                   "n_individuals"), {"types_small_vys": """
  select valley, yrborn, strategy, count(*) as n_individuals from types_small group by valley, yrborn, strategy"""})
    q["plot_fill_pairings"] = b(_fill_sql("pby", None, "yrborn", "strategy", "n_dams"))
    myc = {"myc": """
  select yob as yrborn, count as n_sires, type as strategy, 'master' as dataset, 'master_' || type as fill_group
  from combined_counts
  union all
  select try_cast(yrborn as integer) as yrborn, n_dams as n_sires, strategy, 'small' as dataset,
         'small_' || strategy as fill_group from cls"""}
    q["plot_stack_years"] = b(_stack_sql("myc", "dataset", "yrborn", "fill_group", "n_sires"), myc)
    msc = {"msc": """
  select cast(yrborn as integer) as yrborn, count(distinct sire_x) as n_sires, 'genotype_data' as dataset,
         'genotype_data_' || strategy as fill_group from sl_mating group by yrborn, strategy
  union all
  select yob as yrborn, count(distinct sire) as n_sires, 'master_data' as dataset,
         'master_data_' || strategy as fill_group from master_level group by yob, strategy"""}
    q["plot_stack_sires"] = b(_stack_sql("msc", "dataset", "yrborn", "fill_group", "n_sires"), msc)
    mcol = {"mcol": """
  select col_area, source, n_individuals, source || '_' || strategy as strategy_fill,
         cast(case source || '_' || strategy when 'Small_Monogamous' then 1 when 'Small_Polygynous' then 2
              when 'Master_Monogamous' then 3 when 'Master_Polygynous' then 4 end as integer) as strategy_fill_order
  from (select col_area, strategy, count(*) as n_individuals, 'Small' as source from os group by col_area, strategy
        union all select col_area, strategy, n_individuals, 'Master' as source from scm)"""}
    q["plot_stack_colonies"] = b(_stack_sql("mcol", "source", "col_area", "strategy_fill", "n_individuals",
                                            order="strategy_fill_order"), mcol)
    q["csv_round_trip"] = b("select * from merged")
    q["csv_small_chain"] = b("select * from clean")
    q["csv_master_level"] = b("select * from master_level")
    docs = {"ld": "select l.doc_id, l.quality, l.toxic, d.lang from labels l join documents d on l.doc_id = d.doc_id",
            "tl": """
  select lang, cast(sum(case when toxic = 1 then 1 else 0 end) as bigint) as yes,
         cast(sum(case when toxic = 0 then 1 else 0 end) as bigint) as no, 'lang_x_toxic' as contrast
  from ld group by lang""",
            "tq": """
  select quality, cast(sum(case when toxic = 1 then 1 else 0 end) as bigint) as yes,
         cast(sum(case when toxic = 0 then 1 else 0 end) as bigint) as no, 'quality_x_toxic' as contrast
  from ld group by quality""",
            "tl_long": "select lang, 'yes' as outcome, yes as n from tl union all select lang, 'no' as outcome, no as n from tl"}
    q["toxic_by_lang"] = b("select * from tl", docs)
    q["chisq_lang_toxic"] = b("select 'lang_x_toxic' as contrast, * from ("
                              + O.chisq_sql("tl_long", "lang", "outcome", "n") + ")", docs)
    q["fisher_lang_toxic"] = b("select * from (" + O.fisher_r4_sql("tl", "contrast", "lang", "yes", "no") + """
select t.g as contrast, cast(t.nrows as integer) as n_rows, round(case when t.nrows > 1 then p.p end, 6) as p_value
from t left join p on t.g = p.g)""", docs)
    q["fisher_mc_lang_toxic"] = b("select * from (" + O.fisher_halves_sql("tl", "yes", "no") + ")", docs)
    f2q = O.fisher_2x2_sql("a", "b", "c", "d")
    q["fisher_quality_toxic"] = b(f"""
select contrast, cast(n_rows as integer) as n_rows, case when n_rows = 2 then round({f2q}, 6) end as p_value from (
  select contrast, count(*) as n_rows, arg_min(yes, quality) as a, arg_min(no, quality) as b,
         arg_max(yes, quality) as c, arg_max(no, quality) as d
  from tq group by contrast)""", docs)
    q["logit_year"] = b(O.logit_sql("master_level", "yob", "strategy_bin", "yob"))
    q["logit_year_small"] = b(O.logit_sql("sl_mating", "yrborn", "strategy_bin", "yrborn"))
    q["logit_deviance"] = b(O.deviance_sql("master_level", "yob", "strategy_bin", "yob", "master")
                            + " union all "
                            + O.deviance_sql("sl_mating", "yrborn", "strategy_bin", "yrborn", "small"))
    q["logit_summary"] = b(O.logit_summary_sql("master_level", "yob", "strategy_bin", "master") + " union all "
                           + O.logit_summary_sql("sl_mating", "yrborn", "strategy_bin", "small"))
    return q


def _fill_sql(src: str, facet, x: str, fill: str, y: str) -> str:
    keys = f"{facet}, {x}" if facet else x
    return f"""
select {keys}, {fill}, round(y, 6) as y, round(prop, 6) as prop, round(ymax, 6) as ymax, round(ymax - prop, 6) as ymin
from (select {keys}, {fill}, y, prop,
             sum(prop) over (partition by {keys} order by {fill} desc
                             rows between unbounded preceding and current row) as ymax
      from (select {keys}, {fill}, y, y / sum(y) over (partition by {keys}) as prop
            from (select {keys}, {fill}, sum(cast({y} as double)) as y from {src} group by {keys}, {fill})))"""


def _stack_sql(src: str, facet, x: str, fill: str, y: str, order: str | None = None) -> str:
    keys = f"{facet}, {x}" if facet else x
    grp = f"{keys}, {fill}" + (f", {order}" if order else "")
    return f"""
select {grp}, round(y, 6) as y, round(ymax, 6) as ymax, round(ymax - y, 6) as ymin
from (select {grp}, y, sum(y) over (partition by {keys} order by {order or fill} desc
                                    rows between unbounded preceding and current row) as ymax
      from (select {grp}, sum(cast({y} as double)) as y from {src} group by {grp}))"""


def oracle_sql() -> dict[str, str]:
    return _sql()
