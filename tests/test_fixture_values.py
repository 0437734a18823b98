"""Expected values of FIXTURES.md section 4 (sf0.01), checked in two engines there."""

import pytest
from pyspark.sql import functions as F

from matingstats.plans import master as M
from matingstats.plans import small as S
from matingstats.sources import roles
from tests.conftest import SF_CHECK

D28 = {1995: (379, 651), 1996: (365, 646), 1997: (403, 627), 1998: (369, 631), 1999: (391, 641),
       2000: (414, 604), 2001: (158, 561)}
D25 = {1995: (1452, 691), 1996: (1420, 671), 1997: (1482, 664), 1998: (1407, 676), 1999: (1491, 692),
       2000: (1596, 644), 2001: (565, 666)}


@pytest.fixture(scope="module")
def views(spark):
    return {
        "master": roles.master_raw(spark, SF_CHECK),
        "parent": roles.gen_parent(spark, SF_CHECK),
        "meta": roles.gen_meta(spark, SF_CHECK),
        "places": roles.places(spark, SF_CHECK),
    }


def test_role_view_sizes(views):
    m = views["master"]
    row = m.agg(F.count("*"), F.count("sire"), F.count("dam"), F.count_distinct("col_area")).first()
    assert tuple(row) == (15000, 14117, 11980, 25)
    p = views["parent"].agg(F.count("*"), F.count("sire"), F.count("dam")).first()
    assert tuple(p) == (9000, 8526, 7189)
    g = views["meta"].agg(F.count("*"), F.count("yrborn"), F.count("col_area"), F.count_distinct("yrborn")).first()
    assert tuple(g) == (8714, 8427, 8433, 31)
    pl = views["places"].groupBy("valley").count().collect()
    assert {r["valley"]: r["count"] for r in pl} == {"Upper Valley": 10, "Lower Valley": 10}


def test_every_event_has_a_role(spark, views):
    ids = spark.read.parquet(f"{SF_CHECK}/events.parquet").select(F.col("event_id").cast("string").alias("uid"))
    merged = S.merged_ped(views["parent"], views["meta"])
    assert ids.join(merged, "uid", "left_anti").count() == 0
    one_sided = merged.agg(F.count_if(F.col("sex").isNull()), F.count_if(F.col("sex").isNotNull() & (F.col("uid").cast("long") % 10 == 0))).first()
    assert min(one_sided) > 0


def test_small_merge_and_classification(views):
    merged = S.merged_ped(views["parent"], views["meta"])
    assert merged.count() == 10000
    d7 = S.sire_classification(merged)
    row = d7.agg(F.count("*"), F.sum(F.when(F.col("strategy") == "Polygynous", 1)), F.sum("n_dams"),
                 F.count_distinct("yrborn")).first()
    assert tuple(row) == (3242, 1336, 4866, 31)


def test_master_year_tables(views):
    m = views["master"]
    d28 = {(r["yob"], r["strategy"]): r["n_pairs"] for r in M.master_level_counts(m).collect()}
    d25 = {(r["yob"], r["type"]): r["count"] for r in M.offspring_by_year(m).collect()}
    for y, (p, mo) in D28.items():
        assert (d28[(y, "Polygynous")], d28[(y, "Monogamous")]) == (p, mo)
    for y, (p, mo) in D25.items():
        assert (d25[(y, "Polygynous")], d25[(y, "Monogamous")]) == (p, mo)


def test_offspring_cells_sum_to_rows(views):
    m = views["master"]
    known = m.where(F.col("sire").isNotNull() & F.col("yob").isNotNull()).count()
    assert M.offspring_by_year(m).agg(F.sum("count")).first()[0] == known
    assert M.master_polygynous(m).count() + M.master_monogamous(m).count() == known


def test_document_label_contrasts(spark):
    import math
    from matingstats.plans import contingency as CT
    docs = CT.labelled_docs(spark, SF_CHECK)
    table = {r["lang"]: (r["yes"], r["no"]) for r in CT.outcome_table(docs, "lang").collect()}
    assert table == {"de": (6, 40), "en": (36, 226), "es": (4, 35), "fr": (5, 47)}
    exact = CT.fisher_exact(docs, "lang").first()
    assert exact["n_rows"] == 4
    assert exact["p_value"] == pytest.approx(0.8781708488, abs=1e-9)
    mc = CT.fisher_mc(docs, "lang", B=20000, seed=3).first()["p_value"]
    assert abs(mc - 0.8781708488) < 4 * math.sqrt(0.878 * 0.122 / 20000)
