"""Edge rows of FIXTURES.md section 2 through the classification pipelines."""

from pyspark.sql import functions as F

from matingstats.operators.joins import first_per_key, full_join
from matingstats.plans import master as M
from matingstats.plans import small as S

MASTER_SCHEMA = "uid long, sire string, dam string, yob int, col_area string"


def master(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], MASTER_SCHEMA)


def labels(df, key=("sire", "yob")):
    return {tuple(r[k] for k in key): r["strategy"] for r in df.collect()}


def test_na_dam_counts_as_a_dam(spark):
    m = master(spark, [("A", "d1", 2001, "x"), ("A", None, 2001, "x")])
    assert M.master_polygynous(m).count() == 2
    assert M.master_monogamous(m).count() == 0
    assert labels(M.master_level(m)) == {("A", 2001): "Monogamous"}   # D28 filters the NA dam


def test_only_na_dams(spark):
    m = master(spark, [("B", None, 2001, "x"), ("B", None, 2001, "x")])
    assert M.master_monogamous(m).count() == 2
    assert M.master_level(m).count() == 0


def test_same_litter(spark):
    m = master(spark, [("C", "d1", 2001, "x")] * 3)
    lv = M.master_level(m).first()
    assert (lv["strategy"], lv["n_dams"]) == ("Monogamous", 1)
    cc = {(r["yob"], r["type"]): r["count"] for r in M.offspring_by_year(m).collect()}
    assert cc == {(2001, "Monogamous"): 3}


def test_two_dams_in_different_years(spark):
    m = master(spark, [("D", "d1", 2001, "x"), ("D", "d2", 2002, "x")])
    assert labels(M.master_level(m)) == {("D", 2001): "Monogamous", ("D", 2002): "Monogamous"}


def test_independent_versus_pair_membership(spark):
    places = spark.createDataFrame([("x", "Upper Valley")], "col_area string, valley string")
    m = master(spark, [("E", "d1", 2001, "x"), ("E", "d2", 2001, "x"), ("E", "d1", 2002, "x"),
                       ("F", "d1", 2002, "x"), ("F", "d2", 2002, "x")])
    ind = labels(M.colony_types_master(m, places, mode="independent"))
    pair = labels(M.colony_types_master(m, places, mode="pair"))
    assert ind[("E", 2002)] == "Polygynous"
    assert pair[("E", 2002)] == "Monogamous"
    # property: pair-mode Polygynous rows are a subset of independent-mode ones
    assert {k for k, v in pair.items() if v == "Polygynous"} <= {k for k, v in ind.items() if v == "Polygynous"}


def test_colony_text_forms(spark):
    m = master(spark, [("G", "d1", 2001, "  River "), ("G", "d1", 2001, "river"), ("G", "d1", 2001, None)])
    got = sorted((r["col_area"] or "~") for r in M.colony_list(m).collect())
    assert got == ["river", "~"]
    places = spark.createDataFrame([("river", "Lower Valley")], "col_area string, valley string")
    assert M.colony_types_master(m, places, form="analysis").count() == 1   # only exact "river"
    assert M.colony_types_master(m, places, form="refined").count() == 1    # both normalise to one row


def test_year_text_cleaning(spark):
    parent = spark.createDataFrame([(f"UID_{i}", "S", f"d{i}") for i in range(5)], "id string, sire string, dam string")
    meta = spark.createDataFrame(
        [(f"UID_{i}", None, None, y, "c", "F") for i, y in enumerate(["N/A", "", " 2003 ", None, "x"])],
        "uid string, sire string, dam string, yrborn string, col_area string, sex string")
    merged = S.merged_ped(parent, meta)
    a = [r["yrborn"] for r in S.sire_level_offspring(merged).collect()]
    b = [r["yrborn"] for r in S.sire_level_mating(merged).collect()]
    assert a == [2003.0] and b == [2003.0]
    years = {r["yrborn"] for r in S.sire_classification(merged).collect()}
    assert "N/A" in years                                     # D7 keeps "N/A" as a year


def test_small_valley_other_for_unknown_colony(spark):
    places = spark.createDataFrame([("river", "Lower Valley")], "col_area string, valley string")
    df = spark.createDataFrame([(" River ",), ("river",), (None,)], "col_area string")
    got = sorted(r["valley"] for r in S.with_valley(df, places).collect())
    assert got == ["Lower Valley", "Other", "Other"]


def test_duplicate_uid_keeps_first_by_order(spark):
    df = spark.createDataFrame([("u", "2002", "b"), ("u", "2001", "z"), ("v", "2001", None)],
                               "uid string, yrborn string, dam string")
    got = {r["uid"]: (r["yrborn"], r["dam"]) for r in first_per_key(df, "uid", ["yrborn", "dam"]).collect()}
    assert got == {"u": ("2001", "z"), "v": ("2001", None)}


def test_full_join_matches_null_keys(spark):
    a = spark.createDataFrame([(None, "s1"), ("1", "s2")], "uid string, sire string")
    b = spark.createDataFrame([(None, "x"), ("2", "y")], "uid string, sire string")
    j = full_join(a, b, "uid")
    assert j.columns == ["uid", "sire_x", "sire_y"]
    rows = {(r["uid"], r["sire_x"], r["sire_y"]) for r in j.collect()}
    assert rows == {(None, "s1", "x"), ("1", "s2", None), ("2", None, "y")}


def test_prefix_in_merge(spark):
    parent = spark.createDataFrame([("UID_UID_7", "s", "d")], "id string, sire string, dam string")
    meta = spark.createDataFrame([("UID_7", None, None, "2001", "c", "F")],
                                 "uid string, sire string, dam string, yrborn string, col_area string, sex string")
    merged = S.merged_ped(parent, meta)
    assert [r["uid"] for r in merged.collect()] == ["7"]


def test_study_places_dimension(spark):
    from matingstats.sources.roles import study_places
    p = study_places(spark)
    got = {r["col_area"]: r["valley"] for r in p.collect()}
    assert len(got) == 15 and got["river"] == "Lower Valley" and got["northpk"] == "Upper Valley"
    m = master(spark, [("A", "d1", 2001, " River "), ("A", "d2", 2001, "NorthPk"), ("A", "d1", 2001, "elsewhere")])
    rows = {(r["col_area"], r["valley"], r["strategy"]) for r in M.colony_types_master(m, p).collect()}
    assert rows == {("river", "Lower Valley", "Polygynous"), ("northpk", "Upper Valley", "Polygynous")}


def test_first_row_by_input_order_through_the_joins(spark, tmp_path):
    """Two files a side, repeated ids on both: the original order is x's rows, matches of one row in y's order, then y's own rows."""
    from matingstats.operators.joins import POSITION, joined_position, scan_position

    def side(name, parts, schema):
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name / f"part={k}"))
        return spark.read.parquet(str(tmp_path / name)).select(*[c.split()[0] for c in schema.split(", ")], scan_position())

    x_rows = [[("b", 1), ("a", 2), ("b", 3)], [("c", 4), ("a", 5)]]
    y_rows = [[("a", "p"), ("z", "q")], [("b", "r"), ("a", "s"), ("z", "t"), ("b", "u")]]
    x, y = side("x", x_rows, "uid string, n int"), side("y", y_rows, "uid string, v string")
    j = joined_position(full_join(x, y, "uid"))
    fx, fy = [r for p in x_rows for r in p], [r for p in y_rows for r in p]
    want = [(u, n, v) for u, n in fx for v in ([v for w, v in fy if w == u] or [None])] + [(u, None, v) for u, v in fy if u not in {w for w, _ in fx}]
    assert [tuple(r) for r in j.orderBy(POSITION).select("uid", "n", "v").collect()] == want
    first = {}
    for u, n, v in want:
        first.setdefault(u, (n, v))
    for parts in (1, 5):
        got = first_per_key(j.repartition(parts), "uid", [POSITION]).drop(POSITION).collect()
        assert {r["uid"]: (r["n"], r["v"]) for r in got} == first
