"""Reshape and union rules (R1-R3, U1, U3) and their inverse properties."""

import pytest
from pyspark.sql import functions as F

from matingstats.operators.reshape import (bind_rows, complete_cells, pivot_longer, pivot_wider, uncount)


def test_absent_level_is_zero(spark):
    df = spark.createDataFrame([("2001", "Monogamous", 4)], "y string, strategy string, n long")
    w = pivot_wider(df, ["y"], "strategy", "n", ["Monogamous", "Polygynous"]).first()
    assert (w["Monogamous"], w["Polygynous"]) == (4, 0)


def test_zero_count_gives_no_row(spark):
    df = spark.createDataFrame([("a", 0), ("b", 3), ("c", None)], "k string, count long")
    assert [r["k"] for r in uncount(df, "count").collect()] == ["b", "b", "b"]


def test_uncount_chunks_large_weights(spark):
    df = spark.createDataFrame([("a", 10), ("b", 7)], "k string, count long")
    got = uncount(df, "count", chunk=3).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {"a": 10, "b": 7}


def test_pivot_unpivot_margins_invariant(spark):
    df = spark.createDataFrame([("1", "Monogamous", 2), ("1", "Polygynous", 5), ("2", "Polygynous", 1)],
                               "y string, strategy string, n long")
    wide = pivot_wider(df, ["y"], "strategy", "n", ["Monogamous", "Polygynous"])
    long = pivot_longer(wide, ["y"], ["Monogamous", "Polygynous"], "strategy", "n")
    assert long.agg(F.sum("n")).first()[0] == 8
    assert long.count() == 4
    cells = complete_cells(df, ["y"], "strategy", ["Monogamous", "Polygynous"])
    assert sorted(tuple(r) for r in cells.collect()) == [("1", "Monogamous", 2), ("1", "Polygynous", 5),
                                                        ("2", "Monogamous", 0), ("2", "Polygynous", 1)]


def test_uncount_inverts_count(spark):
    df = spark.createDataFrame([("x", 3), ("y", 2)], "k string, count long")
    back = uncount(df, "count").groupBy("k").agg(F.count("*").alias("count"))
    assert sorted(tuple(r) for r in back.collect()) == [("x", 3), ("y", 2)]


def test_bind_rows_fills_missing_and_rejects_type_clash(spark):
    a = spark.createDataFrame([(1, "x")], "n long, s string")
    b = spark.createDataFrame([(2,)], "n long")
    out = bind_rows(a, b).collect()
    assert sorted((r["n"], r["s"]) for r in out) == [(1, "x"), (2, None)]
    c = spark.createDataFrame([("2",)], "n string")
    with pytest.raises(TypeError):
        bind_rows(a, c)
