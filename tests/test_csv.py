"""CSV scan and sink rules (S1-S4): blank vs NA, round trip through the shared folder."""

import os
import uuid

from matingstats.session import shared_dir
import math

import pytest
from pyspark.sql import functions as F

from matingstats.functions.text import as_integer, as_numeric
from matingstats.sources.csv import column_types, file_headers, header_report, number_text, read_csv, read_pedigree_csv, typed, write_csv, write_csv_file


def _write(tmp_path, text):
    p = tmp_path / f"{uuid.uuid4().hex}.csv"
    p.write_text(text)
    return str(p)


def test_blank_quoted_and_na_cells(spark, tmp_path):
    path = _write(tmp_path, 'id,sire,dam\n1,,x\n2,"",y\n3,NA,z\n4,S,NA\n')
    faithful = {r["id"]: r["sire"] for r in read_pedigree_csv(spark, path, ["id", "sire", "dam"]).collect()}
    assert faithful == {"1": "", "2": "", "3": None, "4": "S"}
    practical = {r["id"]: r["sire"] for r in
                 read_pedigree_csv(spark, path, ["id", "sire", "dam"], blank_as_null=True).collect()}
    assert practical == {"1": None, "2": None, "3": None, "4": "S"}


def test_round_trip_keeps_null_and_empty(spark):
    df = spark.createDataFrame([("1", None, "a"), ("2", "", "b"), ("3", "s", None)], "uid string, sire string, dam string")
    path = shared_dir(spark, "test_csv", uuid.uuid4().hex)
    write_csv(df, path)
    back = {r["uid"]: (r["sire"], r["dam"]) for r in read_pedigree_csv(spark, path, df.columns).collect()}
    assert back == {"1": (None, "a"), "2": ("", "b"), "3": ("s", None)}
    files = [f for f in os.listdir(path.replace("file:", "")) if f.endswith(".csv")]
    text = "".join(open(os.path.join(path.replace("file:", ""), f)).read() for f in files)
    assert "NA" in text and text.startswith("uid,sire,dam")


def _folder(tmp_path, **files):
    folder = tmp_path / uuid.uuid4().hex
    folder.mkdir()
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_columns_are_bound_by_name_file_by_file(spark, tmp_path):
    path = _folder(tmp_path, a="uid,sire,dam\n1,s1,d1\n2,s2,d2\n", b='sire,"uid",dam\ns3,3,d3\n', c="dam,extra,sire,uid\nd4,x,s4,4\n", d="uid,sire,dam\n")
    rows = sorted(tuple(r) for r in read_pedigree_csv(spark, path, ["uid", "sire", "dam"]).collect())
    assert rows == [("1", "s1", "d1"), ("2", "s2", "d2"), ("3", "s3", "d3"), ("4", "s4", "d4")]
    assert len(file_headers(spark, path)) == 3
    found = {(r["file"].split("/")[-1], r["column"], r["status"]) for r in header_report(spark, path, ["uid", "sire", "dam"]).collect()}
    assert found == {("b.csv", "uid", "moved"), ("b.csv", "sire", "moved"), ("c.csv", "extra", "surplus"),
                     ("c.csv", "uid", "moved"), ("c.csv", "sire", "moved"), ("c.csv", "dam", "moved")}
    with pytest.raises(ValueError, match="extra"):
        read_pedigree_csv(spark, path, ["uid", "sire", "dam"], surplus="error")


def test_missing_columns_raise_or_are_null(spark, tmp_path):
    path = _folder(tmp_path, a="uid,sire\n1,s1\n", b="uid,sire,yob\n2,s2,1999\n")
    with pytest.raises(ValueError, match="yob"):
        read_pedigree_csv(spark, path, ["uid", "yob"])
    rows = sorted(tuple(r) for r in read_pedigree_csv(spark, path, ["uid", "yob"], missing="null").collect())
    assert rows == [("1", None), ("2", "1999")]
    assert [(r["column"], r["status"]) for r in header_report(spark, path, ["uid", "sire", "yob"]).collect()] == [("yob", "missing")]


def test_repeated_names_and_quoted_commas(spark, tmp_path):
    path = _write(tmp_path, 'id,"a,b",id\n1,"x,y",2\n')
    assert list(file_headers(spark, path)) == [("id", "a,b", "id.1")]
    assert tuple(read_pedigree_csv(spark, path, ["id.1", "a,b", "id"]).first()) == ("2", "x,y", "1")


def test_column_types_are_those_of_the_original_reader(spark, tmp_path):
    path = _write(tmp_path, "l,i,d,t,mixed,none,big,h\nTRUE,1,1.5,a,TRUE,NA,1,0x1F\nF,-2,,NA,1,,3000000000,Inf\nNA,NA,1e3,,NA,NA,2,NA\n")
    text = read_pedigree_csv(spark, path, ["l", "i", "d", "t", "mixed", "none", "big", "h"])
    assert column_types(text) == {"l": "logical", "i": "integer", "d": "double", "t": "text", "mixed": "text", "none": "logical", "big": "double", "h": "double"}
    df = read_csv(spark, path)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["boolean", "int", "double", "string", "string", "boolean", "double", "double"]
    rows = [tuple(r) for r in df.collect()]
    assert rows[0] == (True, 1, 1.5, "a", "TRUE", None, 1.0, 31.0)
    assert rows[1][:7] == (False, -2, None, None, "1", None, 3e9) and rows[1][7] == math.inf
    assert rows[2] == (None, None, 1000.0, "", None, None, 2.0, None)
    # the typed form is the text form after as.numeric
    for c in ("i", "d", "big", "h"):
        want = [r["v"] for r in text.select(as_numeric(c).alias("v")).collect()]
        assert [None if v is None else float(v) for v in (r[c] for r in df.collect())] == want
    assert column_types(text.limit(0)) == dict.fromkeys(text.columns, "logical")
    assert typed(text.limit(0)).count() == 0


@pytest.mark.parametrize("text,want", [
    ("1", 1.0), (" 1 ", 1.0), ("\t-2.5\r\n", -2.5), ("+3", 3.0), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("1E-2", 0.01), ("-1.5e+2", -150.0), ("007", 7.0),
    ("0x1F", 31.0), ("0X1f", 31.0), ("-0xA", -10.0), ("+0x10", 16.0), ("0x1.8", 1.5), ("0x1.8p3", 12.0), ("0x1p-2", 0.25), ("0x.8p1", 1.0), ("0x0p5000", 0.0),
    ("0x1p1023", 2.0**1023), ("0x1p-1074", 5e-324), ("0xFFFFFFFFFFFFF8", float(0xFFFFFFFFFFFFF8)), (" 0x1F ", 31.0),
    ("Inf", math.inf), ("-Inf", -math.inf), ("inf", math.inf), ("INFINITY", math.inf), ("+infinity", math.inf), ("NaN", math.nan), ("nan", math.nan),
    ("NA", None), ("", None), ("abc", None), ("1x", None), ("0x", None), ("0xG", None), ("1e", None), ("1,5", None), ("1 2", None), ("--1", None), ("0x1p", None), (None, None),
])
def test_as_numeric_spellings(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(as_numeric("t").alias("v"), as_integer("t").alias("i")).first()
    if want is None:
        assert row["v"] is None and row["i"] is None
    elif math.isnan(want):
        assert math.isnan(row["v"]) and row["i"] is None
    else:
        assert row["v"] == want
        assert row["i"] == (int(want) if abs(want) < 2**31 else None)


def test_numbers_are_printed_as_the_original_does(spark):
    want = {1.0: "1", 100000.0: "1e+05", 123456.0: "123456", 0.1 + 0.2: "0.3", 1 / 3: "0.333333333333333", 1e-4: "1e-04", 0.00012345: "0.00012345", 1e15: "1e+15",
            123456789012345678.0: "123456789012345680", 2.0**60: "1152921504606846976", 2.0**66: "73786976294838206464", 2.0**67: "1.47573952589676e+20", -2.5: "-2.5", 1e-300: "1e-300", 2e100: "2e+100",
            1234.5678: "1234.5678", -0.0: "0", math.inf: "Inf", -math.inf: "-Inf", 3e5: "3e+05", 310000.0: "310000", 0.1: "0.1", 150.0: "150"}
    got = spark.createDataFrame([(k,) for k in want], "v double").select("v", number_text("v").alias("t")).collect()
    assert {r["v"]: r["t"] for r in got} == want


def test_the_written_file_has_the_bytes_of_the_original(spark):
    df = spark.createDataFrame([("b", 2, 0.5, None, 'say "hi"'), ("a", 1, 100000.0, True, None), (None, None, None, False, "x,y\nz"), ("c", 3, 1 / 3, True, "")],
                               'uid string, n int, v double, ok boolean, `a "q"` string').repartition(4)
    path = shared_dir(spark, f"file-{uuid.uuid4().hex}.csv")
    for _ in range(2):  # the second run replaces the first
        write_csv_file(df, path, ["uid"])
    text = open(path.replace("file:", ""), newline="").read()
    assert text == ('"uid","n","v","ok","a ""q"""\n"a",1,1e+05,TRUE,NA\n"b",2,0.5,NA,"say ""hi"""\n"c",3,0.333333333333333,TRUE,""\nNA,NA,NA,FALSE,"x,y\nz"\n')
    name = path.split("/")[-1]
    assert [f for f in os.listdir(os.path.dirname(path.replace("file:", ""))) if f.startswith(name) and f != name] == []
    many = spark.range(0, 20_000, 1, 7).select(((F.col("id") * 7919) % 20_000).alias("k"))
    write_csv_file(many, path, ["k"])
    assert open(path.replace("file:", "")).read() == '"k"\n' + "".join(f"{k}\n" for k in range(20_000))
