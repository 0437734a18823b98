"""Missing-value and text rules of the original analysis."""

from pyspark.sql import functions as F

from matingstats.functions import text as T


def one(spark, expr, schema="a string", row=(None,)):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


def test_prefix_strip_twice(spark):
    assert one(spark, T.strip_prefix("a", times=2), row=("UID_UID_7",)) == "7"
    assert one(spark, T.strip_prefix("a"), row=("UID_UID_7",)) == "UID_7"
    assert one(spark, T.strip_prefix("a", times=2), row=("7UID_",)) == "7UID_"


def test_paste_writes_na(spark):
    assert one(spark, T.paste("a", F.lit("Monogamous"))) == "NA_Monogamous"
    assert one(spark, T.paste("a", F.lit("M")), row=("small",)) == "small_M"


def test_in_is_never_null(spark):
    assert one(spark, T.r_in("a", ["x", "y"])) is False
    assert one(spark, T.r_in("a", ["x", None])) is True
    assert one(spark, T.r_in("a", ["x"]), row=("x",)) is True


def test_grepl_on_null_is_false(spark):
    assert one(spark, T.grepl("^[0-9]+$", "a")) is False
    assert one(spark, ~T.grepl("^[0-9]+$", "a")) is True
    assert one(spark, T.grepl("^[0-9]+$", "a"), row=("12",)) is True


def test_trimws_strips_tabs_and_newlines(spark):
    assert one(spark, T.trimws("a"), row=("\t 2003 \r\n",)) == "2003"
    assert one(spark, T.normalise_text("a"), row=("  River ",)) == "river"


def test_as_numeric_and_integer(spark):
    assert one(spark, T.as_numeric("a"), row=(" 2003 ",)) == 2003.0
    assert one(spark, T.as_numeric("a"), row=("N/A",)) is None
    assert one(spark, T.as_numeric("a"), row=("1d",)) is None      # Java would parse it; R does not
    assert one(spark, T.as_numeric("a"), row=("1e3",)) == 1000.0
    assert one(spark, T.as_integer("a"), row=("-2.7",)) == -2       # truncation toward zero


def test_ifelse_null_test_gives_null(spark):
    assert one(spark, T.ifelse(F.col("a") == "x", "yes", "no")) is None
    assert one(spark, T.ifelse(F.col("a") == "x", "yes", "no"), row=("y",)) == "no"


def test_na_if_chain(spark):
    assert one(spark, T.na_if("a", "N/A", ""), row=("",)) is None
    assert one(spark, T.na_if("a", "N/A", ""), row=("N/A",)) is None
    assert one(spark, T.na_if("a", "N/A", ""), row=("3",)) == "3"


def test_is_na_covers_nan(spark):
    assert one(spark, T.is_na("a"), "a double", (float("nan"),)) is True
    assert one(spark, T.is_na("a"), "a double", (None,)) is True
    assert one(spark, T.is_na("a"), "a double", (0.5,)) is False


def test_significance_labels(spark):
    assert one(spark, T.significance_label("a"), "a double", (float("nan"),)) is None
    assert one(spark, T.significance_label("a"), "a double", (0.01,)) == "Yes"
    assert one(spark, T.significance_yes_no("a"), "a double", (None,)) == "No"
    assert one(spark, T.significance_text_na("a", F.lit(False)), "a double", (0.01,)) == "NA"


def test_dominant_level(spark):
    df = spark.createDataFrame([(3, 1), (1, 3), (2, 2)], "p int, m int")
    got = [r[0] for r in df.select(T.dominant_level("p", "m")).collect()]
    assert got == ["Polygynous", "Monogamous", "Tie"]


def test_factor_order(spark):
    lv = ["Small_Monogamous", "Small_Polygynous"]
    assert one(spark, T.factor_order("a", lv), row=("Small_Polygynous",)) == 2
    assert one(spark, T.factor_order("a", lv), row=("Other",)) is None


def test_zero_if_na(spark):
    assert one(spark, T.zero_if_na("a"), "a long", (None,)) == 0
    assert one(spark, T.zero_if_na("a"), "a long", (4,)) == 4


def test_case_when_first_match_and_null_condition(spark):
    expr = T.case_when((F.col("a") > 5, "big"), (F.col("a") > 1, "mid"), default="small")
    assert one(spark, expr, "a long", (9,)) == "big"
    assert one(spark, expr, "a long", (3,)) == "mid"
    assert one(spark, expr, "a long", (None,)) == "small"     # NULL condition is not a match
    assert one(spark, T.case_when((F.col("a") > 5, "big")), "a long", (1,)) is None
