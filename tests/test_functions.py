from pyspark.sql import functions as F

from lexmill.functions import scalars as S
from lexmill.functions import text as T
from lexmill.operators import keys


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_citations(spark):
    assert column(spark, T.full_citation, [None, "", " 023.44 ", "SMC 23", "Chapter 2", "0"]) == [None, None, "SMC 23.44", "SMC 23", "Chapter 2", "SMC "]
    assert column(spark, T.sanitize, [None, "", "23.44.A", "--", "é"]) == ["unknown", "unknown", "23-44-a", "unknown", "unknown"]


def test_hyphens_and_footers(spark):
    assert column(spark, T.mend_hyphens, ["regula-\r\ntion", "a - \nb", "end-\n\nnext", None]) == ["regulation", "a - \nb", "endnext", ""]
    assert column(spark, T.is_footer, ["23-4 (Seattle 12-3)", " 23-4.5(Seattle  1-2) ", "23-4 (Seattle 12)"]) == [True, True, False]


def test_addresses(spark):
    got = column(spark, S.normalize_address, ["  123 main  street, Seattle WA 98101", "9 Broadway", "12345 Pine St", "7 North East Road", None])
    assert got == ["123 MAIN ST", "9 BROAD", "", "7 N E RD", None]
    assert column(spark, lambda c: S.normalize_address(c, anchored=True), ["9 Broadway"]) == ["9 BROADWAY"]
    assert column(spark, S.house_number, ["12 A ST", "A ST"]) == ["12", None] and column(spark, S.street, ["12 A ST", "A ST"]) == ["A ST", "A ST"]


def test_lenient_numbers(spark):
    assert column(spark, lambda c: S.to_number(c, -1.0), [None, "", " 7 ", "x", "1e3", "NaN", "Infinity"]) == [0.0, 0.0, 7.0, -1.0, 1000.0, -1.0, -1.0]


def test_projects(spark):
    assert column(spark, S.project_types, ["Graduate deck", "expand my garage remodel", None]) == [["adu", "deck"], ["addition", "garage", "remodel"], []]
    assert column(spark, S.square_feet, ["1,200 sq ft", "450sf", "800 square feet", "none"]) == [200, 450, 800, None]


def test_shorten(spark):
    out = column(spark, T.shorten, ["short  text", "w " * 900, None])
    assert out[0] == "short text" and out[1].endswith(" …") and len(out[1]) <= 1200 and out[2] is None


def test_keys(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, v string")
    assert sorted(map(tuple, keys.keep_first(df, "k", "o").collect())) == [("a", 1, "y"), ("b", 3, None)]
    assert sorted(map(tuple, keys.keep_last(df, "k", "o").collect())) == [("a", 2, "x"), ("b", 3, None)]
    lists = spark.createDataFrame([(["m1", "", None, "m1"],), (["d", "m2", "d"],)], "l array<string>")
    assert [r.o for r in lists.select(keys.distinct_in_order(F.col("l"), F.lit("d")).alias("o")).collect()] == [["d", "m1"], ["d", "m2"]]
