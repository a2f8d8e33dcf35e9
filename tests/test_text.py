"""Name and text expressions on edge rows."""

import pytest
from pyspark.sql import functions as F

from nearshelf.functions import text as T
from nearshelf.operators import query_text as Q


def evaluate(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r.out for r in rows.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


NAMES = ["2017 Booker 'Fracture' Paso Robles Syrah", "2018 Booker 'Fracture' Paso Robles Syrah", "", None, "2015", "Single",
         "St. Francis Old Vine Zinfandel", "st-jean rouge", "Joseph Phelps' Insignia", "Smith's", "“Quoted” Name", "Ridge “Geyserville”",
         "2010 The Le Clos Vougeot Grand Cru", "Château Margaux 2009 2010", "Domaine", "Napa", "Red", "Q", "7 Deadly", "Paso Robles, Cuvee",
         "2001 12345 Opus One Red", "Éric Louis Sancerre", "La Rioja Alta 904", "Chateau Clos Mas", "  Opus One  ", "A B C D E", "Ab, Cd,, blend",
         "2011 Domaine Louis Jadot Marsannay", "1999 2000 Krug Champagne Brut", "12015 Not A Year", "Barolo 2015"]


BRANDS = ["booker", "booker", "", "", "", "single", "st. francis", "st-jean", "joseph phelps' insignia", "smith", "", "ridge",
          "clos vougeot", "château margaux", "", "", "", "", "deadly", "", "opus one red", "éric louis sancerre", "rioja alta", "", "opus one", "a b c",
          "ab, cd", "domaine louis jadot", "krug champagne", "not a year", "barolo"]
KEYS = ["booker fracture paso robles syrah", "booker fracture paso robles syrah", "", "", "", "single", "st francis old vine zinfandel",
        "st jean rouge", "joseph phelps insignia", "smith s", "quoted name", "ridge geyserville", "the le clos vougeot grand cru", "ch teau margaux",
        "domaine", "napa", "red", "q", "7 deadly", "paso robles cuvee", "12345 opus one red", "ric louis sancerre", "la rioja alta 904",
        "chateau clos mas", "opus one", "a b c d e", "ab cd blend", "domaine louis jadot marsannay", "krug champagne brut", "12015 not a year", "barolo"]


def test_brand_rule(spark):
    assert evaluate(spark, NAMES, T.brand_from_name) == BRANDS


def test_item_key(spark):
    got = evaluate(spark, NAMES, T.item_key)
    assert got == KEYS
    assert got[0] == got[1] == "booker fracture paso robles syrah"


def test_producer_and_year(spark):
    got = dict(zip(NAMES, evaluate(spark, NAMES, T.producer_from_name)))
    assert got["2011 Domaine Louis Jadot Marsannay"] == "Domaine Louis Jadot"
    assert got["Château Margaux 2009 2010"] == "Château Margaux 2010"
    assert got["A B C D E"] == "A B C D"
    assert got["Single"] is got["2015"] is got[""] is got[None] is got["Barolo 2015"] is None
    assert got["1999 2000 Krug Champagne Brut"] == "2000 Krug"
    years = dict(zip(NAMES, evaluate(spark, NAMES, T.first_year)))
    assert years["Château Margaux 2009 2010"] == "2009" and years["12015 Not A Year"] is None


def test_whitespace_is_unicode(spark):
    assert evaluate(spark, ["  a  b\x1f"], T.squeeze) == ["a b"]
    assert evaluate(spark, ["   "], T.text_or_null) == [None]


@pytest.mark.parametrize("text,value", [("12.5", 12.5), (" 1_000 ", 1000.0), ("1.0d", None), ("$12", None), ("inf", float("inf")),
                                        ("", None), (".5e1", 5.0), ("1__0", None), ("5.", 5.0)])
def test_lenient_double(spark, text, value):
    assert evaluate(spark, [text], T.lenient_double) == [value]


def test_shorten_counts_characters(spark):
    long = "é\U0001f377" * 130
    assert evaluate(spark, [long], lambda c: T.shorten(c, 240)) == [long[:240] + "…"]


def test_style_text(spark):
    profile = "Name: A.\n\n  producer: B. \r\nVINTAGE: 2\x1dPrice: $3  Notes: x "
    assert evaluate(spark, [profile, "Name: only", "", None], Q.style_text) == ["Notes: x", "Name: only", "", ""]


def test_query_text_fallbacks(spark):
    rows = spark.createDataFrame(
        [(1, None, None, None, None), (2, "2015 Red Hill", "N/A", "", ["k%d" % i for i in range(10)]), (3, "x", "B", "  Name: y\nNotes ", None)],
        "i INT, name STRING, brand STRING, embedding_text STRING, keywords_list ARRAY<STRING>",
    )
    got = [r.t for r in rows.select("i", Q.query_text(rows).alias("t")).orderBy("i").collect()]
    assert got[0] == "Basic wine entry for Unknown Wine."
    assert got[1] == "Wine: 2015 Red Hill.\nProducer: red hill.\nTags/Keywords: k2, k3, k4, k5, k6, k7, k8, k9."
    assert got[2] == "Name: y\nNotes"
    absent = rows.withColumn("has_metadata", F.col("i") > 1)
    assert absent.select(Q.query_text(absent).alias("t")).first().t == "No wine data available."


def test_taste_cuts(spark):
    rows = spark.createDataFrame([(30, 31, 69, 70, 25), (0, 50, 100, 71, 65), (1, 1, 1, 1, 26), (1, 1, 1, 1, 64)],
                                 "taste_body INT, taste_acidity INT, taste_tannin INT, taste_fruit_earth INT, taste_oak INT")
    got = [tuple(r)[5:] for r in Q.taste_words(rows).collect()]
    assert got[0] == ("light-bodied", "balanced acidity", "moderate tannins", "earthy/savory", "little/no oak")
    assert [g[4] for g in got] == ["little/no oak", "noticeable oak", "some oak", "some oak"]
