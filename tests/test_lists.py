"""Name resolution, session lists, notes, text vectors."""

import pytest
from pyspark.sql import functions as F

from nearshelf.functions import fuzzy
from nearshelf.operators import feedback as B, notes as G, resolve as R, text_vectors as TV
from nearshelf.plans import recommend as P
from nearshelf.sources import names as N


@pytest.mark.parametrize("typed,name,score", [
    ("opus one", "One Opus", 100), ("abcd", "abce", 75), ("", "", 100), ("!!", "x", 0), ("cafe", "café", 86), ("a.b", "b a", 100),
])
def test_exact_score(spark, typed, name, score):
    row = spark.createDataFrame([(typed, name)], "typed_name STRING, name STRING")
    assert R.fuzzy_scores(row, "exact").first().fuzzy == score


def test_prepared_sides_differ_by_version(spark):
    row = spark.createDataFrame([("a·b", "a b")], "typed_name STRING, name STRING")
    assert R.fuzzy_scores(row, "exact").first().fuzzy == 100
    assert R.fuzzy_scores(row, "exact_v1").first().fuzzy == 80
    assert row.select(fuzzy.token_sort_native(F.col("typed_name"), F.col("name")).alias("s")).first().s == 100


def test_first_candidate_wins_a_tie(spark):
    v = lambda x: [1.0, x]
    catalog = spark.createDataFrame([("a", "Red Hill", 1.0, v(0.2)), ("b", "Hill Red", 1.0, v(0.1)), ("c", None, 1.0, v(0.0))],
                                    "id STRING, name STRING, price DOUBLE, embedding ARRAY<FLOAT>")
    names = spark.createDataFrame([(1, "red hill", v(0.0)), (2, "quite other", v(0.0)), (3, "red hill", [0.0, 0.0])],
                                  "query_id INT, typed_name STRING, vector ARRAY<FLOAT>")
    resolved, unresolved = R.resolve_names(names, catalog, dim=2)
    assert [tuple(r) for r in resolved.collect()] == [(1, "red hill", "b", "Hill Red", 100)]
    assert sorted(r.query_id for r in unresolved.collect()) == [2, 3]


def test_autocomplete_equals_plain_search(spark):
    words = ["Aba", "bab", "cab", "abac", "ab", "b", "Babab", "x'y"]
    names = spark.createDataFrame([(f"{a} {b}",) for a in words for b in words] + [("b",)], "name STRING")
    typed = ["", " ", "a", "AB", "aba", "abab", "b a", "x'y b", "zzz", "bab cab", " ab "]
    asked = spark.createDataFrame(list(enumerate(typed)), "query_id INT, typed STRING")
    for limit in (5, None):
        got = {}
        for r in B.autocomplete(names, asked, limit=limit, salts=3).orderBy("query_id", "place").collect():
            got.setdefault(r.query_id, []).append(r.name)
        for i, text in enumerate(typed):
            q = text.strip().lower() if limit else text.lower()
            want = sorted(r.name for r in names.collect() if q in r.name.lower())
            assert got.get(i, []) == (want[:limit] if limit and q else want), (text, limit)


def test_feedback(spark):
    recs = spark.createDataFrame([(1, "a", "X "), (1, "b", None), (1, "c", "Y"), (2, "a", "x"), (1, None, "")], "user_id INT, id STRING, brand STRING")
    events = spark.createDataFrame([(1, "d"), (1, "b"), (1, ""), (1, None)], "user_id INT, id STRING")
    catalog = spark.createDataFrame([("d", " x"), ("b", " ")], "id STRING, brand STRING")
    hidden, blocked = B.dislikes(events, catalog)
    assert sorted((r.user_id, r.id or "") for r in B.apply_feedback(recs, hidden, blocked).collect()) == [(1, ""), (1, "c"), (2, "a")]


def test_name_list_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([('say "x", y',), ("two\nlines",), (" pad ",), (None,), ("",), ("é",), ("é",)], "name STRING")
    N.write_names(N.distinct_names(rows), str(tmp_path / "n"))
    assert [r.name for r in N.read_names(spark, str(tmp_path / "n")).collect()] == [" pad ", 'say "x", y', "two\nlines", "é"]


def test_sections(spark):
    rows = spark.createDataFrame([
        (1, "a", "B", "R", "BASE_WINE_BLURB: x||END_SECTION|| y ||END_SECTION||"), (2, "a", "B", "R", " only "), (3, "a", "B", "R", None), (4, "a", "B", "R", ""),
    ], "query_id INT, id STRING, base_name STRING, rec_name STRING, response STRING")
    got = [tuple(r)[2:] for r in G.parse_sections(rows).orderBy("query_id").collect()]
    assert got[0] == ("x", "y", "Detailed comparison notes are being crafted...")
    assert got[1][2] == "**AI Notes:**\nonly" and got[3][2] == "**AI Notes:**\n"
    assert got[2] == ("Enjoying B? Here's what makes it special based on its profile.",
                      "R is a great pick if you like B, offering similar enjoyment.", "Detailed comparison notes are being crafted...")


def test_own_template(spark):
    item = ("R", None, None, "F", "d" * 310, '[{"review":"good"}]')
    cols = "name STRING, brand STRING, category STRING, country STRING, description STRING, reviews_json STRING"
    recs = spark.createDataFrame([(1, "a", *item)], "query_id INT, id STRING, " + cols)
    base = spark.createDataFrame([(1, "Opus One", "N/A", None, None, None, None)], "query_id INT, " + cols)
    got = G.pair_prompts(recs, base, template="{base_name}|{rec_details}|{other}").first()
    assert got.prompt == "Opus One|Category: N/A, Origin: F, Producer: N/A, Description: " + "d" * 300 + '..., Reviews: "good..."|{other}'
    assert got.base_details.startswith("Category: N/A, Origin: N/A, Producer: opus one, Description: No desc....")


def test_text_vectors_find_the_text(spark):
    texts = spark.createDataFrame([("a", "ripe cherry and smoke", 1.0, "A", None), ("b", "crisp lemon, wet stone", 1.0, "B", None),
                                   ("c", "ripe plum", 1.0, "C", None)], "id STRING, text STRING, price DOUBLE, name STRING, brand STRING")
    model = TV.fit_text_vectors(texts, dim=64)
    catalog = TV.embed_texts(model, texts)
    asked = spark.createDataFrame([(1, "lemon stone"), (2, " "), (3, "unknownword")], "query_id INT, text STRING")
    got = P.recommend_by_text(TV.embed_texts(model, asked, out="vector"), catalog, 1, dim=64).collect()
    assert [(r.query_id, r.id) for r in got if r.query_id == 1] == [(1, "b")]
    assert 2 not in {r.query_id for r in got}


def test_bound_is_never_under_the_score(spark):
    import random

    rng, words = random.Random(4), ["opus", "one", "château", "d'or", "2015", "ÉTÉ", "a.b", "", "ñandú", "x"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 4))), " ".join(rng.choices(words, k=rng.randint(0, 4)))) for _ in range(300)]
    pairs = spark.createDataFrame(rows, "typed_name STRING, name STRING")
    for version, scorer in ((2, "exact"), (1, "exact_v1")):
        got = R.fuzzy_scores(pairs, scorer).withColumn("bound", R.BOUNDS[scorer](F.lower("typed_name"), F.lower("name"))).collect()
        assert all(r.bound >= r.fuzzy for r in got)


def test_plan_from_a_name_equals_its_steps(spark):
    from checks import plans as C
    from nearshelf.operators.query_text import query_variants

    sf = "/root/testdata/sf0.001"
    catalog, embed = C._text_catalog(spark, sf)
    names = C.X.spark_sql(spark, sf, C.NAMES).limit(40)
    whole = P.recommend_from_name(names, catalog, embed, 4, dim=C.TEXT_DIM, scorer="native", digits=6).collect()
    items = catalog.withColumn("query_id", F.col("id"))
    variants = embed(query_variants(items), "text", "vector").withColumnRenamed("query_id", "id")
    steps = P.recommend_by_item(embed(names, "typed_name", "vector"), variants, catalog, 4, dim=C.TEXT_DIM, scorer="native", digits=6).collect()
    key = lambda r: (r.query_id, r.rank, r.phase, r.id, r.score, r.base_id)
    assert sorted(key(r) for r in whole if r.id is not None) == sorted(key(r) for r in steps)
    assert {r.query_id for r in whole} == {r.query_id for r in names.collect()}


def test_equal_asks_are_made_once(spark):
    from nearshelf.plans.recommend import _distinct_asks

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b"), (4, "a"), (5, "a"), (5, "b"), (None, "a")], "query_id INT, typed_name STRING")
    asking, asked = _distinct_asks(rows, ["typed_name"], "test-asks")
    texts = {}
    for r in asked.collect():
        texts.setdefault(r.query_id, []).append(r.typed_name)
    assert len(texts) == 3
    assert {r.query_id: sorted(texts[r.ask_no], key=str) for r in asking.collect()} == {1: ["a"], 2: ["a"], 3: [None], 4: ["a", "b"], 5: ["a", "b"]}
