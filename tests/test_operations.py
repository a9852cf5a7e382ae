"""Edge cases of site operations, wording and article operators."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import wording as W
from lectern.operators import articles as A
from lectern.operators import operations as P


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_too_few_texts_are_refused(spark):
    texts = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "id long, text string")
    with pytest.raises(ValueError):
        P.enough(texts, "text")
    assert P.enough(texts, "text", 1).count() == 3


def test_another_founding_year_fails(spark):
    issues = spark.createDataFrame([(1, 1, "1994-01-01"), (2, 1, "1995-01-01")], "volume int, number int, day string").withColumn("day", F.col("day").cast("date"))
    with pytest.raises(Exception, match="founding"):
        A.founded(issues, "volume", "number", "day", 1990).collect()
    assert A.founded(issues, "volume", "number", "day", 1994).count() == 2


def test_priority_pick_takes_the_first_source_with_rows(spark):
    none, some = spark.createDataFrame([], "id long"), spark.createDataFrame([(5,), (5,), (6,)], "id long")
    got = P.priority_pick([("fix", none), ("new", some)], "id").collect()
    assert len(got) == 1 and got[0].reason == "new" and got[0].id in (5, 6)
    assert P.priority_pick([("fix", none), ("new", none)], "id").count() == 0


def test_cascade_follows_two_parents(spark):
    t = {"a": spark.createDataFrame([(1,), (2,)], "k long"), "b": spark.createDataFrame([(1, 10), (2, 20)], "k long, b long"), "c": spark.createDataFrame([(10,), (20,), (30,)], "b long")}
    left = P.cascade(t, t["a"].where("k = 1"), [("a", "k", "b", "k"), ("b", "b", "c", "b")])
    assert {n: sorted(tuple(r) for r in df.collect()) for n, df in left.items()} == {"a": [(2,)], "b": [(20, 2)] if left["b"].columns[0] == "b" else [(2, 20)], "c": [(20,), (30,)]}


def test_served_without_published_neighbours(spark):
    ranked = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 9, 6)], "src long, dst long, rank int")
    row = P.served(ranked, spark.createDataFrame([], "dst long")).first()
    assert (row.served, row.dropped) == ([], [2, 3])


@pytest.mark.parametrize(("said", "want"), [("ON BEING", "On Being"), ("On BEING", "On BEING"), ("IV", "IV"), ("THE ART OF 'Being'", "The Art of 'Being'"), ("1999", "1999"), ("", "")])
def test_normal_caps(spark, said, want):
    assert one(spark, W.normal_caps(F.lit(said))) == want


def test_nulls_stay_null(spark):
    null = F.lit(None).cast("string")
    assert [one(spark, f(null)) for f in (W.spaced_key, W.squash_spaced, W.plain_title, W.title_case, W.normal_caps, W.without_controls, W.without_fences, W.separated_blocks, W.primary_role)] == [None] * 9
    assert one(spark, W.doi_problem(null, null, "10.9/", "x")) == "empty"


def test_an_item_stands_in_one_category(spark):
    items = spark.createDataFrame([("a", 1, "Notes", "A remark on the word."), ("a", 2, "Notes", None), ("a", 3, "Author information", "Tom Lee lectures.")], "article string, position int, heading string, text string")
    got = A.extracted(items, spark.createDataFrame([], "article string, author string")).orderBy("position").collect()
    assert [(r.category, r.position) for r in got] == [("note", 1), ("bio", 3)]


def test_cascade_of_many_rows_states_its_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_A_TASK", 10)
    t = {"a": spark.range(200).withColumnRenamed("id", "k"), "b": spark.range(400).selectExpr("id as b", "id % 200 as k")}
    left = P.cascade(t, t["a"].where("k < 50"), [("a", "k", "b", "k")])
    assert (left["a"].count(), left["b"].count()) == (150, 300)
    assert left["b"].rdd.getNumPartitions() >= 40
