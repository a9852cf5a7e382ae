"""Identifier matching on examples of each rule; the catalog's oracles cover whole tables."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import identifiers as D

OWN = r"\bLectern\s+Papers\b"
SCHEMA = "id long, text string, title string, container string, kind string, score double, families array<string>, doi string"
REF = "Holm, K. (1990). Care and time. London: Sage."
OURS = "Holm, K. (1990). Care and time. Lectern Papers, 3."
FOUND = [
    (1, REF, "Care and Time", None, "book", 25.0, ["Hölm"], "10.1/a"),
    (1, REF, "Care and Time", None, "journal-article", 90.0, ["Holm"], "10.1/b"),
    (2, REF, "Care and Time", None, "book", 19.0, None, "10.1/a"),
    (3, REF, "Care and Time", "Handbook of Care", "book", 90.0, ["van Holm"], "10.1/a"),
    (4, REF, "Care and Time", None, "book", 90.0, ["Zander"], "10.1/a"),
    (5, OURS, "Care and time", "Lectern Papers", "journal-article", 1.0, ["Holm"], "10.1/b"),
    (5, OURS, "Care and time", "Lectern Papers", "journal-article", 1.0, ["Holm"], "10.1/a"),
    (6, None, None, None, None, None, [], None),
]


@pytest.fixture(scope="module")
def found(spark):
    return D.judged(spark.createDataFrame(FOUND, SCHEMA), OWN)


def test_verdicts_and_best(found):
    got = {r.id: (r.matched, r.own_match, r.doi) for r in D.best_match(found, "id").collect()}
    assert got == {1: (True, False, "10.1/a"), 2: (False, False, "10.1/a"), 3: (False, False, "10.1/a"), 4: (False, False, "10.1/a"), 5: (True, True, "10.1/a"), 6: (False, False, None)}


def test_container_rule(spark):
    rows = [(REF, "Biologicals", 10.0), (REF, "Biologicals", 50.0), (REF, "Care Reports", 10.0), (REF, "The Vol", 10.0), (REF, None, 10.0), (None, "Biologicals", 10.0)]
    got = [r.x for r in spark.createDataFrame(rows, "t string, c string, s double").select(D.container_mismatch(F.col("t"), F.col("c"), F.col("s")).alias("x")).collect()]
    assert got == [True, False, False, False, False, False]


def test_authors(spark):
    rows = [(REF, ["Holm"]), ("Kochunas, R. Care", ["Kočiunas"]), ("Dorn, E. van. Care", ["van Dorn"]), ("Care", ["Xy"]), (None, ["Holm"]), ("Care", [])]
    got = [r.x for r in spark.createDataFrame(rows, "t string, f array<string>").select(D.author_match(F.col("t"), F.col("f")).alias("x")).collect()]
    assert got == [True, True, True, False, False, True]


def test_variants(spark):
    led = "4. Fry, G. (eds.) (2000). A preface. In Holm, K. Care and time. Quill Press. 10.1234/x"
    noisy = "Holm, K. (1990). Care and time [1947]. Trans. Fry, G."
    got = [r.v for r in spark.createDataFrame([(led,), (noisy,), ("",), (None,)], "t string").select(D.query_variants(F.col("t")).alias("v")).collect()]
    assert got[0][0] == "Fry, G. (eds.) (2000). A preface. In Holm, K. Care and time. Quill Press."
    assert "Holm, K. Care and time. Quill Press." in got[0] and "Holm Care and time" in got[0] and len(got[0]) <= 5
    assert got[1] == [noisy, "Holm, K. (1990). Care and time .", "Holm Care and time [1947]"]
    assert got[2] == [""] and got[3] is None


def test_cache_goes_by_text(spark):
    refs = spark.createDataFrame([("a", 2, "x"), ("a", 3, "y"), ("b", 1, "x"), ("a", 4, None)], "article string, ref_id int, text string")
    cache = spark.createDataFrame([("a", "x", "10.1/b", True, None, 9.0), ("a", "x", "10.1/a", True, None, 9.0), ("a", "y", "10.1/c", True, "Biologicals", 9.0)], "article string, text string, doi string, matched boolean, container string, score double")
    got = {(r.article, r.ref_id): (r.cached, r.doi, r.matched) for r in D.from_cache(refs, cache).collect()}
    assert got == {("a", 2): (True, "10.1/a", True), ("a", 3): (True, "10.1/c", False), ("b", 1): (False, None, False), ("a", 4): (False, None, False)}
