"""Cleaning of block arrays on small articles."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import blocks as B

BODY = [("p", "The room was cold when she came in and she sat down without a word to anyone."), ("p", "Then it was warm.")]


@pytest.fixture(scope="module")
def cleaned(spark):
    def run(rule, blocks, *titles):
        names = [f"t{i}" for i in range(len(titles))]
        schema = ", ".join(["b array<struct<tag:string,text:string>>", *[f"{n} string" for n in names]])
        x = spark.createDataFrame([(blocks, *titles)], schema).select(rule(F.col("b"), *[F.col(n) for n in names]).alias("x")).first().x
        return x if x is None else [(b.tag, b.text) for b in x]

    return run


def test_title_goes(cleaned):
    head = [("h1", "The Weight"), ("p", "of Cold Rooms")]
    assert cleaned(B.without_title, head + BODY, "The Weight of Cold Rooms") == BODY
    assert cleaned(B.without_title, BODY, "Something Else Entirely") == BODY
    assert cleaned(B.without_title, BODY, None) == BODY
    assert cleaned(B.without_title, [], "Title") == [] and cleaned(B.without_title, None, "Title") is None


def test_start(cleaned):
    before = [("p", "The end of another piece.")]
    head = [("h2", "The Weight of Rooms")]
    assert cleaned(B.from_title, before + head + BODY, "Obituary: The Weight of Rooms (part 1)") == head + BODY
    assert cleaned(B.from_title, before + BODY, "Not There") == before + BODY
    assert cleaned(B.from_title, before + BODY, "In") == before + BODY


def test_end(cleaned):
    refs = [("h2", "References"), ("p", "Holm, K. (1990). Care and Time. Sage.")]
    rest = [("h2", "Care and also Time"), ("p", "It begins.")]
    assert cleaned(B.until_next, BODY + refs + rest, "Rooms", "Care and Time") == BODY + refs
    assert cleaned(B.until_next, BODY + refs, "Rooms", "Care and Time") == BODY + refs
    assert cleaned(B.until_next, BODY + [("p", "* Care and Time, by K. Holm")], "Rooms", "Care and Time") == BODY
    assert cleaned(B.until_next, BODY + rest, "Care and Time", "Care & and time") == BODY + rest
    assert cleaned(B.until_next, BODY + rest, "Rooms", None) == BODY + rest


def test_furniture(cleaned):
    blocks = [("p", "82"), ("h2", "1990"), ("p", "Papers 3.1: May 1990"), ("p", "82 Papers 3.1: May 1990 The room"), ("p", None)]
    assert cleaned(lambda b: B.without_furniture(b, "Papers"), blocks) == [("h2", "1990"), ("p", "The room"), ("p", None)]


def test_warnings(spark):
    text = "The weight of rooms. " * 10
    rows = [(1, text, text, "The Weight of Rooms", "Articles"), (2, text, text, "Quite Other Words", "Articles"), (3, text, "short", "Gone Things / Lost Ones", "Book Reviews"), (4, None, None, None, None), (5, "Editorial " + text, text, "Quite Other Words", None)]
    d = spark.createDataFrame(rows, "i int, r string, f string, t string, s string")
    got = {r.i: r.w for r in d.select("i", B.warnings(F.col("r"), F.col("f"), F.col("t"), F.col("s")).alias("w")).collect()}
    assert got == {1: [], 2: ["TITLE_NOT_IN_RAW"], 3: ["TITLE_NOT_IN_RAW", "BOOK_TITLE_MISSING", "EMPTY_OUTPUT"], 4: ["EMPTY_OUTPUT"], 5: []}
