"""Notes at their markers, spliced lists, run-on biographies, proved edits; on small inputs and against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import notes as T


def best_rise(numbers):
    for n in range(len(numbers), -1, -1):
        for places in itertools.combinations(range(len(numbers)), n):
            picked = [numbers[i] for i in places]
            if all(a < b for a, b in zip(picked, picked[1:])):
                return list(places)


def test_longest_rise_by_brute_force():
    r = random.Random(3)
    for _ in range(300):
        numbers = [r.randint(1, 9) for _ in range(r.randint(0, 9))]
        assert T.longest_rise(numbers) == best_rise(numbers), numbers


def test_matched_notes(spark):
    markers = spark.createDataFrame([("a", 10, 1), ("a", 20, 9), ("a", 30, 2), ("a", 40, 2), ("a", 50, 3), ("a", 60, 77), ("b", 1, 1), (None, 1, 1), ("a", 70, None), ("a", 50, 3)], "article string, position int, number int")
    notes = spark.createDataFrame([("a", 1, "one"), ("a", 2, "two"), ("a", 2, "again"), ("a", 3, None), ("a", 9, "nine"), ("c", 1, "lone"), (None, 1, "x")], "article string, number int, text string")
    got = sorted((tuple(r) for r in T.matched_notes(markers, notes).collect()), key=str)
    assert got == sorted([("a", 1, 10, "one", "matched"), ("a", 2, 30, "again", "matched"), ("a", 3, 50, None, "matched"), ("a", 9, None, "nine", "unplaced"), ("c", 1, None, "lone", "unplaced"), ("a", 9, 20, None, "unknown"), ("a", 2, 40, None, "unknown"), ("a", 77, 60, None, "unknown"), ("b", 1, 1, None, "unknown")], key=str)
    assert T.matched_notes(markers.where("false"), notes.where("false")).collect() == []


@pytest.mark.parametrize(("blocks", "want"), [
    ([("h2", "Notes"), ("li", "x")], [("h2", "Notes"), ("li", "n1"), ("li", "n2")]), ([("h2", "Notes"), ("li", "x"), ("li", "y")], [("h2", "Notes"), ("li", "x"), ("li", "y")]), ([("p", "b")], [("p", "b"), ("h2", "Notes"), ("li", "n1"), ("li", "n2")]), ([], [("h2", "Notes"), ("li", "n1"), ("li", "n2")]),
    ([("p", "b"), ("h2", "References"), ("li", "r")], [("p", "b"), ("h2", "Notes"), ("li", "n1"), ("li", "n2"), ("h2", "References"), ("li", "r")]), ([("h2", "Notes"), ("p", "1 old"), ("p", "kept"), ("h2", "X"), ("li", "z")], [("h2", "Notes"), ("li", "n1"), ("li", "n2"), ("p", "kept"), ("h2", "X"), ("li", "z")]), (None, None),
])
def test_spliced(spark, blocks, want):
    df = spark.createDataFrame([(blocks, ["n1", "n2"])], "b array<struct<tag:string,text:string>>, n array<string>")
    x, y = df.select(T.spliced_notes(F.col("b"), F.lit("Notes"), F.col("n")), T.spliced_notes(F.col("b"), F.lit("Notes"), F.array().cast("array<string>"))).first()
    assert (None if x is None else [tuple(b) for b in x]) == want and (None if y is None else [tuple(b) for b in y]) == blocks


def test_runon_bios(spark):
    rows = {
        "Prose. <bold>Ann</bold> writes.Contact: a@b.org <bold>Tom</bold> too. orcid.org/0009-1This was read.": ("Prose.", ["Ann writes. Contact: a@b.org", "Tom too. orcid.org/0009-1"], "This was read.", False),
        "<bold>Not</bold> yet <bold>Ann</bold> Contact: x": ("<bold>Not</bold> yet", ["Ann Contact: x"], None, False), "No contact <bold>x</bold>": None, "Contact: none bold": None, "": None, None: None, "a<bold>b</bold>Contact: " + "c" * 2500: ("a<bold>b</bold>Contact: " + "c" * 2500, [], None, True),
    }
    got = spark.createDataFrame([(k,) for k in rows], "p string").select(T.runon_bios(F.col("p")).alias("r")).collect()
    assert [None if x.r is None else tuple(x.r) for x in got] == list(rows.values())


def test_common_start_by_brute_force(spark):
    r = random.Random(5)
    rows = [("".join(r.choice("ab") for _ in range(r.randint(0, 12))), "".join(r.choice("ab") for _ in range(r.randint(0, 12)))) for _ in range(300)] + [("x" * 70_000 + "a", "x" * 70_000 + "b")]
    got = spark.createDataFrame(rows, "a string, b string").select(T.common_start(F.col("a"), F.col("b")).alias("n")).collect()
    assert [x.n for x in got] == [next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b))) for a, b in rows]


def test_proved_edit(spark):
    rows = [("Café au lait", "CAFE  au-lait", ("CAFE  au-lait", False, None, None, None)), ("one two", "one too", ("one two", True, 4, "onetwo", "onetoo")), (None, "", ("", False, None, None, None)), ("ab", None, ("ab", True, 0, "ab", "")), ("", "b", ("", True, 0, "", "b"))]
    got = T.proved_edit(spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string"), "a", "b").select("edit").collect()
    assert [tuple(x.edit) for x in got] == [w for _, _, w in rows]
