"""Cleaning by section on small articles, and the phrase automaton against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import wording as W
from lectern.operators import routing as G

BLOCKS = "array<struct<tag:string,text:string>>"
BODY = [("h2", "Opening"), ("p", "The room was cold when she came in and she sat down without a word to anyone.")]


@pytest.fixture(scope="module")
def stepped(spark):
    def run(step, blocks, *values):
        names = [f"v{i}" for i in range(len(values))]
        schema = ", ".join([f"b {BLOCKS}", *[f"{n} {'boolean' if isinstance(v, bool) else 'string'}" for n, v in zip(names, values)]])
        x = spark.createDataFrame([(blocks, *values)], schema).select(step(F.col("b"), *[F.col(n) for n in names]).alias("x")).first().x
        return x if x is None else [(b.tag, b.text) for b in x]

    return run


def test_blocks_of_markup(spark):
    html = "Lead<p>a &amp;\n b<br>c</p> between <div><h2>X</h2><blockquote>q</blockquote></div><hr><ul><li>one</li><li>two</li></ul><script>s</script>tail"
    got = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(G.markup_blocks(F.col("h")).alias("b")).collect()
    assert [(b.tag, b.text) for b in got[0].b] == [("p", "Lead"), ("p", "a & b c"), ("p", "between"), ("h2", "X"), ("blockquote", "q"), ("hr", ""), ("li", "one"), ("li", "two"), ("p", "tail")]
    assert got[1].b is None and got[2].b == []


def test_subtitle(stepped):
    assert stepped(G.without_subtitle, [("h2", "A Story of Rooms"), *BODY], "A story of rooms") == BODY
    assert stepped(G.without_subtitle, BODY, "A story of rooms") == BODY and stepped(G.without_subtitle, BODY, None) == BODY
    assert stepped(G.without_subtitle, [], "x") == [] and stepped(G.without_subtitle, None, "x") is None


@pytest.mark.parametrize("line", ["Ann B. Clark and Tom Lee", "ANN CLARK AND TOM LEE", "by Ann Bea Clark, and Tom M. Lee", "Ann Clark and Tom Lee, London"])
def test_authors(stepped, line):
    given = "Ann B. Clark and Tom Lee" if "B." in line else "Ann Clark and Tom Lee"
    assert stepped(G.without_authors, [("p", line), *BODY], given) == BODY
    assert stepped(G.without_authors, [*BODY, ("p", line)], given) == [*BODY, ("p", line)]


def test_authors_without_name(stepped):
    assert stepped(G.without_authors, BODY, "Ann Clark") == BODY and stepped(G.without_authors, BODY, None) == BODY and stepped(G.without_authors, None, "Ann Clark") is None


def test_abstract(stepped):
    said = "It was cold in all of the rooms that we saw."
    head = [("h2", " Abstract "), ("p", said + " So.")]
    assert stepped(G.without_abstract, head + BODY, said) == BODY
    assert stepped(G.without_abstract, BODY + head[1:], said) == BODY + head[1:]
    assert stepped(G.without_abstract, head + BODY, "Too short") == head + BODY and stepped(G.without_abstract, head + BODY, None) == head + BODY


def test_keywords(stepped):
    assert stepped(G.without_keywords, [("h3", "Key words"), ("p", "a, b"), *BODY]) == BODY
    assert stepped(G.without_keywords, [("p", "KEYWORDS: a, b"), *BODY, ("p", "Keywords: c")]) == [*BODY, ("p", "Keywords: c")]
    assert stepped(G.without_keywords, BODY) == BODY and stepped(G.without_keywords, []) == []


def test_contents(stepped):
    assert stepped(G.without_contents, [("h2", "Contents"), ("p", "a"), ("hr", ""), *BODY]) == BODY
    assert stepped(G.without_contents, [("h1", "CONTENTS"), ("p", "a"), ("h2", "Editorial"), *BODY]) == [("h2", "Editorial"), *BODY]
    assert stepped(G.without_contents, [("p", "x"), ("h1", "CONTENTS"), ("p", "a")]) == [("p", "x")] and stepped(G.without_contents, BODY) == BODY


def test_listing_and_reviews(stepped):
    assert stepped(G.without_listing, [("h1", "A Book"), ("p", "A. Writer, 1998. Sage."), BODY[1]]) == BODY[1:]
    assert stepped(G.without_listing, [("h1", "A Book")]) == [] and stepped(G.without_listing, BODY[1:]) == BODY[1:]
    assert stepped(G.without_reviews, [("h2", "Book Reviews"), BODY[1], ("h2", "A Book"), BODY[1]]) == [("h2", "Book Reviews"), BODY[1]]
    assert stepped(G.without_reviews_head, [("h2", "BOOK  REVIEWS"), BODY[1]]) == BODY[1:]


PAGE = [
    ("p", "In this issue we look at The Weight of Rooms and at The Cold House, which both of them deserve and got from us."),
    ("h2", "The Weight of Rooms"), ("p", "A. Writer. London: Sage, 1998."), ("p", "This book is long. Nobody who reads The Cold House by Miller (Sage, 2003) after it will be able to say so easily what it was about."),
    ("h2", "The Cold House"), ("p", "B. Miller. Oxford, 2003."), ("p", "Another."),
]


def test_review_of_a_shared_page(stepped):
    assert stepped(G.book_review, PAGE, "Book Review: The Weight of Rooms", "The Cold House", False) == PAGE[1:4]
    assert stepped(G.book_review, PAGE, "The Weight of Rooms", "The Cold House", True) == PAGE[1:]
    # Prose that names the title and an imprint comes first here; a start needn't be a heading.
    assert stepped(G.book_review, PAGE, "The Cold House / Some Other Book", None, None) == PAGE[3:]
    assert stepped(G.book_review, PAGE, "Not There at All", "The Cold House", False) == PAGE and stepped(G.book_review, PAGE, None, None, None) == PAGE
    paragraphs = [(("p" if tag == "h2" else tag), text + ". London: Sage." if tag == "h2" else text) for tag, text in PAGE]
    assert stepped(G.book_review, paragraphs, "The Weight of Rooms", "The Cold House", False) == paragraphs[1:4]
    # Of two reviews of one book the second must be a heading, as prose may begin with the title too.
    twice = [("h2", "The Cold House"), ("p", "Sage, 2003."), ("p", "The Cold House is about a house of 1950."), ("h2", "The Cold House"), ("p", "Again.")]
    assert stepped(G.book_review, twice, "The Cold House", "The Cold House", False) == twice[:3]
    assert stepped(G.book_review, [], "The Cold House", None, None) == [] and stepped(G.book_review, None, "The Cold House", None, None) is None


def test_four_sections(spark):
    rows = [
        ("Articles", [("p", "x"), ("h1", "A Title of Words"), ("p", "Ann Clark"), ("p", "Keywords: a"), *BODY, ("p", "7")], [*BODY]),
        (None, [("h1", "A Title of Words"), *BODY], BODY), ("Editorial", [("h1", "A Title of Words"), ("p", "Ann Clark"), ("p", "Keywords: a")], [("p", "Keywords: a")]),
        ("Book Review Editorial", [("p", "x"), ("h1", "A Title of Words"), ("p", "Intro."), ("h2", "Another"), ("p", "y")], [("h1", "A Title of Words"), ("p", "Intro.")]),
        ("Book Review", [("p", "x"), ("h1", "A Title of Words"), ("p", "Sage, 2001."), BODY[1]], BODY[1:]), ("Articles", None, None), ("Articles", [], []),
    ]
    df = spark.createDataFrame([(i, s, b, "A Title of Words", None, "Ann Clark", None, None, None) for i, (s, b, _) in enumerate(rows)], f"i int, section string, blocks {BLOCKS}, title string, subtitle string, authors string, abstract string, following string, combined boolean")
    got = {r.i: r.blocks for r in G.cleaned(df, journal="Our Journal").collect()}
    assert [None if got[i] is None else [(b.tag, b.text) for b in got[i]] for i in range(len(rows))] == [w for _, _, w in rows]


def placed(words, phrase, most):
    fits = lambda j, w: (phrase[j] in w) if len(phrase) == 1 else w.endswith(phrase[j]) if j == 0 else w.startswith(phrase[j]) if j == len(phrase) - 1 else w == phrase[j]
    ends = {i for i, w in enumerate(words) if phrase and fits(0, w)}
    for j in range(1, len(phrase)):
        ends = {i for i, w in enumerate(words) if fits(j, w) and any(i - most - 1 <= e < i for e in ends)}
    return min(ends) if ends and phrase else -1


def test_phrases_by_brute_force(spark):
    r = random.Random(9)
    rows = [([r.choice(["a", "b", "ab", "ba", "c"]) for _ in range(r.randint(0, 30))], [r.choice(["a", "b", "c"]) for _ in range(r.randint(0, 5))]) for _ in range(600)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, w array<string>, p array<string>").repartition(8)
    for most in (0, 2, 5):
        got = {x.i: x.e for x in df.select("i", W.phrase_end(F.col("w"), F.col("p"), most).alias("e")).collect()}
        assert got == {i: placed(w, p, most) for i, (w, p) in enumerate(rows)}
