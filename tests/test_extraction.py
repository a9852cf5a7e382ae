"""Whole articles into four kinds of back matter; all cases in one run, an article each."""

import pytest

from lectern.operators import articles as A
from lectern.operators import extraction as E

CITED = "Doe, J. (2001). Being and having. London: Sage."
BIO = "Ann Clark is a psychotherapist in private practice in London."
STATED = "This paper was presented at the Annual Conference in London."
CASES = {
    "tail": ([("h2", "References"), ("li", CITED), ("h2", "Opening"), ("p", "Text."), ("h2", "References"), ("p", "ignored, as there are items"), ("li", CITED), ("h2", "Appendix"), ("p", "More.")], [("citation", CITED)]),
    "none": ([("h2", "Opening"), ("p", "Text."), ("p", CITED)], []),
    "labels": ([("h2", "About the Author"), ("p", "She teaches at a school."), ("h2", "Contact"), ("p", "ann@example.org")], [("bio", "She teaches at a school. Contact: ann@example.org")]),
    "under a name": ([("h2", "Opening"), ("p", "x"), ("h2", "Ann Clark"), ("p", "is a psychotherapist in private practice in London.")], [("bio", BIO)]),
    "later": (
        [("p", BIO), ("p", "Text of the article."), ("p", "Contact: lost@example.org"), ("p", "Ann B. Clark is a psychotherapist in private practice in Oxford."), ("p", "Contact: ann@example.org"), ("p", "Contact: b@example.org")],
        [("bio", "Ann B. Clark is a psychotherapist in private practice in Oxford. Contact: ann@example.org Contact: b@example.org")],
    ),
    "outside": (
        [("p", "(1) not yet"), ("p", "Notes: (1) One."), ("p", "Text"), ("p", "(2) Two."), ("p", "Funding statement: none."), ("p", STATED), ("p", None), ("p", " ")],
        [("note", "(1) One."), ("note", "(2) Two."), ("note", "Funding statement: none."), ("provenance", STATED)],
    ),
    "others": ([("p", "Tom Lee is a psychotherapist in private practice in London.")], []), "blank": ([("p", ""), ("h2", None)], []),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, i, tag, text) for name, (blocks, _) in CASES.items() for i, (tag, text) in enumerate(blocks)] + [(None, 1, "p", STATED)]
    by = spark.createDataFrame([(name, "Ann Clark") for name in CASES] + [("tail", None), (None, "x")], "article string, author string")
    got = E.extracted_whole(spark.createDataFrame(rows, "article string, at int, tag string, text string"), by).orderBy("article", "position", "part").collect()
    return {name: [(r.category, r.text) for r in got if r.article == name] for name in (*CASES, None)}


@pytest.mark.parametrize("name", CASES)
def test_whole_articles(found, name):
    assert found[name] == CASES[name][1] and found[None] == []


def test_contacts_under_other_headings_stay_apart(spark):
    rows = [("a", 1, "References", "Contact: x@example.org"), ("a", 2, "Notes", "Email: y@example.org"), ("a", 3, "Notes", "Email: z@example.org")]
    got = A.extracted(spark.createDataFrame(rows, "article string, position int, heading string, text string"), spark.createDataFrame([("a", "Ann Clark")], "article string, author string"))
    assert [r.text for r in got.orderBy("position").collect()] == ["Contact: x@example.org", "Email: y@example.org Email: z@example.org"]
