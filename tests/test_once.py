"""What is dear is worked out once a row: no filter repeats it below its projection."""

import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from lectern.functions import names as N
from lectern.operators import articles as A
from lectern.operators import jats as J
from lectern.operators import sequences as S


def test_kind_of_an_item_is_no_filter(spark):
    items = spark.createDataFrame([(1, 1, "Notes", "A note.")], "article long, position int, heading string, text string")
    found = A.extracted(items, spark.createDataFrame([(1, "Ann Clark")], "article long, author string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [line for line in plan if "Filter " in line and "drop" in line]
    assert [tuple(r) for r in found.collect()] == [(1, "note", 1, 0, "A note.")]


def test_python_sees_numbers_and_characters_only(spark):
    texts = ["", "plain", "Ünïcödé ﬁnal ½ İ \u212a ς Ångström e\u0301", "Привет 한국 漢字 ①② \U0001d4d0", "a\u0301\u0327b", "\ufdfa x"]
    df = spark.createDataFrame(pd.DataFrame({"t": texts})).select("t", N.folded_text(F.col("t")).alias("g"))
    fold = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    assert [(r.t, r.g) for r in df.collect()] == [(x, fold(x)) for x in texts]
    lines = spark.createDataFrame([(["0 x", "1 a", None, " b\x1c c ", "٢ d", "03 e", "5 f", "4", "47 g"],), (["1 a", "2 b"],), (None,)], "l array<string>")
    assert [r[0] for r in lines.select(S.numbered_items("l")).collect()] == [["a b c", "d", "e 5 f 4 47 g"], None, None]
    # The texts themselves stay out of what Python is sent.
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "folded(t#" not in plan and "folded(array_join(array_distinct(" in plan.replace("folded(pythonUDF", "")


def test_articles_are_read_and_balanced_once_each_way(spark):
    rows = [(1, "<h2>A</h2><blockquote>b</blockquote><ul><li><p>c</p></li></ul><h3>D</h3>e"), (2, None), (3, ""), (None, "<p>x</p>"), (None, "<p>y</p>")]
    there = J.to_jats(spark.createDataFrame(rows, "k int, h string"), "k", "h")
    found = J.to_html(there, "k", "jats")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and plan.count("ArrowEvalPython") == 2
    want = {1: "<h2>A</h2>\n<blockquote>b</blockquote>\n<ul><li>c</li>\n</ul>\n<h3>D</h3>\n\ne", 2: None, 3: ""}
    got = found.collect()
    assert {r.k: r.html for r in got if r.k} == want and sorted((r.h, r.jats, r.html) for r in got if r.k is None) == [("<p>x</p>", "", ""), ("<p>y</p>", "", "")]
