"""The event stream against Python's own parser, on pages and on generated markup, and well-formedness of what was balanced."""

import html
import random
import re
import time
from html.parser import HTMLParser
from pathlib import Path
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lectern.functions import markup as K

PAGES = "/root/testdata/sf0.01/pages.parquet"
PIECES = [
    "<p>", "</p>", "<p class='a > b'>", '<a href="x?a=1&amp;b=2" title="<b>">', "</a>", "<A HREF=plain>", "<br>", "<br/>", "<!-- <p> & -->", "<!---->", "<!DOCTYPE html>", "<?pi x?>", "<![CDATA[ a < b ]]>", "<script>if (a < b && c) { '</p>' }</script>", "<style>p > a { }</style>",
    "<script src='x'/>", "word", " ", "\n", "a < b", "1 <2", "&amp;", "&lt;p&gt;", "&eacute", "&notit;", "&#233;", "&#x1F600;", "&#x80;", "&#0;", "&#1;", "&#xD800;", "&#99999999999;", "&;", "&&", "&unknown;", "AT&T", "&ampx", "</b>", "<b>", "</>", "</ p>", "é", "<i a b=c d = 'e' f=\"\">", "\U0001f600", "&NotEqualTilde;", "x&#x41", "&acE;",
]


class Reader(HTMLParser):
    def __init__(self, source):
        super().__init__()
        self.data, self.tags = [], []
        self.feed(source)
        self.close()

    def handle_data(self, data):
        self.data.append(data)

    def handle_starttag(self, tag, attrs):
        self.tags.append((tag, dict(reversed(attrs)).get("href", "-") if tag == "a" else "-"))

    def handle_endtag(self, tag):
        self.tags.append(("/" + tag, "-"))


@pytest.fixture(scope="module")
def generated(spark):
    r = random.Random(7)
    rows = [(k, "".join(r.choice(PIECES) for _ in range(r.randint(0, 25)))) for k in range(1500)]
    return spark.createDataFrame(rows, "id int, html string").repartition(8)


def described(df):
    e = K.events(F.col("html"))
    return df.select("*", K.plain_text(F.col("html")).alias("text"), F.array_join(K.tokens(F.col("html")), "").alias("same"), F.transform(e, lambda x: F.struct(x["kind"].alias("kind"), x["name"].alias("name"), K.attribute(x["source"], "href").alias("href"))).alias("events"))


def tags(row):
    out = []
    for e in row.events:
        if e.kind in ("start", "empty"):
            out.append((e.name, ("-" if e.href is None else e.href) if e.name == "a" else "-"))
        if e.kind in ("end", "empty"):
            out.append(("/" + e.name, "-"))
    return out


def test_generated_markup_as_the_parser_reads_it(generated):
    for row in described(generated).collect():
        read = Reader(row.html)
        assert row.same == row.html
        assert row.text == "".join(read.data), row.html
        assert tags(row) == [(t, "" if h is None else h) for t, h in read.tags], row.html


@pytest.mark.skipif(not Path(PAGES).exists(), reason="no test data")
def test_pages_as_the_parser_reads_them(spark):
    for row in described(spark.read.parquet(PAGES)).collect():
        read = Reader(row.html)
        assert row.same == row.html and row.text == "".join(read.data) and tags(row) == [(t, "" if h is None else h) for t, h in read.tags]


def test_references(spark):
    names = sorted(html.entities.html5)
    rows = [("&" + n,) for n in names] + [("&" + n.rstrip(";") + "zz",) for n in names] + [(f"&#{c};",) for c in list(range(300)) + [0xFDD0, 0xFFFE, 0xFFFF, 0x10FFFF, 0x110000, 0x1FFFE]] + [("&#x00041;",), ("&#" + "0" * 50 + "65",)]
    for row in spark.createDataFrame(rows, "t string").select("t", K.unescaped(F.col("t")).alias("u")).collect():
        assert row.u == html.unescape(row.t), row.t


def test_nothing_and_cut_off_markup(spark):
    rows = [(None,), ("",), ("a <b",), ("a <!-- b",), ("a <a href='x>y",), ("a <script>b",), ("<",), ("&",)]
    got = spark.createDataFrame(rows, "html string").select(K.plain_text(F.col("html")).alias("t"), K.balanced(F.col("html")).alias("b"), K.links(F.col("html")).alias("l")).collect()
    assert [r.t for r in got] == [None, "", "a ", "a ", "a y", "a b", "<", "&"]
    assert [r.b for r in got] == [None, "", "a ", "a ", "a <a href=\"'x\">y</a>", "a <script>b</script>", "&lt;", "&amp;"]


def test_links(spark):
    rows = [
        ('<p><a href="https://doi.org/10.1/x">10.1/x</a>Next word</p>',), ('<a href="u"><b>la</b>bel</a></b></p><p>After it',), ('<a href="u">x</a> spaced',), ('<a href="u">x</a>',), ('<a href="u">x</a><a href="v">y</a>z',), ("<!-- <a href='c'>c</a> --><a name=q>x</a>.",),
        ('<a href="u">never closed',), ("<a href='a>b'>x</a><!-- c -->&amp;so on",), ("</a></a><a href=k>k</a>\n<p>",),
    ]
    got = [[tuple(x) for x in r.l] for r in spark.createDataFrame(rows, "html string").select(K.links(F.col("html")).alias("l")).collect()]
    assert got == [
        [("https://doi.org/10.1/x", "10.1/x", "Next")], [("u", "label", "After")], [("u", "x", "")], [("u", "x", "")], [("u", "x", "y"), ("v", "y", "z")], [("", "x", ".")], [], [("a>b", "x", "&so")], [("k", "k", "")],
    ]


def test_balanced_markup_is_well_formed_and_keeps_its_text(spark, generated):
    rows = generated.select("html", K.balanced(F.col("html")).alias("b")).collect()
    changed = 0
    for row in rows:
        if re.search(r"&#(?:0|1|x80|xD800|99999999999);|&#x41", row.html):
            continue
        root = ElementTree.fromstring(f"<root>{row.b}</root>")
        dropped = "".join(root.itertext())
        assert re.sub(r"\s", "", html.unescape(dropped)) == re.sub(r"\s", "", html.unescape("".join(Reader(row.html).data))), row.html
        changed += row.b != row.html
    again = spark.createDataFrame([(r.b,) for r in rows], "b string").select("b", K.balanced(F.col("b")).alias("c")).collect()
    assert changed > 300 and all(r.b == r.c for r in again)


def test_nesting(spark):
    rows = {
        "<p><b>x</p>y</b>": "<p><b>x</b></p>y", "<p>a<p>b": "<p>a<p>b</p></p>", "</p>a": "a", "<i><b></i></b>": "<i><b></b></i>", "a<br>b</br>": "a<br/>b", "<p class=x checked>&nbsp;& <": '<p class="x" checked="">\xa0&amp; &lt;</p>', '<p  a="b" >x</p >': '<p  a="b" >x</p>', "<P>x</p>": "<P>x</P>",
    }
    got = spark.createDataFrame([(k,) for k in rows], "h string").select(K.balanced(F.col("h")).alias("b")).collect()
    assert [r.b for r in got] == list(rows.values())


@pytest.mark.parametrize("piece", ["<!--", "<a ='", '<a ="', "<", "<![CDATA[", "</", "&", "&#", "<script>", "<a></a>", "<b>", "x=", "--", "]] ", "<a href=\"x\">y"])
def test_long_texts_take_linear_time(spark, piece):
    df = spark.createDataFrame([(piece * (200_000 // len(piece)),)], "html string")
    began = time.time()
    assert df.select(F.length(K.plain_text(F.col("html"))), F.size(K.links(F.col("html")))).collect()
    assert time.time() - began < 30


def test_page_text_reads_references_without_semicolon_as_its_sql(spark, tmp_path):
    import duckdb
    from lectern.plans import catalog

    pages = [(1, "<title>a &amp</title><p>b &ampc &copy d &amp;lt; &am</p>"), (2, "<p>&quot;x&quo</p>&middot&nbsp;&gt&lt")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, catalog.queries()["page_text"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(con.execute(catalog.oracle_sql()["page_text"]).fetchall())
