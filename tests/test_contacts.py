"""Contact lines of biographies, rule by rule."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import contacts as P


@pytest.mark.parametrize(("rule", "html", "want"), [
    (P.spaced_breaks, "<p>writer.<br/>Contact: a@b.org<br>https://o.org</p>", "<p>writer. Contact: a@b.org. https://o.org</p>"), (P.spaced_breaks, "<p>a@b.org <br>c<br> d<br>e</p>", "<p>a@b.org c d e</p>"), (P.spaced_breaks, "<p>verse<br>verse</p>", "<p>verse<br>verse</p>"),
    (P.spaced_breaks, "<p>a@b.org<br><em>x</em></p><br>", "<p>a@b.org<br><em>x</em></p><br>"), (P.parted_addresses, "<p>a@b.orghttps://x.y</p>a@b.orghttps://x.y", "<p>a@b.org. https://x.y</p>a@b.orghttps://x.y"),
    (P.split_bios, "<p>Soul. <strong>Ann</strong> writes.Contact: a@b.org</p>", "<p>Soul.</p><p><strong>Ann</strong> writes. Contact: a@b.org</p>"), (P.split_bios, "<p><strong>Ann</strong> a@b.org</p>", "<p><strong>Ann</strong> a@b.org</p>"),
    (P.split_bios, "<p>Soul.<strong>Ann</strong> x <strong>Tom</strong> t@b.org</p>", "<p>Soul.</p><p><strong>Ann</strong> x</p><p><strong>Tom</strong> t@b.org</p>"), (P.split_bios, "<p>A <strong>bold</strong> word</p>", "<p>A <strong>bold</strong> word</p>"), (P.split_bios, None, None), (P.spaced_breaks, "", ""),
])
def test_rule(spark, rule, html, want):
    assert spark.createDataFrame([(html,)], "h string").select(rule(F.col("h"))).first()[0] == want


@pytest.mark.parametrize(("html", "want"), [
    ("<p>a@b.org ORCID iD: https://www.orcid.org/0000-1. More</p>", "<p>a@b.org More</p>"), ("<p>x 0000-1 , y</p>", "<p>x, y</p>"), ('<p id="0000-1">0000-2</p>', '<p id="0000-1">0000-2</p>'), ("<p>x  y</p>", "<p>x  y</p>"), (None, None),
])
def test_recorded_identifiers(spark, html, want):
    df = spark.createDataFrame([(html, ["https://orcid.org/0000-1/", None, ""])], "h string, o array<string>")
    assert df.select(P.without_recorded(F.col("h"), F.col("o"))).first()[0] == want
    assert df.select(P.without_recorded(F.col("h"), F.array().cast("array<string>"))).first()[0] == html
