"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from lectern.plans import catalog

DATA = "/root/testdata/sf0.001"


def value(v):
    return round(v, 6) if isinstance(v, float) else v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).iterdir():
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    found = catalog.queries()[name](spark, DATA)
    cols = sorted(found.columns)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    ours = sorted((tuple(value(r[c]) for c in cols) for r in found.collect()), key=str)
    theirs = sorted((tuple(value(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert ours == theirs


def test_word_overlap_works_out_its_arguments_once(spark):
    from pyspark.sql import functions as F

    from lectern.functions import text as X

    rows = [("a b a", "b c"), ("b c", "a b c d"), ("", "a"), ("a", ""), (None, "a"), ("a", None), (" ab  b", "abb b"), ("a", "ab ba")]
    df = spark.createDataFrame(rows, "a string, b string")
    long = lambda c: F.regexp_replace(c, "zz", "")
    found = df.select("a", "b", X.word_overlap(long(F.col("a")), long(F.col("b"))).alias("o"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2
    assert [x.o for x in found.collect()] == pytest.approx([1 / 3, 1.0, None, 0.0, None, 0.0, 0.5, 1.0])


def test_title_keys_keep_words_apart_as_the_reference_does(spark, tmp_path):
    import hashlib
    import re

    import duckdb
    import pandas as pd

    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [*(f"Być{b}i Čas" for b in blanks), "A & B&C", "Être_là, (2024)! naïve\u00a0\u2009x", "漢字\u3000①½", "e\u0301a\u200bb", "\u00a0", "", None]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    spark.createDataFrame(docs).write.parquet(f"{tmp_path}/documents.parquet")
    # The reference's _normalise_title (backfill/lib/crossref.py:396-402).
    rule = lambda x: x if x is None else hashlib.md5(re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", x.lower().replace("&", "and"))).strip().encode()).hexdigest()
    got = {r.doc_id: r.title for r in catalog.queries()["title_keys"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = {r[0]: r[1] for r in con.sql(catalog.oracle_sql()["title_keys"]).fetchall()}
    assert len(blanks) > 20 and got == sql == {d: rule(x) for d, x in enumerate(texts)}
