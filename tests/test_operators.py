"""Edge cases of the relational, reconciliation and text operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import reconcile as R
from lectern.operators import rows as O

D = dt.datetime


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_band_is_half_open_and_comes_before_the_cut(spark):
    df = spark.createDataFrame([(1, 2, 0.95), (1, 3, 0.4), (1, 4, 0.94), (1, 5, 0.39)], "src long, dst long, score double")
    assert [(r.dst, r.rank) for r in O.band_topk(df, "src", "dst", "score", 0.4, 0.95, 2).orderBy("rank").collect()] == [(4, 1), (3, 2)]


def test_missing_end_dominates(spark):
    s = lambda rows: spark.createDataFrame(rows, "user_id long, type string, date_start timestamp, date_end timestamp")
    got = R.entitlements([s([(1, "a", D(2024, 1, 2), None)]), s([(1, "b", D(2024, 1, 1), D(2030, 1, 1)), (2, "b", D(2024, 1, 1), D(2025, 1, 1))])]).orderBy("user_id").collect()
    assert [(r.type, r.date_start, r.date_end) for r in got] == [("a", D(2024, 1, 1), None), ("b", D(2024, 1, 1), D(2025, 1, 1))]


def test_upsert_only_extends_active_rows(spark):
    s = lambda rows: spark.createDataFrame(rows, "key long, type string, date_end timestamp")
    old = s([(1, "a", D(2030, 1, 1)), (2, "a", D(2020, 1, 1)), (3, "a", None)])
    new = s([(1, "b", D(2025, 1, 1)), (2, "b", D(2021, 1, 1)), (3, "b", D(2031, 1, 1)), (4, "b", None)])
    got = {r.key: (r.type, r.date_end) for r in R.monotone_upsert(old, new, F.lit(D(2024, 1, 1))).collect()}
    assert got == {1: ("b", D(2030, 1, 1)), 2: ("b", D(2021, 1, 1)), 3: ("b", None), 4: ("b", None)}


def test_empty_scope_is_refused(spark):
    df = spark.createDataFrame([(1, "x")], "key long, v string")
    with pytest.raises(ValueError):
        R.replaced_scope(df, df, df.where("key > 1").select("key"), ["key"])


def test_block_equal_to_the_kept_one_before_it_goes(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, " a"), (1, 2, "b"), (1, 3, "a")], "d long, pos int, b string")
    assert [r.pos for r in O.changed_blocks(df, "d", "pos", "b").orderBy("pos").collect()] == [0, 2, 3]


@pytest.mark.parametrize("ip, block, inside", [("10.0.7.17", "10.0.7.16/28", True), ("10.0.7.32", "10.0.7.16/28", False), ("10.0.7.300", "10.0.7.0/24", False), ("::1", "::1", True), ("1.2.3.4", "1.2.3.4/40", False), ("1.2.3.4", "0.0.0.0/0", True)])
def test_cidr(spark, ip, block, inside):
    assert one(spark, X.in_cidr(F.lit(ip), block)) is inside


def test_dates_names_and_identifiers(spark):
    assert str(one(spark, X.partial_date(F.lit("January 2026")))) == "2026-01-01" and str(one(spark, X.partial_date(F.lit("1991")))) == "1991-07-01"
    assert one(spark, X.strict_date(F.lit("2024-02-30"))) is False and one(spark, X.strict_date(F.lit("2024-02-29"))) is True
    assert tuple(one(spark, X.person(F.lit("Ludwig van Beethoven")))) == ("Ludwig", "van Beethoven") and tuple(one(spark, X.person(F.lit("Plato")))) == ("", "Plato")
    assert one(spark, X.first_doi(F.lit("see 10.1234/abc.5]). next"))) == "10.1234/abc.5" and one(spark, X.first_doi(F.lit("none"))) is None
    assert one(spark, X.bylines(F.lit("A B & C D, E F and G H"))) == ["A B", "C D", "E F", "G H"]
    assert one(spark, X.title_similarity(F.lit("being"), F.lit("being and time"))) == 0.5
