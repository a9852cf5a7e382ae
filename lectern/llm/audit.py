"""Filter interaction audit: which of five quality filters removes which documents, in all orders of applying them.

Words are a relation: one row a word, aggregated by (document, word) and then by document to its counts of words and of
distinct words. The flags of the other filters come by outer joins, and 32 conditional counts a part (one for each set of
failing filters; as many for good and for toxic documents) hold all that any order of the filters needs.

A document is (id, SHA-256 of its text), so repeated ids don't mix. Its words stay together with the number of the scan
partition, as rows that repeat id and text a thousandfold would else be one task; counts of words are divided by the
number of such rows. The joins' sides hold no texts, and Spark splits a hot text's rows in the join on texts, as one row
of the other side belongs to it.

Defined cases: a null text is an empty one; a null source is the part '' (as an empty source is); a row without id counts
as one whose id is larger than all others; repeated rows count each; an id with several rows of labels is good (toxic) if
any of them says so; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import NO_ID, clean

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
#: What separates words, and the symbols that filter D looks for.
BREAKS, SYMBOLS = "[\\x20\\x09-\\x0D]+", "[#$%&*|]"
SETS, ORDERS = 1 << len(FILTERS), factorial(len(FILTERS))


def word_counts(docs: DataFrame) -> DataFrame:
    """(id, text_key, words, distinct_words) of an (id, text_key, text) table; documents without words have no row.

    Of rows that repeat id and text the words are counted together.
    """
    keys = ("id", "text_key", "scan")
    texts = docs.select("id", "text_key", F.spark_partition_id().alias("scan"), "text").repartition(*keys)
    words = texts.select(*keys, F.explode(F.split("text", BREAKS)).alias("word")).where("word <> ''")
    by_word = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    by_row = by_word.groupBy(*keys).agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("distinct_words"))
    return by_row.groupBy("id", "text_key").agg(F.sum("words").alias("words"), F.max("distinct_words").alias("distinct_words"))


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, rows): documents by part, set of failing filters (bit 0 for A) and labels."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), F.coalesce(F.col("carry0").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("text_key"))
    capitals = F.char_length("text") - F.char_length(F.regexp_replace("text", "[A-Z]+", ""))
    others = keyed.select(
        "id", "part", "text_key", (100 * capitals.cast("long") > CAPITAL_PERCENT * F.char_length("text").cast("long")).alias("c"), F.col("text").rlike(SYMBOLS).alias("d")
    ).groupBy("id", "text_key", "part", "c", "d").agg(F.count(F.lit(1)).alias("rows"))
    same = keyed.select("id", "text_key").groupBy("text_key").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("last_id > first_id").select("text_key", "first_id")
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), *[F.coalesce(F.col(c).cast("int") == 1, F.lit(False)).alias(to) for c, to in (("quality", "good"), ("toxic", "bad"))])
    marks = marks.where("id is not null").groupBy("id").agg(F.max("good").alias("good"), F.max("bad").alias("bad"))
    counted = word_counts(keyed.select("id", "text_key", "text")).join(others.groupBy("id", "text_key").agg(F.sum("rows").alias("copies")), ["id", "text_key"])
    lengths = counted.select("id", "text_key", F.expr("words div copies").alias("words"), "distinct_words")
    joined = others.join(lengths, ["id", "text_key"], "left").join(marks, "id", "left").join(same, "text_key", "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    failing = (words < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * words, F.col("c"), F.col("d"), F.coalesce(F.col("id") > F.col("first_id"), F.lit(False)))
    bits = [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failing)]
    return joined.select("part", sum(bits[1:], bits[0]).alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("toxic"), "rows")


def conditional_counts(flagged: DataFrame) -> DataFrame:
    """One row a part: `docs`, `good`, `toxic` are arrays of the 32 counts, one for each set of failing filters."""
    kinds = {"docs": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = [F.sum(F.when((F.col("fails") == k) & chosen, F.col("rows")).otherwise(0)).alias(f"{kind}{k}") for kind, chosen in kinds.items() for k in range(SETS)]
    return flagged.groupBy("part").agg(*counts).select("part", *[F.array(*[f"{kind}{k}" for k in range(SETS)]).alias(kind) for kind in kinds])


def _letters() -> Column:
    return F.filter(F.split("filter_order", ""), lambda x: x != "")


def _bit(letter: Column) -> Column:
    """1 for A, 2 for B, 4 for C, …"""
    return F.element_at(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), F.ascii(letter) - (ord("A") - 1))


def _total(counts: str, wanted) -> Column:
    """Sum of the counts whose set of failing filters is wanted."""
    return F.aggregate(F.transform(counts, lambda n, k: F.when(wanted(k), n).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, n: a + n)


def interactions(counts: DataFrame) -> DataFrame:
    """One row a part, order of the filters and step, from the conditional counts."""
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    steps = counts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).select("*", F.posexplode(_letters()).alias("at", "letter"))
    earlier = F.aggregate(F.slice(_letters(), F.lit(1), F.col("at")), F.lit(0), lambda a, x: a + _bit(x))
    steps = steps.withColumn("bit", _bit(F.col("letter"))).withColumn("before", earlier)
    fails, left = lambda k: k.bitwiseAND(F.col("bit")) != 0, lambda k: k.bitwiseAND(F.col("before")) == 0
    here = lambda k: fails(k) & left(k)
    # Of k filters that a document fails, each comes first in 120 / k of the 120 orders.
    firsts = F.array(*[F.lit(ORDERS // k) for k in range(1, len(FILTERS) + 1)])
    weighted = F.transform("docs", lambda n, k: F.when(fails(k), n * F.element_at(firsts, F.greatest(F.bit_count(k), F.lit(1)))).otherwise(F.lit(0).cast("long")))
    shares = F.aggregate(weighted, F.lit(0).cast("long"), lambda a, n: a + n)
    return steps.select(
        "part", "filter_order", (F.col("at") + 1).cast("int").alias("step"),
        _total("docs", lambda k: left(k) & ~fails(k)).alias("kept"), _total("docs", here).alias("removed"), _total("docs", lambda k: fails(k) & ~left(k)).alias("redundant"),
        _total("docs", lambda k: k == F.col("bit")).alias("unique_fails"), _total("good", here).alias("good_lost"), _total("toxic", here).alias("toxic_lost"), shares.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The interactions of the five filters over whole texts, one row a part, order and step."""
    return interactions(conditional_counts(flags(clean(docs, id_col, text_col, (part_col,)), labels)))
