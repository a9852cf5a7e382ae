"""Benchmark decontamination: a positional inverted index in DataFrame operations only.

The index holds postings (term, id, pos) of training tokens. A benchmark phrase is looked up from its two rarest terms:
their lists, shifted by the terms' offsets in the phrase, are intersected on (document, start), and what remains is
checked word by word. Only the terms that a lookup needs are posted, as no other list would be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.llm.common import carried, clean, stored

WINDOW = 10
#: Tables of up to this many benchmark terms go to every executor; larger ones are met in a shuffle join.
BROADCAST_TERMS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what separates words (all of ASCII but letters and digits).
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Words of a text in order, A-Z in lower case; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), lambda w: w != "")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


def tokens(docs: DataFrame) -> DataFrame:
    """(id, term, pos) of an (id, words) table."""
    return docs.select("id", F.posexplode("words").alias("pos", "term"))


def postings(docs: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """The index: (term, id, pos) of all tokens that are one of `terms` (a table of `rows` distinct terms)."""
    return tokens(docs).join(small(terms.select("term"), rows), "term")


def windows(bench: DataFrame, size: int) -> DataFrame:
    """Distinct windows (key, phrase, items) of an (id, words) benchmark; an item of fewer words, but not none, is one window."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    each = bench.where(F.size("words") > 0).select("id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("phrase"))
    return each.groupBy("phrase").agg(F.sort_array(F.collect_set("id")).alias("items")).select(F.xxhash64("phrase").alias("key"), "phrase", "items")


def lookups(found: DataFrame, counts: DataFrame, rows: int) -> DataFrame:
    """(key, term, off, rank, roles): the one or two rarest terms of each window, at their first offsets, with the number of these."""
    each = found.select("key", F.posexplode("phrase").alias("off", "term")).groupBy("key", "term").agg(F.min("off").alias("off"))
    each = each.join(small(counts, rows), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("n", "off"))
    best = each.withColumn("rank", rank).where("rank <= 2")
    return best.withColumn("roles", F.count(F.lit(1)).over(Window.partitionBy("key"))).select("key", "term", "off", "rank", "roles")


def proximity(index: DataFrame, one: str, two: str, most: int) -> DataFrame:
    """(id, pos, other): places of `one` with a `two` at most `most` words away, in either order, from the two lists."""
    a = index.where(F.col("term") == one).select("id", "pos")
    b = index.where(F.col("term") == two).select("id", F.col("pos").alias("other"))
    # Blocks of most + 1 words: a near pair stands in the same block or in neighbouring ones.
    a = a.select("id", "pos", F.explode(F.array(*[F.expr(f"pos div {most + 1}") + k for k in (-1, 0, 1)])).alias("block"))
    b = b.withColumn("block", F.expr(f"other div {most + 1}"))
    return a.join(b, ["id", "block"]).where(F.abs(F.col("pos") - F.col("other")).between(0 if one != two else 1, most)).select("id", "pos", "other")


def occurrences(docs: DataFrame, bench: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(all windows, candidates): candidates (id, key, start) hold a window's rarest terms at the right distance.

    docs and bench are (id, words) tables.
    """
    found = stored(windows(bench, size), "windows")
    vocabulary = stored(found.select(F.explode("phrase").alias("term")).distinct(), "terms")
    rows = vocabulary.count()
    counts = stored(postings(docs, vocabulary, rows).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "counts")
    asked = stored(lookups(found, counts, rows), "lookups")
    listed = postings(docs, asked.select("term").distinct(), rows)
    # Shifted lists: a posting of a rare term at pos votes for each of its windows at pos - off. Each term has a bit, as rows that repeat id and text post it again.
    shifted = listed.join(small(asked, asked.count()), "term").select("id", "key", (F.col("pos") - F.col("off")).alias("start"), "rank", "roles")
    met = shifted.where("start >= 0").groupBy("id", "key", "start").agg(F.bit_or("rank").alias("votes"), F.max("roles").alias("roles"))
    # Ranks 1 and 2 are bits of their own: 1 stands for one term, 3 for both.
    return found, met.where("votes = 2 * roles - 1").select("id", "key", "start")


def contamination(docs: DataFrame, bench: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of items with an occurring window, sorted), hits (array of [start, end) word
    intervals of occurrences) of every row. A word inside any occurrence of a window is hit. A null text has no words; an
    item without words has no window; a null item id is left out of items. Rows of equal id are told apart. Columns named in `carry` come along.
    """
    plain = clean(docs, id_col, text_col).withColumn("words", words(F.col("text")))
    # Rows are known by a fingerprint of id and text, so that equal ids with different texts stay apart.
    keyed = plain.select(F.xxhash64("id", "text").alias("id"), "words")
    found, candidates = occurrences(keyed, bench.select(F.col(f"`{item_col}`").alias("id"), words(F.col(f"`{text_col}`").cast("string")).alias("words")), size)
    n = found.count()
    phrases = found.select("key", "phrase", "items")
    per_doc = candidates.join(small(phrases, 10 * n), "key").groupBy("id").agg(F.collect_set(F.struct("start", "phrase", "items")).alias("spots"))
    rows = clean(docs, id_col, text_col, carry).withColumn("key", F.xxhash64("id", "text"))
    extra = [f"carry{k}" for k in range(len(carry))]
    both = rows.join(per_doc.withColumnRenamed("id", "key"), "key", "left").select("id", words(F.col("text")).alias("words"), "spots", *extra)
    true = F.filter("spots", lambda s: F.slice("words", s["start"] + 1, F.size(s["phrase"])) == s["phrase"])
    both = both.select("id", F.size("words").cast("long").alias("n_words"), true.alias("spots"), *extra)
    none = F.array().cast(T.ArrayType(bench.schema[item_col].dataType))
    hit = F.array_distinct(F.flatten(F.transform("spots", lambda s: F.sequence(s["start"], s["start"] + F.size(s["phrase"]) - 1))))
    items = F.array_distinct(F.flatten(F.transform("spots", lambda s: s["items"])))
    spans = F.sort_array(F.transform("spots", lambda s: F.struct(s["start"].cast("long").alias("start"), (s["start"] + F.size(s["phrase"])).cast("long").alias("end"))))
    return both.select(
        F.col("id").alias("doc_id"), "n_words",
        F.when(hit.isNotNull(), F.size(hit)).otherwise(0).cast("long").alias("n_hit"), F.coalesce(F.array_sort(items), none).alias("items"),
        F.coalesce(spans, F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("hits"),
        *carried(carry),
    )


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns, from what contamination returns."""
    said = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(said, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
