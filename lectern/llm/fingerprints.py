"""Document fingerprints: a Merkle tree over the pieces, paragraphs and sections of a text, in DataFrame operations only.

Leaves are pieces of paragraphs (up to a full stop, or LEAF characters); a paragraph's hash covers its leaves, a section is
SECTION paragraphs, and the root covers the sections. Roots test equality; differing branches lead to the edited places.
A fingerprint is `root:` and then, for each paragraph, the first eight hex digits of its leaves, paragraphs parted by `/`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import BROADCAST_ROWS, clean, figures, range_bounds, range_of, stored

LEAF, SECTION = 60, 8
#: UTF-8 bytes of text in a range of ids whose rows are ordered together.
RANGE_BYTES = 6_000_000


def leaves(text: Column) -> Column:
    """Hashes of the pieces of each paragraph (line), 64 hex digits each: an array of arrays."""
    piece = f"[^.]{{1,{LEAF - 1}}}\\.?|\\."
    return F.transform(F.split(text, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(piece), F.lit(0)), lambda x: F.sha2(x, 256)))


def root(tree: Column) -> Column:
    """The hash over sections, each over SECTION paragraphs, each over its leaves."""
    paragraphs = F.transform(tree, lambda x: F.sha2(F.array_join(x, ""), 256))
    sections = F.transform(F.sequence(F.lit(0), F.ceil(F.size(paragraphs) / SECTION).cast("int") - 1), lambda k: F.sha2(F.array_join(F.slice(paragraphs, k * SECTION + 1, SECTION), ""), 256))
    return F.sha2(F.array_join(sections, ""), 256)


def fingerprint(text: Column) -> Column:
    tree = leaves(text)
    short = F.array_join(F.transform(tree, lambda p: F.array_join(F.transform(p, lambda x: F.substring(x, 1, 8)), "")), "/")
    return F.concat(root(tree), F.lit(":"), short)


def branches(print_: Column) -> Column:
    """The leaf digests of a fingerprint, in order."""
    return F.regexp_extract_all(F.substring_index(print_, ":", -1), F.lit("[0-9a-f]{8}"), F.lit(0))


def likeness(one: Column, two: Column) -> Column:
    """1 for equal roots, else twice the number of distinct leaves that both hold by the number that each holds; 0 if they share none."""
    a, b = F.array_distinct(branches(one)), F.array_distinct(branches(two))
    share = 2.0 * F.size(F.array_intersect(a, b)) / F.greatest(F.size(a) + F.size(b), F.lit(1))
    return F.when(F.substring_index(one, ":", 1) == F.substring_index(two, ":", 1), 1.0).otherwise(F.least(share, F.lit(1.0)))


def differing(one: Column, two: Column) -> Column:
    """Paragraph numbers, from 0, in which two fingerprints' branches differ."""
    a, b = F.split(F.substring_index(one, ":", -1), "/"), F.split(F.substring_index(two, ":", -1), "/")
    every = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
    return F.filter(every, lambda k: ~F.get(a, k).eqNullSafe(F.get(b, k)))


def with_next(docs: DataFrame) -> DataFrame:
    """(id, text, print, next): next holds text and print of the row that follows in ascending (id, text); after the last one, of the first.

    Ids are cut into ranges; rows are ordered within a range, and the last of each takes the first row of the next range
    that has rows. No step orders all rows in one task.
    """
    _, size = figures(docs.select("id", "text"))
    bounds = range_bounds(docs.select("id"), max(12, -(-size // RANGE_BYTES)))
    parts = max(len(bounds) + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(range_of(bounds, F.col("id")).alias("range"), "id", "text", "print")
    # Ranges are few; the first row of each is dealt to the range before it too, where it follows the last row.
    heads = docs.select(range_of(bounds, F.col("id")).alias("range"), "id").groupBy("range").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id"))["id"].alias("head"))
    turn = Window.orderBy("range")
    heads = stored(heads.select("range", "head", F.coalesce(F.lag("range").over(turn), F.max("range").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("prior")), "heads")
    heads = F.broadcast(heads) if len(bounds) < BROADCAST_ROWS else heads
    rows = rows.join(heads, "range")
    places = F.when(F.col("id").eqNullSafe(F.col("head")), F.array(F.struct("range", F.lit(0).alias("guest")), F.struct(F.col("prior").alias("range"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct("range", F.lit(0).alias("guest"))))
    rows = rows.select(F.explode(places).alias("at"), "id", "text", "print").select("at.range", "at.guest", "id", "text", "print").repartition(parts, "range")
    order = Window.partitionBy("range").orderBy("guest", F.col("id").asc_nulls_last(), F.col("text").asc_nulls_first())
    return rows.withColumn("next", F.lead(F.struct("text", "print")).over(order)).where("guest = 0").select("id", "text", "print", "next")


def edited(text: Column, next_: Column) -> Column:
    """The text with its last floor(n / 2) characters replaced by as many first ones of the next (or all of it)."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, 1, F.char_length(text) - half), F.substring(next_, 1, half))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A null text is empty. Equal texts have equal fingerprints, two empty ones likeness 1. Rows of equal id follow each
    other in order of their texts; rows without an id come last. A single row is its own next.
    """
    plain = clean(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = with_next(plain.withColumn("print", fingerprint(F.col("text")))).withColumn("edited", edited(F.col("text"), F.col("next")["text"]))
    done = rows.select("id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("print").alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), F.col("next")["print"].alias("next_fingerprint"))
    f = F.col("fingerprint")
    return done.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(f, F.col("edited_fingerprint")).alias("near_edited"), likeness(f, F.col("next_fingerprint")).alias("near_next"))
