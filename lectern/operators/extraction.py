"""Four kinds of back matter from whole articles: sections at the end, notes and biographies outside them, provenance anywhere.

An article is rows of blocks (article, at, tag, text) in order. Sections, the contiguous tail of back matter, and what
stands in a section are windows over an article's rows; what each item is, column rules decide. Articles meet by their id
only, and one article's blocks are one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import citations as C
from lectern.operators.articles import routed

# Fixed values ---------------------------------------------------------------------------------------------------------
LABELS = r"(?i)^(?:About the Authors?\s*|Author Bio(?:graph(?:y|ies))?\s*|Author Information\s*)"
INLINE_NOTES, NUMBERED = r"(?i)^Notes?\s*:", r"^\(\d+\)"
REFERENCE_START, BIO_VERB, HONOURS = r"^[A-Z][a-z]+,\s+[A-Z]\.?\s", r"\b(?:is|was|has)\s", ("", "dr ", "prof ", "professor ")
# ----------------------------------------------------------------------------------------------------------------------


def _own_author(text: Column, authors: Column) -> Column:
    """The author that a paragraph begins with: a full name (after a title or none), else a surname among the first five words; null without."""
    low = F.lower(text)
    first = F.array_join(F.slice(C.words(low), 1, 5), " ")
    surname = lambda a: F.element_at(F.split(a, " "), -1)
    full = F.filter(authors, lambda a: F.exists(F.array(*[F.lit(h) for h in HONOURS]), lambda h: F.startswith(low, F.concat(h, a))))
    return F.coalesce(F.get(full, F.lit(0)), F.get(F.filter(authors, lambda a: (F.char_length(surname(a)) > 2) & F.contains(first, surname(a)) & ~F.endswith(low, surname(a))), F.lit(0)))


def _names(text: Column, author: Column) -> Column:
    """Whether a text has an author's first and last name, whatever stands between."""
    parts = F.split(author, " ")
    return F.contains(F.lower(text), F.get(parts, F.lit(0))) & F.contains(F.lower(text), F.element_at(parts, -1))


def sectioned(blocks: DataFrame, authors: DataFrame) -> DataFrame:
    """blocks without blank ones, with authors (lower case), sec (0 before the first heading), heading, and item: whether a block is one of the back matter at the end.

    Back matter is a run of sections whose heading says so, or that hold a biography under a name; sections behind the run
    that are none don't break it. A section with list items has these as items, another its paragraphs and quotes.
    """
    by = authors.where("author is not null").groupBy("article").agg(F.array_sort(F.collect_set(F.lower(F.trim("author")))).alias("authors"))
    own, order = Window.partitionBy("article"), Window.partitionBy("article").orderBy("at")
    section = Window.partitionBy("article", "sec")
    rows = blocks.select("article", "at", "tag", C.strip(F.coalesce("text", F.lit(""))).alias("text")).where("text <> '' and article is not null")
    rows = rows.join(by, "article", "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))
    head, inner = F.col("tag") == "h2", F.col("tag").isin("p", "li", "blockquote")
    rows = rows.withColumn("sec", F.sum(F.when(head, 1).otherwise(0)).over(order)).withColumn("heading", F.last(F.when(head, F.col("text")), ignorenulls=True).over(order))
    rows = rows.withColumns({"listed": F.max(F.col("tag") == "li").over(section), "first_at": F.min(F.when(inner, F.col("at"))).over(section), "opening": F.min_by(F.when(inner, F.col("text")), F.when(inner, F.col("at"))).over(section)})
    named = F.coalesce(C.is_bio_section(F.col("heading"), F.col("opening"), F.col("authors")), F.lit(False))
    rows = rows.withColumns({"named": named, "section": C.heading_class(F.col("heading"))}).withColumn("back", (F.col("sec") > 0) & (F.col("section").isNotNull() | F.col("named")))
    rows = rows.withColumn("last", F.max(F.when(F.col("back"), F.col("sec"))).over(own)).withColumn("stop", F.coalesce(F.max(F.when(~F.col("back") & (F.col("sec") > 0) & (F.col("sec") < F.col("last")), F.col("sec"))).over(own), F.lit(0)))
    fits = F.when(F.col("listed"), F.col("tag") == "li").otherwise(F.col("tag").isin("p", "blockquote"))
    return rows.withColumn("item", F.col("back") & (F.col("sec") > F.col("stop")) & fits).drop("listed", "opening", "last", "stop")


def extracted_whole(blocks: DataFrame, authors: DataFrame) -> DataFrame:
    """(article, category, position, part, text): citations, notes, biographies and provenance of whole articles.

    blocks are (article, at, tag, text), authors (article, author). Provenance counts anywhere; what stands under labels of
    biographies is one biography; a paragraph outside that begins with one of the article's own authors is one too, with
    the contacts right behind it, and replaces an earlier one of the same author; inline notes are those before
    the first heading. Statements are notes, bare author names are left out, collapsed references are split.
    """
    order = Window.partitionBy("article").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    text, item, p = F.col("text"), F.col("item"), F.col("tag") == "p"
    rows = sectioned(blocks, authors)
    label = F.coalesce(F.col("section") == "bio", F.lit(False))
    said = F.when(item & F.col("named") & (F.col("at") == F.col("first_at")), F.concat_ws(" ", "heading", "text")).otherwise(text)
    plain = C.strip(F.regexp_replace(said, LABELS, ""))
    said = F.when(item & label, F.when(F.startswith(F.lower(plain), F.lit("contact ")) & ~F.contains(F.substring(plain, 1, 10), F.lit(":")), F.concat(F.lit("Contact: "), F.trim(F.substring(plain, 9, 1 << 30)))).otherwise(plain)).otherwise(said)
    separate = F.max(F.coalesce(F.col("item") & (F.col("section") == "references"), F.lit(False))).over(Window.partitionBy("article"))
    rows = rows.withColumns({"said": said, "label": label, "separate": separate, "contact": C.is_contact(text), "provenance": F.when(p | item, C.is_provenance(text)).otherwise(False)})
    # What stands outside the sections.
    rows = rows.withColumn("begun", F.coalesce(F.max((F.col("sec") == 0) & p & text.rlike(INLINE_NOTES)).over(before), F.lit(False)))
    outside = p & ~item & ~F.col("provenance")
    inline = outside & (F.col("sec") == 0) & (text.rlike(INLINE_NOTES) | (F.col("begun") & text.rlike(NUMBERED)))
    # What reads the start of a paragraph only comes first; whole texts are searched where it holds.
    spoken = outside & ~inline & ~F.col("contact") & F.substring(text, 1, 200).rlike(BIO_VERB) & ~text.rlike(REFERENCE_START)
    own = F.when(F.when(spoken, _own_author(text, F.col("authors")).isNotNull()), F.when(C.is_bio(text), _own_author(text, F.col("authors"))))
    kind = (
        F.when(F.col("provenance"), "provenance").when(item & label, "label").when(item, routed(F.col("said"), F.col("heading"), F.col("authors"), F.col("separate"), F.col("section"))).when(inline, "note")
        .when(F.when(outside & C.has(text, C.STATEMENTS, case=False), F.coalesce(C.note_reason(text) == "author-statement", F.lit(False))), "note").when(F.col("own").isNotNull(), "own").when(outside & F.col("contact"), "contact")
    )
    rows = rows.withColumn("inline", inline).withColumn("own", own).withColumn("kind", kind)
    # Contacts go on with the biography right before them; one without is left to the text.
    starts = F.when(F.col("kind").isin("own", "contact"), F.lit(0)).otherwise(1)
    rows = rows.withColumn("run", F.sum(starts).over(order)).withColumn("owner", F.last(F.when(F.col("kind") == "own", F.col("at")), ignorenulls=True).over(Window.partitionBy("article", "run").orderBy("at")))
    rows = rows.where("kind is not null and kind <> 'drop' and (kind <> 'contact' or owner is not null) and said <> ''")
    group = F.when(F.col("kind") == "label", -1).when(F.col("kind").isin("own", "contact"), F.col("owner")).otherwise(F.col("at"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("inline"), C.strip(F.regexp_replace("said", INLINE_NOTES, ""))).otherwise(F.col("said")).alias("said")))), lambda x: x["said"]), " ")
    merged = rows.groupBy("article", group.alias("group")).agg(F.min("at").alias("position"), F.min_by("kind", "at").alias("kind"), F.min_by("authors", "at").alias("authors"), F.max("own").alias("own"), joined.alias("text")).where("text <> ''")
    # Of the biographies of one author the last that stands outside counts, and those in sections that name this author give way to it.
    bio = F.col("kind").isin("label", "bio", "own")
    about = F.when(bio, F.coalesce("own", F.get(F.filter("authors", lambda a: _names(F.col("text"), a)), F.lit(0))))
    merged = merged.withColumn("about", about).withColumn("latest", F.max(F.when(F.col("kind") == "own", F.col("position"))).over(Window.partitionBy("article", "about")))
    kept = merged.where(F.col("about").isNull() | (F.col("kind") == "label") | F.col("latest").isNull() | (F.col("position") == F.col("latest")))
    category = F.when(bio, "bio").otherwise(F.col("kind"))
    parts = F.when(category == "citation", C.split_collapsed(F.col("text"))).otherwise(F.array("text"))
    return kept.select("article", category.alias("category"), "position", F.posexplode(parts).alias("part", "text")).select("article", "category", "position", "part", "text")
