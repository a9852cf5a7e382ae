"""Operators over whole articles as rows of items: four kinds of back matter, its order, weighted texts, heads, hanging lists, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import citations as C
from lectern.functions.wording import normal_caps

#: Type of an article by its section, and what an override of access says.
ARTICLE_TYPES = {"Editorial": "editorial", "Articles": "research-article", "Book Review Editorial": "editorial", "Book Reviews": "book-review"}
ACCESS = {"open": 1, "free": 1, "subscription": 0, "paywalled": 0}


def weighted_text(keywords: Column, title: Column, abstract: Column, times: int = 3) -> Column:
    """Keywords and title `times` each, then the abstract without tags: repetition weighs words, and pairs of words across repeats count."""
    words = F.concat(F.array_join(keywords, " "), F.lit(" "))
    part = lambda c: F.when(F.trim(c) != "", c)
    return F.trim(F.concat_ws(" ", part(F.repeat(words, F.lit(times))), part(F.repeat(F.concat(F.coalesce(title, F.lit("")), F.lit(" ")), F.lit(times))), part(F.regexp_replace(F.coalesce(abstract, F.lit("")), "<[^>]+>", ""))))


def typed(articles: DataFrame, section: str, access: str) -> DataFrame:
    """articles with type (by section) and access_status: an override of access if it is known, else open but for `Articles`."""
    kinds = F.create_map(*[F.lit(x) for kv in ARTICLE_TYPES.items() for x in kv])
    said = F.create_map(*[F.lit(x) for kv in ACCESS.items() for x in kv])
    default = F.when(F.coalesce(F.col(section), F.lit("Articles")) == "Articles", 0).otherwise(1)
    chosen = F.try_element_at(said, F.lower(F.trim(F.coalesce(F.col(access), F.lit("")))))
    return articles.withColumns({"type": F.coalesce(F.try_element_at(kinds, F.coalesce(F.col(section), F.lit(""))), F.lit("research-article")), "access_status": F.coalesce(chosen, default)})


def founded(issues: DataFrame, volume: str, number: str, published: str, year: int) -> DataFrame:
    """issues itself; a first issue with another year than the founding one fails the job."""
    first = (F.col(volume) == 1) & (F.col(number) == 1)
    # assert_true gives null, so a row passes only after it was tested.
    return issues.where(F.assert_true(~first | (F.year(published) == year), "the first issue has another year than the founding one").isNull())


def enriched(items: DataFrame, reviews: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """items with fields of the review of the same id, null without one; of several reviews the smallest values."""
    return items.join(reviews.groupBy(on).agg(*[F.min(f).alias(f) for f in fields]), on, "left")


def routed(item: Column, heading: Column, authors: Column, separate: Column, section: Column | None = None) -> Column:
    """Kind of an item of a reference section: provenance, bio, drop, note or citation; the first rule that holds.

    authors are full names in lower case; separate says whether the article has a section of pure references, so that what
    stands under notes is a note. A bio under any heading must name an author by surname. section is the heading's class where it is known.
    """
    surnames = F.transform(authors, lambda a: F.element_at(F.split(a, " "), -1))
    names = C.let(F.lower(item), lambda low: F.exists(surnames, lambda s: F.contains(low, s)))
    section = C.heading_class(heading) if section is None else section
    return (
        F.when(C.is_provenance(item), "provenance").when(section == "bio", "bio").when(F.when(names, C.is_bio(item)), "bio")
        .when(F.array_contains(authors, F.regexp_replace(F.lower(F.trim(item)), r"\.+$", "")), "drop")
        .when((section == "notes") & (separate | ~C.is_citation_like(item)), "note").otherwise("citation")
    )


def extracted(items: DataFrame, authors: DataFrame, key: str = "article") -> DataFrame:
    """(article, category, position, text): citations, notes, bios and provenance of articles, each item in one category.

    items are (article, position, heading, text) of sections at an article's end; authors are (article, author). A contact
    line right behind a bio, or behind another contact under the same heading, belongs to it; a citation of several collapsed references is split. Blank
    items and bare author names are left out.
    """
    by = authors.groupBy(key).agg(F.collect_set(F.lower("author")).alias("authors"))
    own = Window.partitionBy(key)
    rows = items.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("text", F.trim("text")).join(by, key, "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))
    # The class of a heading is worked out once an item: what a window reads is a column.
    rows = rows.withColumn("section", C.heading_class(F.col("heading"))).withColumn("separate", F.max(F.coalesce(F.col("section") == "references", F.lit(False))).over(own))
    # A filter on the kind would work it out a second time below the projection; an exploded array of none or one does not.
    one = F.array(routed(F.col("text"), F.col("heading"), F.col("authors"), F.coalesce("separate", F.lit(False)), F.col("section")))
    kind = rows.withColumn("contact", C.is_contact(F.col("text"))).withColumn("kind", F.explode(F.filter(one, lambda k: k != "drop")))
    # A bio begins a group; contacts go on with it. Anything else begins one of its own.
    order = own.orderBy("position")
    follows = F.lag("contact").over(order) & F.lag("heading").over(order).eqNullSafe(F.col("heading"))
    joins = F.col("contact") & ((F.lag("kind").over(order) == "bio") | follows)
    grouped = kind.withColumn("group", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ")
    merged = grouped.groupBy(key, "group").agg(F.min("position").alias("position"), F.min_by("kind", "position").alias("kind"), F.max("contact").alias("contact"), said.alias("text"))
    category = F.when(F.col("contact") & (F.col("kind") == "citation"), "bio").otherwise(F.col("kind"))
    parts = F.when(category == "citation", C.split_collapsed(F.col("text"))).otherwise(F.array("text"))
    return merged.select(key, category.alias("category"), "position", F.posexplode(parts).alias("part", "text")).select(key, "category", "position", "part", "text")


def back_matter(rows: DataFrame, key: str = "article") -> DataFrame:
    """(article, front, back): provenance as emphasised paragraphs; bios, then one list of notes; citations are left to others."""
    place = F.struct("position", "part", "text")
    listed = lambda name, wrap: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("category") == name, place))), wrap), "")
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tagged = lambda a, z: lambda x: F.concat(F.lit(a), safe(x["text"]), F.lit(z))
    out = rows.groupBy(key).agg(listed("provenance", tagged("<p><em>", "</em></p>")).alias("p"), listed("bio", tagged('<div class="bios"><p>', "</p></div>")).alias("b"), listed("note", tagged("<li>", "</li>")).alias("n"))
    around = lambda c, a, z: F.when(F.col(c) != "", F.concat(F.lit(a), c, F.lit(z))).otherwise("")
    return out.select(key, around("p", '<div class="provenance">', "</div>").alias("front"), F.concat("b", around("n", '<div class="notes"><ol>', "</ol></div>")).alias("back"))


def clean_headings(html: Column) -> Column:
    """Headings without footnote superscripts, those in capitals in title case."""
    split = F.split(html, r"(?i)(?=<h[1-6]\b)|(?<=</h[1-6]>)")

    def one(part: Column) -> Column:
        plain = F.regexp_replace(part, r"(?is)<sup\b[^>]*>.*?</sup>", "")
        inner = F.regexp_extract(plain, r"(?is)^<h[1-6][^>]*>([^<>]*)</h[1-6]>$", 1)
        opens, closes = F.regexp_extract(plain, r"(?i)^(<h[1-6][^>]*>)", 1), F.regexp_extract(plain, r"(?i)(</h[1-6]>)$", 1)
        return F.when(~part.rlike(r"(?i)^<h[1-6]\b"), part).when(inner != "", F.concat(opens, normal_caps(inner), closes)).otherwise(plain)

    return F.array_join(F.transform(split, one), "")


def hanging(lines: DataFrame, region: str, position: str, indented: Column, gap: Column, full: float = 6.0) -> DataFrame:
    """(region, hanging): whether a region's indented lines mostly follow lines of full width, as in a list of references."""
    before = F.lag(gap).over(Window.partitionBy(region).orderBy(position))
    votes = lines.select(region, F.when(indented & before.isNotNull(), F.when(before <= full, 1).otherwise(-1)).otherwise(0).alias("vote"))
    return votes.groupBy(region).agg((F.sum("vote") > 0).alias("hanging"))


def first_by_kind(files: DataFrame, key: str, kind: str, wanted: str, file: str) -> DataFrame:
    """(key, file): of a row's files of the wanted kind the smallest."""
    return files.where(F.col(kind) == wanted).groupBy(key).agg(F.min(file).alias(file))


def bundled(items: DataFrame, key: str, title: str, payload: str) -> DataFrame:
    """(key, xml): one record an item, its payload in base64."""
    safe = F.replace(F.replace(F.replace(F.col(title), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    one_line = F.regexp_replace(F.base64(F.col(payload).cast("binary")), r"\s", "")
    return items.select(key, F.concat(F.lit('<article id="'), F.col(key), F.lit('"><title>'), safe, F.lit("</title><embed encoding=\"base64\">"), one_line, F.lit("</embed></article>")).alias("xml"))
