"""Contact lines of biographies in an article's HTML: fused biographies, line breaks, welded addresses, recorded identifiers.

Paragraphs are told apart on the event stream, so what a comment or script says is no paragraph. Only paragraphs with a
contact change, as a line break elsewhere is one. Nested emphasis counts as its outermost element. Null HTML gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import markup as K
from lectern.functions.wording import let

# Fixed values ---------------------------------------------------------------------------------------------------------
CONTACT = r"\bContact:|[\w.+-]+@[\w.-]+\.\w+|orcid\.org/"
MAIL, LINK = r"[\w.+-]+@[\w.-]+\.", "https?://"
ORCID_BEFORE = r"\s*(?:ORCID(?:\s+iD)?\s*:?\s*)?(?:https?://(?:www\.)?orcid\.org/)?"
# ----------------------------------------------------------------------------------------------------------------------


def has_contact(html: Column) -> Column:
    return K.plain_text(html).rlike(CONTACT)


def each_paragraph(html: Column, rule) -> Column:
    """html with rule(paragraph) in place of each `p` that is closed, tags included."""
    mark = K.without_marks

    def flat(e: Column) -> Column:
        opened, closed = (e["name"] == "p") & (e["kind"] == "start"), (e["name"] == "p") & (e["kind"] == "end")
        return F.when(opened, F.concat(F.lit("\ufdd0"), mark(e["source"]))).when(closed, F.concat(mark(e["source"]), F.lit("\ufdd0"))).otherwise(mark(e["source"]))

    parts = F.split(F.array_join(F.transform(K.events(html), flat), ""), "\ufdd0")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"(?is)^<p[\s>].*</p\s*>$"), rule(x)).otherwise(x)), "")


def split_bios(html: Column) -> Column:
    """A biography that begins with emphasis inside a paragraph, and has a contact after it, gets a paragraph of its own; so do further ones in it."""

    def rule(p: Column) -> Column:
        parts = F.split(p, r"(?i)(?=<strong[\s>])")
        seen = F.transform(parts, lambda x: F.struct(x.alias("x"), has_contact(F.regexp_replace(x, r"(?is)^<strong\b[^>]*>.*?</strong\s*>", "")).alias("own"), has_contact(x).alias("any")))

        def of(s: Column) -> Column:
            last = F.coalesce(F.array_max(F.transform(s, lambda x, i: F.when(x["any"], i))), F.lit(-1))
            empty = F.get(s, F.lit(0))["x"].rlike(r"(?is)^<p\b[^>]*>$")

            def joined(x: Column) -> Column:
                starts = lambda b, i: (i > 0) & ~(x["empty"] & (i == 1)) & (b["own"] | (i < x["last"]))
                spaced = lambda b: F.regexp_replace(b["x"], r"([\w,.)])(Contact:)", "$1 $2")
                return F.regexp_replace(F.array_join(F.transform(s, lambda b, i: F.when(starts(b, i), F.concat(F.lit("</p><p>"), spaced(b))).otherwise(b["x"])), ""), r"\s+</p><p>", "</p><p>")

            return let(F.struct(last.alias("last"), empty.alias("empty")), joined)

        return let(seen, of)

    return each_paragraph(html, rule)


def spaced_breaks(html: Column) -> Column:
    """In a paragraph with a contact, a line break between two texts becomes a full stop between address and link, else one blank."""

    def rule(p: Column) -> Column:
        between = F.regexp_replace(p, rf"({MAIL}\w+\s*)<br\s*/?>(?=\s*{LINK})", "$1. ")
        ready = F.regexp_replace(F.regexp_replace(between, r"([^<>\s]\s*[ \n])<br\s*/?>(?=\s*[^<>\s])", "$1"), r"([^<>\s]\s*)<br\s*/?>(?=[ \n]\s*[^<>\s])", "$1")
        return F.when(has_contact(p), F.regexp_replace(ready, r"([^<>\s]\s*)<br\s*/?>(?=\s*[^<>\s])", "$1 ")).otherwise(p)

    return each_paragraph(html, rule)


def parted_addresses(html: Column) -> Column:
    """In a paragraph with a contact, a full stop and a blank between an address and the link welded to it."""
    return each_paragraph(html, lambda p: F.when(has_contact(p), F.regexp_replace(p, rf"({MAIL}[A-Za-z]{{2,}}?)({LINK})", "$1. $2")).otherwise(p))


def without_recorded(html: Column, orcids: Column) -> Column:
    """Texts without the identifiers (bare, or links that end in one) that are recorded elsewhere; what stood round them is tidied."""
    ids = F.transform(F.filter(orcids, lambda x: x.isNotNull() & (x != "")), lambda x: F.concat(F.lit("\\Q"), F.element_at(F.split(F.regexp_replace(x, "/+$", ""), "/"), -1), F.lit("\\E")))
    pattern = F.concat(F.lit(f"(?i){ORCID_BEFORE}(?:"), F.array_join(ids, "|"), F.lit(r")\.?"))

    def cleaned(found: Column) -> Column:
        def of(e: Column) -> Column:
            cut = F.regexp_replace(e["source"], found, F.lit(""))
            return F.when((e["kind"] != "text") | (cut == e["source"]), e["source"]).otherwise(F.regexp_replace(F.regexp_replace(cut, "[ \\t]{2,}", " "), r"\s+([.,;])", "$1"))

        return F.array_join(F.transform(K.events(html), of), "")

    return F.when(F.size(ids) > 0, let(pattern, cleaned)).otherwise(html)


def tidied(articles: DataFrame, html: str, orcids: str) -> DataFrame:
    """articles with all four rules applied to the column html, each a projection in the same stage; orcids are the recorded identifiers."""
    h = F.col(html)
    for step in (split_bios, spaced_breaks, parted_addresses):
        articles = articles.withColumn(html, step(h))
    return articles.withColumn(html, without_recorded(h, F.col(orcids)))
