"""Records of issues and articles: what is wrong with one, and what a patch of held metadata would change or must leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------------------------------------------------
ISSUE_FIELDS = ("volume", "date", "articles")
ARTICLE_FIELDS = ("title", "authors", "section", "pdf_page_start", "pdf_page_end")
ACCESS = ("open", "paywalled", "subscription")
REVIEW_SECTIONS, REVIEW_FIELDS = ("Book Reviews", "Book Review"), ("book_title", "book_author", "book_year")
ORCID = r"^https://orcid\.org/\d{4}-\d{4}-\d{4}-\d{3}[\dX]$"
# ----------------------------------------------------------------------------------------------------------------------


def _all(*parts: Column) -> Column:
    return F.flatten(F.array(*parts))


def _one(rule: Column, problem: Column | str) -> Column:
    found = F.lit(problem) if isinstance(problem, str) else problem
    return F.when(F.coalesce(rule, F.lit(False)), F.array(found)).otherwise(F.array().cast("array<string>"))


def issue_problems(issue: dict[str, Column]) -> Column:
    """Problems of an issue: fields that are missing (null), no articles."""
    return _all(*[_one(issue[f].isNull(), f"missing {f}") for f in ISSUE_FIELDS], _one(F.size(issue["articles"]) == 0, "no articles"))


def article_problems(a: dict[str, Column]) -> Column:
    """Problems of an article, in the order of the rules.

    Fields are missing if null. `access` must be one of ACCESS, case and blanks aside. `orcids` maps names, each part of
    the authors, to whole identifiers' addresses. Pages must not run backwards. A review of one book (no `/` in the title)
    needs the book's title, author and year, and its publisher must not end after the place.
    """
    names = F.transform(F.map_entries(a["orcids"]), lambda e: _all(
        _one(~F.contains(F.coalesce(a["authors"], F.lit("")), e["key"]), F.concat(F.lit("orcid of no author: "), e["key"])), _one(~F.coalesce(e["value"].rlike(ORCID), F.lit(False)), F.concat(F.lit("orcid of no shape: "), e["key"]))
    ))
    review = F.coalesce(a["section"].isin(*REVIEW_SECTIONS), F.lit(False))
    single = review & ~F.contains(F.coalesce(a["title"], F.lit("")), F.lit("/"))
    return _all(
        *[_one(a[f].isNull(), f"missing {f}") for f in ARTICLE_FIELDS], _one(a["access"].isNotNull() & ~F.lower(F.trim(a["access"])).isin(*ACCESS), "unknown access"), F.coalesce(F.flatten(names), F.array().cast("array<string>")),
        _one(a["pdf_page_start"] > a["pdf_page_end"], "pages run backwards"), *[_one(single & (F.coalesce(a[f].cast("string"), F.lit("")) == ""), f"review without {f}") for f in REVIEW_FIELDS],
        _one(single & F.regexp_replace(a["publisher"], r"\s+$", "").endswith(":"), "publisher cut off"),
    )


def patch_plan(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(id, action, field, place, was, becomes): what a patch changes (update), and what it must leave to a new import (blocked).

    wanted has id, title, abstract and authors (array of given, family, orcid), held these and holder. An article that is
    not held, or has another number of authors, is blocked (its title is still patched); an abstract that differs is
    blocked alone. Identifiers of authors flow one way: one that is not wanted is left. The holder of the copyright, where
    one is held, must be the first author. Ids must be unique on each side; rows without id are left out.
    """
    text = lambda c: c.cast("string")
    entry = lambda action, field, place, was, becomes: F.struct(F.lit(action).alias("action"), F.lit(field).alias("field"), place.cast("int").alias("place"), text(was).alias("was"), text(becomes).alias("becomes"))
    kind = "array<struct<action:string,field:string,place:int,was:string,becomes:string>>"
    one = lambda rule, e: F.when(F.coalesce(rule, F.lit(False)), F.array(e)).otherwise(F.array().cast(kind))
    none = F.lit(None)
    h = held.select(F.col("id").alias("held_id"), *[F.col(c).alias(f"held_{c}") for c in ("title", "abstract", "authors", "holder")])
    rows = wanted.where("id is not null").select("id", "title", "abstract", "authors").join(h, F.col("id") == F.col("held_id"), "left")
    there, same = F.col("held_id").isNotNull(), F.size("authors") == F.size("held_authors")
    differs = lambda a, b: ~a.eqNullSafe(b)
    zipped = F.filter(F.arrays_zip(F.col("authors").alias("w"), F.col("held_authors").alias("h")), lambda x: x["w"].isNotNull() & x["h"].isNotNull())

    def of_author(x: Column, i: Column) -> Column:
        w, k = x["w"], x["h"]
        return _all(
            one(differs(w["given"], k["given"]), entry("update", "given", i, k["given"], w["given"])), one(differs(w["family"], k["family"]), entry("update", "family", i, k["family"], w["family"])),
            one((w["orcid"] != "") & differs(w["orcid"], k["orcid"]), entry("update", "orcid", i, k["orcid"], w["orcid"])),
        )

    first = F.get("authors", F.lit(0))
    holder = F.concat(F.trim(F.concat_ws(" ", first["given"], first["family"])), F.lit(" (Author)"))
    plan = F.when(~there, F.array(entry("blocked", "article", none, none, none))).otherwise(_all(
        one(differs(F.col("title"), F.col("held_title")), entry("update", "title", none, F.col("held_title"), F.col("title"))),
        F.when(~F.coalesce(same, F.lit(False)), F.array(entry("blocked", "authors", none, F.size("held_authors"), F.size("authors")))).otherwise(_all(
            F.flatten(F.transform(zipped, of_author)), one(first.isNotNull() & (F.col("held_holder") != "") & (F.col("held_holder") != holder), entry("update", "holder", none, F.col("held_holder"), holder)),
            one((F.col("abstract") != "") & (F.col("held_abstract") != "") & (F.col("abstract") != F.col("held_abstract")), entry("blocked", "abstract", none, none, none)),
        )),
    ))
    return rows.select("id", F.inline(plan))
