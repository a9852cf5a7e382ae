"""Cleaning of whole articles by section: a table of steps over an array of blocks.

Blocks are struct(tag, text) in order, as `markup_blocks` reads them from HTML. A step takes the blocks and the article's
columns; `cleaned` applies, in the table's order, those that the article's section asks for, one projection each, in one
stage. Nothing is shuffled. Null blocks give null; a null title, author line or abstract changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import citations as C
from lectern.functions import markup as K
from lectern.functions import text as X
from lectern.functions import wording as W
from lectern.operators import blocks as B

# Fixed values ---------------------------------------------------------------------------------------------------------
SUBTITLE_BLOCKS, LEAST_ABSTRACT, ABSTRACT_SHARE = 5, 30, 0.7
KEYWORD_HEAD, KEYWORD_LINE = r"(?i)^(?:Key\s*words?)$", r"(?i)^\s*(?:Key\s*words?)\s*:"
REVIEW_HEAD, SECTION_HEAD, CONTENTS_HEAD = r"(?i)^\s*BOOK\s+REVIEWS?\s*$", r"(?i)^\s*(?:EDITORIAL|BOOK\s+REVIEWS?)\s*$", r"(?i)^\s*CONTENTS\s*$"
IMPRINT = rf"(?i)\d{{4}}|pp\.?\s*\d|ISBN|\$|£|{C.PUBLISHERS}|London|New York|Oxford|Cambridge"
IMPRINT_LINE, IMPRINT_BLOCKS, IMPRINT_CHARS, SHORT_HEADING = 150, 3, 300, 10
# ----------------------------------------------------------------------------------------------------------------------

Step = Callable[[Column, dict[str, Column]], Column]


def markup_blocks(html: Column) -> Column:
    """Block elements with their text, in order; text before the first or between blocks is a `p` of its own, inner blocks are blocks themselves."""
    names = [b for b in W.BLOCK_TAGS if b not in ("table", "thead", "tbody", "tr", "ul", "ol", "div", "section", "figure")]

    def flat(e: Column) -> Column:
        block = e["name"].isin(*names)
        return (
            F.when(e["kind"].isin("start", "empty") & block, F.concat(F.lit("\ufdd0"), e["name"], F.lit("\ufdd1"))).when((e["kind"] == "end") & block, "\ufdd0p\ufdd1")
            .when(e["name"].isin("ul", "ol", "div", "table", "tr", "section"), "\ufdd0p\ufdd1").when(e["name"] == "br", " ").when(e["kind"] == "text", K.without_marks(K.unescaped(e["source"]))).otherwise("")
        )

    parts = F.split(F.concat(F.lit("p\ufdd1"), F.array_join(F.transform(K.events(html), flat), "")), "\ufdd0")
    cut = F.transform(parts, lambda x: F.struct(F.substring_index(x, "\ufdd1", 1).alias("tag"), C.strip(F.regexp_replace(F.substring_index(x, "\ufdd1", -1), r"\s+", " ")).alias("text")))
    return F.filter(cut, lambda b: (b["text"] != "") | (b["tag"] == "hr"))


# ------------------------------------------------------------------------------------------------ steps


def _where(blocks: Column, rule) -> Column:
    """Place (from 1) of the first block for which rule(block, place) holds; 0 without one."""
    return F.coalesce(F.array_position(F.transform(blocks, lambda b, i: F.coalesce(rule(b, i + 1), F.lit(False))), True).cast("int"), F.lit(0))


def _without(blocks: Column, first: Column, n: int | Column = 1) -> Column:
    """Without n blocks from place `first` on; unchanged where first is 0."""
    return F.when(first > 0, F.filter(blocks, lambda b, i: ~((i + 1 >= first) & (i + 1 < first + n)))).otherwise(blocks)


def _until(blocks: Column, place: Column) -> Column:
    return F.when(place > 0, F.slice(blocks, F.lit(1), F.greatest(place - 1, F.lit(0)))).otherwise(blocks)


def _head(b: Column, *tags: str) -> Column:
    return b["tag"].isin(*(tags or B.HEADINGS))


def _body_start(blocks: Column) -> Column:
    """Place of the first heading that is neither abstract, keywords nor a name; behind the last block without one."""
    plain = lambda b: ~F.lower(b["text"]).isin("abstract", "keywords", "key words") & ~C.is_person(b["text"])
    at = _where(blocks, lambda b, _: _head(b, "h2", "h3") & plain(b))
    return F.when(at > 0, at).otherwise(F.size(blocks) + 1)


def without_subtitle(blocks: Column, subtitle: Column, key: B.Key = B.squashed) -> Column:
    """Without the first of the leading blocks that has over half of the subtitle's words; a block of other words ends the search."""

    def of(said: Column) -> Column:
        have = lambda b: F.size(F.array_intersect(said, C.words(key(b))))
        stop = lambda b: (have(b) > F.size(said) * B.TITLE_SHARE) | (F.size(F.array_except(C.words(key(b)), said)) > 0)
        at = _where(F.slice(blocks, 1, SUBTITLE_BLOCKS), lambda b, _: stop(b))
        return F.when((at > 0) & (have(F.get(blocks, at - 1)) > F.size(said) * B.TITLE_SHARE), _without(blocks, at)).otherwise(blocks)

    return F.when(X.squash(subtitle) != "", W.let(F.array_distinct(C.words(X.squash(subtitle))), of)).otherwise(blocks)


def without_authors(blocks: Column, authors: Column, key: B.Key = B.squashed) -> Column:
    """Without the first block before the body that names the authors: as given, then without, then with further middle names."""
    names = F.filter(F.transform(F.split(authors, r",\s*|\s+and\s+"), lambda p: X.squash(p)), lambda p: p != "")
    given, short = X.squash(authors), X.squash(F.element_at(W.name_variants(authors), -1))
    loose = F.array_join(F.transform(F.filter(names, lambda p: F.size(F.split(p, " ")) == 2), lambda p: F.regexp_replace(p, "^(\\S+) (\\S+)$", "$1(?:\\\\s+\\\\S+)*?\\\\s+$2")), "[^a-z0-9]+(?:and[^a-z0-9]+)?")
    parts = F.struct(given.alias("given"), short.alias("short"), loose.alias("loose"), _limit(blocks).alias("limit"))

    def of(a: Column) -> Column:
        near = F.slice(blocks, F.lit(1), F.greatest(a["limit"] - 1, F.lit(0)))
        ways = [_where(near, lambda b, _: (a[c] != "") & F.contains(key(b), a[c])) for c in ("given", "short")] + [_where(near, lambda b, _: (a["loose"] != "") & F.rlike(key(b), a["loose"]))]
        return W.let(F.array(*ways), lambda w: _without(blocks, F.coalesce(F.get(F.filter(w, lambda x: x > 0), F.lit(0)), F.lit(0))))

    return F.when(given != "", W.let(parts, of)).otherwise(blocks)


def _limit(blocks: Column) -> Column:
    abstract = _where(blocks, lambda b, _: _head(b, "h2", "h3") & b["text"].rlike(r"(?i)^\s*Abstract\s*$"))
    return F.when(abstract > 0, abstract).otherwise(_body_start(blocks))


def without_abstract(blocks: Column, abstract: Column, key: B.Key = B.squashed) -> Column:
    """Without the heading `Abstract` and the first paragraph before the body that has over 0.7 of the abstract's words."""

    def of(said: Column) -> Column:
        rest = W.let(_where(blocks, lambda b, _: _head(b, "h2", "h3") & b["text"].rlike(r"(?i)^\s*Abstract\s*$")), lambda at: _without(blocks, at))
        near = lambda b: F.size(F.array_intersect(said, C.words(key(b)))) > F.size(said) * ABSTRACT_SHARE
        return W.let(rest, lambda r: W.let(_body_start(r), lambda end: _without(r, _where(r, lambda b, i: (i < end) & (b["tag"] == "p") & near(b)))))

    return F.when((F.char_length(abstract) >= LEAST_ABSTRACT) & (X.squash(abstract) != ""), W.let(F.array_distinct(C.words(X.squash(abstract))), of)).otherwise(blocks)


def without_keywords(blocks: Column) -> Column:
    """Without a heading of keywords and the paragraph after it, or else the first paragraph that begins so."""
    headed = _where(blocks, lambda b, _: _head(b, "h2", "h3") & b["text"].rlike(KEYWORD_HEAD))
    line = _where(blocks, lambda b, _: (b["tag"] == "p") & b["text"].rlike(KEYWORD_LINE))

    def of(h: Column) -> Column:
        following = _where(blocks, lambda b, i: (i > h) & (b["tag"] == "p"))
        return F.when(h > 0, W.let(following, lambda p: F.filter(blocks, lambda b, i: (i + 1 != h) & ((p == 0) | (i + 1 != p))))).otherwise(_without(blocks, line))

    return W.let(headed, of)


def without_contents(blocks: Column) -> Column:
    """Without a table of contents: its heading up to a rule, which goes too, or to the heading of a section, which stays."""
    start = _where(blocks, lambda b, _: _head(b, "h1", "h2") & b["text"].rlike(CONTENTS_HEAD))

    def of(at: Column) -> Column:
        rule = _where(blocks, lambda b, i: (i > at) & (b["tag"] == "hr"))
        section = _where(blocks, lambda b, i: (i > at) & _head(b, "h1", "h2") & b["text"].rlike(SECTION_HEAD))
        ended = F.struct(rule.alias("r"), section.alias("s"))
        upto = lambda e: F.when((e["r"] > 0) & ((e["s"] == 0) | (e["r"] < e["s"])), e["r"] + 1).when(e["s"] > 0, e["s"]).otherwise(F.size(blocks) + 1)
        return F.when(at > 0, W.let(ended, lambda e: _without(blocks, at, upto(e) - at))).otherwise(blocks)

    return W.let(start, of)


def without_listing(blocks: Column) -> Column:
    """Without the leading headings and lines of imprint."""
    body = _where(blocks, lambda b, _: ~(_head(b) | ((b["tag"] == "p") & (F.char_length(b["text"]) <= IMPRINT_LINE) & b["text"].rlike(IMPRINT))))
    return F.when(F.size(blocks) > 0, W.let(body, lambda at: F.slice(blocks, F.when(at > 0, at).otherwise(F.size(blocks) + 1), F.size(blocks)))).otherwise(blocks)


def without_reviews_head(blocks: Column) -> Column:
    return W.let(_where(blocks, lambda b, _: _head(b, "h1", "h2", "h3") & b["text"].rlike(REVIEW_HEAD)), lambda at: _without(blocks, at))


def without_reviews(blocks: Column) -> Column:
    """Up to the first heading that is not that of a section."""
    return W.let(_where(blocks, lambda b, _: _head(b, "h2", "h3") & ~b["text"].rlike(SECTION_HEAD)), lambda at: _until(blocks, at))


def without_rules(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["tag"] != "hr")


def normal_headings(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: F.struct(b["tag"].alias("tag"), F.when(_head(b), W.normal_caps(b["text"])).otherwise(b["text"]).alias("text")))


def _begins(text: Column, title: Column) -> Column:
    """Whether one of two squashed texts begins the other, both having ten characters or more."""
    n = F.least(F.char_length(text), F.char_length(title))
    return (n >= B.LEAST_OPENING) & (F.substring(text, F.lit(1), n) == F.substring(title, F.lit(1), n))


def book_review(blocks: Column, title: Column, following: Column, combined: Column, key: B.Key = B.squashed) -> Column:
    """One review of a shared page: from the block with its title and imprint up to that of the following review.

    The title is looked for in any of its parts (at `/`), in a block that states an imprint, a heading with an imprint
    after it or a short block; else in any block. The following one must be a heading, stand under one with its title, or
    begin with its title (but not if both titles are the same, as prose may begin so too), behind at most three lines of
    imprint. Reviews that share their pages (`combined`) are not cut at the end. Without the title nothing changes.
    """
    parts_of = lambda t: F.filter(F.transform(F.split(B.bare_title(t), "/"), X.squash), lambda p: p != "")

    def whole(x: Column) -> Column:
        said = F.transform(blocks, lambda b, i: F.struct(key(b).alias("text"), (b["tag"] != "blockquote").alias("fit"), _head(b).alias("head"), b["text"].rlike(IMPRINT).alias("imprint"), F.char_length(b["text"]).alias("n"), F.get(blocks, i + 1)["text"].rlike(IMPRINT).alias("next")))

        def in_blocks(s: Column) -> Column:
            told = lambda b: b["imprint"] | (b["head"] & F.coalesce(b["next"], F.lit(False))) | (F.size(F.split(b["text"], " ")) <= SHORT_HEADING)
            own = lambda b: b["fit"] & F.exists(x["own"], lambda p: F.contains(b["text"], p))
            strict = _where(s, lambda b, _: own(b) & told(b))
            start = W.let(strict, lambda at: F.when(at > 0, at).otherwise(_where(s, lambda b, _: own(b))))

            def from_start(at: Column) -> Column:
                imprint = lambda k: F.coalesce(F.get(s, at + k)["imprint"] & (F.get(s, at + k)["n"] <= IMPRINT_CHARS), F.lit(False))
                lines = F.when(~F.get(s, at - 1)["head"], 0).when(~imprint(0), 0).when(~imprint(1), 1).when(~imprint(2), 2).otherwise(IMPRINT_BLOCKS)
                has = lambda b: F.exists(x["next"], lambda p: F.contains(b["text"], p))
                begins = lambda b: ~x["same"] & F.exists(x["next"], lambda p: _begins(F.replace(b["text"], F.lit(" "), F.lit("")), F.replace(p, F.lit(" "), F.lit(""))))
                headed = lambda i: F.coalesce(has(F.try_element_at(F.filter(F.slice(s, F.lit(1), i - 1), lambda b: b["head"]), F.lit(-1))), F.lit(False))
                after = lambda n: _where(s, lambda b, i: (i > at + n) & b["fit"] & has(b) & (b["head"] | begins(b) | ((i > 1) & headed(i))) & told(b))
                end = F.when(x["cut"], W.let(lines, after)).otherwise(0)
                return F.when(at > 0, W.let(end, lambda e: F.slice(blocks, at, F.when(e > 0, e - at).otherwise(F.size(blocks))))).otherwise(blocks)

            return W.let(start, from_start)

        return W.let(said, in_blocks)

    none = lambda c: F.coalesce(c, F.lit(""))
    tight = lambda c: F.regexp_replace(X.squash(B.bare_title(none(c))), " ", "")
    facts = F.struct(parts_of(none(title)).alias("own"), parts_of(none(following)).alias("next"), (tight(title) == tight(following)).alias("same"), ((X.squash(none(following)) != "") & ~F.coalesce(combined, F.lit(False))).alias("cut"))
    return F.when(X.squash(none(title)) != "", W.let(facts, whole)).otherwise(blocks)


# ------------------------------------------------------------------------------------------------ the table

REVIEW, REVIEW_EDITORIAL, EDITORIAL = ("Book Reviews", "Book Review"), ("Book Review Editorial",), ("Editorial",)
#: While steps are applied, a block holds its squashed text.
KEY = lambda b: b["key"]
#: Steps in order: name, sections (None: all, "": all but the named kinds), step.
STEPS: tuple[tuple[str, tuple[str, ...] | None, Step], ...] = (
    ("review of a shared page", REVIEW, lambda b, a: book_review(b, a["title"], a["following"], a["combined"], KEY)),
    ("contents", None, lambda b, a: without_contents(b)),
    ("listing of the books", REVIEW, lambda b, a: without_listing(b)),
    ("before the title", (*REVIEW_EDITORIAL, *EDITORIAL, ""), lambda b, a: B.from_title(b, a["title"], KEY)),
    ("heading of the reviews", REVIEW_EDITORIAL, lambda b, a: without_reviews_head(b)),
    ("reviews", REVIEW_EDITORIAL, lambda b, a: without_reviews(b)),
    ("title", (*EDITORIAL, ""), lambda b, a: B.without_title(b, a["title"], KEY)),
    ("subtitle", ("",), lambda b, a: without_subtitle(b, a["subtitle"], KEY)),
    ("authors", (*EDITORIAL, ""), lambda b, a: without_authors(b, a["authors"], KEY)),
    ("abstract", ("",), lambda b, a: without_abstract(b, a["abstract"], KEY)),
    ("keywords", ("",), lambda b, a: without_keywords(b)),
    ("repeated title", ("",), lambda b, a: B.without_title(b, a["title"], KEY)),
    ("repeated subtitle", ("",), lambda b, a: without_subtitle(b, a["subtitle"], KEY)),
    ("following article", None, lambda b, a: B.until_next(b, a["title"], a["following"], KEY)),
    ("headings", None, lambda b, a: normal_headings(b)),
    ("rules", None, lambda b, a: without_rules(b)),
)
ARTICLE = ("section", "title", "subtitle", "authors", "abstract", "following", "combined")


def cleaned(articles: DataFrame, blocks: str = "blocks", journal: str | None = None) -> DataFrame:
    """articles with the column `blocks` after all steps that each row's section asks for.

    articles has the columns of ARTICLE, null where unknown. Each step is a projection of its own in the same stage: blocks
    are worked out once a step, and nothing is shuffled. With `journal`, a pattern that names it, running headers and lone
    page numbers go too.
    """
    kinds = (*REVIEW, *REVIEW_EDITORIAL, *EDITORIAL)
    section = F.coalesce(F.col("section"), F.lit(""))
    known = F.when(section.isin(*kinds), section).otherwise("")
    columns, b = {c: F.col(c) for c in ARTICLE}, F.col(blocks)
    articles = articles.withColumn(blocks, F.transform(b, lambda x: F.struct(x["tag"].alias("tag"), x["text"].alias("text"), B.squashed(x).alias("key"))))
    for _, sections, step in STEPS:
        after = step(b, columns)
        articles = articles.withColumn(blocks, after if sections is None else F.when(known.isin(*sections), after).otherwise(b))
    # The step on headings has left tags and texts only.
    return articles if journal is None else articles.withColumn(blocks, B.without_furniture(b, journal))
