"""Cleaning of an article as an array of blocks struct(tag, text) in order: titles, neighbours' text, page furniture, warnings.

All native; a block array is one article, so nothing is shuffled. Null blocks give null, null titles change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import citations as C
from lectern.functions import text as X
from lectern.functions.wording import phrase_end

Key = Callable[[Column], Column]

# Fixed values ---------------------------------------------------------------------------------------------------------
TITLE_RATIO, TITLE_SHARE, FUZZY_SHARE = 2, 0.5, 0.8
LEAST_TARGET, LEAST_OPENING, LEAST_CONTENT, TAIL = 5, 10, 100, 0.4
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
PREFIX = r"^(?:Book Reviews?|Film Review|Exhibition Report|Poem|Personally Speaking|Obituary|Essay Review|Letter to the Editors?|Responses?(?: to)?|Professor|Prof\.?)\s*:?\s*"
SECOND_PREFIX = r"^(?:Professor|Prof\.?)\s*:?\s*"
SECTION_HEADS = ("letters to the editors", "letters to the editor", "letter to the editors", "letter to the editor", "letters", "editorial", "book reviews", "book review editorial", "obituary")
REVIEWS = ("Book Reviews", "Book Review")
# ----------------------------------------------------------------------------------------------------------------------


def bare_title(title: Column) -> Column:
    """Without the kind of article before it and a bracket after it."""
    once = C.strip(F.regexp_replace(title, f"(?iU){PREFIX}", ""))
    return F.regexp_replace(C.strip(F.regexp_replace(once, f"(?iU){SECOND_PREFIX}", "")), r"(?U)\s*\([^)]+\)\s*$", "")


def squashed(b: Column) -> Column:
    """What titles are compared with; a block that holds it already, as `key`, is read by another function given as `key`."""
    return X.squash(b["text"])


def _heading(b: Column) -> Column:
    return b["tag"].isin(*HEADINGS)


def _first(blocks: Column, rule) -> Column:
    """Place (from 1) of the first block for which rule(block, place) holds; 0 without one."""
    return F.array_position(F.transform(blocks, lambda b, i: F.coalesce(rule(b, i + 1), F.lit(False))), True).cast("int")


def _from(blocks: Column, place: Column) -> Column:
    return F.slice(blocks, place, F.greatest(F.size(blocks), F.lit(0)))


def without_title(blocks: Column, title: Column, key: Key = squashed) -> Column:
    """Without the leading short or heading blocks that share words with the title, if together they have over half of its words."""
    said = F.array_distinct(C.words(X.squash(title)))
    shared = lambda b: F.array_intersect(said, C.words(key(b)))
    short = lambda b: F.char_length(key(b)) <= F.char_length(X.squash(title)) * TITLE_RATIO
    stop = _first(blocks, lambda b, _: ~F.coalesce((_heading(b) | short(b)) & (F.size(shared(b)) > 0) & ~C.is_provenance(b["text"]), F.lit(False)))
    n = F.when(stop > 0, stop - 1).otherwise(F.size(blocks))
    have = F.size(F.array_distinct(F.flatten(F.transform(F.slice(blocks, F.lit(1), F.greatest(n, F.lit(0))), shared))))
    return F.when(have > F.size(said) * TITLE_SHARE, _from(blocks, n + 1)).otherwise(blocks)


def from_title(blocks: Column, title: Column, key: Key = squashed) -> Column:
    """From the first block that holds the title on; all blocks if none does or the title is shorter than five characters."""
    want = X.squash(bare_title(title))
    at = _first(blocks, lambda b, _: (want != "") & F.contains(key(b), want))
    return F.when((F.char_length(title) >= LEAST_TARGET) & (at > 0), _from(blocks, at)).otherwise(blocks)


def until_next(blocks: Column, title: Column, following: Column, key: Key = squashed) -> Column:
    """Up to the block in which the following article begins.

    After the last back-matter heading, headings and what follows a further heading are searched for the title's words in
    order with up to five others between; without such a heading, first all headings, then the last three fifths of the
    paragraphs for one that begins with the title. An article with the same title as the following one stays as it is.
    """
    tight = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    said = C.words(X.squash(bare_title(following)))
    holds = lambda b: phrase_end(C.words(key(b)), said) >= 0
    back = lambda b: F.coalesce(C.heading_class(C.strip(b["text"])) != "bio", F.lit(False))
    last = F.coalesce(F.array_max(F.filter(F.transform(blocks, lambda b, i: F.when(b["tag"].isin("h2", "h3") & back(b), i + 1)), lambda x: x.isNotNull())), F.lit(0))
    other = _first(blocks, lambda b, i: (i > last) & _heading(b) & ~back(b))
    after = _first(blocks, lambda b, i: (i > last) & (_heading(b) | ((other > 0) & (i > other))) & holds(b))
    want = tight(following)

    def begins(b: Column) -> Column:
        # Squashing drops what introduces a review, too.
        body = F.replace(key(b), F.lit(" "), F.lit(""))
        least = F.least(F.char_length(want), F.char_length(body))
        return (least >= LEAST_OPENING) & (F.substring(body, F.lit(1), least) == F.substring(want, F.lit(1), least))

    heads = _first(blocks, lambda b, _: _heading(b) & holds(b))
    tail = _first(blocks, lambda b, i: ~_heading(b) & (i - 1 >= F.floor(F.size(blocks) * TAIL)) & begins(b))
    at = F.when(last > 0, after).when(heads > 0, heads).otherwise(tail)
    same = F.coalesce((title != "") & (tight(title) == tight(following)), F.lit(False))
    return F.when((F.coalesce(following, F.lit("")) != "") & ~same & (at > 0), F.slice(blocks, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(blocks)


def without_furniture(blocks: Column, journal: str) -> Column:
    """Without running headers and lone page numbers; a header in front of other text is cut off. `journal` is a pattern that names the journal."""
    alone = rf"(?iU)^\s*\d{{0,4}}\s*(?:(?:(?:{journal})\s*(?:\d+\.\d+\s*)?:\s*)?(?:{MONTHS})\s+\d{{4}}\s*$)"
    ahead = rf"(?iU)^\s*\d{{0,4}}\s*(?:{journal})\s+\d+\.\d+\s*:\s*(?:{MONTHS})\s+\d{{4}}\s*"
    number = lambda b: (b["tag"] == "p") & b["text"].rlike(r"(?U)^\s*\d{1,4}\s*$")
    kept = F.filter(blocks, lambda b: ~F.coalesce(number(b) | b["text"].rlike(alone), F.lit(False)))
    return F.transform(kept, lambda b: F.struct(b["tag"].alias("tag"), F.regexp_replace(b["text"], ahead, "").alias("text")))


def holds_title(title: Column, text: Column) -> Column:
    """Whether a text holds a title, or four fifths of its words of three letters or more; true without such words."""
    a, b = X.squash(title), X.squash(text)
    long = F.filter(C.words(a), lambda w: F.char_length(w) > 2)
    return F.contains(b, a) | (F.size(long) == 0) | (F.size(F.filter(long, lambda w: F.contains(b, w))) >= F.size(long) * FUZZY_SHARE - 1e-9)


def warnings(raw: Column, final: Column, title: Column, section: Column) -> Column:
    """Names of the checks that a cleaned article fails: TITLE_NOT_IN_RAW, BOOK_TITLE_MISSING, EMPTY_OUTPUT."""
    none = lambda c: F.coalesce(c, F.lit(""))
    bare, before, after = bare_title(none(title)), none(raw), none(final)
    headed = F.lower(before).rlike("|".join(SECTION_HEADS))
    parts = F.filter(F.transform(F.split(bare, "/"), C.strip), lambda p: p != "")
    return F.array_compact(F.array(
        F.when((bare != "") & ~holds_title(bare, before) & ~headed, "TITLE_NOT_IN_RAW"),
        F.when(none(section).isin(*REVIEWS) & (bare != "") & ~F.exists(parts, lambda p: holds_title(p, after)), "BOOK_TITLE_MISSING"),
        F.when(F.char_length(C.strip(after)) < LEAST_CONTENT, "EMPTY_OUTPUT"),
    ))
