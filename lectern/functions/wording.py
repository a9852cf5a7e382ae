"""Column functions over titles, names, identifiers and markup of articles; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a title keeps in lower case.
SMALL_WORDS = ("a", "an", "the", "and", "but", "or", "nor", "for", "yet", "so", "in", "on", "at", "to", "by", "of", "as", "is", "it")
#: What a block of markup is, and the shape of an identifier.
BLOCK_TAGS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "table", "thead", "tbody", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "section", "hr")
DOI_SHAPE = "^10\\.[0-9]{4,9}/[!-~]+$"


def let(value: Column, f) -> Column:
    """f(value), with value worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# ------------------------------------------------------------------------------------------------ titles and names


def spaced_key(c: Column) -> Column:
    """Lower case; hyphens and apostrophes part words, all else but letters, digits and blanks goes."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(c, "[-']", " ")), "[^a-z0-9 ]", ""), " +", " "))


def squash_spaced(c: Column) -> Column:
    """Lower case; apostrophes go, everything else but letters and digits is one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "['’]", ""), "[^a-z0-9]+", " "))


def squash_tight(c: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def squash_plain(c: Column) -> Column:
    """Without tags, blanks, control characters, soft hyphens and bullets."""
    return F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"(?U)[\s\x00-\x1f­•▪●◦-]", "")


def plain_title(c: Column) -> Column:
    """Lower case without quotes, blanks collapsed, points trimmed at both ends."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[“”‘’\"']", ""), r"\s+", " ")
    return F.regexp_replace(plain, "^[ .,;:]+|[ .,;:]+$", "")


def name_variants(authors: Column) -> Column:
    """The byline, and the one in which each name of more than two words is its first and last word, if that differs."""
    parts = F.transform(F.split(authors, r",\s*|\s+and\s+"), lambda p: let(F.filter(F.split(F.trim(p), r"\s+"), lambda w: w != ""), lambda w: F.when(F.size(w) > 2, F.concat_ws(" ", F.get(w, 0), F.element_at(w, -1))).otherwise(F.trim(p))))
    short = F.when(F.contains(authors, F.lit(",")), F.array_join(parts, ", ")).when(F.contains(authors, F.lit(" and ")), F.array_join(parts, " and ")).otherwise(F.get(parts, 0))
    return F.array_compact(F.array(authors, F.nullif(short, authors)))


def title_case(c: Column) -> Column:
    """Each word with a capital, SMALL_WORDS in lower case but for the first; marks round a word stay."""

    def cased(word: Column, i: Column) -> Column:
        core = F.regexp_extract(word, r"^[^\p{L}]*(.*?)[^\p{L}]*$", 1)
        low = F.lower(core)
        said = F.when((i > 0) & low.isin(*SMALL_WORDS), low).otherwise(F.concat(F.upper(F.substring(core, 1, 1)), F.substr(low, F.lit(2))))
        return F.when(core == "", word).otherwise(F.concat(F.regexp_extract(word, r"^([^\p{L}]*)", 1), said, F.regexp_extract(word, r"([^\p{L}]*)$", 1)))

    return F.array_join(F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), cased), " ")


def normal_caps(c: Column) -> Column:
    """Title case for text in capitals, or for what stands in capitals before a quotation; Roman numerals and other text stay."""
    capitals = lambda x: x.rlike(r"\p{L}") & ~x.rlike(r"[\p{L}&&[^\p{Lu}]]")
    before = F.regexp_extract(c, "^([^\"'“]+)[\"'“]", 1)
    head = F.regexp_replace(before, r"\s+$", "")
    return F.when(F.trim(c).rlike("^[IVXLCDM]+$"), c).when(capitals(c), title_case(c)).when((before != "") & capitals(before), F.concat(title_case(head), F.substr(c, F.char_length(head) + 1))).otherwise(c)


def primary_role(roles: Column) -> Column:
    """The first of a list of roles; empty for none."""
    return F.trim(F.get(F.split(roles, ","), 0))


def publisher_parts(c: Column) -> Column:
    """(location, name) of `location: name`; location is null without one."""
    at = F.instr(c, ": ")
    return F.struct(F.when(at > 0, F.substring(c, F.lit(1), at - 1)).alias("location"), F.when(at > 0, F.substr(c, at + 2)).otherwise(c).alias("name"))


def editor_parts(c: Column) -> Column:
    """(is_editor, people) of a byline that may be marked (ed.) or (eds.)."""
    mark = r"\(eds?\.?\)"
    return F.struct(c.rlike(mark).alias("is_editor"), F.trim(F.regexp_replace(c, rf"\s*{mark}\s*", "")).alias("people"))


# ------------------------------------------------------------------------------------------------ markup and amounts


def without_controls(c: Column) -> Column:
    """Three and more line feeds to two, trimmed, control characters but tab, line feed and return gone."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"^\s+|\s+$", ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def without_fences(c: Column) -> Column:
    """Without a code fence round the text; the fence's first line goes with it."""
    inner = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), "^```[^\n]*\n", "")
    return F.when(F.endswith(inner, F.lit("```")), F.regexp_replace(inner, r"```$", "")).otherwise(inner)


def fences_trimmed(c: Column) -> Column:
    return F.regexp_replace(without_fences(c), r"\s+$", "")


def separated_blocks(html: Column) -> Column:
    """A line feed after every block element, so that a link at its end doesn't run into the next word."""
    return F.regexp_replace(html, "(?i)(</(?:" + "|".join(t for t in BLOCK_TAGS if t != "hr") + r")\s*>|<hr\b[^>]*>)", "$1\n")


def amount_problem(expected: Column, currency: Column, paid_minor: Column, paid_currency: Column) -> Column:
    """What is wrong with a payment in minor units: amount, currency, or null."""
    return F.when(F.round(expected * 100).cast("long") != paid_minor, "amount").when(F.upper(currency) != F.upper(paid_currency), "currency")


def wrap_ratio(text: Column) -> Column:
    """Share of a text's lines, blank ones aside, that end with a blank and so go on; 0 without lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return let(lines, lambda v: F.when(F.size(v) > 0, F.size(F.filter(v, lambda x: F.endswith(x, F.lit(" ")))) / F.size(v)).otherwise(0.0))


def paragraphs(text: Column, furniture: Column) -> Column:
    """Paragraphs of a text whose lines go on where they end with a blank; lines of furniture (squashed) and bare page numbers go first."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).rlike("^[0-9]{1,4}$") & ~F.array_contains(furniture, squash_plain(x)))
    ended = F.transform(lines, lambda x: F.when(F.trim(x) == "", "\n").when(F.endswith(x, F.lit(" ")), x).otherwise(F.concat(x, F.lit("\n"))))
    return F.filter(F.transform(F.split(F.array_join(ended, ""), "\n"), lambda p: F.trim(p)), lambda p: p != "")


# ------------------------------------------------------------------------------------------------ identifiers


def valid_own_doi(doi: Column, prefix: str, suffix: str) -> Column:
    """Whether an identifier is under our prefix and has a suffix that we give out."""
    return doi.rlike(DOI_SHAPE) & F.startswith(F.lower(doi), F.lit(prefix)) & F.substr(doi, F.lit(len(prefix) + 1)).rlike(f"(?i)^(?:{suffix})$")


def suggested_own_doi(doi: Column, prefix: str, size: int = 8) -> Column:
    """What a run-on under our prefix was probably meant to be: its first `size` letters and digits; null if that changes nothing."""
    core = F.regexp_extract(F.substr(doi, F.lit(len(prefix) + 1)), f"^[A-Za-z0-9]{{{size}}}", 0)
    guess = F.concat(F.lit(prefix), core)
    return F.when(F.startswith(F.lower(doi), F.lit(prefix)) & (core != "") & (F.lower(guess) != F.lower(doi)), guess)


def doi_problem(doi: Column, cleaned: Column, prefix: str, suffix: str) -> Column:
    """Why an identifier can't be used (empty, run_on, unusable, malformed), or null; cleaned is what cleaning makes of it."""
    raw = F.trim(F.coalesce(doi, F.lit("")))
    return F.when(raw == "", "empty").when(F.startswith(F.lower(raw), F.lit(prefix)) & ~valid_own_doi(raw, prefix, suffix), "run_on").when(cleaned.isNull() | ~cleaned.rlike(DOI_SHAPE), "unusable").when(cleaned != raw, "malformed")


def without_doi(text: Column, doi: Column) -> Column:
    """A reference without its identifier, what introduces it and a note of access; ends with one full stop."""
    quoted = F.concat(F.lit(r"\Q"), doi, F.lit(r"\E"))
    pattern = F.concat(F.lit(r"\s*(?:(?:doi|DOI)\s*:\s*)?(?:(?:https?://)?doi\.org/)?"), quoted, F.lit(r"\.?(?:\s*\[Accessed[^\]]*\]\.?)?"))
    cut = F.trim(F.regexp_replace(text, pattern, F.lit("")))
    return F.when(F.contains(text, doi), F.concat(F.regexp_replace(cut, "[. ]+$", ""), F.lit("."))).otherwise(text)


# ------------------------------------------------------------------------------------------------ phrases


def phrase_end(words: Column, phrase: Column, most: int = 5) -> Column:
    """Place (from 0) of the word at which the phrase's words first stand in order, with at most `most` others between two; -1 without.

    An automaton over the words: for each start of the phrase it keeps where that start last ended, which is all that a
    gap's limit needs, so time is words x phrase. The first word may end a longer word and the last may begin one.
    """
    n = F.size(phrase)

    def hit(w: Column, p: Column, j: Column) -> Column:
        return F.when(n == 1, F.contains(w, p)).when(j == 0, F.endswith(w, p)).when(j == n - 1, F.startswith(w, p)).otherwise(w == p)

    def step(a: Column, x: Column) -> Column:
        moved = F.transform(phrase, lambda p, j: F.when(hit(x["w"], p, j) & ((j == 0) | (F.get(a["last"], j - 1) >= x["at"] - most - 1)), x["at"]).otherwise(F.get(a["last"], j)))
        return let(moved, lambda m: F.struct(m.alias("last"), F.when((a["found"] < 0) & (F.get(m, n - 1) == x["at"]), x["at"]).otherwise(a["found"]).alias("found")))

    # A start that never ended lies further back than any gap reaches.
    start = F.struct(F.transform(phrase, lambda p: F.lit(-(most + 2))).alias("last"), F.lit(-1).alias("found"))
    # A word that fits no place of the phrase changes nothing: the automaton moves at the others only.
    placed = F.transform(words, lambda w, i: F.when(F.exists(phrase, lambda p: F.contains(w, p)), F.struct(w.alias("w"), i.alias("at"))))
    return F.when(n > 0, F.aggregate(F.array_compact(placed), start, step)["found"]).otherwise(-1)


# ------------------------------------------------------------------------------------------------ lines of a layout


def line_role(size: Column, largest: Column, sans: Column, bold: Column, italic: Column) -> Column:
    """Role of a line by the size and family of its font; the first rule that holds (sizes are fixed values)."""
    return (
        F.when(largest <= 8.5, "furniture").when(sans & bold & (size >= 20.0), "banner").when(sans & bold & (size >= 14.0), "title").when(sans & bold & (size >= 11.5), "booktitle")
        .when(sans & bold & (size >= 10.0), "byline").when(sans, "strapline").when(bold & (size >= 11.5), "heading").when(bold & italic & (size >= 9.0), "subheading").otherwise("body")
    )
