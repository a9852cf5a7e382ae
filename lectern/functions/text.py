"""Column functions over strings: titles, names, numbers, identifiers. All native, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.wording import let


def squash(c: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and blanks dropped, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""), " +", " "))


def match_key(c: Column) -> Column:
    """Tags gone, letters and blanks kept, blanks collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), "[^a-zA-Z ]", ""), " +", " ")))


def title_key(c: Column) -> Column:
    """`&` spelt out, all but letters, digits and underscores dropped, blanks collapsed, lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit("and")), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def plain_blanks(c: Column) -> Column:
    """Blanks beyond ASCII and control characters that count as blanks (Python's `\\s`) become plain blanks."""
    return F.regexp_replace(c, r"[\x0B\x1C-\x1F\x85\p{Z}]", " ")


def slug(c: Column, most: int = 80) -> Column:
    """Lower-case words joined by hyphens, cut to `most` characters without a hyphen at the end."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, most), "-$", "")


def truncated(c: Column, most: int = 1000, mark: str = "...[truncated]") -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def leading_number(c: Column) -> Column:
    """The number that starts a note and is followed by a full stop, a bracket or a blank; null without one, or beyond a long."""
    return F.nullif(F.regexp_extract(c, r"^(\d+)[.)\s]", 1), F.lit("")).try_cast("long")


def without_number(c: Column) -> Column:
    """A note without the number (of three digits at most) that starts it, bare or in brackets."""
    return F.regexp_replace(F.regexp_replace(c, r"^(?:\(\d{1,3}\)\s*|\d{1,3}[.)\s]+)", ""), r"^\s+|\s+$", "")


def word_overlap(a: Column, b: Column) -> Column:
    """Share of the words of a (with repeats) that b holds; 1 if b contains a; null without words."""
    def share(v: Column) -> Column:
        # A word stands between blanks, so b is searched and not split.
        hit = lambda words: F.size(F.filter(words, lambda w: F.contains(v["padded"], F.concat(F.lit(" "), w, F.lit(" ")))))
        return let(F.filter(F.split(v["a"], " "), lambda w: w != ""), lambda words: F.when(F.size(words) == 0, None).when(F.contains(v["b"], v["a"]), 1.0).otherwise(hit(words) / F.size(words)))

    # Both may be long expressions: they are worked out once, not once a word.
    return let(F.struct(a.alias("a"), b.alias("b")), lambda v: let(F.struct(v["a"].alias("a"), v["b"].alias("b"), F.concat(F.lit(" "), v["b"], F.lit(" ")).alias("padded")), share))


def title_similarity(title: Column, text: Column) -> Column:
    """Of two title keys: 1 if the text holds a title of two words or more, else the title's distinct words that it has by all the title's words, halved for a lone word."""
    w = F.split(title, " ")
    share = F.size(F.array_intersect(w, F.split(text, " "))) / F.size(w)
    return F.when((title == "") | (text == ""), 0.0).when(F.size(w) < 2, share * 0.5).when(F.contains(text, title), 1.0).otherwise(share)


#: Words that say nothing about a title, and the shares of the others from which on a text passes or is suspect.
TITLE_STOP_WORDS = (
    "a", "an", "and", "the", "of", "in", "on", "to", "for", "is", "it", "by", "at", "or", "as", "from", "with", "its", "not", "be", "are", "was", "but", "no", "if", "we", "our", "has", "had", "how", "when",
    "what", "who", "which", "that", "this", "my", "me", "can", "book", "review", "reviews", "editorial", "obituary",
)
TITLE_PASS, TITLE_WARN = 0.6, 0.3


def title_verdict(title: Column, text: Column) -> Column:
    """Struct(status, matched, total, missing): how many of the title's telling words (three letters or more) the text holds; pass, warn or fail. A title without such words passes; a null one, or a null text, counts as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i)^(?:Book Review|Obituary)\s*:\s*", "")
    words = F.filter(F.regexp_extract_all(F.lower(bare), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.char_length(w) > 2) & ~w.isin(*TITLE_STOP_WORDS))
    missing = F.filter(words, lambda w: ~F.contains(low, w))
    total, matched = F.size(words), F.size(words) - F.size(missing)
    share = F.when(total == 0, 1.0).otherwise(matched / total)
    return F.struct(F.when(share >= TITLE_PASS, "pass").when(share >= TITLE_WARN, "warn").otherwise("fail").alias("status"), matched.alias("matched"), total.alias("total"), missing.alias("missing"))


def person(c: Column) -> Column:
    """struct(given, family) of a byline name; particles before the last word belong to the family name."""
    w = F.filter(F.split(F.trim(c), " +"), lambda x: x != "")
    n = F.size(w)
    particle = F.lower(F.get(w, n - 2)).isin("van", "von", "de", "der", "den", "du", "la", "le", "di", "da")
    cut = F.when((n > 2) & particle, n - 2).otherwise(n - 1)
    return F.struct(F.array_join(F.slice(w, 1, F.greatest(cut, F.lit(0))), " ").alias("given"), F.array_join(F.slice(w, F.greatest(cut, F.lit(0)) + 1, n), " ").alias("family"))


def bylines(c: Column) -> Column:
    """Names of a byline, split at `&`, `,` and `and`."""
    return F.filter(F.transform(F.split(c, " *(?:&|,| and ) *"), F.trim), lambda x: x != "")


def stripped_tags(c: Column) -> Column:
    """Text of simple HTML: tags to blanks, the five usual entities decoded, blanks collapsed."""
    out = F.regexp_replace(F.regexp_replace(c, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def partial_date(c: Column) -> Column:
    """Full dates as they are; `Month YYYY` the first of the month; `YYYY` the first of July."""
    full = F.try_to_date(c, "yyyy-MM-dd")
    month = F.try_to_date(F.concat(F.lit("1 "), c), "d MMMM yyyy")
    year = F.when(c.rlike("^[0-9]{4}$"), F.try_to_date(F.concat(c, F.lit("-07-01")), "yyyy-MM-dd"))
    return F.coalesce(full, month, year)


def strict_date(c: Column) -> Column:
    """Whether a string is a Y-m-d date that survives a round trip."""
    return F.coalesce(F.date_format(F.try_to_date(c, "yyyy-MM-dd"), "yyyy-MM-dd") == c, F.lit(False))


def ip_number(c: Column) -> Column:
    """IPv4 address as a number, null if it is none."""
    octet = lambda k: F.split(c, "\\.").getItem(k).cast("long")
    ok = c.rlike("^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$")
    return F.when(ok, octet(0) * 16777216 + octet(1) * 65536 + octet(2) * 256 + octet(3))


def in_cidr(ip: Column, cidr: str) -> Column:
    """Whether an address is in a block; an exact match for one without prefix or for IPv6; an invalid prefix matches nothing."""
    net, _, bits = cidr.partition("/")
    if not bits or ":" in net:
        return ip == cidr
    if not bits.isdigit() or int(bits) > 32:
        return F.lit(False)
    size = 1 << (32 - int(bits))
    base = sum(int(x) << (8 * (3 - k)) for k, x in enumerate(net.split("."))) // size * size
    return F.coalesce(ip_number(ip).between(base, base + size - 1), F.lit(False))


def first_doi(c: Column) -> Column:
    """The first identifier of the shape 10.NNNN/suffix, cleaned; null without one."""
    return clean_doi(F.nullif(F.regexp_extract(c, "10\\.[0-9]{4,9}/[^\\s\"<>]+", 0), F.lit("")))


def clean_doi(c: Column) -> Column:
    """Zero-width characters gone, look-alike hyphens made plain, what trails (punctuation, a lone bracket) trimmed, a second identifier cut off."""
    plain = F.translate(c, "‐‑‒–​‌‍﻿", "----")
    once = F.regexp_replace(plain, "^(10\\.[0-9]{4,9}/.+?)(?:https?:|doi:|10\\.[0-9]{4,9}/).*$", "$1")
    return F.regexp_replace(once, "[.,;:)\\]'\"]+$", "")


def link_class(href: Column) -> Column:
    """Kind of a link; the first rule that holds."""
    return (
        F.when(href.rlike("(?i)\\.pdf(?:$|[?#])|/download/"), "download").when(href.rlike("(?i)/(?:purchase|checkout|cart)"), "purchase").when(href.rlike("(?i)/(?:membership|join|subscribe)"), "membership")
        .when(href.rlike("(?i)doi\\.org/"), "doi").when(href.rlike("(?i)/(?:register|signup)"), "register").when(href.rlike("(?i)/(?:login|signin)"), "login").otherwise("other")
    )
