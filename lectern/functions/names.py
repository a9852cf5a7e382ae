"""Names of people: folded keys, family name and initial, and the matching-blocks ratio of two strings."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from lectern.functions.wording import let

#: Words that begin a family name.
PARTICLES = ("van", "de", "du", "von", "di", "la", "le", "el", "dos", "das")


@F.pandas_udf(StringType())
def folded(s: pd.Series) -> pd.Series:
    """Without combining marks, compatibility characters decomposed (no built-in does that); null stays null."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def folded_text(c: Column) -> Column:
    """What `folded` gives, for long texts: each character folds by itself, so Python is sent the distinct ones beyond ASCII only."""
    chars = F.array_distinct(F.regexp_extract_all(c, F.lit("[^\\x00-\\x7f]"), F.lit(0)))

    def of(x: Column) -> Column:
        pairs = F.zip_with(x["chars"], F.split(x["to"], "\x00"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

        def put(p: Column) -> Column:
            single = F.filter(p, lambda q: F.char_length(q["b"]) <= 1)
            # Those without anything left come last: translate drops what has no partner.
            ordered = F.concat(F.filter(single, lambda q: q["b"] != ""), F.filter(single, lambda q: q["b"] == ""))
            plain = let(ordered, lambda o: F.call_function("translate", x["text"], F.array_join(F.transform(o, lambda q: q["a"]), ""), F.array_join(F.transform(o, lambda q: q["b"]), "")))
            return F.aggregate(F.filter(p, lambda q: F.char_length(q["b"]) > 1), plain, lambda s, q: F.replace(s, q["a"], q["b"]))

        return F.when(F.size(x["chars"]) < 1, x["text"]).otherwise(let(pairs, put))

    return let(F.struct(c.alias("text"), chars.alias("chars"), folded(F.array_join(chars, "\x00")).alias("to")), of)


def name_key(c: Column) -> Column:
    """Folded, in lower case, blanks collapsed: equal for spellings that differ in accents, case and spacing only."""
    return F.trim(F.regexp_replace(F.lower(folded(c)), r"(?U)\s+", " "))


def name_words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def family_name(c: Column) -> Column:
    """Lower-case words from the first particle after the first word on, or the last word; a lone word is itself."""
    words = name_words(F.lower(c))
    at = F.array_position(F.transform(F.slice(words, 2, 1_000), lambda w: w.isin(*PARTICLES)), True)
    return F.when(F.size(words) <= 1, F.lower(c)).when(at > 0, F.array_join(F.slice(words, (at + 1).cast("int"), F.size(words)), " ")).otherwise(F.element_at(words, -1))


def initial(c: Column) -> Column:
    """First letter of the first word, in lower case; empty without words."""
    return F.coalesce(F.substring(F.get(name_words(F.lower(c)), F.lit(0)), 1, 1), F.lit(""))


def length_window(n: Column, least: float) -> Column:
    """All lengths that a string can have whose ratio with one of length n is `least` or more: 2 min / (n + m) bounds it."""
    share = least / (2 - least)
    return F.sequence(F.ceil(n * share - 1e-9).cast("int"), F.floor(n / share + 1e-9).cast("int"))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters (longest blocks first, recursively) by both lengths; null if either is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")
