"""Identifier matching: query variants of a reference, and the verdict on what a lookup found for it."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lectern.functions import citations as C
from lectern.functions import text as X

# Fixed values ---------------------------------------------------------------------------------------------------------
IDENTIFIER = r"10\.\d{4,}/\S+"
#: Similarity from which on a lookup score from the second value on is enough.
TIERS = ((1.0, 20), (0.8, 40), (0.7, 60))
SURE_SCORE, LEAST_FAMILY, LEAST_FUZZY, NEAR = 50, 3, 5, 0.85
PARTICLES = ("van", "de", "du", "von", "di", "la", "le", "el", "den", "der")
NEVER_CITED = ("dataset", "component", "reference-entry")
BOOK = (
    r"\b(?:Press|Publisher|Books?|Verlag|Éditions?|Gallimard|Grasset|Vintage|Routledge|Sage|Springer|Wiley|Blackwell|Penguin|Harper|Random House"
    r"|Oxford University|Cambridge University|Yale University|Princeton University|Harvard University)\b"
)
ARTICLE = r"\b(?:Journal|Review|Quarterly|Bulletin|Annals|Studies|Analysis)\b.*\d+\s*\(\d+\)"
REFERENCE_WORK = r"\b(?:Dictionary|Companion|Encyclopedia|Encyclopaedia|Handbook)\b"
IN_BOOK = r"\.\s+In\s+[A-ZÀ-Ý]"
NO_CONTAINER_WORDS = ("the", "and", "for", "vol", "new", "int", "its")
#: What a query is freed of, and what takes its place, in this order.
NOISE = (
    (r"\[.*?\]", ""), (r"(?i)\((?:Lecture|ed|eds|trans)[\s.].*?\)", ""), (r"(?i)\(eds?\.?\)", ""),
    (r",?\s*Trans\.\s+[A-ZÀ-Ý][a-zà-ÿ]+,\s*[A-Z]\.?(?:\s*&\s*[A-ZÀ-Ý][a-zà-ÿ]+,\s*[A-Z]\.?[A-Z]?\.?)*(?:\s*\(\d{4}\))?\.?", ""),
    (r"\.\s*\.", "."), (r",\s*&\s*,", ","), (r"\(\s+\)", ""), (r"\s+", " "),
)
EDITOR_LED = r"(?i)^[A-ZÀ-Ý][a-zà-ÿ]+,.*?\((?:eds?\.?|trans\.?)\).*?\.\s+In\s+([A-ZÀ-Ý][a-zà-ÿ]+,\s*.+)"
DATED_TITLE, PLAIN_TITLE = r"^([A-ZÀ-Ý][a-zà-ÿ]+),\s*\S+\s*\(\d{4}.*?\)\.?\s*(.+?)\.", r"^([A-ZÀ-Ý][a-zà-ÿ]+),\s*\S+\.?\s+(.+?)\."
# ----------------------------------------------------------------------------------------------------------------------


def _found(c: Column, pattern: str, group: int) -> Column:
    """The group of a pattern's first match; null without a match."""
    return F.when(C.has(c, pattern), F.regexp_extract(c, f"(?Ud){pattern}", group))


def _minimal(c: Column) -> Column:
    """Surname and title, if the title has two words."""
    def said(pattern: str) -> Column:
        title = C.strip(_found(c, pattern, 2))
        return F.concat_ws(" ", _found(c, pattern, 1), F.when(F.size(C.words(title)) >= 2, title))

    return F.when(C.has(c, DATED_TITLE), said(DATED_TITLE)).when(C.has(c, PLAIN_TITLE), said(PLAIN_TITLE))


def query_variants(c: Column) -> Column:
    """Up to five distinct queries for a reference, the fullest first; null for null."""
    base = C.strip(C.cut(C.cut(c, IDENTIFIER), r"^\d+[.)]\s*"))
    cleaned = C.strip(reduce(lambda x, p: F.regexp_replace(x, f"(?Ud){p[0]}", p[1]), NOISE, base))
    book = C.strip(_found(base, EDITOR_LED, 1))
    enough = lambda m: F.when(F.contains(m, F.lit(" ")), m)
    return F.when(c.isNotNull(), F.array_distinct(F.array_compact(F.array(base, cleaned, book, enough(_minimal(base)), enough(_minimal(book))))))


def type_mismatch(ref: Column, kind: Column) -> Column:
    """Whether a work of this type can't be what the reference cites."""
    article, book = C.has(ref, ARTICLE, case=False), C.has(ref, BOOK, case=False)
    return F.coalesce(
        F.when(kind.isin(*NEVER_CITED), True).when(article & (kind == "journal-article"), False).when(article & (kind == "book-chapter"), True)
        .when(book & (kind == "journal-article"), True).when(book & (kind == "book-chapter"), ~C.has(ref, IN_BOOK)),
        F.lit(False),
    )


def container_mismatch(ref: Column, container: Column, score: Column, own: str | None = None) -> Column:
    """Whether a low-scored work's journal or series shares no word of four letters with the reference; never for containers that `own` (a pattern) names."""
    known = F.array_distinct(F.transform(F.regexp_extract_all(container, F.lit("[A-Za-z]{4,}"), 0), F.lower))
    known = F.filter(known, lambda w: ~w.isin(*NO_CONTAINER_WORDS))
    strange = (score < SURE_SCORE) & (F.size(known) > 0) & ~F.exists(known, lambda w: F.contains(F.lower(ref), w))
    return F.coalesce(strange & ~C.has(container, own, case=False) if own else strange, F.lit(False))


@F.pandas_udf(BooleanType())
def author_match(refs: pd.Series, families: pd.Series) -> pd.Series:
    """Whether a family name is in the reference, accents and particles aside, or nearly a word of it; true without any names.

    Folding accents and the ratio have no built-in, so one pass over Arrow batches does both; the ratio is only computed
    where the lengths allow it.
    """
    def folded(x: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()

    def near(f: str, w: str) -> bool:
        return 2 * min(len(f), len(w)) >= NEAR * (len(f) + len(w)) and SequenceMatcher(None, f, w).ratio() >= NEAR

    def match(ref: str | None, names: list | None) -> bool:
        if names is None or len(names) == 0:
            return True
        text = folded(ref or "")
        known = [folded(n) for n in names if n and len(n) >= LEAST_FAMILY]
        bare = [f.split(" ", 1)[1] if f.split(" ", 1)[0] in PARTICLES and " " in f else f for f in known]
        if any(f in text for f in known + bare):
            return True
        long = [f for f in bare if len(f) >= LEAST_FUZZY]
        said = {w for w in re.findall(r"[^\W\d_]+", text) if len(w) >= LEAST_FUZZY} if long else ()
        return any(near(f, w) for f in long for w in said)

    return pd.Series([match(r, n) for r, n in zip(refs, families)], dtype=bool)


def judged(found: DataFrame, own: str | None = None) -> DataFrame:
    """Lookup results (text, title, container, kind, score, families) with similarity, author_match, mismatch, own_match and matched.

    `own` is a pattern that names one's own journal: a reference to it and a result from it need no lookup score.
    """
    ref, title, container = F.coalesce("text", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("container", F.lit(""))
    score = F.coalesce("score", F.lit(0)).cast("double")
    work = C.has(container, REFERENCE_WORK, case=False) & ~C.has(ref, REFERENCE_WORK, case=False)
    d = found.withColumns({
        "similarity": X.title_similarity(X.title_key(title), X.title_key(ref)), "author_match": author_match(ref, F.col("families")),
        "__wrong": work | type_mismatch(ref, F.col("kind")), "__strange": container_mismatch(ref, container, score, own),
    })
    good = reduce(Column.__or__, [(F.col("similarity") >= s) & (score >= n) for s, n in TIERS]) & F.col("author_match")
    mine = C.has(ref, own, case=False) & C.has(container, own, case=False) & F.col("author_match") & (F.col("similarity") >= TIERS[-1][0]) & ~F.col("__wrong") if own else F.lit(False)
    d = d.withColumn("mismatch", F.col("__wrong") | F.col("__strange")).withColumn("own_match", mine)
    return d.withColumn("matched", F.col("own_match") | (good & ~F.col("mismatch"))).drop("__wrong", "__strange")


def best_match(judgements: DataFrame, *keys: str) -> DataFrame:
    """Of each key's results the best: matched, then from one's own journal, then by similarity, score and smallest identifier."""
    rank = F.struct(~F.col("matched"), ~F.col("own_match"), -F.col("similarity"), -F.coalesce("score", F.lit(0)).cast("double"), F.col("doi"))
    rest = [c for c in judgements.columns if c not in keys]
    return judgements.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__b")).select(*keys, "__b.*")


def from_cache(refs: DataFrame, cache: DataFrame, own: str | None = None) -> DataFrame:
    """Refs (article, ref_id, text) with what the cache (article, text, doi, matched, container, score) says of the same text, whatever its place then.

    cached tells whether it says anything; a match whose container the present rule rejects is none. Of several entries the first identifier counts.
    """
    one = cache.groupBy("article", "text").agg(F.min_by(F.struct("doi", "matched", "container", "score"), F.struct(F.col("doi").isNull(), "doi")).alias("__c"))
    d = refs.join(one, ["article", "text"], "left")
    c = lambda k: F.col("__c").getField(k)
    bad = container_mismatch(F.col("text"), c("container"), F.coalesce(c("score"), F.lit(0)).cast("double"), own)
    return d.select("article", "ref_id", "text", F.col("__c").isNotNull().alias("cached"), c("doi").alias("doi"), (F.coalesce(c("matched"), F.lit(False)) & ~bad).alias("matched"))
