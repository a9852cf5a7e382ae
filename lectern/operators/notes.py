"""Notes and biographies put where they belong, and edits that must keep the text.

`matched_notes` aligns the markers in a text with the notes of a list, both in order; `spliced_notes` puts a full list in
place of a shorter one; `runon_bios` cuts biographies off the end of a paragraph; `proved_edit` refuses an edit that
changes letters or digits and says where. Null texts give null.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import citations as C
from lectern.functions import names as N
from lectern.functions.wording import let
from lectern.operators import blocks as B

# Fixed values ---------------------------------------------------------------------------------------------------------
TAIL_LIMIT = 2500
BIO_MARK, CONTACT_MARK = "<bold>", "Contact:"
GLUED_CONTACT = r"([a-z,.\)])(Contact:)"
GLUED_PROVENANCE = r"(?:orcid\.org/[\dX-]+|[\w.+-]+@[\w.-]+\.[a-z]{2,})(?=[A-Z][a-z])"
# ----------------------------------------------------------------------------------------------------------------------


def longest_rise(numbers: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence; of several, the one whose places come first."""
    # From the right: tails[k] is the largest number that a rise of k + 1 members can begin with.
    tails: list[int] = []
    length = [0] * len(numbers)
    for i in range(len(numbers) - 1, -1, -1):
        k = bisect_left(tails, -numbers[i])
        length[i] = k + 1
        if k == len(tails):
            tails.append(-numbers[i])
        else:
            tails[k] = -numbers[i]
    out, left, last = [], len(tails), None
    for i, n in enumerate(numbers):
        if left and length[i] == left and (last is None or n > last):
            out.append(i)
            left, last = left - 1, n
    return out


def matched_notes(markers: DataFrame, notes: DataFrame) -> DataFrame:
    """(article, number, position, text, state) from markers (article, position, number) and notes (article, number, text).

    Of the markers that have a note, as many as can be in one rising order are matched, so a misread number gives way to
    the run round it; state is matched, unplaced (a note without such a marker) or unknown (a marker left over). Every note
    comes once; of notes of one number the first by text counts. An article's markers and notes meet by its id only, and
    those of one article make one sequence, by position and number; a repeated marker counts once. Rows without article or number are left out.
    """

    @F.pandas_udf("array<int>")
    def chosen(rows: pd.Series) -> pd.Series:
        return pd.Series([longest_rise([int(n) for n in row]) for row in rows])

    one = notes.where("article is not null and number is not null").groupBy("article", "number").agg(F.min("text").alias("text"))
    own = markers.where("article is not null and number is not null").select("article", "position", "number").distinct()
    known = own.join(one.select("article", "number"), ["article", "number"], "left_semi")
    runs = known.groupBy("article").agg(F.array_sort(F.collect_list(F.struct("position", "number"))).alias("m"))
    picked = runs.withColumn("p", chosen(F.col("m.number"))).select("article", F.explode(F.transform("p", lambda i: F.get("m", i))).alias("x")).select("article", "x.number", "x.position")
    placed = one.join(picked, ["article", "number"], "left")
    state = F.when(F.col("position").isNull(), "unplaced").otherwise("matched")
    spare = own.join(picked.withColumn("taken", F.lit(True)), ["article", "number", "position"], "left").where("taken is null")
    return placed.select("article", "number", "position", "text", state.alias("state")).unionByName(spare.select("article", "number", "position", F.lit(None).cast("string").alias("text"), F.lit("unknown").alias("state")))


def spliced_notes(blocks: Column, heading: Column, notes: Column) -> Column:
    """blocks with the notes as `li` after the heading of notes, if the article has fewer there.

    Without such a heading, one is put before the references, or at the end; what stood as list items or numbered
    paragraphs between the heading and the next one goes, other blocks stay in order.
    """
    kind = lambda b: C.heading_class(C.strip(b["text"]))
    first = lambda what: F.coalesce(F.array_position(F.transform(blocks, lambda b: F.coalesce((b["tag"] == "h2") & (kind(b) == what), F.lit(False))), True).cast("int"), F.lit(0))
    items = F.transform(notes, lambda n: F.struct(F.lit("li").alias("tag"), n.alias("text")))
    head = F.array(F.struct(F.lit("h2").alias("tag"), heading.alias("text")))

    def of(at: Column) -> Column:
        end = F.coalesce(F.array_min(F.filter(F.transform(blocks, lambda b, i: F.when((i + 1 > at["notes"]) & b["tag"].isin(*B.HEADINGS), i + 1)), lambda x: x.isNotNull())), F.size(blocks) + 1)

        def put(e: Column) -> Column:
            listed = lambda b, i: (i + 1 > at["notes"]) & (i + 1 < e) & ((b["tag"] == "li") | ((b["tag"] == "p") & b["text"].rlike(r"^\d+\D")))
            have = F.size(F.filter(blocks, listed))
            rest = F.filter(F.slice(blocks, at["notes"] + 1, F.size(blocks)), lambda b, i: ~listed(b, i + at["notes"]))
            return F.when(have >= F.size(notes), blocks).otherwise(F.concat(F.slice(blocks, F.lit(1), at["notes"]), items, rest))

        before = F.when(at["references"] > 0, at["references"] - 1).otherwise(F.size(blocks))
        fresh = F.concat(F.slice(blocks, F.lit(1), before), head, items, F.slice(blocks, before + 1, F.size(blocks)))
        return F.when(at["notes"] > 0, let(end, put)).otherwise(fresh)

    return F.when(F.size(notes) > 0, let(F.struct(first("notes").alias("notes"), first("references").alias("references")), of)).otherwise(blocks)


def runon_bios(paragraph: Column) -> Column:
    """Struct(kept, bios, provenance, refused) of a paragraph in which biographies run on from the prose; null without a run.

    A run begins at the first bold mark whose stretch has a contact; each bold mark begins a biography, whose bold goes. A
    run over TAIL_LIMIT characters is refused, and the paragraph kept. What is glued to the last address is provenance.
    """
    parts = F.split(F.concat(F.lit("\u0001"), paragraph), f"(?={BIO_MARK})")
    begun = F.array_position(F.transform(parts, lambda p: F.startswith(p, F.lit(BIO_MARK)) & F.contains(p, F.lit(CONTACT_MARK))), True).cast("int")
    clean = lambda p: F.regexp_replace(C.strip(F.regexp_replace(p, "</?bold>", "")), GLUED_CONTACT, "$1 $2")

    def of(x: Column) -> Column:
        run = F.slice(x["parts"], x["at"], F.size(x["parts"]))
        kept = F.regexp_replace(F.substr(F.array_join(F.slice(x["parts"], F.lit(1), x["at"] - 1), ""), F.lit(2)), r"\s+$", "")
        bios = F.filter(F.transform(run, clean), lambda b: b != "")
        last = F.try_element_at(bios, F.lit(-1))
        end = F.regexp_extract(last, rf"^(?s:.*?){GLUED_PROVENANCE}", 0)
        whole = F.when(end == "", bios).otherwise(F.concat(F.slice(bios, F.lit(1), F.size(bios) - 1), F.array(end)))
        refused = F.char_length(F.array_join(run, "")) > TAIL_LIMIT
        none = F.array().cast("array<string>")
        said = F.struct(
            F.when(refused, F.substr(F.array_join(x["parts"], ""), F.lit(2))).otherwise(kept).alias("kept"), F.when(refused, none).otherwise(whole).alias("bios"),
            F.when(~refused & (end != ""), C.strip(F.substr(last, F.char_length(end) + 1))).alias("provenance"), refused.alias("refused"),
        )
        return F.when(x["at"] > 0, said)

    return let(F.struct(parts.alias("parts"), begun.alias("at")), of)


def content_signature(text: Column) -> Column:
    """Letters and digits of a text, folded: equal before and after a change that keeps the content."""
    return F.regexp_replace(F.lower(N.folded_text(text)), "[^0-9a-z]", "")


def common_start(a: Column, b: Column) -> Column:
    """How many characters two texts have in common from the start: a binary search over lengths."""

    def of(x: Column) -> Column:
        n = F.least(F.char_length(x["a"]), F.char_length(x["b"]))
        steps = F.transform(F.sequence(F.lit(30), F.lit(0)), lambda k: F.pow(F.lit(2.0), k).cast("int"))
        return F.aggregate(steps, F.lit(0), lambda at, k: F.when((at + k <= n) & (F.substring(x["a"], at + 1, k) == F.substring(x["b"], at + 1, k)), at + k).otherwise(at))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def proved_edit(df: DataFrame, before: str, after: str, to: str = "edit", around: int = 30) -> DataFrame:
    """df with the struct `to`: text (the edited one if both have one signature, else the former), refused, and where they differ.

    at is the place in the signatures of the first difference (null if none), was and got what stands round it. A null
    text counts as empty.
    """
    signed = df.withColumn("__a", content_signature(F.coalesce(F.col(before), F.lit("")))).withColumn("__b", content_signature(F.coalesce(F.col(after), F.lit(""))))
    at = signed.withColumn("__at", F.when(F.col("__a") != F.col("__b"), common_start(F.col("__a"), F.col("__b"))))
    part = lambda c: F.when(F.col("__at").isNotNull(), F.substring(F.col(c), F.greatest(F.col("__at") - around, F.lit(0)) + 1, F.least(F.col("__at"), F.lit(around)) + around))
    said = F.struct(F.when(F.col("__at").isNull(), F.col(after)).otherwise(F.col(before)).alias("text"), F.col("__at").isNotNull().alias("refused"), F.col("__at").alias("at"), part("__a").alias("was"), part("__b").alias("got"))
    return at.withColumn(to, said).drop("__a", "__b", "__at")
