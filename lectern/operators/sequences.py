"""Operators over ordered rows of a document: numbered items, back matter, runs of equal style, margins, furniture."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from lectern.functions.wording import let

#: An indent is wider than the first and no wider than the second, in points.
INDENT = (5.0, 15.0)
#: Decimal digits of all scripts and their values; blanks as Python's split sees them.
DIGITS = "".join(chr(c) for c in range(0x110000) if chr(c).isdecimal())
BLANK = r"[\s\x1c-\x1f]"
NUMBERED = rf"(?Ud)^(\d+){BLANK}*(.+)"


@F.pandas_udf(ArrayType(IntegerType()))
def _starts(numbers: pd.Series) -> pd.Series:
    """Places (from 0) of the numbers 1, 2, … of an array, each after the last. The running number is state; only numbers come to Python."""

    def places(row: list | None) -> list:
        found: list[int] = []
        for i, n in enumerate([] if row is None else row):
            if n == len(found) + 1:
                found.append(i)
        return found

    return numbers.map(places)


def numbered_items(lines: Column | str) -> Column:
    """Items 1, 2, … of an array of lines: a line whose number follows the last one starts an item, others go on with it.

    Null with fewer than three items.
    """
    lines = F.col(lines) if isinstance(lines, str) else lines
    ascii_digits = "".join(str(int(c)) for c in DIGITS)
    number = lambda x: F.regexp_replace(F.translate(F.regexp_extract(x, NUMBERED, 1), DIGITS, ascii_digits), "^0+", "")
    # Zero stands for no number and for one that no array is long enough for.
    numbers = F.transform(lines, lambda x: let(number(F.coalesce(x, F.lit(""))), lambda n: F.when((n != "") & (F.char_length(n) < 10), n.cast("int")).otherwise(0)))

    def items(x: Column) -> Column:
        def item(at: Column, j: Column) -> Column:
            end = F.coalesce(F.get(x["starts"], j + 1), F.size(x["lines"]))
            rest = F.slice(x["lines"], at + 2, end - at - 1)
            said = F.concat_ws(" ", F.regexp_extract(F.get(x["lines"], at), NUMBERED, 2), rest)
            return F.regexp_replace(F.regexp_replace(said, rf"(?U){BLANK}+", " "), "^ | $", "")

        return F.when(F.size(x["starts"]) >= 3, F.transform(x["starts"], item))

    return let(F.struct(lines.alias("lines"), _starts(numbers).alias("starts")), items)


def back_matter(df: DataFrame, key: str, pos: str, back: Column) -> DataFrame:
    """Rows from the start of the last contiguous stretch of back matter on; rows after that stretch stay, keys without one go."""
    w = Window.partitionBy(key)
    flagged = df.withColumn("__back", F.coalesce(back, F.lit(False))).withColumn("__last", F.max(F.when(F.col("__back"), F.col(pos))).over(w))
    stop = F.max(F.when(~F.col("__back") & (F.col(pos) < F.col("__last")), F.col(pos))).over(w)
    return flagged.withColumn("__stop", stop).where(F.col("__last").isNotNull() & (F.col("__stop").isNull() | (F.col(pos) > F.col("__stop")))).drop("__back", "__last", "__stop")


def merged_runs(df: DataFrame, key: str, pos: str, style: str, text: str, sep: str = "") -> DataFrame:
    """(key, style, first, n, text): neighbours of equal style in one row, their texts joined in order."""
    w = Window.partitionBy(key).orderBy(pos)
    fresh = F.when(F.row_number().over(w) == 1, 1).when(F.lag(style).over(w).eqNullSafe(F.col(style)), 0).otherwise(1)
    runs = df.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda x: x[text]), sep)
    out = runs.groupBy(key, "__run").agg(F.first(style).alias(style), F.min(pos).alias("first"), F.count(F.lit(1)).alias("n"), joined.alias("text"))
    return out.drop("__run")


def margins(df: DataFrame, page: str, left: str, right: str, indent: tuple[float, float] = INDENT) -> DataFrame:
    """(page, margins, right): left edges in ascending order, without those that an earlier margin explains as itself or as its indent."""
    low, high = (F.lit(x) for x in indent)
    edges = F.array_sort(F.collect_set(F.round(left, 1)))

    def step(known: Column, x: Column) -> Column:
        explained = F.exists(known, lambda m: ((x - m > low) & (x - m <= high)) | (F.abs(x - m) <= low))
        return F.when(explained, known).otherwise(F.concat(known, F.array(x)))

    return df.groupBy(page).agg(edges.alias("edges"), F.max(F.round(right, 1)).alias("right")).select(page, F.aggregate("edges", F.array().cast("array<double>"), step).alias("margins"), "right")


def run_together(text: Column, most: int = 28) -> Column:
    """Whether a word is longer than `most` letters and no link, address or path."""
    return F.exists(F.split(text, r"\s+"), lambda w: w.rlike(f"[A-Za-z]{{{most + 1},}}") & ~w.rlike("[/@.:]"))


def signature(text: Column) -> Column:
    """Lower-case letters and digits only: equal before and after a change that keeps the content."""
    return F.regexp_replace(F.lower(text), "[^0-9a-z]", "")
