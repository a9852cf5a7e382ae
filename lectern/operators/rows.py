"""Relational operators: latest rows, top-k, joins with stated tie rules, set differences, pages and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; a window, so one shuffle by key and no self-join."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The best k rows of each key, ranks from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def band_topk(df: DataFrame, key: str, other: str, score: str, low: float, high: float, k: int) -> DataFrame:
    """low <= score < high first, then the best k of each key by score and smallest other: duplicates never take a place."""
    return top_k(df.where((F.col(score) >= low) & (F.col(score) < high)), [key], [F.desc(score), F.asc(other)], k)


def pivot_settings(df: DataFrame, key: str, name: str, value: str, wanted: Sequence[str]) -> DataFrame:
    """Attribute rows to one row per key in one aggregation, whatever the number of attributes; names in any case."""
    return df.groupBy(key).agg(*[F.max(F.when(F.lower(name) == w.lower(), F.col(value))).alias(w) for w in wanted])


def null_dominant_max(col: str) -> Column:
    """The largest value of a group, or null (never ends) if any is null."""
    return F.when(F.bool_or(F.col(col).isNull()), None).otherwise(F.max(col))


def ordered_concat(value: str, order: str, sep: str) -> Column:
    """Values of a group joined in order; ties by value."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v")))), lambda x: x["v"]), sep)


def ordered_rules(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First rule that holds gives the value."""
    out = None
    for cond, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def difference(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of left whose key right doesn't hold."""
    return left.join(right.select(*on).distinct(), list(on), "left_anti")


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page in an order that must be unique, with the total number of rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by a hash of key and seed: the same ones every time."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)


def changed_blocks(df: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """Without blocks that equal the kept block before them, compared on stripped text."""
    w = Window.partitionBy(key).orderBy(pos)
    return df.withColumn("__last", F.lag(F.trim(text)).over(w)).where(F.col("__last").isNull() | (F.trim(text) != F.col("__last"))).drop("__last")


def sessions(df: DataFrame, key: str, order: str, gap_seconds: int) -> DataFrame:
    """Adds `session`, from 1: a row further than the gap from the one before starts the next."""
    w = Window.partitionBy(key).orderBy(order, "event_id") if "event_id" in df.columns else Window.partitionBy(key).orderBy(order)
    fresh = F.when(F.unix_micros(F.col(order).cast("timestamp")) - F.lag(F.unix_micros(F.col(order).cast("timestamp"))).over(w) <= gap_seconds * 1_000_000, 0).otherwise(1)
    return df.withColumn("__new", fresh).withColumn("session", F.sum("__new").over(w)).drop("__new")


def gaps(df: DataFrame, col: str, block: int = 1_000_000) -> DataFrame:
    """Integers between the smallest and largest value that no row has.

    Values are put in order within blocks of the range; only each block's ends meet in one task, and each gap is spread
    out on its own.
    """
    values = df.where(F.col(col).isNotNull()).select(F.col(col).cast("long").alias("v")).distinct().withColumn("b", F.floor(F.col("v") / block))
    inside = values.select("v", F.lead("v").over(Window.partitionBy("b").orderBy("v")).alias("next"))
    ends = values.groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    between = ends.select(F.col("hi").alias("v"), F.lead("lo").over(Window.orderBy("b")).alias("next"))
    return inside.unionByName(between).where("next > v + 1").select(F.explode(F.sequence(F.col("v") + 1, F.col("next") - 1)).alias(col))


def positional(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both sides met by their place within a key, as zip does; keys with different counts are left out."""
    def placed(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(key)
        return df.withColumn("place", F.row_number().over(w.orderBy(order))).withColumn("size", F.count(F.lit(1)).over(w))

    return placed(left).alias("l").join(placed(right).alias("r"), [key, "place", "size"])


def most_common(df: DataFrame, value: str, n: int) -> DataFrame:
    """(value, n) of the n most frequent values, ties to the smaller value; null is no value."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(n)


def in_any(df: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Rows of df whose key occurs in one of the others (each with a column of that name), once each; null keys occur nowhere."""
    keys = others[0].select(key)
    for other in others[1:]:
        keys = keys.unionByName(other.select(key))
    return df.join(keys.distinct(), key, "left_semi")
