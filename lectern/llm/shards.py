"""Sharding: a keyed Feistel permutation of global row numbers, with cycle walking, gives every row a shard and a slot.

Rows are numbered 0 to n - 1 in the order of id, checksum, size and hash of the text; the permutation maps number r to
position p, and p is slot p // shards of shard p % shards. So shard sizes differ by one row at most, slots have no gaps,
and both directions are computable from (n, seed) alone: `position` finds a row's place, `row_at` the row of a place.

Only (id, size, checksum, hash) of a text are shuffled, once, by range; ranges split any tie, so a hot id or text is no
hot task. The driver sees one count a range.

Defined cases: a null text has size 1 and checksum 0, as an empty one has; a row without id comes after all others;
rows of equal id and text are alike, and any of them may have any of their numbers; texts of equal content go where their
row numbers lead (the law `rows` keeps no groups together); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import NO_ID, carried, clean, stored

SHARDS, SEED, ROUNDS = 16, 20_240, 6
#: Odd multipliers of the round function; any will do, but a change of them changes the shuffle.
MIX = (0x1E3779B97F4A7C15, 0x16E8FEB86659FD93)
#: Bits of monotonically_increasing_id() that count rows inside a partition.
INDEX_BITS = 33


def half_bits(n: int) -> int:
    """Width of each half, such that both halves together count to n at least and to less than 4 * n (beyond n = 4)."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def round_keys(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:7], "big") for k in range(ROUNDS)]


def _scrambled(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    x = (half + np.uint64(key)) * np.uint64(MIX[0])
    return ((x ^ (x >> np.uint64(32))) * np.uint64(MIX[1])) >> np.uint64(64 - bits)


def _once(x: np.ndarray, bits: int, keys: list[int], back: bool) -> np.ndarray:
    left, right = x >> np.uint64(bits), x & np.uint64((1 << bits) - 1)
    for key in reversed(keys) if back else keys:
        left, right = (right ^ _scrambled(left, key, bits), left) if back else (right, left ^ _scrambled(right, key, bits))
    return left << np.uint64(bits) | right


def _walked(rows: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    """The permutation of 0 to n - 1 (or its inverse): the cycle through the larger domain is followed until it is back below n."""
    bits, keys = half_bits(n), round_keys(seed)
    out = np.asarray(rows).astype(np.uint64)
    if len(out) and int(out.max()) >= n:
        raise ValueError(f"a row number is not below {n}")
    out = _once(out, bits, keys, back)
    away = np.flatnonzero(out >= n)
    while len(away):
        out[away] = _once(out[away], bits, keys, back)
        away = away[out[away] >= n]
    return out.astype(np.int64)


def position(rows: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Places, 0 to n - 1, of row numbers."""
    return _walked(rows, n, seed, False)


def row_at(places: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Row numbers at places: the inverse of `position`."""
    return _walked(places, n, seed, True)


def _column(f, n: int, seed: int, numbers: Column) -> Column:
    @F.pandas_udf("long")
    def mapped(x: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(), n, seed))

    return mapped(numbers)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows, written to the shared folder, with the long column `row` from 0 in ascending order of `order`, and their count.

    Each range is sorted on its own; the offsets are the running sums of one count a range.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(ranges.withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at", INDEX_BITS)
    counts = sorted((r["part"], r["n"]) for r in kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in counts], dtype=np.int64)])
    offsets = rows.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(counts, starts)], "part long, start long")
    inside = F.col("at").bitwiseAND(F.lit((1 << INDEX_BITS) - 1))
    out = kept.join(F.broadcast(offsets), part == F.col("part")).withColumn("row", F.col("start") + inside)
    return out.drop("at", "part", "start"), int(starts[-1])


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, size, text_crc32, row, shard, slot of every row, and the columns to carry along."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = clean(docs, id_col, text_col, carry).select(
        "id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[f"carry{k}" for k in range(len(carry))],
        F.coalesce("id", F.lit(NO_ID)).alias("key"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("tie"),
    )
    rows, n = numbered(sized, ["key", "text_crc32", "size", "hash", "tie"])
    placed = rows.withColumn("place", _column(position, n, seed, F.col("row")))
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "row", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"), *carried(carry))


def expected_rows(spark: SparkSession, n: int, shard: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(slot, row) of one shard of n rows, computed without reading any of them: what a reader of that shard may expect, or where it goes on after a stop."""
    slots = spark.range(max(0, (n - shard + shards - 1) // shards)).withColumnRenamed("id", "slot")
    return slots.withColumn("row", _column(row_at, n, seed, F.col("slot") * shards + shard))


def write_shards(placed: DataFrame, path: str) -> None:
    """placed (with what was carried) as Parquet files in one folder a shard, ascending slots from file to file."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digests(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return placed.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
