"""Helpers that several of the operators share: size figures, range chunks, shared-folder tables, samples."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A row without an id counts as one whose id is larger than all others.
NO_ID = (1 << 63) - 1
#: Rows of fixed small width that may be broadcast; above it every join shuffles.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset, a local session gets one and a cluster an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        kept = spark.sparkContext.getCheckpointDir()
        if kept:
            return kept.rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: no folder is known that driver and executors share")
        spark.sparkContext.setCheckpointDir(found := "/tmp/checkpoints/lectern")
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Only (id long, text string) and, as carry0, carry1, …, the columns to carry along, whatever else the table holds."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"carry{k}") for k, c in enumerate(carry)])


def carried(carry: tuple[str, ...]) -> list[Column]:
    """The carried columns under their own names."""
    return [F.col(f"carry{k}").alias(c) for k, c in enumerate(carry)]


def figures(docs: DataFrame) -> tuple[int, int]:
    """Rows and UTF-8 bytes of text, over all rows of an (id, text) table."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def range_bounds(docs: DataFrame, parts: int) -> list[int]:
    """Ascending ids that cut an (id, …) table into about `parts` ranges of like row counts (fewer on ties)."""
    if parts < 2:
        return []
    cuts = docs.where("id is not null").stat.approxQuantile("id", [i / parts for i in range(1, parts)], min(0.01, 0.2 / parts))
    return sorted({int(x) for x in cuts})


def range_of(bounds: list[int], col: Column) -> Column:
    """Index of the range that an id falls into: binary search over an array literal, in log2(len) steps."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in range(math.ceil(math.log2(len(bounds) + 1)) - 1, -1, -1)])
    cuts = F.expr(f"array({','.join(f'{b}L' for b in bounds)})")
    top = F.lit(len(bounds))
    found = F.aggregate(steps, F.lit(0), lambda at, k: F.when((at + k <= top) & (F.get(cuts, at + k - 1) <= col), at + k).otherwise(at))
    return F.when(col.isNull(), top).otherwise(found)


def batches(batch: pa.RecordBatch, most: int = 2_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `most` bytes of text each; a longer text is a slice of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, keep_out: int, most: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most `most` labelled texts of each class, never of a held-out row, and the counts of all rows that may be learnt from.

    The choice is by hash of the id, so it is the same in every run. A row whose label is neither 0 nor 1 is not used.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
        .where(F.crc32(F.col("id").cast("string").cast("binary")) % mod != keep_out)
        .groupBy("id").agg(F.min("y").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in sorted(counts):
        part = usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return [], counts
    rows = clean(docs).where("text is not null").join(F.broadcast(picked), "id").select("id", "text", "y").collect()
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: (r["id"], r["text"]))], counts
