"""Chunks of documents by id range, and the exchange of hash sets between them (see hashing)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import NO_ID, clean, figures, range_bounds, range_of
from lectern.llm.hashing import by_bucket, pack, unpack

#: UTF-8 bytes of text in a chunk, about; a longer document makes a larger chunk. Chunks and buckets grow with the input.
CHUNK_BYTES = 8_000_000
LEAST_CHUNKS = 12


@dataclass
class Chunked:
    """rows: (chunk, id, text), dealt out by chunk; a chunk's ids are all smaller than the next chunk's."""

    rows: DataFrame
    chunks: int
    bytes: int
    parts: int

    def dealt(self, answers: DataFrame) -> DataFrame:
        """Answers dealt out as the rows are, so that a cogroup by chunk moves the texts no second time."""
        return answers.repartition(self.parts, "chunk")


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> Chunked:
    plain = clean(docs, id_col, text_col)
    _, size = figures(plain)
    n = max(LEAST_CHUNKS, -(-size // chunk_bytes))
    bounds = range_bounds(plain, n)
    rows = plain.select(range_of(bounds, F.col("id")).alias("chunk"), F.coalesce("id", F.lit(NO_ID)).alias("id"), F.col("id").isNull().alias("no_id"), "text")
    parts = max(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return Chunked(rows.repartition(parts, "chunk"), n, size, parts)


def texts_of(rows: pa.Table) -> tuple[list[bytes | None], np.ndarray]:
    """Texts as bytes and ids of a chunk, in ascending order of ids."""
    rows = rows.take(pa.array(np.argsort(rows.column("id").to_numpy(), kind="stable")))
    return rows.column("text").cast(pa.binary()).to_pylist(), rows.column("id").to_numpy()


def slices(texts: list[bytes | None], most: int = 1_500_000) -> list[tuple[int, int]]:
    """Ranges of whole texts with about `most` bytes each."""
    out, at, total = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if total and total + n > most:
            out.append((at, i))
            at, total = i, 0
        total += n
    if len(texts) > at:
        out.append((at, len(texts)))
    return out


def gathered(docs: Chunked, hashes: Callable[[list[bytes | None]], np.ndarray], bits: int = 64) -> DataFrame:
    """(chunk, bucket, blob): each chunk's distinct hashes (their `bits` top bits) by bucket."""
    buckets = docs.chunks

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        texts, _ = texts_of(rows)
        found = [np.unique(hashes(texts[a:b]) >> np.uint64(64 - bits)) for a, b in slices(texts)]
        values = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        cut = by_bucket(values, buckets, bits)
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(cut), pa.int32()), "bucket": pa.array([k for k, _ in cut], pa.int32()), "blob": pa.array([pack(v) for _, v in cut], pa.binary())})

    return docs.rows.groupBy("chunk").applyInArrow(run, "chunk int, bucket int, blob binary")


def answered(sent: DataFrame, smaller: bool) -> DataFrame:
    """(chunk, blob, counts) of what other chunks hold too.

    With `smaller`: the hashes that a smaller chunk holds. Else: those that any other chunk holds; counts has the number
    of chunks of each as an unsigned 16-bit integer (65535 for that many or more), in the order of the blob.
    """

    def run(rows: pa.Table) -> pa.Table:
        chunk = rows.column("chunk").to_numpy()
        blobs = [unpack(b) for b in rows.column("blob").to_pylist()]
        who = np.repeat(np.argsort(np.argsort(chunk)), [len(b) for b in blobs]).astype(np.int32)
        names = np.sort(chunk)
        values = np.concatenate(blobs)
        order = np.lexsort((who, values)) if smaller else np.argsort(values, kind="stable")
        values, who = values[order], who[order]
        first = np.concatenate([[True], values[1:] != values[:-1]])
        if smaller:
            keep, times = ~first, None
        else:
            group = np.cumsum(first) - 1
            times = np.bincount(group)[group]
            keep = times > 1
            times = np.minimum(times[keep], 65535)
        values, who = values[keep], who[keep]
        order = np.argsort(who, kind="stable")
        values, who = values[order], who[order]
        at = np.searchsorted(who, np.arange(len(names) + 1))
        full = [k for k in range(len(names)) if at[k + 1] > at[k]]
        counts = [None if smaller else times[order][at[k] : at[k + 1]].astype("<u2").tobytes() for k in full]
        return pa.table({"chunk": pa.array([int(names[k]) for k in full], pa.int32()), "blob": pa.array([pack(values[at[k] : at[k + 1]]) for k in full], pa.binary()), "counts": pa.array(counts, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "chunk int, blob binary, counts binary")


def together(blobs: list[bytes]) -> np.ndarray:
    """The ascending values of a chunk's answers."""
    return np.sort(np.concatenate([unpack(b) for b in blobs])) if blobs else np.zeros(0, np.uint64)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the ascending array `known`."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values
