"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

A window that a document with a smaller id also holds is marked; overlapping marks merge into maximal removal intervals.
Hashes have 64 bits, so over w windows about w * w / 2**65 pairs of different ones are taken for equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.chunks import Chunked, among, answered, chunked, gathered, slices, texts_of, together
from lectern.llm.common import NO_ID
from lectern.llm.hashing import Words, covered, runs

WINDOW = 13


def repeats_within(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries' hash an earlier document number of the same array holds; doc ascends."""
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], doc[order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    least = d[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))] if len(h) else d
    out = np.zeros(len(h), bool)
    out[order] = least < d
    return out


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each word covered by a window whose word sequence also starts in a document with a smaller id.

    Returns one row per input row: doc_id, n_words, n_removed, removed (array of word intervals, ends exclusive), kept
    (the words that stay, joined by one space). A null or empty text has no words. A row without an id counts as one with
    the largest id; rows of equal id do not remove from each other. An empty table gives no rows.
    """
    parts: Chunked = chunked(docs, id_col, text_col)
    known = answered(gathered(parts, lambda texts: Words(texts).windows(window)[0]), smaller=True)

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        texts, ids = texts_of(rows)
        no_id = rows.column("no_id").to_numpy(zero_copy_only=False)
        elsewhere = together(found.column("blob").to_pylist())
        rank = np.unique(ids, return_inverse=True)[1]
        pieces, firsts, offset = [], [], 0
        sizes = []
        for a, b in slices(texts):
            w = Words(texts[a:b])
            h, first = w.windows(window)
            pieces.append((h, rank[a + w.doc[first]]))
            firsts.append(first + offset)
            offset += len(w.start)
            sizes.append(w.count)
        h = np.concatenate([p[0] for p in pieces]) if pieces else np.zeros(0, np.uint64)
        who = np.concatenate([p[1] for p in pieces]) if pieces else np.zeros(0, np.int64)
        first = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
        gone = covered(first[repeats_within(h, who) | among(h, elsewhere)], window, offset)
        del h, who, first, pieces
        at, n_words, n_gone, spans, kept = 0, [], [], [], []
        for (a, b), count in zip(slices(texts), sizes, strict=True):
            w = Words(texts[a:b])
            g = gone[at : at + len(w.start)]
            at += len(w.start)
            stays = np.repeat(~g, w.end - w.start + 1)
            data = w.data[stays].tobytes()
            size = np.concatenate([[0], np.cumsum(np.where(g, 0, w.end - w.start + 1))])
            ends = size[w.first]
            for d in range(b - a):
                kept.append(data[ends[d] : max(ends[d], ends[d + 1] - 1)])
                own = g[w.first[d] : w.first[d + 1]]
                spans.append(runs(own) if own.any() else [])
                n_gone.append(int(own.sum()))
            n_words += count.tolist()
        flat = [x for s in spans for x in s]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)
        pair = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64())], names=["start", "end"])
        return pa.table({
            "doc_id": pa.array(ids, mask=(ids == NO_ID) if no_id.any() else None), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()),
            "removed": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pair), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    return parts.rows.groupBy("chunk").cogroup(parts.dealt(known).groupBy("chunk")).applyInArrow(run, "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns, from what dedup returns."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
