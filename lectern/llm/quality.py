"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters read every second position of the text's bytes. Their responses are rectified and max-pooled over
chunks of two blocks that overlap by one block and together cover the whole document; a document's mean, largest and
smallest chunk response of each filter feed one logistic unit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import batches, clean, labelled_sample

WIDTH, STRIDE, FILTERS, BLOCK = 6, 2, 16, 256
#: Bounds of what training reads: texts of each class, and bytes of each text, in pieces spread over all of it (scoring has no such bound).
SAMPLE_PER_CLASS, SAMPLE_BYTES = 1_000, 16_384


def spread(text: bytes, most: int = SAMPLE_BYTES, piece: int = 2 * BLOCK) -> bytes:
    """A text, or pieces of it at equal distances from its first to its last byte, `most` bytes in all."""
    if len(text) <= most:
        return text
    n = most // piece
    starts = [k * (len(text) - piece) // (n - 1) for k in range(n)]
    return b"".join(text[a : a + piece] for a in starts)


@dataclass
class Network:
    """taps: (WIDTH, 256, FILTERS) response of each filter to a byte at an offset; head: weights on mean, max and min."""

    taps: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    offset: float

    def blocks(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Padded bytes, each text's first block, each text's number of blocks (one at least)."""
        n = np.array([-(-(len(t) + WIDTH) // BLOCK) for t in texts], dtype=np.int64)
        flat = b"".join(t.ljust(k * BLOCK, b"\0") for t, k in zip(texts, n.tolist(), strict=True)) + bytes(WIDTH)
        return np.frombuffer(flat, dtype=np.uint8), np.cumsum(n) - n, n

    def respond(self, flat: np.ndarray) -> np.ndarray:
        """Filter responses, (blocks, positions in a block, filters)."""
        m = (len(flat) - WIDTH) // STRIDE
        out = np.take(self.taps[0], flat[0 : m * STRIDE : STRIDE], axis=0)
        for k in range(1, WIDTH):
            out += np.take(self.taps[k], flat[k : k + m * STRIDE : STRIDE], axis=0)
        return out.reshape(-1, BLOCK // STRIDE, FILTERS)

    def tops(self, flat: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Responses without those that reach from a text's last block into the next text, so that no score depends on a neighbour."""
        h = self.respond(flat)
        h[last, -((WIDTH - 1) // STRIDE) :] = -1e9
        return h

    def pooled(self, top: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Mean, max and min over each text's chunks of the chunk maxima; a chunk is a block and the next of the same text."""
        last = first + n - 1
        follow = np.arange(len(top)) + 1
        follow[last] = last
        chunk = np.maximum(np.maximum(top, top[follow]) + self.bias, 0)
        live = np.ones(len(top), bool)
        live[last[n > 1]] = False  # the last block is already in the chunk before it
        rows, count = np.flatnonzero(live), np.maximum(n - 1, 1)
        at = np.cumsum(count) - count
        c = chunk[rows]
        return np.concatenate([np.add.reduceat(c, at) / count[:, None], np.maximum.reduceat(c, at), np.minimum.reduceat(c, at)], axis=1), rows, at, count, c, follow

    def score(self, texts: list[bytes]) -> np.ndarray:
        flat, first, n = self.blocks(texts)
        total = int(n.sum())
        last = np.zeros(total, bool)
        last[first + n - 1] = True
        top = np.concatenate([self.tops(flat[s * BLOCK : min(s + 1024, total) * BLOCK + WIDTH], last[s : s + 1024]).max(axis=1) for s in range(0, total, 1024)])
        return 1 / (1 + np.exp(-np.clip(self.pooled(top, first, n)[0] @ self.head + self.offset, -30, 30)))


def train(rows: list[tuple[str, int]], counts: dict[int, int], epochs: int = 10, seed: int = 7) -> Network:
    """Adam on the logistic loss, gradients passing the max-pools to the positions that won; then the true class odds."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(3 * FILTERS, np.float32), 0.0)
    texts, y = [spread(t.encode()) for t, _ in rows], np.array([v for _, v in rows], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        n0, n1 = counts.get(0, 0), counts.get(1, 0)
        net.offset = float(np.log((n1 + 1) / (n0 + 1)))
        return net
    net.head += rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32)
    params = [net.taps, net.bias, net.head]
    m1, m2, step, off_m = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, [0.0, 0.0]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(texts))
        for s in range(0, len(order), 64):
            pick = order[s : s + 64]
            flat, first, n = net.blocks([texts[i] for i in pick])
            h = net.tops(flat, first + n - 1)
            won, top = h.argmax(axis=1), h.max(axis=1)
            x, rows_, at, count, c, follow = net.pooled(top, first, n)
            p = 1 / (1 + np.exp(-np.clip(x @ net.head + net.offset, -30, 30)))
            err = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            g_head, g_off = x.T @ err + 1e-4 * net.head, float(err.sum())
            gx = err[:, None] * net.head
            g_mean, g_max, g_min = np.split(gx, 3, axis=1)
            doc = np.repeat(np.arange(len(pick)), count)
            gc = g_mean[doc] / count[doc][:, None]
            gc += g_max[doc] * (c == np.maximum.reduceat(c, at)[doc]) + g_min[doc] * (c == np.minimum.reduceat(c, at)[doc])
            gc *= c > 0
            second = top[follow[rows_]] > top[rows_]
            block = np.where(second, follow[rows_][:, None], rows_[:, None])
            f = np.broadcast_to(np.arange(FILTERS), block.shape)
            pos = block * BLOCK + won[block, f] * STRIDE
            g_taps = np.zeros_like(net.taps)
            for k in range(WIDTH):
                np.add.at(g_taps[k], (flat[pos + k], f), gc)
            step += 1
            for q, (par, g) in enumerate(zip(params, (g_taps, gc.sum(axis=0), g_head), strict=True)):
                m1[q] = 0.9 * m1[q] + 0.1 * g
                m2[q] = 0.99 * m2[q] + 0.01 * g * g
                par -= (rate * (m1[q] / (1 - 0.9**step)) / (np.sqrt(m2[q] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            off_m = [0.9 * off_m[0] + 0.1 * g_off, 0.99 * off_m[1] + 0.01 * g_off**2]
            net.offset -= rate * (off_m[0] / (1 - 0.9**step)) / (np.sqrt(off_m[1] / (1 - 0.99**step)) + 1e-6)
    net.offset += float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))  # training weighed both classes alike
    return net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row; a null text scores as an empty one. No shuffle; the network is of fixed size."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for b in batches(part):
                texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(net.score(texts).astype(np.float64))], names=["doc_id", "score"])

    return clean(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def annotated(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """All columns of docs as they are, and score; needs no join. A column `score` of docs is replaced."""
    rest = docs.drop("score")
    at = rest.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for b in batches(part, column=part.schema.names[at]):
                texts = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(net.score(texts).astype(np.float64))], names=[*b.schema.names, "score"])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Contract rows: doc_id, held_out, score, predicted. Learns from the labelled texts of `labelled_docs` that aren't held out."""
    net = train(*labelled_sample(labelled_docs, labels, "quality", 5, 0, SAMPLE_PER_CLASS))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(docs, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
