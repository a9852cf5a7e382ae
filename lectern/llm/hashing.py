"""Vectorised Rabin-Karp hashing of byte strings, and hash sets that travel between chunks of documents in packed form.

A chunk is a range of document ids. A chunk sends, per bucket of the hash space, one blob with its sorted distinct hashes;
a bucket meets the blobs of all chunks, and answers each chunk with one blob. So a hash costs a few bytes on the way and
no row of its own, and a hash that very many documents hold is one entry per chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np

MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (shifts, multiplications), so that top bits may serve as a bucket."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The polynomial's base, its inverse modulo 2**64, and a random value for each byte.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 19)
            step = np.full(n, BASE, np.uint64)
            step[0] = 1
            self.up = np.multiply.accumulate(step)
            step[1:] = INVERSE
            self.down = np.multiply.accumulate(step)
        return self.up, self.down


POWERS = Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[k] the polynomial of data[:k]; a substring's hash follows from two entries."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=out[1:])
    return out


def substring_hashes(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], equal for equal strings wherever they stand."""
    _, down = POWERS.upto(len(p))
    return mixed((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Longer words enter a window's hash as a digest.
LONG_WORD = 48


class Words:
    """The words of some texts: maximal runs of bytes other than blanks, each followed by one blank in `data`.

    start and end are offsets in data, doc the text's number; first[d] : first[d + 1] are the words of text d.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        raw = np.frombuffer(b"".join([(t or b"") + b"\n" for t in texts]), dtype=np.uint8)
        stop = np.cumsum([len(t or b"") + 1 for t in texts])
        inside = ~SPACE[raw]
        before = np.zeros(len(raw), bool)
        before[1:] = inside[:-1]
        begin = np.flatnonzero(inside & ~before)
        close = np.flatnonzero(before & ~inside)
        self.data = raw[inside | before]
        if lower:
            self.data = LOWER[self.data]
        size = close - begin
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.data[self.end] = 32
        self.first = np.concatenate([[0], np.searchsorted(begin, stop)])
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def digested(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """data, start and end with the first bytes of a SHA-256 digest in place of each word over LONG_WORD bytes.

        Modulo a power of two some pairs of long strings of two letters have equal hashes under every base (Thue-Morse
        words from 1,024 letters on); windows of short words are far below that.
        """
        long = np.flatnonzero(self.end - self.start > LONG_WORD)
        if not len(long):
            return self.data, self.start, self.end
        data, keep = self.data.copy(), np.ones(len(self.data), bool)
        for a, b in zip(self.start[long].tolist(), self.end[long].tolist(), strict=True):
            data[a : a + 32] = np.frombuffer(hashlib.sha256(self.data[a:b].tobytes()).digest(), np.uint8)
            keep[a + 32 : b] = False
        at = np.concatenate([[0], np.cumsum(keep)])
        return data[keep], at[self.start], at[self.end]

    def windows(self, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of `size` words of one text, and the window's first word.

        With `short`, a text of fewer words, but not none, has one window: all its words.
        """
        n = len(self.start)
        first = np.arange(max(0, n - size + 1))
        first = first[self.doc[first] == self.doc[first + size - 1]] if len(first) else first
        last = first + size - 1
        if short:
            few = np.flatnonzero((self.count > 0) & (self.count < size))
            first = np.concatenate([first, self.first[few]])
            last = np.concatenate([last, self.first[few + 1] - 1])
            order = np.argsort(first, kind="stable")
            first, last = first[order], last[order]
        data, start, end = self.digested()
        return substring_hashes(prefix_sums(data), start[first], end[last]), first


# ------------------------------------------------------------------------------------------------------- packed hash sets


def pack(sorted_values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, their first bytes together, then their second: compressors like the zeros."""
    return np.diff(sorted_values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def by_bucket(values: np.ndarray, buckets: int, bits: int = 64) -> list[tuple[int, np.ndarray]]:
    """Ascending values of `bits` bits, cut into `buckets` ranges of equal width; empty ranges are left out."""
    width = -(-(1 << bits) // buckets)
    edges = np.searchsorted(values, np.array([min(k * width, MASK) for k in range(1, buckets)], dtype=np.uint64))
    cut = [0, *edges.tolist(), len(values)]
    return [(k, values[a:b]) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]


def covered(starts: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which of `length` places some run of `size` from one of `starts` covers."""
    steps = np.zeros(length + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + size, length), -1)
    return np.cumsum(steps[:-1]) > 0


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of a mask, ends exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
