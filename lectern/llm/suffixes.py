"""Suffix-array dedup of byte strings.

A 50-byte string's anchor is the substring of GRAM bytes in it with the smallest hash, the leftmost of equals: equal
strings have equal anchors. Chunks exchange packed sets of anchors (see hashing); strings whose anchor stands in one
document only are in no other. Neighbouring strings with one anchor form a segment. Segments of one anchor meet in a
bucket, are joined to short texts and ordered by suffix arrays (linear grouping construction, see gsaca): strings that are
equal are neighbours there. The smallest document of each goes back to the chunks. Strings in order are compared byte by
byte; segments that repeat, and strings met in several texts of one anchor, are first told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.chunks import among, answered, chunked, gathered, slices, texts_of, together
from lectern.llm.common import NO_ID
from lectern.llm.gsaca import suffix_arrays
from lectern.llm.hashing import by_bucket, covered, mixed, prefix_sums, runs, substring_hashes

SIZE, GRAM = 50, 24
#: Segments of an anchor are put into texts of about so many bytes; equal strings of several texts meet by their bytes.
TEXT_BYTES, LOT_BYTES = 600, 300_000
ANCHOR_BITS = 48
#: Bytes of text whose strings are hashed together, and buckets for each chunk: both bound the memory of a task.
SLICE, BUCKETS = 500_000, 2


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by prefix and suffix minima of blocks of w."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


class Segments:
    """Segments of some texts, in order: text number, first byte in `data`, strings in it, and the anchor's hash."""

    def __init__(self, texts: list[bytes | None], size: int = SIZE, gram: int = GRAM):
        self.data = np.frombuffer(b"".join([t or b"" for t in texts]), dtype=np.uint8)
        lens = np.array([len(t or b"") for t in texts], dtype=np.int64)
        self.begin = np.cumsum(lens) - lens
        n, w = len(self.data), size - gram + 1
        self.sums = prefix_sums(self.data)
        if n < size:
            self.doc = self.start = self.count = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        at = np.arange(n - gram + 1)
        h = substring_hashes(self.sums, at, at + gram)
        bits = np.uint64(max(1, int(n).bit_length()))
        least = sliding_least((h >> bits << bits) | at.astype(np.uint64), w)
        place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        valid = np.zeros(n + 1, np.int32)
        long = lens >= size
        np.add.at(valid, self.begin[long], 1)
        np.add.at(valid, (self.begin + lens - size + 1)[long], -1)
        inside = np.cumsum(valid)[: len(place)] > 0
        first = inside.copy()
        first[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
        # Texts of exactly the string's size may touch: a text's first string starts a segment.
        first[self.begin[long]] = True
        self.start = np.flatnonzero(first)
        stop = np.append(self.start[1:], len(place))
        ins = np.concatenate([[0], np.cumsum(inside)])
        self.count = ins[stop] - ins[self.start]
        # Smallest hashes crowd at the low end; scrambled once more, anchors fill all buckets alike.
        self.anchor = mixed(h[place[self.start]])
        self.doc = np.searchsorted(self.begin, self.start, "right") - 1

    def names(self, pick: np.ndarray, size: int = SIZE) -> np.ndarray:
        """Hashes of the chosen segments' bytes."""
        s = self.start[pick]
        return substring_hashes(self.sums, s, s + self.count[pick] + size - 1)


def anchors(texts: list[bytes | None]) -> np.ndarray:
    return Segments(texts).anchor


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start : start + size] of all runs, end to end."""
    return data[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)]


def rank_of(ids: np.ndarray) -> np.ndarray:
    return np.unique(ids, return_inverse=True)[1]


def classes(anchor: np.ndarray, lens: np.ndarray, data: np.ndarray, owner: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """For each string of each segment, in order, the smallest owner among all segments with the same anchor; and the numbers of strings.

    Equal segments are one from here on, and an anchor with one segment has nothing to put in order: all its strings have
    its owner. Anchors, lens and owners are by segment; data holds their bytes end to end.
    """
    offset = np.cumsum(lens) - lens
    keys: dict[tuple[int, bytes], int] = {}
    raw = data.tobytes()
    same = np.array([keys.setdefault((a, raw[o : o + n]), len(keys)) for a, o, n in zip(anchor.tolist(), offset.tolist(), lens.tolist(), strict=True)], dtype=np.int64)
    least = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(least, same, owner)
    parts = list(keys)
    times: dict[int, int] = {}
    for a, _ in parts:
        times[a] = times.get(a, 0) + 1
    order = sorted((k for k in range(len(parts)) if times[parts[k][0]] > 1), key=lambda k: parts[k][0])
    # Texts: segments of one anchor up to about TEXT_BYTES, each followed by a 1, the last by a 0 (bytes are 2 to 257).
    texts, held, total = [], [], 0
    for k in order:
        a, b = parts[k]
        if texts and texts[-1] == a and total + len(b) < TEXT_BYTES:
            held[-1].append(k)
            total += len(b) + 1
        else:
            texts.append(a)
            held.append([k])
            total = len(b) + 1
    spread = np.bincount(np.unique(texts, return_inverse=True)[1]) if texts else np.zeros(0, np.int64)
    several = np.repeat(spread > 1, spread)  # texts stand in order of anchors
    strings = np.array([len(b) - size + 1 for _, b in parts], dtype=np.int64)
    at_part = np.cumsum(strings) - strings
    found = np.repeat(least, strings)
    widths = [sum(len(parts[k][1]) + 1 for k in ks) for ks in held]
    todo = sorted(range(len(held)), key=widths.__getitem__)
    at, n_classes = 0, 0
    spots, class_of, low, loose, reps = [], [], [], [], []
    while at < len(todo):
        lot, most = [], 0
        while at < len(todo) and (not lot or (len(lot) + 1) * widths[todo[at]] <= LOT_BYTES):
            lot.append(todo[at])
            most = widths[todo[at]]
            at += 1
        text = np.zeros((len(lot), most), np.int16)
        string = np.full((len(lot), most), -1, np.int64)  # number of the string that starts here, among all of the bucket
        for r, x in enumerate(lot):
            o = 0
            for k in held[x]:
                b = parts[k][1]
                m = len(b)
                text[r, o : o + m] = np.frombuffer(b, np.uint8)
                text[r, o : o + m] += 2
                text[r, o + m] = 1
                string[r, o : o + strings[k]] = np.arange(at_part[k], at_part[k] + strings[k])
                o += m + 1
            text[r, o - 1] = 0
        sa = suffix_arrays(text, np.array([widths[x] for x in lot])).ravel()
        spot = np.repeat(np.arange(len(lot)) * most, most) + np.maximum(sa, 0)
        spot = spot[(sa >= 0) & (string.ravel()[spot] >= 0)]
        flat = text.ravel()
        new = np.ones(len(spot), bool)
        if len(spot) > 1:
            equal = spot[1:] // most == spot[:-1] // most
            for step in range(0, size, 10):
                who = np.flatnonzero(equal)
                window = np.arange(step, min(size, step + 10))
                equal[who] = (flat[spot[1:][who][:, None] + window] == flat[spot[:-1][who][:, None] + window]).all(axis=1)
            new[1:] = ~equal
        first = np.flatnonzero(new)
        own = string.ravel()[spot]
        spots.append(own)
        class_of.append(n_classes + np.cumsum(new) - 1)
        low.append(np.minimum.reduceat(found[own], first))
        rest = np.flatnonzero(several[np.array(lot)[spot[first] // most]])
        loose.append(n_classes + rest)
        reps.append((flat[spot[first[rest]][:, None] + np.arange(size)] - 2).astype(np.uint8))
        n_classes += len(first)
    if spots:
        low = np.concatenate(low)
        # An anchor's texts are merged by the first string of each class.
        loose, reps = np.concatenate(loose), np.ascontiguousarray(np.concatenate(reps))
        if len(loose):
            group = np.unique(reps.view(f"S{size}").ravel(), return_inverse=True)[1]
            best = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(best, group, low[loose])
            low[loose] = best[group]
        found[np.concatenate(spots)] = low[np.concatenate(class_of)]
    counts = strings[same]
    step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return found[np.repeat(at_part[same], counts) + step], counts


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each byte covered by a 50-byte string that also starts in a document with a smaller id.

    Returns one row per input row: doc_id, n_bytes, n_removed, removed (maximal byte runs, ends exclusive), kept (binary:
    the remaining bytes). A null text is empty; texts shorter than 50 bytes lose nothing. A row without an id counts as one
    with the largest id; rows of equal id do not remove from each other. An empty table gives no rows.
    """
    parts = chunked(docs, id_col, text_col)
    # All in one plan, so that the exchange of texts is made once and used three times.
    known = answered(gathered(parts, anchors, ANCHOR_BITS), smaller=False)
    buckets = BUCKETS * parts.chunks

    def send(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        texts, ids = texts_of(rows)
        chunk = int(key[0].as_py() if hasattr(key[0], "as_py") else key[0])
        rank = rank_of(ids)
        elsewhere = together(found.column("blob").to_pylist())
        cut = slices(texts, SLICE)
        hashes = [Segments(texts[a:b]) for a, b in cut] if len(cut) == 1 else None
        # Anchors of two documents of this chunk: by the first and last document of each.
        every, owner = [], []
        for q, (a, b) in enumerate(cut):
            s = hashes[q] if hashes else Segments(texts[a:b])
            every.append(s.anchor)
            owner.append(rank[a + s.doc])
        h = np.concatenate(every) if every else np.zeros(0, np.uint64)
        d = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        twice = np.zeros(0, np.uint64)
        if len(h):
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            twice = h[at][np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at)]
        del h, d, every, owner
        names, anchor, lens, owner, data = [], [], [], [], []
        for q, (a, b) in enumerate(cut):
            s = hashes[q] if hashes else Segments(texts[a:b])
            pick = np.flatnonzero(among(s.anchor >> np.uint64(64 - ANCHOR_BITS), elsewhere) | among(s.anchor, twice))
            name, first = np.unique(s.names(pick), return_index=True)
            first = pick[first]
            n = s.count[first] + SIZE - 1
            names.append(name)
            anchor.append(s.anchor[first])
            lens.append(n)
            owner.append(rank[a + s.doc[first]])
            data.append(gather(s.data, s.start[first], n))
        names, anchor, lens, owner, data = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (names, anchor, lens, owner, data))
        # The first of equal names has the smallest document, as slices ascend.
        _, first = np.unique(names, return_index=True)
        first = first[np.argsort(anchor[first], kind="stable")]
        begin = np.cumsum(lens) - lens
        at, out = 0, {c: [] for c in ("bucket", "chunk", "names", "anchors", "lens", "owners", "data")}
        for k, values in by_bucket(anchor[first], buckets):
            x = first[at : at + len(values)]
            at += len(values)
            row = (k, chunk, names[x].tobytes(), anchor[x].tobytes(), lens[x].astype("<i2").tobytes(), owner[x].astype("<i4").tobytes(), pa.compress(gather(data, begin[x], lens[x]).tobytes(), codec="zstd", asbytes=True))
            for c, v in zip(out, row, strict=True):
                out[c].append(v)
        return pa.table({c: pa.array(v, pa.int32() if c in ("bucket", "chunk") else pa.binary()) for c, v in out.items()})

    def meet(rows: pa.Table) -> pa.Table:
        got = {c: rows.column(c).to_pylist() for c in rows.column_names}
        anchor = np.concatenate([np.frombuffer(x, "<u8") for x in got["anchors"]])
        lens = np.concatenate([np.frombuffer(x, "<i2") for x in got["lens"]]).astype(np.int64)
        owner = np.concatenate([(c << 32) + np.frombuffer(x, "<i4").astype(np.int64) for c, x in zip(got["chunk"], got["owners"], strict=True)])
        sizes = [int(np.frombuffer(x, "<i2").sum(dtype=np.int64)) for x in got["lens"]]
        data = b"".join(pa.decompress(x, n, codec="zstd", asbytes=True) for x, n in zip(got["data"], sizes, strict=True))
        values, counts = classes(anchor, lens, np.frombuffer(data, np.uint8), owner)
        # One bit a string: whether a document before the segment's first one in its chunk holds it.
        before = values < np.repeat(owner, counts)
        edge, ends, out = 0, np.concatenate([[0], np.cumsum(counts)]), []
        for names in got["names"]:
            n = len(names) // 8
            out.append((counts[edge : edge + n].astype("<i2").tobytes(), np.packbits(before[ends[edge] : ends[edge + n]]).tobytes()))
            edge += n
        cols = list(zip(*out, strict=True))
        return pa.table({"chunk": pa.array(got["chunk"], pa.int32()), **{c: pa.array(v, pa.binary()) for c, v in zip(("names", "owners", "counts", "before"), (got["names"], got["owners"], *cols), strict=True)}})

    def remove(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        texts, ids = texts_of(rows)
        no_id = rows.column("no_id").to_numpy(zero_copy_only=False)
        rank = rank_of(ids)
        none = found.num_rows == 0
        names = np.zeros(0, np.uint64) if none else np.concatenate([np.frombuffer(x, "<u8") for x in found.column("names").to_pylist()])
        owner = np.zeros(0, np.int32) if none else np.concatenate([np.frombuffer(x, "<i4") for x in found.column("owners").to_pylist()])
        by_row = [np.frombuffer(x, "<i2").astype(np.int64) for x in found.column("counts").to_pylist()]
        before = [np.unpackbits(np.frombuffer(x, np.uint8), count=int(c.sum())) for x, c in zip(found.column("before").to_pylist(), by_row, strict=True)]
        before = np.concatenate(before).astype(bool) if before else np.zeros(0, bool)
        counts = np.concatenate(by_row) if by_row else np.zeros(0, np.int64)
        offset = np.cumsum(counts) - counts
        order = np.argsort(names, kind="stable")
        names, offset, owner = names[order], offset[order], owner[order]
        n_bytes, n_gone, spans, kept = [], [], [], []
        for a, b in slices(texts, SLICE):
            s = Segments(texts[a:b])
            gone = np.zeros(len(s.data), bool)
            if len(names) and len(s.start):
                own = s.names(np.arange(len(s.start)))
                at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                hit = np.flatnonzero(names[at] == own)
                c = s.count[hit]
                step = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                # A later document of the chunk loses all strings of a segment, its first one those that an earlier chunk's document holds.
                smaller = before[np.repeat(offset[at[hit]], c) + step] | np.repeat(rank[a + s.doc[hit]] > owner[at[hit]], c)
                gone = covered((np.repeat(s.start[hit], c) + step)[smaller], SIZE, len(s.data))
            stop = np.append(s.begin[1:], len(s.data))
            for x, y in zip(s.begin.tolist(), stop.tolist(), strict=True):
                g = gone[x:y]
                n_bytes.append(y - x)
                n_gone.append(int(g.sum()))
                spans.append(runs(g) if n_gone[-1] else [])
                kept.append(s.data[x:y][~g].tobytes() if n_gone[-1] else s.data[x:y].tobytes())
        flat = [x for q in spans for x in q]
        pair = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64())], names=["start", "end"])
        ends = np.concatenate([[0], np.cumsum([len(q) for q in spans])])
        return pa.table({
            "doc_id": pa.array(ids, mask=(ids == NO_ID) if no_id.any() else None), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()),
            "removed": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pair), "kept": pa.array(kept, pa.binary()),
        })

    sent = parts.rows.groupBy("chunk").cogroup(parts.dealt(known).groupBy("chunk")).applyInArrow(send, "bucket int, chunk int, names binary, anchors binary, lens binary, owners binary, data binary")
    answers = sent.groupBy("bucket").applyInArrow(meet, "chunk int, names binary, owners binary, counts binary, before binary")
    return parts.rows.groupBy("chunk").cogroup(parts.dealt(answers).groupBy("chunk")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns, from what dedup returns."""
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
