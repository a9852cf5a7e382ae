"""BPE encoding and decoding: batched numpy merge rounds over the words of many texts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batches, clean

#: Fixed values of the byte-level pre-tokenizer: its published split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker remembers; beyond it the memory is emptied, which costs time only.
REMEMBERED = 250_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + n)
            n += 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merges, ids and token bytes of a byte-level BPE file, as flat arrays."""

    def __init__(self, text: str):
        file = json.loads(text)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        if file.get("normalizer") or file["pre_tokenizer"]["type"] != "ByteLevel" or file["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normalizer or prefix space is supported")
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.byte_id = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        if len(set(made.tolist())) != len(made):
            raise ValueError("a token that several merges make would need one merge at a time")
        self.order = np.argsort(keys)
        self.keys, self.made = keys[self.order], made
        data = [b""] * self.size
        for token, i in vocab.items():
            data[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            data[i] = token.encode()
        self.token_len = np.array([len(d) for d in data], dtype=np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(data), dtype=np.uint8)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and how many each has.

        In each round every word joins all occurrences of its own lowest-ranked pair, left to right. As each token has one
        merge that makes it, a new pair always ranks below the pair just joined, so this equals joining one at a time.
        """
        n = len(words)
        symbols = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(n), [len(w) for w in words])
        done_symbols, done_words, never = [], [], len(self.keys)
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), never - 1)
            rank = np.full(len(symbols), never, dtype=np.int64)
            rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.order[at], never)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            over = best == never
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                symbols, word, rank, best = symbols[~over], word[~over], rank[~over], best[~over]
            hit = np.flatnonzero(rank == best)
            if not len(hit):
                continue
            new_run = np.concatenate([[True], np.diff(hit) != 1])
            run_at = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run_at) % 2 == 0]  # of overlapping pairs aa|a the left one
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        word, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=n)


def gather(flat: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[at[i] : at[i] + lens[i]] for all i, end to end."""
    total = int(lens.sum())
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(at - (np.cumsum(lens) - lens), lens)
    return flat[out]


class Encoder:
    """Encodes and decodes batches of texts, remembering the words that it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.split = vocabulary, regex.compile(SPLIT)
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None
        self.forget()

    def forget(self) -> None:
        self.known = {}
        self.ids, self.at, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if w not in self.v.special]
        flat, lens = self.v.merge([w.encode() for w in plain])
        named = [w for w in words if w in self.v.special]
        flat = np.concatenate([flat, np.array([self.v.special[w] for w in named], dtype=np.int64)])
        lens = np.concatenate([lens, np.ones(len(named), np.int64)])
        start, base = len(self.ids), len(self.known)
        self.ids = np.concatenate([self.ids, flat.astype(np.uint32)])
        self.at = np.concatenate([self.at, start + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.known.update(zip([*plain, *named], range(base, base + len(words)), strict=True))

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.v.special):
            return self.split.findall(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.split.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.split.findall(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array and the number that each text has."""
        if len(self.known) > REMEMBERED:
            self.forget()
        words, ends = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            words += self.pieces(t)
            ends[i] = len(words)
        found = list(map(self.known.get, words))
        if None in found:
            self.learn(list(dict.fromkeys(w for w, k in zip(words, found, strict=True) if k is None)))
            found = list(map(self.known.get, words))
        which = np.array(found, dtype=np.int64)
        lens = self.lens[which]
        ids = gather(self.ids, self.at[which], lens)
        tokens = np.concatenate([[0], np.cumsum(lens)])[ends]
        return ids, np.diff(tokens, prepend=0)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.v.token_bytes, self.v.token_at[ids], self.v.token_len[ids])


def encode_decode(docs: DataFrame, vocabulary_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text and the text that they decode to.

    Returns doc_id, ids (binary: little-endian unsigned 32-bit integers), n_tokens, decoded. A null or empty text has no
    tokens. A special token's string in a text is that token. `vocabulary_json` is the content of a tokenizer file; it is
    of fixed size and goes to the workers with the function. Rows need no shuffle; ties and repeated rows change nothing.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(vocabulary_json))
        for part in parts:
            for b in batches(part):
                texts = [t or "" for t in b.column("text").to_pylist()]
                ids, counts = encoder.encode(texts)
                ends = np.cumsum(counts)
                data = np.ascontiguousarray(ids, dtype="<u4").tobytes()
                plain = encoder.decode(ids).tobytes()
                text_ends = np.concatenate([[0], np.cumsum(encoder.v.token_len[ids])])[ends]
                cut = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                back = [plain[s:e].decode("utf-8", "replace") for s, e in zip([0, *text_ends[:-1].tolist()], text_ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cut, pa.binary()), pa.array(counts, pa.int64()), pa.array(back, pa.string())], names=["doc_id", "ids", "n_tokens", "decoded"])

    return clean(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """The contract's columns, from what encode_decode returns."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
