"""Personal data: four base patterns, and a semi-Markov conditional random field that adds spans to theirs.

The field scores whole candidate segments of up to MOST_TOKENS tokens. A segment's features look at the entire span (its
shape, digits, separators, a cue word before it); bounded-entity dynamic programming chooses boundaries and kinds jointly,
as the best path over segments. Its weights are trained here, by gradient ascent on the conditional likelihood, on lines
made by a rule. Only stretches of text that hold a digit, an at sign or a bracketed "at" or "dot" can hold an entity, so only they are decoded.
"""

from __future__ import annotations

import functools
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import batches, clean

KINDS = ("email", "ip", "card", "phone")
#: The base patterns of the contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Parts of EMAIL and IP that are looked for in one pass.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9.]+")
INTEREST = re.compile(r"[0-9@]")
#: What opens a stretch: a digit, an at sign, or how it and dots are written to hide an address.
MARK = re.compile(r"(?i)[0-9@]|[\[({<](?:at|dot)[\])}>]")
SIGN = re.compile(r"(?i)[\[({<](?:at|dot)[\])}>]$")
MOST_TOKENS = 6
#: Cue words that may stand before an entity.
CUES = {"email": {"email", "mail", "e-mail", "contact", "write"}, "ip": {"ip", "host", "address", "server", "from"}, "card": {"card", "visa", "mastercard", "pay", "cc"}, "phone": {"phone", "tel", "call", "fax", "mobile", "telephone"}}


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[0::2]) + sum((2 * x - 9 if x > 4 else 2 * x) for x in d[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL, found outwards from each at sign: a long run of letters is not tried from each of its places."""
    done = at = 0
    while (k := text.find("@", at)) >= 0:
        low = max(done, at)
        first = low + len(text[low:k].rstrip(LOCAL))
        at = k + 1
        if first < k and (m := DOMAIN.match(text, k + 1)):
            yield first, m.end()
            done = at = m.end()


def quads(text: str) -> Iterator[tuple[int, int]]:
    """Matches of IP: four neighbouring numbers of a run of digits and dots, whose parts are at most 255."""
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        begin = []
        for x in parts:
            begin.append(at)
            at += len(x) + 1
        k = 0
        while k + 3 < len(parts):
            four = parts[k : k + 4]
            if not all(four):
                k += 1
                continue
            if all(len(q := x.lstrip("0")) <= 3 and int(q or "0") <= 255 for x in four):
                yield begin[k], begin[k + 3] + len(four[3])
            k += 4


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans, by kind as listed and then start; a match that fails its condition is dropped and not tried again."""
    found = [("email", *span) for span in emails(text)]
    if not INTEREST.search(text):
        return found
    found += [("ip", *span) for span in quads(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


# ---------------------------------------------------------------------------------------------------------------- field

FEATURES = (
    "bias", "tokens", "at", "at_word", "dot_word", "top_level", "digits_3_6", "digits_7", "digits_8_10", "digits_11_15", "digits_16_19", "digits_20",
    "quads", "octets_ok", "luhn", "letters", "brackets", "plus", "groups_4", "groups_3_4", "single_number", "hex_like", "slash_or_colon", "decimal", "leading_zero_or_area",
    "cue_email", "cue_ip", "cue_card", "cue_phone", "short_tail", "spelt_end", "spelt_beside",
)


def span_features(tokens: list[str], i: int, j: int) -> list[int]:
    """Indices of the features that hold for the whole span tokens[i:j]."""
    words = tokens[i:j]
    s = " ".join(words).rstrip(",;:.!?\"'")
    digits = re.sub(r"[^0-9]", "", s)
    groups = re.findall(r"[0-9]+", s)
    low = s.lower()
    letters = bool(re.search(r"[^\W\d_]", s))
    before = tokens[i - 1].lower().strip(".,:;()#") if i else ""
    n = len(digits)
    octets = [g for g in groups if int(g[:6]) <= 255]
    holds = [
        True, j - i > 1, "@" in s, bool(re.search(r"[\[({<]\s*at\s*[\])}>]", low)), bool(re.search(r"[\[({<]\s*dot\s*[\])}>]", low)), bool(re.search(r"\.(com|org|net|edu|info|io|de|fr|es)$", low)) and "@" in s,
        3 <= n <= 6, n == 7, 8 <= n <= 10, 11 <= n <= 15, 16 <= n <= 19, n >= 20,
        len(groups) == 4, len(groups) == 4 and len(octets) == 4 and "." in s and " " not in s, 16 <= n <= 19 and luhn(digits), letters, bool(re.match(r"\(?\(?[0-9]{3}\)", s)), s.startswith("+"),
        len(groups) == 4 and all(len(g) == 4 for g in groups), len(groups) == 3 and [len(g) for g in groups] == [3, 3, 4], len(groups) == 1 and digits == s, bool(re.fullmatch(r"(?=.*[a-f])[0-9a-f]{8,}", low)),
        bool(re.search(r"[/:=_|\"]", s)), bool(re.fullmatch(r"[0-9]+[.,][0-9]+%?", s)), bool(re.match(r"0[0-9]{1,4}[ /-]", s)),
        before in CUES["email"], before in CUES["ip"], before in CUES["card"], before in CUES["phone"], bool(re.search(r"(?:^|\s)[0-9]{1,2}$", s)),
        # A span that starts or ends with a spelt sign, or stops short of one, is only part of an address.
        bool(SIGN.match(words[0]) or SIGN.match(words[-1])), bool((i and SIGN.match(tokens[i - 1])) or (j < len(tokens) and SIGN.match(tokens[j]))),
    ]
    return [k for k, h in enumerate(holds) if h]


def segments(tokens: list[str]) -> dict[tuple[int, int], list[int]]:
    """Candidate segments: spans that start and end with a token that can start or end an entity."""
    edge = [bool(re.search(r"[0-9@]|^[\[({<]?(?:at|dot)[\])}>]?$", t) or MARK.search(t)) or (k + 1 < len(tokens) and bool(re.match(r"(?i)[\[(<{]at[\])>}]$", tokens[k + 1]))) or (k and bool(re.match(r"(?i)[\[(<{](?:dot|at)[\])>}]$", tokens[k - 1]))) for k, t in enumerate(tokens)]
    return {(i, j): span_features(tokens, i, j) for i in range(len(tokens)) if edge[i] for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1) if edge[j - 1]}


def best_path(n: int, segs: dict[tuple[int, int], np.ndarray]) -> list[tuple[int, int, int]]:
    """The best segmentation of n tokens: one dynamic program over ends, segment starts and kinds; a lone token is free."""
    score, back = [0.0] * (n + 1), [None] * (n + 1)
    ending: dict[int, list] = {}
    for (i, j), sc in segs.items():
        ending.setdefault(j, []).append((i, sc))
    for j in range(1, n + 1):
        score[j] = score[j - 1]
        for i, sc in ending.get(j, ()):
            k = int(sc.argmax())
            if score[i] + sc[k] > score[j]:
                score[j], back[j] = score[i] + float(sc[k]), (i, k)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((i, j, k))
            j = i
    return out[::-1]


def made_lines(count: int, seed: int = 11) -> list[tuple[list[str], list[tuple[int, int, int]]]]:
    """Training lines by rule: entities in their usual spellings, and numbers that are none, between plain words."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abdeginorstu") for _ in range(r.randint(2, 8)))

    def card() -> str:
        d = r.choice("456") + num(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def entity(kind: int) -> str:
        if kind == 0:
            return r.choice([f"{word()}.{num(2)}@{word()}.com", f"{word()}@{word()}.org", f"{word()} [at] {word()} [dot] com", f"{word()} (at) {word()}.net", f"{word()} (at) {word()} (dot) org"])
        if kind == 1:
            return ".".join(str(r.randint(1, 255)) for _ in range(4))
        if kind == 2:
            d = card()
            return r.choice([d, " ".join(d[k : k + 4] for k in (0, 4, 8, 12)), "-".join(d[k : k + 4] for k in (0, 4, 8, 12))])
        a, b, c = str(r.randint(200, 989)), str(r.randint(200, 989)), num(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {num(3)} {num(7)}", f"+33 {num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"({a}) {b} {c}"])

    def decoy() -> str:
        return r.choice([num(r.randint(1, 7)), f"{num(2)}.{num(2)}", f"19{num(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{num(3)}/{num(2)}", "AK" + word().upper() + num(5), f"token={num(3)}ab{num(9)}f", f"v{num(1)}.{num(1)}.{num(1)}", num(16), f"{num(2)} {num(2)} {num(3)}", f"{num(2)}:{num(2)}", num(12), f"{num(3)} {num(3)}", f"3.{num(1)}.{num(1)}", f"{num(4)} {num(4)}", num(r.randint(8, 10)), f"{num(1)}, {num(1)}, {num(2)}", f"CC BY {num(1)}.0", f"cafe{num(8)}", f"999.{num(3)}.777.{num(2)}", f"{num(5)}-{num(4)}"])

    out = []
    for _ in range(count):
        tokens, gold = [word() for _ in range(r.randint(0, 3))], []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.5:
                kind = r.randrange(4)
                if r.random() < 0.3:
                    tokens.append(r.choice(sorted(CUES[KINDS[kind]])))
                parts = entity(kind).split(" ")
                gold.append((len(tokens), len(tokens) + len(parts), kind))
                if r.random() < 0.3:
                    parts[-1] += r.choice(",.;")
                tokens += parts
            else:
                tokens += decoy().split(" ")
            tokens += [word() for _ in range(r.randint(0 if r.random() < 0.2 else 1, 3))]
        out.append((tokens, gold))
    return out


@functools.lru_cache(maxsize=1)
def trained(lines: int = 500, epochs: int = 8, rate: float = 0.3) -> np.ndarray:
    """(kinds, features) weights: stochastic gradient on the conditional log-likelihood, by a forward-backward pass over segments."""
    w = np.zeros((len(KINDS), len(FEATURES)))
    w[:, 0] = -1.0
    data = []
    for tokens, gold in made_lines(lines):
        segs = segments(tokens)
        x = np.zeros((len(segs), len(FEATURES)))
        for r, f in enumerate(segs.values()):
            x[r, f] = 1
        y = np.zeros((len(segs), len(KINDS)))
        for r, key in enumerate(segs):
            for i, j, k in gold:
                if key == (i, j):
                    y[r, k] = 1
        data.append((len(tokens), list(segs), x, y))
    total = np.ones_like(w)
    for _ in range(epochs):
        for n, keys, x, y in data:
            if not keys:
                continue
            e = np.exp(np.clip(x @ w.T, -30, 30))
            mass = e.sum(axis=1)
            fwd, bwd = np.zeros(n + 1), np.zeros(n + 1)
            fwd[0] = bwd[n] = 1
            by_end, by_start = {}, {}
            for r, (i, j) in enumerate(keys):
                by_end.setdefault(j, []).append((i, mass[r]))
                by_start.setdefault(i, []).append((j, mass[r]))
            for j in range(1, n + 1):
                fwd[j] = fwd[j - 1] + sum(fwd[i] * m for i, m in by_end.get(j, ()))
            for i in range(n - 1, -1, -1):
                bwd[i] = bwd[i + 1] + sum(bwd[j] * m for j, m in by_start.get(i, ()))
            prob = e * np.array([fwd[i] * bwd[j] for i, j in keys])[:, None] / fwd[n]
            g = (y - prob).T @ x - 0.002 * w
            total += g * g
            w += rate * g / np.sqrt(total)
    return w


def stretches(text: str) -> Iterator[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """(places of all tokens, places of marked tokens): marked tokens of a line at most MOST_TOKENS apart, with as many tokens on both sides."""
    for line in re.finditer(r"[^\n]+", text):
        if not MARK.search(line[0]):
            continue
        spots = [(line.start() + t.start(), line.start() + t.end()) for t in re.finditer(r"\S+", line[0])]
        marked = [k for k, (s, e) in enumerate(spots) if MARK.search(text, s, e)]
        first = 0
        for k in range(1, len(marked) + 1):
            if k == len(marked) or marked[k] - marked[k - 1] > MOST_TOKENS:
                yield spots[max(0, marked[first] - MOST_TOKENS) : marked[k - 1] + MOST_TOKENS + 1], [spots[m] for m in marked[first:k]]
                first = k


class Taken:
    """Places that base spans cover."""

    def __init__(self, base: list[tuple[str, int, int]]):
        spans = sorted((s, e) for _, s, e in base)
        self.starts = [s for s, _ in spans]
        self.ends = list(accumulate((e for _, e in spans), max))

    def touches(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def added_spans(text: str, base: list[tuple[str, int, int]], w: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans that the field finds and that touch no base span."""
    out, done = [], 0
    taken = Taken(base)
    for spots, marked in stretches(text):
        if base and all(taken.touches(p, q) for p, q in marked):
            continue
        tokens = [text[s:e] for s, e in spots]
        segs = {}
        for (i, j), f in segments(tokens).items():
            # Neighbouring stretches may share tokens that aren't marked.
            if spots[i][0] >= done and not taken.touches(spots[i][0], spots[j - 1][1]):
                segs[(i, j)] = w[:, f].sum(axis=1)
        for i, j, k in best_path(len(tokens), segs):
            s, e = spots[i][0], spots[j - 1][1]
            done = max(done, e)
            e -= len(text[s:e]) - len(text[s:e].rstrip(",;:.!?\"'"))
            out.append((KINDS[k], s, e))
    return out


def find(text: str, w: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, each by kind as listed and then start."""
    base = base_spans(text)
    more = added_spans(text, base, w) if MARK.search(text) else []
    order = lambda x: (KINDS.index(x[0]), x[1], x[2])
    return sorted(base, key=order), sorted(base + more, key=order)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every whole text, a null one being empty.

    Returns doc_id, n_email, n_ip, n_card, n_phone (of the base spans), base, spans: `kind:start:end`, comma-joined, in
    code points with exclusive ends. Rows need no shuffle, so ties and repeated rows change nothing; weights are of fixed size.
    """
    w = trained()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = lambda xs: ",".join(f"{k}:{s}:{e}" for k, s, e in xs)
        for part in parts:
            for b in batches(part):
                found = [find(t or "", w) for t in b.column("text").to_pylist()]
                counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in KINDS]
                yield pa.RecordBatch.from_arrays([b.column("id"), *counts, pa.array([said(x) for x, _ in found], pa.string()), pa.array([said(x) for _, x in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return clean(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
