"""Toxicity: a weighted finite-state pattern grammar over clauses.

Small transducers read a text. Insults and threats share one trie over letters, learnt from labelled rows: a word is
accepted with the weight of its longest known stem, and a threat in words that are ordinary one by one isn't found by its
wording. Target, negation and reported-speech transducers accept short
fixed word lists of the four languages. A clause transducer composes them: reading a clause's symbols from left to right it
keeps a state (negation open, report open, target seen), and a matched stem gives its weight, changed by the
state. A document's score is a logistic function, also learnt, of its clauses' weights.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batches, clean, labelled_sample

#: Bound of what training reads: texts of each class.
SAMPLE_PER_CLASS = 3_000
#: Words that name a target, negate, or report speech, in English, German, French and Spanish.
TARGETS = "you your yours u he she they them these those du dich dir ihr euch sie er tu toi vous votre te ils elles tú ti usted ustedes vosotros ellos ellas".split()
NEGATIONS = "not no never isn't aren't don't without nicht kein keine keinen nie niemals ohne ne pas jamais sans ni nunca jamás sin".split()
REPORTS = "said says say called quoted wrote claimed reported sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()
STEMS = range(4, 9)
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]")


@dataclass
class Grammar:
    """stems: weight of each accepted stem or whole word (whole words end in a blank); rest: the logistic unit."""

    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))
    offset: float = 0.0

    def __post_init__(self):
        self.role = {w: k for k, ws in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in ws}
        # One pass finds the texts and words to look at: the trie of all stems as a pattern with shared prefixes.
        self.seek = re.compile(r"\b(?:" + trie_pattern(sorted(s.strip() for s in self.stems)) + ")") if self.stems else None

    def accept(self, word: str) -> float:
        """Weight of the longest path that accepts the word; 0 if none does."""
        if (w := self.stems.get(word + " ")) is not None:
            return w
        for n in sorted(STEMS, reverse=True):
            if len(word) >= n and (w := self.stems.get(word[:n])) is not None:
                return w
        return 0.0

    def clause(self, words: list[str]) -> float:
        """Weight of one clause under the composed transducer."""
        negated = reported = 0
        target, total = False, 0.0
        for word in words:
            role = self.role.get(word)
            if role == "negation":
                negated = 3  # holds for the next words
            elif role == "report":
                reported = 8
            elif role == "target":
                target = True
            elif w := self.accept(word):
                total += w * (0.3 if negated else 1.0) * (0.6 if reported else 1.0) * (1.2 if target else 1.0)
            negated, reported = max(0, negated - 1), max(0, reported - 1)
        return total

    def features(self, text: str) -> np.ndarray:
        """log of the summed and largest clause weights, matched clauses, and the share of clauses matched."""
        out = np.zeros(len(self.weights))
        low = text.lower()
        if self.seek is None or not self.seek.search(low):
            return out
        found, n = [], 0
        at, ends = 0, [*(m.end() for m in CLAUSE.finditer(low)), len(low)]
        for e in ends:
            n += e > at + 1
            part = low[at:e]
            at = e
            if self.seek.search(part) and (w := self.clause(WORD.findall(part))):
                found.append(w)
        if found:
            out[:] = 1, np.log1p(sum(found)), np.log1p(max(found)), np.log1p(len(found)), len(found) / max(1, n), np.log1p(1e4 * sum(found) / max(1, len(low)))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), len(self.weights))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.offset, -30, 30)))


def trie_pattern(words: list[str]) -> str:
    """A pattern for any of the sorted words that shares their prefixes, so that matching walks one path of a trie."""
    if not words or words[0] == "":
        return ""
    out = []
    for c in dict.fromkeys(w[0] for w in words):
        out.append(re.escape(c) + trie_pattern([w[1:] for w in words if w[0] == c]))
    return out[0] if len(out) == 1 else "(?:" + "|".join(out) + ")"


def train(rows: list[tuple[str, int]], counts: dict[int, int]) -> Grammar:
    """Stems whose share among toxic texts is many times that among others; then the logistic unit by Newton's steps."""
    n = Counter(y for _, y in rows)
    prior = np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))
    if not n[0] or not n[1]:
        return Grammar(offset=float(prior))
    seen = {0: Counter(), 1: Counter()}
    for text, y in dict.fromkeys(rows):
        words = set(WORD.findall(text.lower()))
        seen[y].update({w + " " for w in words} | {w[:k] for w in words for k in STEMS if len(w) >= k})
    stems = {}
    for s, k in seen[1].items():
        odds = (k / n[1]) / ((seen[0][s] + 0.5) / n[0])
        if k >= max(5, 0.01 * n[1]) and odds >= 12:
            stems[s] = float(min(4.0, np.log(odds) / 2))
    # Of a chain of stems that accept the same words the longest stays; then one that a shorter stem covers adds no path.
    longer = {s[:k]: max(seen[1][s], 0) for s in sorted(stems, key=lambda s: seen[1][s]) for k in range(min(STEMS), len(s))}
    stems = {s: w for s, w in stems.items() if longer.get(s, 0) < 0.95 * seen[1][s]}
    stems = {s: w for s, w in stems.items() if not any(s[:k] in stems and s[:k] != s for k in STEMS if k < len(s.strip()))}
    g = Grammar(stems, np.zeros(6), 0.0)
    x = np.array([[*g.features(t), 1.0] for t, _ in rows])
    y = np.array([v for _, v in rows], dtype=float)
    share = np.where(y == 1, counts[1] / n[1], counts[0] / n[0])
    share /= share.mean()
    w = np.zeros(7)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + 0.3 * np.append(w[:-1], 0)
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag([0.3] * 6 + [1e-6])
        w -= np.linalg.solve(hess, grad)
    g.weights, g.offset = w[:-1], float(w[-1])
    return g


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row; a null text scores as an empty one. No shuffle; the grammar is of bounded size."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(grammar.stems, grammar.weights, grammar.offset)
        for part in parts:
            for b in batches(part):
                texts = [t or "" for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(g.score(texts))], names=["doc_id", "score"])

    return clean(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Contract rows: doc_id, held_out, score, predicted."""
    g = train(*labelled_sample(docs, labels, "toxic", 4, 2, SAMPLE_PER_CLASS))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return score(docs, g).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
