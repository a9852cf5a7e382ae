"""Each operator against a brute-force version, with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lectern.llm import bpe, decontaminate, fingerprints, gsaca, jaccard, lines, pii, quality, substrings, suffixes, toxicity
from lectern.llm.queries import tokenizer_json

SCHEMA = "doc_id long, text string, chunk string, id long, score string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    passage = " ".join(word() for _ in range(30))
    base = " ".join(word() for _ in range(120))
    rows = [(d, " ".join(word() for _ in range(r.randint(20, 90))) + ("\n" + passage if d % 3 == 0 else "")) for d in range(20)]
    for d in range(20, 30):
        w = base.split(" ")
        for _ in range(d % 4):
            w[r.randrange(len(w))] = word()
        rows.append((d, " ".join(w)))
    return rows + [(30, base), (31, base), (32, None), (33, ""), (34, "  \n "), (35, "Only Four words here"), (36, "only four words Here"), (37, "x" * 4000 + " y\n" * 50)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "c", 0, "s") for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substrings(docs, rows, nothing):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    seen, want = {}, {}
    for d, w in words.items():
        for i in range(len(w) - 12):
            seen.setdefault(tuple(w[i : i + 13]), d)
    for d, w in words.items():
        gone = [any(seen[tuple(w[j : j + 13])] < d for j in range(max(0, i - 12), min(i, len(w) - 13) + 1)) for i in range(len(w))]
        want[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedup(docs).collect()} == want
    assert substrings.dedup(nothing).count() == 0


def test_suffixes(docs, rows, nothing):
    data = {d: (t or "").encode() for d, t in rows}
    seen, want = {}, {}
    for d, b in data.items():
        for i in range(len(b) - 49):
            seen.setdefault(b[i : i + 50], d)
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if seen[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        want[d] = (len(b), sum(gone), len(re.findall(b"\1+", gone)), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in suffixes.dedup(docs).collect()} == want
    assert suffixes.dedup(nothing).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_suffix_arrays(letters):
    r = np.random.default_rng(letters)
    texts = [list(r.integers(1, letters + 1, r.integers(0, 50))) + [0] for _ in range(60)]
    table = np.zeros((60, 51), np.int16)
    for k, t in enumerate(texts):
        table[k, : len(t)] = t
    got = gsaca.suffix_arrays(table, np.array([len(t) for t in texts]))
    for k, t in enumerate(texts):
        assert got[k, : len(t)].tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_jaccard(docs, rows, nothing):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()} == {d: (len(s), top(d)) for d, s in sets.items()}
    assert jaccard.join(nothing).count() == 0


def test_decontamination(spark, docs, rows, nothing):
    bench = spark.createDataFrame([(1, rows[0][1].split("\n")[1]), (2, "only FOUR"), (3, None), (4, "!!"), (5, rows[20][1])], "item_id long, text string")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = Counter()
    items = {}
    for r in bench.collect():
        w = find(r.text)
        for k in range(max(1, len(w) - 9)):
            if x := tuple(w[k : k + 10]):
                items.setdefault(x, set()).add(r.item_id)
    want = {}
    for d, t in rows:
        w, hit, it = find(t), set(), set()
        for x, who in items.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    it |= who
        want[d] = (len(w), len(hit), ",".join(sorted(map(str, it))))
    got = decontaminate.digests(decontaminate.contamination(docs, bench)).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.items_sha256) for r in got} == {d: (n, h, hashlib.sha256(s.encode()).hexdigest()) for d, (n, h, s) in want.items()}
    assert decontaminate.contamination(nothing, bench).count() == 0 and not windows


def test_decontamination_of_repeated_rows(spark):
    leak = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(7, leak), (8, "solo")], "item_id long, text string")
    rows = [(1, "x " + leak), (1, "x " + leak), (1, "x " + leak), (1, "clean"), (None, leak), (None, leak), (2, "so solo"), (2, "so solo"), (3, "nine ten")]
    got = decontaminate.digests(decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench)).collect()
    assert Counter((r.doc_id, r.n_hit, r.contaminated) for r in got) == Counter({(1, 11, True): 3, (1, 0, False): 1, (None, 11, True): 2, (2, 1, True): 2, (3, 0, False): 1})


def test_jaccard_moves_only_sets_that_are_paired(docs, monkeypatch):
    written, keep = [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: written.append((name, df)) or keep(df, name))
    answer = lambda: sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in jaccard.join(docs).collect())
    want = answer()
    # No second table of the sets is written, and those of one side of the pairs stay where they lie.
    assert "pairs" in [n for n, _ in written] and "sets" not in [n for n, _ in written]
    met = next(df for n, df in written if n == "met")._jdf.queryExecution().executedPlan().toString()
    assert met.count("BroadcastHashJoin") >= 3
    # Above the bound sets and pairs meet in shuffle joins, with the same result.
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    written.clear()
    assert answer() == want and "sets" in [n for n, _ in written]


def test_proximity(spark):
    index = spark.createDataFrame([("a", 1, 3), ("b", 1, 9), ("b", 1, 40), ("b", 2, 4)], "term string, id long, pos int")
    assert [(r.id, r.pos, r.other) for r in decontaminate.proximity(index, "a", "b", 6).collect()] == [(1, 3, 9)]


def test_lines(docs, rows, spark):
    near = " ".join(f"word{i}" for i in range(80))
    more = spark.createDataFrame([(50, near + "\nother line"), (51, near.replace("word40", "wird40") + "\n\nOTHER line "), (52, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept) for r in lines.dedup(more).collect()}
    assert got[50] == (0, near + "\nother line") and got[52] == (0, "") and got[51][0] >= 1 and "OTHER" not in got[51][1]
    seen, got = set(), {r.doc_id: set(r.removed) for r in lines.dedup(docs).collect()}
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            if k := x.strip(" ").lower():
                assert k not in seen or i in got[d]
                seen.add(k)


def edit_similarity(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return 1 - row[-1] / max(len(x), len(y))


def test_near_lines(spark):
    r = random.Random(8)
    syllables = ["er", "in", "th", "on", "re", "an", "st", "ou", "le", "ion", "ver", "ach"]
    vocabulary = ["".join(r.choices(syllables, k=min(r.choices([1, 2, 3, 4], [3, 4, 3, 1])[0], 4))) for _ in range(1500)]
    texts = []
    for n in [5, 6, 8, 10, 14, 20, 27, 40] * 12:
        a = [r.choice(vocabulary) for _ in range(n)]
        b = list(a)
        for k in r.sample(range(n), r.randint(1, max(1, n // 7))):
            b[k] = r.choice(vocabulary) if r.random() < 0.6 else b[k][:-1] + "q"
        texts += [" ".join(a), " ".join(b)]
    found = lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("n_removed = 1").collect()
    gone = {x.doc_id for x in found}
    # Brute force: a line goes if it hangs together with an earlier one by links of edit similarity SIMILAR.
    fit = [k for k in range(0, len(texts), 2) if edit_similarity(texts[k], texts[k + 1]) >= lines.SIMILAR]
    assert len(fit) > 80 and sum(k + 1 in gone for k in fit) >= 0.98 * len(fit)
    assert all(any(edit_similarity(texts[d], texts[e]) >= lines.SIMILAR for e in range(len(texts)) if e != d) for d in gone)


def test_lines_lose_no_link(spark):
    r = random.Random(5)
    texts = ["cheque", "cheques", "user 12345678 has logged in", "user 12349999 has logged in", "ab", "ac"]
    for n in [1, 2, 3, 6, 12, 40] * 4:
        a = " ".join("".join(r.choices("etaoinsrhld", k=r.randint(3, 9))) for _ in range(n))
        b = list(a)
        for k in r.sample(range(len(b)), len(b) // 6):
            b[k] = r.choice("xyz") if b[k] != " " else " "
        texts += [a, "".join(b)]
    root = list(range(len(texts)))
    for e in range(len(texts)):
        for d in range(e):
            if root[d] != root[e] and edit_similarity(texts[d], texts[e]) >= lines.SIMILAR - 1e-9:
                root = [min(root[d], root[e]) if x in (root[d], root[e]) else x for x in root]
    found = lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {x.doc_id for x in found.where("n_removed = 1").collect()} == {e for e in range(len(texts)) if root[e] != e} and len(set(root)) < len(texts) - 20


def test_lines_fold_punctuation(spark):
    table = spark.createDataFrame([(1, "All rights reserved, 2024.\n---"), (2, "all rights -- reserved (2024)\n---")], "doc_id long, text string")
    assert {x.doc_id: x.kept for x in lines.dedup(table).collect()} == {1: "All rights reserved, 2024.\n---", 2: "---"}


def test_fingerprints(docs, rows):
    got = {r.doc_id: r for r in fingerprints.compared(docs).collect()}
    texts = [t or "" for _, t in rows]
    for k, (d, _) in enumerate(rows):
        half, nxt = len(texts[k]) // 2, texts[(k + 1) % len(texts)]
        assert got[d].edited_sha256 == hashlib.sha256((texts[k][: len(texts[k]) - half] + nxt[:half]).encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[30].fingerprint == got[31].fingerprint and got[30].near_next == 1 and len({r.fingerprint for r in got.values()}) == len(set(texts))


def test_bpe(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_str(tokenizer_json())
    got = {r.doc_id: r for r in bpe.encode_decode(docs, tokenizer_json()).collect()}
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[d].ids), "<u4").tolist() == ids and got[d].decoded == t.decode(ids, skip_special_tokens=False)
    e = bpe.Encoder(bpe.Vocabulary(tokenizer_json()))
    for text in ("a<|endoftext|>b", "日本語  x y", "a" * 999, "it's  I'LL\r\n\n"):
        assert e.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_pii_base_spans():
    text = "é a.b@c.de, 1.2.3.4 999.1.1.1 is 4111 1111 1111 1111 +1 (705) 555-6638 x 4111111111111112"
    assert [(k, text[s:e]) for k, s, e in pii.base_spans(text)] == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (705) 555-6638")]
    base, every = pii.find("tel +1 (269) 555-3296 4524132264652876 end", pii.trained())
    assert set(base) <= set(every) and ("card", 22, 38) in every and pii.find("", pii.trained()) == ([], [])


@pytest.mark.parametrize("said", ["anna [at] example [dot] org", "anna (at) example (dot) com", "anna7 [at] example [dot] org", "anna (at) example.net", "anna [AT] example [DOT] org"])
@pytest.mark.parametrize("around", ["{}", "please write to {} or come by on any day of the week", "twelve words stand here before it so that nothing is near by {}, thanks\nnext line"])
def test_pii_spelt_addresses(said, around):
    text = around.format(said)
    at = text.index(said)
    assert pii.find(text, pii.trained()) == ([], [("email", at, at + len(said))])


def test_pii_stretches():
    text = "a b c d e f g 1 h i j k l m 2 n o p q r s t 3\n4"
    got = [("".join(text[s:e] for s, e in spots), "".join(text[s:e] for s, e in marked)) for spots, marked in pii.stretches(text)]
    assert got == [("bcdefg1hijklm", "1"), ("hijklm2nopqrs", "2"), ("opqrst3", "3"), ("4", "4")]


def test_classifiers(spark, docs):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    text = lambda bad: " ".join(word() + ("###" if bad == "q" else "") + (" blarghy" if bad == "x" and i % 9 == 0 else "") for i in range(60))
    made = [(i, text("q" if i % 2 else "x" if i % 4 == 0 else "")) for i in range(300)]
    table = spark.createDataFrame([*made, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, 1 - i % 2, int(i % 4 == 0)) for i in range(300)], (None, 1, 0), (900, None, None)], "doc_id long, quality int, toxic int")
    for got, want in ((quality.classify(table, table, labels), lambda i: 1 - i % 2), (toxicity.classify(table, labels), lambda i: int(i % 4 == 0))):
        got = got.collect()
        assert len(got) == 302 and all(0 <= x.score <= 1 for x in got)
        held = [x for x in got if x.held_out and x.doc_id < 300]
        assert sum(x.predicted == want(x.doc_id) for x in held) >= 0.95 * len(held) > 0
    assert toxicity.classify(docs, labels.where("false")).count() == docs.count()


def test_pipeline(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema)
        assert docs.columns == list(corpus_pipeline.COLUMNS) and 0.3 * n < docs.count() <= n, name
        n = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == n
