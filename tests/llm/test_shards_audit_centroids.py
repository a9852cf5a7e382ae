"""Sharding, the audit of filters and the clustering against brute-force versions, with nulls, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import audit, centroids, shards

TEXTS = [
    (1, "a b a b a b", "s"), (2, "a b a b a b", "s"), (2, "a b a b a b", "s"), (3, "word " * 250, "s"), (4, " ".join(f"w{k}" for k in range(260)), None), (5, "ABC def", ""), (6, "x # y", "t"), (7, None, "t"), (8, "", "t"),
    (None, "a b a b a b", "t"), (None, None, "t"), (9, " \t\n\x0b\x0c\r ", "s"), (9, "naïve one two", "s"), (10, " ".join(f"W{k} w{k}" for k in range(150)) + " & ¢", "t"), (11, " ".join(f"w{k}" for k in range(260)), "s"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (3, 1, 0), (6, 0, 1), (None, 1, 1), (9, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    extra = "row string, place string, words long, fails int, rows long, tie string, word string, part string"
    return spark.createDataFrame([(d, t, s, "r", "p", 1, 2, 3, "x", "y", "z") for d, t, s in TEXTS], f"doc_id long, text string, source string, {extra}").repartition(3)


# ---------------------------------------------------------------------------------------------------------- sharding


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 5))
def test_permutation_and_its_inverse(n, seed):
    rows = np.arange(n)
    places = shards.position(rows, n, seed)
    assert sorted(places) == list(rows) and (shards.row_at(places, n, seed) == rows).all()


def test_permutation_of_large_numbers():
    n = (1 << 52) + 12_345
    rows = np.random.default_rng(1).integers(0, n, 2000)
    places = shards.position(rows, n)
    assert (places < n).all() and (shards.row_at(places, n) == rows).all()
    # Spread over shards and over the whole range, and without the order of the rows.
    assert Counter(places % 16).most_common()[-1][1] > 80 and abs(places.mean() / n - 0.5) < 0.05
    assert abs(np.corrcoef(shards.position(np.arange(5000), 5000), np.arange(5000))[0, 1]) < 0.1
    with pytest.raises(ValueError):
        shards.position(np.array([5]), 5)


def by_hand(texts, n_shards, seed):
    key = lambda x: (x[0] if x[0] is not None else math.inf, x[2], x[1])
    sized = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in texts), key=key)
    bits, keys = shards.half_bits(len(sized)), shards.round_keys(seed)
    out = []
    for row, (d, size, crc) in enumerate(sized):
        place = row
        while True:
            left, right = place >> bits, place & ((1 << bits) - 1)
            for k in keys:
                x = (right + k) * shards.MIX[0] % (1 << 64)
                left, right = right, left ^ ((x ^ x >> 32) * shards.MIX[1] % (1 << 64)) >> (64 - bits)
            place = left << bits | right
            if place < len(sized):
                break
        out.append((d, size, crc, place % n_shards, place // n_shards))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n_shards", "seed"), [(16, shards.SEED), (4, 3), (1, 3)])
def test_shards_by_hand(docs, n_shards, seed):
    found = shards.shuffled(docs, n_shards, seed)
    got = [tuple(r) for r in found.select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
    assert sorted(got, key=str) == by_hand(TEXTS, n_shards, seed)
    counts = Counter(r[3] for r in got)
    assert max(counts.values()) - min(counts.get(k, 0) for k in range(n_shards)) <= 1
    assert all(sorted(r[4] for r in got if r[3] == k) == list(range(n)) for k, n in counts.items())


def test_shards_do_not_depend_on_partitions(docs):
    a, b = (sorted(map(str, shards.shuffled(d).collect())) for d in (docs, docs.repartition(1)))
    assert a == b


def test_a_shard_is_known_without_its_rows(spark, docs):
    found = {(r.shard, r.slot): r.row for r in shards.shuffled(docs, 4).collect()}
    for k in range(4):
        expected = shards.expected_rows(spark, len(TEXTS), k, 4).collect()
        assert {(k, r.slot): r.row for r in expected} == {x: y for x, y in found.items() if x[0] == k}


def test_written_shards(spark, docs, tmp_path):
    shards.write_shards(shards.shuffled(docs, 4, carry=("text", "place")), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(TEXTS) and {"text", "place"} <= set(back.columns)
    assert back.where("shard = 2").count() == len(TEXTS) // 4 + (len(TEXTS) % 4 > 2)


def test_hot_rows_are_numbered_over_all_ranges(spark):
    same = spark.range(0, 4000, 1, 8).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    found = shards.shuffled(same, 16).groupBy("shard").agg(F.count_distinct("slot").alias("n"), F.max("slot").alias("last")).collect()
    assert sorted(map(tuple, found)) == [(k, 250, 249) for k in range(16)]


def test_no_rows_to_shard(docs):
    found = shards.digests(shards.shuffled(docs.where("false")))
    assert found.collect() == [] and found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


# ------------------------------------------------------------------------------------------------------------- audit


def audited(texts, labels):
    first, good, bad = {}, set(), set()
    for d, t, _ in texts:
        first[t or ""] = min(first.get(t or "", math.inf), math.inf if d is None else d)
    for d, q, x in labels:
        good |= {d} if q == 1 and d is not None else set()
        bad |= {d} if x == 1 and d is not None else set()
    seen = defaultdict(list)
    for d, t, s in texts:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": (math.inf if d is None else d) > first[t],
        }
        seen[s or ""].append(({k for k, x in fails.items() if x}, d in good, d in bad))
    out = {}
    for part, rows in seen.items():
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order):
                before = set(order[:step])
                here = [r for r in rows if letter in r[0] and not r[0] & before]
                out[part, "".join(order), step + 1] = [
                    sum(not r[0] & (before | {letter}) for r in rows), len(here), sum(letter in r[0] and bool(r[0] & before) for r in rows), sum(r[0] == {letter} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here),
                ]
    shapley = Counter()
    for (part, order, step), x in out.items():
        shapley[part, order[step - 1]] += x[1]
    return {k: (*x, shapley[k[0], k[1][k[2] - 1]]) for k, x in out.items()}


def test_audit_by_brute_force(spark, docs):
    labels = spark.createDataFrame([(*x, "s") for x in LABELS], "doc_id long, quality int, toxic int, part string")
    found = audit.audit(docs, labels)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found.collect()}
    want = audited(TEXTS, LABELS)
    assert got == want and len(got) == 3 * 600
    assert any(x[4] for x in want.values()) and any(x[5] for x in want.values()) and any(x[2] for x in want.values()) and any(x[3] for x in want.values())


def test_audit_of_hot_copies(spark):
    same = spark.range(0, 3000, 1, 6).select(F.lit(7).cast("long").alias("doc_id"), F.lit("b a " * 150).alias("text"), F.lit("s").alias("source"))
    found = audit.audit(same, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.kept, r.removed, r.unique_fails) for r in found] == [(3000, 0, 0), (0, 3000, 3000), (0, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_audit_without_rows(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs.where("false"), labels).collect() == []
    assert {r.good_lost + r.toxic_lost for r in audit.audit(docs, labels).collect()} == {0}


# -------------------------------------------------------------------------------------------------------- clustering


def vectors(n=300, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, 64))
    v = (centres[r.integers(0, 9, n)] + 0.3 * r.normal(size=(n, 64))).astype(np.float32)
    rows = [(int(k), x.tolist()) for k, x in enumerate(v)]
    bad = [[1.0] * 63, [1.0] * 65, [], [float("nan")] + [0.0] * 63, [float("inf")] + [0.0] * 63, [None] + [0.0] * 63, None, [3e38] + [0.0] * 63]
    return rows + [(7, rows[7][1]), (None, rows[8][1]), (n, [-0.001] * 64)] + [(n + 1 + k, x) for k, x in enumerate(bad)]


def clustered(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 1e30 for x in v)]
    code = lambda v: np.array(v, "<i4").tobytes()
    heads = [v for _, v in sorted(kept, key=lambda x: (hashlib.sha256(f"1:{'' if x[0] is None else x[0]}".encode()).hexdigest(), code(x[1])))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(heads))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        heads = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else c for j, c in enumerate(heads)]
    out = [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept]
    sums = Counter()
    for _, c, d in out:
        sums[c] += d
    return sorted(((i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, heads[c])).encode()).hexdigest()) for i, c, d in out), key=str)


@pytest.mark.parametrize("n", [300, 5])
def test_clusters_by_brute_force(spark, n):
    rows = vectors(n=max(n, 9)) if n > 9 else vectors()[:n]
    df = spark.createDataFrame([(i, v, 1, "b") for i, v in rows], "vec_id long, embedding array<float>, cluster int, norms string").repartition(3)
    assert sorted(map(tuple, centroids.digests(*centroids.clusters(df)).collect()), key=str) == clustered(rows)


def test_screening_keeps_all_nearest_and_measures_few():
    r = np.random.default_rng(5)
    v = np.concatenate([r.integers(-90, 90, (500, 64)), np.repeat(r.integers(-3, 3, (40, 64)), 5, axis=0)]).astype("<i4")
    v = (v * r.integers(1, 30, (len(v), 1))).astype("<i4")
    heads = np.concatenate([v[:12], v[:2], np.zeros((2, 64), np.int64)]).astype(np.int64)
    cluster, distance, measured = centroids.assigned(v, centroids.block_norms(v), heads)
    exact = ((v[:, None, :].astype(np.int64) - heads[None]) ** 2).sum(axis=2)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all() and measured < 0.8 * exact.size
    assert (centroids.bounds(centroids.block_norms(v), centroids.block_norms(heads)) <= exact).all()


def test_bounds_of_the_largest_components():
    v = np.full((2, 64), centroids.MOST, "<i4") * np.array([[1], [-1]], "<i4")
    cluster, distance, _ = centroids.assigned(v, centroids.block_norms(v), v[:1].astype(np.int64))
    assert list(cluster) == [0, 0] and list(distance) == [0, 64 * (2 * centroids.MOST) ** 2]


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    found = centroids.digests(*centroids.clusters(df))
    assert found.collect() == [] and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
