"""Matching and sequence operators against plain Python, readers and writers by round trips, the window over a real stream."""

import random
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lectern.functions import names as N
from lectern.operators import matching as M
from lectern.operators import sequences as S
from lectern.sources import readers, writers
from lectern.streaming import latency

KNOWN = ["Ana Dimitrijević", "Emmy van Dorn", "Eva van Dorn", "Kim Loliya", "Kim A. Loliya", "Zoë Marchetti"]
ASKED = ["ana  dimitrijevic", "E. van Dorn", "Ed van Dorn", "K. Loliya", "Zoe Marcheti", "Zoé Marchetti", "Zo Marchetti", "Quite Other", "Mono", "", "Emmy Van Dorne"]


def key(s):
    return " ".join("".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower().split())


def block(s):
    w = s.lower().split()
    at = next((i for i in range(1, len(w)) if w[i] in N.PARTICLES), None)
    return (" ".join(w[at:]) if at else w[-1]) if len(w) > 1 else s.lower(), (w or [""])[0][:1]


def decided(name):
    same = sorted(c for c in KNOWN if key(c) == key(name))
    if same:
        return same[0], "exact"
    near = sorted(c for c in KNOWN if block(c) == block(name))
    if near:
        return (near[0], "fuzzy") if len(near) == 1 else (None, "ambiguous")
    score, best = min((-SequenceMatcher(None, key(name), key(c)).ratio(), c) for c in KNOWN)
    return (best, "fuzzy") if -score >= M.LEAST_RATIO else (None, "new")


def test_near_pairs_by_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeiklmnrst") for _ in range(r.randint(1, 9)))
    known = sorted({f"{word()} {word()}" for _ in range(300)} | {"a", "ab", "", "é"})
    asked = set()
    for k in known:
        x = list(k)
        for _ in range(r.randint(1, 3)):
            at = r.randrange(len(x) + 1)
            x[at : at + r.randint(0, 1)] = r.choice(["", "q", "a"])
        asked.add("".join(x))
    asked |= {word() for _ in range(100)}
    for least in (0.85, 0.75, 0.6):
        pairs = M.near_pairs(spark.createDataFrame([(x, x) for x in asked], "name string, key string"), spark.createDataFrame([(x, x) for x in known], "canonical string, other string"), least).collect()
        want = {(a, b) for a in asked for b in known if SequenceMatcher(None, a, b).ratio() >= least}
        met = [(p.name, p.canonical) for p in pairs]
        # Every pair of the ratio is met, none twice, and with a high ratio few others are.
        assert want <= set(met) and len(met) == len(set(met))
        assert least < 0.85 or (len(met) < 20 * len(want) and len(met) < 0.06 * len(asked) * len(known))


def test_registry(spark):
    names = spark.createDataFrame([(n,) for n in [*ASKED, None, ASKED[0]]], "name string")
    got = M.registry_match(names, spark.createDataFrame([(n,) for n in KNOWN], "canonical string")).collect()
    assert {r.name: (r.canonical, r.status) for r in got} == {n: decided(n) for n in ASKED}
    assert len(got) == len(ASKED)


def test_one_to_one_takes_author_then_first_free(spark):
    schema = "id long, scope string, title string, author string"
    old = spark.createDataFrame([(1, "a", "T", "x"), (2, "a", "t ", "y"), (3, "a", "T", "z"), (4, "a", "U", "x"), (5, "a", "U", None), (6, "b", "T", "x")], schema)
    new = spark.createDataFrame([(10, "a", "t", "y"), (11, "a", "T", "q"), (12, "a", "U", "x")], schema)
    got = {r.old_id: r.new_id for r in M.one_to_one(old, new).collect()}
    assert got == {1: 10, 2: 11, 3: None, 4: 12, 5: 12, 6: None}


def test_contained_and_prefix(spark):
    d = spark.createDataFrame([(1, "s", "abc"), (2, "s", "xabcx"), (3, "t", "abc"), (4, "s", ""), (5, "s", None)], "id long, scope string, text string")
    got = M.contained(d, d, "scope").where("left_id < right_id").collect()
    assert [(r.left_id, r.right_id) for r in got] == [(1, 2)]
    right = spark.createDataFrame([("s", "abd", 1), ("s", "abc", 2)], "scope string, text string, v int")
    assert sorted(r.id for r in M.prefix_verified(d, right, ["scope"], "text", 2).collect()) == [1, 4, 5]


def test_numbered_items(spark):
    rows = [(1, ["head", "1 One", "more", "2. Two", "9 nine", "3Three"]), (2, ["1 a", "2 b"]), (3, None), (4, [])]
    got = spark.createDataFrame(rows, "id long, l array<string>").select("id", S.numbered_items("l").alias("v")).orderBy("id").collect()
    assert [r.v for r in got] == [["One more", ". Two 9 nine", "Three"], None, None, None]


def test_back_matter_keeps_what_trails(spark):
    flags = {1: [0, 1, 0, 1, 1, 0], 2: [0, 0], 3: [1, 1]}
    df = spark.createDataFrame([(k, i, bool(f)) for k, v in flags.items() for i, f in enumerate(v)], "k long, p int, b boolean")
    assert sorted((r.k, r.p) for r in S.back_matter(df, "k", "p", F.col("b")).collect()) == [(1, 3), (1, 4), (1, 5), (3, 0), (3, 1)]


def test_margins_and_words(spark):
    xs = [72.0, 72.3, 82.0, 120.0, 130.0, 78.0]
    known = []
    for x in sorted(set(xs)):
        if not any(S.INDENT[0] < x - m <= S.INDENT[1] or abs(x - m) <= S.INDENT[0] for m in known):
            known.append(x)
    df = spark.createDataFrame([(1, x, x + 300) for x in xs], "page int, x double, r double")
    got = S.margins(df, "page", "x", "r").first()
    assert (list(got.margins), got.right) == (known, 430.0)
    words = spark.createDataFrame([("a" * 29,), ("a" * 28,), ("http://" + "a" * 40,)], "t string")
    assert [r.v for r in words.select(S.run_together(F.col("t")).alias("v")).collect()] == [True, False, False]


def test_readers(spark, tmp_path):
    (tmp_path / "j").mkdir()
    for n in ("b", "a"):
        (tmp_path / "j" / f"{n}.json").write_text('{"volume": 1,\n "issue": 2, "name": "%s"}' % n)
    docs = readers.json_documents(spark, str(tmp_path / "j"), "volume int, issue int, name string")
    assert docs.count() == 2 and readers.first_by_key(docs, ["volume", "issue"]).first().name == "a"
    (tmp_path / "t.tsv").write_text("1\tx\nbad\ty\n2\tz\n")
    good, bad = readers.delimited(spark, str(tmp_path / "t.tsv"), "id int, v string")
    assert sorted(r.id for r in good.collect()) == [1, 2] and [r.raw for r in bad.collect()] == ["bad\ty"]
    (tmp_path / "x.xml").write_text("<a>\n<ref>One</ref><fn>f</fn><ref>Two</ref></a>")
    got = readers.xml_items(readers.xml_documents(spark, str(tmp_path / "x.xml")), "//ref/text()").collect()
    assert [(r.pos, r.item) for r in got] == [(1, "One"), (2, "Two")]
    files = spark.createDataFrame([("p/a.json",)], "path string")
    flagged = readers.with_sidecar(spark.createDataFrame([("a",), ("b",)], "n string"), files, F.concat(F.lit("p/"), "n", F.lit(".json")))
    assert {r.n: r.has_sidecar for r in flagged.collect()} == {"a": True, "b": False}


def test_writers(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    with pytest.raises(FileNotFoundError):
        writers.read_table(spark, root)
    writers.replace_table(rows((1, "a"), (2, "b")), root)
    writers.replace_keys(rows((2, "c"), (3, "d")), root, ["k"])
    assert sorted(map(tuple, writers.read_table(spark, root).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    writers.replace_table(rows(), root)
    assert writers.read_table(spark, root).count() == 0
    writers.write_csv(rows((1, "a")), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().v == "a"
    assert "| 1 | a |" in writers.report(rows((1, "a")), "R")


def test_latency_over_a_stream(spark, tmp_path):
    spark.range(120).select(F.timestamp_seconds(F.col("id") + 1_700_000_040).alias("ts"), F.col("id").cast("double").alias("v")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = latency.latency_windows(stream, "ts", "v").writeStream.format("memory").queryName("latency").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert sorted((r.n, r["mean"]) for r in spark.table("latency").collect()) == [(60, 29.5), (60, 89.5)]
    finally:
        q.stop()


def test_one_to_one_without_a_group_a_call(spark):
    r = random.Random(3)
    side = lambda at: [(at + i, r.randint(0, 12), r.choice("pq"), r.choice(["a", "b", None])) for i in range(150)]
    a, b = side(0), side(1000)
    old, new = (spark.createDataFrame(x, "id long, scope long, title string, author string") for x in (a, b))
    found = M.one_to_one(old, new)
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()
    want = {}
    for key in {x[1:3] for x in a}:
        free = [(x[0], x[3] or "") for x in b if x[1:3] == key]
        once = free[0][0] if len(free) == 1 else None
        for i, _, _, author in [x for x in a if x[1:3] == key]:
            got = next((f for f in free if f[1] == (author or "")), free[0] if free else None)
            want[i] = once or (got[0] if got else None)
            if got and not once:
                free.remove(got)
    assert {x.old_id: x.new_id for x in found.collect()} == want
