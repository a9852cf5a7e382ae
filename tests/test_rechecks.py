"""Deferred checks: the table against plain Python, and a stream against the table."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lectern.streaming import rechecks as R

START = datetime(2024, 1, 1)


def events(seed, n=400):
    r = random.Random(seed)
    rows = [(r.choice("abc"), START + timedelta(milliseconds=500 * r.randint(0, n)), r.choice(["start", "end", "end", "other"])) for _ in range(n)]
    return rows + [(None, START, "end"), ("a", None, "end"), ("lone", START, "end")]


def by_hand(rows, delay=5):
    out = []
    for user in {u for u, t, _ in rows if u and t}:
        own = sorted((t, k != "start") for u, t, k in rows if u == user and t and k != "other")
        pending, active = None, 0
        for t, end in own + [(datetime(2100, 1, 1), False)]:
            if pending and pending < t:
                out.append((user, pending, active, active <= 0))
                pending = None
            active += -1 if end else 1
            pending = t + timedelta(seconds=delay) if end and pending is None else pending
    return sorted(out)


def kinds():
    return F.when(F.col("kind") == "start", True).when(F.col("kind") == "end", False)


def test_table_by_hand(spark):
    for seed in range(3):
        rows = events(seed)
        got = R.rechecks(spark.createDataFrame(rows, "user string, ts timestamp, kind string"), "user", "ts", kinds()).collect()
        assert sorted(map(tuple, got)) == by_hand(rows)
    assert R.rechecks(spark.createDataFrame([], "user string, ts timestamp, kind string"), "user", "ts", kinds()).collect() == []


def test_stream_gives_the_rows_of_the_table(spark, tmp_path):
    rows = [x for x in events(9, 150) if x[0] and x[1]]
    random.Random(1).shuffle(rows)
    # Three batches out of order, within the lateness, and two that move the watermark past all checks.
    parts = [rows[:50], rows[50:100], rows[100:], [("z", START + timedelta(hours=1), "other"), ("z", START + timedelta(hours=1), "start")], [("z", START + timedelta(hours=2), "start")]]
    schema = "user string, ts timestamp, kind string"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    found = R.rechecks(source, "user", "ts", kinds(), late="10 minutes")
    query = found.writeStream.format("memory").queryName("rechecked").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert sorted(map(tuple, spark.table("rechecked").collect())) == by_hand(rows)
