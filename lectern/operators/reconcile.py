"""Membership resolution and reconciliation: entitlements, drift, monotone upserts, diffs, retention, load shedding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.rows import null_dominant_max


def entitlements(sources: Sequence[DataFrame]) -> DataFrame:
    """(user_id, type, date_start, date_end) of each user over sources in order of priority: type of the first source that
    has one, earliest start, latest end where a missing end never expires."""
    tagged = [s.select("user_id", "type", "date_start", "date_end", F.lit(i).alias("priority")) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, tagged).groupBy("user_id").agg(F.min(F.struct("priority", "type"))["type"].alias("type"), F.min("date_start").alias("date_start"), null_dominant_max("date_end").alias("date_end"))


def active(now: Column, end: str = "date_end") -> Column:
    return F.col(end).isNull() | (F.col(end) > now)


def missing_access(local_active: DataFrame, remote_active: DataFrame) -> DataFrame:
    """Active here, not there, by lower-cased email."""
    return local_active.withColumn("email", F.lower("email")).join(remote_active.select(F.lower("email").alias("email")).distinct(), "email", "left_anti")


def stale_access(synced: DataFrame, local_active: DataFrame, remote: DataFrame) -> DataFrame:
    """Synced before, no longer active here, and active there or unknown there (it fails open)."""
    gone = synced.join(local_active.select("user_id").distinct(), "user_id", "left_anti")
    state = remote.groupBy("user_id").agg(F.bool_or("is_active").alias("is_active"))
    return gone.join(state, "user_id", "left").where(F.coalesce("is_active", F.lit(True))).drop("is_active")


def monotone_upsert(stored: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """(key, type, date_end): an active end is only extended or made endless; an inactive row is overwritten; type follows the input."""
    s = stored.select("key", F.col("type").alias("s_type"), F.col("date_end").alias("s_end"), F.lit(True).alias("s"))
    n = new.select("key", F.col("type").alias("n_type"), F.col("date_end").alias("n_end"), F.lit(True).alias("n"))
    both = s.join(n, "key", "full")
    alive = F.col("s").isNotNull() & (F.col("s_end").isNull() | (F.col("s_end") > now))
    end = F.when(F.col("n").isNull(), F.col("s_end")).when(~F.coalesce(alive, F.lit(False)), F.col("n_end")).when(F.col("s_end").isNull() | F.col("n_end").isNull(), None).otherwise(F.greatest("s_end", "n_end"))
    return both.select("key", F.when(F.col("n").isNotNull(), F.col("n_type")).otherwise(F.col("s_type")).alias("type"), end.alias("date_end"))


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: rows of both tables by key, the new one's values where it has the key."""
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*values).alias("__old"))
    n = new.select(*keys, F.struct(*values).alias("__new"))
    both = o.join(n, list(keys), "full").withColumn("__row", F.coalesce("__new", "__old"))
    return both.select(*keys, *[F.col("__row")[v].alias(v) for v in values])


def inserted_or_ignored(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def replaced_scope(old: DataFrame, new: DataFrame, scope: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in scope are deleted, the new ones in scope added; an empty scope is refused."""
    if scope.isEmpty():
        raise ValueError("refused: the scope is empty")
    return old.join(scope, list(keys), "left_anti").unionByName(new.join(scope, list(keys), "left_semi"))


def field_diff(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, old, new) for each field that differs, nulls compared as values."""
    both = left.alias("l").join(right.alias("r"), key)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l.{f}").cast("string").alias("old"), F.col(f"r.{f}").cast("string").alias("new")) for f in fields])
    return both.select(key, F.explode(F.filter(cells, lambda c: ~c["old"].eqNullSafe(c["new"]))).alias("c")).select(key, "c.field", "c.old", "c.new")


def three_way(base: DataFrame, one: DataFrame, two: DataFrame, key: str, value: str) -> DataFrame:
    """(key, verdict): agree, different, first_only, second_only or neither, for each key of base."""
    j = base.select(key).join(one.select(key, F.col(value).alias("a")), key, "left").join(two.select(key, F.col(value).alias("b")), key, "left")
    v = F.when(F.col("a").isNull() & F.col("b").isNull(), "neither").when(F.col("b").isNull(), "first_only").when(F.col("a").isNull(), "second_only").when(F.col("a") == F.col("b"), "agree").otherwise("different")
    return j.select(key, v.alias("verdict"))


def retained(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows no older than `days`: only strictly older ones go."""
    return df.where(~(F.col(ts) < now - F.expr(f"INTERVAL {days} DAYS")))


def shed_load(samples: Column, mean_ms: Column) -> Column:
    """Seconds that callers should wait: none under 5 samples or under 500 ms, 5 beyond 2000 ms, else 2."""
    return F.when(samples < 5, 0).when(mean_ms < 500, 0).when(mean_ms > 2000, 5).otherwise(2)


def rate(hit: Column, of: Column | None = None) -> Column:
    """Percent of rows, one decimal, null where there are none."""
    n = F.count(F.lit(1)) if of is None else F.sum(of.cast("int"))
    return F.round(100.0 * F.sum(hit.cast("int")) / F.nullif(n, F.lit(0)), 1)
