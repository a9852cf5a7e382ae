"""Joins that decide between candidates: a name registry, one-to-one matches of repeated titles, containment."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import names as N

#: Ratio from which on a name is taken for a misspelt registry entry.
LEAST_RATIO = 0.85


def registry_match(names: DataFrame, registry: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """(name, canonical, status, candidates) for each distinct name against registry (canonical).

    By equal folded key: exact. Else by family name and initial: fuzzy with one candidate, ambiguous with several (canonical is
    null then). Else the entry of the largest ratio if that is `least` at least, ties to the smaller entry: fuzzy. Else new.
    All joins are on equal values (keys, or rare pairs of letters), so that neither side is ever sent whole to one task.
    """
    asked = names.select("name").where("name is not null").distinct().withColumn("key", N.name_key(F.col("name")))
    known = registry.select("canonical").where("canonical is not null").distinct().withColumn("key", N.name_key(F.col("canonical")))
    exact = asked.join(known.groupBy("key").agg(F.min("canonical").alias("exact")), "key", "left")
    block = [N.family_name, N.initial]
    blocks = known.groupBy(*[f(F.col("canonical")).alias(n) for f, n in zip(block, "fi")]).agg(F.array_sort(F.collect_set("canonical")).alias("found"))
    met = exact.withColumns({n: f(F.col("name")) for f, n in zip(block, "fi")}).join(blocks, ["f", "i"], "left")
    met = met.select("name", "key", "exact", F.when(F.col("exact").isNull(), F.col("found")).alias("found"))
    pairs = near_pairs(met.where("exact is null and found is null").select("name", "key"), known.select("canonical", F.col("key").alias("other")), least)
    scored = pairs.withColumn("score", N.ratio(F.col("key"), F.col("other"))).where(F.col("score") >= least)
    best = scored.groupBy("name").agg(F.min_by("canonical", F.struct(-F.col("score"), F.col("canonical"))).alias("best"))
    out = met.join(best, "name", "left")
    one = F.when(F.size("found") == 1, F.get("found", F.lit(0)))
    status = F.when(F.col("exact").isNotNull(), "exact").when(F.size("found") > 1, "ambiguous").when(F.coalesce(one, "best").isNotNull(), "fuzzy").otherwise("new")
    return out.select("name", F.coalesce("exact", one, "best").alias("canonical"), status.alias("status"), F.coalesce("found", F.array().cast("array<string>")).alias("candidates"))


def _grams(df: DataFrame, name: str, key: str) -> DataFrame:
    """df with `grams`: the key's pairs of letters, each numbered by how often it stood before in the key."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(key) - 1, F.lit(1))), lambda i: F.substring(F.col(key), i, F.lit(2)))
    each = df.select(name, key, F.posexplode(F.when(F.char_length(key) > 1, pairs).otherwise(F.array())).alias("at", "gram"))
    nth = F.row_number().over(Window.partitionBy(name, key, "gram").orderBy("at"))
    return each.select(name, key, F.concat_ws("\u0001", "gram", nth.cast("string")).alias("gram"))


def least_shared(a: Column, b: Column, least: float) -> Column:
    """How many pairs of letters two strings of lengths a and b share at least if their matching-blocks ratio is `least`.

    Of M matched letters in k blocks M - k pairs lie inside blocks, k is 1 + (a - M) + (b - M) at most, and M is at least
    least * (a + b) / 2.
    """
    return F.ceil((1.5 * least - 1) * (a + b) - 1 - 1e-9).cast("int")


def near_pairs(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(name, key, canonical, other): all pairs of asked (name, key) and known (canonical, other) whose ratio may be `least`.

    An index of pairs of letters: a key is met by its rarest ones only, as many as are left when all but the fewest that it
    must share are put aside; lengths and the number of shared pairs are asked before the ratio is. Keys too short for the
    bound to promise one shared pair meet by length. With `least` of 2/3 or below nothing is promised, and all meet so.
    """
    share = least / (2 - least)
    few = lambda c: least_shared(F.char_length(c), F.ceil(F.char_length(c) * share - 1e-9), least)
    fits = (F.char_length("other") >= F.char_length("key") * share - 1e-9) & (F.char_length("key") >= F.char_length("other") * share - 1e-9)
    mine, theirs = _grams(asked, "name", "key"), _grams(known, "canonical", "other")
    seen = theirs.groupBy("gram").agg(F.count(F.lit(1)).alias("seen"))

    def indexed(grams: DataFrame, name: str, key: str) -> DataFrame:
        ranked = grams.join(seen, "gram", "left").groupBy(name, key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "gram"))).alias("g"))
        return ranked.select(name, key, F.col("g.gram").alias(f"{name}_grams")).where(few(key) >= 1)

    def entries(table: DataFrame, name: str, key: str) -> DataFrame:
        grams = F.col(f"{name}_grams")
        return table.withColumn("gram", F.explode(F.slice(grams, F.lit(1), F.greatest(F.size(grams) - few(key) + 1, F.lit(0)))))

    a, b = indexed(mine, "name", "key"), indexed(theirs, "canonical", "other")
    met = entries(a, "name", "key").join(entries(b, "canonical", "other"), "gram").where(fits).drop("gram").distinct()
    enough = F.size(F.array_intersect("name_grams", "canonical_grams")) >= least_shared(F.char_length("key"), F.char_length("other"), least)
    long = met.where(enough).select("name", "key", "canonical", "other")
    # A short key meets keys of any length that the ratio allows, whichever side it is on.
    sized = lambda mine, theirs: mine.withColumn("size", F.explode(N.length_window(F.char_length("key"), least))).join(theirs.withColumn("size", F.char_length("other")), "size")
    short = sized(asked.where(few("key") < 1), known).unionByName(sized(asked.where(few("key") >= 1), known.where(few("other") < 1)))
    return long.unionByName(short.select("name", "key", "canonical", "other"))


def one_to_one(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id) of rows (id, scope, title, author) of both sides with the same scope and title, new_id null where none is left.

    A title that the new side has once takes every old row. Among repeated ones each old row, by id, takes the first free row
    of its author, else the first free row. Groups are the copies of one title in one scope, so each fits a task; they are
    rows of arrays, many of which a Python function takes at a time.
    """
    def keyed(df: DataFrame, side: str) -> DataFrame:
        return df.select("scope", F.lower(F.trim("title")).alias("title"), F.struct(F.col("id").cast("long").alias("id"), F.lower(F.trim(F.coalesce("author", F.lit("")))).alias("author")).alias(side))

    def decide(authors: list[str], free_ids: list[int], free_authors: list[str]) -> list[int | None]:
        free = dict(zip(free_ids, free_authors, strict=True))
        by_author: dict[str, deque[int]] = {}
        for i, author in free.items():
            by_author.setdefault(author, deque()).append(i)
        rest, out = deque(free), []
        for author in authors:
            # A row is in two queues; where one gave it, the other passes over it.
            own = by_author.get(author, ())
            while own and own[0] not in free:
                own.popleft()
            while rest and rest[0] not in free:
                rest.popleft()
            got = own[0] if own else rest[0] if rest else None
            free.pop(got, None)
            out.append(got)
        return out

    @F.pandas_udf("array<long>")
    def decided(authors: pd.Series, free_ids: pd.Series, free_authors: pd.Series) -> pd.Series:
        return pd.Series([decide(*row) for row in zip(authors, free_ids, free_authors, strict=True)], dtype=object)

    sides = keyed(old, "old").withColumn("new", F.lit(None)).unionByName(keyed(new, "new").withColumn("old", F.lit(None)))
    groups = sides.groupBy("scope", "title").agg(F.sort_array(F.collect_list("old")).alias("old"), F.sort_array(F.collect_list("new")).alias("new")).where("size(old) > 0")
    # One row of the new side, or none, needs no choice.
    once = F.size(F.array_distinct("new.id")) <= 1
    plain = groups.where(once).select(F.explode("old.id").alias("old_id"), F.get("new.id", F.lit(0)).alias("new_id"))
    chosen = groups.where(~once).select("old.id", decided("old.author", "new.id", "new.author").alias("got"))
    return plain.unionByName(chosen.select(F.explode(F.arrays_zip(F.col("id").alias("id"), "got")).alias("x")).select(F.col("x.id").alias("old_id"), F.col("x.got").alias("new_id")))


def contained(left: DataFrame, right: DataFrame, scope: str, text: str = "text") -> DataFrame:
    """(left id, right id, scope) where one text holds the other, neither empty; only within a scope, by an equi-join."""
    a = left.where(F.col(text) != "").select(scope, F.col("id").alias("left_id"), F.col(text).alias("__a"))
    b = right.where(F.col(text) != "").select(scope, F.col("id").alias("right_id"), F.col(text).alias("__b"))
    return a.join(b, scope).where(F.contains("__a", F.col("__b")) | F.contains("__b", F.col("__a"))).select("left_id", "right_id", scope)


def prefix_verified(left: DataFrame, right: DataFrame, keys: list[str], text: str, most: int = 20) -> DataFrame:
    """Left rows with the right's other columns by keys, kept only if the texts begin alike or one is empty; of equal right keys the largest text."""
    one = right.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in right.columns if c not in keys]), text).alias("__r"))
    begin = lambda c: F.coalesce(F.substring(c, 1, most), F.lit(""))
    met = left.join(one, keys).withColumn("__t", F.col(f"__r.{text}"))
    ok = (begin(text) == begin("__t")) | (begin(text) == "") | (begin("__t") == "")
    return met.where(ok).select(*left.columns, *[F.col(f"__r.{c}").alias(c) for c in right.columns if c not in keys and c != text])
