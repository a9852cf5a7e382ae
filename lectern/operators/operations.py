"""Operators of running a site: composed filters, fallbacks, status rules, pick orders, syncs, verifiers, cascades and serving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.rows import hashed_sample, top_k

# ------------------------------------------------------------------------------------------------ filters and columns


def composed(df: DataFrame, equal: dict[str, object] | None = None, contains: dict[str, str] | None = None, column: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows that meet every condition given; an empty or missing value sets none. since and until are days, both included."""
    for name, value in (equal or {}).items():
        df = df.where(F.col(name) == value) if value not in (None, "") else df
    for name, part in (contains or {}).items():
        df = df.where(F.contains(F.col(name), F.lit(part))) if part else df
    if column and since:
        df = df.where(F.col(column) >= F.lit(f"{since} 00:00:00").cast("timestamp"))
    if column and until:
        df = df.where(F.col(column) <= F.lit(f"{until} 23:59:59").cast("timestamp"))
    return df


def allowed_order(asked: str | None, direction: str | None, allowed: Sequence[str]) -> Column:
    """Order by the asked column if it is allowed, else by the first allowed one; descending unless ASC is asked for."""
    name = asked if asked in allowed else allowed[0]
    return F.asc(name) if (direction or "").upper() == "ASC" else F.desc(name)


def in_locale(settings: DataFrame, key: str, locale: str, value: str, preferred: str = "en") -> DataFrame:
    """(key, value): the value in the preferred locale, else the smallest in any; one row a key."""
    best = F.coalesce(F.max(F.when(F.col(locale) == preferred, F.col(value))), F.min(value))
    return settings.groupBy(key).agg(best.alias(value))


def error_category(code: Column) -> Column:
    """What a server says of a status: permanent, retryable, noop, or null."""
    return F.when(code == 404, "noop").when((code >= 400) & (code < 500) & (code != 429), "permanent").when(code.isin(429, 500, 502, 503), "retryable")


def retryable(code: Column) -> Column:
    """What a client may try again: no answer at all, 429, or any server error."""
    return (code == 0) | (code == 429) | ((code >= 500) & (code < 600))


def adaptive_delay(ms: Column, code: Column, success: Column, retry_after: Column) -> Column:
    """Milliseconds to wait before the next request; the first rule that holds."""
    asked = F.coalesce(F.when(retry_after > 0, retry_after), F.lit(5)) * 1000
    return F.when(code == 429, asked).when((code == 0) | (code >= 500), 5000).when(~success | (ms < 200), 0).when(ms < 500, 100).otherwise(F.floor(ms)).cast("long")


def cost_estimate(items: DataFrame, pages: str, done: Column, tokens_in: int, tokens_out: int, price_in: float, price_out: float) -> DataFrame:
    """One row: items, those done already, pages to process, tokens and cost (prices are for a million tokens)."""
    open_pages = F.coalesce(F.sum(F.when(~done, F.col(pages))), F.lit(0)).cast("long")
    out = items.agg(F.count(F.lit(1)).alias("items"), F.count_if(done).alias("skipped"), open_pages.alias("pages"))
    return out.withColumns({"to_process": F.col("items") - F.col("skipped"), "tokens_in": F.col("pages") * tokens_in, "tokens_out": F.col("pages") * tokens_out}).withColumn("cost", F.col("tokens_in") / 1e6 * price_in + F.col("tokens_out") / 1e6 * price_out)


def progress(counts: DataFrame, total: str, remaining: str, seconds: str) -> DataFrame:
    """counts with rate (items a minute) and eta (minutes), null before anything was processed or time passed."""
    done = F.col(total) - F.col(remaining)
    moving = (F.col(seconds) > 0) & (done > 0)
    rate = F.when(moving, F.round(done / (F.col(seconds) / 60), 1))
    eta = F.when(moving, F.round(F.round(F.col(remaining) / (done / F.col(seconds)), 0) / 60, 1))
    return counts.withColumns({"rate": rate, "eta": eta})


def registry_stats(registry: DataFrame, variants: str, articles: str) -> DataFrame:
    """One row: names, names with variants, all variants, all articles."""
    n = F.coalesce(F.size(F.col(variants)), F.lit(0))
    n = F.greatest(n, F.lit(0))
    return registry.agg(F.count(F.lit(1)).alias("authors"), F.count_if(n > 0).alias("with_variants"), F.coalesce(F.sum(n.cast("long")), F.lit(0)).alias("total_variants"), F.coalesce(F.sum(F.coalesce(F.col(articles), F.lit(0)).cast("long")), F.lit(0)).alias("total_articles"))


# ------------------------------------------------------------------------------------------------ joins, picks and sets


def within_first(df: DataFrame, parents: DataFrame, key: str, n: int) -> DataFrame:
    """Rows whose key is among the first n parents in order of it (n a small constant, so they go to every task)."""
    return df.join(F.broadcast(parents.select(key).distinct().orderBy(key).limit(n)), key, "left_semi")


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row a key: the last in the given order, as in a lookup that is filled row by row."""
    return top_k(rows, list(keys), [(F.col(o) if isinstance(o, str) else o).desc_nulls_last() for o in order], 1)


def priority_pick(sources: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """At most one row (key, reason): from the first source that has any, the one with the smallest hash of its key."""
    parts = [df.select(key).distinct().select(key, F.lit(reason).alias("reason"), F.lit(k).alias("__at")) for k, (reason, df) in enumerate(sources)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.orderBy("__at", F.xxhash64(key), key).limit(1).select(key, "reason")


def sync_plan(source: DataFrame, dest: DataFrame, known: DataFrame, fingerprint: Sequence[str], key: str) -> DataFrame:
    """source rows with status: `skipped` if dest has the fingerprint, `not_found` if its key isn't known there, else `insert`."""
    there = dest.select(*fingerprint).distinct().withColumn("__there", F.lit(True))
    ids = known.select(key).distinct().withColumn("__known", F.lit(True))
    status = F.when(F.col("__there"), "skipped").when(F.col("__known").isNull(), "not_found").otherwise("insert")
    return source.join(there, list(fingerprint), "left").join(ids, key, "left").withColumn("status", status).drop("__there", "__known")


def unseen(rows: DataFrame, seen: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key wasn't seen before, each key once (its first row)."""
    return top_k(rows.join(seen.select(key).distinct(), key, "left_anti"), [key], [F.asc(order)], 1)


def to_enqueue(wanted: DataFrame, pending: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs that aren't pending already, each once."""
    return wanted.dropDuplicates(list(keys)).join(pending.select(*keys).distinct(), list(keys), "left_anti")


def superseded(changes: DataFrame, current: DataFrame, key: str, wanted: str, present: str) -> DataFrame:
    """changes with superseded: whether the present value (compared in lower case) is another one by now; false for an unknown key."""
    now = current.select(key, F.col(present).alias("__now"))
    return changes.join(now, key, "left").withColumn("superseded", F.coalesce(F.lower("__now") != F.col(wanted), F.lit(False))).drop("__now")


def remap_plan(ids: DataFrame, old: str, new: str) -> DataFrame:
    """ids that change, with direct: whether the new id is free of all old ones. Others need a first pass to `parked` ids beyond all in use."""
    used = ids.select(F.col(old).alias(new)).distinct().withColumn("__used", F.lit(True))
    top = ids.agg(F.greatest(F.max(old), F.max(new)).alias("__top"))
    moved = ids.where(F.col(old) != F.col(new)).join(used, new, "left").crossJoin(F.broadcast(top))
    return moved.select(old, new, F.col("__used").isNull().alias("direct"), F.when(F.col("__used"), F.col("__top") + 1 + F.col(old)).alias("parked"))


#: Rows of one task of a cascade, so that its memory doesn't grow with the tables.
ROWS_A_TASK = 500_000


def cascade(tables: dict[str, DataFrame], doomed: DataFrame, links: Sequence[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """What is left of each table when the doomed rows of the first link's parent go, and all that hangs on what goes.

    links are (parent, parent key, child, child key), parents first; doomed has the first parent's key.
    """
    parts = {name: -(-df.count() // ROWS_A_TASK) for name, df in tables.items()}

    def dealt(df: DataFrame, name: str, key: str) -> DataFrame:
        # Partitions of narrow rows are coalesced by bytes to many millions of rows; a stated number stays.
        return df.repartition(max(parts[name], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key) if parts[name] > 1 else df

    gone = {links[0][0]: doomed}
    for parent, pk, child, ck in links:
        # A semi join asks for no distinct keys, which would all be held.
        lost = dealt(tables[child], child, ck).join(dealt(gone[parent].select(F.col(pk).alias(ck)), child, ck), ck, "left_semi")
        gone[child] = gone[child].unionByName(lost) if child in gone else lost
    keys = {links[0][0]: links[0][1]} | {c: ck for _, _, c, ck in links}
    return {name: dealt(df, name, keys[name]).join(dealt(gone[name].select(keys[name]), name, keys[name]), keys[name], "left_anti") if name in gone else df for name, df in tables.items()}


def fresh_inserts(wanted: DataFrame, existing: DataFrame, key: str, rows_a_chunk: int = 100) -> DataFrame:
    """Rows whose key has none yet, with the chunk that they are sent in; chunks are dealt by hash, of about that many rows."""
    new = wanted.join(existing.select(key).distinct(), key, "left_anti")
    n = F.broadcast(new.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows_a_chunk)).alias("__n")))
    return new.crossJoin(n).withColumn("chunk", F.pmod(F.xxhash64(key), F.col("__n"))).drop("__n")


def key_map(natural: DataFrame, stored: DataFrame, keys: Sequence[str], new_id: str) -> DataFrame:
    """The id that each natural key was stored under; the smallest where several were."""
    return natural.join(stored.groupBy(*keys).agg(F.min(new_id).alias(new_id)), list(keys))


def same_author(articles: DataFrame, item: str, author: str, order: str, k: int = 6) -> DataFrame:
    """(item, other, rank): up to k newest other items of the same author.

    An author's items are ranked once; each item looks at the first k + 1 only, so no author's pairs are made.
    """
    own = articles.select(item, author, order).dropDuplicates([item, author])
    best = top_k(own, [author], [F.desc(order), F.asc(item)], k + 1).select(author, F.col(item).alias("other"), F.col(order).alias("__at"))
    pairs = own.select(item, author).join(best, author).where(F.col(item) != F.col("other")).dropDuplicates([item, "other"])
    w = Window.partitionBy(item).orderBy(F.desc("__at"), "other")
    return pairs.select(item, "other", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


# ------------------------------------------------------------------------------------------------ audits


def checks(found: Sequence[tuple[str, Column, Column]]) -> Column:
    """Array of (name, status, detail) structs, PASS or FAIL; explode it for a table of checks."""
    return F.array(*[F.struct(F.lit(name).alias("name"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("status"), detail.cast("string").alias("detail")) for name, ok, detail in found])


def verified_issue(expected: DataFrame, actual: DataFrame, group: str, title: str, fields: Sequence[str]) -> DataFrame:
    """(group, name, status, detail): article count, titles matched and each field's agreement, for every group.

    Titles are compared trimmed and in lower case; a repeated actual title stands once, with its smallest fields.
    """
    key = F.lower(F.trim(F.col(title)))
    have = actual.groupBy(group, key.alias("__t")).agg(*[F.min(f).alias(f"__{f}") for f in fields], F.count(F.lit(1)).alias("__n"))
    both = expected.withColumn("__t", key).join(have, [group, "__t"], "left")
    summed = both.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count("__n").alias("matched"), *[F.count_if(F.col("__n").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"__{f}"))).alias(f"bad_{f}") for f in fields])
    total = summed.join(actual.groupBy(group).agg(F.count(F.lit(1)).alias("got")), group, "left").withColumn("got", F.coalesce("got", F.lit(0)))
    said = [("Article count", F.col("got") == F.col("n"), F.concat(F.lit("expected="), "n", F.lit(", got="), "got")), ("Titles matched", F.col("matched") == F.col("n"), F.concat_ws("/", "matched", "n"))]
    said += [(f"{f} match", F.col(f"bad_{f}") == 0, F.concat(F.col(f"bad_{f}"), F.lit(" differ"))) for f in fields]
    return total.select(group, F.explode(checks(said)).alias("c")).select(group, "c.*")


def queue_audit(jobs: DataFrame, failed: Column, payload: str, benign: str, most: int = 50) -> DataFrame:
    """One row: pending, critical and benign failures, and the level of each (FAIL, WARN or PASS)."""
    kind = F.contains(F.col(payload), F.lit(benign))
    n = jobs.agg(F.count_if(~failed).alias("pending"), F.count_if(failed & ~kind).alias("critical"), F.count_if(failed & kind).alias("benign"))
    level = lambda bad, word: F.when(bad, word).otherwise("PASS")
    return n.select("*", level(F.col("pending") > most, "FAIL").alias("pending_level"), level(F.col("critical") > 0, "FAIL").alias("critical_level"), level(F.col("benign") > 0, "WARN").alias("benign_level"))


def mint_candidates(items: DataFrame, key: str, has_id: Column, registered: Column, forced: object = None) -> DataFrame:
    """(key, action): `mint` without an identifier, `deposit` with one that isn't registered or is forced; others are left out."""
    force = F.lit(False) if forced is None else F.col(key) == forced
    return items.select(key, F.when(~has_id, "mint").when(~registered | force, "deposit").alias("action")).where("action is not null")


def probe_summary(items: DataFrame, key: str, n: int, status: str, seconds: str, slow: float = 5.0) -> DataFrame:
    """One row over a sample of n: probed, slow (no answer in time), missing (another status than 200), level."""
    part = hashed_sample(items, key, n)
    late = F.col(seconds) > slow
    out = part.agg(F.count(F.lit(1)).alias("probed"), F.count_if(late).alias("slow"), F.count_if(~late & (F.col(status) != 200)).alias("missing"))
    return out.withColumn("level", F.when((F.col("slow") > 0) | (F.col("missing") > 0), "FAIL").otherwise("PASS"))


def open_sample(items: DataFrame, key: str, excluded: Column, n: int) -> DataFrame:
    """A sample of n rows outside a class; the class is left out before the sample, so n remain where there are so many."""
    return hashed_sample(items.where(~F.coalesce(excluded, F.lit(False))), key, n)


# ------------------------------------------------------------------------------------------------ serving


def enough(texts: DataFrame, text: str, least: int = 2) -> DataFrame:
    """texts itself; raises if fewer than `least` rows hold any text, as weights over a smaller corpus mean nothing."""
    found = texts.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").limit(least).count()
    if found < least:
        raise ValueError(f"only {found} rows with text, {least} needed")
    return texts


def served(ranked: DataFrame, published: DataFrame, src: str = "src", dst: str = "dst", k: int = 5) -> DataFrame:
    """(src, served, dropped): the first k stored neighbours in order of rank that are still published, and those that aren't."""
    ids = published.select(dst).distinct().withColumn("__there", F.lit(True))
    rows = ranked.where(F.col("rank") <= k).join(ids, dst, "left").select(src, F.struct("rank", dst).alias("s"), F.col("__there").isNotNull().alias("there"))
    listed = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.col("s")))), lambda s: s[dst])
    return rows.groupBy(src).agg(listed(F.col("there")).alias("served"), listed(~F.col("there")).alias("dropped"))


def affected_by(ranked: DataFrame, changed: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Sources whose stored neighbours hold a changed item, and the changed items themselves: what must be built again."""
    hit = ranked.join(changed.select(F.col(dst)).distinct(), dst, "left_semi").select(src)
    return hit.union(changed.select(F.col(dst).alias(src))).distinct()
