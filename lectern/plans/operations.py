"""Queries of running a site: filters, fallbacks, status rules, picks, syncs, audits, serving; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import operations as P
from lectern.operators import rows as O
from lectern.operators import similarity as V
from lectern.plans.catalog import COSINE, query
from lectern.streaming import rechecks


@query("composed_filters", "SELECT event_id FROM events WHERE event_type = 'click' AND contains(props, '\"k\": 6') AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-12 23:59:59'")
def _(t):
    return P.composed(t("events"), equal={"event_type": "click", "user_id": None}, contains={"props": '"k": 6'}, column="ts", since="2024-01-03", until="2024-01-12").select("event_id")


@query("allowed_order", "SELECT event_id, event_type FROM events ORDER BY event_type ASC, event_id LIMIT 40")
def _(t):
    return t("events").orderBy(P.allowed_order("event_type", "asc", ("ts", "event_type", "value")), "event_id").select("event_id", "event_type").limit(40)


@query("fallback_order", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 40")
def _(t):
    return t("events").orderBy(P.allowed_order("ts; drop table", None, ("ts", "event_type")), "event_id").select("event_id").limit(40)


@query("locale_fallback", "SELECT source, coalesce(max(CASE WHEN lang = 'en' THEN text END), min(text)) AS text FROM (SELECT source, lang, CAST(n_chars AS VARCHAR) AS text FROM documents WHERE doc_id % 7 < 2 OR lang <> 'en') GROUP BY source")
def _(t):
    d = t("documents").where("doc_id % 7 < 2 or lang != 'en'").select("source", "lang", F.col("n_chars").cast("string").alias("text"))
    return P.in_locale(d, "source", "lang", "text")


CODES = "(SELECT event_id, CAST([0, 200, 301, 400, 404, 409, 429, 500, 502, 503, 504, 599][1 + event_id % 12] AS INTEGER) AS code, value * 10 AS ms, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 9 AS INTEGER) END AS retry FROM events)"


def _codes(t):
    code = F.element_at(F.array(*[F.lit(c) for c in (0, 200, 301, 400, 404, 409, 429, 500, 502, 503, 504, 599)]), (F.col("event_id") % 12 + 1).cast("int"))
    return t("events").select("event_id", code.alias("code"), (F.col("value") * 10).alias("ms"), F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 9).cast("int")).alias("retry"))


@query("error_categories", f"""SELECT event_id, CASE WHEN code BETWEEN 400 AND 499 AND code NOT IN (404, 429) THEN 'permanent' WHEN code IN (429, 500, 502, 503) THEN 'retryable' WHEN code = 404 THEN 'noop' END AS server,
 code = 0 OR code = 429 OR code BETWEEN 500 AND 599 AS client FROM {CODES}""")
def _(t):
    return _codes(t).select("event_id", P.error_category(F.col("code")).alias("server"), P.retryable(F.col("code")).alias("client"))


@query("adaptive_delays", f"""SELECT event_id, CAST(CASE WHEN code = 429 THEN 1000 * CASE WHEN coalesce(retry, 0) > 0 THEN retry ELSE 5 END WHEN code = 0 OR code >= 500 THEN 5000 WHEN code >= 400 THEN 0 WHEN ms < 200 THEN 0 WHEN ms < 500 THEN 100 ELSE floor(ms) END AS BIGINT) AS delay FROM {CODES}""")
def _(t):
    return _codes(t).select("event_id", P.adaptive_delay(F.col("ms"), F.col("code"), F.col("code") < 400, F.col("retry")).alias("delay"))


@query("cost_estimate", """SELECT count(*) AS items, count(*) FILTER (lang = 'de') AS skipped, CAST(sum(CASE WHEN lang <> 'de' THEN n_chars ELSE 0 END) AS BIGINT) AS pages, count(*) FILTER (lang <> 'de') AS to_process,
 CAST(sum(CASE WHEN lang <> 'de' THEN n_chars ELSE 0 END) AS BIGINT) * 1500 AS tokens_in, CAST(sum(CASE WHEN lang <> 'de' THEN n_chars ELSE 0 END) AS BIGINT) * 2000 AS tokens_out,
 round(sum(CASE WHEN lang <> 'de' THEN n_chars ELSE 0 END) * (1500 / 1e6 * 0.8 + 2000 / 1e6 * 4.0), 2) AS cost FROM documents""")
def _(t):
    return P.cost_estimate(t("documents"), "n_chars", F.col("lang") == "de", 1500, 2000, 0.8, 4.0).withColumn("cost", F.round("cost", 2))


@query("queue_progress", """WITH q AS (SELECT event_type, count(*) AS total, count(*) FILTER (value < 20) AS remaining, CAST(date_diff('second', min(ts), max(ts)) AS BIGINT) AS seconds FROM events GROUP BY 1)
 SELECT *, CASE WHEN seconds > 0 AND total > remaining THEN round((total - remaining) / (seconds / 60), 1) END AS rate,
 CASE WHEN seconds > 0 AND total > remaining THEN round(round(remaining / ((total - remaining) / seconds), 0) / 60, 1) END AS eta FROM q""")
def _(t):
    q = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") < 20).alias("remaining"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))
    return P.progress(q, "total", "remaining", "seconds")


@query("table_megabytes", "SELECT source, round(sum(n_chars) / 1024 / 1024, 1) AS mb FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy("source").agg(F.round(F.sum("n_chars") / 1024 / 1024, 1).alias("mb"))


@query("registry_stats", """WITH r AS (SELECT o_custkey, count(*) AS articles, count(DISTINCT o_orderpriority) FILTER (o_orderpriority <> '5-LOW') AS v FROM orders GROUP BY 1)
 SELECT count(*) AS authors, count(*) FILTER (v > 0) AS with_variants, CAST(sum(v) AS BIGINT) AS total_variants, CAST(sum(articles) AS BIGINT) AS total_articles FROM r""")
def _(t):
    r = t("orders").groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))).alias("variants"), F.count(F.lit(1)).alias("articles"))
    return P.registry_stats(r, "variants", "articles")


# ------------------------------------------------------------------------------------------------ joins, picks, sets


@query("within_first", "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 200) GROUP BY 1 HAVING count(*) >= 2")
def _(t):
    first = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return P.within_first(t("lineitem"), first, "l_orderkey", 200).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("last_wins_lookup", """WITH l AS (SELECT lower(trim(p_name)) AS title, p_size, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY lower(trim(p_name)), p_size ORDER BY p_partkey DESC) = 1)
 SELECT x.p_partkey, l.p_partkey AS found FROM part x LEFT JOIN l ON lower(trim(x.p_name)) = l.title AND x.p_size + 1 = l.p_size""")
def _(t):
    p = t("part").select("p_partkey", F.lower(F.trim("p_name")).alias("title"), "p_size")
    lookup = P.last_wins(p, ["title", "p_size"], ["p_partkey"]).select("title", (F.col("p_size") - 1).alias("p_size"), F.col("p_partkey").alias("found"))
    return p.join(lookup, ["title", "p_size"], "left").select("p_partkey", "found")


@query("numeric_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INTEGER), o_orderkey) AS place FROM orders ORDER BY place LIMIT 100")
def _(t):
    ranked = t("orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("seq")).orderBy("seq", "o_orderkey").limit(100)
    return ranked.groupBy().agg(F.array_sort(F.collect_list(F.struct("seq", "o_orderkey"))).alias("r")).select(F.posexplode("r").alias("pos", "r")).select("r.o_orderkey", (F.col("pos") + 1).cast("long").alias("place"))


@query("notes_by_number", """SELECT turn, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(CASE WHEN turn % 3 <> 0 THEN 9 - turn END, 1000000), turn) AS place FROM conversations""")
def _(t):

    note = t("conversations").withColumn("number", F.when(F.col("turn") % 3 != 0, 9 - F.col("turn")))
    return note.select("turn", "conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("number").asc_nulls_last(), "turn")).cast("long").alias("place"))


@query("priority_pick")
def _(t):
    e = t("events")
    return P.priority_pick([("needs_fix", e.where("event_type = 'error' and value > 50").select("user_id")), ("unreviewed", t("customer").select(F.col("c_custkey").alias("user_id")).join(e.select("user_id"), "user_id", "left_anti")), ("any", e.select("user_id"))], "user_id")


SIDES = "s AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day FROM events WHERE event_id % 3 <> 0), d AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day FROM events WHERE event_id % 3 <> 1)"


@query("two_way_sync", f"""WITH {SIDES}, k AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0),
 r AS (SELECT 'out' AS way, s.*, CASE WHEN (user_id, event_type, day) IN (SELECT (user_id, event_type, day) FROM d) THEN 'skipped' WHEN user_id NOT IN (SELECT c_custkey FROM k) THEN 'not_found' ELSE 'insert' END AS status FROM s
  UNION ALL SELECT 'back', d.*, CASE WHEN (user_id, event_type, day) IN (SELECT (user_id, event_type, day) FROM s) THEN 'skipped' WHEN user_id NOT IN (SELECT c_custkey FROM k) THEN 'not_found' ELSE 'insert' END FROM d)
 SELECT way, status, count(*) AS n FROM r GROUP BY ALL""")
def _(t):
    side = lambda cond: t("events").where(cond).select("user_id", "event_type", F.col("ts").cast("date").alias("day"))
    s, d, known = side("event_id % 3 != 0"), side("event_id % 3 != 1"), t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    plan = lambda way, a, b: P.sync_plan(a, b, known, ["user_id", "event_type", "day"], "user_id").select(F.lit(way).alias("way"), "status")
    return plan("out", s, d).union(plan("back", d, s)).groupBy("way", "status").agg(F.count(F.lit(1)).alias("n"))


@query("unseen_rows", "SELECT user_id, event_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 95) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def _(t):
    e = t("events")
    return P.unseen(e.where("event_type = 'click'"), e.where("event_type = 'error' and value > 95"), "user_id", "event_id").select("user_id", "event_id")


@query("to_enqueue", "SELECT DISTINCT user_id, event_type FROM events WHERE value > 30 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE value < 1)")
def _(t):
    return P.to_enqueue(t("events").where("value > 30").select("user_id", "event_type"), t("events").where("value < 1"), ["user_id", "event_type"])


@query("superseded_changes", "SELECT o_orderkey, coalesce(lower(c_mktsegment) <> CASE WHEN o_orderkey % 2 = 0 THEN 'building' ELSE lower(c_mktsegment) END, false) AS superseded FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def _(t):
    c = t("customer")
    asked = t("orders").join(c.select(F.col("c_custkey").alias("o_custkey"), F.lower("c_mktsegment").alias("own")), "o_custkey", "left").withColumn("wanted", F.when(F.col("o_orderkey") % 2 == 0, "building").otherwise(F.col("own")))
    return P.superseded(asked, c.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "wanted", "c_mktsegment").select("o_orderkey", "superseded")


@query("remap_plan", """WITH m AS (SELECT c_custkey AS old, CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 1 WHEN c_custkey % 4 = 1 THEN c_custkey - 1 WHEN c_custkey % 4 = 2 THEN c_custkey + 100000 ELSE c_custkey END AS new FROM customer)
 SELECT old, new, new NOT IN (SELECT old FROM m) AS direct, CASE WHEN new IN (SELECT old FROM m) THEN (SELECT greatest(max(old), max(new)) FROM m) + 1 + old END AS parked FROM m WHERE old <> new""")
def _(t):
    k = F.col("c_custkey")
    new = F.when(k % 4 == 0, k + 1).when(k % 4 == 1, k - 1).when(k % 4 == 2, k + 100000).otherwise(k)
    return P.remap_plan(t("customer").select(k.alias("old"), new.alias("new")), "old", "new")


@query("cascade_left", """WITH g AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM g))
 SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM g) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM g)
 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)""")
def _(t):
    tables = {n: t(n) for n in ("customer", "orders", "lineitem")}
    left = P.cascade(tables, t("customer").where("c_mktsegment = 'BUILDING'"), [("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")])
    counts = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, df in left.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query("fresh_inserts", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(t):
    return P.fresh_inserts(t("customer").where("c_acctbal > 0"), t("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("key_map", "SELECT n_name, min(c_custkey) AS c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def _(t):
    return P.key_map(t("nation").select("n_name", F.col("n_nationkey").alias("k")), t("customer").select(F.col("c_nationkey").alias("k"), "c_custkey"), ["k"], "c_custkey").select("n_name", "c_custkey")


@query("same_author", """WITH o AS (SELECT DISTINCT l_orderkey AS item, l_suppkey AS author FROM lineitem WHERE l_linenumber <= 2), p AS (SELECT DISTINCT a.item, b.item AS other FROM o a JOIN o b ON a.author = b.author AND a.item <> b.item)
 SELECT item, other, CAST(row_number() OVER (PARTITION BY item ORDER BY other DESC) AS INTEGER) AS rank FROM p QUALIFY rank <= 6""")
def _(t):
    o = t("lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("author"), F.col("l_orderkey").alias("made"))
    return P.same_author(o, "item", "author", "made")


# ------------------------------------------------------------------------------------------------ audits


@query("issue_verifier", """WITH e AS (SELECT o_custkey AS issue, CAST(o_orderkey AS VARCHAR) AS title, o_orderstatus AS section FROM orders WHERE o_orderkey % 10 <> 3),
 a AS (SELECT o_custkey AS issue, CAST(o_orderkey AS VARCHAR) AS title, CASE WHEN o_orderkey % 50 = 1 THEN 'X' ELSE o_orderstatus END AS section FROM orders WHERE o_orderkey % 11 <> 5),
 s AS (SELECT e.issue, count(*) AS n, count(a.title) AS m, count(*) FILTER (a.title IS NOT NULL AND e.section <> a.section) AS b FROM e LEFT JOIN a ON e.issue = a.issue AND e.title = a.title GROUP BY 1),
 g AS (SELECT issue, count(*) AS got FROM a GROUP BY 1), x AS (SELECT s.*, coalesce(got, 0) AS got FROM s LEFT JOIN g USING (issue))
 SELECT issue, 'Article count' AS name, CASE WHEN got = n THEN 'PASS' ELSE 'FAIL' END AS status, 'expected=' || n || ', got=' || got AS detail FROM x
 UNION ALL SELECT issue, 'Titles matched', CASE WHEN m = n THEN 'PASS' ELSE 'FAIL' END, m || '/' || n FROM x UNION ALL SELECT issue, 'section match', CASE WHEN b = 0 THEN 'PASS' ELSE 'FAIL' END, b || ' differ' FROM x""")
def _(t):
    base = t("orders").select(F.col("o_custkey").alias("issue"), F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderstatus").alias("section"), "o_orderkey")
    got = base.where("o_orderkey % 11 != 5").withColumn("section", F.when(F.col("o_orderkey") % 50 == 1, "X").otherwise(F.col("section")))
    return P.verified_issue(base.where("o_orderkey % 10 != 3").drop("o_orderkey"), got.drop("o_orderkey"), "issue", "title", ["section"])


@query("queue_audit", """SELECT count(*) FILTER (event_type <> 'error') AS pending, count(*) FILTER (event_type = 'error' AND NOT contains(props, '7')) AS critical, count(*) FILTER (event_type = 'error' AND contains(props, '7')) AS benign,
 CASE WHEN count(*) FILTER (event_type <> 'error') > 50 THEN 'FAIL' ELSE 'PASS' END AS pending_level, CASE WHEN count(*) FILTER (event_type = 'error' AND NOT contains(props, '7')) > 0 THEN 'FAIL' ELSE 'PASS' END AS critical_level,
 CASE WHEN count(*) FILTER (event_type = 'error' AND contains(props, '7')) > 0 THEN 'WARN' ELSE 'PASS' END AS benign_level FROM events""")
def _(t):
    return P.queue_audit(t("events"), F.col("event_type") == "error", "props", "7")


@query("mint_candidates", "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'mint' ELSE 'deposit' END AS action FROM orders WHERE o_orderpriority = '5-LOW' OR o_orderstatus <> 'F' OR o_orderkey = 33")
def _(t):
    return P.mint_candidates(t("orders"), "o_orderkey", F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus") == "F", 33)


@query("probe_summary")
def _(t):
    return P.probe_summary(_codes(t).withColumn("seconds", F.col("ms") / 100), "event_id", 10, "code", "seconds")


@query("open_sample")
def _(t):
    return P.open_sample(t("documents").select("doc_id", "lang"), "doc_id", F.col("lang") == "de", 50)


@query("facet_order", """SELECT 'source' AS facet, source AS value, n, row_number() OVER (ORDER BY n DESC, source) AS place FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)
 UNION ALL SELECT 'lang', lang, n, row_number() OVER (ORDER BY n DESC, lang) FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)""")
def _(t):
    def facet(name):
        n = t("documents").groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("facet", F.lit(name))
        return n.select("facet", "value", "n", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value")).cast("long").alias("place"))

    return facet("source").union(facet("lang"))


# ------------------------------------------------------------------------------------------------ serving


@query("served_neighbours", f"""WITH k AS ({COSINE.format(extra='')}) SELECT src, coalesce(string_agg(CASE WHEN dst % 3 <> 0 THEN CAST(dst AS VARCHAR) END, ',' ORDER BY rank), '') AS served, coalesce(string_agg(CASE WHEN dst % 3 = 0 THEN CAST(dst AS VARCHAR) END, ',' ORDER BY rank), '') AS dropped FROM k GROUP BY src""")
def _(t):
    e = t("embeddings")
    out = P.served(V.embedding_topk(e), e.where("vec_id % 3 != 0").select(F.col("vec_id").alias("dst")))
    return out.select("src", F.array_join("served", ",").alias("served"), F.array_join("dropped", ",").alias("dropped"))


@query("affected_by", f"WITH k AS ({COSINE.format(extra='')}) SELECT DISTINCT src FROM k WHERE dst % 50 = 7 UNION SELECT vec_id FROM embeddings WHERE vec_id % 50 = 7")
def _(t):
    e = t("embeddings")
    return P.affected_by(V.embedding_topk(e), e.where("vec_id % 50 = 7").select(F.col("vec_id").alias("dst")))


@query("enough_text", "SELECT count(*) AS n FROM documents")
def _(t):
    return P.enough(t("documents"), "text").agg(F.count(F.lit(1)).alias("n"))


@query("insert_or_ignore", "SELECT c_custkey AS k, 'old' AS v FROM customer WHERE c_acctbal > 0 UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    from lectern.operators.reconcile import inserted_or_ignored

    old = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    return inserted_or_ignored(old, t("orders").select(F.col("o_custkey").alias("k"), F.lit("new").alias("v")).distinct(), ["k"])


@query("set_difference", "SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def _(t):
    return O.difference(t("customer").select("c_nationkey").distinct(), t("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey")), ["c_nationkey"])


# ------------------------------------------------------------------------------------------------ deferred checks


@query("expiry_checks", """WITH RECURSIVE s AS (SELECT CAST(user_id AS VARCHAR) AS u, epoch_us(ts) AS at_us, CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END AS step FROM events WHERE event_type IN ('purchase', 'error')), e AS (SELECT DISTINCT u, at_us FROM s WHERE step < 0),
 r AS (SELECT u, min(at_us) AS at_us FROM e GROUP BY u UNION ALL SELECT r.u, min(e.at_us) FROM r JOIN e ON e.u = r.u AND e.at_us > r.at_us + 86400000000 GROUP BY r.u, r.at_us)
 SELECT u AS "user", r.at_us + 86400000000 AS due, (SELECT CAST(sum(step) AS BIGINT) FROM s WHERE s.u = r.u AND s.at_us <= r.at_us + 86400000000) AS active, (SELECT sum(step) FROM s WHERE s.u = r.u AND s.at_us <= r.at_us + 86400000000) <= 0 AS expired FROM r""")
def _(t):
    starts = F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False)
    return rechecks.rechecks(t("events"), "user_id", "ts", starts, delay=86_400).select("user", F.unix_micros("due").alias("due"), "active", "expired")
