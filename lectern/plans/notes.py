"""Queries over notes, run-on biographies and edits that must keep the text; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.operators import notes as T
from lectern.operators import rows as O
from lectern.plans.catalog import query

# Lines of an order are markers in order, quantities their numbers; lines that weren't returned have a note, and each order has a note 99.
# The SQL looks through all rising subsequences.


@query("matched_notes", """WITH RECURSIVE f AS (SELECT l_orderkey AS a, l_linenumber AS p, CAST(l_quantity AS INTEGER) AS q, l_returnflag AS f FROM lineitem), m AS (SELECT DISTINCT a, p, q FROM f),
 n AS (SELECT a, q AS number, min(f) AS text FROM f WHERE f <> 'R' GROUP BY ALL UNION ALL SELECT DISTINCT a, 99, 'none' FROM m), k AS (SELECT m.a, p, q, [p, q] AS pq FROM m JOIN n ON n.a = m.a AND n.number = m.q),
 r AS (SELECT a, [pq] AS ps, p, q FROM k UNION ALL SELECT r.a, list_append(ps, k.pq), k.p, k.q FROM r JOIN k ON k.a = r.a AND k.p >= r.p AND k.q > r.q),
 b AS (SELECT a, ps FROM r QUALIFY row_number() OVER (PARTITION BY a ORDER BY len(ps) DESC, ps) = 1), t AS (SELECT a, unnest(ps) AS pq FROM b), x AS (SELECT a, pq[1] AS p, pq[2] AS q FROM t)
 SELECT n.a AS article, n.number, x.p AS position, text, CASE WHEN x.p IS NULL THEN 'unplaced' ELSE 'matched' END AS state FROM n LEFT JOIN x ON x.a = n.a AND x.q = n.number
 UNION ALL SELECT m.a, m.q, m.p, NULL, 'unknown' FROM m ANTI JOIN x ON x.a = m.a AND x.p = m.p AND x.q = m.q""")
def _(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("article"), F.col("l_linenumber").alias("position"), F.col("l_quantity").cast("int").alias("number"), F.col("l_returnflag").alias("text"))
    extra = lines.select("article", F.lit(99).alias("number"), F.lit("none").alias("text")).distinct()
    return T.matched_notes(lines.drop("text"), lines.where("text <> 'R'").select("article", "number", "text").unionByName(extra))


SPLICED = """CASE k % 4 WHEN 0 THEN 'h2:Notes|' || new || '|h2:References' WHEN 1 THEN 'p:body|h2:Notes|' || new || '|h2:References|p:Doe' WHEN 2 THEN 'p:body|h2:Notes:|' || new || '|p:aside|h2:Works Cited' ELSE 'p:body|h2:Endnotes|' || old END"""


@query("spliced_notes", f"""WITH o AS (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 7 + 1 AS n FROM orders), x AS (SELECT *, array_to_string(list_transform(range(1, n + 1), lambda i: 'li:Note ' || i || ' of ' || k), '|') AS new,
 array_to_string(list_transform(range(1, n + 1), lambda i: 'li:old ' || i), '|') AS old FROM o) SELECT o_orderkey, {SPLICED} AS blocks FROM x""")
def _(t):
    k, n = F.col("o_orderkey"), (F.col("o_orderkey") % 7 + 1).cast("int")
    b = lambda tag, text: F.struct(F.lit(tag).alias("tag"), (F.lit(text) if isinstance(text, str) else text).alias("text"))
    old = F.transform(F.sequence(F.lit(1), n), lambda i: b("li", F.concat(F.lit("old "), i)))
    numbered = F.slice(F.transform(F.sequence(F.lit(1), n), lambda i: b("p", F.concat(i, F.lit(" old")))), F.lit(1), n - 1)
    blocks = (
        F.when(k % 4 == 0, F.array(b("h2", "Notes"), b("h2", "References"))).when(k % 4 == 1, F.array(b("p", "body"), b("h2", "References"), b("p", "Doe")))
        .when(k % 4 == 2, F.concat(F.array(b("p", "body"), b("h2", "Notes:")), numbered, F.array(b("p", "aside"), b("h2", "Works Cited")))).otherwise(F.concat(F.array(b("p", "body"), b("h2", "Endnotes")), old))
    )
    notes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("Note "), i, F.lit(" of "), k))
    found = t("orders").select("o_orderkey", T.spliced_notes(blocks, F.lit("Notes"), notes).alias("b"))
    return found.select("o_orderkey", F.array_join(F.transform("b", lambda x: F.concat_ws(":", x["tag"], x["text"])), "|").alias("blocks"))


LONG = "and so on and on "


@query("runon_bios", f"""SELECT doc_id, md5(CASE WHEN doc_id % 4 = 3 THEN coalesce(text, '') || '<bold>Ann</bold> Contact: x' || repeat('{LONG}', 150 + doc_id % 2) ELSE regexp_replace(coalesce(text, ''), '[\\s]+$', '') || CASE WHEN doc_id % 4 = 2 THEN '<bold>Thanks</bold> to all' ELSE '' END END) AS kept,
 CASE doc_id % 4 WHEN 1 THEN 'Ann Clark is a writer. Contact: ann' || doc_id || '@example.org' WHEN 2 THEN 'Ann Clark is a writer, Contact: a@b.org|Tom Lee of London. Contact: tom' || doc_id || '@example.org' ELSE '' END AS bios,
 CASE WHEN doc_id % 4 = 2 THEN 'This paper is of ' || doc_id || '.' END AS provenance, doc_id % 4 = 3 AS refused FROM documents WHERE doc_id % 4 <> 0""")
def _(t):
    v, d, text = F.col("doc_id") % 4, F.col("doc_id"), F.coalesce("text", F.lit(""))
    paragraph = (
        F.when(v == 0, text).when(v == 1, F.concat(text, F.lit(" <bold>Ann Clark</bold> is a writer.Contact: ann"), d, F.lit("@example.org")))
        .when(v == 2, F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("<bold>Thanks</bold> to all\n<bold>Ann Clark</bold> is a writer,Contact: a@b.org <bold>Tom Lee</bold> of London. Contact: tom"), d, F.lit("@example.orgThis paper is of "), d, F.lit(".")))
        .otherwise(F.concat(text, F.lit("<bold>Ann</bold> Contact: x"), F.repeat(F.lit(LONG), (150 + d % 2).cast("int"))))
    )
    found = t("documents").select("doc_id", T.runon_bios(paragraph).alias("r")).where("r is not null")
    return found.select("doc_id", F.md5("r.kept").alias("kept"), F.array_join("r.bios", "|").alias("bios"), "r.provenance", "r.refused")


SIGNED = "regexp_replace(lower(strip_accents({})), '[^0-9a-z]', '', 'g')"


@query("proved_edits", f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, (length(coalesce(text, '')) * (doc_id % 10) // 10) AS n FROM documents),
 s AS (SELECT *, {SIGNED.format('text')} AS a, {SIGNED.format("CASE WHEN doc_id % 3 = 0 THEN text ELSE left(text, n) || '00' || substr(text, n + 1) END")} AS b, length({SIGNED.format('left(text, n)')}) AS l, {SIGNED.format('substr(text, n + 1)')} AS rest FROM d),
 p AS (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN l + length(rest) - length(ltrim(rest, '0')) END AS spot FROM s)
 SELECT doc_id, spot IS NOT NULL AS refused, spot::INTEGER AS "at", CASE WHEN spot >= 0 THEN substr(a, greatest(spot - 30, 0) + 1, least(spot, 30) + 30) END AS was, CASE WHEN spot >= 0 THEN substr(b, greatest(spot - 30, 0) + 1, least(spot, 30) + 30) END AS got,
 md5(CASE WHEN spot IS NULL THEN translate(regexp_replace(text, '\\s+', '  ', 'g'), 'aeiou', 'AEIOU') ELSE text END) AS kept FROM p""")
def _(t):
    d = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.floor(F.char_length("text") * (F.col("doc_id") % 10) / 10).cast("int")
    spaced = F.translate(F.regexp_replace("text", r"\s+", "  "), "aeiou", "AEIOU")
    after = F.when(F.col("doc_id") % 3 == 0, spaced).otherwise(F.concat(F.substring("text", F.lit(1), n), F.lit("00"), F.substr("text", n + 1)))
    found = T.proved_edit(d.withColumn("after", after), "text", "after")
    return found.select("doc_id", "edit.refused", "edit.at", "edit.was", "edit.got", F.md5("edit.text").alias("kept"))


@query("tidied_contacts", """WITH d AS (SELECT doc_id, doc_id % 4 AS v, replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS body FROM documents)
 SELECT doc_id, md5('<!-- <p>a@b.org<br>c</p> -->' || CASE v WHEN 0 THEN '<p>Prose<br/>line</p><p>' || regexp_replace(body, '[\\s]+$', '') || '</p><p><strong>Ann Clark</strong> writes. Contact: a' || doc_id || '@b.org</p><p><strong>Tom Lee</strong> too. Contact: t@b.org</p>'
  WHEN 1 THEN '<p class="x"><strong>Ann Clark</strong> writes. Contact: a@b.org. https://e.org/' || doc_id || ' and more</p><p>' || body || '</p>' WHEN 2 THEN '<p>Write to a' || doc_id || '@b.org. https://e.org</p>'
  ELSE '<p>Ann, a@b.org</p><p title="0000-0002-1825-0097">ORCID: 0000-0003-0000-000' || doc_id % 10 || '</p>' END) AS html FROM d""")
def _(t):
    from lectern.functions import markup as K
    from lectern.operators import contacts as P

    v, d, body = F.col("doc_id") % 4, F.col("doc_id"), K.escaped(F.coalesce("text", F.lit("")))
    html = (
        F.when(v == 0, F.concat(F.lit("<p>Prose<br/>line</p><p>"), body, F.lit(" <strong>Ann Clark</strong> writes.Contact: a"), d, F.lit("@b.org <strong>Tom Lee</strong> too. Contact: t@b.org</p>")))
        .when(v == 1, F.concat(F.lit('<p class="x"><strong>Ann Clark</strong> writes.<br>Contact: a@b.org<br />https://e.org/'), d, F.lit(" <br>and more</p><p>"), body, F.lit("</p>")))
        .when(v == 2, F.concat(F.lit("<p>Write to a"), d, F.lit("@b.orghttps://e.org</p>"))).otherwise(F.concat(F.lit('<p>Ann, a@b.org https://orcid.org/0000-0002-1825-0097.</p><p title="0000-0002-1825-0097">ORCID: 0000-0003-0000-000'), d % 10, F.lit("</p>")))
    )
    a = t("documents").select("doc_id", F.concat(F.lit("<!-- <p>a@b.org<br>c</p> -->"), html).alias("html"), F.array(F.lit("https://orcid.org/0000-0002-1825-0097/")).alias("orcids"))
    return P.tidied(a, "html", "orcids").select("doc_id", F.md5("html").alias("html"))


# ------------------------------------------------------------------------------------------------ numbers and titles in texts

NUMBERED = "(SELECT conv_id, turn, CASE hash_of % 4 WHEN 0 THEN (hash_of % 97) || '. ' || text WHEN 1 THEN (hash_of % 97) || ')' || text WHEN 2 THEN '(' || hash_of % 97 || ') ' || text ELSE text END AS note FROM (SELECT *, conv_id * 31 + turn * 17 AS hash_of FROM conversations))"


@query("numbered_texts", f"""SELECT conv_id, turn, try_cast(nullif(regexp_extract(note, '^(\\d+)[.)\\s]', 1), '') AS BIGINT) AS number, md5(regexp_replace(regexp_replace(note, '^(\\(\\d{{1,3}}\\)\\s*|\\d{{1,3}}[.)\\s]+)', ''), '^\\s+|\\s+$', '', 'g')) AS plain,
 row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(try_cast(nullif(regexp_extract(note, '^(\\d+)[.)\\s]', 1), '') AS BIGINT), 9223372036854775807), turn) AS place FROM {NUMBERED}""")
def _(t):
    h = F.col("conv_id") * 31 + F.col("turn") * 17
    n = h % 97
    note = F.when(h % 4 == 0, F.concat(n, F.lit(". "), "text")).when(h % 4 == 1, F.concat(n, F.lit(")"), "text")).when(h % 4 == 2, F.concat(F.lit("("), n, F.lit(") "), "text")).otherwise(F.col("text"))
    rows = t("conversations").select("conv_id", "turn", note.alias("note")).withColumn("number", X.leading_number(F.col("note")))
    order = Window.partitionBy("conv_id").orderBy(F.col("number").asc_nulls_last(), "turn")
    return rows.select("conv_id", "turn", "number", F.md5(X.without_number(F.col("note"))).alias("plain"), F.row_number().over(order).cast("long").alias("place"))


STOPS = ", ".join(f"'{w}'" for w in X.TITLE_STOP_WORDS)


@query("title_verdicts", f"""WITH w AS (SELECT doc_id, lower(substr(text, 1 + (doc_id % 5)::INTEGER * 40)) AS low, list_filter(regexp_extract_all(lower(regexp_replace('Obituary: ' || left(text, 90), '^(Book Review|Obituary)\\s*:\\s*', '', 'i')), '[a-z]+'), lambda x: length(x) > 2 AND x NOT IN ({STOPS})) AS w FROM documents WHERE text IS NOT NULL),
 m AS (SELECT doc_id, len(w) AS total, list_filter(w, lambda x: NOT contains(low, x)) AS missing FROM w)
 SELECT doc_id, CASE WHEN total = 0 OR (total - len(missing)) / total >= 0.6 THEN 'pass' WHEN (total - len(missing)) / total >= 0.3 THEN 'warn' ELSE 'fail' END AS status, (total - len(missing))::INTEGER AS matched, total::INTEGER AS total, array_to_string(missing, ',') AS missing FROM m""")
def _(t):
    title = F.concat(F.lit("Obituary: "), F.substring("text", 1, 90))
    v = X.title_verdict(title, F.substr("text", (1 + (F.col("doc_id") % 5) * 40).cast("int")))
    found = t("documents").where("text is not null").select("doc_id", v.alias("v"))
    return found.select("doc_id", "v.status", "v.matched", "v.total", F.array_join("v.missing", ",").alias("missing"))


SQUASHED = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


@query("word_overlaps", f"""WITH t AS (SELECT doc_id, {SQUASHED.format('left(text, 90)')} AS a, {SQUASHED.format('substr(text, 1 + (doc_id % 6)::INTEGER * 15)')} AS b FROM documents WHERE text IS NOT NULL),
 w AS (SELECT *, list_filter(string_split(a, ' '), lambda x: x <> '') AS wa, string_split(b, ' ') AS wb FROM t)
 SELECT doc_id, CASE WHEN len(wa) = 0 THEN NULL WHEN contains(b, a) THEN 1.0 ELSE round(len(list_filter(wa, lambda x: list_contains(wb, x))) / len(wa), 6) END AS overlap FROM w""")
def _(t):
    a, b = X.squash(F.substring("text", 1, 90)), X.squash(F.substr("text", (1 + (F.col("doc_id") % 6) * 15).cast("int")))
    return t("documents").where("text is not null").select("doc_id", F.round(X.word_overlap(a, b), 6).alias("overlap"))


@query("common_parts", "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 25")
def _(t):
    return O.most_common(t("lineitem"), "l_partkey", 25)


@query("staff_or_active", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) OR EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = c_nationkey AND r_name = 'ASIA')")
def _(t):
    active = t("orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    near = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"))
    return O.in_any(t("customer"), "c_custkey", active, t("customer").join(near, "c_nationkey", "left_semi")).select("c_custkey")


# ------------------------------------------------------------------------------------------------ records


@query("record_validation", """WITH p AS (SELECT p_partkey, p_partkey % 11 AS k, p_name FROM part), r AS (SELECT p_partkey, unnest(list_filter([CASE WHEN k = 1 THEN 'missing title' END, CASE WHEN k IN (2, 3) THEN 'missing authors' END, CASE WHEN k = 4 THEN 'unknown access' END,
 CASE WHEN k IN (3, 5) THEN 'orcid of no author: Ann Clark' END, CASE WHEN k IN (5, 6) THEN 'orcid of no shape: Ann Clark' END, CASE WHEN k = 7 THEN 'pages run backwards' END, CASE WHEN k = 8 THEN 'review without book_title' END, CASE WHEN k = 8 THEN 'review without book_year' END,
 CASE WHEN k = 8 THEN 'publisher cut off' END, CASE WHEN k = 10 THEN 'issue: no articles' END, CASE WHEN k = 0 THEN 'issue: missing date' END], lambda x: x IS NOT NULL)) AS problem FROM p) SELECT p_partkey, problem FROM r""")
def _(t):
    from lectern.operators import records as R

    k, null = F.col("p_partkey") % 11, F.lit(None).cast("string")
    orcid = F.when(k.isin(5, 6), F.concat(F.lit("0000-0001-"), F.col("p_partkey"))).otherwise("https://orcid.org/0000-0002-1825-009X")
    a = {
        "title": F.when(k == 1, null).when(k == 9, F.concat("p_name", F.lit(" / Other"))).otherwise(F.col("p_name")), "authors": F.when(k.isin(2, 3), null).when(k == 5, "Tom Lee").otherwise("Tom Lee and Ann Clark"), "section": F.when(k.isin(8, 9), "Book Reviews").otherwise("Articles"),
        "pdf_page_start": F.when(k == 7, 9).otherwise(3), "pdf_page_end": F.lit(7), "access": F.when(k == 4, F.col("p_brand")).when(k == 5, " Open "), "orcids": F.when(k.isin(3, 5, 6, 7), F.create_map(F.lit("Ann Clark"), orcid)),
        "book_title": F.when(k == 8, ""), "book_author": F.when(k == 8, "Doe"), "book_year": F.lit(None).cast("int"), "publisher": F.when(k == 8, "London: ").otherwise("London: Sage"),
    }
    issue = {"volume": F.lit(1), "date": F.when(k != 0, "2001-02-03"), "articles": F.when(k == 10, F.array().cast("array<string>")).otherwise(F.array("p_name"))}
    found = F.concat(R.article_problems(a), F.transform(R.issue_problems(issue), lambda x: F.concat(F.lit("issue: "), x)))
    return t("part").select("p_partkey", F.explode(found).alias("problem"))


@query("patch_plan", """WITH p AS (SELECT p_partkey AS id, p_partkey % 8 AS k, p_name, p_brand FROM part)
 SELECT id, 'blocked' AS action, 'article' AS field, NULL::INTEGER AS place, NULL AS was, NULL AS becomes FROM p WHERE k = 0 UNION ALL SELECT id, 'update', 'title', NULL, p_name || '!', p_name FROM p WHERE k IN (1, 2) UNION ALL SELECT id, 'blocked', 'authors', NULL, '1', '2' FROM p WHERE k = 2
 UNION ALL SELECT id, 'update', 'given', 0, 'Anne', 'Ann' FROM p WHERE k = 3 UNION ALL SELECT id, 'update', 'orcid', 1, NULL, p_brand FROM p WHERE k = 4 UNION ALL SELECT id, 'update', 'holder', NULL, 'Anne Clark (Author)', 'Ann Clark (Author)' FROM p WHERE k = 3 UNION ALL SELECT id, 'update', 'family', 1, 'Li', 'Lee' FROM p WHERE k = 5
 UNION ALL SELECT id, 'blocked', 'abstract', NULL, NULL, NULL FROM p WHERE k = 6""")
def _(t):
    from lectern.operators import records as R

    k, null = F.col("id") % 8, F.lit(None).cast("string")
    author = lambda given, family, orcid: F.struct(*[(F.lit(x) if isinstance(x, str) else x).alias(n) for n, x in (("given", given), ("family", family), ("orcid", orcid))])
    p = t("part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand")
    wanted = p.select("id", F.col("p_name").alias("title"), F.col("p_brand").alias("abstract"), F.array(author("Ann", "Clark", null), author("Tom", "Lee", F.when(k == 4, F.col("p_brand")).otherwise(""))).alias("authors"))
    second = author("Tom", F.when(k == 5, "Li").otherwise("Lee"), F.when(k == 7, "kept"))
    held = p.where("id % 8 <> 0").select(
        "id", F.when(k.isin(1, 2), F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("title"), F.when(k == 6, "another").when(k == 7, "").otherwise(F.col("p_brand")).alias("abstract"),
        F.when(k == 2, F.array(author("Ann", "Clark", null))).otherwise(F.array(author(F.when(k == 3, "Anne").otherwise("Ann"), "Clark", null), second)).alias("authors"), F.when(k == 3, "Anne Clark (Author)").when(k == 4, "").otherwise("Ann Clark (Author)").alias("holder"),
    )
    return R.patch_plan(wanted, held)
