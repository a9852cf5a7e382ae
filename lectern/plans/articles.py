"""Queries over wording, identifiers, layout and back matter of articles; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import markup as K
from lectern.functions import text as X
from lectern.functions import wording as W
from lectern.operators import articles as A
from lectern.operators import extraction as E
from lectern.plans.catalog import query

TITLES = "(SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '“' || p_name || '”,  ' || p_type WHEN 1 THEN upper(p_name) || '''s re-made: ' || p_brand WHEN 2 THEN '<i>' || p_name || '</i> • ' || p_brand ELSE p_name || ' & ' || p_type || '. ' END AS title FROM part)"


def _titles(t):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    title = (
        F.when(k == 0, F.concat(F.lit("“"), name, F.lit("”,  "), "p_type")).when(k == 1, F.concat(F.upper(name), F.lit("'s re-made: "), "p_brand"))
        .when(k == 2, F.concat(F.lit("<i>"), name, F.lit("</i> • "), "p_brand")).otherwise(F.concat(name, F.lit(" & "), "p_type", F.lit(". ")))
    )
    return t("part").select("p_partkey", title.alias("title"))


@query("title_forms", f"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(regexp_replace(title, '[-'']', ' ', 'g')), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS spaced,
 trim(regexp_replace(replace(replace(lower(title), '''', ''), '’', ''), '[^a-z0-9]+', ' ', 'g')) AS squashed, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS tight,
 regexp_replace(regexp_replace(title, '<[^>]+>', '', 'g'), '[\\s•-]', '', 'g') AS plain,
 trim(regexp_replace(regexp_replace(trim(lower(title)), '[“”"'']', '', 'g'), '\\s+', ' ', 'g'), ' .,;:') AS title, lower(trim(regexp_replace(regexp_replace(regexp_replace(title, '<[^>]+>', '', 'g'), '[^a-zA-Z ]', '', 'g'), ' +', ' ', 'g'))) AS matched FROM {TITLES}""")
def _(t):
    c = F.col("title")
    return _titles(t).select("p_partkey", W.spaced_key(c).alias("spaced"), W.squash_spaced(c).alias("squashed"), W.squash_tight(c).alias("tight"), W.squash_plain(c).alias("plain"), W.plain_title(c).alias("title"), X.match_key(c).alias("matched"))


@query("name_variants", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Ann Clark|' WHEN 1 THEN 'Luis M. Rodriguez|Luis Rodriguez' WHEN 2 THEN 'Ann B. Clark, Edgar Agrela Correia|Ann Clark, Edgar Correia' ELSE 'Ann B. Clark and Tom Lee|Ann Clark and Tom Lee' END AS said FROM customer""")
def _(t):
    k = F.col("c_custkey") % 4
    line = F.when(k == 0, "Ann Clark").when(k == 1, "Luis M. Rodriguez").when(k == 2, "Ann B. Clark, Edgar Agrela Correia").otherwise("Ann B. Clark and Tom Lee")
    v = W.name_variants(F.col("line"))
    return t("customer").select("c_custkey", line.alias("line")).select("c_custkey", F.concat(F.get(v, 0), F.lit("|"), F.coalesce(F.get(v, 1), F.lit(""))).alias("said"))


@query("title_case", """WITH p AS (SELECT p_partkey, 'the art of (' || p_name || ') and ' || lower(p_type) AS low FROM part),
 w AS (SELECT p_partkey, low, list_transform(string_split(low, ' '), lambda x, i: CASE WHEN i > 1 AND x IN ('a', 'an', 'the', 'and', 'but', 'or', 'nor', 'for', 'yet', 'so', 'in', 'on', 'at', 'to', 'by', 'of', 'as', 'is', 'it') THEN x
  WHEN x[1] = '(' THEN '(' || upper(x[2]) || x[3:] ELSE upper(x[1]) || x[2:] END) AS w FROM p),
 c AS (SELECT p_partkey, low, array_to_string(w, ' ') AS cased FROM w)
 SELECT p_partkey, cased, CASE p_partkey % 3 WHEN 0 THEN cased WHEN 1 THEN low ELSE cased || ' “In Quotes”' END AS normal, 'XIV' AS roman FROM c""")
def _(t):
    low = F.concat(F.lit("the art of ("), "p_name", F.lit(") and "), F.lower("p_type"))
    said = F.when(F.col("p_partkey") % 3 == 0, F.upper(low)).when(F.col("p_partkey") % 3 == 1, low).otherwise(F.concat(F.upper(low), F.lit(" “In Quotes”")))
    return t("part").select("p_partkey", low.alias("low"), said.alias("said")).select("p_partkey", W.title_case(F.upper("low")).alias("cased"), W.normal_caps(F.col("said")).alias("normal"), W.normal_caps(F.lit("XIV")).alias("roman"))


@query("clean_markup", r"""SELECT p_partkey, p_name || chr(10) || chr(10) || 'x' AS controls, CASE WHEN p_partkey % 3 = 2 THEN '```' || p_name ELSE '<p>' || p_name || '</p>' END AS fenced,
 '<p><a>1</a></p>' || chr(10) || '<b>' || p_name || '</b><hr/>' || chr(10) || '<LI>x</LI>' || chr(10) AS separated FROM part""")
def _(t):
    n, k = F.col("p_name"), F.col("p_partkey") % 3
    body = F.concat(F.lit("<p>"), n, F.lit("</p>"))
    fenced = F.when(k == 0, F.concat(F.lit(" ```html\n"), body, F.lit("\n```\n"))).when(k == 1, body).otherwise(F.concat(F.lit("```x\n```"), n, F.lit("  ")))
    return t("part").select("p_partkey", W.without_controls(F.concat(F.lit("\n "), n, F.lit("\n\n\n\n\u0001x\u000b ")).cast("string")).alias("controls"), W.fences_trimmed(fenced).alias("fenced"), W.separated_blocks(F.concat(F.lit("<p><a>1</a></p><b>"), n, F.lit("</b><hr/><LI>x</LI>"))).alias("separated"))


@query("payment_problems", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'amount' WHEN 1 THEN 'currency' END AS problem FROM orders")
def _(t):
    k, minor = F.col("o_orderkey") % 3, F.round(F.col("o_totalprice") * 100).cast("long")
    return t("orders").select("o_orderkey", W.amount_problem(F.col("o_totalprice"), F.lit("gbp"), F.when(k == 0, minor + 1).otherwise(minor), F.when(k == 1, "EUR").otherwise("GBP")).alias("problem"))


@query("primary_roles", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN lower(c_mktsegment) ELSE 'editor' END AS role FROM customer")
def _(t):
    k, seg = F.col("c_custkey") % 3, F.lower("c_mktsegment")
    return t("customer").select("c_custkey", W.primary_role(F.when(k == 0, " ").when(k == 1, F.concat(F.lit(" "), seg, F.lit(", editor"))).otherwise(F.concat(F.lit("editor,"), seg))).alias("role"))


@query("publishers_and_editors", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'London' END AS location, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ': Sons' ELSE p_brand END AS name, p_partkey % 3 = 1 AS is_editor, p_name AS people FROM part")
def _(t):
    pub = W.publisher_parts(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("London: "), "p_brand", F.lit(": Sons"))).otherwise(F.col("p_brand")))
    ed = W.editor_parts(F.when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" (eds.)"))).otherwise(F.col("p_name")))
    return t("part").select("p_partkey", pub.alias("pub"), ed.alias("ed")).select("p_partkey", "pub.location", "pub.name", "ed.is_editor", "ed.people")


OWN = ("10.9999/", "[a-z0-9]{8}|ea\\.\\d+\\.\\d+(?:\\.\\d+)?")


@query("doi_problems", """WITH d AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS s FROM orders)
 SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'empty' WHEN 2 THEN 'run_on' WHEN 3 THEN 'unusable' WHEN 4 THEN 'malformed' END AS problem, CASE WHEN o_orderkey % 7 = 2 THEN '10.9999/' || s END AS suggested, o_orderkey % 7 IN (1, 6) AS own FROM d""")
def _(t):
    k, s = F.col("o_orderkey") % 7, F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    doi = (
        F.when(k == 0, " ").when(k == 1, F.concat(F.lit("10.9999/"), s)).when(k == 2, F.concat(F.lit("10.9999/"), s, F.lit("Links"))).when(k == 3, F.concat(F.lit("http//x"), s))
        .when(k == 4, F.concat(F.lit("10.1000/"), s, F.lit(")."))).when(k == 5, F.concat(F.lit("10.1000/"), s)).otherwise("10.9999/ea.12.3")
    )
    d = t("orders").select("o_orderkey", doi.alias("doi"))
    return d.select("o_orderkey", W.doi_problem(F.col("doi"), X.clean_doi(F.trim("doi")), *OWN).alias("problem"), W.suggested_own_doi(F.col("doi"), OWN[0]).alias("suggested"), W.valid_own_doi(F.col("doi"), *OWN).alias("own"))


@query("doi_links", """SELECT o_orderkey, '10.1000/a' || o_orderkey || ',10.1000/b' AS links, CASE WHEN o_orderkey % 2 = 0 THEN '10.1000/a' || o_orderkey || '>Next,' ELSE '' END AS run_on FROM orders""")
def _(t):
    gap = F.when(F.col("o_orderkey") % 2 == 0, "</p><p>").otherwise("</p>\n<p>")
    html = F.concat(F.lit('<p>See <a class="x" href="https://doi.org/10.1000/a'), "o_orderkey", F.lit('">one</a>'), gap, F.lit("Next, <A HREF='http://dx.doi.org/10.1000/b'>two</A> words</p>"))
    one = t("orders").select("o_orderkey", html.alias("html"))
    said = F.array_join(F.transform(K.run_on_links(F.col("html")), lambda x: F.concat_ws(">", x["doi"], x["follows"])), ";")
    return one.select("o_orderkey", F.array_join(K.doi_links(F.col("html")), ",").alias("links"), said.alias("run_on"))


@query("without_doi", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'Doe, J. (2001). Being. No link' ELSE 'Doe, J. (2001). Being.' END AS text FROM orders")
def _(t):
    k, doi = F.col("o_orderkey") % 3, F.concat(F.lit("10.1000/(x)"), F.col("o_orderkey").cast("string"))
    ref = F.when(k == 0, F.concat(F.lit("Doe, J. (2001). Being. doi: https://doi.org/"), doi, F.lit(". [Accessed 1 May 2002]."))).when(k == 1, F.concat(F.lit("Doe, J. (2001). Being. "), doi)).otherwise("Doe, J. (2001). Being. No link")
    return t("orders").select("o_orderkey", doi.alias("doi"), ref.alias("ref")).select("o_orderkey", W.without_doi(F.col("ref"), F.col("doi")).alias("text"))


# ------------------------------------------------------------------------------------------------ layout


@query("line_roles", """SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN s <= 8.5 THEN 'furniture' WHEN sans AND bold AND s >= 20 THEN 'banner' WHEN sans AND bold AND s >= 14 THEN 'title' WHEN sans AND bold AND s >= 11.5 THEN 'booktitle' WHEN sans AND bold AND s >= 10 THEN 'byline'
 WHEN sans THEN 'strapline' WHEN bold AND s >= 11.5 THEN 'heading' WHEN bold AND italic AND s >= 9 THEN 'subheading' ELSE 'body' END AS role FROM (SELECT *, l_quantity / 2 AS s, l_returnflag = 'A' AS sans, l_linestatus = 'F' AS bold, l_returnflag = 'R' AS italic FROM lineitem)""")
def _(t):
    s = F.col("l_quantity") / 2
    return t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", W.line_role(s, s, F.col("l_returnflag") == "A", F.col("l_linestatus") == "F", F.col("l_returnflag") == "R").alias("role"))


@query("hanging_regions", """WITH l AS (SELECT l_suppkey, l_tax >= 0.04 AS indented, lag(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber) AS before FROM lineitem)
 SELECT l_suppkey, sum(CASE WHEN NOT indented OR before IS NULL THEN 0 WHEN before <= 24 THEN 1 ELSE -1 END) > 0 AS hanging FROM l GROUP BY 1""")
def _(t):
    lines = t("lineitem").withColumn("place", F.struct("l_orderkey", "l_partkey", "l_linenumber"))
    return A.hanging(lines, "l_suppkey", "place", F.col("l_tax") >= 0.04, F.col("l_quantity"), 24.0)


WRAPPED = "(SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 3 = 0 THEN trim(x) WHEN i % 7 = 0 THEN CAST(i AS VARCHAR) ELSE trim(x) || ' ' END), chr(10)) AS text FROM documents)"


@query("wrap_ratios", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {WRAPPED}) SELECT doc_id, round(coalesce(avg(CASE WHEN line LIKE '% ' THEN 1.0 ELSE 0.0 END) FILTER (trim(line) <> ''), 0), 6) AS ratio FROM l GROUP BY doc_id""")
def _(t):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % 3 == 0, F.trim(x)).when((i + 1) % 7 == 0, (i + 1).cast("string")).otherwise(F.concat(F.trim(x), F.lit(" "))))
    return t("documents").select("doc_id", F.array_join(lines, "\n").alias("text")).select("doc_id", F.round(W.wrap_ratio(F.col("text")), 6).alias("ratio"))


@query("reflowed", f"""WITH l AS (SELECT doc_id, list_filter(string_split('THE RUNNING-HEAD' || chr(10) || text, chr(10)), lambda x: NOT regexp_full_match(trim(x), '[0-9]{{1,4}}') AND regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '[\\s•-]', '', 'g') <> 'THERUNNINGHEAD') AS l FROM {WRAPPED}),
 j AS (SELECT doc_id, array_to_string(list_transform(l, lambda x: CASE WHEN trim(x) = '' THEN chr(10) WHEN x LIKE '% ' THEN x ELSE x || chr(10) END), '') AS j FROM l),
 p AS (SELECT doc_id, list_filter(list_transform(string_split(j, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM j) SELECT doc_id, len(p) AS paragraphs, md5(array_to_string(p, '|')) AS digest FROM p WHERE p IS NOT NULL""")
def _(t):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % 3 == 0, F.trim(x)).when((i + 1) % 7 == 0, (i + 1).cast("string")).otherwise(F.concat(F.trim(x), F.lit(" "))))
    text = F.concat(F.lit("THE RUNNING-HEAD\n"), F.array_join(lines, "\n"))
    found = t("documents").where("text is not null").select("doc_id", W.paragraphs(text, F.array(F.lit("THERUNNINGHEAD"))).alias("p"))
    return found.select("doc_id", F.size("p").cast("long").alias("paragraphs"), F.md5(F.array_join("p", "|")).alias("digest"))


@query("clean_headings", "SELECT p_partkey, '<h2>The Art of ' || upper(p_name[1]) || p_name[2:] || '</h2><p>KEPT<sup>1</sup></p><h3><em>' || upper(p_brand) || '</em></h3>' AS html FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS p_name, p_brand FROM part)")
def _(t):
    word = F.upper(F.split_part("p_name", F.lit(" "), F.lit(1)))
    html = F.concat(F.lit("<h2>THE ART OF "), word, F.lit("<sup>2</sup></h2><p>KEPT<sup>1</sup></p><h3><em>"), F.upper("p_brand"), F.lit("</em></h3>"))
    return t("part").select("p_partkey", A.clean_headings(html).alias("html"))


# ------------------------------------------------------------------------------------------------ articles


@query("article_types", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'editorial' WHEN 1 THEN 'book-review' WHEN 2 THEN 'editorial' ELSE 'research-article' END AS type,
 CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 0 WHEN o_orderkey % 5 = 3 THEN 0 ELSE 1 END AS INTEGER) AS access_status FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    section = F.element_at(F.array(*[F.lit(s) for s in ("Editorial", "Book Reviews", "Book Review Editorial", "Articles", "Poems")]), (k % 5 + 1).cast("int"))
    access = F.when(k % 3 == 0, " Open").when((k % 3 == 1) & (k % 2 == 0), "paywalled").when(k % 3 == 1, "unknown")
    return A.typed(t("orders").select("o_orderkey", section.alias("section"), access.alias("access")), "section", "access").select("o_orderkey", "type", "access_status")


@query("founding_year", "SELECT o_orderkey FROM orders")
def _(t):
    issues = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") == 0, 1).otherwise(2).alias("volume"), F.lit(1).alias("number"), F.when(F.col("o_orderkey") == 0, F.expr("DATE '1990-01-01'")).otherwise(F.col("o_orderdate").cast("date")).alias("published"))
    return A.founded(issues, "volume", "number", "published", 1990).select("o_orderkey")


@query("enriched_items", "SELECT o_orderkey, n_name FROM orders LEFT JOIN (SELECT c_custkey AS o_custkey, min(n_name) AS n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 3000 GROUP BY 1) USING (o_custkey)")
def _(t):
    who = t("customer").where("c_acctbal > 3000").join(F.broadcast(t("nation")), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    return A.enriched(t("orders"), who, "o_custkey", ["n_name"]).select("o_orderkey", "n_name")


@query("weighted_texts", "SELECT p_partkey, trim(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE repeat(p_brand || ' ' || p_type || ' ', 3) || ' ' END || repeat(p_name || ' ', 3) || CASE WHEN p_partkey % 2 = 0 THEN ' An abstract' ELSE '' END) AS text FROM part")
def _(t):
    keywords = F.when(F.col("p_partkey") % 3 != 0, F.array("p_brand", "p_type"))
    return t("part").select("p_partkey", A.weighted_text(keywords, F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "<p>An <i>abstract</i></p>")).alias("text"))


@query("first_galley", "SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def _(t):
    return A.first_by_kind(t("lineitem"), "l_orderkey", "l_returnflag", "R", "l_partkey")


@query("xml_bundle", """SELECT p_partkey, '<article id="' || p_partkey || '"><title>' || p_name || ' &amp; &lt;' || p_brand || '&gt;</title><embed encoding="base64">' || to_base64(encode(repeat(p_name, 20))) || '</embed></article>' AS xml FROM part""")
def _(t):
    rows = t("part").select("p_partkey", F.concat("p_name", F.lit(" & <"), "p_brand", F.lit(">")).alias("title"), F.repeat("p_name", F.lit(20)).alias("payload"))
    return A.bundled(rows, "p_partkey", "title", "payload")


CITED, STATED, NOTED = "Doe, J. (2001). Being and having. London: Sage.", "This paper was presented at the Annual Conference in London.", "The word is used here in the sense of the later lectures."
BIO, CONTACT, HEADED = "Ann Clark is a psychotherapist in private practice in London.", "Contact: ann@example.org", "She teaches at a school of her own."


def _items(t):
    k = F.col("o_orderkey")
    item = lambda at, head, text: F.struct(F.lit(at).alias("position"), F.lit(head).alias("heading"), F.lit(text).alias("text"))
    rows = F.array(item(1, "Notes", NOTED), item(2, "Notes", CITED), item(3, "Articles" , STATED), item(4, "References", CITED), item(5, "References", BIO), item(6, "Articles", CONTACT), item(7, "About the Author", HEADED), item(8, "References", "Ann Clark."), item(9, "References", " "))
    kept = F.filter(rows, lambda x: (k % 2 == 0) | ~x["heading"].eqNullSafe(F.lit("References")))
    items = t("orders").select(k.alias("article"), F.inline(kept))
    return items, t("orders").select(k.alias("article"), F.lit("Ann Clark").alias("author"))


ROWS = f"""(SELECT o_orderkey AS article, 'note' AS category, 1 AS position, 0 AS part, '{NOTED}' AS text FROM orders UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'note' ELSE 'citation' END, 2, 0, '{CITED}' FROM orders
 UNION ALL SELECT o_orderkey, 'provenance', 3, 0, '{STATED}' FROM orders UNION ALL SELECT o_orderkey, 'citation', 4, 0, '{CITED}' FROM orders WHERE o_orderkey % 2 = 0
 UNION ALL SELECT o_orderkey, 'bio', 5, 0, '{BIO} {CONTACT}' FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'bio', 6, 0, '{CONTACT}' FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, 'bio', 7, 0, '{HEADED}' FROM orders)"""


@query("extracted_articles", f"SELECT * FROM {ROWS}")
def _(t):
    return A.extracted(*_items(t))


@query("back_matter", f"""SELECT article, '<div class="provenance"><p><em>{STATED}</em></p></div>' AS front, string_agg(CASE WHEN category = 'bio' THEN '<div class="bios"><p>' || text || '</p></div>' END, '' ORDER BY position) || '<div class="notes"><ol>' ||
 string_agg(CASE WHEN category = 'note' THEN '<li>' || text || '</li>' END, '' ORDER BY position) || '</ol></div>' AS back FROM {ROWS} GROUP BY article""")
def _(t):
    return A.back_matter(A.extracted(*_items(t)))


# Whole articles round the documents' texts, in three shapes: with all sections; with inline notes; without references and with two biographies of one author.


@query("whole_articles", f"""WITH d AS (SELECT doc_id AS article, doc_id % 3 AS v FROM documents), r AS (
 SELECT article, 'provenance' AS category, 1 AS position, '{STATED}' AS text FROM d WHERE v <> 0 UNION ALL SELECT article, 'note', 2, '(1) First of ' || article FROM d WHERE v = 1 UNION ALL SELECT article, 'note', 3, '(2) Second of ' || article FROM d WHERE v = 1
 UNION ALL SELECT article, 'note', 9, '{NOTED}' FROM d UNION ALL SELECT article, CASE WHEN v = 2 THEN 'citation' ELSE 'note' END, 10, '{CITED}' FROM d UNION ALL SELECT article, 'citation', 12, 'Roe, R. (19' || 50 + article % 40 || '). Rooms. Oxford: Sage.' FROM d WHERE v <> 2
 UNION ALL SELECT article, 'bio', 14, '{HEADED} Contact: a' || article || '@example.org' FROM d UNION ALL SELECT article, 'bio', 17, 'Tom Lee is a psychotherapist in private practice in London. Contact: tom@example.org' FROM d
 UNION ALL SELECT article, 'note', 19, 'Funding statement: none was received.' FROM d UNION ALL SELECT article, 'bio', 20, 'Dr Ann B. Clark is a psychotherapist in private practice in Oxford.' FROM d WHERE v = 2)
 SELECT article, category, position, 0 AS part, text FROM r""")
def _(t):
    d, v = F.col("doc_id"), F.col("doc_id") % 3
    block = lambda at, tag, text, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(at).alias("at"), F.lit(tag).alias("tag"), (F.lit(text) if isinstance(text, str) else text).alias("text")))
    body = F.concat(F.lit("Lorem ipsum dolor sit amet, "), F.coalesce("text", F.lit("")))
    blocks = F.array_compact(F.array(
        block(1, "p", STATED, v != 0), block(2, "p", F.concat(F.lit("Notes: (1) First of "), d), v == 1), block(3, "p", F.concat(F.lit("(2) Second of "), d), v == 1), block(4, "p", "Ann Clark is a psychotherapist in private practice in London.", v == 2), block(5, "p", " "), block(6, "h2", "Opening"), block(7, "p", body),
        block(8, "h2", "Notes"), block(9, "li", NOTED), block(10, "li", CITED), block(11, "h2", "References", v != 2), block(12, "li", F.concat(F.lit("Roe, R. (19"), 50 + d % 40, F.lit("). Rooms. Oxford: Sage.")), v != 2),
        block(13, "h2", "About the Author"), block(14, "p", HEADED), block(15, "p", F.concat(F.lit("Contact a"), d, F.lit("@example.org"))), block(16, "h2", "Appendix"), block(17, "p", "Tom Lee is a psychotherapist in private practice in London."), block(18, "p", "Contact: tom@example.org"), block(19, "p", "Funding statement: none was received."),
        block(20, "p", "Dr Ann B. Clark is a psychotherapist in private practice in Oxford.", v == 2), block(21, "p", body),
    ))
    rows = t("documents").select(d.alias("article"), F.inline(blocks))
    authors = t("documents").select(d.alias("article"), F.explode(F.array(F.lit("Ann Clark"), F.lit("Tom Lee"))).alias("author"))
    return E.extracted_whole(rows, authors)
