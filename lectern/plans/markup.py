"""Queries over markup: whole pages as event streams, and articles between HTML and JATS; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import markup as K
from lectern.functions import text as X
from lectern.operators import jats as J
from lectern.plans.catalog import query, spread

#: Pages cut into raw elements, comments, tags and text by DuckDB's own expressions.
PIECES = r"""p AS (SELECT page_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<script[^>]*>[\s\S]*?</script>|<style[^>]*>[\s\S]*?</style>|<!--[\s\S]*?-->|<[^>]*>|[^<]+') AS x FROM pages)),
 d AS (SELECT page_id, i, x, CASE WHEN x LIKE '<script%' OR x LIKE '<style%' THEN regexp_replace(x, '^<[^>]*>|</[a-z]+>$', '', 'g') WHEN x LIKE '<%' THEN ''
  ELSE replace(replace(replace(replace(replace(replace(replace(x, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&amp;', '&') END AS said FROM p)"""
#: The pieces with these names as HTML reads them, which is the rule of `unescaped`: the semicolon may be missing.
READ_PIECES = PIECES.split("  ELSE ")[0] + """  ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&nbsp;?', chr(160), 'g'), '&amp;?', '&', 'g') END AS said FROM p)"""


@query("page_text", f"WITH {READ_PIECES} SELECT page_id, length(string_agg(said, '' ORDER BY i)) AS chars, md5(string_agg(said, '' ORDER BY i)) AS digest FROM d GROUP BY page_id")
def _(t):
    return t("pages").select("page_id", K.plain_text(F.col("html")).alias("said")).select("page_id", F.char_length("said").cast("long").alias("chars"), F.md5("said").alias("digest"))


@query("link_classes", f"""WITH {PIECES}, h AS (SELECT regexp_extract(x, 'href="([^"]*)"', 1) AS h FROM d WHERE x LIKE '<a %')
 SELECT CASE WHEN regexp_matches(h, '\\.pdf($|[?#])|/download/', 'i') THEN 'download' WHEN regexp_matches(h, '/(purchase|checkout|cart)', 'i') THEN 'purchase' WHEN regexp_matches(h, '/(membership|join|subscribe)', 'i') THEN 'membership'
 WHEN regexp_matches(h, 'doi\\.org/', 'i') THEN 'doi' WHEN regexp_matches(h, '/(register|signup)', 'i') THEN 'register' WHEN regexp_matches(h, '/(login|signin)', 'i') THEN 'login' ELSE 'other' END AS class,
 length(regexp_extract(h, '^/([a-zA-Z]?)', 1)) AS lettered, count(*) AS n FROM h GROUP BY ALL""")
def _(t):
    opened = F.filter(K.events(F.col("html")), lambda e: (e["kind"] == "start") & (e["name"] == "a"))
    hrefs = t("pages").select(F.explode(F.transform(opened, lambda e: K.attribute(e["source"], "href"))).alias("href"))
    return hrefs.groupBy(X.link_class(F.col("href")).alias("class"), F.char_length(F.regexp_extract("href", "^/([a-zA-Z]?)", 1)).cast("long").alias("lettered")).agg(F.count(F.lit(1)).alias("n"))


@query("page_links", f"""WITH {PIECES},
 w AS (SELECT *, last_value(CASE WHEN x LIKE '<a %' THEN i END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS opened,
  first_value(CASE WHEN said <> '' THEN said END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM d),
 l AS (SELECT c.page_id, c.i, regexp_extract(o.x, 'href="([^"]*)"', 1) AS href, (SELECT string_agg(m.said, '' ORDER BY m.i) FROM d m WHERE m.page_id = c.page_id AND m.i BETWEEN c.opened AND c.i) AS label, coalesce(regexp_extract(c.next, '^\\S+'), '') AS run_on
  FROM w c JOIN d o ON o.page_id = c.page_id AND o.i = c.opened WHERE c.x = '</a>')
 SELECT page_id, count(*) AS links, count(*) FILTER (WHERE run_on <> '') AS run_ons, md5(string_agg(href || '|' || label || '|' || run_on, chr(10) ORDER BY i)) AS digest FROM l GROUP BY page_id""")
def _(t):
    found = t("pages").select("page_id", K.links(F.col("html")).alias("l")).where("size(l) > 0")
    said = F.array_join(F.transform("l", lambda x: F.concat_ws("|", x["href"], x["label"], x["run_on"])), "\n")
    return found.select("page_id", F.size("l").cast("long").alias("links"), F.size(F.filter("l", lambda x: x["run_on"] != "")).cast("long").alias("run_ons"), F.md5(said).alias("digest"))


# Balanced pages are read by an XML parser, which refuses what is not well-formed; what it reads is the text of the pieces.


@query("balanced_pages", f"WITH {PIECES} SELECT page_id, md5(string_agg(said, '' ORDER BY i)) AS digest, count(*) FILTER (WHERE x LIKE '<p>%') AS paragraphs FROM d GROUP BY page_id")
def _(t):
    whole = F.concat(F.lit("<r>"), K.balanced(F.col("html")), F.lit("</r>"))
    read = t("pages").select("page_id", whole.alias("xml"))
    return read.select("page_id", F.md5(F.xpath_string("xml", F.lit("/r"))).alias("digest"), F.xpath_long("xml", F.lit("count(//p)")).alias("paragraphs"))


REFERENCES = "(SELECT p_partkey, p_partkey % 5 AS k, '10.1000/' || lower(replace(p_brand, '#', '')) || p_partkey AS doi, p_name, p_type FROM part)"


@query("reference_dois", f"""SELECT p_partkey, trim(p_name || ' & ' || p_type || '. ' || CASE k WHEN 4 THEN 'https://doi.org/' || doi WHEN 0 THEN '' ELSE doi END) AS text, CASE WHEN k IN (1, 2) THEN doi ELSE '' END AS stated, CASE WHEN k = 4 THEN doi ELSE '' END AS linked,
 CASE k WHEN 2 THEN 'Following,' ELSE '' END AS run_on FROM {REFERENCES}""")
def _(t):
    k, doi = F.col("p_partkey") % 5, F.concat(F.lit("10.1000/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.col("p_partkey"))
    ident = (
        F.when(k == 1, F.concat(F.lit('<pub-id assigner="a>b" pub-id-type="doi">\n '), doi, F.lit("</pub-id>"))).when(k == 2, F.concat(F.lit("<j:pub-id pub-id-type='doi'>"), doi, F.lit("</j:pub-id>")))
        .when(k == 3, F.concat(F.lit('<pub-id pub-id-type="pmid">'), doi, F.lit("</pub-id>"))).when(k == 4, F.concat(F.lit("<ext-link>https://doi.org/"), doi, F.lit("</ext-link>"))).otherwise("<!-- <pub-id pub-id-type=\"doi\">10.1/x</pub-id> -->")
    )
    jats = F.concat(F.lit("<back><ref-list><title>x</title><ref id='r'><mixed-citation>"), "p_name", F.lit(" &amp; <i>"), "p_type", F.lit("</i>. "), ident, F.lit("</mixed-citation></ref></ref-list></back>"))
    html = F.concat(F.lit('<li>x <a href="https://doi.org/'), doi, F.lit('">y</a>'), F.when(k == 2, "</li><li>Following, z").otherwise("</li>\n<li>z"), F.lit("</li>"))
    one = spread(t("part").select("p_partkey", "p_name", "p_type", "p_brand")).select("p_partkey", F.get(K.reference_dois(jats), F.lit(0)).alias("r"), F.get(K.run_on_links(html), F.lit(0)).alias("l"))
    return one.select("p_partkey", F.trim("r.text").alias("text"), F.array_join("r.stated", ",").alias("stated"), F.array_join("r.linked", ",").alias("linked"), F.coalesce("l.follows", F.lit("")).alias("run_on"))


# Articles round the documents' texts, three shapes; the SQL writes the JATS, and the HTML that comes back from it.

ESCAPED = "replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
NL = "' || chr(10) || '"


@query("article_jats", f"""WITH d AS (SELECT doc_id, doc_id % 3 AS v, {ESCAPED} AS body FROM documents), x AS (SELECT doc_id,
 '<sec><title>One ' || doc_id || '</title>{NL}<p>' || body || ' <italic>x</italic> &amp; <ext-link xlink:href="https://e.org/?a=1&amp;b=2">link</ext-link>.</p>{NL}' ||
 CASE v WHEN 0 THEN '<list list-type="bullet"><list-item><p>a</p></list-item>{NL}<list-item><p>b <bold>c</bold></p></list-item>{NL}</list>{NL}</sec>{NL}'
  WHEN 1 THEN '<sec><title>In</title>{NL}<disp-quote><p>bare ' || doc_id || '</p></disp-quote>{NL}</sec>{NL}<sec><title>In two</title>{NL}<p>t</p>{NL}</sec>{NL}</sec>{NL}'
  ELSE '<disp-quote><p>q1</p>{NL}<p>q2</p>{NL}</disp-quote>{NL}<fig><graphic xlink:href="a.png" xlink:title="A &quot;b&quot;" content-type="width:40%"/><caption><p>Cap</p></caption></fig>{NL}</sec>{NL}' END || '<sec><title>End</title>{NL}<p>last<break/>line' || '</p>{NL}</sec>' AS jats,
 '<h2>One ' || doc_id || '</h2>{NL}<p>' || body || ' <em>x</em> &amp; <a href="https://e.org/?a=1&amp;b=2">link</a>.</p>{NL}' ||
 CASE v WHEN 0 THEN '<ul><li>a</li>{NL}<li>b <strong>c</strong></li>{NL}</ul>{NL}' WHEN 1 THEN '<h3>In</h3>{NL}<blockquote>bare ' || doc_id || '</blockquote>{NL}<h3>In two</h3>{NL}<p>t</p>{NL}'
  ELSE '<blockquote><p>q1</p>{NL}<p>q2</p>{NL}</blockquote>{NL}<figure><img src="a.png" alt="A &quot;b&quot;" data-width="40%"/><figcaption>Cap</figcaption>{NL}</figure>{NL}' END || '<h2>End</h2>{NL}<p>last<br/>line</p>' AS html FROM d)
 SELECT doc_id, md5(jats) AS jats, md5(html) AS html FROM x""")
def _(t):
    d, v = F.col("doc_id"), F.col("doc_id") % 3
    shapes = (
        F.when(v == 0, "<div><ul><li><p>a</p></li><li>b <b>c</b></li></ul></div>").when(v == 1, F.concat(F.lit("<h3>In</h3><blockquote>bare "), d, F.lit("</blockquote><H3>In two</H3><p>t</p>")))
        .otherwise('<blockquote><p>q1</p><p>q2</blockquote><!-- c --><figure><img src=a.png alt=\'A "b"\' data-width="40%"><figcaption>Cap</figcaption></figure><script>x</script>')
    )
    html = F.concat(F.lit("<head><title>t</title></head><h2>One "), d, F.lit("</h2><p>"), K.escaped(F.coalesce("text", F.lit(""))), F.lit(' <i>x</i> & <a href="https://e.org/?a=1&amp;b=2">link</a><a name="q">.</a></p>'), shapes, F.lit("<h2>End</h2><p>last<br>line"))
    there = J.to_jats(spread(t("documents").select("doc_id", "text")).select("doc_id", html.alias("source")), "doc_id", "source")
    return J.to_html(there, "doc_id", "jats").select("doc_id", F.md5("jats").alias("jats"), F.md5("html").alias("html"))
