"""Queries over whole articles that are cleaned by section; the bodies are the documents' texts, the SQL writes down what must stay."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import markup as K
from lectern.functions import wording as W
from lectern.operators import routing as G
from lectern.plans.catalog import query, spread

FILL = "lorem ipsum dolor sit amet " * 6
D = f"""d AS (SELECT doc_id, doc_id % 4 AS k, doc_id % 3 AS v, '{FILL}' || coalesce(text, '') AS raw, 'Qqzx Brand ' || doc_id || ' Ljjk' AS title FROM documents),
 b AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS body FROM d)"""


def _articles(t):
    """One article a document, in four sections and three variants: title, subtitle, authors, abstract, following title, HTML."""
    k, v, d = F.col("doc_id") % 4, F.col("doc_id") % 3, F.col("doc_id")
    text = K.escaped(F.concat(F.lit(FILL), F.coalesce("text", F.lit(""))))
    title, following = F.concat(F.lit("Qqzx Brand "), d, F.lit(" Ljjk")), F.concat(F.lit("Vvxkq Wwqj "), d + 1)
    abstract = F.concat(F.lit("On the weight of cold rooms and "), "source", F.lit(", a first report"))
    part = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c if not isinstance(c, str) else F.lit(c), F.lit(f"</{tag}>"))
    body = part("p", text)
    byline = F.when(v == 0, part("p", "Ann B. Clark and Tom Lee")).when(v == 1, part("h3", "Ann Clark and Tom Lee")).otherwise(part("p", "by Ann Bea Clark and Tom M. Lee"))
    words = F.when(v == 0, F.concat(part("h3", "Key Words"), part("p", "cold, room"))).when(v == 1, part("p", "Keywords: cold, room")).otherwise("")
    tail = F.concat(part("h2", "References"), part("p", "Doe, J. (2001). Being and having. London: Sage."), part("h2", F.concat(F.lit("Vvxkq one two three four five Wwqj "), d + 1)), part("p", "Alien text."))
    article = F.concat(part("p", "What the one before ended with."), part("h1", title), part("h2", "A Longer Story of it"), byline, part("h2", "ABSTRACT"), part("p", F.concat(abstract, F.lit("."))), words, part("h2", "OPENING OF THE DAY"), body, tail)
    editorial = F.concat(F.when(v == 0, F.concat(part("h2", "Contents"), part("p", "A list of things"), F.lit("<hr/>"))).when(v == 1, F.concat(part("h1", "CONTENTS"), part("p", "x"), part("h2", "Editorial"))).otherwise(""), part("h1", title), part("p", "Ann Clark"), body, part("p", F.concat(K.escaped(following), F.lit(" begins here"))))
    imprint = "A. Writer. London: Sage, 1998. 200 pp."
    review = F.concat(part("p", "The end of another review."), part("h1", title), part("p", imprint), body, F.when(v == 0, part("h2", following)).when(v == 1, part("p", F.concat(following, F.lit(". Oxford: Karnac, 2001.")))).otherwise(F.concat(part("h2", following), part("p", "Oxford: Karnac, 2001."))), part("p", "Alien text."))
    intro = F.concat(part("p", "stray"), part("h1", title), part("h2", "Book  Reviews"), F.lit("<div>"), body, F.lit("</div>"), part("h2", "Another book"), part("p", "Alien text."))
    html = F.when(k == 0, article).when(k == 1, editorial).when(k == 2, review).otherwise(intro)
    section = F.element_at(F.array(*[F.lit(x) for x in ("Articles", "Editorial", "Book Reviews", "Book Review Editorial")]), (k + 1).cast("int"))
    return spread(t("documents").select("doc_id", "text", "source")).select("doc_id", html.alias("html"), section.alias("section"), title.alias("title"), F.lit("A longer story of it").alias("subtitle"), F.when(k == 0, "Ann B. Clark and Tom Lee").otherwise("Ann Clark").alias("authors"), abstract.alias("abstract"), following.alias("following"), ((k == 2) & (v == 9)).alias("combined"))


@query("cleaned_articles", f"""WITH {D} SELECT doc_id, CASE k WHEN 0 THEN 4 WHEN 3 THEN 2 ELSE 1 END::BIGINT AS blocks,
 md5(CASE k WHEN 0 THEN 'h2:Opening of the Day|p:' || body || '|h2:References|p:Doe, J. (2001). Being and having. London: Sage.' WHEN 3 THEN 'h1:' || title || '|p:' || body ELSE 'p:' || body END) AS digest FROM b""")
def _(t):
    found = G.cleaned(_articles(t).withColumn("blocks", G.markup_blocks(F.col("html"))))
    return found.select("doc_id", F.size("blocks").cast("long").alias("blocks"), F.md5(F.array_join(F.transform("blocks", lambda x: F.concat_ws(":", x["tag"], x["text"])), "|")).alias("digest"))


# The SQL looks for every way to place the words, by a join a word; the phrase is the words 3, 6 and 11 of every fifth text, in order, or the last two the other way round.


@query("gapped_phrases", """WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
 p AS (SELECT doc_id, w, [w[3], w[6], w[11 + doc_id % 3]] AS p, doc_id % 2 = 0 AS turned FROM w WHERE len(w) >= 14),
 q AS (SELECT doc_id, CASE WHEN turned THEN [p[2], p[1], p[3]] ELSE p END AS p, w FROM p), x AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM q),
 a AS (SELECT doc_id, i FROM x JOIN q USING (doc_id) WHERE ends_with(x.w, p[1])), b AS (SELECT DISTINCT x.doc_id, x.i FROM x JOIN q USING (doc_id) JOIN a ON a.doc_id = x.doc_id AND x.i BETWEEN a.i + 1 AND a.i + 6 WHERE x.w = p[2]),
 c AS (SELECT x.doc_id, min(x.i) AS i FROM x JOIN q USING (doc_id) JOIN b ON b.doc_id = x.doc_id AND x.i BETWEEN b.i + 1 AND b.i + 6 WHERE starts_with(x.w, p[3]) GROUP BY 1)
 SELECT doc_id, coalesce(i - 1, -1)::INTEGER AS place FROM q LEFT JOIN c USING (doc_id)""")
def _(t):
    from lectern.functions import text as X

    words = F.filter(F.split(X.squash(F.col("text")), " "), lambda w: w != "")
    d = spread(t("documents").where("text is not null").select("doc_id", "text")).select("doc_id", words.alias("w")).where("size(w) >= 14")
    third = F.get("w", (10 + F.col("doc_id") % 3).cast("int"))
    phrase = F.when(F.col("doc_id") % 2 == 0, F.array(F.get("w", F.lit(5)), F.get("w", F.lit(2)), third)).otherwise(F.array(F.get("w", F.lit(2)), F.get("w", F.lit(5)), third))
    return d.select("doc_id", W.phrase_end(F.col("w"), phrase).cast("int").alias("place"))
