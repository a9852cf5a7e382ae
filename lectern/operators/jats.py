"""Articles between HTML and JATS: a table of nodes, and rules by element name in both directions.

`nodes` makes of each text a row an event, with position, depth, parent and the numbers of open quotes and list items, by
windows over the text's events; `to_jats` and `to_html` give each row what it writes, by a table of rules, and put the
pieces together in order. Sections are what headings imply: a heading closes those of its level and below. All rows of a
text meet in one window, so a text is the unit of work, as it is one row before and after.

Defined cases: a null text is null; wrappers and unknown elements vanish, their text stays; content of script and style
goes; unbalanced markup is balanced first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import markup as K

#: What an element opens and closes with in the other format.
INLINE = {"em": "italic", "i": "italic", "strong": "bold", "b": "bold", "sup": "sup", "sub": "sub"}
JATS_RULES = {
    **{h: (f"<{j}>", f"</{j}>") for h, j in INLINE.items()}, "p": ("<p>", "</p>\n"), "ol": ('<list list-type="order">', "</list>\n"), "ul": ('<list list-type="bullet">', "</list>\n"), "li": ("<list-item><p>", "</p></list-item>\n"),
    "blockquote": ("<disp-quote>", "</disp-quote>\n"), "br": ("<break/>", ""), "figure": ("<fig>", "</fig>\n"), "figcaption": ("<caption><p>", "</p></caption>"), "h2": ("<sec><title>", "</title>\n"), "h3": ("<sec><title>", "</title>\n"),
}
HTML_RULES = {
    "italic": ("<em>", "</em>"), "bold": ("<strong>", "</strong>"), "sup": ("<sup>", "</sup>"), "sub": ("<sub>", "</sub>"), "p": ("<p>", "</p>\n"), "disp-quote": ("<blockquote>", "</blockquote>\n"), "list-item": ("<li>", "</li>\n"), "break": ("<br/>", ""),
    "fig": ("<figure>", "</figure>\n"), "caption": ("<figcaption>", "</figcaption>\n"),
}
#: Elements of JATS that hold elements only, so that blanks between these are no text; elements without content.
HOLDERS = ("sec", "list", "list-item", "disp-quote", "fig")
JATS_VOID = ("break", "graphic", "hr")


def nodes(texts: DataFrame, key: str, markup: str, counted: tuple[str, ...] = (), void: tuple[str, ...] = K.VOID_ELEMENTS) -> DataFrame:
    """(key, row, at, kind, name, source, depth, parent, of, in_<name> for each of counted): the events of each balanced text.

    parent is the position of the element that an event stands in and `of` its name, null at the top; an end has those of
    what holds its element. The first event carries the whole row of `texts`, so that nothing is read twice; a text without
    events has one row without position.
    """
    events = texts.select(F.col(key).alias("key"), F.struct(*texts.columns).alias("row"), K.balanced(F.col(markup), void).alias("m")).select("key", "row", F.posexplode_outer(K.events(F.col("m"))).alias("at", "e"))
    events = events.select("key", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("row")).alias("row"), "at", "e.*")
    order = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    move = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)
    held = lambda n: F.sum(F.when(F.col("name") == n, move).otherwise(0)).over(order) - F.when((F.col("kind") == "start") & (F.col("name") == n), 1).otherwise(0)
    deep = events.select("*", (F.sum(move).over(order) - F.when(F.col("kind") == "start", 1).otherwise(0)).alias("depth"), *[held(n).alias(f"in_{n}") for n in counted])
    # The parent of what stands at a depth is the last start one above: both are rows of one level.
    levels = deep.withColumn("level", F.explode(F.when(F.col("kind") == "start", F.array(F.col("depth"), F.col("depth") + 1)).otherwise(F.array("depth"))))
    level = Window.partitionBy("key", "level").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.when((F.col("kind") == "start") & (F.col("level") == F.col("depth") + 1), F.struct("at", "name"))
    held_by = levels.withColumn("held_by", F.last(opened, ignorenulls=True).over(level)).where("level = depth")
    return held_by.withColumns({"parent": F.col("held_by.at"), "of": F.col("held_by.name")}).drop("level", "held_by")


def _written(name: str, rules: dict[str, tuple[str, str]]) -> tuple[Column, Column]:
    table = lambda k: F.create_map(*[F.lit(x) for n, pair in rules.items() for x in (n, pair[k])])
    return F.coalesce(F.try_element_at(table(0), F.col(name)), F.lit("")), F.coalesce(F.try_element_at(table(1), F.col(name)), F.lit(""))


def _joined(pieces: DataFrame, key: str, markup: str, to: str) -> DataFrame:
    """The rows that the first events carry, with the pieces of each text put together in order, `end` behind them; a text without events is empty, a null one null."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")
    found = pieces.groupBy("key").agg(F.concat(whole, F.coalesce(F.max("end"), F.lit(""))).alias("__whole"), F.collect_list("row").alias("__rows"))
    rows = found.select("__whole", F.explode("__rows").alias("__row")).select("__row.*", "__whole")
    said = F.when(F.col(key).isNotNull(), F.regexp_replace("__whole", r"^\s+|\s+$", ""))
    return rows.withColumn(to, F.when(F.col(markup).isNotNull(), F.coalesce(said, F.lit("")))).drop("__whole")


def _with_attributes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("attributes", F.when(F.col("kind").isin("start", "empty"), K.attributes(F.col("source"))))


def _quoted(value: Column) -> Column:
    return F.replace(K.escaped(value), F.lit('"'), F.lit("&quot;"))


def to_jats(articles: DataFrame, key: str, html: str, to: str = "jats") -> DataFrame:
    """articles with the body of each as JATS. Keys must be unique.

    Headings of level 2 and 3 open sections that close before the next of their level; a paragraph inside a list item has
    no element of its own, and one is put round a quote's bare text; of images the source, title and width are kept.
    """
    n = nodes(articles, key, html, ("li", "blockquote", "head"))
    opens, closes = _written("name", JATS_RULES)
    head, quote = F.col("name").isin("h2", "h3") & (F.col("kind") == "start"), F.col("kind").isin("start", "end") & (F.col("name") == "blockquote")
    before = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    outer = F.coalesce(F.max(F.when(head & (F.col("name") == "h2"), 1).otherwise(0)).over(before), F.lit(0))
    inner = F.coalesce((F.last(F.when(head, F.col("name")), ignorenulls=True).over(before) == "h3").cast("int"), F.lit(0))
    rows = n.withColumns({"outer": outer, "inner": inner, "last": F.max(F.when(head, F.col("at"))).over(Window.partitionBy("key")) == F.col("at")})
    outer, inner = F.col("outer"), F.col("inner")
    closing = F.when(F.col("name") == "h2", outer + inner).otherwise(inner)
    left = F.greatest(outer, (F.col("name") == "h2").cast("int")) + (F.col("name") == "h3").cast("int")
    rows = rows.withColumns({"before": F.when(head, F.repeat(F.lit("</sec>\n"), closing)), "end": F.when(head & F.col("last"), F.repeat(F.lit("</sec>\n"), left))})
    # A quote and the paragraphs that stand right in it share the quote's position.
    inside = (F.col("kind") == "start") & (F.col("name") == "p") & (F.col("in_blockquote") > 0)
    opened = F.last(F.when(quote & (F.col("kind") == "start"), F.col("at")), ignorenulls=True).over(Window.partitionBy("key", "depth").orderBy("at"))
    rows = rows.withColumn("opened", opened).withColumn("quoted", F.when(quote, F.col("opened")).when(inside, F.col("parent")))
    rows = rows.withColumn("bare", F.when(quote, F.max(F.when(inside, True)).over(Window.partitionBy("key", "quoted")).isNull()))
    source, kind, name = F.col("source"), F.col("kind"), F.col("name")
    rows = _with_attributes(rows)
    href, src, title, width = (F.coalesce(K.value_of(F.col("attributes"), a), F.lit("")) for a in ("href", "src", "alt", "data-width"))
    graphic = F.concat(
        F.lit('<graphic xlink:href="'), _quoted(src), F.lit('"'), F.when(title != "", F.concat(F.lit(' xlink:title="'), _quoted(title), F.lit('"'))).otherwise(""),
        F.when(width != "", F.concat(F.lit(' content-type="width:'), _quoted(width), F.lit('"'))).otherwise(""), F.lit("/>"),
    )
    linked = F.max(F.when((name == "a") & (kind == "start") & (href != ""), F.col("at"))).over(Window.partitionBy("key", "depth", "parent").orderBy("at"))
    first = F.max(F.when((name == "a") & (kind == "start"), F.col("at"))).over(Window.partitionBy("key", "depth", "parent").orderBy("at"))
    rows = rows.withColumn("link", F.coalesce(linked == first, F.lit(False)))
    piece = (
        F.when(kind.isin("raw", "other") | (F.col("in_head") > 0), "").when(kind == "text", K.escaped(K.unescaped(source)))
        .when((name == "p") & (F.col("in_li") > 0) & (F.col("in_blockquote") <= 0), "")
        .when(name == "a", F.when(~F.col("link"), "").when(kind == "start", F.concat(F.lit('<ext-link xlink:href="'), _quoted(href), F.lit('">'))).otherwise("</ext-link>"))
        .when(name == "img", F.when(src != "", graphic).otherwise("")).when(name == "blockquote", F.when(kind == "start", F.concat(opens, F.when(F.col("bare"), "<p>").otherwise(""))).otherwise(F.concat(F.when(F.col("bare"), "</p>").otherwise(""), closes)))
        .when(kind.isin("start", "empty"), F.concat(F.coalesce("before", F.lit("")), opens)).otherwise(closes)
    )
    return _joined(rows.select("key", "row", "at", piece.alias("piece"), "end"), key, html, to)


def to_html(articles: DataFrame, key: str, jats: str, to: str = "html") -> DataFrame:
    """articles with the body of each as HTML: sections become headings of level 2, inner ones of level 3; items of one paragraph lose its element. Keys must be unique."""
    n = nodes(articles, key, jats, ("sec",), JATS_VOID)
    source, kind, name = F.col("source"), F.col("kind"), F.col("name")
    rows = n.withColumn("kids", F.sum(F.when(kind.isin("start", "empty"), 1).otherwise(0)).over(Window.partitionBy("key", "parent")))
    opens, closes = _written("name", HTML_RULES)
    rows = _with_attributes(rows)
    ordered = F.coalesce(K.value_of(F.col("attributes"), "list-type") == "order", F.lit(False))
    level = F.when(F.col("in_sec") > 1, "h3").otherwise("h2")
    href, title, width = (F.coalesce(K.value_of(F.col("attributes"), a), F.lit("")) for a in ("xlink:href", "xlink:title", "content-type"))
    image = F.concat(F.lit('<img src="'), _quoted(href), F.lit('"'), F.when(title != "", F.concat(F.lit(' alt="'), _quoted(title), F.lit('"'))).otherwise(""), F.when(F.startswith(width, F.lit("width:")), F.concat(F.lit(' data-width="'), _quoted(F.substr(width, F.lit(7))), F.lit('"'))).otherwise(""), F.lit("/>"))
    # A list's end is told from its start: the last list that began at this depth.
    begun = F.last(F.when((name == "list") & (kind == "start"), ordered), ignorenulls=True).over(Window.partitionBy("key", "depth").orderBy("at"))
    rows = rows.withColumn("ordered", begun)
    lone = (name == "p") & (((F.col("of") == "list-item") & (F.col("kids") == 1)) | (F.col("of") == "caption") | ((F.col("of") == "disp-quote") & (F.col("kids") == 1)))
    piece = (
        F.when(kind == "text", F.when((F.col("of").isin(*HOLDERS) | F.col("of").isNull()) & source.rlike(r"^\s*$"), "").otherwise(K.escaped(K.unescaped(source)))).when(kind.isin("raw", "other"), "")
        .when(lone, "").when((name == "title") & (F.col("of") == "sec"), F.when(kind == "start", F.concat(F.lit("<"), level, F.lit(">"))).otherwise(F.concat(F.lit("</"), level, F.lit(">\n"))))
        .when(name == "list", F.when(kind == "start", F.when(F.col("ordered"), "<ol>").otherwise("<ul>")).otherwise(F.when(F.col("ordered"), "</ol>\n").otherwise("</ul>\n")))
        .when(name == "ext-link", F.when(kind == "start", F.concat(F.lit('<a href="'), _quoted(href), F.lit('">'))).otherwise("</a>")).when(name == "graphic", image)
        .when(kind.isin("start", "empty"), opens).otherwise(closes)
    )
    return _joined(rows.select("key", "row", "at", piece.alias("piece"), F.lit(None).cast("string").alias("end")), key, jats, to)
