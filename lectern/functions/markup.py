"""Markup as a stream of events: one regular expression is the tokenizer's states, array expressions do the rest.

`tokens` cuts a text without loss; `events` names each token and splits raw elements (script, style) from their content;
text, attributes, links and what follows a link are read from the events, so a `>` in an attribute, a tag in a comment or
script, CDATA and character references count as what they are. Every pattern is linear: inner repetitions are possessive,
and what never ends is taken to the end of the text.

Defined cases: null gives null; markup that the text's end cuts off is no text; a `<` before anything but a letter, `/`,
`!` or `?` is text; content of script and style is text without character references, as parsers report it.
"""

from __future__ import annotations

import html.entities as entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.wording import let

#: Elements whose content is not parsed, elements without content, elements that begin on a line of their own.
RAW_ELEMENTS = ("script", "style")
VOID_ELEMENTS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

_INSIDE = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+"""
_START = rf"<[a-zA-Z]{_INSIDE}(?:>|\z)"
_RAW = "|".join(rf"<(?i:{e})(?=[\s/>]){_INSIDE}(?<!/)>(?s:.*?)(?=</\s*+(?i:{e})\s*+>|\z)" for e in RAW_ELEMENTS)
LEXER = "|".join((r"<!--(?s:.*?)(?:--\s*+>|\z)", r"<!\[CDATA\[(?s:.*?)(?:\]\s*+\]\s*+>|\z)", _RAW, r"<[!?][^>]*+(?:>|\z)", r"</[^>]*+(?:>|\z)", _START, r"(?:[^<]++|<(?![a-zA-Z/!?]))++"))
_ATTRIBUTE = r"""[^\s/>=][^\s/>=]*+(?:\s*+=[\s=]*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
_REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[^\t\n\f <&#;]{1,32}+;?)"


def tokens(markup: Column) -> Column:
    """Tags, comments, declarations and stretches of text in order; joined, they are the text again."""
    return F.regexp_extract_all(markup, F.lit(LEXER), F.lit(0))


def _event(kind: Column | str, name: Column, source: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), name.alias("name"), source.alias("source"))


def events(markup: Column) -> Column:
    """Structs of kind (start, empty, end, text, raw, other), lower-case name of the element ('' for text) and source."""

    def of(token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, r"^</?\s*([a-zA-Z][^\t\n\r\f />\x00]*)", 1))
        begun = lambda tag: _event(F.when(tag.endswith("/>"), "empty").when(tag.endswith(">"), "start").otherwise("other"), name, tag)
        head = F.regexp_extract(token, f"^{_START}", 0)
        content = F.substr(token, F.char_length(head) + 1)
        raw = F.when(content == "", F.array(begun(head))).otherwise(F.array(begun(head), _event("raw", F.lit(""), content)))
        ended = _event(F.when(token.endswith(">"), "end").otherwise("other"), name, token)
        text = F.array(_event("text", F.lit(""), token))
        return (
            F.when(~token.startswith("<"), text).when(token.rlike(rf"^<(?i:{'|'.join(RAW_ELEMENTS)})[\s/>]"), raw).when(token.rlike("^<[a-zA-Z]"), F.array(begun(token)))
            .when(token.rlike(r"^</\s*[a-zA-Z]"), F.array(ended)).when(token.rlike("^<[!?/]"), F.array(_event("other", F.lit(""), token))).otherwise(text)
        )

    return F.flatten(F.transform(tokens(markup), of))


def _table(names: dict[str, str]) -> Column:
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in names.items())), F.lit("\x01"), F.lit("\x02"))


def _numbered(digits: Column, base: int) -> Column:
    """The character of a number in digits."""
    short = F.regexp_replace(digits, "^0+", "")
    code = F.when(F.char_length(short) > 7, 0x110000).when(short == "", 0).otherwise(F.conv(short, base, 10).cast("int"))
    western = {f"{c}": bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)} | {"13": "\r"}
    among = lambda low, high: (code >= low) & (code <= high)
    nothing = among(1, 8) | among(14, 31) | code.isin(11, 127) | among(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    known = F.try_element_at(_table(western), code.cast("string"))
    return F.when(known.isNotNull(), known).when((code == 0) | among(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd").when(nothing, "").otherwise(char)


def _decoded(reference: Column) -> Column:
    name = F.substr(reference, F.lit(2))
    bare = sorted((k for k in entities.html5 if not k.endswith(";")), key=len, reverse=True)
    start = F.regexp_extract(name, f"^(?:{'|'.join(bare)})", 0)
    table = _table(entities.html5)
    named = F.coalesce(F.try_element_at(table, name), F.when(start != "", F.concat(F.try_element_at(table, start), F.substr(name, F.char_length(start) + 1))), reference)
    hexes, digits = F.regexp_extract(name, "^#[xX]([0-9a-fA-F]+)", 1), F.regexp_extract(name, "^#([0-9]+)", 1)
    return F.when(digits != "", _numbered(digits, 10)).when(hexes != "", _numbered(hexes, 16)).otherwise(named)


def unescaped(text: Column) -> Column:
    """text with its character references replaced: numbers, all names, and names without semicolon by their longest known start."""

    def of(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(rf"{_REFERENCE}|[^&]++|&"), F.lit(0))
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(0)))
        meanings = let(found, lambda x: F.map_from_arrays(x, F.transform(x, _decoded)))
        replaced = let(meanings, lambda m: F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(m, p), p)), ""))
        return F.when(F.instr(t, "&") == 0, t).otherwise(replaced)

    # The text may be a long expression: it is worked out once.
    return let(text, of)


def without_marks(text: Column) -> Column:
    """text without the noncharacters that flattened streams are marked with."""
    return F.regexp_replace(text, "[\ufdd0-\ufdd6]", "")


def plain_text(markup: Column) -> Column:
    """What a parser reports as data, joined."""
    return _data(events(markup))


def _data(stream: Column) -> Column:
    """The text of a stream of events."""
    data = F.filter(stream, lambda e: e["kind"].isin("text", "raw"))
    # References are replaced once for the whole text: a noncharacter ends each stretch, so none runs across a tag.
    def marked(e: Column) -> Column:
        return F.concat(F.when(e["kind"] == "raw", F.replace(e["source"], F.lit("&"), F.lit("\ufdd1"))).otherwise(e["source"]), F.lit("\ufdd0;"))

    joined = F.array_join(F.transform(data, marked), "")
    return F.replace(F.replace(unescaped(joined), F.lit("\ufdd0;"), F.lit("")), F.lit("\ufdd1"), F.lit("&"))


def _pairs(tag: Column, decoded: bool) -> Column:
    inner = F.regexp_replace(tag, r"^<[a-zA-Z][^\t\n\r\f />\x00]*+", "")

    def of(pair: Column) -> Column:
        value = F.regexp_replace(F.regexp_replace(pair, r"^[^\s=]+\s*=*[\s=]*", ""), r"""(?s)^(["'])(.*)\1$""", "$2")
        return F.struct(F.lower(F.regexp_extract(pair, r"^[^\s=]+", 0)).alias("name"), (unescaped(value) if decoded else value).alias("value"))

    return F.transform(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(0)), of)


def attributes(tag: Column) -> Column:
    """Structs of name (lower case) and value of a start tag's attributes in order, references replaced; the value is '' where there is none."""
    return _pairs(tag, True)


def value_of(found: Column, name: str) -> Column:
    """Value of the first attribute of that name among those of `attributes`; null if there is none."""
    return F.get(F.filter(found, lambda a: a["name"] == name), F.lit(0))["value"]


def attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute of that name in a start tag; '' for one without value, null if there is none."""
    return value_of(attributes(tag), name)


#: Marks inside a flattened stream: a tag, the end of a link, the end of its address.
_TAG, _LINK, _ADDRESS = "\ufdd2", "\ufdd3", "\ufdd4"
_MARKS = f"{_TAG}|{_LINK}[^{_ADDRESS}]*+{_ADDRESS}"


def links(markup: Column) -> Column:
    """Structs of the href and label of each link that is closed, and the word that its end runs into ('' where space, or nothing, follows).

    Tags between the end of a link and the next text don't separate words, as a text extractor drops them. The stream is
    flattened to text with marks, an address is moved behind its label, and runs of marks are zipped with the text after them.
    """
    plain = without_marks

    def flat(t: Column) -> Column:
        address = F.concat(F.lit("\ufdd0"), plain(F.coalesce(value_of(_pairs(t, False), "href"), F.lit(""))), F.lit("\ufdd1"))
        # Content of raw elements has no references: its ampersands are put aside.
        raw = F.concat(F.lit(_TAG), F.replace(plain(F.regexp_replace(t, f"^{_START}", "")), F.lit("&"), F.lit("\ufdd6")))
        return (
            F.when(~t.startswith("<") | ~t.rlike("^<[a-zA-Z/!?]"), plain(t)).when(t.rlike(r"^<[aA][\s/>]") & ~t.rlike(r"/>$|[^>]$"), address).when(t.rlike(r"^</\s*[aA](?:\s[^>]*)?>$"), "\ufdd5")
            .when(t.rlike(rf"^<(?i:{'|'.join(RAW_ELEMENTS)})[\s/>]"), raw).otherwise(F.lit(_TAG))
        )

    # References are replaced once for the whole stream, addresses and labels alike; none decodes to a mark.
    stream = F.replace(unescaped(F.array_join(F.transform(tokens(markup), flat), "")), F.lit("\ufdd6"), F.lit("&"))
    moved = F.regexp_replace(stream, "\ufdd0([^\ufdd1]*+)\ufdd1([^\ufdd0\ufdd5]*+)\ufdd5", f"{_TAG}$2{_LINK}$1\ufdd0$2{_ADDRESS}")
    moved = F.regexp_replace(moved, "\ufdd0[^\ufdd1\ufdd4]*+\ufdd1|\ufdd5", _TAG)
    def of(run: Column, following: Column) -> Column:
        ended = F.regexp_extract_all(run, F.lit(f"{_LINK}([^{_ADDRESS}]*+){_ADDRESS}"), F.lit(1))
        word = F.regexp_extract(following, r"^\S+", 0)
        parts = lambda x: F.struct(F.substring_index(x, "\ufdd0", 1).alias("href"), F.replace(F.substring_index(x, "\ufdd0", -1), F.lit(_TAG), F.lit("")).alias("label"))
        return F.transform(ended, lambda x: F.struct(parts(x)["href"].alias("href"), parts(x)["label"].alias("label"), word.alias("run_on")))

    def zipped(m: Column) -> Column:
        runs, after = F.regexp_extract_all(m, F.lit(f"(?:{_MARKS})++"), F.lit(0)), F.split(m, f"(?:{_MARKS})++")
        return F.flatten(F.zip_with(runs, let(after, lambda a: F.slice(a, F.lit(2), F.size(a))), of))

    return let(moved, zipped)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


#: A start tag that XML can hold as it is; what XML can't hold as a name; an ampersand that begins no reference of XML.
_XML_REFERENCE = r"&(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);"
_FAIR = re.compile(rf"""<[a-zA-Z_][\w.-]*(?:\s+[a-zA-Z_][\w.:-]*\s*=\s*(?:"(?:[^"<&]|{_XML_REFERENCE})*"|'(?:[^'<&]|{_XML_REFERENCE})*'))*\s*/?>""", re.ASCII)
_NAME = re.compile(r"[a-zA-Z_][\w.-]*", re.ASCII)
_AMPERSAND = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);)([a-zA-Z][a-zA-Z0-9]*;)?")
_PAIR = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=[\s=]*("[^"]*"|'[^']*'|[^\s>]*))?""")


def _fit(text: str, names: bool = True) -> str:
    """text as XML can hold it; names that only HTML has become characters, but not in raw content."""

    def known(m: re.Match) -> str:
        char = entities.html5.get(m[1]) if names and m[1] else None
        return f"&amp;{m[1] or ''}" if char is None else char.replace("&", "&amp;")

    return _AMPERSAND.sub(known, text).replace("<", "&lt;").replace("]]>", "]]&gt;")


def _start_tag(source: str, written: str, empty: bool) -> str:
    """A start tag with quoted attributes, the first of each name."""
    if _FAIR.fullmatch(source) and source.endswith("/>") == empty:
        return source
    pairs: dict[str, str] = {}
    for name, value in _PAIR.findall(source[1 + len(written):]):
        if _NAME.fullmatch(name.replace(":", "", 1)):
            pairs.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value)
    attributes = "".join(' {}="{}"'.format(k, _fit(v).replace('"', "&quot;")) for k, v in pairs.items())
    return f"<{written}{attributes}{'/>' if empty else '>'}"


def _nested(stream: list[dict], void: frozenset[str]) -> str:
    """The stack automaton over the events of one text."""
    out: list[str] = []
    stack: list[tuple[str, str]] = []
    open_of: dict[str, int] = {}
    for e in stream:
        kind, name, source = e["kind"], e["name"], e["source"]
        if kind in ("text", "raw"):
            out.append(_fit(source, kind == "text"))
        elif kind in ("start", "empty", "end") and _NAME.fullmatch(name):
            written = source.lstrip("</ \t\n\r\f")[: len(name)]
            if kind != "end":
                empty = kind == "empty" or name in void
                out.append(_start_tag(source, written, empty))
                if not empty:
                    stack.append((name, written))
                    open_of[name] = open_of.get(name, 0) + 1
            elif open_of.get(name):
                while True:
                    inner, as_written = stack.pop()
                    open_of[inner] -= 1
                    out.append(source if inner == name and source == f"</{as_written}>" else f"</{as_written}>")
                    if inner == name:
                        break
    return "".join(out + [f"</{written}>" for _, written in reversed(stack)])


def balanced(markup: Column, void: tuple[str, ...] = VOID_ELEMENTS) -> Column:
    """markup as a well-formed fragment: an end closes what was opened after its start, an end without start goes, what is open at the end is closed.

    Elements in `void` are written as empty ones. Comments, declarations, cut-off tags and tags whose name XML can't hold
    are left out. A fragment that is well-formed and holds none of these stays as it is. The tokenizer is native; only the
    stack is a Python function.
    """
    kinds = frozenset(void)

    @F.pandas_udf("string")
    def nested(rows: pd.Series) -> pd.Series:
        return pd.Series([None if row is None else _nested(row, kinds) for row in rows], dtype=object)

    return nested(events(markup))


# ------------------------------------------------------------------------------------------------ links to the resolver

RESOLVER = r"(?i)^https?://(?:dx\.)?doi\.org/"


def _resolved(html: Column) -> Column:
    return F.transform(F.filter(links(html), lambda x: x["href"].rlike(RESOLVER)), lambda x: F.struct(F.regexp_replace(x["href"], RESOLVER, "").alias("doi"), x["run_on"].alias("follows")))


def doi_links(html: Column) -> Column:
    """Identifiers that links to the resolver name, in order."""
    return F.transform(_resolved(html), lambda x: x["doi"])


def run_on_links(html: Column) -> Column:
    """(doi, follows): links to the resolver whose next text stands right behind the link; tags in between part nothing."""
    return F.filter(_resolved(html), lambda x: x["follows"] != "")


def _between(stream: Column, opens, name: str, content) -> Column:
    """content(markup) of each element `name` (with or without prefix) that opens() takes, in a stream of events; the markup is that up to its first end."""
    # Attributes are read of elements of that name only.
    begun = lambda e: (e["kind"] == "start") & e["name"].rlike(f"^(?:.*:)?{name}$") & opens(e)
    marked = F.transform(stream, lambda e: F.concat(F.when(begun(e), "\ufdd0").when((e["kind"] == "end") & e["name"].rlike(f"^(?:.*:)?{name}$"), "\ufdd1").otherwise(""), without_marks(e["source"])))
    inner = lambda parts: F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: let(F.substring_index(x, "\ufdd1", 1), content))
    return let(F.split(F.array_join(marked, ""), "\ufdd0"), inner)


def reference_dois(jats: Column) -> Column:
    """Structs of each reference's text, the identifiers that it states (pub-id of type doi) and those that its text links to."""
    doi = lambda e: F.lower(attribute(e["source"], "pub-id-type")) == "doi"

    def told(stream: Column) -> Column:
        return let(_data(stream), lambda said: F.struct(
            F.trim(F.regexp_replace(said, r"\s+", " ")).alias("text"),
            _between(stream, doi, "pub-id", lambda x: F.regexp_replace(plain_text(x), r"^\s+|\s+$", "")).alias("stated"),
            F.regexp_extract_all(said, F.lit(r"(?i)https?://(?:dx\.)?doi\.org/(\S+)"), F.lit(1)).alias("linked"),
        ))

    return _between(events(jats), lambda e: F.lit(True), "ref", lambda r: let(events(r), told))
