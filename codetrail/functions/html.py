"""HTML read as a parser does: tokens, the stack of open elements, entities.

``with_tokens`` cuts the text of a page into tokens once; a comment, or a script with its content, is one token, so nothing
inside it is taken for a tag.  ``with_links`` walks the tokens with the open elements as state: an end tag closes the
innermost element of its name and what is open inside it (or nothing), a list entry, cell, row or paragraph ends where its
next sibling starts, and elements without content are never open.  Everything is one pass over the page's row and built-in
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrail.functions.arrays import bound, scan, with_once

# Fixed values of the HTML standard: elements without content, elements whose content is text only, inline elements (their
# tags don't separate words), and what the start of an element ends: the names, and the names that it doesn't reach beyond.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
TEXT_ONLY = ("script", "style", "textarea", "title")
INLINE = ("a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "font", "i", "img", "kbd", "mark", "q", "s", "samp", "small", "span",
          "strong", "sub", "sup", "tt", "u", "var")
ENDS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
        "option": (("option",), ("select",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
        "tr": (("tr",), ("table",)), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead"), ("table",)),
        "a": (("a",), ("table", "td", "th")), "p": (("p",), ("div", "td", "th", "li", "button", "table")),
        "div": (("p",), ("div", "td", "th", "li", "button", "table")), "table": (("p",), ("div", "td", "th", "li", "button", "table")),
        "ul": (("p",), ("div", "td", "th", "li", "button", "table"))}
# Named characters.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®",
         "laquo": "«", "raquo": "»", "middot": "·", "ndash": "–", "mdash": "—", "hellip": "…", "bull": "•"}

_INSIDE = r"""(?:"[^"]*+"|'[^']*+'|[^'">]++)*+"""
_TOKEN = (rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(TEXT_ONLY)})\b{_INSIDE}>.*?(?:</\1\s*>|\z)|<[!?][^>]*>"
          rf"|</?[a-z]{_INSIDE}>|</?[a-z][^>]*>|[^<]++|<")
_ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


def _characters(code: Column) -> Column:
    """The text of a code point; the replacement character where there is none."""
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    point = F.when(valid, code).otherwise(F.lit(0xFFFD)).cast("long")
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def decoded(text: Column) -> Column:
    """``text`` with its entities as characters; what isn't an entity stays."""
    known = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);?", 1)
        rest = F.regexp_replace(p, r"^(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);?", "")
        number = F.when(F.lower(name).startswith("#x"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7))
        return (F.when(name.startswith("#"), F.concat(_characters(number.try_cast("long")), rest))
                .when(F.element_at(known, name).isNotNull(), F.concat(F.element_at(known, name), rest))
                .otherwise(F.concat(F.lit("&"), p)))

    parts = F.split(text, "&")
    whole = bound(parts, lambda x: F.concat(x[0], F.array_join(F.transform(F.slice(x, F.lit(2), F.size(x)), piece), "")))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def _value(tag: Column, name: str) -> Column:
    """The first attribute of that name of a tag, decoded; '' where it is missing."""
    inner = F.regexp_replace(tag, r"(?is)^<[a-z][^\s/>]*|/?>$", "")
    names = F.transform(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), 1), F.lower)
    values = F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), 2)
    raw = F.coalesce(F.get(values, F.array_position(names, name).cast("int") - 1), F.lit(""))
    return decoded(F.regexp_replace(raw, r"""(?s)^(["'])(.*)\1$""", "$2"))


def with_tokens(df: DataFrame, html: str = "html", out: str = "_tokens") -> DataFrame:
    """``out``: array<struct<at, kind, name, raw>>; kind is open, close, text or other (comments, scripts, declarations)."""
    def token(raw: Column, at: Column) -> Column:
        name = F.lower(F.regexp_extract(raw, r"^</?([A-Za-z][^\s/>]*)", 1))
        kind = (F.when(name == "", F.when(raw.rlike("^<[!?]"), F.lit("other")).otherwise(F.lit("text")))
                .when(name.isin(*TEXT_ONLY), F.lit("other")).when(raw.startswith("</"), F.lit("close")).otherwise(F.lit("open")))
        return F.struct(at.alias("at"), kind.alias("kind"), name.alias("name"), raw.alias("raw"))

    return with_once(df, out, F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_TOKEN), 0), token))


_ELEMENT = "struct<name:string,at:int,main:boolean,under:boolean,entry:boolean,child:boolean>"
_STATE = f"struct<open:array<{_ELEMENT}>,link:int,row:int,main:boolean,child:boolean>"
_KEPT = "array<struct<link:int,row:int,main:boolean,child:boolean>>"


def _last_of(open_: Column, names: Column | tuple[str, ...]) -> Column:
    """The 1-based place of the innermost open element of these names, 0 where there is none."""
    is_it = (lambda e: e["name"].isin(*names)) if isinstance(names, tuple) else (lambda e: e["name"] == names)
    back = F.array_position(F.transform(F.reverse(open_), is_it), True)
    return F.when(back > 0, F.size(open_) + 1 - back).otherwise(0).cast("int")


def _walk(main_id: str, entry_class: str):
    def ended(open_: Column, name: Column) -> Column:
        keep = F.size(open_)
        for start, (names, limits) in ENDS.items():
            at = _last_of(open_, names)
            keep = F.when((name == start) & (at > _last_of(open_, limits)), at - 1).otherwise(keep)
        return F.slice(open_, F.lit(1), keep)

    def step(state: Column, t: Column) -> Column:
        def opened(open_: Column) -> Column:
            parent = F.try_element_at(open_, F.lit(-1))
            under = F.coalesce(parent["main"] | parent["under"], F.lit(False))
            classes = F.split(F.trim(_value(t["raw"], "class")), r"\s+")
            element = F.struct(t["name"].alias("name"), t["at"].alias("at"), (_value(t["raw"], "id") == main_id).alias("main"),
                               under.alias("under"), (under & F.array_contains(classes, entry_class)).alias("entry"),
                               F.coalesce(parent["entry"], F.lit(False)).alias("child"))
            return F.concat(open_, F.array(element))

        def closed(open_: Column) -> Column:
            at = _last_of(open_, t["name"])
            return F.when(at > 0, F.slice(open_, F.lit(1), at - 1)).otherwise(open_)

        void = t["name"].isin(*VOID)
        after = (F.when((t["kind"] == "open") & ~void, bound(ended(state["open"], t["name"]), opened))
                 .when((t["kind"] == "close") & ~void, closed(state["open"])).otherwise(state["open"]))

        def shown(open_: Column) -> Column:
            inner = F.try_element_at(open_, F.lit(-1))
            link, row = (F.coalesce(F.get(open_, _last_of(open_, n) - 1)["at"], F.lit(-1)) for n in (("a",), ("tr",)))
            return F.struct(open_.alias("open"), link.alias("link"), row.alias("row"),
                            F.coalesce(inner["main"] | inner["under"], F.lit(False)).alias("main"),
                            F.coalesce(inner["child"], F.lit(False)).alias("child")).cast(_STATE)
        return F.when(t["kind"].isin("open", "close") & ~void, bound(after, shown)).otherwise(state)
    return step


def _plain(tokens: Column) -> Column:
    """The text of tokens: white space as single blanks, a blank at tags of block elements, entities decoded."""
    def part(t: Column) -> Column:
        return (F.when(t["kind"] == "text", t["raw"]).when(t["kind"].isin("open", "close") & ~t["name"].isin(*INLINE), F.lit(" "))
                .otherwise(F.lit("")))
    text = decoded(F.array_join(F.transform(tokens, part), ""))
    return F.regexp_replace(F.regexp_replace(text, r"[\s\x{A0}]+", " "), "^ | $", "")


def with_links(df: DataFrame, main_id: str, entry_class: str, html: str = "html") -> DataFrame:
    """``df`` with

    * ``_links``: array<struct<href, text, title, classes, main, child, row, at>> of the ``a`` elements in document order:
      whether one stands in the element with ``main_id``, whether it is a direct child of an element of ``entry_class`` in
      there, the table row it stands in (a token's number, or -1) and its own token's number;
    * ``_main``: array<struct<at, text>> of the texts in the main element.
    """
    x = with_tokens(df, html)
    start = F.struct(F.array().cast(f"array<{_ELEMENT}>").alias("open"), F.lit(-1).alias("link"), F.lit(-1).alias("row"),
                     F.lit(False).alias("main"), F.lit(False).alias("child")).cast(_STATE)
    kept = scan(F.col("_tokens"), _walk(main_id, entry_class), start,
                lambda s: F.struct(s["link"].alias("link"), s["row"].alias("row"), s["main"].alias("main"), s["child"].alias("child")),
                F.array().cast(_KEPT))
    x = with_once(x, "_states", kept)
    states, tokens = F.col("_states"), F.col("_tokens")
    # a link reaches from where the innermost open link becomes it to where it next changes
    changes = F.filter(F.transform(states, lambda s, i: F.when(
        s["link"] != F.coalesce(F.get(states, i - 1)["link"], F.lit(-1)), i)), lambda i: i.isNotNull())
    x = with_once(x, "_changes", F.concat(changes, F.array(F.size("_states"))))
    spans = F.transform(F.slice("_changes", F.lit(1), F.size("_changes") - 1), lambda a, k: F.struct(
        a.alias("a"), F.get("_changes", k + 1).alias("z")))
    starts = F.filter(spans, lambda s: F.get(states, s["a"])["link"] == s["a"])

    def link(s: Column) -> Column:
        tag, state = F.get(tokens, s["a"])["raw"], F.get(states, s["a"])
        return F.struct(_value(tag, "href").alias("href"), _plain(F.slice(tokens, s["a"] + 2, s["z"] - s["a"] - 1)).alias("text"),
                        _value(tag, "title").alias("title"), F.split(F.trim(_value(tag, "class")), r"\s+").alias("classes"),
                        state["main"].alias("main"), state["child"].alias("child"), state["row"].alias("row"), s["a"].alias("at"))

    x = with_once(x, "_links", F.transform(starts, link))
    inside = F.filter(F.transform(tokens, lambda t, i: F.when(
        (t["kind"] == "text") & F.get(states, i)["main"], F.struct(i.alias("at"), _plain(F.array(t)).alias("text")))),
        lambda t: t.isNotNull())
    return x.withColumn("_main", inside).drop("_tokens", "_changes")


def rows_after(states: str, at: Column) -> Column:
    """The first table row that starts after a token in the main element: its token's number, or null."""
    return F.array_min(F.filter(F.transform(F.col(states), lambda s: F.when((s["row"] > at) & s["main"], s["row"])),
                                lambda r: r.isNotNull()))
