"""Elements of a page, their attributes and texts, picked by a path of tags, classes and ids.

A page is cut into tokens, which are tags, texts, comments and raw elements such as scripts. One walk over them keeps the open
elements on a stack, so nested elements of one tag close where they should. Void elements hold nothing; an element that is never
closed ends with its parent, and a closing tag without an open element is ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that have no content, and those whose content is no markup.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW = ("script", "style", "textarea", "title")

_TAG = r"""</?[a-zA-Z](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""
_TOKEN = rf"(?is)<!--.*?-->|<({'|'.join(RAW)})\b[^>]*>.*?</\1\s*>|{_TAG}|[^<]++|<"
_ATTRIBUTE = r"""([^\s=/>"'<]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


class Element(NamedTuple):
    """An element of a path: each of the parts given must hold."""

    tag: str | None = None
    klass: str | None = None
    ident: str | None = None


class Markup(NamedTuple):
    """The elements at the end of a path, each somewhere within the one before."""

    path: tuple[Element, ...]


class Attribute(NamedTuple):
    """An attribute of the elements at the end of a path."""

    path: tuple[Element, ...]
    name: str


class Text(NamedTuple):
    """The text of the elements at the end of a path: their own, or with that of all inside."""

    path: tuple[Element, ...]
    own: bool = False


Pick = Markup | Attribute | Text


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def tokens(html: Column) -> Column:
    """The page as an array of texts that are the page again when joined."""
    return F.regexp_extract_all(html, F.lit(_TOKEN), 0)


def attribute(tag: Column, name: str) -> Column:
    """The value of an opening tag's first attribute of that name, quoted or not; empty without a value, null without the attribute."""
    pairs = lambda inside, group: F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), group)

    def value(inside: Column) -> Column:
        at = F.array_position(F.transform(pairs(inside, 1), F.lower), name.lower())
        return once(at, lambda at: F.when(at > 0, F.regexp_replace(F.get(pairs(inside, 2), (at - 1).cast("int")), r"""(?s)^(["'])(.*)\1$""", "$2")))

    return F.when(F.contains(F.lower(tag), F.lit(name.lower())), once(F.regexp_replace(tag, r"^<[^\s/>]+", ""), value))


def _is(token: Column, name: Column, element: Element) -> Column:
    holds = F.lit(True)
    if element.tag:
        holds = holds & (name == element.tag.lower())
    if element.klass:  # most tags have no such word, and need no look at their attributes
        listed = F.array_contains(F.split(F.coalesce(attribute(token, "class"), F.lit("")), r"\s+"), element.klass)
        holds = holds & F.contains(token, F.lit(element.klass)) & listed
    if element.ident:
        holds = holds & F.contains(token, F.lit(element.ident)) & (F.coalesce(attribute(token, "id"), F.lit("")) == element.ident)
    return holds


def _name(token: Column) -> Column:
    """The name of a tag; empty for a text or comment."""
    return F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][^\s/>]*)", 1))


def _whole(token: Column, name: Column) -> Column:
    """A token that is an element by itself; a slash before the bracket closes nothing, as in browsers."""
    return name.isin(*VOID) | F.rlike(token, F.lit("(?s)^<[^/].*</[^<]*>$"))


def spans(parts: Column, path: tuple[Element, ...]) -> Column:
    """``(start, end)`` of the elements at the end of the path, in page order, as places in the array of tokens."""
    last = len(path) - 1
    tags = F.filter(F.transform(parts, lambda x, i: once(_name(x), lambda name: F.struct(
        i.alias("at"), name.alias("name"), F.startswith(x, F.lit("</")).alias("closes"), _whole(x, name).alias("whole"),
        F.when(F.rlike(x, F.lit("^<[a-zA-Z]")), F.array(*[_is(x, name, step) for step in path])).alias("fits")))), lambda t: t["name"] != "")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.array().cast("array<struct<name:string,at:int,hit:boolean,met:int>>").alias("open"), empty.alias("found"))

    def step(state: Column, tag: Column) -> Column:
        held = state["open"]
        above = F.coalesce(F.try_element_at(held, F.lit(-1))["met"], F.lit(0))

        def begun(x: Column) -> Column:
            hit = x["fit"] & (x["above"] >= last)
            met = F.when(x["fit"], F.least(x["above"] + 1, F.lit(last))).otherwise(x["above"])
            entry = F.struct(tag["name"].alias("name"), tag["at"].alias("at"), hit.alias("hit"), met.alias("met"))
            opened = F.struct(F.concat(held, F.array(entry)).alias("open"), state["found"].alias("found"))
            alone = F.when(hit, F.struct(held.alias("open"), F.concat(state["found"], F.array(F.struct(tag["at"].alias("start"), tag["at"].alias("end")))).alias("found"))) \
                .otherwise(state)
            return F.when(tag["whole"], alone).otherwise(opened)

        def ended(back: Column) -> Column:
            keep = F.size(held) - back
            hits = F.transform(F.filter(F.slice(held, keep + 1, back), lambda e: e["hit"]), lambda e: F.struct(e["at"].alias("start"), tag["at"].alias("end")))
            return F.when(back > 0, F.struct(F.slice(held, F.lit(1), keep).alias("open"), F.concat(state["found"], hits).alias("found"))).otherwise(state)

        fit = once(above, lambda above: F.struct(above.alias("above"), F.coalesce(F.get(tag["fits"], F.least(above, F.lit(last))), F.lit(False)).alias("fit")))
        back = F.array_position(F.transform(F.reverse(held), lambda e: e["name"]), tag["name"]).cast("int")
        return F.when(tag["closes"], once(back, ended)).otherwise(once(fit, begun))

    done = F.aggregate(tags, start, step, lambda state: F.concat(state["found"], F.transform(
        F.filter(state["open"], lambda e: e["hit"]), lambda e: F.struct(e["at"].alias("start"), (F.size(parts) - 1).alias("end")))))
    return F.when(F.size(parts) > 0, F.array_sort(done)).otherwise(empty)


def picked(html: Column, what: Pick) -> Column:
    """The markup, attribute or text of every element that is meant, in page order; elements without the attribute are left out."""
    def each(parts: Column, span: Column) -> Column:
        inside = F.slice(parts, span["start"] + 1, span["end"] - span["start"] + 1)
        if isinstance(what, Attribute):
            return attribute(F.get(parts, span["start"]), what.name)
        if isinstance(what, Text):
            return own_text(inside) if what.own else F.array_join(F.filter(inside, lambda x: ~F.startswith(x, F.lit("<"))), "")
        return F.array_join(inside, "")

    found = once(tokens(html), lambda parts: F.transform(spans(parts, what.path), lambda span: each(parts, span)))
    return F.filter(found, lambda x: x.isNotNull()) if isinstance(what, Attribute) else found


def own_text(inside: Column) -> Column:
    """An element's text without that of elements in it, from its tokens."""
    def step(state: Column, x: Column) -> Column:
        change = once(_name(x), lambda name: F.when((name == "") | _whole(x, name), 0).when(F.startswith(x, F.lit("</")), -1).otherwise(1))
        text = F.when((state["depth"] == 1) & ~F.startswith(x, F.lit("<")), F.concat(state["text"], x)).otherwise(state["text"])
        return F.struct((state["depth"] + change).alias("depth"), text.alias("text"))

    return F.aggregate(inside, F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")), step, lambda s: s["text"])
