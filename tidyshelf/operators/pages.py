"""Typed records from a table of pages ``(page_id, url, html)``.

Pages of one site share a template. What it picks is given by regular expressions over the whole text, or by paths of
elements, which follow nesting and read attributes in any order and quoting; both are native. The defaults are those of a photo
gallery: ``GALLERY`` has the expressions, which fit pages that are all made alike, ``NESTED`` the paths.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf.functions.markup import Attribute, Element, Markup, Pick, Text, once, picked
from tidyshelf.functions.text import literal_map, strip, strip_to_int, trailing_int, unescape_html
from tidyshelf.operators.graph import reachable


class Template(NamedTuple):
    """Patterns with one group each, or paths; block patterns capture the whole block. Fixed values."""

    heading: str | Pick = r'(?s)id="gallerytitle".*?<h2[^>]*>(.*?)</h2>'
    inner: str = r"(?s)<(\w+)[^>]*>.*</\1>"
    crumb: str | Pick = r'(?s)<span[^>]*>\s*<a[^>]*>([^<]*)</a>'
    crumb_area: str = r'(?s)id="gallerytitle".*?<h2[^>]*>(.*?)</h2>'
    album: str | Pick = r'(?s)(<div class="album".*?)(?=<div class="album"|<div class="image"|<div class="pagelist"|$)'
    image: str | Pick = r'(?s)(<div class="image".*?)(?=<div class="image"|<div class="album"|<div class="pagelist"|$)'
    item_link: str | Pick = r'(?s)class="albumdesc".*?<a[^>]*href="([^"]*)"'
    next_link: str | Pick = r'(?s)class="next".*?<a[^>]*href="([^"]*)"'
    text: str | Pick = r"(?s)<a[^>]*>\s*([^<]+?)\s*</a>"
    title: str | Pick = r'<a[^>]*\btitle="([^"]*)"'
    alt: str | Pick = r'<img[^>]*\balt="([^"]*)"'
    src: str | Pick = r'<img[^>]*\bsrc="([^"]*)"'


GALLERY = Template()
_HEADING = (Element(ident="gallerytitle"), Element("h2"))
NESTED = Template(
    heading=Text(_HEADING, own=True), crumb=Text((*_HEADING, Element("span"), Element("a")), own=True),
    album=Markup((Element("div", "album"),)), image=Markup((Element("div", "image"),)),
    item_link=Attribute((Element(klass="album"), Element(klass="albumdesc"), Element("a")), "href"),
    next_link=Attribute((Element(klass="pagelist"), Element(klass="next"), Element("a")), "href"),
    text=Text((Element("a"),)), title=Attribute((Element("a"),), "title"),
    alt=Attribute((Element("img"),), "alt"), src=Attribute((Element("img"),), "src"))


def all_matches(text: Column, pattern: str | Pick) -> Column:
    """All that the pattern or path finds, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), 1) if isinstance(pattern, str) else picked(text, pattern)


def first_match(text: Column, pattern: str | Pick) -> Column:
    """The first that is found, trimmed and unescaped; null if there is none. A link without any text has no first text."""
    found = all_matches(text, pattern)
    if isinstance(pattern, Text):
        found = F.filter(found, lambda x: strip(x) != "")
    first = F.try_element_at(found, F.lit(1))
    return strip(unescape_html(first)) if isinstance(pattern, str) else once(first, lambda x: strip(unescape_html(x)))


def page_section(html: Column, t: Template = GALLERY) -> Column:
    """The heading's own text, without the text of elements inside it; empty without a heading."""
    if not isinstance(t.heading, str):
        return once(F.array_join(picked(html, t.heading), ""), lambda x: strip(unescape_html(x)))
    return strip(unescape_html(F.regexp_replace(F.regexp_extract(html, t.heading, 1), t.inner, "")))


def page_breadcrumbs(html: Column, t: Template = GALLERY) -> Column:
    """Ordered list of trimmed crumb texts."""
    area = F.regexp_extract(html, t.crumb_area, 1) if isinstance(t.crumb, str) else html
    return F.transform(all_matches(area, t.crumb), lambda c: strip(unescape_html(c)))


def crumb(k: int) -> Column:
    """The k-th crumb from the end, null on shorter lists."""
    return F.try_element_at(F.col("crumbs"), F.lit(-k))


def read_pages(pages: DataFrame, t: Template = GALLERY) -> DataFrame:
    """Adds ``section`` and ``crumbs``, which every extraction below starts from."""
    return pages.withColumns({"section": page_section(F.col("html"), t), "crumbs": page_breadcrumbs(F.col("html"), t)})


def page_links(pages: DataFrame, t: Template = GALLERY) -> DataFrame:
    """Edges ``(page_id, kind, pos, target)`` in page order, item links and next-page links apart."""
    def edges(kind: str, pattern: str | Pick) -> Column:
        found = all_matches(F.col("html"), pattern)
        return F.transform(found, lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("pos"), unescape_html(x).alias("target")))

    both = F.concat(edges("item", t.item_link), edges("next", t.next_link))
    return pages.select("page_id", F.inline(both))


def resolve_link(base: Column, link: Column) -> Column:
    """A link as written on the page at ``base``, as an absolute address without a fragment (RFC 3986, section 5.2).

    Both are trimmed. A null base or link gives null; so does a base without a scheme, unless the link has one.
    """
    part = lambda x, i: F.regexp_extract(strip(x), r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?:(//)([^/?#]*))?([^?#]*)(?:(\?)([^#]*))?", i)
    has = lambda x, i: part(x, i) != ""
    base_path, path = part(base, 4), part(link, 4)
    merged = F.when(has(base, 2) & (base_path == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_extract(base_path, "(?s)^(.*/)?", 1), path))
    own = has(link, 1) | has(link, 2)
    walked = F.when(own | F.startswith(path, F.lit("/")), without_dots(path)).when(path == "", base_path).otherwise(without_dots(merged))
    query = F.when(own | (path != "") | has(link, 5), F.concat(part(link, 5), part(link, 6))).otherwise(F.concat(part(base, 5), part(base, 6)))
    host = F.when(own, F.concat(part(link, 2), part(link, 3))).otherwise(F.concat(part(base, 2), part(base, 3)))
    scheme = F.when(has(link, 1), part(link, 1)).when(has(base, 1), part(base, 1))
    return F.concat(F.lower(scheme), F.lit(":"), host, walked, query)


def without_dots(path: Column) -> Column:
    """A path without its segments "." and "..", which take the segment before them away."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    rooted = F.startswith(path, F.lit("/"))
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda out, x: F.when(x == ".", out).when(x != "..", F.concat(out, F.array(x)))
        .when(rooted & (F.size(out) <= 1), out).otherwise(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))))
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))


def page_graph(pages: DataFrame, t: Template = GALLERY, url: str = "url") -> DataFrame:
    """``page_links`` with ``address``, the absolute address of each target, and ``target_id``, the page that has it, if any.

    Of several pages with one address the least id counts; a page's own fragment is no part of its address.
    """
    links = page_links(pages, t).join(pages.select("page_id", F.col(url).alias("_base")), "page_id")
    links = links.withColumn("address", resolve_link(F.col("_base"), F.col("target"))).drop("_base")
    known = pages.groupBy(resolve_link(F.col(url), F.lit("")).alias("address")).agg(F.min("page_id").alias("target_id"))
    return links.join(known, "address", "left")


def page_depths(pages: DataFrame, roots: DataFrame, t: Template = GALLERY, url: str = "url") -> DataFrame:
    """``(page_id, depth)`` of the pages that links lead to from the roots, a table of page ids, which are at depth 0."""
    links = page_graph(pages, t, url).select("page_id", "target_id")
    return reachable(roots, links, "page_id", "target_id").select(F.col("node").alias("page_id"), "depth")


def route_pages(pages: DataFrame, rules: Sequence[tuple[str, Column]], out: str = "route") -> DataFrame:
    """Name of the first rule that holds, null for pages whose links are only followed.

    Rules are predicates over ``section`` and ``crumb(k)``; one over a missing crumb does not hold.
    """
    route = F.lit(None).cast("string")
    for name, holds in reversed(list(rules)):
        route = F.when(holds, F.lit(name)).otherwise(route)
    return pages.withColumn(out, route)


def page_blocks(pages: DataFrame, pattern: str | Pick, *keep: str) -> DataFrame:
    """One row per repeated block with its position; ``section``, ``crumbs`` and ``keep`` stay at hand."""
    return pages.select("page_id", "section", "crumbs", *keep,
                        F.posexplode(all_matches(F.col("html"), pattern)).alias("pos", "block"))


def page_items(pages: DataFrame, kind: str, t: Template = GALLERY, name: str | Pick | None = None,
               source: Column | None = None, blocks: str | Pick | None = None, **extra: Column) -> DataFrame:
    """One record per image block: type, name, image, and source when given.

    ``name`` is a pattern and defaults to the image's alternative text; ``extra`` columns may use
    ``section``, ``crumb(k)`` and ``name``.
    """
    rows = page_blocks(pages, blocks or t.image).select(
        "page_id", "pos", "section", "crumbs", F.lit(kind).alias("type"),
        first_match(F.col("block"), name or t.alt).alias("name"), first_match(F.col("block"), t.src).alias("image"))
    if source is not None:
        rows = rows.withColumn("source", source)
    return rows.withColumns(extra).drop("section", "crumbs") if extra else rows.drop("section", "crumbs")


def source_items(pages: DataFrame, kind: str, t: Template = GALLERY) -> DataFrame:
    """Items whose source is the last crumb."""
    return page_items(pages, kind, t, source=crumb(1))


def titled_items(pages: DataFrame, kind: str, t: Template = GALLERY) -> DataFrame:
    """Items named by the link's title, without a source."""
    return page_items(pages, kind, t, name=t.title)


def tiered_items(pages: DataFrame, kind: str, t: Template = GALLERY, number: Column | None = None) -> DataFrame:
    """Source one crumb up; the tier is the last number of the heading (or of ``number``)."""
    return page_items(pages, kind, t, source=crumb(2), tier=trailing_int(F.col("section") if number is None else number))


def section_items(pages: DataFrame, kind: str, out: str, t: Template = GALLERY) -> DataFrame:
    """Source one crumb up; the heading is kept as a column."""
    return page_items(pages, kind, t, source=crumb(2), **{out: F.col("section")})


def parent_items(pages: DataFrame, kind: str, t: Template = GALLERY) -> DataFrame:
    """Source one crumb up."""
    return page_items(pages, kind, t, source=crumb(2))


def sentinel_items(pages: DataFrame, kind: str, out: str, marker: str, sentinel: str, t: Template = GALLERY) -> DataFrame:
    """Under a marked heading the last crumb is the source and, behind the sentinel, also the group;
    elsewhere the source is one crumb up and the heading is the group."""
    marked = F.startswith(F.col("section"), F.lit(marker))
    group = F.when(marked, F.concat(F.lit(sentinel), crumb(1))).otherwise(F.col("section"))
    return page_items(pages, kind, t, source=F.when(marked, crumb(1)).otherwise(crumb(2)), **{out: group})


def branch_items(pages: DataFrame, kind: str, out: str, branch: str, t: Template = GALLERY) -> DataFrame:
    """The third crumb from the end decides: inside the branch the last crumb is the source and there is
    no group, elsewhere the source is one crumb up and the heading is the group."""
    inside = F.coalesce(F.startswith(crumb(3), F.lit(branch)), F.lit(False))
    return page_items(pages, kind, t, source=F.when(inside, crumb(1)).otherwise(crumb(2)),
                      **{out: F.when(~inside, F.col("section"))})


def pivot_by_suffix(pages: DataFrame, suffixes: Sequence[str], t: Template = GALLERY,
                    source: int = 2) -> tuple[DataFrame, DataFrame]:
    """Parents and children: blocks named with a suffix become columns of the page's one parent record,
    the last of each winning; all other blocks become children keyed by the parent's name.

    The columns are picked inside each page's own block list, so nothing is shuffled.
    """
    def named(block: Column) -> Column:
        return F.struct(first_match(block, t.alt).alias("name"), first_match(block, t.src).alias("image"))

    def matches(item: Column, suffix: str) -> Column:
        return F.coalesce(F.endswith(F.lower(item["name"]), F.lit(suffix)), F.lit(False))

    items = F.transform(all_matches(F.col("html"), t.image), named)
    base = pages.select("page_id", F.col("section").alias("name"), crumb(source).alias("source"), items.alias("items"))

    def last_image(suffix: str) -> Column:
        hits = F.filter("items", lambda x: matches(x, suffix))
        return F.try_element_at(hits, F.lit(-1))["image"].alias(suffix)

    columns = [last_image(suffix) for suffix in suffixes]
    parents = base.select("page_id", "name", "source", *columns)
    plain = F.filter(F.transform("items", lambda x, i: F.struct(i.alias("pos"), x.alias("item"))),
                     lambda x: ~_any([matches(x["item"], s) for s in suffixes]))
    children = base.select("page_id", F.col("name").alias("parent"), F.explode(plain).alias("c")).select(
        "page_id", "parent", "c.pos", "c.item.name", "c.item.image")
    return parents, children


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def album_titles(html: Column, t: Template = GALLERY) -> Column:
    """First link text of each album, in order."""
    return F.transform(all_matches(html, t.album), lambda b: first_match(b, t.text))


def root_source(pages: DataFrame, name: str, kind: str, t: Template = GALLERY) -> DataFrame:
    """One fixed record per root page."""
    return pages.select("page_id", F.lit(0).alias("pos"), F.lit(name).alias("name"), F.lit(kind).alias("type"),
                        F.lit(None).cast("bigint").alias("wave"),
                        first_match(F.try_element_at(all_matches(F.col("html"), t.album), F.lit(1)), t.src).alias("image"))


def album_sources(pages: DataFrame, kind: str, t: Template = GALLERY) -> DataFrame:
    """One source per album."""
    return page_blocks(pages, t.album).select(
        "page_id", "pos", first_match(F.col("block"), t.text).alias("name"), F.lit(kind).alias("type"),
        F.lit(None).cast("bigint").alias("wave"), first_match(F.col("block"), t.src).alias("image"))


def pack_sources(pages: DataFrame, marker: str, if_any: str, if_none: str, wave_words: Sequence[str],
                 fallbacks: Mapping[str, str], t: Template = GALLERY) -> DataFrame:
    """One source per page: its kind by whether any album has the marker title, its wave from the last
    crumb, its image from the first image block that has one or else by heading."""
    has_marker = F.coalesce(F.exists(album_titles(F.col("html"), t), lambda x: x == marker), F.lit(False))
    return pages.select(
        "page_id", F.lit(0).alias("pos"), F.col("section").alias("name"),
        F.when(has_marker, F.lit(if_any)).otherwise(F.lit(if_none)).alias("type"),
        strip_to_int(crumb(1), wave_words).alias("wave"),
        first_image(F.col("html"), F.col("section"), fallbacks, t).alias("image"))


def first_image(html: Column, key: Column, fallbacks: Mapping[str, str], t: Template = GALLERY) -> Column:
    """The first image that any image block has, else the fallback by key."""
    found = F.transform(all_matches(html, t.image), lambda block: first_match(block, t.src))
    first = F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(first, F.try_element_at(literal_map(fallbacks), key))


def content_backs(pages: DataFrame, marker: str, t: Template = GALLERY) -> DataFrame:
    """Card backs, one per album: the deck is its title, the variant the heading for marked titles."""
    name = first_match(F.col("block"), t.text)
    return page_blocks(pages, t.album).select(
        "page_id", "pos", name.alias("deck"),
        F.when(F.startswith(name, F.lit(marker)), F.col("section")).alias("variant"),
        first_match(F.col("block"), t.src).alias("image"))


def deck_backs(pages: DataFrame, deck: Column | str, t: Template = GALLERY) -> DataFrame:
    """Card backs with the album title as variant; the deck is fixed, or depends on the page."""
    named = pages.withColumn("deck", F.lit(deck) if isinstance(deck, str) else deck)
    return page_blocks(named, t.album, "deck").select(
        "page_id", "pos", "deck",
        first_match(F.col("block"), t.text).alias("variant"), first_match(F.col("block"), t.src).alias("image"))


def split_backs(pages: DataFrame, kind: str, deck: str, marker: str = "back",
                t: Template = GALLERY) -> tuple[DataFrame, DataFrame]:
    """All blocks as cards, and blocks with the marker name once more as card backs; source one crumb up."""
    cards = page_items(pages, kind, t, source=crumb(2))
    backs = cards.where(F.lower("name") == marker).select(
        "page_id", "pos", F.lit(deck).alias("deck"), F.col("source").alias("variant"), "image")
    return cards, backs


def first_other_name(names: Column, marker: str = "back") -> Column:
    """The first name that is not exactly the marker, null without one."""
    return F.try_element_at(F.filter(names, lambda x: x != marker), F.lit(1))


def variant_backs(pages: DataFrame, deck: str, marker: str = "back", t: Template = GALLERY) -> DataFrame:
    """Marked blocks as card backs whose variant is the page's first other name; ``failed`` without one."""
    items = F.transform(all_matches(F.col("html"), t.image), lambda b: F.struct(
        first_match(b, t.alt).alias("name"), first_match(b, t.src).alias("image")))
    rows = pages.select("page_id", items.alias("items")).withColumn(
        "variant", first_other_name(F.transform("items", lambda x: x["name"]), marker))
    return (
        rows.select("page_id", "variant", F.posexplode("items").alias("pos", "item"))
        .where(F.lower("item.name") == marker)
        .select("page_id", "pos", F.lit(deck).alias("deck"), "variant", F.col("item.image").alias("image"),
                F.col("variant").isNull().alias("failed"))
    )
