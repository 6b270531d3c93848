"""Queries on records from pages.

The given pages have a heading, a menu and no images; the menu's entries stand in for crumbs, albums
and image blocks, all through a template.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyshelf.functions.text import replace_exact
from tidyshelf.operators import pages as p
from tidyshelf.plans.registry import query, table

MENU = p.Template(
    heading=r"(?s)<h1>(.*?)</h1>",
    crumb_area=r"(?s)<nav>(.*?)</nav>", crumb=r"<a [^>]*>([^<]*)</a>",
    album=r"(?s)(<li>.*?</li>)", image=r"(?s)(<li>.*?</li>)",
    item_link=r'<li><a href="([^"]*)"', next_link=r'<a href="([^"]*)">[^<]*</a></li></ul>',
    text=r"<a [^>]*>([^<]*)</a>", title=r'<a href="/([^"]*)"', alt=r"<a [^>]*>([^<]*)</a>", src=r'href="([^"]*)"')
# The page number as heading, and as the only crumb.
NUMBERED = MENU._replace(heading=r"track\(([0-9]+)\)")
WAVES = MENU._replace(crumb_area=r"(?s)(<script>.*?</script>)", crumb=r"track\(([0-9]+)\)")
# Only entries of one kind count as image blocks.
SPARSE = MENU._replace(image=r'(?s)(<li><a href="/th[^"]*">.*?</li>)')
FALLBACKS = {"en": "/fallback/en.png", "fr": "/fallback/fr.png"}


def clean_sql(x: str) -> str:
    for old, new in (("'&lt;'", "'<'"), ("'&gt;'", "'>'"), ("'&quot;'", "'\"'"), ("'&#39;'", "''''"), ("'&nbsp;'", "chr(160)"), ("'&amp;'", "'&'")):
        x = f"replace({x}, {old}, {new})"
    return f"regexp_replace({x}, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')"


PAGES_SQL = f"""
    WITH p AS (SELECT page_id, url, html, {clean_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS section,
        list_transform(regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a>', 1), lambda x: {clean_sql('x')}) AS crumbs,
        regexp_extract_all(html, '(?s)(<li>.*?</li>)', 1) AS blocks,
        regexp_extract(html, 'track\\(([0-9]+)\\)', 1) AS number,
        regexp_extract(html, '<html lang="(..)"', 1) AS lang FROM pages),
    b AS (SELECT page_id, section, crumbs, number, unnest(blocks) AS block, CAST(generate_subscripts(blocks, 1) - 1 AS INTEGER) AS pos FROM p),
    i AS (SELECT page_id, section, crumbs, number, pos, {clean_sql("regexp_extract(block, '<a [^>]*>([^<]*)</a>', 1)")} AS name,
        {clean_sql("regexp_extract(block, 'href=\"([^\"]*)\"', 1)")} AS image FROM b) """


def read(spark, sf, template=MENU):
    return p.read_pages(table(spark, sf, "pages"), template)


@query("i1_page_section", PAGES_SQL + "SELECT page_id, section FROM p")
def i1(spark, sf):
    return read(spark, sf).select("page_id", "section")


@query("i2_page_breadcrumbs", PAGES_SQL + "SELECT page_id, CAST(generate_subscripts(crumbs, 1) - 1 AS INTEGER) AS pos, unnest(crumbs) AS crumb FROM p")
def i2(spark, sf):
    return read(spark, sf).select("page_id", F.posexplode("crumbs").alias("pos", "crumb"))


@query("i3_page_links", PAGES_SQL + """
    SELECT page_id, 'item' AS kind, pos, image AS target FROM i
    UNION ALL SELECT page_id, 'next', 0, image FROM i QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos DESC) = 1""")
def i3(spark, sf):
    """All menu entries as item links, the last one also as the way on."""
    return p.page_links(table(spark, sf, "pages"), MENU)


# The same entries by the paths of their elements.
PATHS = p.Template(
    heading=p.Text((p.Element("h1"),), own=True), crumb=p.Text((p.Element("nav"), p.Element("a"))),
    album=p.Markup((p.Element("nav"), p.Element("li"))), image=p.Markup((p.Element("nav"), p.Element("li"))),
    item_link=p.Attribute((p.Element("nav"), p.Element("li"), p.Element("a")), "href"), next_link=p.Attribute((p.Element("nav"), p.Element("b"), p.Element("a")), "href"),
    text=p.Text((p.Element("a"),)), title=p.Attribute((p.Element("a"),), "title"), alt=p.Text((p.Element("a"),)), src=p.Attribute((p.Element("a"),), "href"))


@query("i3_page_graph", PAGES_SQL + """, e AS (SELECT i.page_id, 'item' AS kind, pos, image AS target, regexp_extract(url, '^(https?://[^/?#]*)', 1) || image AS address
        FROM i JOIN pages USING (page_id)),
    a AS (SELECT regexp_replace(url, '#.*', '') AS address, min(page_id) AS target_id FROM pages GROUP BY ALL)
    SELECT e.*, target_id FROM e LEFT JOIN a USING (address)""")
def i3_graph(spark, sf):
    """The menu's links as absolute addresses, with the pages that have them."""
    return p.page_graph(table(spark, sf, "pages"), PATHS)


@query("i3_page_depths", """
    WITH RECURSIVE p AS (SELECT page_id, 'http://h.example' || regexp_extract(html, '<li><a href="([^"]*)"', 1) AS url, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS links FROM pages),
    a AS (SELECT url, min(page_id) AS id FROM p GROUP BY url),
    e AS MATERIALIZED (SELECT DISTINCT l.page_id, id FROM (SELECT page_id, 'http://h.example' || unnest(links) AS url FROM p) l JOIN a USING (url)),
    d AS (SELECT min(page_id) AS page_id, 0 AS depth FROM pages UNION SELECT e.id, depth + 1 FROM d JOIN e USING (page_id) WHERE depth < 40)
    SELECT page_id, min(depth) AS depth FROM d GROUP BY page_id""")
def i3_depths(spark, sf):
    """Pages stand at the address of their own first entry, and are followed from the first of them."""
    pages = table(spark, sf, "pages")
    first = F.regexp_extract("html", '<li><a href="([^"]*)"', 1)
    return p.page_depths(pages.withColumn("url", F.concat(F.lit("http://h.example"), first)), pages.agg(F.min("page_id").alias("page_id")), PATHS)


@query("i5_nested_items", PAGES_SQL + "SELECT page_id, pos, 'command-cards' AS type, name, image, crumbs[-1] AS source FROM i")
def i5_nested(spark, sf):
    """The same records as those of ``i5_source_items``, by paths instead of expressions."""
    return p.source_items(read(spark, sf, PATHS), "command-cards", PATHS)


def routes():
    section, first = F.lower("section"), F.lower(p.crumb(1))
    return [("listing", F.size("crumbs") == 0), ("deck", F.startswith(first, F.lit("th"))),
            ("pack", F.endswith(p.crumb(1), F.lit("."))), ("hero", F.contains(section, F.lit("ti")) & (F.length(p.crumb(2)) > 3)),
            ("deep", F.startswith(F.lower(p.crumb(6)), F.lit("d")))]


ROUTED_SQL = PAGES_SQL + """, r AS (SELECT *, CASE WHEN len(crumbs) = 0 THEN 'listing' WHEN starts_with(lower(crumbs[-1]), 'th') THEN 'deck'
    WHEN ends_with(crumbs[-1], '.') THEN 'pack' WHEN contains(lower(section), 'ti') AND length(crumbs[-2]) > 3 THEN 'hero'
    WHEN starts_with(lower(crumbs[-6]), 'd') THEN 'deep' END AS route FROM p) """


@query("i4_route_pages", ROUTED_SQL + "SELECT page_id, route FROM r")
def i4(spark, sf):
    return p.route_pages(read(spark, sf), routes()).select("page_id", "route")


@query("i5_source_items", PAGES_SQL + "SELECT page_id, pos, 'command-cards' AS type, name, image, crumbs[-1] AS source FROM i")
def i5(spark, sf):
    return p.source_items(read(spark, sf), "command-cards", MENU)


@query("i6_titled_items", PAGES_SQL + "SELECT page_id, pos, 'maps' AS type, substr(image, 2) AS name, image FROM i")
def i6(spark, sf):
    return p.titled_items(read(spark, sf), "maps", MENU)


@query("i7_tiered_items", PAGES_SQL + "SELECT page_id, pos, 'upgrade-cards' AS type, name, image, crumbs[-2] AS source, CAST(number AS BIGINT) AS tier FROM i")
def i7(spark, sf):
    return p.tiered_items(read(spark, sf, NUMBERED), "upgrade-cards", NUMBERED)


@query("i7_section_items", PAGES_SQL + "SELECT page_id, pos, 'side-cards' AS type, name, image, crumbs[-2] AS source, section AS color FROM i")
def i7_section(spark, sf):
    return p.section_items(read(spark, sf), "side-cards", "color", MENU)


@query("i7_parent_items", PAGES_SQL + "SELECT page_id, pos, 'class-cards' AS type, name, image, crumbs[-2] AS source FROM i")
def i7_parent(spark, sf):
    return p.parent_items(read(spark, sf), "class-cards", MENU)


@query("i8_sentinel_items", PAGES_SQL + """SELECT page_id, pos, 'agenda-cards' AS type, name, image,
    CASE WHEN starts_with(section, 'Th') THEN crumbs[-1] ELSE crumbs[-2] END AS source,
    CASE WHEN starts_with(section, 'Th') THEN '!!' || crumbs[-1] ELSE section END AS agenda FROM i""")
def i8(spark, sf):
    return p.sentinel_items(read(spark, sf), "agenda-cards", "agenda", "Th", "!!", MENU)


@query("i9_branch_items", PAGES_SQL + """SELECT page_id, pos, 'cards' AS type, name, image,
    CASE WHEN starts_with(crumbs[-3], 'th') THEN crumbs[-1] ELSE crumbs[-2] END AS source,
    CASE WHEN NOT starts_with(crumbs[-3], 'th') THEN section END AS faction FROM i""")
def i9(spark, sf):
    return p.branch_items(read(spark, sf), "cards", "faction", "th", MENU)


@query("i10_pivot_parents", PAGES_SQL + """SELECT page_id, section AS name, crumbs[-2] AS source,
    (SELECT arg_max(image, pos) FROM i WHERE i.page_id = p.page_id AND ends_with(lower(i.name), 'e')) AS e,
    (SELECT arg_max(image, pos) FROM i WHERE i.page_id = p.page_id AND ends_with(lower(i.name), 'n')) AS n FROM p""")
def i10(spark, sf):
    return p.pivot_by_suffix(read(spark, sf), ["e", "n"], MENU)[0]


@query("i10_pivot_children", PAGES_SQL + """SELECT page_id, section AS parent, pos, name, image FROM i
    WHERE NOT ends_with(lower(name), 'e') AND NOT ends_with(lower(name), 'n')""")
def i10_children(spark, sf):
    return p.pivot_by_suffix(read(spark, sf), ["e", "n"], MENU)[1]


PACK_SQL = """SELECT page_id, 0 AS pos, section AS name, CASE WHEN list_contains(list_transform(blocks, lambda x: regexp_extract(x, '<a [^>]*>([^<]*)</a>', 1)), 'the')
    THEN 'Villain' ELSE 'Ally' END AS type, CAST(number AS BIGINT) AS wave, (SELECT image FROM i WHERE i.page_id = r.page_id AND i.pos = 0) AS image FROM r"""


@query("i11_pack_sources", ROUTED_SQL + PACK_SQL)
def i11(spark, sf):
    """The page number stands for the wave; a page with the entry "the" is of the other kind."""
    return p.pack_sources(read(spark, sf, WAVES), "the", "Villain", "Ally", ["wave ", "wave-"], {}, WAVES)


@query("i12_source_records", ROUTED_SQL + PACK_SQL + """ WHERE route = 'pack'
    UNION ALL SELECT page_id, 0, 'Base Game', 'Core', NULL, (SELECT image FROM i WHERE i.page_id = r.page_id AND i.pos = 0) FROM r WHERE route = 'hero'
    UNION ALL SELECT i.page_id, i.pos, i.name, 'Expansion', NULL, i.image FROM i JOIN r USING (page_id) WHERE route = 'deck'""")
def i12(spark, sf):
    """Routed pages give one fixed record, one per album, or one per page."""
    routed = p.route_pages(read(spark, sf), routes())
    of = lambda route: routed.where(F.col("route") == route)
    packs = of("pack").withColumn("crumbs", p.page_breadcrumbs(F.col("html"), WAVES))
    return (
        p.root_source(of("hero"), "Base Game", "Core", MENU).unionByName(p.album_sources(of("deck"), "Expansion", MENU))
        .unionByName(p.pack_sources(packs, "the", "Villain", "Ally", ["wave ", "wave-"], {}, MENU))
    )


@query("i13_first_image", PAGES_SQL + """SELECT page_id, coalesce(nullif(regexp_extract(html, '<li><a href="(/th[^"]*)">', 1), ''),
    CASE lang WHEN 'en' THEN '/fallback/en.png' WHEN 'fr' THEN '/fallback/fr.png' END) AS image FROM p""")
def i13(spark, sf):
    lang = F.regexp_extract("html", '<html lang="(..)"', 1)
    return table(spark, sf, "pages").select("page_id", p.first_image(F.col("html"), lang, FALLBACKS, SPARSE).alias("image"))


@query("i14_content_backs", PAGES_SQL + "SELECT page_id, pos, name AS deck, CASE WHEN starts_with(name, 'e') THEN section END AS variant, image FROM i")
def i14(spark, sf):
    return p.content_backs(read(spark, sf), "e", MENU)


@query("i15_deck_backs", ROUTED_SQL + """SELECT i.page_id, i.pos, CASE route WHEN 'deck' THEN 'Condition' WHEN 'pack' THEN 'Class' ELSE 'Upgrade' END AS deck,
    i.name AS variant, i.image FROM i JOIN r USING (page_id) WHERE route IS NOT NULL""")
def i15(spark, sf):
    """Each route's pages hold the backs of one deck; all are read in one pass."""
    routed = p.route_pages(read(spark, sf), routes()).where("route IS NOT NULL")
    decks = {"deck": "Condition", "pack": "Class", "hero": "Upgrade", "deep": "Upgrade", "listing": "Upgrade"}
    return p.deck_backs(routed, replace_exact(F.col("route"), decks), MENU)


@query("i16_split_backs", PAGES_SQL + """SELECT page_id, pos, 'card' AS kind, name, crumbs[-2] AS source, image FROM i
    UNION ALL SELECT page_id, pos, 'back', 'Threat', crumbs[-2], image FROM i WHERE lower(name) = 'the'""")
def i16(spark, sf):
    cards, backs = p.split_backs(read(spark, sf), "cards", "Threat", "the", MENU)
    return cards.select("page_id", "pos", F.lit("card").alias("kind"), "name", "source", "image").unionByName(
        backs.select("page_id", "pos", F.lit("back").alias("kind"), F.col("deck").alias("name"), F.col("variant").alias("source"), "image"))


@query("i17_variant_backs", PAGES_SQL + """, o AS (SELECT page_id, arg_min(name, pos) AS variant FROM i WHERE name <> 'the' GROUP BY page_id)
    SELECT page_id, pos, 'Condition' AS deck, variant, image, variant IS NULL AS failed FROM i LEFT JOIN o USING (page_id) WHERE lower(name) = 'the'""")
def i17(spark, sf):
    return p.variant_backs(read(spark, sf), "Condition", "the", MENU)
