from conftest import rows
from pyspark.sql import functions as F

from tidyshelf.operators import pages as p


def gallery(title, crumbs=(), albums=(), images=(), following=None):
    spans = "".join(f'<span><a href="/{c}"> {c} </a> | </span>' for c in crumbs)
    html = f'<html><div id="gallerytitle">\n<h2>{spans} {title} </h2></div>'
    html += "".join(f'<div class="album"><div class="thumb"><a href="{h}"><img src=" {s} " alt="x"/></a></div>'
                    f'<div class="albumdesc"><h3><a href="{h}"> {t} </a></h3></div></div>' for h, t, s in albums)
    html += "".join(f'<div class="image"><div><a href="#" title="T {n}"><img alt=" {n} " src="{s}"/></a></div></div>' for n, s in images)
    if following:
        html += f'<div class="pagelist"><ul><li class="next"><a href="{following}">next</a></li></ul></div>'
    return html + "</html>"


def pages(frame, *htmls):
    return p.read_pages(frame([(i, f"u{i}", h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string"))


def test_heading_and_crumbs(frame):
    df = pages(frame, gallery("Agenda &amp; Co", ["Core Box", "Wave 2"]), "<html></html>", gallery(""))
    assert rows(df, "page_id", "section", "crumbs") == [(0, "Agenda & Co", ["Core Box", "Wave 2"]), (1, "", []), (2, "", [])]


def test_links(frame):
    df = pages(frame, gallery("X", albums=[("/a", "A", "/a.png"), ("/b", "B", "/b.png")], following="/p2"), gallery("Y"))
    assert rows(p.page_links(df)) == [(0, "item", 0, "/a"), (0, "item", 1, "/b"), (0, "next", 0, "/p2")]


def test_routes_first_rule_wins_and_short_lists_do_not_hold(frame):
    rules = [("root", F.size("crumbs") == 0), ("pack", F.startswith(F.lower(p.crumb(1)), F.lit("wave"))),
             ("deep", p.crumb(3) == "Top"), ("named", F.col("section") == "X")]
    df = pages(frame, gallery("X"), gallery("X", ["Wave 1"]), gallery("X", ["Top", "a", "b"]), gallery("X", ["a"]), gallery("Y", ["a"]))
    assert rows(p.route_pages(df, rules), "page_id", "route") == [(0, "root"), (1, "pack"), (2, "deep"), (3, "named"), (4, None)]


IMAGES = [("One", "/1.png"), ("back", "/2.png"), ("Back", "/3.png")]


def test_items(frame):
    df = pages(frame, gallery("Tier 3 of 4", ["Top", "Core", "Cards"], images=IMAGES), gallery("none", ["Top"]))
    assert rows(p.source_items(df, "c"), "pos", "type", "name", "image", "source") == [
        (0, "c", "One", "/1.png", "Cards"), (1, "c", "back", "/2.png", "Cards"), (2, "c", "Back", "/3.png", "Cards")]
    assert rows(p.titled_items(df, "m"), "name") == [("T Back",), ("T One",), ("T back",)]
    assert "source" not in p.titled_items(df, "m").columns
    assert rows(p.tiered_items(df, "u"), "pos", "source", "tier") == [(i, "Core", 4) for i in range(3)]
    assert rows(p.section_items(df, "s", "color"), "pos", "color", "source")[0] == (0, "Tier 3 of 4", "Core")
    assert rows(p.parent_items(df, "s"), "pos", "source")[0] == (0, "Core")


def test_sentinel_and_branch(frame):
    one = [("One", "/1.png")]
    df = pages(frame, gallery("Agenda Deck", ["Packs", "Wave 1", "General"], images=one), gallery("Plans", ["Core", "Agenda"], images=one))
    assert rows(p.sentinel_items(df, "a", "agenda", "Agenda", "!!"), "page_id", "source", "agenda") == [
        (0, "General", "!!General"), (1, "Core", "Plans")]
    assert rows(p.branch_items(df, "d", "faction", "Packs"), "page_id", "source", "faction") == [
        (0, "General", None), (1, "Core", "Plans")]


def test_pivot_by_suffix(frame):
    images = [("Ann Healthy", "/h.png"), ("Card", "/c.png"), ("Ann wounded", "/w1.png"), ("Ann Wounded", "/w2.png")]
    df = pages(frame, gallery("Ann", ["Core", "Heroes"], images=images), gallery("Bob", ["Core", "Heroes"]))
    parents, children = p.pivot_by_suffix(df, ["healthy", "wounded"])
    assert rows(parents) == [(0, "Ann", "Core", "/h.png", "/w2.png"), (1, "Bob", "Core", None, None)]
    assert rows(children) == [(0, "Ann", 1, "Card", "/c.png")]


def test_sources(frame):
    df = pages(frame, gallery("Ann", ["Packs", "Wave-10"], albums=[("/a", "Deck A", "/a.png"), ("/b", "Deck B", "/b.png")], images=[("x", "/x.png")]),
               gallery("Bob", ["Packs", "wave 2"], albums=[("/a", "Deck C", "/c.png")]), gallery("Cy", ["Packs", "Other"]))
    fallback = {"Bob": "/bob.png"}
    assert rows(p.pack_sources(df, "Deck B", "Villain", "Ally", ["wave ", "wave-"], fallback)) == [
        (0, 0, "Ann", "Villain", 10, "/x.png"), (1, 0, "Bob", "Ally", 2, "/bob.png"), (2, 0, "Cy", "Ally", None, None)]
    assert rows(p.album_sources(df, "Expansion"), "page_id", "name", "image") == [(0, "Deck A", "/a.png"), (0, "Deck B", "/b.png"), (1, "Deck C", "/c.png")]
    assert rows(p.root_source(df, "Base", "Core"), "page_id", "name", "image")[0] == (0, "Base", "/a.png")


def test_card_backs(frame):
    albums = [("/a", "Story Cards", "/a.png"), ("/b", "Supply", "/b.png")]
    df = pages(frame, gallery("North", ["Expansions"], albums=albums))
    assert rows(p.content_backs(df, "Story")) == [(0, 0, "Story Cards", "North", "/a.png"), (0, 1, "Supply", None, "/b.png")]
    assert rows(p.deck_backs(df, "Condition")) == [(0, 0, "Condition", "Story Cards", "/a.png"), (0, 1, "Condition", "Supply", "/b.png")]


def test_split_and_variant_backs(frame):
    df = pages(frame, gallery("Threat", ["Core", "Side"], images=IMAGES), gallery("Only", ["Core", "Side"], images=[("back", "/9.png")]),
               gallery("First", ["Core", "Side"], images=[("back", "/8.png"), ("Stun", "/7.png")]))
    cards, backs = p.split_backs(df, "threat", "Threat Mission")
    assert cards.count() == 6
    assert rows(backs) == [(0, 1, "Threat Mission", "Core", "/2.png"), (0, 2, "Threat Mission", "Core", "/3.png"),
                           (1, 0, "Threat Mission", "Core", "/9.png"), (2, 0, "Threat Mission", "Core", "/8.png")]
    assert rows(p.variant_backs(df, "Condition"), "page_id", "pos", "variant", "failed") == [
        (0, 1, "One", False), (0, 2, "One", False), (1, 0, None, True), (2, 0, "Stun", False)]


def test_references_and_an_empty_first_block(frame):
    page = gallery("Ann&#8217;s &#x27;Deck&#x27; &amp; more", ["Caf&#233;", "One"], images=[("x", "/x.png"), ("y", "/y.png")])
    page = page.replace('src="/x.png"', "")
    row = p.read_pages(pages(frame, page)).first()
    assert row.section == "Ann\u2019s 'Deck' & more" and row.crumbs[0] == "Caf\u00e9"
    found = pages(frame, page).select(p.first_image(F.col("html"), F.lit("k"), {"k": "/fallback.png"}).alias("x"))
    assert found.first().x == "/y.png"


QUOTED = """<html><!-- <div class="image"><img alt="gone" src="/gone.png"></div> --><script>var x = '<div class="image">';</script>
<DIV id='gallerytitle' class='a b'><h2> <span><a href='/t'>Top</a> &raquo; </span><span><a href=/c>Caf&eacute;</a> | </span> Tier 2 </h2></DIV>
<div class='wide image'><div class='image frame'><img src='/in.png' alt='Inner &rsquo;s'></div>
<div><img src="/out.png" title="not > this alt='no'" alt = 'Outer'/></div></div>
<div class="images"><img alt="no block" src="/x.png"></div>
<div data-class="image"><img alt="none" src="/y.png"></div>
<div class=image><a title='T' href="#"><img alt=Plain src=/p.png></a>
<div class="album"><a href="sub/a.html"><img src="/a.png"></a><div class='albumdesc'><h3><a href='../up/./b.html#frag'> One <b>two</b></a></h3></div></div>"""


def test_nested_blocks_and_any_quoting(frame):
    df = p.read_pages(frame([(0, "http://h.org/x/y/p.html", QUOTED)], "page_id bigint, url string, html string"), p.NESTED)
    assert rows(df, "section", "crumbs") == [("Tier 2", ["Top", "Caf\u00e9"])]
    assert rows(p.source_items(df, "c", p.NESTED), "pos", "name", "image", "source") == [
        (0, "Inner \u2019s", "/in.png", "Caf\u00e9"), (1, "Inner \u2019s", "/in.png", "Caf\u00e9"), (2, "Plain", "/p.png", "Caf\u00e9")]
    assert rows(p.album_sources(df, "k", p.NESTED), "name", "image") == [("One two", "/a.png")]
    assert rows(p.titled_items(df, "m", p.NESTED), "pos", "name") == [(0, None), (1, None), (2, "T")]
    assert rows(p.page_links(df, p.NESTED)) == [(0, "item", 0, "../up/./b.html#frag")]
    graph = p.page_graph(df, p.NESTED)
    assert rows(graph, "address", "target_id") == [("http://h.org/x/up/b.html", None)]


def test_both_ways_agree_on_plain_pages(frame):
    df = pages(frame, gallery("Tier 3 of 4", ["Top", "Core", "Cards"], [("/a", "A", "/a.png"), ("/b", "B", "/b.png")], IMAGES, "/p2"), gallery("none", ["Top"]), "<html></html>", "")
    again = p.read_pages(df.drop("section", "crumbs"), p.NESTED)
    assert rows(again, "page_id", "section", "crumbs") == rows(df, "page_id", "section", "crumbs")
    for build in (lambda d, t: p.source_items(d, "c", t), lambda d, t: p.titled_items(d, "c", t), lambda d, t: p.page_links(d, t), lambda d, t: p.album_sources(d, "k", t),
                  lambda d, t: p.content_backs(d, "A", t), lambda d, t: p.variant_backs(d, "D", "back", t), lambda d, t: p.pivot_by_suffix(d, ["one"], t)[1],
                  lambda d, t: p.pack_sources(d, "A", "x", "y", ["wave "], {}, t)):
        assert rows(build(df, p.GALLERY)) == rows(build(again, p.NESTED))


def test_elements_that_are_not_closed(frame):
    html = "<div class=image><p>one<div class=image><br><p>two</div><ul><li>x<li>y</ul></b><img src=/1 alt=a><div class='image'>three"
    df = frame([(html,)], "html string").select(F.explode(p.all_matches(F.col("html"), p.NESTED.image)).alias("b"))
    assert [r.b for r in df.collect()] == [html, "<div class=image><br><p>two</div>", "<div class='image'>three"]


def test_deep_and_wide_pages(frame):
    deep = "<div class='image'>" * 200 + "x" + "</div>" * 200
    wide = "".join(f"<div class='image'><img alt='{i}'></div>" for i in range(2000))
    df = frame([(0, deep), (1, wide), (2, None)], "id int, html string").withColumn("b", p.all_matches(F.col("html"), p.NESTED.image))
    assert [r.n for r in df.selectExpr("id", "size(b) AS n").orderBy("id").collect()][:2] == [200, 2000]
    assert df.where("id = 1").first().b[1999] == "<div class='image'><img alt='1999'></div>"


LINKS = {"g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y",
         "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q", "g#s": "http://a/b/c/g", "g?y#s": "http://a/b/c/g?y", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x",
         "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/",
         "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.",
         ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
         "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "mailto:x@y": "mailto:x@y"}


def test_links_are_resolved_as_the_standard_says(frame):
    df = frame([(k,) for k in LINKS], "link string").withColumn("to", p.resolve_link(F.lit("http://a/b/c/d;p?q"), F.col("link")))
    assert {r.link: r.to for r in df.collect()} == LINKS
    assert frame([("x",)], "l string").select(p.resolve_link(F.lit("http://a"), F.col("l")).alias("x")).first().x == "http://a/x"


def test_pages_are_followed_from_the_roots(frame):
    site = {"http://h/": ["a", "b"], "http://h/a": ["/", "c"], "http://h/b": ["a#x"], "http://h/c": ["http://other/", "/"], "http://h/d": ["/"]}
    df = frame([(i, u, "".join(f'<div class=album><div class=albumdesc><a href="{x}">t</a></div></div>' for x in to)) for i, (u, to) in enumerate(site.items())],
               "page_id bigint, url string, html string")
    assert rows(p.page_depths(df, df.where("page_id = 0").select("page_id"), p.NESTED)) == [(0, 0), (1, 1), (2, 1), (3, 2)]
