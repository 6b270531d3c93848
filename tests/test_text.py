import re

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidyshelf.functions import text as t

SLOW = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def apply(frame, values, expr):
    got = frame(list(enumerate(values)), "i int, v string").select("i", expr(F.col("v")).alias("o")).collect()
    return [r.o for r in sorted(got, key=lambda r: r.i)]


def plain_slug(value):
    return re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", value).strip().lower())


def test_replacements(frame):
    assert apply(frame, ["a", "b", None], lambda v: t.replace_exact(v, {"a": "A"})) == ["A", "b", None]
    assert apply(frame, ["a"], lambda v: t.replace_exact(v, {})) == ["a"]
    assert apply(frame, ["Heroes Deck Card", "Card"], lambda v: t.strip_words(v, {"Heroe": "Hero", " Deck": "", " Card": ""})) == ["Heros", "Card"]
    assert apply(frame, ["cards", "ss", "x", "s", "", None], t.singular) == ["card", "s", "x", "", "", None]


def test_sentinel(frame):
    known = {"Mole": "A Digger"}
    assert apply(frame, ["!!Mole", "!!Nobody", "plain", None], lambda v: t.resolve_sentinel(v, "!!", known)) == ["A Digger", None, "plain", None]
    assert apply(frame, ["!!Mole", "!!Nobody", "plain", None], lambda v: t.sentinel_unknown(v, "!!", known)) == [False, True, False, False]


def test_defaults(frame):
    df = frame([(None, "p"), (None, "q"), ("Red", "p"), (None, None)], "color string, name string")
    out = df.select("name", t.default_by_set(F.col("color"), F.col("name"), ["p"], "Grey", "Green").alias("c"))
    assert rows(out) == [("p", "Grey"), ("p", "Red"), ("q", "Green"), (None, "Green")]


def test_split_suffix(frame):
    df = frame([("A Campaign B campaign",), ("C Skirmish",), ("D",), ("CAMPAIGN",), ("XCampaign",), (None,)], "name string")
    out = t.split_suffix(df, "name", ["Campaign", "Skirmish"], "scope")
    assert rows(out, "name", "scope") == [("A B", "Campaign"), ("C", "Skirmish"), ("CAMPAIGN", None), ("D", None), ("XCampaign", "Campaign"), (None, None)]


def test_normalize_source(frame):
    names = ["Core Box", "North Box ", "Harbor-Town", "Box", None]
    got = apply(frame, names, lambda v: t.normalize_source(v, {"Core Box": "Base Game"}, "Box", {"Harbor-Town": "Harbor's Town"}))
    assert got == ["Base Game", "North", "Harbor's Town", "", None]


def test_slugify_examples(frame):
    values = ["  Hello,  World! ", "a--b - c", "Ünïcode_Ñame x y", "\tx\n", "---", "", "é", "٣ x²", "a\x1cb\x85c"]
    assert apply(frame, values, t.slugify) == [plain_slug(v) for v in values]


@SLOW
@given(st.lists(st.text(alphabet="aB3_é-– \t.ß 　", max_size=20), min_size=1, max_size=20))
def test_slugify_is_the_plain_rule_and_idempotent(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = {r.i: (r.a, r.b) for r in df.select("i", t.slugify(F.col("v")).alias("a"), t.slugify(t.slugify(F.col("v"))).alias("b")).collect()}
    for i, value in enumerate(values):
        assert got[i] == (plain_slug(value),) * 2


SCHEMA = "name string, cost int, elite boolean, unique boolean, modes array<string>, price double, owned boolean"


@pytest.fixture
def cards(frame):
    return frame([("Lars S. O_k", 3, True, False, ["Skirmish"], 1.5, True), ("Hal", None, True, True, ["Skirmish", "Campaign"], 1.0, False),
                  ("Lena", 0, None, None, None, None, None), ("Chester", 4, True, None, [], 2.0, True)], SCHEMA)


def test_canonical_name_by_type(cards):
    name = t.canonical_name(cards, "elite", "name", "absent", "cost", "modes", "price", "owned", full_set=["Campaign", "Skirmish"])
    assert rows(cards.select(name)) == [("elitechester4owned",), ("elitelarssok3skirmishowned",), ("hal",), ("lena0",)]
    assert rows(cards.select(t.canonical_name(cards, "absent"))) == [("",)] * 4


def test_filename_words_and_paths(cards):
    words = t.filename_words(cards, "elite", "name", "modes", "owned", "cost", full_set=["Campaign", "Skirmish"], prefixes=["p"], suffixes=["s"])
    assert rows(cards.select(words)) == [("p-elite-chester-4-s",), ("p-elite-lars-s-o_k-skirmish-3-s",), ("p-hal-s",), ("p-lena-0-s",)]
    path = t.derived_path(cards, "Deployment Cards", ["cost", "owned"], ["name"])
    assert rows(cards.select(path)) == [("deployment-cards/0/lena.png",), ("deployment-cards/3/true/lars-s-o_k.png",),
                                        ("deployment-cards/4/true/chester.png",), ("deployment-cards/false/hal.png",)]


def test_urls_and_files(frame):
    thumb = "/cache/Packs/A_275_thumb_ffflogog_whatermark_cc.png"
    assert apply(frame, [thumb], lambda v: t.rewrite_url(v, "http://h.example.org")) == ["http://h.example.org/albums/Packs/A.png"]
    assert apply(frame, ["a.b.png", "none", ".x"], t.file_stem) == ["a", "none", ""]
    assert apply(frame, ["a.b.png", "none", "x."], t.file_extension) == ["png", "none", ""]


def test_numbers(frame):
    assert apply(frame, ["Tier 1 of 23", "none", "", None], t.trailing_int) == [23, None, None, None]
    assert apply(frame, ["Wave 4", "wave-10", "Wave x", "7"], lambda v: t.strip_to_int(v, ["wave ", "wave-"])) == [4, 10, None, 7]
    assert apply(frame, ["a &amp;lt; b &lt;"], t.unescape_html) == ["a &lt; b <"]


def test_character_references(frame):
    cases = [("It&#8217;s &#x27;x&#X27; &nosuch; &amp;#39; &#38;lt; &lt;b&gt;&nbsp;&quot;", "It\u2019s 'x' &nosuch; &#39; &lt; <b>\u00a0\""), ("&#0;&#xD800;&#1114112;", "\ufffd" * 3),
             ("&#128512;", "\U0001f600"), ("Caf&eacute; &rsquo;x&rsquo; &ndash; &amp;eacute; &AMP;lt; &CounterClockwiseContourIntegral;&NotEqualTilde;", "Caf\u00e9 \u2019x\u2019 \u2013 &eacute; &lt; \u2233\u2242\u0338"), ("plain & text &#; &#x;", "plain & text &#; &#x;"), (None, None)]
    df = frame([(i, c[0]) for i, c in enumerate(cases)], "id int, t string")
    assert {r.id: r.x for r in df.select("id", t.unescape_html(F.col("t")).alias("x")).collect()} == {i: c[1] for i, c in enumerate(cases)}
    more = df.where("id = 0").select(t.unescape_html(F.col("t"), {"&nosuch;": "\u00e9"}).alias("x")).first().x
    assert "\u00e9" in more and "&lt;b&gt;" in more


def test_replace_by_table(frame):
    df = frame([(1, "a"), (2, "b"), (3, None), (4, "a")], "id int, v string")
    mapping = frame([("a", "x"), ("a", "x"), ("c", "y"), (None, "z")], "key string, value string")
    out = t.replace_by_table(df, "v", mapping)
    assert out.columns == df.columns and rows(out) == [(1, "x"), (2, "b"), (3, None), (4, "x")]
