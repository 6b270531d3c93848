from conftest import rows
from pyspark.sql import functions as F

from tidyshelf.operators import model as m


def test_resolve_fk_last_id_wins_and_unknown_is_an_error_row(frame):
    dim = frame([("a", 0), ("b", 1), ("a", 2)], "name string, seq int")
    facts = frame([(1, "a"), (2, "b"), (3, "zz"), (4, None)], "id int, source string")
    out = m.resolve_fk(facts, dim, "source", "name", "seq", "source_id")
    assert rows(m.resolved(out), "id", "source_id") == [(1, 2), (2, 1), (4, None)]
    assert rows(m.unresolved(out), "id", "source") == [(3, "zz")]


def test_extract_dimension_first_seen_and_known_names(frame):
    facts = frame([("x", "s3", 2), ("y", "s1", 0), ("x", "s2", 1), (None, "s4", 3)], "name string, source string, seq int")
    dim = m.extract_dimension(facts, "name", "source", "seq", initial=10)
    assert rows(dim) == [(11, "y", "s1"), (12, "x", "s2"), (13, None, "s4")]
    old = frame([(3, "x", "s0"), (1, "x", "s9")], "id bigint, name string, source string")
    both = m.extract_dimension(facts, "name", "source", "seq", initial=10, existing=old)
    assert rows(both, "id", "name") == [(1, "x"), (11, "y"), (12, None), (3, "x")]
    linked = m.link_dimension(facts, both, "name", "name_id")
    assert rows(linked, "seq", "name_id") == [(0, 11), (1, 1), (2, 1), (3, 12)]


def test_bridge_of_scalar_list_null_and_empty(frame):
    lists = frame([(1, ["a", "b"]), (2, []), (3, None), (4, [None])], "id int, source array<string>")
    assert rows(m.bridge_table(lists, "source", "cards")) == [
        ("a", "cards", 1), ("b", "cards", 1), (None, "cards", 3), (None, "cards", 4)]
    scalars = frame([(7, "c"), (8, None)], "id int, source string")
    bridge = m.bridge_table(scalars, "source", "maps", present=F.col("id") != 8, bridge=m.bridge_table(lists, "source", "cards"))
    assert ("c", "maps", 7) in rows(bridge) and bridge.count() == 5


def test_lookup_and_domain(frame):
    dim = frame([(1, "Ann"), (2, None)], "id int, name string")
    facts = frame([(10, 1), (11, 2), (12, 3), (13, None)], "n int, hero int")
    out = m.lookup_attribute(facts, dim, "hero", "id", "name", "hero_name")
    assert rows(out, "n", "hero_name", "unresolved") == [
        (10, "Ann", False), (11, None, False), (12, None, True), (13, None, True)]
    assert rows(m.domain_check(facts, dim, "hero", "id"), "n", "in_domain") == [(10, True), (11, True), (12, False), (13, False)]


def test_mapped_join(frame):
    records = frame([(1, "lars", "i1.png"), (2, "rey", "i2.png"), (3, "rey", "i3.png")], "id int, name string, image string")
    mapping = frame([("walker", "lars")], "key string, value string")
    files = frame([("x/walker.big.png",), ("x/rey.png",), ("a/rey.v2.png",), ("x/none.png",)], "path string")
    long = m.mapped_join(records, mapping, files, "name", "id", "image")
    assert rows(long.where("added")) == [(1, "x/walker.big.png", True), (3, "a/rey.v2.png", True), (3, "x/rey.png", True), (None, "x/none.png", True)]
    folded = {r.id: r.images for r in m.fold_images(long, "id").collect()}
    assert folded == {1: ["i1.png", "x/walker.big.png"], 2: ["i2.png"], 3: ["i3.png", "a/rey.v2.png", "x/rey.png"]}


def test_chain_tables(frame):
    out = m.chain_tables(a=frame([(1,)], "x int"), b=frame([(2, "y")], "x int, z string"))
    assert rows(out, "x", "z", "table") == [(1, None, "a"), (2, "y", "b")]


def test_a_mapping_key_listed_twice_does_not_double_the_file(frame):
    files = frame([("x/k.png",)], "path string")
    mapping = frame([("k", "first", 0), ("k", "last", 1)], "key string, value string, pos int")
    assert rows(m.match_files(files, mapping), "path", "name") == [("x/k.png", "last")]
