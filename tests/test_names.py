import random
from difflib import SequenceMatcher

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidyshelf.operators import names as n


def plain_cascade(records, strategies):
    """What the cascade means, on plain dictionaries."""
    out, left = {}, list(records)
    for level, attrs in enumerate(strategies):
        held = {}
        for r in left:
            held.setdefault("".join(str(r[a]) for a in attrs if r[a] is not None), []).append(r)
        for name, group in held.items():
            if len(group) == 1:
                out[group[0]["id"]] = (name, level)
        left = [r for group in held.values() if len(group) > 1 for r in group]
    return {**out, **{r["id"]: ("", None) for r in left}}


@pytest.mark.parametrize("parts,levels", [(1, 2), (8, 3), (8, 6)])
def test_cascade_equals_plain_rule(frame, parts, levels):
    rng = random.Random(levels)
    columns = ["a", "b", "c", "d", "e", "f"][:levels]
    records = [{"id": i, **{c: rng.choice("xyz") if rng.random() > .2 else None for c in columns}} for i in range(120)]
    df = frame([tuple(r.values()) for r in records], "id int, " + ", ".join(f"{c} string" for c in columns), parts)
    strategies = [columns[:i + 1] for i in range(levels)]
    named = n.unique_names(df, "id", strategies)
    got = {r.id: (r.canonical, r.level) for r in named.collect()}
    assert got == plain_cascade(records, strategies)
    for level in range(levels):
        settled = [name for name, at in got.values() if at == level]
        assert len(settled) == len(set(settled))


def test_cascade_reports(frame):
    df = frame([(1, "a", "x"), (2, "a", "y"), (3, "b", "q"), (4, "a", "z"), (5, "a", "z"), (6, "ax", None)], "id int, name string, kind string")
    named = n.unique_names(df, "id", [["name"], ["name", "kind"]])
    assert rows(named, "id", "canonical", "level") == [(1, "ax", 1), (2, "ay", 1), (3, "b", 0), (4, "", None), (5, "", None), (6, "ax", 0)]
    assert rows(n.unresolved_names(named), "id") == [(4,), (5,)]
    assert rows(n.level_report(named)) == [(0, 2), (1, 2)]
    assert rows(n.name_clashes(named)) == [("ax", 2, 2)]


def test_single_record_gets_the_first_strategy(frame):
    named = n.unique_names(frame([(1, "Only One")], "id int, name string"), "id", [["name"]])
    assert rows(named, "canonical", "level") == [("onlyone", 0)]


def test_coverage_and_missing(frame):
    expected = frame([("a",), ("a",), ("b",), ("c",), ("c",), ("c",)], "name string")
    have = frame([("a",), ("a",), ("z",)], "name string")
    assert rows(n.coverage(expected, have)) == [(6, 33.33)]
    assert rows(n.missing_names(expected, have)) == [("b",), ("c",), ("c",), ("c",)]
    assert rows(n.coverage(expected.where("false"), have)) == [(0, None)]


def brute(missing, have):
    return {(m, h) for m in set(missing) for h in set(have) if SequenceMatcher(None, m, h).ratio() > 0.80 or m in h}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fuzzy_equals_brute_force(frame, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))
    have = {word() for _ in range(120)}
    missing = {word() for _ in range(40)}
    for h in list(have)[:60]:
        at = rng.randrange(len(h))
        missing |= {h[:at] + h[at + 1:], h[:at] + rng.choice("abcd") + h[at:], h[1:] + h[:1], h * 2, h[:at] + "é" + h[at + 1:]}
    missing -= have
    df = n.fuzzy_candidates(frame([(m,) for m in missing], "name string"), frame([(h,) for h in have], "name string"))
    assert {tuple(r) for r in df.collect()} == brute(missing, have)


def test_fuzzy_edges(frame):
    have = ["abcde", "a", "xaby", "zzzzzzzzzz", "abcdefghi"]
    missing = ["", "b", "ab", "zzzzzzzz", "zzzzzzzzzzzz", "abcdefghix", "abcd", "nope", "é"]
    df = n.fuzzy_candidates(frame([(m,) for m in missing], "name string"), frame([(h,) for h in have], "name string"))
    assert {tuple(r) for r in df.collect()} == brute(missing, have)
    # Eight of ten characters are exactly at the limit and do not pass.
    assert SequenceMatcher(None, "abcdefgh__", "abcdefgh--").ratio() == 0.80
    at_limit = n.fuzzy_candidates(frame([("abcdefgh__",)], "name string"), frame([("abcdefgh--",)], "name string"))
    assert at_limit.count() == 0
    with pytest.raises(ValueError):
        n.fuzzy_candidates(df, df, ratio=0.5)


def test_fuzzy_long_names(frame):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(260))
    missing, have = [base[:100] + "Q" + base[100:]], [base, base[::-1]]
    df = n.fuzzy_candidates(frame([(m,) for m in missing], "name string"), frame([(h,) for h in have], "name string"))
    assert {tuple(r) for r in df.collect()} == brute(missing, have)


def test_long_names_with_a_common_beginning(frame):
    rng = random.Random(10)
    start = "".join(rng.choice("abcdefgh") for _ in range(20))
    word = lambda k: start + "".join(rng.choice("abcdefgh") for _ in range(k))
    have = {word(rng.randint(5, 20)) for _ in range(80)}
    missing = {h[:-2] + "zz" for h in list(have)[:20]} | {word(9) for _ in range(20)} | {h + "q" * 9 for h in list(have)[:5]}
    df = n.fuzzy_candidates(frame([(m,) for m in missing], "name string"), frame([(h,) for h in have], "name string"))
    assert {tuple(r) for r in df.collect()} == brute(missing, have)


def test_manifest(frame):
    df = frame([("u1", "a"), ("http://known.example.org/x", "b"), (None, "c")], "url string, name string")
    assert rows(n.fetch_manifest(df, "cards", "url", "name", "known.example")) == [("cards", "u1", "a"), ("cards", None, "c")]
