import hashlib

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidyshelf.operators import keys as k
from tidyshelf.operators import ordering as o
from tidyshelf.operators import similar as s

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_sort_rows_nulls_first_and_stable(frame):
    df = frame([("b", 1, 0), (None, 2, 1), ("a", 3, 2), ("a", 1, 3)], "name string, n int, seq int")
    assert [r.seq for r in o.sort_rows(df, "name", seq="seq").collect()] == [1, 2, 3, 0]
    assert [r.seq for r in o.sort_rows(df, "name", "n").collect()] == [1, 3, 2, 0]
    assert [r.seq for r in o.sort_rows_by(df, -F.col("n"), seq="seq").collect()] == [2, 1, 0, 3]


def test_sort_array_column(frame):
    df = frame([(["bb", "a", "ccc"],), ([],)], "words array<string>", 1)
    assert rows(o.sort_array_column(df, "words")) == [(["a", "bb", "ccc"],), ([],)]
    by_size = o.sort_array_column(frame([(["bb", "a", "cc", "d"],)], "words array<string>"), "words", key=F.length)
    assert by_size.first().words == ["a", "d", "bb", "cc"]


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_numbers_do_not_depend_on_partitions(frame, parts):
    data = [((i * 7919) % 1009 * 70000 - 9_000_000, f"n{i % 5}") for i in range(500)]
    df = frame(data, "key bigint, name string", parts)
    want = {key: n for n, key in enumerate(sorted(key for key, _ in data))}
    assert {r.key: r.seq for r in o.number_by_key(df, "key").collect()} == want
    by_name = sorted(data, key=lambda r: (r[1], r[0]))
    got = {r.key: r.seq for r in o.number_sorted(df, "name", "key", start=5).collect()}
    assert got == {key: n + 5 for n, (key, _) in enumerate(by_name)}


@SLOW
@given(st.sets(st.integers(-2**63, 2**63 - 1), min_size=1, max_size=40))
def test_any_keys_are_numbered_densely(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "key bigint")
    got = {r.key: r.seq for r in o.number_by_key(df, "key").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}


def test_add_ids_only_when_no_row_has_one(frame):
    df = frame([(5, None), (9, None)], "key int, id bigint")
    added = k.add_ids(df, "key", initial=3)
    assert added.columns == ["id", "key"] and rows(added) == [(4, 5), (5, 9)]
    partly = frame([(5, None), (9, 1)], "key int, id bigint")
    assert rows(k.add_ids(partly, "key")) == [(5, None), (9, 1)]


@SLOW
@given(st.lists(st.one_of(st.none(), st.integers(-2**40, 2**40)), min_size=1, max_size=30, unique_by=lambda v: v if v is not None else object()))
def test_no_row_is_lost_and_ids_are_dense(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "key bigint")
    got = sorted((r.id, r.key) for r in k.add_ids(df, "key").collect())
    assert [i for i, _ in got] == list(range(len(values)))
    assert [v for _, v in got] == [None] * values.count(None) + sorted(v for v in values if v is not None)


def test_null_key_is_merged_and_kept(frame):
    df = frame([("a", "x", 1), (None, "y", 2), (None, "z", 0), ("a", "w", 5), (None, "y", 9)], "key string, v string, n int")
    assert rows(k.dedup_merge(df, "key", ["v"], "n")) == [("a", ["x", "w"], 1), (None, ["z", "y"], 0)]
    assert rows(k.dedup_first(df, ["key"], "n")) == [("a", "x", 1), (None, "z", 0)]


def test_dedup_plans_have_no_sort_aggregate(frame):
    df = frame([("a", "x", 1)], "key string, v string, n int")
    for out in (k.dedup_merge(df, "key", ["v"], "n"), k.dedup_first(df, ["key"], "n")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan


@pytest.mark.parametrize("distance", range(5))
def test_64_bits_at_every_distance(frame, distance):
    top = -2 ** 63
    hashes = [0, top, top | 1, 1, 7, 15, -1, -2 ** 62, 2 ** 62]
    df = frame([(h, i) for i, h in enumerate(hashes)], "hash bigint, n int")
    got = {(r.hash_a, r.hash_b, r.distance) for r in s.near_duplicates(df, "hash", "n", 64, distance).collect()}
    apart = lambda a, b: bin((a ^ b) & (2 ** 64 - 1)).count("1")
    assert got == {(a, b, apart(a, b)) for a in hashes for b in hashes if a < b and apart(a, b) <= distance}


def test_a_grid_of_more_than_64_pairs_is_an_error(frame):
    df = frame([([float(i) for i in range(66)],)], "grid array<double>")
    with pytest.raises(Exception, match="64 pairs"):
        df.select(s.dhash(F.col("grid"), 66)).collect()
    assert df.select(s.dhash(F.slice("grid", 1, 65), 65)).first()[0] == -1


def test_hash_encoding_keeps_lookalikes_apart(frame):
    df = frame([(1, "a|1:b", "c"), (2, "a", "b|1:c"), (3, None, "x"), (4, "None", "x"), (5, "null", "x")], "id int, a string, b string")
    hashed = k.add_hash(df, exclude=["id"])
    found = [r.hash for r in hashed.collect()]
    assert len(set(found)) == 5 and all(len(h) == 128 for h in found)
    one = k.add_hash(frame([("x",)], "a string")).first().hash
    assert one == hashlib.sha512(b"1:x").hexdigest()
    assert k.add_hash(hashed, exclude=["id"]).select("hash").distinct().count() == 5


def test_duplicates_and_first(frame):
    df = frame([("d", None, 3), ("d", None, 1), ("d", "v", 2), ("e", "v", 4)], "deck string, variant string, seq int", 4)
    assert rows(k.dedup_first(df, ["deck", "variant"], "seq")) == [("d", "v", 2), ("d", None, 1), ("e", "v", 4)]
    assert rows(k.duplicate_hashes(df, "deck")) == [("d", 3)]


@pytest.mark.parametrize("parts", [1, 8])
def test_dedup_merge_in_first_seen_order(frame, parts):
    data = [("h", "s2", "x", 0), ("h", "s1", "x", 1), ("h", "s2", "y", 2), ("g", "s9", "z", 3)]
    df = frame(data, "hash string, source string, image string, seq int", parts)
    merged = {r.hash: r for r in k.dedup_merge(df, "hash", ["source", "image"], "seq").collect()}
    assert merged["h"].source == ["s2", "s1"] and merged["h"].image == ["x", "y"] and merged["h"].seq == 0
    assert merged["g"].source == ["s9"] and len(merged) == 2


@SLOW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("pqrs")), min_size=1, max_size=20))
def test_merge_loses_no_source(spark, data):
    df = spark.createDataFrame([(h, v, i) for i, (h, v) in enumerate(data)], "hash string, source string, seq int")
    merged = {r.hash: r.source for r in k.dedup_merge(df, "hash", ["source"], "seq").collect()}
    want = {}
    for h, v in data:
        want.setdefault(h, [])
        if v not in want[h]:
            want[h].append(v)
    assert merged == want


def test_null_values_are_kept_in_merged_lists(frame):
    df = frame([("h", None, 0), ("h", "a", 1)], "hash string, source string, seq int")
    assert k.dedup_merge(df, "hash", ["source"], "seq").first().source == [None, "a"]


def test_hot_group_merges(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("hash"),
                                   (F.col("id") % 7).cast("string").alias("source"), "id")
    merged = k.dedup_merge(df, "hash", ["source"], "id")
    assert merged.count() == 20001
    assert merged.where("hash = 'hot'").first().source == ["0", "3", "6", "2", "5", "1", "4"]


def test_known_content_and_paths(frame):
    df = frame([(1, "old"), (2, "new")], "id int, content string")
    deny = frame([(hashlib.sha512(b"old").hexdigest(),)] * 2, "digest string")
    assert rows(k.drop_known_content(df, "content", deny)) == [(2, "new")]
    paths = frame([("card", "ff", "a.b.png"), ("card", "ff", "x.png"), ("card", "00", "noext")], "kind string, fp string, name string")
    found = paths.select(k.fingerprint_path(F.col("kind"), F.col("fp"), F.col("name"), {"card": "raw/cards/"}).alias("path"))
    assert rows(found) == [("raw/cards/00.noext",), ("raw/cards/ff.png",), ("raw/cards/ff.png",)]
    assert rows(k.path_collisions(found)) == [("raw/cards/ff.png", 2)]


def test_a_long_list_is_sifted_without_content(spark, frame):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 50 = 7 THEN NULL ELSE concat('text ', id % 1000) END AS content").repartition(5)
    deny = spark.range(0, 40000, 3).selectExpr("sha2(concat('text ', id), 512) AS digest").unionByName(frame([(None,)], "digest string"))
    out = k.drop_known_content(df, "content", deny, few=10)
    want = sorted(i for i in range(3000) if i % 50 == 7 or (i % 1000) % 3)
    assert sorted(r.id for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    # every digest of the list passes the filter, and few others do
    known = deny.where("digest is not null")
    marks = k.known_filter(known, "digest", 1 << 18)
    assert k.may_be_known(known, "digest", marks, 1 << 18, "may").where("not may").isEmpty()
    others = spark.range(5000).selectExpr("sha2(concat('other ', id), 512) AS digest")
    assert k.may_be_known(others, "digest", marks, 1 << 18, "may").where("may").count() < 500


def test_more_hits_than_are_sent_to_all(spark, monkeypatch):
    monkeypatch.setattr(k, "FEW", 5)
    df = spark.range(300).selectExpr("id", "concat('t', id) AS content")
    deny = spark.range(0, 300, 2).selectExpr("sha2(concat('t', id), 512) AS digest")
    assert sorted(r.id for r in k.drop_known_content(df, "content", deny, few=5).collect()) == list(range(1, 300, 2))


def test_max_ids(frame):
    got = k.max_ids({"a": frame([(1,), (5,)], "id int"), "b": frame([], "id int")})
    assert rows(got) == [("a", 5)]


def test_dhash_bits(frame):
    df = frame([([1.0, 2.0, 1.0, 3.0, 3.0, 4.0],)], "grid array<double>")
    assert df.select(s.dhash(F.col("grid"), 3)).first()[0] == 0b1001
    assert df.select(s.hex_hash(s.dhash(F.col("grid"), 3), 12)).first()[0] == "009"


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4])
def test_near_duplicates_equal_brute_force(spark, distance):
    import random
    rng = random.Random(distance)
    base = [rng.getrandbits(12) for _ in range(60)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(base + base[:10])], "id int, hash bigint")
    got = {(r.hash_a, r.hash_b, r.distance) for r in s.near_duplicates(df, "hash", "id", 12, distance).collect()}
    distinct = sorted(set(base))
    want = {(a, b, bin(a ^ b).count("1")) for a in distinct for b in distinct if a < b and bin(a ^ b).count("1") <= distance}
    assert got == want
