import random

import pytest
from conftest import rows

from tidyshelf.operators import graph, similar


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(hashes, distance):
    return sorted((a, b, bin((a ^ b) & ((1 << 64) - 1)).count("1")) for a in set(hashes) for b in set(hashes)
                  if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= distance)


@pytest.mark.parametrize("distance, crowd", [(1, 1000), (1, 3), (4, 20), (9, 60)])
def test_close_pairs_are_those_of_comparing_all(frame, distance, crowd):
    rng = random.Random(distance)
    hashes = [rng.getrandbits(64) for _ in range(60)]
    for h in hashes[:30]:  # close ones, and many that share their upper half
        for flips in range(1, 7):
            hashes.append(h ^ sum(1 << b for b in rng.sample(range(64), flips)))
    hashes += [(7 << 40) | rng.getrandbits(16) for _ in range(120)]
    hashes = [signed(h) for h in hashes]
    df = frame([(i, h) for i, h in enumerate([*hashes, hashes[0], None])], "id bigint, h bigint")
    got = sorted(tuple(r) for r in similar.close_pairs(df, "h", distance, crowd=crowd).collect())
    assert got == brute(hashes, distance) and len(got) > 20


def test_look_alikes_follow_chains(frame):
    chain = [(1 << i) - 1 for i in range(12)]  # each differs from the next by one bit
    df = frame([(20 - i, h) for i, h in enumerate(chain)] + [(1, signed((1 << 64) - 1)), (2, None), (3, chain[4])], "id bigint, h bigint")
    got = {(r.id, r.h): r.group for r in similar.look_alikes(df, "h", "id", 1).collect()}
    assert got == {**{(20 - i, h): chain[4] for i, h in enumerate(chain)}, (1, -1): -1, (2, None): None, (3, chain[4]): chain[4]}


def test_a_long_chain_is_one_group_in_few_rounds(spark, monkeypatch):
    pins = []
    pin = graph.pin
    monkeypatch.setattr(graph, "pin", lambda df, label: pins.append(label) or pin(df, label))
    links = spark.range(9999).selectExpr("id * 7919 % 10000 AS a", "(id + 1) * 7919 % 10000 AS b")
    out = graph.linked_groups(links, "a", "b")
    assert out.count() == 10000 and rows(out.select("group").distinct()) == [(0,)]
    assert pins.count("moves") <= 12


def test_groups_of_nothing_and_of_loops(frame):
    assert graph.linked_groups(frame([], "a int, b int"), "a", "b").count() == 0
    df = frame([(1, 1), (2, 3), (3, 2), (5, None), (None, 6)], "a int, b int")
    assert rows(graph.linked_groups(df, "a", "b"), "member", "group") == [(1, 1), (2, 2), (3, 2)]


def test_reachable(frame):
    links = frame([(1, 2), (2, 3), (3, 1), (3, 4), (1, 4), (8, 9), (4, None)], "a int, b int")
    assert rows(graph.reachable(frame([(1,), (None,)], "id int"), links, "a", "b")) == [(1, 0), (2, 1), (3, 2), (4, 1)]


def test_hashes_under_no_key_are_compared_in_blocks(frame, monkeypatch):
    rng = random.Random(3)
    hashes = [rng.getrandbits(64) for _ in range(700)] + [0, (1 << 64) - 1, 1 << 63, (1 << 63) - 1]
    hashes += [h ^ sum(1 << b for b in rng.sample(range(64), flips)) for h in hashes[:300] for flips in (3, 16, 17)]
    hashes = [signed(h) for h in hashes]
    df = frame([(i, h) for i, h in enumerate([*hashes, hashes[0], None])], "id bigint, h bigint")
    sizes = []
    compared = similar._compared
    monkeypatch.setattr(similar, "_compared", lambda *args: sizes.append(compared(*args)) or sizes[-1])
    got = sorted(tuple(r) for r in similar.close_pairs(df, "h", 16, block=100).collect())
    assert got == brute(hashes, 16) and len(got) > 600
    # no task holds more than a few pairs of blocks: 17 blocks, each with each and with itself
    assert [d.rdd.getNumPartitions() for d in sizes] == [17 * 18 // 2]


@pytest.mark.parametrize("full", [1, 50])
def test_blocks_under_several_keys(frame, monkeypatch, full):
    monkeypatch.setattr(similar, "FULL", full)
    monkeypatch.setattr(similar, "CHUNK", 40)
    rng = random.Random(5)
    hashes = [signed((top << 60) | rng.getrandbits(20)) for top in (1, 9) for _ in range(80)]
    df = frame([(i, h) for i, h in enumerate(hashes)], "id bigint, h bigint")
    got = sorted(tuple(r) for r in similar.close_pairs(df, "h", 5, crowd=10, block=15).collect())
    assert got == brute(hashes, 5) and len(got) > 100


def test_look_alikes_of_a_crowd_are_compared_in_blocks(frame, monkeypatch):
    rng = random.Random(8)
    hashes = [rng.getrandbits(64) for _ in range(500)]
    hashes += [h ^ sum(1 << b for b in rng.sample(range(64), 9)) for h in hashes[:400]]
    hashes = [signed(h) for h in hashes + [h ^ sum(1 << b for b in rng.sample(range(64), 10)) for h in hashes[500:700]]]
    group = {h: h for h in hashes}

    def root(h):
        while group[h] != h:
            h = group[h]
        return h

    place = {h: i for i, h in enumerate(hashes)}
    for a, b, _ in brute(hashes, 16):
        a, b = sorted((root(a), root(b)), key=place.get)
        group[b] = a
    compared, calls = similar._compared, []
    monkeypatch.setattr(similar, "_compared", lambda *args: calls.append(args) or compared(*args))
    got = {r.h: r.group for r in similar.look_alikes(frame(list(enumerate(hashes)), "id bigint, h bigint"), "h", "id", 16).collect()}
    assert len(calls) == 1 and len(hashes) > similar.CROWD
    assert got == {h: root(h) for h in hashes}
