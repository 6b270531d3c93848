"""The operators on vectors of this round, against brute force; nulls, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyshelf.llm import codes, neardup, negatives

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id bigint, label int, embedding array<float>, key string, n_links string, code string, row string, `__node` int, block int"
EXTRA = ("k", "l", "c", "r", 1, 2)
ODD = [(5900, 1, None), (5901, 1, [0.0] * 16), (5902, 1, [1.0, None] + [0.0] * 14), (5903, 1, [NAN] + [1.0] * 15), (5904, 1, [INF] + [1.0] * 15), (5905, None, [1.0] * 16), (None, 1, [1.0] * 16)]


def clustered(seed, n, dim=16, labels=3):
    """Vectors in tight groups, of which some straddle the threshold, with copies and multiples."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    out = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=dim) * rng.choice([0.05, 0.1, 0.3, 1.0]) if i % 3 else rng.normal(size=dim)
        out.append((int(i * 7 % 997), int(rng.integers(labels)), np.float32(v).tolist()))
    out += [(1000 + i, *out[i][1:]) for i in range(5)] + [(1100 + i, out[i][1], (2 * np.float32(out[i][2])).tolist()) for i in range(5)]
    return out


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(parts)


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


# near duplicates

def links(rows, threshold):
    fit = [r for r in rows if r[0] is not None and r[1] is not None and usable(r[2]) and any(r[2])]
    near = {r[0]: set() for r in rows}
    for a in fit:
        for b in fit:
            if a[0] != b[0] and a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = np.array(a[2], float), np.array(b[2], float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    near[a[0]].add(b[0])
    return near


def component(near, start):
    seen, todo = {start}, [start]
    while todo:
        for x in near[todo.pop()] - seen:
            seen.add(x)
            todo.append(x)
    return min(seen)


@pytest.mark.parametrize("threshold, settings", [(0.98, {}), (0.98, {"block": 8, "uncut": 4}), (0.9, {"block": 5, "groups": 3, "uncut": 2}), (0.98, {"block": 20, "groups": 1, "uncut": 1}), (0.98, {"block": 30}), (0.999, {})])
def test_links_are_those_of_all_pairs(spark, threshold, settings):
    rows = clustered(1, 300) + ODD + [(2000, 1, [1.0] * 7), (2001, 1, [1.0] * 7)]
    near = links(rows, threshold)
    out = neardup.near_duplicates(frame(spark, rows), threshold=threshold, **settings)
    assert out.columns == ["vec_id", "label", "embedding", "key", "n_links", "code", "row", "__node", "block", "component_id", "kept"]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    assert len(got) == len(rows) and max(len(x) for x in near.values()) > 5 * (threshold < 0.99)
    for r in rows:
        least = None if r[0] is None else component(near, r[0])
        assert got[r[0]] == (0 if r[0] is None else len(near[r[0]]), least, r[0] is not None and least == r[0])


def test_repeated_rows_are_one_vector(spark):
    rows = [(3, 0, [1.0, 0.0]), (3, 0, [1.0, 0.0]), (5, 0, [1.0, 0.0]), (7, 0, [0.0, 1.0]), (9, 0, [-0.0, 2.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect())
    assert got == [(3, 1, 3, True), (3, 1, 3, True), (5, 1, 3, False), (7, 1, 7, True), (9, 1, 7, False)]
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    assert neardup.near_duplicates(frame(spark, ODD)).where("n_links > 0 or kept and vec_id is null").count() == 0


def test_half_widths_bound_the_misses():
    rng = np.random.default_rng(5)
    for dim in (1, 3, 16, 64, 100):
        a = rng.normal(size=(400, dim))
        b = a + rng.normal(size=(400, dim)) * 0.02 if dim > 1 else a * 3
        cos = (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
        least = float(cos.min())
        missed = (np.abs(neardup.projected(a) - neardup.projected(b)) > neardup.half_width(dim, least, 8)).sum(axis=1)
        assert missed.max() < len(neardup.groups_of(dim, 8))


# hard negatives

def mined(rows, anchors, positives=5, negatives=3):
    fit = {}
    for r in sorted((r for r in rows if r[0] is not None and r[1] is not None and usable(r[2])), key=lambda r: (r[0], r[1], r[2])):
        fit.setdefault(r[0], (r[1], [int(np.floor(256 * float(np.float32(x)))) for x in r[2]]))
    out = []
    for a in fit:
        if not anchors(a):
            continue
        score = {b: sum(x * y for x, y in zip(fit[a][1], fit[b][1])) for b in fit if b != a and len(fit[b][1]) == len(fit[a][1])}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if fit[b][0] == fit[a][0]][:positives]:
            hard = [b for b in order if fit[b][0] != fit[a][0] and 50 * score[p] <= 100 * score[b] <= 95 * score[p]][:negatives]
            out += [(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 1e-3, 3e4])
def test_negatives_are_those_of_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(negatives, "CANDIDATES", 100)
    rows = [(i, l, [float(np.float32(x * size)) for x in v]) for i, l, v in clustered(2, 400)]
    rows += [(3000 + i, 2, rows[1][2]) for i in range(6)]  # ties
    rows += [rows[0], (rows[0][0], 9, rows[5][2]), (3500, 0, [size] * 7), (3501, 0, [size] * 7), (3502, 1, [size * 0.8] * 7)] + ODD
    out = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows, lambda i: i % 5 == 0)
    assert sorted(tuple(r) for r in out.collect()) == want and (len(want) > 100 or size < 1)


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(3)
    a, b = negatives.Summaries(np.floor(rng.normal(size=(30, 50)) * 99)), negatives.Summaries(np.floor(rng.normal(size=(40, 50)) * 99))
    score, width = a.vectors @ b.vectors.T, np.inf
    for level in range(len(a.means)):
        middle, give = a.means[level] @ b.means[level].T, a.deviations[level] @ b.deviations[level].T
        assert (np.abs(score - middle) <= give + 1e-6).all() and give.mean() < width
        width = give.mean()


def test_no_negatives(spark):
    assert negatives.hard_negatives(frame(spark, []), F.lit(True)).count() == 0
    assert negatives.hard_negatives(frame(spark, ODD), F.lit(True)).count() == 0
    assert negatives.hard_negatives(frame(spark, [(1, 0, [1.0, 2.0])]), F.lit(True)).count() == 0
    with pytest.raises(ValueError, match="too large"):
        negatives.hard_negatives(frame(spark, [(1, 0, [1e20, 2.0])]), F.lit(True))


# codes

def coded(rows, parts, many, rounds, scale=4096):
    kept = sorted([r for r in rows if usable(r[2])], key=lambda r: (r[0] is None, r[0], r[2]))
    x = np.array([[int(np.floor(scale * float(np.float32(v)))) for v in r[2]] for r in kept], np.int64).reshape(len(kept), parts, -1)
    books = x[:many].transpose(1, 0, 2).copy()
    near = lambda: ((x[:, :, None] - books[None]) ** 2).sum(-1)
    for _ in range(rounds):
        nearest = near().argmin(-1)
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[nearest[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(0) // len(mine)
    away = near()
    code = ["".join(f"{c:02x}" for c in r) for r in away.argmin(-1)]
    return sorted((r[0] is None, r[0], c, int(e)) for r, c, e in zip(kept, code, away.min(-1).sum(-1))), books


@pytest.mark.parametrize("n, parts, many, rounds, batch", [(400, 8, 16, 6, 8192), (400, 4, 5, 9, 50), (10, 8, 16, 6, 3), (300, 2, 200, 3, 64), (300, 16, 7, 12, 100)])
def test_codes_are_those_of_comparing_all(spark, monkeypatch, n, parts, many, rounds, batch):
    monkeypatch.setattr(codes, "ROWS", batch)
    rows = clustered(4, n) + [(4000 + i, 1, [1.0] * 16) for i in range(20)] + ODD  # many ties
    out, books = codes.compress(frame(spark, rows), parts=parts, many=many, rounds=rounds, keep=("label", "row"))
    assert out.columns == ["vec_id", "label", "row", "code", "error"]
    want, brute = coded(rows, parts, many, rounds)
    assert (books == brute).all()
    assert sorted((r.vec_id is None, r.vec_id, r.code, r.error) for r in out.collect()) == want


def test_codes_of_little(spark):
    out, books = codes.compress(frame(spark, []))
    assert out.count() == 0 and books.size == 0 and len(codes.digest(books)) == 64
    out, books = codes.compress(frame(spark, ODD[:1] + [(1, None, [1.0] * 8)] * 3), many=4)
    assert [(r.code, r.error) for r in out.collect()] == [("00" * 8, 0)] * 3
    for wrong in ([(1, 0, [1.0] * 8), (2, 0, [1.0] * 16)], [(1, 0, [1.0] * 9)], [(1, 0, [1e30] * 8)]):
        with pytest.raises(ValueError):
            codes.compress(frame(spark, wrong))


def test_settled_balls_are_passed_over():
    """In the last rounds of groups that lie far apart no part is compared any more, and the codes stay right."""
    rng = np.random.default_rng(9)
    parts = np.concatenate([rng.integers(-9, 9, size=(50, 4)) + 1000 * k for k in range(3)])
    entries = np.array([[0] * 4, [1000] * 4, [2000] * 4])
    home = np.repeat([0, 1, 2], 50)
    reach = np.full(3, 40.0)
    nearest, away = codes.assign(parts, home, entries, reach, np.array([True, False, True]))
    assert (nearest == home).all() and (away[50:100] >= 0).all() and (np.delete(away, range(50, 100)) == -1).all()
