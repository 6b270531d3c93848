"""Near-duplicate vectors by counting collisions of one-dimensional projections.

The vectors of length one are turned by a random rotation, so that their coordinates are as many projections as they
have dimensions. Around each vector lies a window on every projection, and a pair collides on a projection if one lies in
the window of the other. The difference of two vectors whose cosine reaches the threshold is no longer than
``radius = sqrt(2 - 2 * threshold)``, and its coordinates' squares sum to its squared length. Fewer than G of them can
therefore exceed radius / sqrt(G), the half width of the windows, so at least ``dim - G + 1`` windows collide: with
this count as the limit recall is 1, whatever the vectors are, and only pairs that reach it are verified.

The count is found without looking at all pairs: the projections are dealt into G groups, and a pair that misses fewer
than G windows misses none of at least one group. Sorted values of the projections cut each group's space into cells; a vector
lies in one cell of each group and asks in every cell that its windows touch.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm.common import blocks_of, fixed, fresh, query, small_batches, stacked, table
from tidyshelf.llm.components import components
from tidyshelf.llm.neighbours import usable
from tidyshelf.session import pin

#: Groups of projections, vectors of a cell that lie in one block, and vectors that ask in one block.
GROUPS, BLOCK, ASKING = 8, 8192, 16384
#: Blocks of a label whose space is not cut: below, the copies that cells take cost more than the comparisons they save.
UNCUT = 32
#: Vectors whose projections are sorted on the driver to place the cuts of the cells; the cuts only balance the cells.
SAMPLE = 10_000
#: Cuts of a projection; a cell uses some of them.
CUTS = 16
#: Pairs that are in memory at a time, and those whose projections are.
PAIRS, ROWS = 1 << 18, 1 << 13


@functools.cache
def rotation(dim: int) -> np.ndarray:
    """A random orthonormal matrix, the same wherever it is made."""
    turned, signs = np.linalg.qr(np.random.default_rng((dim, 11)).normal(size=(dim, dim)))
    return turned * np.where(np.diag(signs) < 0, -1.0, 1.0)


def groups_of(dim: int, most: int) -> list[np.ndarray]:
    """The projections dealt into groups of at least four, as far as there are."""
    return np.array_split(np.arange(dim), max(1, min(most, dim // 4)))


def half_width(dim: int, threshold: float, most: int) -> float:
    """Half the width of a window; a little more than the bound, for projections are rounded."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold) / len(groups_of(dim, most)))) + 1e-6


def projected(vectors: np.ndarray) -> np.ndarray:
    """The projections of each row; summed up one by one, so that a row's are the same wherever they are worked out."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.zeros_like(unit)
    for axis, row in enumerate(rotation(vectors.shape[1])):
        out += unit[:, axis:axis + 1] * row
    return out.astype(np.float32)


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for every length, one after another."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def cells(places: np.ndarray, columns: np.ndarray, cuts: np.ndarray, bits: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell of each row, and (row, cell) for all cells that the row's windows touch, in a space cut ``bits`` times in two."""
    own = np.zeros(len(places), np.int64)
    row, touched = np.arange(len(places)), np.zeros(len(places), np.int64)
    most = CUTS.bit_length() - 1
    for at, column in enumerate(columns):
        times = min(most, bits // len(columns) + (at < bits % len(columns)))
        if not times:
            continue
        step = CUTS >> times
        limits = cuts[step - 1::step, column]
        low, high = (np.searchsorted(limits, places[:, column] + by, "right") for by in (-width, width))
        own = own * (1 << times) + np.searchsorted(limits, places[:, column], "right")
        n = (high - low + 1)[row]
        touched = np.repeat(touched * (1 << times) + low[row], n) + ragged(n)
        row = np.repeat(row, n)
    return own, row, touched


def in_cells(distinct: DataFrame, cuts: dict[int, np.ndarray], threshold: float, groups: int, kind: type, payload: bool) -> DataFrame:
    """A row for each cell that a vector lies in (side 0) or asks in (side 1), with the vector as bytes if ``payload``.

    Where the space is not cut, there is one cell for all groups, of group -1.
    """
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column("bits").to_numpy()
            for rows, vectors in stacked(batch.column("vec")):
                dim = vectors.shape[1]
                places, width = projected(vectors), half_width(dim, threshold, groups)
                for number in np.unique(bits[rows]):
                    some = np.flatnonzero(bits[rows] == number)
                    for group, columns in enumerate(groups_of(dim, groups)) if number and dim in cuts else [(-1, [])]:
                        own, at, touched = cells(places[some], columns, cuts.get(dim), number, width)
                        at = np.concatenate([np.arange(len(some)), at])
                        code = np.concatenate([own, touched])
                        side = (np.arange(len(at)) >= len(some)).astype(np.int32)
                        for start in range(0, len(at), 20_000):
                            part = slice(start, start + 20_000)
                            picked = rows[some[at[part]]]
                            columns_out = [batch.column(c).take(pa.array(picked)) for c in ("key", "copies", "kin")]
                            if payload:
                                raw = [vectors[i].astype(kind).tobytes() for i in some[at[part]]]
                                columns_out.append(pa.array(raw, pa.binary()))
                            columns_out += [pa.array(np.full(len(picked), group, np.int32)), pa.array(code[part]), pa.array(side[part])]
                            yield pa.RecordBatch.from_arrays(columns_out, names)

    names = ["key", "copies", "kin", *(["vec"] if payload else []), "grp", "code", "side"]
    schema = "key long, copies long, kin long, " + ("vec binary, " if payload else "") + "grp int, code long, side int"
    out = small_batches(distinct).select("key", "copies", "kin", "bits", "vec").mapInArrow(place, schema)
    return out.withColumn("cell", F.xxhash64("kin", "grp", "code")).drop("kin", "code")


def meets(asking: tuple[np.ndarray, np.ndarray], lying: tuple[np.ndarray, np.ndarray], group: int, threshold: float, groups: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of the first, row of the second) of the pairs whose cosine reaches the threshold, in parts.

    A pair is looked at in the first group whose windows all collide, and so comes up once; where the space is not cut (group -1), all
    projections are one group, whose windows are as wide as one group needs. The second side is sorted by the group's first
    projection, the first side's windows are runs of it, and the group's other projections thin the pairs out, before all collisions are
    counted. Of two vectors that ask for each other, the one with the lesser first projection finds the other (equal: the lesser key).
    """
    (keys, vectors), (base_keys, base) = asking, lying
    dim = vectors.shape[1]
    parts, index = groups_of(dim, groups if group >= 0 else 1), half_width(dim, threshold, groups if group >= 0 else 1)
    left, right = projected(vectors), projected(base)
    columns = parts[max(group, 0)]
    order = np.argsort(right[:, columns[0]], kind="stable")
    right, base_keys, base = right[order], base_keys[order], base[order]
    by_left, by_right = np.ascontiguousarray(left[:, columns].T), np.ascontiguousarray(right[:, columns].T)
    norms, base_norms = np.linalg.norm(vectors, axis=1), np.linalg.norm(base, axis=1)
    width, least = half_width(dim, threshold, groups), dim - len(groups_of(dim, groups)) + 1
    low, high = np.searchsorted(by_right[0], by_left[0], "left"), np.searchsorted(by_right[0], by_left[0] + np.float32(index), "right")
    ends = np.cumsum(high - low)
    start = 0
    while start < len(keys):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        n = (high - low)[start:stop]
        i = np.repeat(np.arange(start, stop, dtype=np.int32), n)
        j = (np.repeat(low[start:stop], n) + ragged(n)).astype(np.int32)
        start = stop
        for c in range(1, len(columns)):  # as long as it thins them out
            near = np.abs(by_left[c][i] - by_right[c][j]) <= index
            before = len(i)
            i, j = i[near], j[near]
            if len(i) > 0.95 * before:
                break
        keep = (by_left[0][i] < by_right[0][j]) | (by_left[0][i] == by_right[0][j]) & (keys[i] < base_keys[j])
        keep &= keys[i] != base_keys[j]
        i, j = i[keep], j[keep]
        for at in range(0, len(i), ROWS):
            a, b = i[at:at + ROWS], j[at:at + ROWS]
            apart = np.abs(left[a] - right[b])
            collides = apart <= index
            keep = collides[:, parts[max(group, 0)]].all(axis=1) & ((apart <= width).sum(axis=1) >= least)
            for earlier in parts[:max(group, 0)]:
                keep &= ~collides[:, earlier].all(axis=1)
            a, b = a[keep], b[keep]
            keep = np.einsum("nd,nd->n", vectors[a], base[b]) / (norms[a] * base_norms[b]) >= threshold
            yield a[keep], order[b[keep]]


def hooked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each place is joined with, once the pairs are joined as well."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return root
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98,
                    groups: int = GROUPS, block: int = BLOCK, uncut: int = UNCUT) -> DataFrame:
    """``vectors`` with n_links, component_id and kept: links join rows of one label whose cosine is at least ``threshold``.

    No link is missed (see the module), so links are those of comparing all pairs. Of the links of a block only counts and a spanning
    forest go on, never the pairs. Equal vectors of a label are one vector with a number of copies. A row whose id, label or
    vector is null, whose vector is zero or holds null or not finite components, links with nothing, nor do vectors of different
    lengths; its component is its own id. Repeated rows are one vector, each of them is returned; rows that share an id but not the vector
    are one place of the graph, whose links are those of all. Other columns are kept, but for those
    of the outputs' names, which are replaced; an empty table gives an empty one.

    Spaces of labels with more than ``uncut`` times ``block`` vectors are cut so that a cell holds about ``block`` of them. Where a cell holds more, it is dealt over
    blocks of that size, and those that ask in it over blocks of ASKING, so that a block's size is bounded.
    """
    kind = np.float32 if dict(vectors.dtypes)[embedding] == "array<float>" else np.float64
    one, two, node, links, root = fresh(vectors, "__one", "__two", "__node", "__links", "__root")
    given = vectors.withColumn(node, F.col(vec_id).cast("long"))
    plain = F.transform(embedding, lambda x: F.when(x == 0, F.abs(x)).otherwise(x))
    fit = F.col(node).isNotNull() & F.col(label).isNotNull() & usable(embedding)
    # two hashes stand for label and vector
    given = given.withColumn(one, F.when(fit, F.xxhash64(F.col(label), plain))).withColumn(two, F.when(fit, F.xxhash64(F.lit(2), plain, F.col(label))))
    alike = given.where(F.col(one).isNotNull()).groupBy(one, two).agg(
        F.min(node).alias("key"), F.count_distinct(node).alias("copies"), F.first(embedding).alias("vec"), F.first(F.xxhash64(F.col(label), F.size(embedding))).alias("kin"))
    alike = pin(alike, "alike")
    crowds = alike.groupBy("kin").agg(F.count("*").alias("n")).where(F.col("n") > uncut * block) \
        .select("kin", F.round(F.log2(F.col("n") / block)).cast("int").alias("bits"))
    alike = alike.join(crowds, "kin", "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    cuts = {}
    if alike.where("bits > 0").limit(1).count():
        sample = alike.where("bits > 0").select("vec").orderBy(F.xxhash64("key", F.lit("sample"))).limit(SAMPLE).toArrow()
        for _, some in stacked(sample.column("vec").combine_chunks()):
            cuts[some.shape[1]] = np.quantile(projected(some), np.arange(1, CUTS) / CUTS, axis=0)

    def dealt(payload: bool) -> DataFrame:
        return in_cells(alike, cuts, threshold, groups, kind, payload)

    # a cell matters if a vector lies in it and another one asks
    sizes = dealt(False).groupBy("cell").agg(F.count(F.when(F.col("side") == 0, 1)).alias("base"), F.count(F.when(F.col("side") == 1, 1)).alias("asking"))
    sizes = pin(sizes.where("base > 0 and asking > 1").select(
        "cell", F.ceil(F.col("base") / block).cast("int").alias("parts"), F.ceil(F.col("asking") / ASKING).cast("int").alias("rounds")), "sizes")
    rows = dealt(True).join(sizes, "cell")
    of = F.when(F.col("side") == 0, F.pmod(F.xxhash64("key"), "parts")).otherwise(F.pmod(F.xxhash64("key"), "rounds")).cast("int")
    other = F.when(F.col("side") == 0, F.col("rounds")).otherwise(F.col("parts"))
    rows = rows.withColumn("of", of).withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    part, turn = (F.when(F.col("side") == s, F.col("of")).otherwise(F.col("other")) for s in (0, 1))
    rows = rows.select("key", "copies", "vec", "grp", "side", F.xxhash64("cell", part, turn).alias("block"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in blocks_of(batches):
            ids, side, keys, copied, grp = (held.column(c).to_numpy() for c in ("block", "side", "key", "copies", "grp"))
            edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
            out: list[list] = [[], [], []]
            for start, end in zip(edges[:-1], edges[1:]):
                middle = start + int(np.searchsorted(side[start:end], 1))
                if middle in (start, end) or end - middle == 1 and middle - start == 1 and keys[start] == keys[middle]:
                    continue
                raw = fixed(held.column("vec").slice(start, end - start), kind).reshape(end - start, -1).astype(np.float64)
                base, asking = slice(start, middle), slice(middle, end)
                nodes, place = np.unique(keys[start:end], return_inverse=True)
                root, linked, counts = np.arange(len(nodes)), np.zeros(len(nodes), bool), np.zeros(len(nodes), np.int64)
                for i, j in meets((keys[asking], raw[middle - start:]), (keys[base], raw[:middle - start]), int(grp[start]), threshold, groups):
                    a, b = place[middle - start:][i], place[:middle - start][j]
                    np.add.at(counts, a, copied[base][j])
                    np.add.at(counts, b, copied[asking][i])
                    linked[a] = linked[b] = True
                    root = hooked(root, a, b)
                for column, values in zip(out, (nodes[linked], nodes[root[linked]], counts[linked])):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["a", "b", "n"])

    found = pin(rows.repartition("block").sortWithinPartitions("block", "side").mapInArrow(match, "a long, b long, n long"), "found")
    places = components(found.select("a", "b"))
    places = places.select(F.col("node").alias("key"), F.col("root").alias(root))
    counts = found.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    of_key = alike.groupBy("key").agg(F.sum(F.col("copies") - 1).alias("others")).join(counts, "key", "left").join(places, "key", "left") \
        .select("key", (F.col("others") + F.coalesce("n", F.lit(0))).alias(links), F.coalesce(root, "key").alias(root)).where(F.col(links) > 0)
    facts = alike.select(one, two, "key").join(of_key, "key").drop("key")
    out = given.join(facts, [one, two], "left")
    out = out.withColumns({"n_links": F.coalesce(F.col(links), F.lit(0).cast("bigint")), "component_id": F.coalesce(F.col(root), F.col(node)),
                           "kept": F.coalesce(F.col(node) == F.coalesce(F.col(root), F.col(node)), F.lit(False))})
    return out.drop(one, two, node, links, root)


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), fit AS (
  SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), linked AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98
), reached AS (
  SELECT vec_id AS x, vec_id AS y FROM fit
  UNION
  SELECT r.x, l.y FROM reached r JOIN linked l ON r.y = l.x
), least AS (
  SELECT x, min(y) AS y FROM reached GROUP BY x
), counted AS (
  SELECT x, count(*) AS n FROM linked GROUP BY x
)
SELECT v.vec_id, coalesce(n, 0) AS n_links, coalesce(least.y, v.vec_id) AS component_id, coalesce(least.y, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN counted ON counted.x = v.vec_id LEFT JOIN least ON least.x = v.vec_id
"""


@query("op11_embedding_near_dedup", OP11_SQL)
def op11_embedding_near_dedup(spark, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    return near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept")
