"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the nearest of the
signed axes. Each table has rotations of its own. A query looks into the buckets of its nearest axes, and
every vector found there is ranked by its exact distance. How many buckets it takes depends on the vectors, so a
sample of the queries is compared with all of them first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyshelf.llm.common import blocks_of, query, small_batches, table
from tidyshelf.session import pin

TABLES, PROBES = 16, 8
#: Queries that are compared with all vectors to choose the hashes and probes, and the share of their neighbours to be met.
SAMPLE, RECALL = 64, 0.95
#: Vectors of a bucket that meet in one block; a larger bucket is several blocks.
BLOCK = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    rows, n = x.shape
    half = 1
    while half < n:
        x = x.reshape(rows, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, n)
        half *= 2
    return x / np.sqrt(n)


def axes(unit: np.ndarray, number: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest signed axes of each row after pseudo-rotation ``number``, nearest first, and their nearness."""
    width = 1 << max(0, (unit.shape[1] - 1).bit_length())
    turned = np.zeros((len(unit), width))
    turned[:, :unit.shape[1]] = unit
    rng = np.random.default_rng((width, number))
    for _ in range(3):
        turned = hadamard(turned * rng.choice([-1.0, 1.0], width))
    near = np.concatenate([turned, -turned], axis=1)
    best = np.argsort(-near, axis=1, kind="stable")[:, :most]
    return best, np.take_along_axis(near, best, axis=1)


def choices_of(hashes: int, most: int, probes: int) -> list[tuple[int, ...]]:
    """Ranks of axes, one for each hash, whose sum can be among the ``probes`` nearest: all of no higher ranks are as near."""
    out: list = [((), 1)]
    for _ in range(hashes):
        out = [((*c, k), n * (k + 1)) for c, n in out for k in range(min(most, probes // n))]
    return [c for c, _ in out]


def buckets_of(vectors: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """Codes of the buckets of each row: ``probes`` for each table, nearest first.

    With several hashes to a table, the buckets are ordered by the nearness summed over its axes.
    """
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    wide = 2 << max(0, (unit.shape[1] - 1).bit_length())
    most = min(probes, wide)
    out = []
    for number in range(tables):
        found = [axes(unit, number * hashes + k, most) for k in range(hashes)]
        choices = choices_of(hashes, most, probes)
        near = np.stack([sum(found[k][1][:, c] for k, c in enumerate(choice)) for choice in choices], axis=1)
        code = np.stack([sum(found[k][0][:, c].astype(np.int64) * wide**k for k, c in enumerate(choice)) for choice in choices], axis=1)
        order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        out.append(np.take_along_axis(code, order, axis=1) * tables + number)
    return np.concatenate(out, axis=1)


def usable(vec: str) -> Column:
    """Neither null nor zero, and every component a finite number."""
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & whole & F.exists(vec, lambda x: x != 0), F.lit(False))


def hashed(vectors: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """``key``, ``ids`` and the vector as bytes, once for each bucket."""
    kind = np.float32 if dict(vectors.dtypes)["vec"] == "array<float>" else np.float64

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            lengths = np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(lengths)
            rows = [flat[e - n:e] for e, n in zip(ends, lengths)]
            codes: list = [None] * len(rows)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                found = buckets_of(np.stack([rows[i] for i in at]).astype(np.float64), tables, hashes, probes)
                for i, c in zip(at, found):
                    codes[i] = c
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("ids"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(codes, pa.list_(pa.int64()))],
                ["key", "ids", "vec", "buckets"])

    out = small_batches(vectors).select("key", "ids", "vec").mapInArrow(code, "key long, ids array<long>, vec binary, buckets array<long>")
    # vectors of another length never meet
    return out.select("key", "ids", "vec", F.explode("buckets").alias("bucket")).withColumn("bucket", F.xxhash64("bucket", F.length("vec")))


def ranked(index: DataFrame, queries: DataFrame, most: int, kind: type) -> DataFrame:
    """(query, key, score, ids): the ``most`` nearest of each block that a query looks into.

    A bucket of many vectors is dealt out over blocks, and its queries go to each of them.
    """
    sizes = index.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    left = index.join(sizes, "bucket").select(F.lit(0).alias("side"), "key", "ids", "vec", F.xxhash64("bucket", F.pmod(F.xxhash64("key"), "parts")).alias("block"))
    right = queries.join(sizes, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1))) \
        .select(F.lit(1).alias("side"), "key", F.array().cast("array<bigint>").alias("ids"), "vec", F.xxhash64("bucket", "part").alias("block"))
    asked = right.select("block").distinct()
    left = left.join(asked, "block", "left_semi").select(right.columns)  # buckets that nobody asks for stay where they are
    rows = left.unionByName(right).repartition("block").sortWithinPartitions("block", "side")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks_of(batches):
            block, side, key = (part.column(c).to_numpy() for c in ("block", "side", "key"))
            vec, ids = part.column("vec").to_pylist(), part.column("ids").to_pylist()
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            asked_key, found_key, score, found_ids = [], [], [], []
            for start, end in zip(edges[:-1], edges[1:]):
                middle = start + int(np.searchsorted(side[start:end], 1))
                if middle in (start, end):
                    continue
                base = np.frombuffer(b"".join(vec[start:middle]), kind).reshape(middle - start, -1).astype(np.float64)
                least = np.array([x[0] for x in ids[start:middle]])
                for q in range(middle, end):
                    away = np.sqrt(((base - np.frombuffer(vec[q], kind).astype(np.float64)) ** 2).sum(axis=1))
                    best = np.arange(len(away))
                    if len(away) > most:  # all that tie with the last stay in until the ids decide
                        best = np.flatnonzero(away <= np.partition(away, most - 1)[most - 1])
                    best = best[np.lexsort((least[best], away[best]))][:most]
                    asked_key += [key[q]] * len(best)
                    found_key += key[start + best].tolist()
                    score += away[best].tolist()
                    found_ids += [ids[start + i] for i in best]
            yield pa.RecordBatch.from_arrays([pa.array(asked_key, pa.int64()), pa.array(found_key, pa.int64()), pa.array(score, pa.float64()), pa.array(found_ids, pa.list_(pa.int64()))],
                                             ["query", "key", "score", "ids"])

    return rows.mapInArrow(rank, "query long, key long, score double, ids array<long>")


def met(pairs: list[tuple[np.ndarray, np.ndarray]], tables: int, hashes: int, probes: int) -> float:
    """Share of (query, neighbour) whose neighbour lies in a bucket that the query looks into."""
    found = 0
    for length in {len(q) for q, _ in pairs}:
        asking, base = (np.stack(x) for x in zip(*((q, v) for q, v in pairs if len(q) == length)))
        seen, held = buckets_of(asking, tables, hashes, probes), buckets_of(base, tables, hashes, 1)
        found += sum(bool(np.isin(a, b).any()) for a, b in zip(seen, held))
    return found / max(len(pairs), 1)


def probing(distinct: DataFrame, packed: DataFrame, top: int, tables: int, probes: int, hashes: int, wide: int, kind: type) -> tuple[int, int] | None:
    """The hashes and probes that compare the fewest vectors and meet RECALL of a sample's true neighbours; None if only all vectors do.

    At most SAMPLE queries, each with ``top`` neighbours, reach the driver.
    """
    few = distinct.where("asks").select("key").orderBy(F.xxhash64(F.lit("sample"), "key"), "key").limit(SAMPLE)
    true = ranked(packed, packed.join(few, "key", "left_semi"), top + 1, kind).where("query <> key").select("query", "key", "score")
    true = true.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "key"))).where(F.col("n") <= top).select("query", "key")
    true = pin(true, "true")
    wanted = true.select("key").union(true.select("query")).distinct()
    vec = {r.key: np.asarray(r.vec, np.float64) for r in distinct.join(wanted, "key", "left_semi").select("key", "vec").collect()}
    pairs = [(vec[r.query], vec[r.key]) for r in true.collect()]
    steps = {(h, p) for h in range(hashes, 0, -1) for p in (probes, 4 * probes, 16 * probes) if tables * p <= wide**h} | {(hashes, probes)}
    for h, p in sorted(steps, key=lambda s: (s[1] / wide**s[0], s)):
        if not pairs or met(pairs, tables, h, p) >= RECALL:
            return h, p
    return None


def nearest(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", top: int = 10,
            tables: int = TABLES, probes: int = PROBES, hashes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest rows found for each query row, by Euclidean distance.

    Equal vectors are one entry with its ``top`` + 1 least ids, which is all that any answer can need, so a vector held by a
    third of all rows weighs as one. Ties go to the smaller id. A query for which fewer than ``top`` are found is compared with
    all, in blocks. Null, zero and not finite vectors and null ids take no part; of rows alike in id and vector one does.
    ``hashes`` to a table grows by itself with the number of vectors, so that a bucket holds some hundreds. It is an upper bound, and
    ``probes`` a lower one: fewer and wider buckets or more probes are taken until a sample of the queries meets its true neighbours,
    and if that would compare as many vectors as there are, all are compared. The index holds
    every distinct vector once for each table, as bytes, so that the exact distances are worked out where a bucket lies.
    """
    kind = np.float32 if dict(vectors.dtypes)[embedding] == "array<float>" else np.float64
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable("vec"))
    # -0.0 is 0.0, and the key stands for the vector
    rows = rows.withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))).withColumn("key", F.xxhash64("vec"))
    keyed = pin(rows, "vectors")
    spread = keyed.select("key", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).distinct()
    for by in (["key", "salt"], ["key"]):  # a hot vector's ids are thinned in parts first
        spread = spread.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("n") <= top + 1)
    ids = spread.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = keyed.groupBy("key").agg(F.first("vec").alias("vec"), F.max("asks").alias("asks"))
    distinct = pin(distinct.join(ids, "key"), "distinct")
    count, size = distinct.agg(F.count("*"), F.max(F.size("vec"))).first()
    if hashes is None:
        hashes = max(1, round(np.log(max(count, 1) / 400) / np.log(max(2 * (size or 1), 4)))) if count else 1
    packed = distinct.select("key", "ids", packed_bytes(kind), F.xxhash64(F.size("vec")).alias("bucket"))
    asking = distinct.where("asks")
    way = probing(distinct, packed, top, tables, probes, hashes, 2 << max(0, ((size or 1) - 1).bit_length()), kind)
    if way is None:
        found = ranked(packed, packed.join(asking.select("key"), "key", "left_semi"), top + 1, kind)
    else:
        index = pin(hashed(distinct, tables, way[0], 1), "index")
        found = ranked(index, hashed(asking, tables, *way), top + 1, kind).dropDuplicates(["query", "key"])
    found = pin(found, "found")
    asked = keyed.where("asks").select(F.col("id").alias("query_id"), F.col("key").alias("query")).distinct()

    def listed(pairs: DataFrame) -> DataFrame:
        each = pairs.select("query", "score", F.explode("ids").alias("id"))
        each = each.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))).where(F.col("n") <= top + 1)
        out = each.select("query", "score", "id").join(asked, "query").where("id <> query_id")
        return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= top) \
            .select("query_id", "rank", F.col("id").alias("vec_id"), "score")

    answers = pin(listed(found), "answers")
    short = pin(asked.join(answers.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
                .where(F.coalesce("n", F.lit(0)) < top).select("query_id", "query"), "short")
    if short.isEmpty():
        return answers
    again = packed.join(short.select(F.col("query").alias("key")).distinct(), "key", "left_semi")
    rest = listed(ranked(packed, again, top + 1, kind)).join(short.select("query_id"), "query_id", "left_semi")
    return answers.join(short.select("query_id"), "query_id", "left_anti").unionByName(rest)


def packed_bytes(kind: type) -> Column:
    @F.pandas_udf("binary")
    def pack(vec):
        return vec.map(lambda v: np.asarray(v, kind).tobytes())

    return pack("vec").alias("vec")


@query("op7_nearest_neighbours")
def op7_nearest_neighbours(spark, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 100 == 0)
