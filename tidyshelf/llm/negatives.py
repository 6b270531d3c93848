"""Hard negatives by summaries of segments.

A vector is cut into segments, and of each the mean and the deviation are kept. The inner product of two segments of n components is
n times the product of the means, give or take at most n times the product of the deviations. Summed over the segments this
bounds a score from both sides. A pair whose bounds lie outside what is asked for, or below the best found so far, is dropped; for
the others the segments are halved, and what the finest segments leave is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyshelf.llm.common import fixed, query, small_batches, table
from tidyshelf.session import pin

#: Segments of a vector, level by level.
LEVELS = (4, 8, 16, 32)
#: Anchors that are held by a task, those that are compared at a time, and candidates that a task reads one batch after another.
ANCHORS, TOGETHER, CANDIDATES = 16384, 512, 8192
#: Tasks for each block of anchors, until each of them reads ANY candidates.
TASKS, ANY = 64, 1 << 20
#: Under this share of a batch's pairs, bounds are worked out pair by pair.
SPARSE = 1 / 16
LOW, HIGH = -(1 << 62), 1 << 62


class Summaries:
    """Vectors with the means and deviations of their segments at each level, times the root of the segments' lengths."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.means, self.deviations = [], []
        for level in LEVELS:
            if level < vectors.shape[1]:
                bounds = np.linspace(0, vectors.shape[1], level + 1).astype(int)
                n = np.diff(bounds)
                mean = np.add.reduceat(vectors, bounds[:-1], axis=1) / n
                spread = np.add.reduceat((vectors - np.repeat(mean, n, axis=1)) ** 2, bounds[:-1], axis=1)
                self.means.append(mean * np.sqrt(n))
                self.deviations.append(np.sqrt(spread))

    def of(self, rows) -> Summaries:
        part = object.__new__(Summaries)
        part.vectors, part.means, part.deviations = self.vectors[rows], [m[rows] for m in self.means], [d[rows] for d in self.deviations]
        return part


def scored(asking: Summaries, lying: Summaries, allowed: np.ndarray, least: np.ndarray, most: np.ndarray, idle: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the first, row of the second, score) of the allowed pairs with a score of ``least`` to ``most`` of the first's row.

    A level that hardly drops any pair is marked in ``idle`` and passed over from then on.
    """
    live, pairs = allowed & (least <= most)[:, None], None
    slack = 0.5  # scores are whole numbers, bounds are rounded
    for level in range(len(lying.means)):
        if idle[level]:
            continue
        before = len(pairs[0]) if pairs else np.count_nonzero(live)
        if not before:
            break
        if pairs is None and before < SPARSE * live.size:
            pairs = np.nonzero(live)
        if pairs is None:
            middle = asking.means[level] @ lying.means[level].T
            give = asking.deviations[level] @ lying.deviations[level].T
            live &= (middle + give > least[:, None] - slack) & (middle - give < most[:, None] + slack)
            after = np.count_nonzero(live)
        else:
            i, j = pairs
            middle = np.einsum("ns,ns->n", asking.means[level][i], lying.means[level][j])
            give = np.einsum("ns,ns->n", asking.deviations[level][i], lying.deviations[level][j])
            keep = (middle + give > least[i] - slack) & (middle - give < most[i] + slack)
            pairs = i[keep], j[keep]
            after = len(pairs[0])
        idle[level] = before > 1000 and after > 0.98 * before
    if pairs is None and np.count_nonzero(live) < SPARSE * live.size:
        pairs = np.nonzero(live)
    if pairs is None:
        score = asking.vectors @ lying.vectors.T
        i, j = np.nonzero(live & (score >= least[:, None]) & (score <= most[:, None]))
        return i, j, score[i, j].astype(np.int64)
    i, j = pairs
    score = np.einsum("nd,nd->n", asking.vectors[i], lying.vectors[j])
    keep = (score >= least[i]) & (score <= most[i])
    return i[keep], j[keep], score[keep].astype(np.int64)


class Asking:
    """The anchors of a task, each with its ranges of scores, and the best candidates found so far in every range."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, vectors: np.ndarray, ranges: list[tuple[np.ndarray, np.ndarray]], top: int, same: bool):
        self.keys, self.labels, self.summaries, self.top, self.same = keys, labels, Summaries(vectors), top, same
        self.low, self.high = np.stack([r[0] for r in ranges], axis=1), np.stack([r[1] for r in ranges], axis=1)
        self.best = self.low.copy()  # the least score that may still enter
        self.found: list = [(np.empty(0, np.int64),) * 3] * len(ranges)
        self.idle = [False] * len(LEVELS)
        self.kin = {label: np.flatnonzero(labels == label) for label in np.unique(labels)} if same else {None: np.arange(len(keys))}

    def see(self, keys: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        lying = Summaries(vectors)
        for label, rows in self.kin.items():
            at = np.flatnonzero(labels == label) if self.same else np.arange(len(keys))
            if len(at):
                part = lying if len(at) == len(keys) else lying.of(at)
                for start in range(0, len(rows), TOGETHER):
                    self.compare(rows[start:start + TOGETHER], part, keys[at], labels[at])

    def compare(self, rows: np.ndarray, lying: Summaries, keys: np.ndarray, labels: np.ndarray) -> None:
        allowed = self.keys[rows][:, None] != keys
        if not self.same:
            allowed &= self.labels[rows][:, None] != labels
        open_ = self.best[rows] <= self.high[rows]
        least = np.where(open_, self.best[rows], HIGH).min(axis=1)
        most = np.where(open_, self.high[rows], LOW).max(axis=1)
        i, j, score = scored(self.summaries.of(rows), lying, allowed, least, most, self.idle)
        i = rows[i]
        for r in range(self.low.shape[1]):
            fits = (score >= self.best[i, r]) & (score <= self.high[i, r])
            if not fits.any():
                continue
            here = np.isin(self.found[r][0], rows, assume_unique=False)
            held = [c[here] for c in self.found[r]]
            rest = [c[~here] for c in self.found[r]]
            row, s, key = (np.concatenate(c) for c in zip(held, (i[fits], score[fits], keys[j[fits]])))
            order = np.lexsort((key, -s, row))
            row, s, key = row[order], s[order], key[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            keep = place < self.top
            full = place == self.top - 1
            self.best[row[full], r] = np.maximum(self.best[row[full], r], s[full])
            self.found[r] = tuple(np.concatenate(c) for c in zip(rest, (row[keep], s[keep], key[keep])))


def best(rows: DataFrame, asks: DataFrame, top: int, same: bool, kind: type, exact: bool) -> DataFrame:
    """(key, range, candidate, score): the ``top`` candidates of each range of every anchor, higher scores first, ties to the lesser id.

    ``rows`` has id, label, size and vec; ``asks`` the same and the arrays low and high. Candidates are of the anchor's label if
    ``same``, else of another one. Each block of anchors meets all candidates, dealt over tasks that read them batch by batch.
    """
    n, anchors = rows.count(), asks.count()
    blocks = max(1, -(-anchors // ANCHORS))
    tasks = max(1, min(-(-n // CANDIDATES), max(TASKS, -(-n // ANY))))
    every = [F.explode(F.sequence(F.lit(0), F.lit(k - 1))) for k in (blocks, tasks)]
    empty = F.array().cast("array<bigint>")
    left = asks.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("task", every[1]).withColumn("side", F.lit(0))
    right = rows.withColumn("task", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(tasks)).cast("int")).withColumn("block", every[0]) \
        .select("*", empty.alias("low"), empty.alias("high"), F.lit(1).alias("side"))
    both = left.unionByName(right.select(left.columns)).withColumn("block", F.xxhash64("block", "task", "size")).drop("task", "size")
    both = both.repartition("block").sortWithinPartitions("block", "side", "id")
    number = np.float64 if exact else np.int64

    def vectors_of(batch: pa.RecordBatch) -> np.ndarray:
        return fixed(pa.chunked_array([batch.column("vec")]), kind).reshape(batch.num_rows, -1).astype(number)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, asking = None, [], None

        def result() -> Iterator[pa.RecordBatch]:
            if asking is not None:
                for r, (row, score, key) in enumerate(asking.found):
                    yield pa.RecordBatch.from_arrays([pa.array(asking.keys[row]), pa.array(np.full(len(row), r, np.int32)), pa.array(key), pa.array(score)],
                                                     ["key", "range", "candidate", "score"])

        for batch in small_runs(batches):
            if batch.column("block")[0].as_py() != block:
                yield from result()
                block, held, asking = batch.column("block")[0].as_py(), [], None
            side = batch.column("side").to_numpy()
            middle = int(np.searchsorted(side, 1))
            if middle:
                held.append(batch.slice(0, middle))
            if middle < len(side) and held:
                if asking is None:
                    all_ = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    ranges = [np.stack(all_.column(c).to_pylist()).astype(np.int64).reshape(all_.num_rows, -1) for c in ("low", "high")]
                    asking = Asking(all_.column("id").to_numpy(), all_.column("label").to_numpy(), vectors_of(all_),
                                    list(zip(ranges[0].T, ranges[1].T)), top, same)
                rest = batch.slice(middle)
                asking.see(rest.column("id").to_numpy(), rest.column("label").to_numpy(), vectors_of(rest))
        yield from result()

    found = both.mapInArrow(search, "key long, range int, candidate long, score long")
    order = Window.partitionBy("key", "range").orderBy(F.desc("score"), "candidate")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def small_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the block changes."""
    for batch in batches:
        if batch.num_rows:
            ids = batch.column("block").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
            for start, end in zip(edges[:-1], edges[1:]):
                yield batch.slice(start, end - start)


def hard_negatives(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = 256,
                   positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) by inner products of floor(scale * x).

    The positives of an anchor are the first rows of its label, the negatives of a positive the first rows of another label that score
    ``share`` percent of it; higher scores come first, ties go to the lesser id. Rows whose id, label or vector is null, or with
    null or not finite components, take no part. An id stands for one vector: of several rows with one id the least by label
    and components takes part, so repeated rows are one. Vectors of different lengths have no score. An empty table gives an
    empty one. Components whose scores may not fit into a long raise a ValueError.
    """
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("vec"),
                           F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.coalesce(finite, F.lit(False)).alias("fit"))
    given = given.where("fit and id is not null and label is not null").select(
        "id", "label", F.transform("vec", lambda x: F.floor(x.cast("double") * scale)).alias("vec"), "asks")
    given = pin(given.groupBy("id").agg(F.min(F.struct("label", "vec", "asks")).alias("r")).select("id", "r.*"), "whole")
    largest, most = given.agg(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))), F.max(F.size("vec"))).first()
    bound = int(largest or 0) ** 2 * max(most or 0, 1)
    if bound >= 1 << 61:
        raise ValueError("components are too large for scores in a long")
    kind = np.int16 if (largest or 0) < 1 << 15 else np.int32 if largest < 1 << 31 else np.int64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.asarray(v, np.int64).astype(kind).tobytes() for v in batch.column("vec").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "asks", "size")), pa.array(raw, pa.binary())],
                                             ["id", "label", "asks", "size", "vec"])

    packed = small_batches(given).withColumn("size", F.size("vec")).select("id", "label", "asks", "size", "vec")
    packed = pin(packed.mapInArrow(pack, "id long, label long, asks boolean, size int, vec binary"), "packed")
    rows, anchors = packed.drop("asks"), packed.where("asks").drop("asks")
    exact = bound < 1 << 53  # then products of doubles are whole
    every = [F.array(F.lit(x).cast("bigint")).alias(c) for x, c in ((LOW, "low"), (HIGH, "high"))]
    likes = pin(best(rows, anchors.select("*", *every), positives, True, kind, exact), "positives")
    # from low to high percent, in whole numbers; a score below zero has none
    low, high = F.expr(f"(score * {share[0]} + pmod(-score * {share[0]}, 100)) div 100"), F.expr(f"(score * {share[1]} - pmod(score * {share[1]}, 100)) div 100")
    asked = likes.withColumn("low", low).withColumn("high", high)
    listed = asked.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "candidate", "score", "low", "high"))).alias("p"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda k: F.get("p", k))
    ranges = listed.select(F.col("key").alias("id"), F.transform(filled, lambda p: F.coalesce(p.low, F.lit(HIGH))).alias("low"),
                           F.transform(filled, lambda p: F.coalesce(p.high, F.lit(LOW))).alias("high"))
    found = best(rows, anchors.join(ranges, "id"), negatives, False, kind, exact)
    likes = likes.select("key", (F.col("rank") - 1).alias("range"), F.col("candidate").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(likes, ["key", "range"]).select(
        F.col("key").alias("anchor_id"), "positive_id", "rank", F.col("candidate").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT a, b AS p, score FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT s.a AS anchor_id, p AS positive_id, (row_number() OVER (PARTITION BY s.a, p ORDER BY s.score DESC, s.b))::INTEGER AS rank,
  s.b AS negative_id, positives.score AS positive_score, s.score AS negative_score
FROM positives JOIN scored s ON s.a = positives.a AND NOT s.alike AND 50 * positives.score <= 100 * s.score AND 100 * s.score <= 95 * positives.score
QUALIFY row_number() OVER (PARTITION BY s.a, p ORDER BY s.score DESC, s.b) <= 3
"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)
