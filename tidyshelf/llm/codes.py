"""Vector code compression: parts of vectors replaced by entries of codebooks, learned by ball k-means.

A codebook's entry and the parts assigned to it form a ball. Its radius is the distance of its farthest part; entries no farther
than twice the radius are its neighbours, and no other entry can be nearer to any of its parts. Half the distance to the nearest
neighbour bounds a core whose parts stay without being compared. A part beyond it, in a ring, is compared with those neighbours only
that lie within twice its own distance. A ball that has not moved, and whose neighbours have not, is not looked at. All of it is
exact on whole numbers, so the codes are those of comparing every part with every entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm.common import fixed, query, table
from tidyshelf.session import pin, remove, shared_path

#: Rows that are worked on at a time.
ROWS = 8192
FAR = np.iinfo(np.int64).max


def apart(entries: np.ndarray) -> np.ndarray:
    """Squared distances between the entries of each codebook."""
    return ((entries[:, :, None] - entries[:, None]) ** 2).sum(axis=3)


def assign(parts: np.ndarray, home: np.ndarray, entries: np.ndarray, reach: np.ndarray, settled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, and its squared distance, from the ball that each part is in.

    ``reach`` bounds the balls' radii; parts of settled balls stay, and their distance is given as -1.
    """
    nearest, away, many = home.copy(), np.full(len(home), -1, np.int64), len(entries)
    between = apart(entries[None])[0]
    rings = np.where(np.eye(many, dtype=bool) | (np.sqrt(between) > 2 * reach[:, None]), FAR, between)
    neighbours = np.argsort(rings, axis=1, kind="stable")
    rings = np.take_along_axis(rings, neighbours, axis=1)
    rows = np.flatnonzero(~settled[home])
    away[rows] = ((parts[rows] - entries[home[rows]]) ** 2).sum(axis=1)
    compared = (rings[home[rows]] <= 4 * away[rows][:, None]).sum(axis=1)
    rows, n = rows[compared > 0], compared[compared > 0]
    if len(rows):
        starts = np.cumsum(n) - n
        row = np.repeat(rows, n)
        entry = neighbours[home[row], np.arange(len(row)) - np.repeat(starts, n)]
        rank = ((parts[row] - entries[entry]) ** 2).sum(axis=1) * many + entry  # of equally near ones the lower index
        best = np.minimum(np.minimum.reduceat(rank, starts), away[rows] * many + home[rows])
        nearest[rows], away[rows] = best % many, best // many
    return nearest, away


def assigned(packed: DataFrame, entries: np.ndarray, reach: np.ndarray, settled: np.ndarray, kind: type, last: bool) -> DataFrame:
    """``packed`` with the codes of one more assignment.

    One row of each batch carries the batch's sums and counts, and its radii. In the last assignment there are neither these nor
    the vectors, but the error of every row.
    """
    count, many, width = entries.shape
    row = packed.schema["row"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for start in range(0, held.num_rows, ROWS):
                batch = held.slice(start, ROWS)
                parts = fixed(batch.column("vec"), kind).reshape(batch.num_rows, count, width).astype(np.int64)
                codes = fixed(batch.column("codes"), np.uint8).reshape(batch.num_rows, count).astype(np.int64)
                sums, sizes, radii = np.zeros((count, many, width), np.int64), np.zeros((count, many), np.int64), np.full((count, many), -1, np.int64)
                error = np.zeros(batch.num_rows, np.int64)
                for p in range(count):
                    codes[:, p], away = assign(parts[:, p], codes[:, p], entries[p], reach[p], settled[p])
                    error += away
                    np.add.at(sums[p], codes[:, p], parts[:, p])
                    sizes[p] = np.bincount(codes[:, p], minlength=many)
                    np.maximum.at(radii[p], codes[:, p], away)
                coded = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
                if last:
                    yield pa.RecordBatch.from_arrays([batch.column("row"), coded, pa.array(error)], ["row", "codes", "error"])
                    continue
                rest = [None] * (batch.num_rows - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("vec"), coded, pa.array([np.concatenate([sums.ravel(), sizes.ravel()]), *rest], pa.list_(pa.int64())),
                     pa.array([radii.ravel(), *rest], pa.list_(pa.int64()))], ["row", "vec", "codes", "sums", "radii"])

    out = "codes binary, error long" if last else "vec binary, codes binary, sums array<long>, radii array<long>"
    return packed.select("row", "vec", "codes").mapInArrow(step, f"row {row}, {out}")


def gathered(coded: DataFrame, column: str, by, size: int) -> np.ndarray:
    """The batches' arrays of one column, summed up (or the like) by position; ``size`` numbers reach the driver."""
    each = coded.where(F.col(column).isNotNull()).select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(by("x").alias("x"))
    out = np.zeros(size, np.int64)
    for r in each.collect():
        out[r["at"]] = r["x"]
    return out


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", keep: Sequence[str] = ("label",), parts: int = 8,
             many: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, the ``keep`` columns, code, error) for each row, and the final codebooks by part, entry and position.

    Components become floor(scale * x). Codebooks begin with the parts of the ``many`` least ids (null ids come last, ties go to the
    lesser vector; fewer rows give fewer entries). Each round assigns every part to its nearest entry, ties to the lower index, and moves
    entries to the floor of their parts' mean; an entry without parts stays. A code has two hex digits for each part.

    Rows whose vector is null or holds null or not finite components are left out. Repeated rows are rows of their own. All
    vectors must be of one length, a multiple of ``parts``, and so small that squared distances fit into a long; else a ValueError
    says so. An empty table gives an empty one and codebooks without entries. Rounds are written one after another, and a round's
    table is removed once the next one is there, so no more than two are kept.
    """
    spark = vectors.sparkSession
    if not 1 <= many <= 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(embedding).isNotNull() & finite).select(
        F.struct(vec_id, *keep).alias("row"), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)).alias("vec"))
    count, least, most, largest = rows.agg(
        F.count("*"), F.min(F.size("vec")), F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double")))))).first()
    result = f"row {rows.schema['row'].dataType.simpleString()}, codes binary, error long"
    if not count:
        entries = np.zeros((parts, 0, 0), np.int64)
        coded = spark.createDataFrame([], result)
    else:
        if least != most or most % parts:
            raise ValueError(f"vectors of {least} to {most} components can not all be cut into {parts} equal parts")
        width, largest = most // parts, largest or 0
        if (2 * int(largest) + 2) ** 2 * max(width, 1) * max(many, 4) >= 1 << 63:
            raise ValueError("components are too large for squared distances in a long")
        kind = np.int16 if largest < 1 << 15 else np.int32 if largest < 1 << 31 else np.int64
        first = rows.orderBy(F.col(f"row.{vec_id}").asc_nulls_last(), "vec").limit(many).select("vec").collect()
        entries = np.array([r.vec for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
        coded, entries = trained(rows, entries, rounds, kind)
    return coded.select("row.*", F.lower(F.hex("codes")).alias("code"), "error"), entries


def trained(rows: DataFrame, entries: np.ndarray, rounds: int, kind: type) -> tuple[DataFrame, np.ndarray]:
    """(row, codes, error) after the rounds and one more assignment, and the codebooks."""
    spark, (count, many, width) = rows.sparkSession, entries.shape
    none = b"\0" * count

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([v.tobytes() for v in flat], pa.binary()), pa.array([none] * len(flat), pa.binary())],
                                             ["row", "vec", "codes"])

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_path(spark, "codes")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    held, path = written(rows.mapInArrow(pack, f"row {rows.schema['row'].dataType.simpleString()}, vec binary, codes binary"))
    reach, settled, radii = np.full((count, many), np.inf), np.zeros((count, many), bool), np.full((count, many), -1, np.int64)
    for _ in range(rounds):
        held, then = written(assigned(held, entries, reach, settled, kind, last=False))
        remove(spark, path)
        path = then
        total = gathered(held, "sums", F.sum, count * many * (width + 1))
        sums, sizes = total[:count * many * width].reshape(entries.shape), total[count * many * width:].reshape(count, many)
        seen = gathered(held, "radii", F.max, count * many).reshape(count, many)
        radii = np.where(settled, np.maximum(radii, seen), seen)  # a settled ball's parts stay as far as they were
        moved = np.where(sizes[:, :, None] > 0, sums // np.maximum(sizes, 1)[:, :, None], entries)
        way = np.sqrt(((moved - entries) ** 2).sum(axis=2))
        entries = moved
        reach = (np.sqrt(np.maximum(radii, 0)) + way) * (1 + 1e-9) + 1e-6  # a little more, for rounding
        near = np.sqrt(apart(entries)) <= 2 * reach[:, :, None]
        settled = ~(near & (way > 0)[:, None, :]).any(axis=2) & (way == 0)
    coded = pin(assigned(held, entries, reach, np.zeros_like(settled), kind, last=True), "coded")
    remove(spark, path)
    return coded, entries


def digest(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


PARTS, MANY, ROUNDS = 8, 16, 6

OP13_SQL = f"""
WITH RECURSIVE fit AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), places AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, e, len(e) // {PARTS} AS width FROM fit
), parts AS MATERIALIZED (
  SELECT r, p, e[p * width + 1:(p + 1) * width] AS x FROM places, range({PARTS}) t(p)
), books AS (
  SELECT 0 AS round, p, r AS entry, x AS c FROM parts WHERE r < {MANY}
  UNION ALL
  SELECT round, p, entry, c FROM (
    WITH near AS (
      SELECT b.round, parts.p, parts.r, parts.x, arg_min(b.entry, list_sum(list_transform(list_zip(parts.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {MANY} + b.entry) AS entry
      FROM parts JOIN books b ON b.p = parts.p WHERE b.round < {ROUNDS} GROUP BY ALL
    ), sums AS (
      SELECT p, entry, place, floor(sum(x[place])::DOUBLE / count(*))::BIGINT AS c
      FROM near, unnest(range(1, len(x) + 1)) t(place) GROUP BY p, entry, place
    ), means AS (
      SELECT p, entry, list(c ORDER BY place) AS c FROM sums GROUP BY p, entry
    )
    SELECT b.round + 1 AS round, b.p, b.entry, coalesce(means.c, b.c) AS c
    FROM books b LEFT JOIN means ON means.p = b.p AND means.entry = b.entry WHERE b.round < {ROUNDS}
  )
), final AS MATERIALIZED (
  SELECT p, entry, c FROM books WHERE round = {ROUNDS}
), away AS (
  SELECT parts.r, parts.p, min(list_sum(list_transform(list_zip(parts.x, f.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {MANY} + f.entry) AS best
  FROM parts JOIN final f ON f.p = parts.p GROUP BY parts.r, parts.p
), coded AS (
  SELECT r, string_agg(lower(printf('%02x', best % {MANY})), '' ORDER BY p) AS code, sum(best // {MANY})::BIGINT AS error FROM away GROUP BY r
), book AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) AS digest FROM final
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256
FROM coded JOIN places USING (r), book
"""


@query("op13_vector_codes", OP13_SQL)
def op13_vector_codes(spark, folder: str) -> DataFrame:
    coded, entries = compress(table(spark, folder, "embeddings"), parts=PARTS, many=MANY, rounds=ROUNDS)
    of_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("of"))) \
        .select("vec_id", "code", "error", "label_error", F.lit(digest(entries)).alias("codebooks_sha256"))
