"""Similarity join on word shingles: MinHash bands, Bayesian pruning, exact check.

Texts with the same set of shingles are one class. Classes that agree on a band of MinHash values are
compared value by value; a pair is given up as soon as the posterior probability of its
similarity reaching the threshold is below the tolerance. What is left is checked on the shingles themselves.
Pairs live only inside numpy blocks of bounded size; rows carry links counted and a spanning star, so a
group of n like texts costs n rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm.common import blocks_of, fixed, fresh, query, sift, small_batches, table, whole
from tidyshelf.llm.components import components
from tidyshelf.session import pin

LAST = 2**63 - 1
WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4          # a pair at 0.8 misses all bands with probability (1 - 0.8**4)**24 < 4e-6
VALUES = BANDS * ROWS
STEP = 16                    # MinHash values looked at before the next decision
TOLERANCE = 1e-6             # posterior below which a pair is given up
CHUNK = 1 << 16              # bytes of a text hashed at once

_rng = np.random.default_rng(20240)
_ODD = _rng.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _powers(base: int) -> np.ndarray:
    steps = np.full(CHUNK + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word in order. A word is a run of lower-case ASCII letters, digits and bytes beyond ASCII."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    out, head, length = [], np.zeros(1, np.uint64), 0  # hash and bytes so far of a word that goes on beyond a chunk
    for at in range(0, len(raw), CHUNK):
        part = raw[at:at + CHUNK]
        flag = np.concatenate([[False], _WORD[part], [False]])
        edge = np.flatnonzero(flag[1:] != flag[:-1])
        starts, ends = edge[::2], edge[1::2]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POWER[:len(part)], dtype=np.uint64, out=total[1:])
        found = (total[ends] - total[starts]) * _INVERSE[starts]
        if length:
            if flag[1]:
                found[:1] = head + found[:1] * np.array([pow(_BASE, length, 2**64)], np.uint64)
            else:
                out.append(head.copy())
                length = 0
        if flag[-2] and at + CHUNK < len(raw):
            head, found = found[-1:].copy(), found[:-1]
            length = int(ends[-1] - starts[-1]) + (length if starts[-1] == 0 else 0)
        else:
            length = 0
        out.append(found)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words; a shorter text is one shingle, one without words has none."""
    words = word_hashes(text)
    if not len(words):
        return words
    run = min(WORDS, len(words))
    total = np.full(len(words) - run + 1, run, np.uint64)
    for k in range(run):
        total += words[k:k + len(total)] * _PLACE[k]
    return np.unique(mix(total))


def signature(found: np.ndarray) -> bytes:
    """16 bits of each MinHash value, band after band."""
    least = np.full(VALUES, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 2048):
        np.minimum(least, (found[at:at + 2048, None] * _ODD + _ADD).min(axis=0), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 16, 32, ... values compared: the fewest matches at which a pair is kept.

    With a uniform prior the similarity given m matches of n is Beta(m + 1, n - m + 1); its tail above the
    threshold is a binomial sum.
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


_FEWEST = fewest_matches()


def likely(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) that are not given up while their values are compared step by step."""
    matches = np.zeros(len(a), np.int32)
    for k, need in enumerate(_FEWEST):
        part = values[:, k * STEP:(k + 1) * STEP]
        matches += (part[a] == part[b]).sum(axis=1)
        keep = matches >= need
        a, b, matches = a[keep], b[keep], matches[keep]
    return a, b


class Stars:
    """Joins numbers into sets; each set is named by one of them."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            i, j = self.find(i), self.find(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)


def block_grid(df: DataFrame, group: str, chunk: Column, chunks: str) -> DataFrame:
    """A row for each block that a member takes part in: ``chunk`` against every chunk of its group, itself included."""
    other = F.explode(F.sequence(F.lit(0), F.col(chunks) - 1))
    grid = df.withColumn("chunk", chunk.cast("int")).withColumn("other", other)
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    return grid.withColumn("block", F.xxhash64(group, low, high)).withColumn("within", F.col("chunk") == F.col("other")).drop("other")


def sketches(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc, body, node, n, sig) of every row; node is a hash of the set of shingles, null for a text without words."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, counts, sigs = [], [], []
            for value in batch.column("text"):
                found = shingles(value.as_py())
                nodes.append(int(mix(found.sum(dtype=np.uint64) + mix(np.array([len(found)], np.uint64))).view(np.int64)[0]) if len(found) else None)
                counts.append(len(found))
                sigs.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("body"), pa.array(nodes, pa.int64()), pa.array(counts, pa.int32()), pa.array(sigs, pa.binary())],
                ["doc", "body", "node", "n", "sig"])

    rows = small_batches(docs).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(whole(text)).alias("body"), whole(text).alias("text"))
    return rows.mapInArrow(sketch, "doc long, body long, node long, n int, sig binary")


def candidate_stars(classes: DataFrame, members: int = 1024) -> DataFrame:
    """Edges (a, b) that join the classes of every pair that shares a band and survives the pruning.

    Buckets of one class are left out. A bucket of more than ``members`` classes is cut into chunks, and each
    pair of chunks is a block of its own. A pair is looked at only in the first band that it shares.
    """
    bands = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.substring("sig", j * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    keyed = classes.select("node", bands.alias("band", "value")).select("node", "band", F.xxhash64("band", "value").alias("bucket"))
    crowded = keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    placed = keyed.join(crowded, "bucket").withColumn("chunks", F.ceil(F.col("size") / members).cast("int"))
    grid = block_grid(placed, "bucket", F.pmod(F.xxhash64("node"), "chunks"), "chunks").select("node", "band", "block", "chunk", "within")
    # in order of the nodes, so that the stars of all bands tend to have the same centre
    rows = grid.join(classes.select("node", "sig"), "node").repartition("block").sortWithinPartitions("block", "node")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks_of(batches):
            node, block, band, chunk = (part.column(c).to_numpy() for c in ("node", "block", "band", "chunk"))
            within = part.column("within").to_numpy()
            values = fixed(part.column("sig"), np.uint16).reshape(-1, VALUES)
            whole_bands = values.view(np.uint64)
            stars, reach = Stars(len(node)), 1
            while True:
                a = np.flatnonzero(block[reach:] == block[:-reach])
                if not len(a):
                    break
                b = a + reach
                new = (node[a] != node[b]) & (within[a] | (chunk[a] != chunk[b]))
                a, b = a[new], b[new]
                first = (whole_bands[a] == whole_bands[b]).argmax(axis=1) == band[a]
                stars.join(*likely(values, a[first], b[first]))
                reach += 1
            root = np.array([stars.find(i) for i in range(len(node))])
            far = root != np.arange(len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[root[far]])], ["a", "b"])

    return rows.mapInArrow(prune, "a long, b long")


def verified(docs: DataFrame, classes: DataFrame, clusters: DataFrame, text: str, doc_id: str,
             members: int = 256, held: int = 400_000) -> DataFrame:
    """(node, docs, texts, root): links of exact similarity at least the threshold, summed in each block of a cluster.

    A cluster of m texts is cut into about m / ``members`` chunks, and a text goes once to each of them, since every pair has to
    be looked at; a block holds two chunks, so no task grows with the cluster.
    """
    sized = clusters.select("node", F.col("root").alias("cluster")).join(classes, "node")
    totals = sized.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("n") / held)).cast("int").alias("chunks"))
    sized = sized.join(totals, "cluster")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(value.as_py()).tobytes() for value in batch.column("text")]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(sets, pa.binary()))

    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(whole(text)).alias("body"), whole(text).alias("text"))
    sized = pin(sized.select("doc", "body", "node", "sig", "size", "cluster", "chunks"), "members")
    rows = sift(rows, sized, "doc", "body")[0].join(sized, ["doc", "body"]) \
        .select("node", "sig", "size", "cluster", "chunks", "text")
    rows = rows.mapInArrow(read, "node long, sig binary, size long, cluster long, chunks int, text binary")
    grid = block_grid(rows, "cluster", F.pmod(F.xxhash64("node"), "chunks"), "chunks") \
        .select("node", "sig", "size", "block", "chunk", "within", "text").repartition("block").sortWithinPartitions("block", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks_of(batches):
            block, node = part.column("block").to_numpy(), part.column("node").to_numpy()
            first = np.concatenate([[True], (block[1:] != block[:-1]) | (node[1:] != node[:-1])])  # a repeated row counts once
            part = part.filter(pa.array(first))
            block, node, size, chunk = (part.column(c).to_numpy() for c in ("block", "node", "size", "chunk"))
            within = part.column("within").to_numpy()
            values = fixed(part.column("sig"), np.uint16).reshape(-1, VALUES)
            sets = [np.frombuffer(x, np.uint64) for x in part.column("text").to_pylist()]
            linked_docs, linked_texts, stars = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), Stars(len(node))
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            for start, end in zip(edges[:-1], edges[1:]):
                if end - start < 2:
                    continue
                lengths = np.array([len(s) for s in sets[start:end]])
                known, code = np.unique(np.concatenate(sets[start:end]), return_inverse=True)
                at = np.concatenate([[0], np.cumsum(lengths)])
                seen = np.zeros(len(known), bool)
                for i in range(end - start - 1):
                    b = np.arange(i + 1, end - start)
                    ratio = np.minimum(lengths[b], lengths[i]) >= THRESHOLD * np.maximum(lengths[b], lengths[i])
                    b = b[ratio & (within[start + b] | (chunk[start + b] != chunk[start + i]))]
                    _, b = likely(values[start:end], np.full(len(b), i), b)
                    if not len(b):
                        continue
                    mine = code[at[i]:at[i + 1]]
                    seen[mine] = True
                    common = np.array([np.count_nonzero(seen[code[at[j]:at[j + 1]]]) for j in b])
                    seen[mine] = False
                    b = b[common >= THRESHOLD * (lengths[i] + lengths[b] - common) - 1e-9] + start
                    linked_docs[start + i] += size[b].sum()
                    linked_texts[start + i] += len(b)
                    linked_docs[b] += size[start + i]
                    linked_texts[b] += 1
                    stars.join(np.full(len(b), start + i), b)
            root = np.array([stars.find(i) for i in range(len(node))])
            some = linked_texts > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (node, linked_docs, linked_texts, node[root])], ["node", "docs", "texts", "root"])

    return grid.mapInArrow(verify, "node long, docs long, texts long, root long")


def link_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, body, class_id, text_class, n_links, n_text_links, keep) for every row of ``docs``.

    ``doc`` is the id (a null id counts as the last), ``body`` a hash of the text. ``text_class`` is the least id
    with the same set of shingles, ``class_id`` the least id of all that are joined by links of Jaccard similarity
    0.8 or more on runs of five words. ``n_links`` counts the other rows linked directly, copies included;
    ``n_text_links`` the other shingle sets. ``keep`` marks one (doc, body) of each class. Texts of fewer than
    five words are one shingle; null, empty and wordless texts are alone, whatever else is like them.
    """
    sketched = pin(sketches(docs, text, doc_id), "sketches")
    classes = sketched.where("node is not null").groupBy("node").agg(
        F.min(F.struct("doc", "body", "sig")).alias("m"), F.count("*").alias("size"), F.max("n").alias("n")) \
        .select("node", "m.doc", "m.body", "m.sig", "size", "n")
    classes = pin(classes, "classes")
    clusters = components(candidate_stars(classes))
    links = pin(verified(docs, classes, clusters, text, doc_id), "links")
    groups = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    mine = classes.select("node", "doc", "body", "size").join(groups, "node", "left").join(counted, "node", "left") \
        .withColumn("root", F.coalesce("root", "node"))
    heads = mine.groupBy("root").agg(F.min(F.struct("doc", "body")).alias("head"))
    # a root that no link touched is its own head; only the joined ones need the table of heads
    named = mine.join(heads, "root").select(
        "node", F.col("head.doc").alias("class_id"), F.col("head.body").alias("head_body"), F.col("doc").alias("text_class"),
        (F.coalesce("docs", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"))
    return sketched.select("doc", "body", "node").join(named, "node", "left").select(
        "doc", "body", F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("text_class", "doc").alias("text_class"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"),
        (F.col("node").isNull() | ((F.col("doc") == F.col("class_id")) & (F.col("body") == F.col("head_body")))).alias("keep"))


def keep_one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without all but one document of each class; of a repeated row with words one stays."""
    grouped = link_groups(docs, text, doc_id).groupBy("doc", "body").agg(
        F.max("keep").alias("keep"), F.count("*").alias("same"), F.max("n_links").alias("links"))
    d, b = fresh(docs, "__doc", "__body")
    twice = F.col("keep") & (F.col("same") > 1) & (F.col("links") > 0)
    special = pin(grouped.where(~F.col("keep") | twice).select(F.col("doc").alias(d), F.col("body").alias(b), twice.alias("twice")), "dropped")
    keyed = docs.withColumns({d: F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), b: F.xxhash64(whole(text))})
    some, rest = sift(keyed, special, d, b)
    kept = rest.unionByName(some.join(special, [d, b], "left_anti"))
    if not special.where("twice").isEmpty():
        kept = kept.unionByName(some.join(special.where("twice"), [d, b], "left_semi").dropDuplicates([d, b]))
    return kept.select(*docs.columns)


def near_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class of near copies stays."""
    return keep_one_of_each(docs)


OP9_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM worded WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(shingle, '|' ORDER BY shingle)) AS texts FROM s GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b, y.texts AS b_texts, x.texts <> y.texts AS apart
  FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q USING (shingle) WHERE p.doc_id <> q.doc_id GROUP BY ALL)
  JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), classes AS (
  SELECT doc_id, min(other) AS class_id FROM reach GROUP BY ALL
), counted AS (
  SELECT a AS doc_id, count(*) AS n_links, count(DISTINCT b_texts) FILTER (WHERE apart) AS n_text_links FROM links GROUP BY ALL
)
SELECT doc_id, class_id, coalesce(min(doc_id) OVER (PARTITION BY coalesce(texts, doc_id::VARCHAR)), doc_id) AS text_class,
       coalesce(n_links, 0) AS n_links, coalesce(n_text_links, 0) AS n_text_links
FROM documents LEFT JOIN n USING (doc_id) JOIN classes USING (doc_id) LEFT JOIN counted USING (doc_id)
"""


@query("op9_ngram_jaccard_join", OP9_SQL)
def op9_ngram_jaccard_join(spark, folder: str) -> DataFrame:
    grouped = link_groups(table(spark, folder, "documents").select("doc_id", "text"))
    given = lambda c: F.when(F.col(c) != LAST, F.col(c))  # the number that stands for a null id
    return grouped.select(given("doc").alias("doc_id"), given("class_id").alias("class_id"), given("text_class").alias("text_class"), "n_links", "n_text_links")
