"""Byte-level BPE: encoding by padded matrices, decoding by the rank table.

Distinct new pieces of a slice of text are sorted into buckets of like length and become the rows of
a matrix of ids. In each round every row merges its leftmost pair of least rank; pairs are looked
up in a hash table, rows that are done leave the matrix. Pieces met before come from a bounded
table of each worker.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm.common import fresh, query, small_batches, table

NONE = np.int32(2**31 - 1)
BREAK = re.compile(r"\S(?= )")


def load_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file: token bytes by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PairTable:
    """Hash table from a pair of ids to the id of the joined token, in two numpy arrays."""

    def __init__(self, tokens: list[bytes]) -> None:
        rank = {t: i for i, t in enumerate(tokens) if t}
        keys, values = [], []
        for token, i in rank.items():
            for cut in range(1, len(token)):
                left, right = rank.get(token[:cut]), rank.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(i)
        bits = max(4, (4 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.size = np.uint64(64 - bits), 1 << bits
        self.keys = np.full(self.size, -1, np.int64)
        self.values = np.full(self.size, NONE, np.int32)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self.slots(key)
        while len(key):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]  # of several that want a place, the last gets it
            settled = self.keys[slot] == key
            self.values[slot[settled]] = value[settled]
            key, value, slot = key[~settled], value[~settled], (slot[~settled] + 1) % self.size

    def slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each joined pair, ``NONE`` where there is none. Negative ids are filling."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(len(key), NONE, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self.slots(key[open_])
        while len(open_):
            seen = self.keys[slot]
            hit = seen == key[open_]
            out[open_[hit]] = self.values[slot[hit]]
            on = ~hit & (seen != -1)
            open_, slot = open_[on], (slot[on] + 1) % self.size
        return out


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str, longest: int = 1024, known: int = 100_000, cells: int = 1 << 20) -> None:
        self.tokens, self.longest, self.known, self.cells = tokens, longest, known, cells
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(tokens)
        self.pattern = regex.compile(pattern)
        self.decimal = [str(i) for i in range(len(tokens))]
        self.number = list(range(len(tokens)))  # one object for each id, whatever table refers to it
        self.table: dict[str, tuple[int, ...]] = {}

    def merge_rows(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pieces of like length: one matrix, all rows merge one pair a round."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        rows, out = np.arange(len(pieces)), [()] * len(pieces)
        while True:
            if ranks.shape[1]:
                at = ranks.argmin(axis=1)
                least = ranks[np.arange(len(rows)), at]
            else:
                at, least = np.zeros(len(rows), int), np.full(len(rows), NONE)
            done = least == NONE
            if done.any():
                lengths = (ids[done] >= 0).sum(axis=1).tolist()
                for r, row, n in zip(rows[done].tolist(), ids[done].tolist(), lengths):
                    out[r] = tuple(map(self.number.__getitem__, row[:n]))
            if done.all():
                return out
            rows, ids, ranks, at, least = rows[~done], ids[~done], ranks[~done], at[~done], least[~done]
            each = np.arange(len(rows))
            ids[each, at] = least
            moved = np.arange(ids.shape[1] - 1)
            ids = np.where(moved[None] > at[:, None], ids[:, 1:], ids[:, :-1])
            ranks = np.where(moved[None, :-1] > at[:, None], ranks[:, 1:], ranks[:, :-1])
            for side in (at - 1, at):
                ok = (side >= 0) & (side < ranks.shape[1])
                ranks[each[ok], side[ok]] = self.pairs.find(ids[each[ok], side[ok]], ids[each[ok], side[ok] + 1])

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one very long piece by the same rule; a heap instead of a row that is searched whole each round."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        first = self.pairs.find(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(int(r), i) for i, r in enumerate(first) if r != NONE]
        current = {i: r for r, i in heap}
        heapq.heapify(heap)

        def look(i: int) -> None:
            current.pop(i, None)
            if 0 <= i and after[i] < len(ids):
                new = self.rank.get(self.tokens[ids[i]] + self.tokens[ids[after[i]]])
                if new is not None:
                    current[i] = new
                    heapq.heappush(heap, (new, i))

        while heap:
            r, i = heapq.heappop(heap)
            if current.get(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            current.pop(j, None)
            if after[i] < len(ids):
                before[after[i]] = i
            look(i)
            look(before[i])
        return tuple(x for x in ids if x >= 0)

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of new pieces into the worker's table."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "replace")
            whole = self.rank.get(raw)
            if whole is not None:
                self.table[piece] = (whole,)
            elif len(raw) > self.longest:
                self.table[piece] = self.merge_long(raw)
            else:
                buckets.setdefault(max(3, (len(raw) - 1).bit_length()), []).append((piece, raw))
        for bits, members in buckets.items():
            step = max(1, self.cells >> bits)
            for at in range(0, len(members), step):
                part = members[at:at + step]
                self.table.update(zip([p for p, _ in part], self.merge_rows([r for _, r in part])))

    def slices(self, text: str) -> Iterator[list[str]]:
        """The pieces of the whole text, slice after slice. A slice ends before a space after a non-space, where a piece must end."""
        at = 0
        while at < len(text):
            cut = BREAK.search(text, at + (1 << 16)) if len(text) - at > 1 << 17 else None
            end = cut.end() if cut else len(text)
            yield self.pattern.findall(text[at:end])
            at = end

    def encode_all(self, texts: Iterable[str], together: int = 1 << 17) -> Iterator[tuple[int, list[int]]]:
        """(index of the text, ids) for each slice in order. New pieces of about ``together`` pieces of many texts are learned at once."""
        waiting: list[tuple[int, list[str]]] = []
        held = 0

        def ready() -> Iterator[tuple[int, list[int]]]:
            new = set(chain.from_iterable(p for _, p in waiting)).difference(self.table)
            if len(self.table) + len(new) > self.known:
                self.table.clear()
                new = set(chain.from_iterable(p for _, p in waiting))
            self.learn(new)
            for index, pieces in waiting:
                yield index, list(chain.from_iterable(map(self.table.__getitem__, pieces)))

        for index, text in enumerate(texts):
            for pieces in self.slices(text):
                waiting.append((index, pieces))
                held += len(pieces)
                if held >= together:
                    yield from ready()
                    waiting, held = [], 0
        yield from ready()

    def encode(self, text: str) -> list[int]:
        return [i for _, part in self.encode_all([text]) for i in part]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[int, str], Codec] = {}


def digests(codec: Codec, texts: pd.Series, ids: bool) -> pd.DataFrame:
    """Number of tokens, digest of the ids, digest of the decoded bytes, and the ids if asked."""
    counts = [0] * len(texts)
    hashed, back = [hashlib.sha256() for _ in counts], [hashlib.sha256() for _ in counts]
    kept: list[list[np.ndarray]] = [[] for _ in counts]
    for k, part in codec.encode_all(value or "" for value in texts):
        if part:
            hashed[k].update(("," * bool(counts[k]) + ",".join(map(codec.decimal.__getitem__, part))).encode())
            back[k].update(codec.decode(part))
            counts[k] += len(part)
            if ids:
                kept[k].append(np.array(part, np.int32))
    out = {"n_tokens": counts, "ids_sha256": [h.hexdigest() for h in hashed], "decoded_sha256": [h.hexdigest() for h in back]}
    if ids:
        out["tokens"] = [np.concatenate(p) if p else np.zeros(0, np.int32) for p in kept]
    return pd.DataFrame(out)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = True, together: int = 500) -> DataFrame:
    """All columns of ``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked, the ``tokens`` themselves.

    Null counts as the empty text: no tokens. The rank file is read once and sent to the workers, at
    most a few MB. ``together`` texts are worked through at once, in slices, so memory does not grow with a text's
    length but for the row itself. Equal texts get equal ids; repeated rows stay.
    """
    vocabulary = load_ranks(path)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", tokens array<int>" * ids

    @F.pandas_udf(kinds)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        key = (hash(tuple(sent.value)), pattern)
        if key not in _codecs:
            _codecs.clear()
            _codecs[key] = Codec(sent.value, pattern)
        codec = _codecs[key]
        for batch in batches:
            for at in range(0, len(batch), together):
                yield digests(codec, batch.iloc[at:at + together], ids)

    made, = fresh(docs, "__bpe")
    names = [k.split()[0] for k in kinds.split(", ")]
    return small_batches(docs).withColumn(made, digest(F.col(text))) \
        .withColumns({n: F.col(f"{made}.{n}") for n in names}).drop(made)


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: documents with their token ids."""
    return encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@query("op4_byte_bpe")
def op4_byte_bpe(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ids=False).drop("text")
