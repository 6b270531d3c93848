"""Language of texts by a byte convolutional network, trained in numpy.

A window of lower-case UTF-8 bytes is embedded, filters of several widths slide over it, each filter's
largest answer is kept, and a softmax over these answers names the language. A text is the mean of
its windows, which cover it from the first byte to the last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm.common import fresh, query, small_batches, table

WINDOW = 256
PAD = 256
LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteNet:
    """Weights: byte embeddings, one bank of filters (narrow ones padded with zeros), the softmax layer."""

    labels: list[str]
    embedding: np.ndarray  # 257 x E
    bank: np.ndarray       # (widest * E) x filters
    mask: np.ndarray       # 1 where a filter of that width has a weight
    bias: np.ndarray
    out: np.ndarray        # filters x labels
    out_bias: np.ndarray

    @property
    def width(self) -> int:
        return self.bank.shape[0] // self.embedding.shape[1]

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """Embedded byte runs of the widest filter, one row for each place of each window."""
        embedded = self.embedding[windows]
        n, length, size = embedded.shape
        places = length - self.width + 1
        view = np.lib.stride_tricks.as_strided(
            embedded, (n, places, self.width * size), (embedded.strides[0], embedded.strides[1], embedded.strides[2]))
        return np.ascontiguousarray(view)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        patches = self.patches(windows)
        n, places, size = patches.shape
        pooled = (patches.reshape(-1, size) @ self.bank).reshape(n, places, -1).max(axis=1)
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias


def windows_of(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """All bytes in rows of ``size``; the last row is filled up."""
    rows = max(1, -(-len(raw) // size))
    out = np.full(rows * size, PAD, np.int16)
    out[:len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(rows, size)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], widths: tuple[int, ...] = (2, 3, 4), filters: int = 16, size: int = 6,
          epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 7) -> ByteNet:
    """Fit a network on pieces of text of about one window each; the same input gives the same weights."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    widest, total = max(widths), filters * len(widths)
    mask = np.zeros((widest * size, total), np.float32)
    for k, width in enumerate(widths):
        mask[:width * size, k * filters:(k + 1) * filters] = 1
    scale = 1 / np.sqrt(mask.sum(axis=0))
    net = ByteNet(names, rng.normal(0, 0.5, (257, size)).astype(np.float32),
                  (rng.normal(0, 1, mask.shape) * mask * scale * 1.5).astype(np.float32), mask,
                  np.zeros(total, np.float32), rng.normal(0, 0.1, (total, len(names))).astype(np.float32),
                  np.zeros(len(names), np.float32))
    net.embedding[PAD] = 0
    if not texts:
        return net
    starts = rng.random(len(texts))
    short = [t[int(a * len(t) / 2):][:int(n)] for t, a, n in zip(texts, starts, rng.integers(6, 80, len(texts)))]  # short texts must be known too
    rows = np.concatenate([windows_of(t.lower().encode("utf-8", "replace")[:WINDOW]) for t in [*texts, *short]])
    target = np.array([names.index(x) for x in [*labels, *labels]])
    count = np.bincount(target, minlength=len(names))
    weight = (len(target) / (len(names) * count))[target].astype(np.float32)
    keys = ("embedding", "bank", "bias", "out", "out_bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in keys}
    second = {k: np.zeros_like(getattr(net, k)) for k in keys}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            x, n = rows[pick], len(pick)
            patches = net.patches(x)
            answers = (patches.reshape(-1, patches.shape[2]) @ net.bank).reshape(n, patches.shape[1], -1)
            best = answers.argmax(axis=1)
            pooled = np.take_along_axis(answers, best[:, None, :], axis=1)[:, 0] + net.bias
            active = np.maximum(pooled, 0)
            error = softmax(active @ net.out + net.out_bias)
            error[np.arange(n), target[pick]] -= 1
            error *= weight[pick, None] / n
            back = (error @ net.out.T) * (pooled > 0)
            taken = patches[np.arange(n)[:, None], best]  # n x filters x (widest * size)
            down = (back[:, :, None] * net.bank.T[None]).reshape(n, total, widest, size)
            embedding = np.zeros_like(net.embedding)
            for j in range(widest):
                np.add.at(embedding, x[np.arange(n)[:, None], best + j], down[:, :, j])
            embedding[PAD] = 0
            grads = {"embedding": embedding, "bank": np.einsum("nf,nfk->kf", back, taken) * mask,
                     "bias": back.sum(axis=0), "out": active.T @ error, "out_bias": error.sum(axis=0)}
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - rate * move).astype(np.float32))
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no training may see: crc32 of the id as text divides by 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
        sample_docs: int = 400, pieces: int = 8, most_langs: int = 500) -> ByteNet:
    """Train on a bounded sample: about ``sample_docs`` labelled documents of each language, ``pieces`` places of each.

    The sample is all that reaches the driver: at most languages x sample_docs (give or take chance) x
    pieces x one window of characters; more than ``most_langs`` languages are refused. Rows without text or language, and held-out rows, are never seen.
    """
    usable = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.col(lang).alias("l"), held_out(doc_id).alias("h")) \
        .where("not h and l is not null and t is not null").where(F.col("t").rlike(r"\p{L}"))
    counts = {r["l"]: r["n"] for r in usable.groupBy("l").agg(F.count("*").alias("n")).limit(most_langs + 1).collect()}
    if len(counts) > most_langs:
        raise ValueError(f"more than {most_langs} languages are labelled")
    if not counts:
        return train([], ["und"])
    share = F.coalesce(*[F.when(F.col("l") == k, F.lit(min(1.0, sample_docs / n))) for k, n in sorted(counts.items())])
    draw = F.pmod(F.xxhash64("d", "x", F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    places = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(
        F.col("t"), (F.floor(i * F.greatest(F.length("t") - WINDOW // 2, F.lit(0)) / F.lit(pieces)) + 1).cast("int"), F.lit(WINDOW)))
    # a row that is there many times is drawn once, so the bound holds for any table
    rows = usable.withColumn("x", F.xxhash64("t")).where(draw < share).select("d", "l", "x", places.alias("p")).dropDuplicates(["d", "l", "x"]).collect()
    rows.sort(key=lambda r: (r["l"], str(r["d"]), r["p"]))
    pairs = [(piece, r["l"]) for r in rows for piece in dict.fromkeys(r["p"]) if LETTER.search(piece)]
    pairs = pairs or [("a", sorted(counts)[0])]
    return train([p for p, _ in pairs], [x for _, x in pairs])


def predict(docs: DataFrame, net: ByteNet, text: str = "text", lang_pred: str = "lang_pred", score: str = "score",
            group: int = 256) -> DataFrame:
    """All columns of ``docs`` and the predicted language with its probability.

    ``und`` with score 0 for a null text or one without a letter. The whole text counts: mean logits over
    all its windows, weighted by the bytes in each. ``group`` windows are computed at once, whatever the
    text's length. Equal texts get equal answers (up to rounding of the last digits); repeated rows stay.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(net)

    @F.pandas_udf("lang string, score double")
    def name_language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            names, scores = [], []
            for value in batch:
                found = LETTER.search(value) if value else None
                if not found:
                    names.append("und")
                    scores.append(0.0)
                    continue
                raw = value.lower().encode("utf-8", "replace")
                total = np.zeros(len(model.labels))
                for at in range(0, len(raw), group * WINDOW):
                    part = raw[at:at + group * WINDOW]
                    filled = np.full(-(-len(part) // WINDOW), WINDOW)
                    filled[-1] = len(part) - WINDOW * (len(filled) - 1)
                    total += filled @ model.logits(windows_of(part)).astype(np.float64)
                chance = softmax((total / len(raw))[None])[0]
                best = int(chance.argmax())
                names.append(model.labels[best])
                scores.append(round(float(chance[best]), 6))
            yield pd.DataFrame({"lang": names, "score": scores})

    made, = fresh(docs, "__language")
    once = name_language.asNondeterministic()  # a filter on the answer must not have it worked out a second time
    return small_batches(docs).withColumn(made, once(F.col(text))) \
        .withColumns({lang_pred: F.col(f"{made}.lang"), score: F.col(f"{made}.score")}).drop(made)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", **fitted) -> DataFrame:
    """Train on the labelled rows that are not held out, then predict every row."""
    return predict(docs, fit(docs, text, lang, doc_id, **fitted), text)


def language_stage(spark, docs: DataFrame, sf_dir: str, min_score: float = 0.0) -> DataFrame:
    """Pipeline stage: documents of no language go; a missing ``lang`` is filled by the prediction.

    The learned languages share the whole probability, so a low score marks a short text rather than a foreign one; unless
    ``min_score`` is raised, only ``und`` is rejected.
    """
    named = identify(docs)
    known = named.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return known.select(*[F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


@query("op6_language_id")
def op6_language_id(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
