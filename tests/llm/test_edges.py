"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator on documents."""

import hashlib
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidyshelf.llm import bpe, jaccard, language, licenses, lines, matroska, mixing, shards

LONG = " ".join(f"word{i % 977} and {i}" for i in range(20_000)) + "x" * 5000
NOTICE = "Licensed under the Apache License, Version 2.0."
TEXTS = [None, "", "   \n\n ", "...!!! 123", "one", "Zwei kleine Wörter", NOTICE, NOTICE, LONG, LONG + " end", "tie tie tie tie tie tie", "tie tie tie tie tie tie"]
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, body string, doc string, node string, key string, tokens string, "
          "mark string, `__doc` string, `__body` string, leaf string, size string, media string")
CLASHES = ("c",) * 11


def table(spark, texts=TEXTS):
    rows = [(i if i != 4 else None, t, [None, "en", "de"][i % 3], [None, "src1", "weird"][i % 3], None if t is None else len(t)) + CLASHES for i, t in enumerate(texts)]
    rows += [rows[6], rows[6]] if len(rows) > 6 else []  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(df, *cols):
    return {(r.doc_id, r.text): tuple(r[c] for c in cols) for r in df.collect()}


def test_language(docs, none):
    out = language.identify(docs, sample_docs=20)
    assert out.columns == [*docs.columns, "lang_pred", "score"] and out.count() == docs.count()
    got = by_text(out, "lang_pred", "score")
    for key, (lang, score) in got.items():
        if not any(c.isalpha() for c in key[1] or ""):
            assert (lang, score) == ("und", 0.0)
        else:
            assert lang in ("en", "de") and 0 < score <= 1
    assert language.identify(none).count() == 0


def test_no_labels_at_all(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id bigint, text string, lang string")
    assert sorted((r.doc_id, r.lang_pred) for r in language.identify(df).collect()) == [(1, "und"), (2, "und")]


def test_lines(docs, none):
    out = lines.drop_recurring_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"] and out.count() == docs.count()
    got = by_text(out, "n_lines", "n_dropped")
    assert got[0, None] == (0, 0) and got[1, ""] == (0, 0) and got[2, "   \n\n "] == (0, 0) and got[6, NOTICE] == (1, 0)
    assert lines.drop_recurring_lines(none).count() == 0


def test_similarity(docs, none):
    out = {(r.doc, r.body): r for r in jaccard.link_groups(docs).collect()}
    rows = {r.doc: r for r in out.values()}
    assert jaccard.link_groups(docs).count() == docs.count()
    # the notice is in rows 6 (three times) and 7; the long texts differ by one shingle
    assert rows[6].class_id == rows[7].class_id == 6 and rows[7].n_links == 3 and rows[7].n_text_links == 0
    assert rows[8].class_id == rows[9].class_id == 8 and rows[9].n_links == 1 and rows[9].n_text_links == 1
    assert rows[10].class_id == rows[11].class_id == 10
    for alone in (0, 1, 2, 3, 5):
        assert (rows[alone].class_id, rows[alone].n_links) == (alone, 0)
    assert jaccard.link_groups(none).count() == 0


def test_one_of_each_stays(docs, none):
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((i == 4, i if i != 4 else 0) for i in (0, 1, 2, 3, 4, 5, 6, 8, 10))
    assert jaccard.keep_one_of_each(none).count() == 0


def test_mixing(docs, none):
    out = mixing.mix(docs, {"lang": {"en": 3}}, domain=mixing.domain_of(), max_epochs=2)
    assert out.columns == [*docs.columns, "domain", "n_tokens", "epochs"]
    got = by_text(out, "n_tokens", "epochs")
    assert all(1 <= e <= 2 for _, e in got.values())
    total = sum(len((t or "").split()) for _, t in by_text(docs))
    assert sum(n * e for n, e in got.values()) <= total + 2 * len(NOTICE.split())
    assert mixing.mix(none, {}).count() == 0


def test_bpe(docs, none):
    out = bpe.encode(docs, P.path(bpe.VOCABULARY), P.PATTERN)
    assert out.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"] or "tokens" in docs.columns
    for r in out.select("text", "n_tokens", "decoded_sha256").collect():
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and (r.n_tokens == 0) == (not r.text)
    assert bpe.encode(none, P.path(bpe.VOCABULARY), P.PATTERN).count() == 0


@pytest.mark.parametrize("small", [{}, {"sample": 8, "ranges": 3, "full": 2}])
def test_shards(docs, none, small):
    out = shards.shard_by_bytes(docs, shards=4, **small).collect()
    assert len(out) == docs.count()
    sizes, slots = {}, {}
    for r in out:
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in [(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((r["size"], r.text_crc32) for r in out) == want
    assert shards.shard_by_bytes(none, **small).count() == 0


def test_matroska(docs, none):
    stored = matroska.read(matroska.store(docs.drop("media")))
    for r in stored.select("text", "payload").collect():
        raw = (r.text or "").encode()
        assert bytes(r.payload) == raw + b"\0" * (-len(raw) % 64 if raw else 64)
    assert matroska.packet_table(matroska.store(none), "doc_id").count() == 0


def test_licenses(docs, none):
    got = sorted((r.doc, r.license, r.kind, r.containment) for r in licenses.scan(docs).collect())
    assert got == [(6, "Apache-2.0", "notice", 1.0), (7, "Apache-2.0", "notice", 1.0)]
    assert licenses.scan(none).count() == 0


def test_clashing_column_takes_the_operators_place(docs):
    """A column of an output's own name is replaced by it, and only that one."""
    out = language.identify(docs.withColumn("lang_pred", F.lit("old")), sample_docs=20)
    assert out.columns.count("lang_pred") == 1 and out.where("lang_pred = 'old'").count() == 0


def test_every_stage_of_the_pipeline(spark, tmp_path):
    """``run`` on nulls, empty and long texts, repeated rows and clashing columns, on an empty table, and each stage's columns."""
    table(spark).write.parquet(str(tmp_path / "some" / "documents.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    given = {(r.doc_id, r.text) for r in table(spark).collect()}
    kept = {(r.doc_id, r.text) for r in out}
    assert kept and kept <= given and all(r.n_tokens > 0 for r in out)
    # those without a letter go, and the copies of others; mixing chooses from the rest, and may take one twice
    assert not {0, 1, 2, 3, 7, 9, 11} & {d for d, _ in kept}
    docs = table(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
