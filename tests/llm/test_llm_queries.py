"""The llm queries on the small tables: against SQL where there is any, else against brute force."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from compare import compare, connect

import corpus_pipeline
from tidyshelf.llm import bpe
from tidyshelf.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{FOLDER}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, FOLDER, QUERIES[name], SQL[name]) is None


def test_language_on_held_out_documents(spark):
    out = QUERIES["op6_language_id"](spark, FOLDER).toPandas()
    lang = duckdb.sql(f"SELECT doc_id, lang FROM '{FOLDER}/documents.parquet'").df().set_index("doc_id").lang
    held = out[out.held_out]
    assert (out.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in out.doc_id]).all()
    assert len(held) > 20 and (held.lang_pred.values == lang.loc[held.doc_id].values).mean() > 0.95
    assert out.score.between(0, 1).all()


def test_ids_equal_the_library(spark, docs):
    tokens = bpe.load_ranks(P.path(bpe.VOCABULARY))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})
    for r in QUERIES["op4_byte_bpe"](spark, FOLDER).collect():
        ids = own.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_shards_are_even_and_gapless(spark, docs):
    rows = QUERIES["op5_sharding"](spark, FOLDER).toPandas()
    assert sorted(rows.doc_id) == sorted(docs) and set(rows.law) == {"bytes"}
    assert all(len(docs[d].encode()) + 8 == s and zlib.crc32(docs[d].encode()) == c for d, s, c in zip(rows.doc_id, rows["size"], rows.text_crc32))
    sizes = rows.groupby("shard")["size"].sum().reindex(range(24), fill_value=0)
    assert sizes.max() - sizes.min() <= 2 * rows["size"].max()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))


def test_stored_payloads_come_back(spark, docs):
    for r in QUERIES["op8_matroska"](spark, FOLDER).collect():
        raw = docs[r.doc_id].encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()


def test_links_equal_brute_force(spark, docs):
    def shingles(text):
        words = re.findall("[a-z0-9\u0080-\U0010ffff]+", text.lower())
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {d: shingles(t) for d, t in docs.items()}
    links = {d: {e for e in sets if e != d and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]) > 0} for d in sets}
    root = {d: d for d in sets}
    for _ in sets:
        for d in sets:
            root[d] = min([root[d], *(root[e] for e in links[d])])
    rows = QUERIES["op9_ngram_jaccard_join"](spark, FOLDER).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == {d: (root[d], len(links[d])) for d in sets}
    assert sum(map(len, links.values())) > 0


def test_neighbours_are_found(spark):
    rows = QUERIES["op7_nearest_neighbours"](spark, FOLDER).toPandas()
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet' ORDER BY vec_id").df()
    vectors, ids = np.stack(table.embedding).astype(float), table.vec_id.values
    hits = total = 0
    for query, group in rows.groupby("query_id"):
        away = np.sqrt(((vectors - vectors[ids == query]) ** 2).sum(axis=1))
        near = sorted((a, i) for a, i in zip(away, ids) if i != query)[:10]
        hits += len({i for _, i in near} & set(group.vec_id))
        total += len(near)
        assert list(group.sort_values("rank").score) == [pytest.approx(away[ids == i][0], rel=1e-14) for i in group.sort_values("rank").vec_id]
    assert set(rows.query_id) == {i for i in ids if i % 100 == 0} and hits >= 0.9 * total


def test_pages_keep_the_article(spark):
    html = dict(duckdb.sql(f"SELECT page_id, html FROM '{FOLDER}/pages.parquet'").fetchall())
    for r in QUERIES["op2_html_extraction"](spark, FOLDER).collect():
        article = re.search("(?s)<article>(.*?)(?:</article>|$)", html[r.page_id])[1]
        blocks = [" ".join(re.sub("<[^>]*>", "", b.replace("<br>", " ")).split()) for b in re.split("</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            want = want.replace(name, char)
        assert r.text == want and r.n_chars == len(want)


def test_the_pipeline_stage_by_stage(spark, docs):
    """Every stage's result against a plain account of it on the stage's own input."""
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, FOLDER)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == frame.columns
        results[name] = (frame.toPandas(), out.toPandas())
        frame = spark.createDataFrame(results[name][1], out.schema)
    before, after = results["language_id"]
    assert set(before.doc_id) == set(after.doc_id)  # all are clean here
    before, after = results["line_dedup"]
    places: dict[str, set[str]] = {}
    for text in before.text:
        for line in text.split("\n"):
            places.setdefault(re.sub("[0-9]+", "<*>", " ".join(line.split())), set()).add(text)
    left = [re.sub("[0-9]+", "<*>", " ".join(line.split())) for t in after.text for line in t.split("\n") if line.strip()]
    lost = {shape for shape, texts in places.items() if shape and len(texts) < 3} - set(left)
    assert len(lost) <= 0.01 * len(places)  # only variants of a template that recurs
    for shape, texts in places.items():  # a line of several texts is left in one document
        if shape and len(texts) >= 3:
            assert sum(any(re.sub("[0-9]+", "<*>", " ".join(x.split())) == shape for x in t.split("\n")) for t in after.text) <= 1
    assert (after.n_chars == after.text.str.len()).all()
    before, after = results["near_duplicates"]
    assert set(after.doc_id) <= set(before.doc_id) and not after.text[after.text != ""].duplicated().any()
    before, after = results["source_mixing"]
    assert after.doc_id.value_counts().max() <= 2 and set(after.doc_id) <= set(before.doc_id)
    before, after = results["byte_bpe"]
    codec = bpe.Codec(bpe.load_ranks(P.path(bpe.VOCABULARY)), P.PATTERN)
    assert len(before) == len(after)
    for r in after.itertuples():
        assert list(r.tokens) == codec.encode(r.text) and codec.decode(list(r.tokens)).decode() == r.text


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 0 and {"doc_id", "tokens", "n_tokens"} <= set(out.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "source_mixing", "byte_bpe"]
