"""What each operator means, on hand-made cases."""

import random
import re
import struct

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidyshelf.llm import bpe, common, html, jaccard, language, licenses, lines, matroska, mixing, neighbours, shards
from tidyshelf.llm.components import components


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# line dedup

def test_fields_are_generalised_and_the_first_document_keeps_its_lines(spark):
    line = "Posted on the board by {} at 12:0{} today as is usual here"
    docs = spark.createDataFrame([(3, line.format("Ann", 1) + "\nown line of three"), (1, line.format("Bob", 2)), (2, "start\n\n" + line.format("Cy", 3)),
                                  (4, "Posted on the board by nobody at all and quite another line"), (5, line.format("Cy", 3))], "doc_id bigint, text string")
    got = dict(rows(lines.drop_recurring_lines(docs), "doc_id", "text"))
    assert got == {1: line.format("Bob", 2), 2: "start\n", 3: "own line of three", 4: "Posted on the board by nobody at all and quite another line", 5: ""}


def test_copies_of_a_document_do_not_make_its_lines_recur(spark):
    docs = spark.createDataFrame([(i, "a line of its own\nand a second line") for i in range(9)], "doc_id bigint, text string")
    assert rows(lines.drop_recurring_lines(docs), "n_dropped") == [(0,)] * 9


def test_variants_within_one_document_do_not_recur(spark):
    text = "\n".join(f"entry number {w} of this long list" for w in ("one", "two", "three", "four"))
    docs = spark.createDataFrame([(1, text), (2, "other words")], "doc_id bigint, text string")
    assert rows(lines.drop_recurring_lines(docs), "n_dropped") == [(0,), (0,)]


def test_lines_that_nothing_asks_for_stay_out_of_the_shuffles(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=9))
    text = lambda: "\n".join(" ".join(word() for _ in range(9)) for _ in range(50))
    line = "Posted on the board by {} at 12:00 today as is usual here"
    docs = spark.createDataFrame([(i, text() + "\n" + line.format(f"name{word()}")) for i in range(40)], "doc_id bigint, text string")
    passed = []
    sift = common.sift
    monkeypatch.setattr(lines, "sift", lambda df, wanted, *keys: passed.append((keys, df.count(), sift(df, wanted, *keys)[0].count())) or sift(df, wanted, *keys))
    assert sum(n for n, in rows(lines.drop_recurring_lines(docs), "n_dropped")) == 39
    passed = [x for x in passed if "leaf" in x[0]]
    assert [(keys, n) for keys, n, _ in passed] == [(("leaf",), 2040), (("doc", "leaf", "key"), 2040), (("leaf", "key"), 2040), (("leaf", "key"), 2040)]
    assert all(40 <= some < 45 for _, _, some in passed)


def test_a_sieve_of_many_keys_holds_back_almost_all_others(spark):
    wanted = spark.range(400_000)
    some, none = common.sift(spark.range(390_000, 500_000), wanted, "id")
    assert some.where("id < 400000").count() == 10_000
    assert some.count() < 12_000 and some.count() + none.count() == 110_000 and some.join(none, "id").count() == 0
    assert some.columns == none.columns == ["id"]


@pytest.mark.parametrize("n", [60, 1500])
@pytest.mark.parametrize("drop", [lambda spark, docs: lines.line_stage(spark, docs, ""), lambda spark, docs: lines.drop_recurring_lines(docs)])
def test_fields_whose_values_recur_are_fields_at_any_size(spark, n, drop):
    rng = random.Random(n)
    data = [(i, f"own words {i * 'x'}\nThis story was filed by Name{chr(65 + rng.randrange(50))} from the City{chr(65 + rng.randrange(52))} desk on monday") for i in range(n)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    left = [t for t, in rows(drop(spark, docs), "text")]
    assert len(left) == n and sum("This story" in t for t in left) <= max(2, n // 20)


def test_a_long_line_of_two_texts_stays_in_one(spark):
    passage, short = "a passage of just eight tokens stands here", "a line of seven tokens stands here"
    docs = spark.createDataFrame([(1, f"one\n{passage}\n{short}"), (2, f"two\n{passage}\n{short}"), (3, f"two\n{passage}\n{short}")], "doc_id bigint, text string")
    assert rows(lines.line_stage(spark, docs, ""), "doc_id", "text") == [(1, f"one\n{passage}\n{short}"), (2, f"two\n{short}"), (3, f"two\n{short}")]


def test_a_near_copy_is_left_whole_for_the_stage_that_follows(spark):
    rng = random.Random(1)
    made = ["".join(rng.choices("abcdefghij", k=200)) for _ in range(110)]
    line = lambda i: " ".join(made[i][5 * k:5 * k + 5] for k in range(12))
    first = [line(i) for i in range(20)]
    other = [*first[:19], "one line that is of the second document only and quite unlike it"]
    part = [*first[:3], *(line(i) for i in range(100, 104))]
    docs = spark.createDataFrame([(1, "\n".join(first)), (2, "\n".join(other)), (3, "\n".join(part)), (4, "\n".join(first[5:9]))], "doc_id bigint, text string")
    left = lines.line_stage(spark, docs, "")
    assert dict(rows(left, "doc_id", "text")) == {1: "\n".join(first), 2: "\n".join(other), 3: "\n".join(part[3:])}
    assert sorted(r.doc_id for r in jaccard.near_stage(spark, left, "").collect()) == [1, 3]


# pages

PAGE = "<article><h1>Head</h1><p>one one.</p>{}<p>two two.</p><p>three three.</p></article><footer>foot</footer>"


@pytest.mark.parametrize("inside", ['<svg viewBox="0"/>', "<svg><path d='M'/><title>t</title></svg>", '<object data="x">', "<button>", "<button>Share</button>", "<math/>",
                                    "<select><option>a<option>b</select>", "<iframe src=x>", "<object><p>fallback</p></object>", "<template><p>no</p></template>"])
def test_unseen_elements_take_nothing_else_along(inside):
    assert [text for _, text in html.parse(PAGE.format(inside)).blocks] == ["Head", "one one.", "two two.", "three three.", "foot"]


def test_formulas_and_unseen_elements_in_a_sentence():
    source = "<p>The sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is odd, <svg><text>t</text></svg>so <button>Go</button>there.</p><p>next"
    assert [text for _, text in html.parse(source).blocks] == ["The sum x+1 is odd, so there.", "next"]
    assert [text for _, text in html.parse("<p>a <button>b <svg>c</svg> d</button> e <canvas>f").blocks] == ["a e f"]


def test_held_out_pages():
    model = html.train(html.labelled_pages(600))
    wrong = 0
    test = html.labelled_pages(120, seed=5)
    for source, got in zip(test, html.main_texts([re.sub(r'\s*data-content="."', "", s) for s in test], model)):
        page = html.parse(source)
        for i in range(1, len(page.label)):
            page.label[i] = page.label[page.parent[i]] if page.label[i] < 0 else page.label[i]
        wrong += got != "\n".join(t for n, t in page.blocks if page.label[n] == 1)
    assert wrong <= 12


def test_messages_give_exact_marginals():
    """Sum-product on a tree equals the sum over all labellings."""
    page = html.parse("<div class=a><p>one</p><ul class=b><li>two<li>three</ul></div><p>four")
    rng = np.random.default_rng(1)
    words = sorted({w for seen in page.evidence for w in seen})
    model = html.TreeModel({w: i for i, w in enumerate(words)}, rng.normal(size=len(words)), rng.normal(size=(2, 2)))
    n, score, total = len(page.parent), [sum(model.weight[model.index[w]] for w in seen) for seen in page.evidence], 0.0
    marginal = np.zeros(n)
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        p = np.exp(sum(score[i] * y[i] for i in range(n)) + sum(model.pair[y[page.parent[i]], y[i]] for i in range(1, n)))
        total += p
        marginal += p * np.array(y)
    assert np.allclose(html.Forest([page], model.index).marginals(model)[0], marginal / total)


def test_markup_is_read_as_browsers_do():
    page = html.parse("<p>a<b>b\n c</b> &amp; d<br>e<p>f<script>var x='</p>';</script><!-- no <p> -->g<ul><li>h<li>i</ul>j < k</div><table><tr><td>l<td>m</table><p>cut <a hre")
    assert [t for _, t in page.blocks] == ["ab c & d e", "fg", "h", "i", "j < k", "l", "m", "cut"]
    assert html.parse("").blocks == [] and html.parse("<div title='a>b'>x</div>").blocks[0][1] == "x"


# licences

def test_containment_decides(spark):
    notice = licenses.TEMPLATES[1][2]
    words = notice.split()
    docs = [(1, "some words before " * 30 + notice.upper().replace(",", " ") + " and after" * 40), (2, " ".join(words[:-6])), (3, " ".join(words[:30])),
            (4, " ".join(w if i % 9 else "changed" for i, w in enumerate(words))), (5, "Released under the MIT Licence"), (6, "x " * 5000 + "released under the MIT-license!")]
    got = {(r.doc, r.license, r.kind): r.containment for r in licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[1, "Apache-2.0", "header"] == 1.0 and got[1, "Apache-2.0", "notice"] == 1.0 and 0.8 <= got[2, "Apache-2.0", "header"] < 1.0
    assert got[6, "MIT", "notice"] == 1.0 and not {k for k in got if k[0] in (4, 5)} and (3, "Apache-2.0", "header") not in got
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), [("x", "y", "too few words")])


# tokens

def test_any_text_is_encoded_as_the_library_does():
    tokens = bpe.load_ranks(P.path(bpe.VOCABULARY))
    codec = bpe.Codec(tokens, P.PATTERN, longest=64, known=50, cells=256)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})
    rng = random.Random(3)
    texts = ["", " ", "\n\n  x", "'s 'S it's", "a" * 3000, "é漢字🙂" * 40, "ab  cd\t\n" * 30_000, "no" * 40_000]
    texts += ["".join(rng.choice("abetion é漢!'\n 12") for _ in range(rng.choice([3, 40, 700]))) for _ in range(150)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == own.encode_ordinary(text) and codec.decode(ids) == text.encode()


# sharding

def test_a_hot_text_is_split_and_small_records_beside_a_huge_one_too(spark):
    data = [(i, "hot text") for i in range(400)] + [(1000 + i, f"text {i}") for i in range(200)] + [(5000, "x" * 100_000)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    found = [rows(shards.shard_by_bytes(df, shards=5, **small), "doc_id", "shard", "slot") for small in ({}, {"sample": 32, "ranges": 4, "full": 20})]
    assert found[0] == found[1] and len(found[0]) == len(data)


# language

def test_training_repeats_itself_and_ignores_held_out_rows(spark):
    data = [(i, ("the cat and the dog " if i % 2 else "der Hund und die Katze ") * 8, "en" if i % 2 else "de") for i in range(200)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    first, second = language.fit(df, sample_docs=30), language.fit(df.repartition(7), sample_docs=30)
    assert np.array_equal(first.bank, second.bank) and first.labels == ["de", "en"]
    odd = df.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert language.fit(odd, sample_docs=30).labels == ["de", "en"]
    out = language.predict(df, first)
    assert out.where("lang <> lang_pred").count() == 0


def test_all_windows_of_a_long_text_count():
    net = language.train(["the cat and the dog " * 10] * 20 + ["der Hund und die Katze " * 10] * 20, ["en"] * 20 + ["de"] * 20)
    assert language.windows_of(b"x" * 513).shape == (3, 256) and (language.windows_of(b"")[0] == language.PAD).all()
    assert net.logits(language.windows_of(b"the cat " * 200)).argmax(axis=1).tolist().count(net.labels.index("en")) >= 6


# neighbours

def test_equal_vectors_ties_and_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [(i, [1.0, 0.0, 0.0]) for i in range(60)] + [(100, [0.0, 2.0, 0.0]), (101, [0.0, 0.0, 0.0]), (102, None), (103, [nan, 0.0, 1.0]), (104, [inf, 0.0, 0.0]),
                                                        (105, [None, 1.0, 1.0]), (106, [0.0, 2.0, -0.0]), (106, [0.0, 2.0, -0.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    out = neighbours.nearest(df, F.col("vec_id").isin(0, 5, 100, 101, 102))
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 5, 100}
    assert [v for _, v, _ in sorted(got[0])] == list(range(1, 11)) and [v for _, v, _ in sorted(got[5])] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert sorted(got[100])[0] == (1, 106, 0.0) and [v for _, v, _ in sorted(got[100])[1:]] == list(range(9)) and sorted(got[100])[1][2] == 5 ** 0.5
    few = neighbours.nearest(df.where("vec_id >= 59"), F.col("vec_id") == 100)
    assert rows(few, "rank", "vec_id") == [(1, 106), (2, 59)]
    assert neighbours.nearest(df.where("false"), F.lit(True)).count() == 0


def test_rotations_keep_lengths_and_hashes_differ():
    x = np.random.default_rng(0).normal(size=(50, 64))
    assert np.allclose(np.linalg.norm(neighbours.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    codes = neighbours.buckets_of(x, 4, 2, 3)
    assert codes.shape == (50, 12) and all(len(set(row)) == 12 for row in codes.tolist())
    assert np.array_equal(neighbours.buckets_of(x * 7, 4, 2, 3), codes)


def test_several_hashes_to_a_table_still_find_the_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    out = neighbours.nearest(df, F.col("vec_id") % 50 == 0, hashes=2).select("query_id", "vec_id").collect()
    want = {(q, i) for q in range(0, 3000, 50) for i in np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[1:11].tolist()}
    assert len(out) == len(want) and len({tuple(r) for r in out} & want) >= 0.9 * len(want)


def test_only_choices_that_can_be_nearest_are_looked_at():
    assert neighbours.choices_of(2, 8, 4) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (2, 0), (3, 0)]
    assert neighbours.choices_of(1, 3, 8) == [(0,), (1,), (2,)] and len(neighbours.choices_of(3, 128, 128)) < 5000


# matroska

def test_all_lacings_unknown_lengths_and_broken_files():
    e, v = matroska.element, matroska.vint
    frames = [b"a" * 300, b"b" * 10, b"c" * 700, b"d" * 5]
    head = lambda kind: v(2) + struct.pack(">hB", 7, kind << 1)
    body = matroska.number(matroska.TIME, 100) + b"".join(e(matroska.SIMPLE, head(k) + matroska.laced(frames, k)) for k in (1, 3)) \
        + e(matroska.GROUP, e(matroska.BLOCK, head(0) + b"z" * 9)) + e(matroska.SIMPLE, head(2) + matroska.laced([b"e" * 4] * 3, 2))
    live = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    data = e(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + e(matroska.VOID, b"123") + live + live
    found, cues = matroska.packets(data)
    assert [data[p[7]:p[7] + p[8]] for p in found] == 2 * (frames + frames + [b"z" * 9] + [b"e" * 4] * 3) and cues == 0
    assert {p[0] for p in found} == {2} and {p[1] for p in found} == {107_000_000} and [p[2] for p in found] == [0] * 12 + [1] * 12
    assert [p[5] for p in found[:12]] == ["xiph"] * 4 + ["ebml"] * 4 + ["none"] + ["fixed"] * 3
    whole = matroska.mux(bytes(range(256)) * 40)
    full = matroska.packets(whole)[0]
    for cut in range(0, len(whole), 97):
        some = matroska.packets(whole[:cut])[0]
        assert some == full[:len(some)]
    assert matroska.packets(b"") == ([], 0) and matroska.packets(b"\x00" * 50) == ([], 0)


def test_lengths_of_every_size():
    for value in (0, 1, 126, 127, 16382, 16383, 2**21 - 2, 2**28, 2**49):
        assert matroska.read_vint(matroska.vint(value), 0) == (value, len(matroska.vint(value)))


# similarity join

@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_near_copies_in_small_blocks(spark, monkeypatch, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    want = [sum(i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    small = lambda f, **k: lambda *args: f(*args, **k)
    for cut in (False, True):
        if cut:
            monkeypatch.setattr(jaccard, "candidate_stars", small(jaccard.candidate_stars, members=7))
            monkeypatch.setattr(jaccard, "verified", small(jaccard.verified, members=5))
        assert [n for _, n in rows(jaccard.link_groups(df).select(F.lpad(F.col("doc").cast("string"), 3, "0").alias("d"), "n_links"), "d", "n_links")] == want


def test_a_pair_is_given_up_only_when_hopeless():
    need = jaccard.fewest_matches(0.8, 1e-6)
    assert len(need) == jaccard.VALUES // jaccard.STEP and need == sorted(need) and need[-1] > 0.5 * jaccard.VALUES and need[0] < 8


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, j) for j in range(501, 560)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)] + [(7, 7)]
    up = {n: n for e in edges for n in e}
    for _ in up:
        moved = False
        for a, b in edges:
            low = min(up[a], up[b])
            moved |= up[a] != low or up[b] != low
            up[a] = up[b] = low
        if not moved:
            break
    assert dict(rows(components(spark.createDataFrame(edges, "a bigint, b bigint")), "node", "root")) == up
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# mixing

def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 100), ("a", "en", "s2", 1000), ("a", "de", "s1", 1000), ("b", "en", "s1", 1000)],
                                   "domain string, lang string, source string, tokens bigint")
    got = {tuple(r)[:3]: r.budget for r in mixing.budget_leaves(leaves, {}, 2000, 1).collect()}
    # both domains 1000; in a each language 500; in a/en s1 has 100, so s2 gets the rest of its parent's
    assert got == {("a", "en", "s1"): 100, ("a", "en", "s2"): 400, ("a", "de", "s1"): 500, ("b", "en", "s1"): 1000}
    short = {tuple(r)[:3]: r.budget for r in mixing.budget_leaves(leaves.where("source = 's1'"), {"lang": {"de": 3}}, 1500, 1).collect()}
    assert short == {("a", "en", "s1"): 100, ("a", "de", "s1"): 650, ("b", "en", "s1"): 750}
    assert sum(r.budget for r in mixing.budget_leaves(leaves, {"source": {"s2": 7}, "domain": {"a": 3}}, 1777, 2).collect()) == 1777
    assert {r.budget for r in mixing.budget_leaves(leaves, {}, 10**9, 3).collect()} == {300, 3000}


def test_a_leaf_reads_a_prefix_of_its_order(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", "s1") for i in range(200)], "doc_id bigint, text string, lang string, source string")
    total = sum(1 + i % 7 for i in range(200))
    out = {r.doc_id: r for r in mixing.mix(df, {}, budget=total + 300).collect()}
    read = sum(r.n_tokens * r.epochs for r in out.values())
    assert len(out) == 200 and {r.epochs for r in out.values()} == {1, 2} and total + 300 - 7 < read <= total + 300
    again = {r.doc_id: r.epochs for r in mixing.mix(df.repartition(9), {}, budget=total + 300).collect()}
    assert again == {d: r.epochs for d, r in out.items()}
    assert mixing.mix(df, {}, budget=0).count() == 0


def test_words_of_any_length_are_one_word(spark, monkeypatch):
    word = "x" * 200_000
    texts = [a + "one two three " + word + b for a in ("", " ", " . ") for b in ("", "!")]
    assert all(len(jaccard.word_hashes(t)) == 4 for t in texts)
    out = jaccard.link_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert {(r.class_id, r.n_links) for r in out.collect()} == {(0, len(texts) - 1)}
    whole = [jaccard.word_hashes(t).tolist() for t in ("ab cde é. f", "abcdefgh", "", " a", "a b c d e f g")]
    for chunk in (1, 2, 3, 5):
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        assert [jaccard.word_hashes(t).tolist() for t in ("ab cde é. f", "abcdefgh", "", " a", "a b c d e f g")] == whole


def test_common_statements_are_found_and_told_apart(spark):
    gpl = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    cases = {
        gpl.format(":", "", ",", 3): {("GPL-3.0", "header")}, gpl.format(":", "Affero ", ",", 3): {("AGPL", "terms")},
        gpl.format(":", "Lesser ", ",", "2.1"): {("LGPL", "terms")}, gpl.format(";", "", ";", 2): {("GPL-2.0", "version")},
        "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either": {("Unlicense", "text")},
        "a = 1  # SPDX-License-Identifier: MIT\n": {("MIT", "spdx")}, "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */": {
            ("GPL-2.0-only", "spdx"), ("Linux-syscall-note", "spdx"), ("BSD-3-Clause", "spdx")}, "Give an SPDX-License-Identifier: 0BSD. Or none.": {("0BSD", "spdx")},
        "An identifier line starts with SPDX-License-Identifier and a colon.": set(), None: set(),
        'x THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. y': {("MIT", "disclaimer")}}
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = {i: set() for i in range(len(cases))}
    best = {}
    for r in licenses.scan(docs).collect():
        got[r.doc].add((r.license, r.kind))
        best.setdefault(r.doc, {})[r.license, r.kind] = r.containment
    for i, want in enumerate(cases.values()):
        assert want <= got[i] and all(best[i][w] >= 0.9 for w in want) and all(best[i][x] < 0.9 for x in got[i] - want), (i, got[i], best.get(i))
