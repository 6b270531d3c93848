"""Queries on keys, duplicates, relational modelling and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyshelf.functions import cleaning as c
from tidyshelf.functions.text import canonical_name, slugify
from tidyshelf.operators import keys as k
from tidyshelf.operators import model as m
from tidyshelf.operators import quality as q
from tidyshelf.operators import similar
from tidyshelf.plans.registry import query, table
from tidyshelf.plans.tables import ANSWERS_SQL, TABLES, label_answers, labelled

ID_COLUMNS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
              "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id",
              "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id",
              "labels": "doc_id", "conversations": "conv_id"}
GRID_WIDTH, GRID_ROWS, GRID_BITS = 8, 8, 56


@query("d1_add_ids", "SELECT row_number() OVER (ORDER BY doc_id) + 113 AS id, doc_id, quality, toxic FROM labels")
def d1(spark, sf):
    """Ids along a key with gaps, going on after 113."""
    return k.add_ids(table(spark, sf, "labels"), "doc_id", initial=113)


@query("d1_add_ids_sorted", """
    SELECT row_number() OVER (ORDER BY p_name, p_brand, p_partkey) - 1 AS id, p_partkey, p_name, p_brand FROM part""")
def d1_sorted(spark, sf):
    return k.add_ids(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), "p_name", "p_brand", "p_partkey")


@query("d1_add_ids_null_order", """
    SELECT row_number() OVER (ORDER BY l.doc_id NULLS FIRST) - 1 AS id, l.doc_id AS label_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def d1_nulls(spark, sf):
    """Documents in the order of their label; those without one come first and all get an id."""
    docs, labels = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select(F.col("doc_id").alias("label_id"))
    return k.add_ids(docs.join(labels, F.col("doc_id") == F.col("label_id"), "left").select("label_id"), "label_id")


@query("d2_max_ids", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", CAST(max({ID_COLUMNS[t]}) AS BIGINT) AS max_id FROM {t}" for t in TABLES))
def d2(spark, sf):
    return k.max_ids({t: table(spark, sf, t) for t in TABLES}, ID_COLUMNS)


def _field(name: str, text: str | None = None) -> str:
    text = text or name
    return f"coalesce(CAST(length({text}) AS VARCHAR) || ':' || {text}, 'null')"


RECORD_SQL = " || '|' || ".join(_field(n) for n in ("text", "lang", "source"))


@query("d3_add_hash", f"SELECT doc_id, sha256({RECORD_SQL}) AS hash FROM documents")
def d3(spark, sf):
    docs = table(spark, sf, "documents")
    return k.add_hash(docs, exclude=["doc_id", "n_chars"], bits=256).select("doc_id", "hash")


def hashed(spark, sf):
    """Documents with the digest of their text."""
    return k.add_hash(table(spark, sf, "documents"), include=["text"], bits=256)


HASHED_SQL = f"SELECT *, sha256({_field('text')}) AS hash FROM documents"


@query("d4_duplicate_hashes", f"SELECT hash, count(*) AS copies FROM ({HASHED_SQL}) GROUP BY hash HAVING count(*) > 1")
def d4(spark, sf):
    return k.duplicate_hashes(hashed(spark, sf))


@query("d5_dedup_merge", f"""
    WITH h AS ({HASHED_SQL}),
    s AS (SELECT hash, source, min(doc_id) AS seen FROM h GROUP BY hash, source),
    l AS (SELECT hash, lang, min(doc_id) AS seen FROM h GROUP BY hash, lang),
    sl AS (SELECT hash, string_agg(source, ',' ORDER BY seen) AS sources FROM s GROUP BY hash),
    ll AS (SELECT hash, string_agg(lang, ',' ORDER BY seen) AS langs FROM l GROUP BY hash),
    f AS (SELECT hash, min(doc_id) AS doc_id FROM h GROUP BY hash)
    SELECT f.doc_id, hash, n_chars, sources, langs FROM f JOIN sl USING (hash) JOIN ll USING (hash)
    JOIN documents d ON d.doc_id = f.doc_id""")
def d5(spark, sf):
    merged = k.dedup_merge(hashed(spark, sf), "hash", ["source", "lang"], "doc_id")
    return merged.select("doc_id", "hash", "n_chars", F.array_join("source", ",").alias("sources"), F.array_join("lang", ",").alias("langs"))


@query("d5_dedup_merge_null_key", f"""
    WITH h AS (SELECT d.doc_id, source, n_chars, CASE WHEN toxic IS NOT NULL THEN hash END AS hash FROM ({HASHED_SQL}) d LEFT JOIN labels USING (doc_id)),
    s AS (SELECT hash, source, min(doc_id) AS seen FROM h GROUP BY hash, source),
    l AS (SELECT hash, string_agg(source, ',' ORDER BY seen) AS sources FROM s GROUP BY hash)
    SELECT doc_id, h.hash, n_chars, sources FROM h JOIN l ON h.hash IS NOT DISTINCT FROM l.hash
    QUALIFY row_number() OVER (PARTITION BY h.hash ORDER BY doc_id) = 1""")
def d5_nulls(spark, sf):
    """Only labelled documents have a key; the others are one group."""
    docs = hashed(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    docs = docs.select("doc_id", F.when(F.col("toxic").isNotNull(), F.col("hash")).alias("hash"), "n_chars", "source")
    return k.dedup_merge(docs, "hash", ["source"], "doc_id").withColumnRenamed("source", "sources").withColumn("sources", F.array_join("sources", ","))


@query("d5_merged_values", f"SELECT hash, source, min(doc_id) AS first_seen FROM ({HASHED_SQL}) GROUP BY hash, source")
def d5_long(spark, sf):
    return k.merged_values(hashed(spark, sf), "hash", "source", "doc_id")


@query("d6_dedup_first", """
    SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def d6(spark, sf):
    return k.dedup_first(table(spark, sf, "events"), ["user_id", "event_type"], "event_id")


@query("d7_drop_known_content", """
    SELECT doc_id, lang FROM documents WHERE sha256(text) NOT IN
        (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""")
def d7(spark, sf):
    """Every document whose text is that of a toxic one goes."""
    bad = labelled(spark, sf).where("toxic = 1").select(k.content_hash(F.col("text"), 256).alias("digest"))
    return k.drop_known_content(table(spark, sf, "documents"), "text", bad, bits=256).select("doc_id", "lang")


@query("d7_large_denylist", """
    SELECT doc_id, lang FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src1')""")
def d7_large(spark, sf):
    """All texts of one source are on the list, which is sifted by a filter of bits however long it is."""
    docs = table(spark, sf, "documents")
    listed = docs.where("source = 'src1'").select(k.content_hash(F.col("text"), 256).alias("digest"))
    return k.drop_known_content(docs, "text", listed, bits=256, few=0).select("doc_id", "lang")


ROOTS = {"http": "raw/plain/", "https": "raw/secure/"}


@query("d8_fingerprint_path", """
    SELECT page_id, CASE string_split(url, ':')[1] WHEN 'http' THEN 'raw/plain/' WHEN 'https' THEN 'raw/secure/' END
           || md5(html) || '.' || string_split(url, '.')[-1] AS path FROM pages""")
def d8(spark, sf):
    pages = table(spark, sf, "pages")
    path = k.fingerprint_path(F.substring_index("url", ":", 1), F.md5("html"), F.col("url"), ROOTS)
    return pages.select("page_id", path.alias("path"))


@query("d8_path_collisions", """
    SELECT 'docs/' || lang || '/' || md5(text) || '.' || source AS path, count(*) AS copies FROM documents
    GROUP BY 1 HAVING count(*) > 1""")
def d8_collisions(spark, sf):
    docs = table(spark, sf, "documents")
    roots = {lang: f"docs/{lang}/" for lang in ("en", "de", "es", "fr")}
    path = k.fingerprint_path(F.col("lang"), F.md5("text"), F.col("source"), roots)
    return k.path_collisions(docs.select(path.alias("path")))


def embedding_hashes(spark, sf):
    """Each embedding read as a grid of values."""
    return table(spark, sf, "embeddings").select("vec_id", similar.dhash(F.col("embedding"), GRID_WIDTH).alias("hash"))


_PAIRS = [(r * GRID_WIDTH + i, r * GRID_WIDTH + i + 1) for r in range(GRID_ROWS) for i in range(GRID_WIDTH - 1)]
DHASH_SQL = "SELECT vec_id, " + " + ".join(
    f"CASE WHEN embedding[{b + 1}] > embedding[{a + 1}] THEN {1 << (GRID_BITS - 1 - n)} ELSE 0 END"
    for n, (a, b) in enumerate(_PAIRS)) + " AS hash FROM embeddings"


@query("d9_dhash", f"SELECT vec_id, CAST(hash AS BIGINT) AS hash, lower(lpad(to_hex(CAST(hash AS BIGINT)), 14, '0')) AS hex FROM ({DHASH_SQL})")
def d9(spark, sf):
    return embedding_hashes(spark, sf).withColumn("hex", similar.hex_hash(F.col("hash"), GRID_BITS))


def wide_hashes(spark, sf):
    """All 64 pairs of a grid nine wide: the embedding and its first row once more."""
    grid = F.concat("embedding", F.slice("embedding", 1, GRID_ROWS))
    return table(spark, sf, "embeddings").select("vec_id", similar.dhash(grid, GRID_WIDTH + 1).alias("hash"))


_WIDE = [(r * 9 + i, r * 9 + i + 1) for r in range(8) for i in range(8)]
WIDE_SQL = "SELECT vec_id, CAST(" + " + ".join(
    f"CASE WHEN g[{b + 1}] > g[{a + 1}] THEN {'-' if n == 0 else ''}{1 << (63 - n)}::HUGEINT ELSE 0 END"
    for n, (a, b) in enumerate(_WIDE)) + " AS BIGINT) AS hash FROM (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS g FROM embeddings)"


@query("d9_dhash_wide", WIDE_SQL)
def d9_wide(spark, sf):
    return wide_hashes(spark, sf)


def block_hashes(spark, sf):
    """A short hash of the means of the grid's blocks of two by two."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    blocks = [(at(16 * r + 2 * i) + at(16 * r + 2 * i + 1) + at(16 * r + 2 * i + 8) + at(16 * r + 2 * i + 9)) / 4 for r in range(4) for i in range(4)]
    return table(spark, sf, "embeddings").select("vec_id", similar.dhash(F.array(*blocks), 4).alias("hash"))


_MEANS = [" + ".join(f"embedding[{16 * r + 2 * i + k + 1}]::DOUBLE" for k in (0, 1, 8, 9)) for r in range(4) for i in range(4)]
BLOCK_SQL = "SELECT vec_id, " + " + ".join(
    f"CASE WHEN ({_MEANS[r * 4 + i + 1]}) / 4 > ({_MEANS[r * 4 + i]}) / 4 THEN {1 << (11 - 3 * r - i)} ELSE 0 END"
    for r in range(4) for i in range(3)) + " AS hash FROM embeddings"


@query("d9_near_duplicates", f"""
    WITH g AS (SELECT CAST(hash AS BIGINT) AS hash, count(*) AS copies, min(vec_id) AS first FROM ({BLOCK_SQL}) GROUP BY hash)
    SELECT a.hash AS hash_a, b.hash AS hash_b, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance,
           a.copies AS copies_a, a.first AS first_a, b.copies AS copies_b, b.first AS first_b
    FROM g a JOIN g b ON a.hash < b.hash AND bit_count(xor(a.hash, b.hash)) <= 2""")
def d9_near(spark, sf):
    return similar.near_duplicates(block_hashes(spark, sf), "hash", "vec_id", 12, 2)


LIKE_SQL = f"""
    WITH RECURSIVE h AS MATERIALIZED ({WIDE_SQL}), g AS (SELECT hash, min(vec_id) AS first FROM h GROUP BY hash),
    links AS MATERIALIZED (SELECT a.hash AS a, b.hash AS b FROM g a JOIN g b ON a.hash <> b.hash AND bit_count(xor(a.hash, b.hash)) <= 16),
    reached AS (SELECT hash AS a, hash AS b FROM g UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
    stands AS (SELECT a, arg_min(b, first) AS stands FROM reached JOIN g ON g.hash = b GROUP BY a)"""


@query("d8_look_alikes", LIKE_SQL + """
    SELECT vec_id, 'raw/' || lower(lpad(to_hex(stands), 16, '0')) || '.png' AS path FROM h JOIN stands ON a = hash""")
def d8_look_alikes(spark, sf):
    """One path for each group of look-alikes: the fingerprint of the group's first row."""
    alike = similar.look_alikes(wide_hashes(spark, sf), "hash", "vec_id", 16)
    path = k.fingerprint_path(F.lit("raw"), similar.hex_hash(F.col("group"), 64), F.lit("x.png"), {"raw": "raw/"})
    return alike.select("vec_id", path.alias("path"))


@query("d9_close_pairs", f"""
    WITH h AS (SELECT DISTINCT hash FROM ({WIDE_SQL}))
    SELECT a.hash AS hash_a, b.hash AS hash_b, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance
    FROM h a JOIN h b ON a.hash < b.hash AND bit_count(xor(a.hash, b.hash)) <= 16""")
def d9_close(spark, sf):
    """Pairs of 64-bit hashes by pigeonhole, at a distance that literal neighbourhoods can not reach."""
    return similar.close_pairs(wide_hashes(spark, sf), "hash", 16)


@query("e1_resolve_fk", """
    WITH d AS (SELECT p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS id FROM part WHERE p_type = 'PROMO'),
    i AS (SELECT p_brand, max(id) AS brand_id FROM d GROUP BY p_brand)
    SELECT p_partkey, p_brand, brand_id, brand_id IS NULL AS unresolved FROM part LEFT JOIN i USING (p_brand)""")
def e1(spark, sf):
    """Brands numbered by the promoted parts, looked up for all parts."""
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    dim = parts.where("p_type = 'PROMO'")
    return m.resolve_fk(parts.drop("p_type"), dim, "p_brand", "p_brand", "p_partkey", "brand_id")


@query("e1_resolve_fk_null_order", """
    WITH d AS (SELECT p_brand, row_number() OVER (ORDER BY CASE WHEN p_partkey % 7 > 0 THEN p_partkey END NULLS FIRST) - 1 AS id FROM part WHERE p_type = 'PROMO'),
    i AS (SELECT p_brand, max(id) AS brand_id FROM d GROUP BY p_brand)
    SELECT p_partkey, p_brand, brand_id, brand_id IS NULL AS unresolved FROM part LEFT JOIN i USING (p_brand)""")
def e1_nulls(spark, sf):
    """Every seventh part has no place in the order; its brand is known all the same."""
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    dim = parts.where("p_type = 'PROMO'").select("p_brand", F.when(F.col("p_partkey") % 7 > 0, F.col("p_partkey")).alias("place"))
    return m.resolve_fk(parts.drop("p_type"), dim, "p_brand", "p_brand", "place", "brand_id")


@query("e2_extract_dimension_null_order", """
    WITH n AS (SELECT p_name AS name, min(p_partkey) AS seen, arg_min(p_type, p_partkey) AS source FROM part
               WHERE p_name <> (SELECT max(p_name) FROM part) GROUP BY p_name
               UNION ALL SELECT max(p_name), NULL, NULL FROM part)
    SELECT row_number() OVER (ORDER BY seen NULLS FIRST) - 1 AS id, name, source FROM n""")
def e2_nulls(spark, sf):
    """The parts of the last name have no place in the order."""
    parts = table(spark, sf, "part")
    last = parts.agg(F.max("p_name")).scalar()
    place = F.when(F.col("p_name") != last, F.col("p_partkey"))
    return m.extract_dimension(parts.withColumn("place", place), "p_name", "p_type", "place")


DIM_SQL = """
    WITH old AS (SELECT row_number() OVER (ORDER BY min(p_partkey)) - 1 AS id, p_name AS name, arg_min(p_type, p_partkey) AS source
                 FROM part WHERE p_type = 'ECONOMY' GROUP BY p_name),
    new AS (SELECT row_number() OVER (ORDER BY min(p_partkey)) + 1000 AS id, p_name AS name, arg_min(p_type, p_partkey) AS source
            FROM part WHERE p_name NOT IN (SELECT name FROM old) GROUP BY p_name),
    dim AS (SELECT * FROM old UNION ALL SELECT * FROM new) """


def name_dimension(spark, sf):
    parts = table(spark, sf, "part")
    old = m.extract_dimension(parts.where("p_type = 'ECONOMY'"), "p_name", "p_type", "p_partkey")
    return m.extract_dimension(parts, "p_name", "p_type", "p_partkey", initial=1000, existing=old)


@query("e2_extract_dimension", DIM_SQL + "SELECT id, name, source FROM dim")
def e2(spark, sf):
    return name_dimension(spark, sf)


@query("e2_link_dimension", DIM_SQL + "SELECT p_partkey, p_name, id AS name_id FROM part LEFT JOIN dim ON name = p_name")
def e2_link(spark, sf):
    return m.link_dimension(table(spark, sf, "part").select("p_partkey", "p_name"), name_dimension(spark, sf), "p_name", "name_id")


@query("e3_bridge_table", f"""
    WITH h AS ({HASHED_SQL}), f AS (SELECT hash, min(doc_id) AS content_id FROM h GROUP BY hash)
    SELECT DISTINCT source AS source_id, 'documents' AS content_type, content_id FROM h JOIN f USING (hash)
    UNION ALL SELECT p_brand, 'part', p_partkey FROM part""")
def e3(spark, sf):
    """Merged documents bring a row for each key of theirs, parts a single one."""
    docs = hashed(spark, sf).select("doc_id", "hash", "source")
    values = k.merged_values(docs, "hash", "source", "doc_id")
    first = values.groupBy("hash").agg(F.min("first_seen").alias("doc_id"))
    bridge = m.bridge_table(values.join(first, "hash"), "source", "documents", "doc_id")
    return m.bridge_table(table(spark, sf, "part"), "p_brand", "part", "p_partkey", bridge=bridge)


@query("e4_lookup_attribute", """
    SELECT conv_id, turn, quality, labels.doc_id IS NULL AS unresolved FROM conversations LEFT JOIN labels ON conv_id = doc_id""")
def e4(spark, sf):
    facts = table(spark, sf, "conversations").select("conv_id", "turn")
    return m.lookup_attribute(facts, table(spark, sf, "labels"), "conv_id", "doc_id", "quality", "quality")


@query("e5_domain_check", """
    SELECT doc_id, source, doc_id IN (SELECT doc_id FROM labels) AS in_domain FROM documents""")
def e5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return m.domain_check(docs, table(spark, sf, "labels"), "doc_id", "doc_id")


SQUEEZE = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


E6_SQL = """
    WITH r AS (SELECT c_custkey, {0} AS name, 'large/' || c_mktsegment || '.png' AS image FROM customer),
    f AS (SELECT 'raw/' || o_orderpriority || '/' || CASE o_orderstatus WHEN 'F' THEN 'cust-' || o_custkey WHEN 'P' THEN 'lost-' || o_orderkey
                 ELSE 'customer' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END || '.' || o_orderkey || '.png' AS path FROM orders),
    s AS (SELECT path, string_split(string_split(path, '/')[-1], '.')[1] AS stem FROM f),
    n AS (SELECT path, coalesce({0}, stem) AS name FROM s LEFT JOIN customer ON stem = 'cust-' || c_custkey),
    long AS (SELECT c_custkey, image, false AS added FROM r
             UNION ALL SELECT c_custkey, path, true FROM n LEFT JOIN r USING (name)) """


@query("e6_mapped_join", E6_SQL.format(SQUEEZE.format("c_name")) + "SELECT c_custkey, image, added FROM long")
def e6(spark, sf):
    """Order files under three kinds of names; one kind needs the mapping, which lists some keys twice, one belongs to no record."""
    customers = table(spark, sf, "customer")
    records = customers.select("c_custkey", canonical_name(customers, "c_name").alias("name"),
                               F.concat(F.lit("large/"), "c_mktsegment", F.lit(".png")).alias("image"))
    mapping = records.select(F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("key"), F.col("name").alias("value"))
    number, key = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    stem = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("cust-"), number))
            .when(F.col("o_orderstatus") == "P", F.concat(F.lit("lost-"), key))
            .otherwise(F.concat(F.lit("customer"), F.lpad(number, 9, "0"))))
    files = table(spark, sf, "orders").select(
        F.concat(F.lit("raw/"), "o_orderpriority", F.lit("/"), stem, F.lit("."), key, F.lit(".png")).alias("path"))
    return m.mapped_join(records, mapping.unionByName(mapping.where("endswith(key, '7')").withColumn("value", F.lit(""))), files, "name", "c_custkey", "image")


@query("e6_fold_images", E6_SQL.format(SQUEEZE.format("c_name")) + """
    SELECT c_custkey, string_agg(image, ',' ORDER BY added, image) AS images FROM long WHERE c_custkey IS NOT NULL GROUP BY c_custkey""")
def e6_fold(spark, sf):
    return m.fold_images(e6(spark, sf), "c_custkey").withColumn("images", F.array_join("images", ","))


@query("e7_chain_tables", """
    SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, 'customer' AS "table" FROM customer
    UNION ALL SELECT s_name, s_nationkey, NULL, 'supplier' FROM supplier
    UNION ALL SELECT n_name, n_nationkey, NULL, 'nation' FROM nation""")
def e7(spark, sf):
    named = lambda t, p, **more: table(spark, sf, t).select(
        F.col(f"{p}_name").alias("name"), F.col(f"{p}_nationkey").alias("nation"), *[F.col(v).alias(n) for n, v in more.items()])
    return m.chain_tables(customer=named("customer", "c", segment="c_mktsegment"), supplier=named("supplier", "s"), nation=named("nation", "n"))


@query("f1_apply_overrides", """
    SELECT doc_id, CASE WHEN labels.doc_id IS NULL THEN CAST(n_chars > 2000 AS INTEGER)
                        WHEN toxic = 1 THEN NULL ELSE quality END AS quality
    FROM documents LEFT JOIN labels USING (doc_id)""")
def f1(spark, sf):
    """A guess from the length, replaced by the label; toxic documents have a null as their answer."""
    guess = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("quality"))
    answers = table(spark, sf, "labels").select(
        F.lit("documents").alias("source"), F.lit("quality").alias("field"), F.col("doc_id").cast("string").alias("pk"),
        F.when(F.col("toxic") != 1, F.col("quality").cast("string")).alias("value"))
    return q.apply_overrides(guess, answers, "documents", "quality", "doc_id")


@query("f1_apply_overrides_repeated", """
    SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL AND toxic = 0 THEN quality ELSE CAST(n_chars > 2000 AS INTEGER) END AS quality,
           l.doc_id IS NOT NULL AND toxic = 1 AS bad FROM documents LEFT JOIN labels l USING (doc_id)""")
def f1_repeated(spark, sf):
    """Each label answered twice, the second time right; what toxic documents got in the end is no number."""
    guess = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("quality"))
    final = F.when(F.col("toxic") == 1, "abc").otherwise(F.col("quality").cast("string"))
    answers = table(spark, sf, "labels").select(
        F.lit("documents").alias("source"), F.lit("quality").alias("field"), F.col("doc_id").cast("string").alias("pk"),
        F.inline(F.array(F.struct(F.lit("9").alias("value"), F.lit(1).alias("version")), F.struct(final.alias("value"), F.lit(2).alias("version")))))
    return q.apply_overrides(guess, answers, "documents", "quality", "doc_id", bad="bad")


def raw_answers(spark, sf):
    """Event values as typed text: null tokens, texts that are no numbers, padded and plain numbers."""
    number, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    raw = F.when(kind == "error", ".").when(kind == "view", F.concat(F.lit("k"), number)) \
        .when(kind == "click", F.concat(F.lit(" -"), number, F.lit("\t"))).otherwise(number)
    return table(spark, sf, "events").select("event_id", raw.alias("raw"))


RAW_SQL = """
    SELECT event_id, CASE event_type WHEN 'error' THEN '.' WHEN 'view' THEN 'k' || json_extract_string(props, '$.k')
        WHEN 'click' THEN ' -' || json_extract_string(props, '$.k') || chr(9) ELSE json_extract_string(props, '$.k') END AS raw FROM events"""
IS_INT_SQL = r"regexp_matches(raw, '^\s*[+-]?[0-9]+\s*$')"


@query("f2_clean_int", f"""
    SELECT event_id, raw, CASE WHEN {IS_INT_SQL} THEN CAST(trim(raw, ' ' || chr(9)) AS BIGINT) END AS number FROM ({RAW_SQL})""")
def f2(spark, sf):
    return raw_answers(spark, sf).withColumn("number", c.clean_int(F.col("raw")))


@query("f3_validate_int", f"""
    SELECT event_id, CASE WHEN raw IS NULL OR raw = '.' THEN true ELSE {IS_INT_SQL} END AS valid,
           CASE WHEN raw IS NULL THEN false ELSE {IS_INT_SQL} END AS strict FROM ({RAW_SQL})""")
def f3(spark, sf):
    raw = F.col("raw")
    return raw_answers(spark, sf).select("event_id", c.validate_int(raw).alias("valid"),
                                         c.validate_int(raw, allow_null=False, null_token=None).alias("strict"))


@query("f4_clean_text", r"""
    SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL ELSE sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) END AS clean FROM conversations""")
def f4(spark, sf):
    raw = F.when(F.col("role") == "system", ".").otherwise(F.concat(F.lit(" \t"), "text", F.lit("\n ")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(c.clean_text(raw), 256).alias("clean"))


@query("f5_validate_text", """
    SELECT doc_id, true AS valid, quality IS NOT NULL AS strict FROM documents LEFT JOIN labels USING (doc_id)""")
def f5(spark, sf):
    text = F.col("quality").cast("string")
    return labelled(spark, sf).select("doc_id", c.validate_text(text).alias("valid"), c.validate_text(text, allow_null=False).alias("strict"))


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"]
TYPES_SQL = "['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL']"


@query("f6_decode_choice", f"""
    SELECT p_partkey, CASE WHEN p_type = 'STANDARD' THEN NULL WHEN p_size < 5 THEN {TYPES_SQL}[p_size + 1] ELSE CAST(p_size AS VARCHAR) END AS choice FROM part""")
def f6(spark, sf):
    raw = F.when(F.col("p_type") == "STANDARD", ".").otherwise(F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", c.decode_choice(raw, TYPES).alias("choice"))


@query("f7_validate_choice", f"SELECT p_partkey, p_type, list_contains({TYPES_SQL}, p_type) AS valid FROM part")
def f7(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_type", c.validate_choice(F.col("p_type"), TYPES).alias("valid"))


WORDS = ["blue", "cold", "red", "old", "small", "ring", "rod", "bolt", "gear"]


@query("f8_validate_choice_list", """
    SELECT p_partkey, list_has_all(['blue', 'cold', 'red', 'old', 'small', 'ring', 'rod', 'bolt', 'gear'], string_split(p_name, ' ')) AS valid FROM part""")
def f8(spark, sf):
    return table(spark, sf, "part").select("p_partkey", c.validate_choice_list(F.split("p_name", " "), WORDS).alias("valid"))


@query("f9_append_choices", """
    WITH b AS (SELECT conv_id, role FROM conversations WHERE turn = 0),
    a AS (SELECT conv_id, turn, nullif(role, 'system') AS role FROM conversations WHERE turn > 0),
    d AS (SELECT conv_id, role, min(turn) AS seen FROM a WHERE role IS NOT NULL GROUP BY conv_id, role),
    n AS (SELECT DISTINCT conv_id FROM a WHERE role IS NULL),
    l AS (SELECT b.conv_id, string_agg(d.role, ',' ORDER BY seen) AS more FROM b JOIN d ON b.conv_id = d.conv_id AND b.role <> d.role GROUP BY b.conv_id)
    SELECT conv_id, CASE WHEN conv_id IN (SELECT conv_id FROM n) THEN NULL ELSE concat_ws(',', role, more) END AS roles FROM b LEFT JOIN l USING (conv_id)""")
def f9(spark, sf):
    """The first turn's role is there already, later turns answer in order, a system turn is a null."""
    talks = table(spark, sf, "conversations")
    base = talks.where("turn = 0").select("conv_id", F.array("role").alias("roles"))
    answers = talks.where("turn > 0").select("conv_id", "turn", F.nullif("role", F.lit("system")).alias("role"))
    return q.append_choices(base, answers, "conv_id", "roles", "turn", "role").withColumn("roles", F.array_join("roles", ","))


def document_rules():
    return [q.Rule("quality", "has a label", c.validate_int(F.col("quality").cast("string"), allow_null=False)),
            q.Rule("lang", "known language", c.validate_choice(F.col("lang"), ["en", "fr", "es"])),
            q.Rule("n_chars", "long enough", F.coalesce(F.col("n_chars") >= 500, F.lit(False)))]


RULES_SQL = """
    WITH j AS (SELECT doc_id, quality, lang, n_chars FROM documents LEFT JOIN labels USING (doc_id)),
    c AS (SELECT doc_id, 'quality' AS field, 'has a label' AS rule, CAST(quality AS VARCHAR) AS value, quality IS NOT NULL AS valid FROM j
          UNION ALL SELECT doc_id, 'lang', 'known language', lang, lang IN ('en', 'fr', 'es') FROM j
          UNION ALL SELECT doc_id, 'n_chars', 'long enough', CAST(n_chars AS VARCHAR), n_chars >= 500 FROM j) """
QUEUE_SQL = RULES_SQL + "SELECT 'documents' AS source, field, CAST(doc_id AS VARCHAR) AS pk, rule, value FROM c"


@query("f10_review_queue", QUEUE_SQL + " WHERE NOT valid")
def f10(spark, sf):
    return q.review_queue(labelled(spark, sf), "documents", "doc_id", document_rules())


@query("f10_amend_queue", QUEUE_SQL)
def f10_amend(spark, sf):
    return q.review_queue(labelled(spark, sf), "documents", "doc_id", document_rules(), amend=True)


@query("f11_merge_answers", f"""
    WITH old AS ({ANSWERS_SQL}),
    new AS (SELECT CAST(doc_id AS VARCHAR) AS pk, CASE WHEN lang = 'fr' THEN '' WHEN lang = 'de' THEN NULL ELSE CAST(n_chars // 1000 AS VARCHAR) END AS value FROM documents),
    kept AS (SELECT 'documents' AS source, 'quality' AS field, pk, value FROM new WHERE value IS NULL OR value <> '')
    SELECT * FROM kept UNION ALL SELECT * FROM old WHERE (field, pk) NOT IN (SELECT field, pk FROM kept)""")
def f11(spark, sf):
    """New answers for every document; French ones were skipped, German ones answered with null."""
    lang = F.col("lang")
    value = F.when(lang == "fr", "").when(lang == "de", F.lit(None)).otherwise(F.floor(F.col("n_chars") / 1000).cast("string"))
    new = table(spark, sf, "documents").select(F.lit("documents").alias("source"), F.lit("quality").alias("field"),
                                               F.col("doc_id").cast("string").alias("pk"), value.alias("value"), F.lit(1).alias("version"))
    return q.merge_answers(label_answers(spark, sf), new)


@query("f12_validation_summary", RULES_SQL + "SELECT field, rule, CAST(count_if(valid) AS BIGINT) AS valid, CAST(count_if(NOT valid) AS BIGINT) AS invalid FROM c GROUP BY field, rule")
def f12(spark, sf):
    return q.validation_summary(labelled(spark, sf), document_rules())
