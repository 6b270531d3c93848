"""Queries on text functions, unique names and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyshelf.functions import text as t
from tidyshelf.operators import model as m
from tidyshelf.operators import names as n
from tidyshelf.plans.registry import query, table
from tidyshelf.plans.tables import labelled
from tidyshelf.sources.collections import explode_wrapped

SEGMENTS = {"BUILDING": "Construction", "MACHINERY": "Machines"}


def squeeze_sql(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


def slug_sql(x: str) -> str:
    kept = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_\\s\\x{{A0}}-]', '', 'g')"
    return f"regexp_replace(lower(regexp_replace({kept}, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')), '[\\s\\x{{A0}}-]+', '-', 'g')"


@query("g1_replace_exact", """
    SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' WHEN 'MACHINERY' THEN 'Machines' ELSE c_mktsegment END AS segment FROM customer""")
def g1(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", t.replace_exact(F.col("c_mktsegment"), SEGMENTS).alias("segment"))


@query("g1_replace_by_table", """
    SELECT c_custkey, coalesce(s_name, c_name) AS name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey * 7""")
def g1_table(spark, sf):
    """Every seventh customer is renamed after a supplier; the mapping lists each entry twice."""
    entries = table(spark, sf, "supplier").select((F.col("s_suppkey") * 7).alias("number"), "s_name")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    mapping = customers.join(entries, F.col("c_custkey") == F.col("number")).select(F.col("c_name").alias("key"), F.col("s_name").alias("value"))
    return t.replace_by_table(customers, "c_name", mapping.unionByName(mapping)).withColumnRenamed("c_name", "name")


@query("g2_strip_words", "SELECT doc_id, sha256(replace(replace(replace(text, ' the', ''), 'ing', ''), 'ou', 'u')) AS stripped FROM documents")
def g2(spark, sf):
    stripped = t.strip_words(F.col("text"), {" the": "", "ing": "", "ou": "u"})
    return table(spark, sf, "documents").select("doc_id", F.sha2(stripped, 256).alias("stripped"))


@query("g3_singular", """
    SELECT conv_id, turn, sha256(array_to_string(list_transform(string_split(text, ' '),
        lambda w: CASE WHEN ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END), ' ')) AS singulars FROM conversations""")
def g3(spark, sf):
    words = F.transform(F.split("text", " "), t.singular)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.array_join(words, " "), 256).alias("singulars"))


SOURCES = {"0": "Alpha", "1": "Beta", "2": "Gamma", "3": "Delta", "4": "Epsilon", "5": "Zeta"}


@query("g4_resolve_sentinel", """
    SELECT doc_id, source, CASE source WHEN 'src0' THEN 'Alpha' WHEN 'src1' THEN 'Beta' WHEN 'src2' THEN 'Gamma' WHEN 'src3' THEN 'Delta'
        WHEN 'src4' THEN 'Epsilon' WHEN 'src5' THEN 'Zeta' END AS name,
        source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5') AS unknown FROM documents""")
def g4(spark, sf):
    source = F.col("source")
    return table(spark, sf, "documents").select(
        "doc_id", "source", t.resolve_sentinel(source, "src", SOURCES).alias("name"), t.sentinel_unknown(source, "src", SOURCES).alias("unknown"))


@query("g5_default_by_set", """
    SELECT doc_id, coalesce(CASE quality WHEN 1 THEN 'Good' WHEN 0 THEN 'Poor' END, CASE WHEN lang IN ('fr', 'es') THEN 'Grey' ELSE 'Green' END) AS color
    FROM documents LEFT JOIN labels USING (doc_id)""")
def g5(spark, sf):
    color = F.when(F.col("quality") == 1, "Good").when(F.col("quality") == 0, "Poor")
    return labelled(spark, sf).select("doc_id", t.default_by_set(color, F.col("lang"), ["fr", "es"], "Grey", "Green").alias("color"))


@query("g6_split_suffix", """
    SELECT p_partkey, CASE WHEN ends_with(p_name, 'widget') THEN 'Widget' WHEN ends_with(p_name, 'ring') THEN 'Ring' END AS scope,
        CASE WHEN ends_with(p_name, 'widget') THEN replace(p_name, ' widget', '') WHEN ends_with(p_name, 'ring') THEN replace(p_name, ' ring', '') ELSE p_name END AS p_name
    FROM part""")
def g6(spark, sf):
    return t.split_suffix(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", ["Widget", "Ring"], "scope")


@query("g7_normalize_source", """
    SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'Base Game' WHEN 'SMALL' THEN 'Small Realm' ELSE p_type END AS source FROM part""")
def g7(spark, sf):
    raw = F.when(F.col("p_type") == "PROMO", "Core Box").otherwise(F.concat("p_type", F.lit(" Box")))
    source = t.normalize_source(raw, {"Core Box": "Base Game"}, "Box", {"SMALL": "Small Realm"})
    return table(spark, sf, "part").select("p_partkey", source.alias("source"))


@query("g8_slugify", f"SELECT doc_id, sha256({slug_sql('text')}) AS slug FROM documents")
def g8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(t.slugify(F.col("text")), 256).alias("slug"))


def typed_parts(spark, sf):
    """Parts with the kinds of attribute a name is made of."""
    size = F.col("p_size")
    modes = F.when(size < 10, F.array(F.lit("Skirmish"), F.lit("Campaign"))).when(size < 20, F.array(F.lit("Skirmish")))
    return table(spark, sf, "part").withColumns({
        "elite": F.col("p_type") == "PROMO", "unique": size > 40, "modes": modes})


MODES = ["Campaign", "Skirmish"]
SHOWN_ELITE = "CASE WHEN p_type = 'PROMO' AND NOT p_size > 40 THEN 'elite' END"
SHOWN_MODES = "CASE WHEN p_size >= 10 AND p_size < 20 THEN 'Skirmish' END"


@query("g9_canonical_name", f"SELECT p_partkey, {squeeze_sql(f'concat({SHOWN_ELITE}, p_name, {SHOWN_MODES}, p_size)')} AS canonical FROM part")
def g9(spark, sf):
    parts = typed_parts(spark, sf)
    return parts.select("p_partkey", t.canonical_name(parts, "elite", "p_name", "modes", "p_size", full_set=MODES).alias("canonical"))


FILE_SQL = f"concat_ws('-', {SHOWN_ELITE}, {slug_sql('p_name')}, {slug_sql('p_brand')}, {SHOWN_MODES.replace('Skirmish', 'skirmish')}, CAST(p_size AS VARCHAR))"


@query("g10_filename_words", f"SELECT p_partkey, concat_ws('-', 'card', {FILE_SQL}, 'front') AS words FROM part")
def g10(spark, sf):
    parts = typed_parts(spark, sf)
    words = t.filename_words(parts, "elite", "p_name", "p_brand", "modes", "p_size", full_set=MODES, prefixes=["card"], suffixes=["front"])
    return parts.select("p_partkey", words.alias("words"))


@query("g11_derived_path", f"""
    WITH p AS (SELECT p_partkey, p_size, concat_ws('/', 'part-cards', CASE WHEN p_type <> 'SMALL' THEN {slug_sql('p_type')} END, {slug_sql('p_brand')}, {FILE_SQL} || '.png') AS path FROM part)
    SELECT p_partkey, path, p_size > 25 AS unchanged FROM p""")
def g11(spark, sf):
    """Paths of parts; the larger ones have theirs already."""
    parts = typed_parts(spark, sf).withColumn("kind", F.when(F.col("p_type") != "SMALL", F.col("p_type")))
    path = t.derived_path(parts, "Part Cards", ["kind", "p_brand"], ["elite", "p_name", "p_brand", "modes", "p_size"], full_set=MODES)
    held = F.when(F.col("p_size") > 25, F.col("path")).otherwise(F.concat(F.lit("old/"), "path"))
    return parts.select("p_partkey", "p_size", path.alias("path")).select("p_partkey", "path", (held == F.col("path")).alias("unchanged"))


@query("g11_path_with_parent", f"""
    SELECT c_custkey, concat_ws('/', 'customers', {slug_sql('c_mktsegment')}, {slug_sql('n_name')} || '-' || {slug_sql('c_name')} || '.png') AS path
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def g11_parent(spark, sf):
    found = m.resolved(m.lookup_attribute(table(spark, sf, "customer"), table(spark, sf, "nation"), "c_nationkey", "n_nationkey", "n_name", "nation"))
    return found.select("c_custkey", t.derived_path(found, "customers", ["c_mktsegment"], ["c_name"], parent="nation").alias("path"))


@query("g12_rewrite_url", """
    SELECT page_id, 'http://cards.example.org/albums' || regexp_extract(url, '^https?://[^/]+(/.*)$', 1) || '.png' AS url FROM pages""")
def g12(spark, sf):
    """Thumbnail addresses made from the page's path."""
    path = F.regexp_extract("url", "^https?://[^/]+(/.*)$", 1)
    number = F.lpad((F.col("page_id") % 1000).cast("string"), 3, "0")
    thumb = F.concat(F.lit("/cache"), path, F.lit("_"), number, F.lit("_thumb_ffflogog_whatermark_cc.png"))
    return table(spark, sf, "pages").select("page_id", t.rewrite_url(thumb, "http://cards.example.org").alias("url"))


@query("g13_file_parts", "SELECT page_id, string_split(url, '.')[1] AS stem, string_split(url, '.')[-1] AS extension FROM pages")
def g13(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.file_stem(F.col("url")).alias("stem"), t.file_extension(F.col("url")).alias("extension"))


@query("g14_numbers", """
    SELECT page_id, CAST(regexp_extract_all(url, '[0-9]+')[-1] AS BIGINT) AS last_number, page_id AS wave FROM pages""")
def g14(spark, sf):
    wave = t.strip_to_int(F.concat(F.lit("Wave-"), F.col("page_id").cast("string")), ["wave ", "wave-"])
    return table(spark, sf, "pages").select("page_id", t.trailing_int(F.col("url")).alias("last_number"), wave.alias("wave"))


STRATEGIES = [("p_name",), ("p_name", "p_brand"), ("p_name", "p_brand", "p_type"), ("p_name", "p_brand", "p_type", "p_size")]
_N = [squeeze_sql("concat(" + ", ".join(s) + ")") for s in STRATEGIES]
NAMED_SQL = f"""
    WITH n AS (SELECT p_partkey, p_name, {", ".join(f"{x} AS n{i}" for i, x in enumerate(_N))} FROM part),
    l0 AS (SELECT *, count(*) OVER (PARTITION BY n0) = 1 AS s0 FROM n),
    l1 AS (SELECT *, NOT s0 AND count_if(NOT s0) OVER (PARTITION BY n1) = 1 AS s1 FROM l0),
    l2 AS (SELECT *, NOT (s0 OR s1) AND count_if(NOT (s0 OR s1)) OVER (PARTITION BY n2) = 1 AS s2 FROM l1),
    l3 AS (SELECT *, NOT (s0 OR s1 OR s2) AND count_if(NOT (s0 OR s1 OR s2)) OVER (PARTITION BY n3) = 1 AS s3 FROM l2),
    named AS (SELECT p_partkey, p_name, CASE WHEN s0 THEN n0 WHEN s1 THEN n1 WHEN s2 THEN n2 WHEN s3 THEN n3 ELSE '' END AS canonical,
              CASE WHEN s0 THEN 0 WHEN s1 THEN 1 WHEN s2 THEN 2 WHEN s3 THEN 3 END AS level FROM l3),
    expected AS (SELECT {_N[2]} AS name FROM part) """


def named_parts(spark, sf):
    """Parts with the shortest name that tells each apart."""
    return n.unique_names(table(spark, sf, "part"), "p_partkey", STRATEGIES)


def expected_names(spark, sf):
    """The outside list: a name per part, repeated where parts agree."""
    parts = table(spark, sf, "part")
    return parts.select(t.canonical_name(parts, "p_name", "p_brand", "p_type").alias("name"))


def generated_names(spark, sf):
    return named_parts(spark, sf).where("canonical <> ''").select(F.col("canonical").alias("name"))


@query("h1_unique_names", NAMED_SQL + "SELECT p_partkey, p_name, canonical, level FROM named")
def h1(spark, sf):
    return named_parts(spark, sf).select("p_partkey", "p_name", "canonical", "level")


@query("h1_name_clashes", """
    WITH s AS (SELECT s_suppkey AS key, CASE WHEN s_suppkey < 10 THEN 'x' || s_suppkey ELSE 'x' END AS a,
                      CASE WHEN s_suppkey < 10 THEN '' WHEN s_suppkey < 20 THEN CAST(s_suppkey % 10 AS VARCHAR) ELSE CAST(s_suppkey AS VARCHAR) END AS b FROM supplier),
    l AS (SELECT *, count(*) OVER (PARTITION BY a) = 1 AS alone FROM s),
    named AS (SELECT CASE WHEN alone THEN a ELSE a || b END AS canonical, CASE WHEN alone THEN 0 ELSE 1 END AS level FROM l)
    SELECT canonical, count(*) AS records, count(DISTINCT level) AS levels FROM named GROUP BY canonical HAVING count(*) > 1""")
def h1_clashes(spark, sf):
    """The first ten suppliers are told apart by a name that the next ten get from two parts."""
    key = F.col("s_suppkey")
    parts = table(spark, sf, "supplier").select(
        "s_suppkey", F.when(key < 10, F.concat(F.lit("x"), key.cast("string"))).otherwise("x").alias("a"),
        F.when(key < 10, "").when(key < 20, (key % 10).cast("string")).otherwise(key.cast("string")).alias("b"))
    return n.name_clashes(n.unique_names(parts, "s_suppkey", [["a"], ["a", "b"]]))


@query("h2_unresolved_names", NAMED_SQL + "SELECT p_partkey, p_name FROM named WHERE canonical = ''")
def h2(spark, sf):
    return n.unresolved_names(named_parts(spark, sf)).select("p_partkey", "p_name")


@query("h3_coverage", NAMED_SQL + """SELECT count(*) AS expected,
    round(100.0::DOUBLE * count_if(name IN (SELECT canonical FROM named WHERE canonical <> '')) / count(*), 2) AS percent FROM expected""")
def h3(spark, sf):
    return n.coverage(expected_names(spark, sf), generated_names(spark, sf))


@query("h4_missing_names", NAMED_SQL + "SELECT name FROM expected WHERE name NOT IN (SELECT canonical FROM named WHERE canonical <> '')")
def h4(spark, sf):
    return n.missing_names(expected_names(spark, sf), generated_names(spark, sf))


def page_words(spark, sf):
    """Names wanted: all words of the pages' texts."""
    words = F.explode(F.split(F.regexp_replace("html", "<[^>]*>", " "), r"\s+"))
    return table(spark, sf, "pages").select(words.alias("word")).select(t.squeeze(F.col("word")).alias("name")).where("name <> ''").distinct()


def benchmark_words(spark, sf):
    """Names known: the words of the benchmark texts."""
    words = F.explode(F.split("text", r"\s+"))
    return table(spark, sf, "benchmark").select(words.alias("word")).select(t.squeeze(F.col("word")).alias("name")).where("name <> ''").distinct()


WORDS_SQL = f"""
    WITH RECURSIVE p AS (SELECT unnest(regexp_split_to_array(regexp_replace(html, '<[^>]*>', ' ', 'g'), $$\\s+$$)) AS word FROM pages),
    q AS (SELECT unnest(regexp_split_to_array(text, $$\\s+$$)) AS word FROM benchmark),
    k AS MATERIALIZED (SELECT DISTINCT name, length(name) AS n FROM (SELECT {squeeze_sql('word')} AS name FROM q) WHERE name <> ''),
    w AS MATERIALIZED (SELECT DISTINCT name, length(name) AS n FROM (SELECT {squeeze_sql('word')} AS name FROM p) WHERE name <> '' AND name NOT IN (SELECT name FROM k)),
    held AS (SELECT w.name AS missing, k.name AS candidate FROM w JOIN k ON contains(k.name, w.name)) """

# The ratio by its definition: take the longest common run, the earliest if there are several, then look on both sides of it.
# Its pairs are searched among those whose edit distance, counted in bytes of at most two to a letter, allows it.
RATIO_SQL = """,
    close AS (SELECT w.name AS a, k.name AS b, w.n AS na, k.n AS nb FROM w JOIN k ON 2 * least(w.n, k.n) > 0.8 * (w.n + k.n)
              AND levenshtein(w.name, k.name) <= 2 * (w.n + k.n - 2 * (floor(0.4 * (w.n + k.n)) + 1))),
    part(a, b, na, nb, alo, ahi, blo, bhi, matched) AS (
        SELECT a, b, na, nb, 0::BIGINT, na, 0::BIGINT, nb, 0::BIGINT FROM close
        UNION ALL
        SELECT a, b, na, nb, CASE side WHEN 0 THEN alo ELSE run.i + run.k END, CASE side WHEN 0 THEN run.i ELSE ahi END,
               CASE side WHEN 0 THEN blo ELSE run.j + run.k END, CASE side WHEN 0 THEN run.j ELSE bhi END, CASE side WHEN 0 THEN run.k ELSE 0 END
        FROM (SELECT a, b, na, nb, alo, ahi, blo, bhi, arg_max({'i': i, 'j': j, 'k': k}, {'k': k, 'i': -i, 'j': -j}) AS run FROM (
                  SELECT *, list_max(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda k: substr(a, i + 1, k) = substr(b, j + 1, k))) AS k FROM (
                      SELECT *, unnest(range(blo, bhi)) AS j FROM (SELECT *, unnest(range(alo, ahi)) AS i FROM part)) WHERE substr(a, i + 1, 1) = substr(b, j + 1, 1))
              GROUP BY ALL), (VALUES (0), (1)) sides(side)),
    alike AS (SELECT a, b FROM part GROUP BY a, b, na, nb HAVING 2.0::DOUBLE * sum(matched) / (na + nb) > 0.80::DOUBLE) """


@query("h5_fuzzy_candidates", WORDS_SQL + RATIO_SQL + "SELECT a AS missing, b AS candidate FROM alike UNION SELECT missing, candidate FROM held")
def h5(spark, sf):
    have = benchmark_words(spark, sf)
    return n.fuzzy_candidates(n.missing_names(page_words(spark, sf), have), have)


@query("h5_containing_candidates", WORDS_SQL + "SELECT missing, candidate FROM held")
def h5_containing(spark, sf):
    have = benchmark_words(spark, sf)
    return n.containing_candidates(n.missing_names(page_words(spark, sf), have), have)


@query("h6_fetch_manifest", """
    WITH l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS host, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS links FROM pages),
    e AS (SELECT host, unnest(links) AS link FROM l)
    SELECT 'cards' AS "table", host || link AS url, link AS name FROM e WHERE NOT contains(host, 'example.net')""")
def h6(spark, sf):
    """Each page as a nested list of linked cards, minus those on a known host."""
    host = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    links = F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)"'), 1)
    cards = lambda wrapper: F.transform(links, lambda x: F.struct(F.struct(x.alias("name"), F.concat(host, x).alias("url")).alias(wrapper)))
    secure = F.startswith("url", F.lit("https"))
    nested = table(spark, sf, "pages").select(
        F.when(secure, cards("card")).alias("commandCards"), F.when(~secure, cards("deployment")).alias("deployments"))
    records = explode_wrapped(nested, ("commandCards", "deployments"), ("card", "deployment"))
    return n.fetch_manifest(records, "cards", "url", "name", "example.net")


@query("h7_level_report", NAMED_SQL + "SELECT level, count(*) AS names FROM named WHERE level IS NOT NULL GROUP BY level")
def h7(spark, sf):
    return n.level_report(named_parts(spark, sf))
