"""Queries on image headers, plans and decision tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyshelf.operators import images as j
from tidyshelf.plans.registry import query, table
from tidyshelf.session import pin


def part_files(spark, sf):
    """A small image file per part, written as a table: good headers of three formats, a JPEG without a
    frame, a cut PNG, and text that is no image."""
    width, height = F.col("p_size") * 7 + 20, (F.col("p_partkey") % 400 + 30).cast("int")
    word = lambda col, digits: F.lpad(F.hex(col), digits, "0")
    little = lambda col: F.concat(F.substring(word(col, 4), 3, 2), F.substring(word(col, 4), 1, 2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), word(width, 8), word(height, 8), F.lit("0806000000"))
    gif = F.concat(F.lit("474946383961"), little(width), little(height), F.lit("F7000021F904010A0000FF002C"), F.lit("00000000"))
    start = F.lit("FFD8FFE000104A46494600010100000100010000")
    frame = F.concat(F.lit("FFFFC0001108"), word(height, 4), word(width, 4), F.lit("03012200"))
    kind = F.col("p_type")
    content = (F.when(kind == "ECONOMY", png).when(kind == "LARGE", gif).when(kind == "MEDIUM", F.concat(start, frame))
               .when(kind == "PROMO", F.concat(start, F.lit("FFDB0004AAAA"))).when(kind == "SMALL", F.left(png, F.lit(40)))
               .otherwise(F.hex(F.concat(F.lit("<html><body>no image</body></html>"), "p_name"))))
    path = F.concat(F.lit("part-cards/"), F.col("p_partkey").cast("string"))
    return pin(table(spark, sf, "part").select("p_partkey", "p_type", path.alias("path"), F.unhex(content).alias("content")), "images")


SIZES_SQL = """
    WITH s AS (SELECT p_partkey, p_type, 'part-cards/' || p_partkey AS path,
        CASE p_type WHEN 'ECONOMY' THEN 'png' WHEN 'LARGE' THEN 'gif' WHEN 'MEDIUM' THEN 'jpeg' WHEN 'PROMO' THEN 'jpeg' END AS format,
        CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN CAST(p_size * 7 + 20 AS BIGINT) END AS width,
        CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN p_partkey % 400 + 30 END AS height FROM part),
    known AS (SELECT * FROM s WHERE width IS NOT NULL) """


def part_sizes(spark, sf):
    return j.image_sizes(part_files(spark, sf)).drop("content")


def known_sizes(spark, sf):
    return part_sizes(spark, sf).where("width IS NOT NULL")


@query("j1_image_sizes", SIZES_SQL + "SELECT p_partkey, format, width, height FROM s")
def j1(spark, sf):
    return part_sizes(spark, sf).select("p_partkey", "format", "width", "height")


@query("j1_image_inventory", SIZES_SQL + "SELECT format, count(*) AS files, CAST(count_if(width IS NULL) AS BIGINT) AS unreadable FROM s GROUP BY format")
def j1_inventory(spark, sf):
    return j.image_inventory(part_files(spark, sf))


@query("j2_dimension_summary", SIZES_SQL + """SELECT p_type, max(width) AS max_width, min(width) AS min_width,
    max(height) AS max_height, min(height) AS min_height FROM known WHERE format <> 'gif' GROUP BY p_type""")
def j2(spark, sf):
    return j.dimension_summary(known_sizes(spark, sf), "p_type", predicate=F.col("format") != "gif")


def _plan_sql(width: str, height: str) -> str:
    return SIZES_SQL + f""", t AS (SELECT path, width, height, {width} AS target_width, {height} AS target_height FROM known),
    a AS (SELECT *, least(width, target_width) AS w1, CASE WHEN width > target_width
          THEN greatest(CAST(floor(CAST(height * target_width AS DOUBLE) / width) AS BIGINT), 1) ELSE height END AS h1
          FROM t WHERE width <> target_width OR height <> target_height),
    f AS (SELECT path, width, height, target_width, target_height, least(h1, target_height) AS new_height, CASE WHEN h1 > target_height
          THEN greatest(CAST(floor(CAST(w1 * target_height AS DOUBLE) / h1) AS BIGINT), 1) ELSE w1 END AS new_width FROM a)
    SELECT *, CAST(floor((target_width - new_width) / 2.0) AS BIGINT) AS offset_x, CAST(floor((target_height - new_height) / 2.0) AS BIGINT) AS offset_y FROM f"""


@query("j3_resize_plan", _plan_sql("(SELECT min(width) FROM known)", "(SELECT min(height) FROM known)"))
def j3(spark, sf):
    return j.resize_plan(pin(known_sizes(spark, sf).select("path", "width", "height"), "sizes"))


@query("j3_resize_to_box", _plan_sql("CAST(150 AS BIGINT)", "CAST(200 AS BIGINT)"))
def j3_box(spark, sf):
    return j.resize_plan(known_sizes(spark, sf).select("path", "width", "height"), 150, 200)


@query("j4_choose_one", SIZES_SQL + """,
    r AS (SELECT c_custkey, 'part-cards/' || c_custkey AS a, 'part-cards/' || c_nationkey AS b,
          CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END AS several FROM customer),
    w AS (SELECT r.*, coalesce(x.width > y.width AND x.height > y.height, false) AS larger
          FROM r LEFT JOIN s x ON x.path = a LEFT JOIN s y ON y.path = b)
    SELECT c_custkey, CASE WHEN several = 1 OR (several = 2 AND larger) THEN a END AS chosen, several = 2 AND NOT larger AS needs_review FROM w""")
def j4(spark, sf):
    """Customers with no list, one candidate or two."""
    path = lambda c: F.concat(F.lit("part-cards/"), F.col(c).cast("string"))
    images = F.when(F.col("c_mktsegment") == "BUILDING", F.array(path("c_custkey"))) \
        .when(F.col("c_mktsegment") != "MACHINERY", F.array(path("c_custkey"), path("c_nationkey")))
    records = table(spark, sf, "customer").select("c_custkey", images.alias("images"))
    return j.choose_one(records, "images", part_sizes(spark, sf)).select("c_custkey", "chosen", "needs_review")


def customer_images(spark, sf):
    """Customers with up to two of three images."""
    key, segment = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    name = lambda kind: F.concat(F.lit(kind + "/"), key, F.lit(".png"))
    return table(spark, sf, "customer").select(
        "c_custkey", F.when(segment != "BUILDING", name("image")).alias("image"),
        F.when(segment == "BUILDING", name("healthy")).alias("healthy"), F.when(segment == "BUILDING", name("wounded")).alias("wounded"))


def image_rows(spark, sf):
    return j.unpivot_images(customer_images(spark, sf), "customer", "c_custkey")


ROWS_SQL = """
    WITH rows AS (SELECT 'customer' AS "table", c_custkey AS id, 'image' AS attr, 'image/' || c_custkey || '.png' AS path FROM customer WHERE c_mktsegment <> 'BUILDING'
    UNION ALL SELECT 'customer', c_custkey, 'healthy', 'healthy/' || c_custkey || '.png' FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT 'customer', c_custkey, 'wounded', 'wounded/' || c_custkey || '.png' FROM customer WHERE c_mktsegment = 'BUILDING') """


@query("j5_unpivot_images", ROWS_SQL + "SELECT * FROM rows")
def j5(spark, sf):
    return image_rows(spark, sf)


@query("j6_unprocessed", ROWS_SQL + "SELECT * FROM rows WHERE path NOT IN (SELECT 'image/' || o_custkey || '.png' FROM orders WHERE o_orderstatus = 'F')")
def j6(spark, sf):
    """Images of customers with a finished order are done."""
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.concat(F.lit("image/"), F.col("o_custkey").cast("string"), F.lit(".png")).alias("path"))
    return j.unprocessed(image_rows(spark, sf), done)


@query("j7_copy_manifest", ROWS_SQL + "SELECT *, './images/' || path AS read_path, './high-res/' || path AS write_path FROM rows")
def j7(spark, sf):
    return j.copy_manifest(image_rows(spark, sf), "./images/", "./high-res")


@query("j8_median_band", """
    SELECT event_type, median(value) AS median, CAST(trunc(greatest(0.0::DOUBLE, (1.0::DOUBLE - 0.33::DOUBLE) * median(value))) AS BIGINT) AS lower,
           CAST(trunc(least(255.0::DOUBLE, (1.0::DOUBLE + 0.33::DOUBLE) * median(value))) AS BIGINT) AS upper FROM events GROUP BY event_type""")
def j8(spark, sf):
    return j.median_band(table(spark, sf, "events"), "event_type", "value")


@query("j8_within_band", """
    WITH m AS (SELECT source, median(n_chars) AS m FROM documents GROUP BY source)
    SELECT doc_id, source, n_chars FROM documents JOIN m USING (source)
    WHERE n_chars BETWEEN trunc(greatest(0.0::DOUBLE, (1.0::DOUBLE - 0.33::DOUBLE) * m)) AND trunc(least(100000.0::DOUBLE, (1.0::DOUBLE + 0.33::DOUBLE) * m))""")
def j8_within(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return j.within_band(docs, j.median_band(docs, "source", "n_chars", ceiling=100000), "source", "n_chars")


def part_rules():
    kind, size = F.col("p_type"), F.col("p_size")
    return [("affine-large", (kind == "LARGE") & (size > 25)), ("affine-other", (kind == "LARGE") & (size <= 25)),
            ("rigid-short", kind.isin("SMALL", "ECONOMY") & (F.col("p_brand") != "Brand#7")),
            ("rigid-brand", F.col("p_brand") == "Brand#7"), ("round", F.col("p_name").contains("ring"))]


RULE_SQL = """
    WITH c AS (SELECT p_partkey, CASE WHEN p_type = 'LARGE' AND p_size > 25 THEN 0 END AS r0, CASE WHEN p_type = 'LARGE' AND p_size <= 25 THEN 1 END AS r1,
        CASE WHEN p_type IN ('SMALL', 'ECONOMY') AND p_brand <> 'Brand#7' THEN 2 END AS r2, CASE WHEN p_brand = 'Brand#7' THEN 3 END AS r3,
        CASE WHEN contains(p_name, 'ring') THEN 4 END AS r4 FROM part),
    h AS (SELECT p_partkey, list_filter([r0, r1, r2, r3, r4], lambda x: x IS NOT NULL) AS hits FROM c),
    e AS (SELECT p_partkey, unnest(CASE WHEN len(hits) = 0 THEN [NULL] ELSE hits END) AS rule_pos FROM h),
    named AS (SELECT p_partkey, rule_pos, ['affine-large', 'affine-other', 'rigid-short', 'rigid-brand', 'round'][rule_pos + 1] AS rule FROM e) """


@query("j9_assign_by_rules", RULE_SQL + "SELECT p_partkey, CAST(rule_pos AS INTEGER) AS rule_pos, rule FROM named")
def j9(spark, sf):
    return j.assign_by_rules(table(spark, sf, "part"), part_rules()).select("p_partkey", "rule_pos", "rule")


@query("j9_rule_report", RULE_SQL + """SELECT rule, count(*) AS "rows" FROM named WHERE rule IS NOT NULL GROUP BY rule
    UNION ALL SELECT '(none)', count(*) FROM h WHERE len(hits) = 0 UNION ALL SELECT '(several)', count(*) FROM h WHERE len(hits) > 1""")
def j9_report(spark, sf):
    return j.rule_report(table(spark, sf, "part"), part_rules())
