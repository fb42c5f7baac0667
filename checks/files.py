"""File collection, text block and geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import add_view, oracle
from quire.functions import geometry as g
from quire.operators import candidates as cand
from quire.schemas import IMAGE_EXTENSIONS, REGIONS
from quire.sources import files as fs, tokens

QUERIES, ORACLES = {}, {}


def q(name, view, sql):
    def add(function):
        QUERIES[name] = function
        ORACLES[name] = oracle(view, sql)
        return function
    return add


def f_files(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    ext = (F.when(F.col("o_orderpriority") == "1-URGENT", "jpg").when(F.col("o_orderpriority") == "2-HIGH", "TIF")
           .when(F.col("o_orderpriority") == "3-MEDIUM", "pdf").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "docx").otherwise("jpg"))
    name = (F.when(key % 3 == 0, F.format_string("Page_%03d.%s", key % 1000, ext))
            .when(key % 3 == 1, F.format_string("%d_%05d.%s", 9780000000000 + cust, key % 100000, ext))
            .otherwise(F.format_string("scan%d b%d.%s", key % 7, key, ext)))
    return fx.table(spark, sf_dir, "orders").select(
        cust.cast("string").alias("book_id"), name.alias("original_name"),
        F.concat(F.lit("/library/"), cust.cast("string"), F.lit("/"), name).alias("path"),
        (key % 30 + 1).cast("int").alias("page_count"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("changed"))


add_view("f_files", """
  SELECT CAST(o_custkey AS VARCHAR) AS book_id, name AS original_name, '/library/' || o_custkey || '/' || name AS path, CAST(o_orderkey % 30 + 1 AS INTEGER) AS page_count, ext
  FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'Page_' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.' || ext
      WHEN 1 THEN (9780000000000 + o_custkey) || '_' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') || '.' || ext
      ELSE 'scan' || (o_orderkey % 7) || ' b' || o_orderkey || '.' || ext END AS name
    FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'jpg' WHEN '2-HIGH' THEN 'TIF' WHEN '3-MEDIUM' THEN 'pdf' WHEN '4-NOT SPECIFIED' THEN 'docx' ELSE 'jpg' END AS ext FROM orders))""")


@q("file_facts", "f_files", """
SELECT path, CASE lower(ext) WHEN 'pdf' THEN 'document' WHEN 'docx' THEN 'unknown' ELSE 'image' END AS kind, ext <> 'docx' AS supported,
       CASE ext WHEN 'pdf' THEN page_count WHEN 'docx' THEN 0 ELSE 1 END AS estimated_pages FROM f_files""")
def file_facts(spark, sf_dir):
    return fs.file_facts(f_files(spark, sf_dir)).select("path", "kind", "supported", "estimated_pages")


@q("collection_census", "f_files", """
SELECT book_id, count(*) AS total_files, count(*) FILTER (ext <> 'docx') AS supported_files, count(*) FILTER (ext = 'docx') AS unsupported_files,
       CAST(sum(CASE ext WHEN 'pdf' THEN page_count WHEN 'docx' THEN 0 ELSE 1 END) AS BIGINT) AS estimated_pages, bool_or(ext <> 'docx') AS is_valid,
       CASE WHEN NOT bool_or(ext <> 'docx') THEN 'No supported files found in directory' END AS error FROM f_files GROUP BY book_id""")
def collection_census(spark, sf_dir):
    return fs.collection_census(f_files(spark, sf_dir))


@q("natural_order", "f_files", r"""
SELECT book_id, path, CAST(row_number() OVER (PARTITION BY book_id ORDER BY n, t, path) - 1 AS INTEGER) AS scan_index FROM (
  SELECT book_id, path, coalesce(try_cast(nullif(p, '') AS BIGINT), 999999) AS n,
         CASE WHEN p <> '' THEN s ELSE 'scan' || lpad(regexp_extract(s, 'scan([0-9]+)', 1), 20, '0') || ' b' || lpad(regexp_extract(s, 'b([0-9]+)', 1), 20, '0') END AS t
  FROM (SELECT *, CASE WHEN starts_with(s, 'page_') THEN regexp_extract(s, 'page_([0-9]+)', 1) WHEN contains(s, '_') THEN regexp_extract(s, '_([0-9]{3,5})$', 1) ELSE regexp_extract(s, '([0-9]{3,5})$', 1) END AS p
        FROM (SELECT *, lower(replace(original_name, '.' || ext, '')) AS s FROM f_files WHERE ext <> 'docx')))""")
def natural_order(spark, sf_dir):
    return fs.natural_order(f_files(spark, sf_dir), fx.wide(spark, sf_dir, "orders", "o_custkey")).select("book_id", "path", "scan_index")


@q("expand_documents", "f_lines", """
SELECT p_partkey AS document_id, p_name AS document, CAST(k AS INTEGER) AS page_number, p_name || '_page_' || lpad(CAST(k AS VARCHAR), 3, '0') AS original_name, p_size AS total_pages, 300 AS dpi
FROM part, LATERAL (SELECT unnest(range(1, p_size + 1)) AS k) WHERE p_size > 0""")
def expand_documents(spark, sf_dir):
    return fs.expand_documents(fx.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("document_id"), F.col("p_name").alias("document"), F.col("p_size").alias("page_count")))


@q("book_ids", "f_files", """
SELECT book_id, first_file, CASE WHEN regexp_full_match(h, '[0-9]{10,}') THEN h ELSE 'Organized_Pages' END AS output_folder,
       CASE WHEN regexp_full_match(h, '[0-9]+') THEN h ELSE 'page' END AS file_prefix,
       coalesce(nullif(regexp_extract(folder, '[0-9]{13}'), ''), folder) AS folder_book
FROM (SELECT book_id, min(original_name) AS first_file, split_part(min(original_name), '_', 1) AS h, CASE WHEN CAST(book_id AS INTEGER) % 2 = 0 THEN 'scan ' || (9780000000000 + CAST(book_id AS INTEGER)) ELSE 'box ' || book_id END AS folder FROM f_files GROUP BY book_id)""")
def book_ids(spark, sf_dir):
    number = F.col("book_id").cast("int")
    folder = F.when(number % 2 == 0, F.concat(F.lit("scan "), (F.lit(9780000000000) + number).cast("string"))).otherwise(
        F.concat(F.lit("box "), F.col("book_id")))
    first = f_files(spark, sf_dir).groupBy("book_id").agg(F.min("original_name").alias("first_file")).withColumn("folder", folder)
    return fs.book_identifiers(first).drop("folder")


@q("filename_numbers", "f_files", """
SELECT path, CAST(o - 1 AS INTEGER) AS ord, text, CAST(text AS BIGINT) AS numeric_value, 70.0::DOUBLE AS confidence FROM (
  SELECT path, unnest(regexp_extract_all(original_name, '[0-9]+')) AS text, generate_subscripts(regexp_extract_all(original_name, '[0-9]+'), 1) AS o FROM f_files)""")
def filename_numbers(spark, sf_dir):
    from quire.functions.text import name_numbers

    rows = f_files(spark, sf_dir).withColumn("scan_index", F.col("path"))
    return name_numbers(rows).select(F.col("scan_index").alias("path"), "ord", "text", "numeric_value", "confidence")


@q("filename_position", "f_files", r"""
SELECT path, try_cast(CASE WHEN original_name LIKE 'Page%' THEN regexp_extract(original_name, '([0-9]+)', 1) WHEN NOT ends_with(original_name, '.jpg') THEN NULL
   WHEN contains(original_name, '_') THEN regexp_extract(original_name, '_0*([0-9]+)\.jpg', 1) ELSE regexp_extract(original_name, '([0-9]+)\.jpg', 1) END AS INTEGER) AS position FROM f_files""")
def filename_position(spark, sf_dir):
    return f_files(spark, sf_dir).select("path", fs.name_position(F.col("original_name")).alias("position"))


@q("filename_fallback", "f_files", """
SELECT path, CAST(CASE WHEN n <= 12 THEN n ELSE n - 12 END AS INTEGER) AS number,
       CASE WHEN n <= 12 THEN ['vi','vii','viii','ix','x','xi','xii'][n - 5] ELSE CAST(n - 12 AS VARCHAR) END AS text, 60.0::DOUBLE AS confidence
FROM (SELECT path, try_cast(nullif(regexp_extract(original_name, 'Page_([0-9]{3,4})', 1), '') AS INTEGER) AS n FROM f_files) WHERE n BETWEEN 6 AND 12 OR n > 50""")
def filename_fallback(spark, sf_dir):
    return cand.name_fallback(f_files(spark, sf_dir)).select("path", "number", "text", "confidence")


def f_blocks(spark, sf_dir):
    """Eight text boxes per page on 2480 x 3508 pixels."""
    from quire.functions.numerals import roman_text

    q_, part, line = F.col("l_quantity").cast("int"), F.col("l_partkey"), F.col("l_linenumber")
    price = F.floor(F.col("l_extendedprice")).cast("int")
    number = F.when(F.col("l_returnflag") == "R", roman_text(q_)).otherwise((q_ + 60 * (part % 5)).cast("string"))
    text = (F.when(line == 1, F.concat(F.lit("page "), number)).when(line == 2, F.concat(F.lit(" "), number, F.lit("  ")))
            .when(line == 3, F.concat(F.lit("a "), number, F.lit(" x"))).when(line == 4, F.lit("  ")).otherwise(number))
    left = F.when(part % 4 == 0, 8).when(part % 4 == 1, 2400).when(part % 4 == 2, 1210).otherwise(part % 2300)
    top = F.when(price % 4 == 0, 20).when(price % 4 == 1, 3440).when(price % 4 == 2, 1730).otherwise(price % 3300)
    return fx.lines(spark, sf_dir, "l_quantity", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_tax").select(
        "book_id", F.floor(F.col("i") / 8).cast("int").alias("scan_index"), (F.col("i") % 8).alias("block_index"), text.alias("text"),
        (20 + 1000 * F.col("l_tax")).alias("conf"), left.cast("int").alias("left"), top.cast("int").alias("top"),
        F.lit(60).alias("width"), F.lit(40).alias("height"), F.lit(2480).alias("page_width"), F.lit(3508).alias("page_height"))


add_view("f_blocks", """
  SELECT book_id, i // 8 AS scan_index, CAST(i % 8 AS INTEGER) AS block_index,
         CASE l_linenumber WHEN 1 THEN 'page ' || num WHEN 2 THEN ' ' || num || '  ' WHEN 3 THEN 'a ' || num || ' x' WHEN 4 THEN '  ' ELSE num END AS text,
         20 + 1000 * l_tax AS conf, CASE l_partkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 2400 WHEN 2 THEN 1210 ELSE l_partkey % 2300 END AS lft,
         CASE price % 4 WHEN 0 THEN 20 WHEN 1 THEN 3440 WHEN 2 THEN 1730 ELSE price % 3300 END AS top
  FROM (SELECT *, CAST(floor(l_extendedprice) AS INTEGER) AS price, CASE WHEN l_returnflag = 'R' THEN
      repeat('l', n // 50) || CASE WHEN n % 50 >= 40 THEN 'xl' ELSE '' END || repeat('x', (n % 50 % 40) // 10)
      || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] ELSE CAST(n + 60 * (l_partkey % 5) AS VARCHAR) END AS num
    FROM (SELECT *, CAST(l_quantity AS INTEGER) AS n FROM f_lines))""", ["f_lines"])


@q("token_filter", "f_blocks", "SELECT book_id, scan_index, block_index, trim(text) AS text, round(conf, 6) AS conf FROM f_blocks WHERE trim(text) <> '' AND conf > 30")
def token_filter(spark, sf_dir):
    return tokens.token_filter(f_blocks(spark, sf_dir)).select(
        "book_id", "scan_index", "block_index", "text", F.round("conf", 6).alias("conf"))


@q("assemble_text", "f_blocks", """
SELECT book_id, scan_index, string_agg(text, ' ' ORDER BY block_index) AS full_text, round(avg(conf), 6) AS language_confidence FROM f_blocks WHERE conf > 50 GROUP BY ALL""")
def assemble_text(spark, sf_dir):
    return tokens.assemble_text(f_blocks(spark, sf_dir)).withColumn("language_confidence", F.round("language_confidence", 6))


@q("number_boxes", "f_blocks", r"""
SELECT n.book_id, n.scan_index, n.text, coalesce(arg_min(b.lft, b.block_index), 0) AS "left", coalesce(arg_min(b.top, b.block_index), 0) AS top
FROM (SELECT DISTINCT book_id, scan_index, x AS text FROM (SELECT book_id, scan_index, unnest(regexp_extract_all(text, '[0-9]+')) AS x FROM f_blocks)) n
LEFT JOIN f_blocks b ON b.book_id = n.book_id AND b.scan_index = n.scan_index AND contains(b.text, n.text) GROUP BY ALL""")
def number_boxes(spark, sf_dir):
    blocks = f_blocks(spark, sf_dir)
    numbers = blocks.select("book_id", "scan_index", F.explode(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1))).alias("text")).distinct()
    return tokens.number_boxes(numbers, blocks).select("book_id", "scan_index", "text", "position.left", "position.top")


# region rectangles as a plain table for 2480 x 3508
_BOXES = {
    "edge_top_left": (0, 0, 100, 100), "edge_top_right": (2380, 0, 2480, 100), "edge_bottom_left": (0, 3408, 100, 3508),
    "edge_bottom_right": (2380, 3408, 2480, 3508), "edge_top_center": (1090, 0, 1390, 100), "edge_bottom_center": (1090, 3408, 1390, 3508),
    "full_edge_top": (0, 0, 2480, 100), "full_edge_bottom": (0, 3408, 2480, 3508), "full_edge_left": (0, 0, 100, 3508), "full_edge_right": (2380, 0, 2480, 3508),
    "top_left": (0, 0, 200, 200), "top_right": (2280, 0, 2480, 200), "bottom_left": (0, 3308, 200, 3508), "bottom_right": (2280, 3308, 2480, 3508),
    "bottom_center": (1090, 3308, 1390, 3508), "top_center": (1090, 0, 1390, 200), "middle_left": (0, 1654, 200, 1854), "middle_right": (2280, 1654, 2480, 1854)}
add_view("r_boxes", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}', {', '.join(map(str, _BOXES[n]))})" for k, n in enumerate(REGIONS)) + ") v(scan_rank, region, x1, y1, x2, y2)")
add_view("f_placed", """
  SELECT b.*, trim(b.text) AS t, r.scan_rank, r.region FROM f_blocks b JOIN r_boxes r ON b.lft + 30 >= r.x1 AND b.lft + 30 < r.x2 AND b.top + 20 >= r.y1 AND b.top + 20 < r.y2""", ["f_blocks", "r_boxes"])


@q("region_assign", "f_placed", "SELECT book_id, scan_index, block_index, region, scan_rank FROM f_placed")
def region_assign(spark, sf_dir):
    return cand.region_assign(f_blocks(spark, sf_dir)).select("book_id", "scan_index", "block_index", "region", "scan_rank")


def _boxes_sql() -> str:
    """All 28 rectangles of a w x h page as plain arithmetic."""
    def side(name, across, middle):
        if "center" in name:
            return f"w // 2 - {middle // 2}", f"w // 2 + {middle // 2}"
        return ("0", str(across)) if "left" in name else (f"w - {across}", "w")

    def level(name, down, middle):
        if "middle" in name:
            return f"h // 2 - {middle // 2}", f"h // 2 + {middle // 2}"
        return ("0", str(down)) if "top" in name else (f"h - {down}", "h")

    rows = {}
    for name in REGIONS:
        if name.startswith("full_edge_"):
            rows[name] = {"top": "0, 0, w, 100", "bottom": "0, h - 100, w, h", "left": "0, 0, 100, h", "right": "w - 100, 0, w, h"}[name[10:]]
            continue
        size = 100 if name.startswith("edge_") else 200
        (x1, x2), (y1, y2) = side(name, size, 300), level(name, size, 200)
        rows[name] = f"{x1}, {y1}, {x2}, {y2}"
    for name in ("top_left", "top_right", "bottom_left", "bottom_right"):
        x, y = "CAST(floor(w * 0.15) AS INTEGER)", "CAST(floor(h * 0.15) AS INTEGER)"
        rows["corner_" + name] = (f"0, {'0' if 'top' in name else f'h - {y}'}, {x}, {y if 'top' in name else 'h'}" if "left" in name
                                  else f"w - {x}, {'0' if 'top' in name else f'h - {y}'}, w, {y if 'top' in name else 'h'}")
    for name in ("top_left", "top_right", "bottom_left", "bottom_right", "top_center", "bottom_center"):
        (x1, x2), (y1, y2) = side(name, 200, 200), level(name, 200, 200)
        rows["manual_" + name] = f"{x1}, {y1}, {x2}, {y2}"
    size = "SELECT p_partkey, 2000 + p_size * 10 AS w, 3000 + p_size * 7 AS h FROM part"
    parts = [f"SELECT p_partkey AS page, '{name}' AS region, {box} FROM ({size})" for name, box in rows.items()]
    parts[0] = f"SELECT p_partkey AS page, '{REGIONS[0]}' AS region, 0 AS x1, 0 AS y1, 100 AS x2, 100 AS y2 FROM ({size})"
    return " UNION ALL ".join(parts)


@q("region_boxes", "f_lines", _boxes_sql())
def region_boxes(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page"), (2000 + F.col("p_size") * 10).alias("w"), (3000 + F.col("p_size") * 7).alias("h"))
    w, h = F.col("w"), F.col("h")

    def named(boxes, prefix):
        return pages.select("page", F.explode(boxes).alias("b")).select(
            "page", F.concat(F.lit(prefix), F.col("b.region")).alias("region"), "b.x1", "b.y1", "b.x2", "b.y2")

    return named(g.region_boxes(w, h), "").unionByName(named(g.corner_boxes(w, h), "corner_")).unionByName(
        named(g.manual_boxes(w, h), "manual_"))


@q("rescale_boxes", "f_lines", """
SELECT p_partkey AS page, greatest(0, least(CAST(floor(least(a, b) * (2480 / 620.0)) AS INTEGER), 2479)) AS x1, greatest(0, least(CAST(floor(greatest(a, b) * (2480 / 620.0)) AS INTEGER), 2480)) AS x2
FROM (SELECT p_partkey, CAST(p_partkey % 700 AS INTEGER) AS a, p_size * 10 AS b FROM part)""")
def rescale_boxes(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 700).cast("int").alias("a"), (F.col("p_size") * 10).alias("b"))
    box = g.rescale({"x1": F.col("a"), "x2": F.col("b"), "y1": F.lit(0), "y2": F.lit(9)}, (F.lit(620), F.lit(877)), (F.lit(2480), F.lit(3508)))
    return part.select(F.col("p_partkey").alias("page"), box["x1"].alias("x1"), box["x2"].alias("x2"))


@q("resize_plan", "f_lines", """
SELECT p_partkey AS page, CASE WHEN greatest(w, h) <= 2500 THEN w WHEN w > h THEN 2500 ELSE CAST(floor(w * 2500 / h) AS INTEGER) END AS fit_width,
       CASE WHEN greatest(w, h) <= 2500 THEN h WHEN w > h THEN CAST(floor(h * 2500 / w) AS INTEGER) ELSE 2500 END AS fit_height,
       CAST(floor(w * (300 / 150.0)) AS INTEGER) AS print_width, round(w * 72.0 / 300, 6) AS point_width
FROM (SELECT p_partkey, 1000 + p_size * 50 AS w, CAST(1500 + p_partkey % 2000 AS INTEGER) AS h FROM part)""")
def resize_plan(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page"), (1000 + F.col("p_size") * 50).alias("w"), (1500 + F.col("p_partkey") % 2000).cast("int").alias("h"))
    fit = g.capped_size(F.col("w"), F.col("h"))
    return part.select("page", fit[0].alias("fit_width"), fit[1].alias("fit_height"),
                       g.size_at_300dpi(F.col("w"), F.col("h"), F.lit(150))[0].alias("print_width"),
                       F.round(g.points(F.col("w")), 6).alias("point_width"))


_TOP, _LEFT, _RIGHT = "contains(region, 'top')", "contains(region, 'left')", "contains(region, 'right')"
_OK = r"len(regexp_extract_all(t, '\S+')) <= 5 AND NOT regexp_matches(lower(t), 'page|chapter|section|figure|table|the|and|of')"
add_view("f_arabic", rf"""
  SELECT *, least(99.9, conf * 0.9 * CASE WHEN number > 200 AND region NOT IN ('top_left', 'top_right', 'top_center', 'bottom_center') THEN 0.4 ELSE 1 END
     + CASE WHEN starts_with(region, 'edge_') THEN 40 + CASE WHEN region IN ('edge_top_left', 'edge_top_right', 'edge_bottom_right') THEN 15 ELSE 0 END
            WHEN starts_with(region, 'full_edge_') THEN 30 WHEN region IN ('top_left', 'top_right') THEN 25 WHEN region IN ('top_center', 'bottom_center') THEN 15 WHEN {_TOP} THEN 10 ELSE 0 END
     + CASE WHEN {_RIGHT} THEN 5 ELSE 0 END + CASE WHEN t = candidate THEN 10 ELSE 0 END) AS confidence
  FROM (SELECT *, CAST(candidate AS INTEGER) AS number FROM (SELECT *, unnest(regexp_extract_all(t, '\b[0-9]{{1,3}}\b')) AS candidate FROM f_placed WHERE {_OK})) WHERE number BETWEEN 1 AND 999""", ["f_placed"])
from checks.text import roman_sql  # noqa: E402

add_view("f_roman_all", rf"""
  SELECT *, {roman_sql("candidate")} AS number FROM (SELECT *, unnest(list_distinct(regexp_extract_all(lower(t), '\b[ivxlcdm]{{1,10}}\b'))) AS candidate FROM f_placed WHERE {_OK})""", ["f_placed"])
add_view("f_roman", rf"""
  SELECT *, least(99.9, conf * 0.95 + CASE WHEN starts_with(region, 'edge_') THEN 45 + CASE WHEN {_TOP} THEN 10 ELSE 0 END WHEN starts_with(region, 'full_edge_') THEN 35
        WHEN region IN ('top_left', 'top_right') THEN 30 WHEN region = 'top_center' THEN 20 ELSE 0 END
     + CASE WHEN length(candidate) >= 3 THEN 15 WHEN length(candidate) = 2 THEN 10 ELSE 0 END + CASE WHEN {_TOP} THEN 10 ELSE 0 END + CASE WHEN {_LEFT} THEN 5 ELSE 0 END
     + CASE WHEN lower(t) = candidate THEN 15 ELSE 0 END) AS confidence
  FROM f_roman_all a WHERE number BETWEEN 1 AND 50 AND (length(candidate) > 1 OR candidate = 'x' OR (candidate IN ('i', 'v') AND length(t) <= 3))
    AND NOT EXISTS (SELECT 1 FROM f_roman_all b WHERE b.book_id = a.book_id AND b.scan_index = a.scan_index AND b.block_index = a.block_index AND b.region = a.region
        AND length(b.candidate) > length(a.candidate) AND contains(b.candidate, a.candidate) AND b.number BETWEEN 1 AND 50)""", ["f_roman_all"])
add_view("f_cand", f"""
  SELECT *, base + CASE WHEN gap <= 10 THEN 30 WHEN gap <= 25 THEN 20 WHEN gap <= 50 THEN 10 WHEN gap <= 100 THEN 5 ELSE 0 END AS confidence FROM (
    SELECT book_id, scan_index, block_index, scan_rank, region, candidate, number, kind, confidence AS base,
           least(CASE WHEN {_LEFT} THEN lft WHEN {_RIGHT} THEN 2480 - lft - 60 ELSE least(lft, 2420 - lft) END,
                 CASE WHEN {_TOP} THEN top WHEN contains(region, 'bottom') THEN 3508 - top - 40 ELSE least(top, 3468 - top) END) AS gap
    FROM (SELECT *, 'arabic' AS kind FROM f_arabic UNION ALL BY NAME SELECT *, 'roman' AS kind FROM f_roman))""", ["f_arabic", "f_roman"])
add_view("f_kept", """
  SELECT c.* FROM f_cand c LEFT JOIN (
    SELECT book_id, scan_index, min(scan_rank) AS stop FROM (
      SELECT book_id, scan_index, scan_rank, arg_min(confidence, block_index * 100 + CASE kind WHEN 'roman' THEN 50 - length(candidate) ELSE 0 END) AS f FROM f_cand GROUP BY ALL) WHERE f >= 95 GROUP BY ALL) s USING (book_id, scan_index)
  WHERE s.stop IS NULL OR c.scan_rank <= s.stop""", ["f_cand"])
add_view("f_best", """
  SELECT * FROM (SELECT *, confidence * CASE region WHEN 'top_right' THEN 1.0 WHEN 'bottom_center' THEN 0.95 WHEN 'top_left' THEN 0.9 WHEN 'bottom_right' THEN 0.85 WHEN 'bottom_left' THEN 0.85
      WHEN 'top_center' THEN 0.6 WHEN 'middle_right' THEN 0.4 WHEN 'middle_left' THEN 0.3 ELSE 0.5 END AS weighted FROM f_kept)
  QUALIFY row_number() OVER (PARTITION BY book_id, scan_index ORDER BY weighted DESC, scan_rank, block_index, kind, length(candidate) DESC) = 1""", ["f_kept"])

_KEYS = ["book_id", "scan_index", "block_index", "region", "candidate", "number"]


@q("score_arabic", "f_arabic", "SELECT book_id, scan_index, block_index, region, candidate, number, round(confidence, 6) AS confidence FROM f_arabic")
def score_arabic(spark, sf_dir):
    return cand.score_arabic(f_blocks(spark, sf_dir)).select(*_KEYS, F.round("confidence", 6).alias("confidence"))


@q("score_roman", "f_roman", "SELECT book_id, scan_index, block_index, region, candidate, number, round(confidence, 6) AS confidence FROM f_roman")
def score_roman(spark, sf_dir):
    return cand.score_roman(f_blocks(spark, sf_dir)).select(*_KEYS, F.round("confidence", 6).alias("confidence"))


@q("edge_boost", "f_cand", "SELECT book_id, scan_index, block_index, region, candidate, number, round(confidence, 6) AS confidence FROM f_cand")
def edge_boost(spark, sf_dir):
    return cand.candidates(f_blocks(spark, sf_dir)).select(*_KEYS, F.round("confidence", 6).alias("confidence"))


@q("early_exit", "f_kept", "SELECT book_id, scan_index, block_index, region, candidate, number FROM f_kept")
def early_exit(spark, sf_dir):
    return cand.early_exit(cand.candidates(f_blocks(spark, sf_dir))).select(*_KEYS)


@q("best_candidate", "f_best", "SELECT book_id, scan_index, candidate AS text, number, kind, region, round(weighted, 6) AS confidence FROM f_best")
def best_candidate(spark, sf_dir):
    return cand.best_candidate(cand.candidates(f_blocks(spark, sf_dir))).withColumn("confidence", F.round("confidence", 6))


@q("repair_numbers", "f_best", """
SELECT book_id, scan_index, CASE WHEN bad AND number // 10 BETWEEN 1 AND 9 THEN CAST(number // 10 AS INTEGER) ELSE number END AS number, bad AS repaired,
       round(weighted * CASE WHEN bad THEN 0.8 ELSE 1 END, 6) AS confidence
FROM (SELECT *, number > 15 AND number BETWEEN 10 AND 99 AND candidate NOT IN ('i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii','xiii','xiv','xv','xvi','xvii','xviii','xix','xx') AS bad FROM f_best)""")
def repair_numbers(spark, sf_dir):
    best = cand.best_candidate(cand.candidates(f_blocks(spark, sf_dir)))
    return cand.repair_numbers(best, F.lit(10)).select(
        "book_id", "scan_index", "number", "repaired", F.round("confidence", 6).alias("confidence"))


@q("accept_numbers", "f_best", """
SELECT book_id, scan_index, candidate AS text, CASE WHEN candidate IN ('i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii','xiii','xiv','xv') THEN 'roman' ELSE 'arabic' END AS number_type,
       number AS numeric_value, CASE WHEN scan_index + 1 BETWEEN 6 AND 16 THEN 'roman' WHEN scan_index + 1 > 16 THEN 'arabic' END AS expected FROM f_best WHERE weighted > 50""")
def accept_numbers(spark, sf_dir):
    best = cand.best_candidate(cand.candidates(f_blocks(spark, sf_dir)))
    hint = cand.expected_type(F.col("scan_index") + 1, F.lit(None).cast("string"))
    return cand.accept(best).select("book_id", "scan_index", "text", "number_type", "numeric_value", hint.alias("expected"))
