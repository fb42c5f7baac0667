"""Scan facts, history, memory, learner and dataset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import add_view, oracle
from quire.operators import candidates as cand, dataset as d, history as h, learner as l, location_fold, memory, scans as s
from quire.schemas import ARABIC_SCAN_ORDER, REGIONS, ROMAN_SCAN_ORDER

QUERIES, ORACLES = {}, {}


def q(name, view=None, sql=None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = oracle(view, sql) if view else sql
        return function
    return add


# ---- scans

def f_blank(spark, sf_dir):
    from quire.plans import ranks

    hot = fx.lines_wide(spark, sf_dir)
    rows = ranks.with_totals(fx.lines(spark, sf_dir, "l_discount"), ["book_id"], {"_n": F.count(F.lit(1))}, "i", hot)
    book, i = F.col("book_id").cast("int"), F.col("i")
    blank = (i < book % 4) | (i >= F.col("_n") - book % 3) | (F.col("l_discount") == 0)
    return rows.select("book_id", i.alias("scan_index"), blank.alias("is_blank"))


add_view("f_blank", """
  SELECT book_id, i AS scan_index, i < l_suppkey % 4 OR i >= count(*) OVER (PARTITION BY book_id) - l_suppkey % 3 OR l_discount = 0 AS is_blank FROM f_lines""", ["f_lines"])


@q("blank_removal", "f_blank", """
SELECT book_id, scan_index, is_blank AND (pre OR post) AS start_end, is_blank AND pre AS at_start, is_blank AND post AS at_end, is_blank AND NOT pre AND NOT post AS middle, is_blank AS every
FROM (SELECT *, sum(CASE WHEN is_blank THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY scan_index) = 0 AS pre,
             sum(CASE WHEN is_blank THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY scan_index DESC) = 0 AS post FROM f_blank)""")
def blank_removal(spark, sf_dir):
    rows = f_blank(spark, sf_dir)
    for mode, name in (("start_end", "start_end"), ("start", "at_start"), ("end", "at_end"), ("middle", "middle"), ("all", "every")):
        rows = s.blank_removal(rows, mode, fx.lines_wide(spark, sf_dir)).withColumnRenamed("removed", name)
    return rows.drop("is_blank")


@q("blank_rule", "f_lines", """
SELECT book_id, i AS scan_index, white > 0.95 AND edge < 0.01 AND dark <= 0.01 AS is_blank, round(CASE WHEN white > 0.95 AND edge < 0.01 AND dark <= 0.01 THEN white ELSE 1 - white END, 6) AS confidence,
       white > 0.95 AND edge < 0.01 AND dark <= 0.01 AND w > 1000 AS needs_rotation
FROM (SELECT book_id, i, 1 - l_discount AS white, l_tax / 4 AS edge, l_quantity / 1000.0 AS dark, 700 + 100 * l_linenumber AS w FROM f_lines)""")
def blank_rule(spark, sf_dir):
    scans = fx.lines(spark, sf_dir, "l_discount", "l_tax", "l_quantity", "l_linenumber").select(
        "book_id", F.col("i").alias("scan_index"), (1 - F.col("l_discount")).alias("white_share"),
        (F.col("l_tax") / 4).alias("edge_density"), (F.col("l_quantity") / 1000.0).alias("dark_share"),
        (700 + 100 * F.col("l_linenumber")).alias("width"), F.lit(1000).alias("height"))
    return s.blank_rule(scans).select("book_id", "scan_index", "is_blank", F.round("confidence", 6).alias("confidence"), "needs_rotation")


def f_images(spark, sf_dir):
    """The bytes of each document as a grey image 64 pixels wide, the rest white."""
    data = F.encode("text", "UTF-8")
    height = F.ceil(F.octet_length(data) / 64).cast("int")
    return fx.table(spark, sf_dir, "documents").where(F.octet_length(data) > 0).select(
        F.col("doc_id").cast("string").alias("origin"), height.alias("height"), F.lit(64).alias("width"),
        F.lit(1).alias("nChannels"), F.lit(0).alias("mode"),
        F.rpad(data, height * 64, F.unhex(F.lit("FF"))).alias("data"))


@q("scan_profile", "f_lines", """
SELECT CAST(doc_id AS VARCHAR) AS origin, 64 AS width, h AS height, h * 64 - n AS white_pixels
FROM (SELECT doc_id, octet_length(encode(text)) AS n, CAST(ceil(octet_length(encode(text)) / 64) AS INTEGER) AS h FROM documents) WHERE n > 0""")
def scan_profile(spark, sf_dir):
    pixels = F.round(F.col("white_share") * F.col("width") * F.col("height")).cast("long")
    return s.scan_profile(f_images(spark, sf_dir)).select("origin", "width", "height", pixels.alias("white_pixels"))


@q("scan_quality")
def scan_quality(spark, sf_dir):
    return s.quality_rule(s.blank_rule(s.scan_profile(f_images(spark, sf_dir))))


def f_crops(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("book_id"), F.col("p_partkey").cast("string").alias("page_name"),
        F.lit(2480).alias("page_width"), F.lit(3508).alias("page_height"), (2480 - F.col("p_size") * 40).alias("crop_width"),
        (3508 - F.floor("p_retailprice").cast("int") % 1500).alias("crop_height"),
        ((F.col("p_partkey") % 20) / 50.0).alias("border_share"), ((F.col("p_partkey") % 7) / 10.0).alias("edge_content"))


add_view("f_crops", """
  SELECT *, 100 - 30 * CAST(a AS INTEGER) - 10 * CAST(b AS INTEGER) - 15 * CAST(c AS INTEGER) - 25 * CAST(e AS INTEGER) - 20 * CAST(f AS INTEGER) AS score FROM (
    SELECT *, ratio < 0.6 AS a, ratio > 0.95 AS b, abs(wr - hr) > 0.3 AS c, border > 0.15 AS e, edge > 0.3 AS f FROM (
      SELECT p_brand AS book_id, CAST(p_partkey AS VARCHAR) AS page_name, cw, ch, (cw * ch) / (2480 * 3508) AS ratio, (2480 - cw) / 2480 AS wr, (3508 - ch) / 3508 AS hr,
             (p_partkey % 20) / 50.0::DOUBLE AS border, (p_partkey % 7) / 10.0::DOUBLE AS edge
      FROM (SELECT *, 2480 - p_size * 40 AS cw, 3508 - CAST(floor(p_retailprice) AS INTEGER) % 1500 AS ch FROM part)))""")


@q("crop_validation", "f_crops", """
SELECT book_id, page_name, round(ratio, 6) AS crop_ratio, CAST(score AS DOUBLE) AS confidence, score >= 70 AS is_valid, a OR c OR e OR f OR score < 70 AS needs_review,
       CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) + CAST(e AS INTEGER) + CAST(f AS INTEGER) AS issues FROM f_crops""")
def crop_validation(spark, sf_dir):
    return s.crop_validation(f_crops(spark, sf_dir)).select(
        "book_id", "page_name", F.round("crop_ratio", 6).alias("crop_ratio"), "confidence", "is_valid", "needs_review", F.size("issues").alias("issues"))


@q("crop_summary", "f_crops", """
SELECT book_id, count(*) AS review_pages, round(avg(score), 6) AS mean_confidence, count(*) FILTER (a) AS excessive_cropping, count(*) FILTER (b) AS minimal_cropping,
       count(*) FILTER (c) AS asymmetric_cropping, count(*) FILTER (e) AS black_borders, count(*) FILTER (f) AS content_cutoff
FROM f_crops WHERE a OR c OR e OR f OR score < 70 GROUP BY book_id""")
def crop_summary(spark, sf_dir):
    return s.crop_summary(s.crop_validation(f_crops(spark, sf_dir))).withColumn("mean_confidence", F.round("mean_confidence", 6))


@q("crop_review", "f_crops", """
SELECT book_id, page_name, concat_ws(' | ', page_name, printf('%.1f%%', CAST(score AS DOUBLE)), concat_ws('; ', CASE WHEN a THEN 'cut_heavy' END,
   CASE WHEN b THEN 'cut_little' END, CASE WHEN c THEN 'cut_uneven' END,
   CASE WHEN e THEN 'border_dark' END, CASE WHEN f THEN 'content_at_edge' END)) AS line
FROM f_crops WHERE a OR c OR e OR f OR score < 70""")
def crop_review(spark, sf_dir):
    return s.crop_review(s.crop_validation(f_crops(spark, sf_dir)))


@q("apply_overrides", "f_crops", """
SELECT page_name, CAST(coalesce(o.w, cw) AS INTEGER) AS crop_width, o.w IS NOT NULL AS is_manual FROM f_crops LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS page_name, 1000 + max(o_orderkey) % 500 AS w FROM orders GROUP BY 1) o USING (page_name)""")
def apply_overrides(spark, sf_dir):
    manual = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("page_name")).agg(
        (1000 + F.max("o_orderkey") % 500).cast("int").alias("manual_width"), F.lit(3000).alias("manual_height"))
    return s.apply_overrides(f_crops(spark, sf_dir), manual).select("page_name", "crop_width", "is_manual")


# ---- sessions

def f_sessions(spark, sf_dir):
    key = F.col("event_id")
    flags = {name: (F.shiftright(key, k) % 2 == 1) for k, name in enumerate(h.FEATURES)}
    return fx.table(spark, sf_dir, "events").select(
        key.alias("session_id"), "ts", "user_id", (1 + key % 600).cast("int").alias("pages"), F.col("value").alias("seconds"),
        (F.col("event_type") != "error").alias("success"), *[c.alias(n) for n, c in flags.items()])


add_view("f_sessions", "SELECT event_id AS session_id, ts, user_id, CAST(1 + event_id % 600 AS INTEGER) AS pages, value AS seconds, event_type <> 'error' AS success, event_id AS k, CASE WHEN event_id % 600 < 49 THEN 'small' WHEN event_id % 600 < 199 THEN 'medium' WHEN event_id % 600 < 499 THEN 'large' ELSE 'very_large' END AS category FROM events")


@q("session_metrics", "f_sessions", """
SELECT count(*) AS sessions, count(*) FILTER (success) AS documents, CAST(sum(pages) FILTER (success) AS BIGINT) AS pages, round(sum(seconds) FILTER (success), 4) AS seconds,
       round(sum(seconds) FILTER (success) / sum(pages) FILTER (success), 6) AS seconds_per_page FROM f_sessions""")
def session_metrics(spark, sf_dir):
    return h.session_metrics(f_sessions(spark, sf_dir)).withColumns({
        "seconds": F.round("seconds", 4), "seconds_per_page": F.round("seconds_per_page", 6)})


@q("feature_usage", "f_sessions", """
SELECT feature, CAST(uses AS BIGINT) AS uses, round(uses / sum(uses) OVER (), 6) AS share, CASE WHEN feature = 'preprocessing' AND uses / sum(uses) OVER () > 0.5 THEN 'recommend preprocessing'
   WHEN feature = 'preprocessing' AND uses / sum(uses) OVER () < 0.2 THEN 'most users disable preprocessing' WHEN feature = 'compression' AND uses / sum(uses) OVER () > 0.6 THEN 'recommend compression' END AS advice
FROM (SELECT ['preprocessing', 'auto_rotate', 'auto_crop', 'clean_circles', 'blank_removal', 'compression'][b + 1] AS feature, sum((k >> b) % 2) AS uses FROM f_sessions, range(6) r(b) GROUP BY 1)""")
def feature_usage(spark, sf_dir):
    return h.feature_usage(f_sessions(spark, sf_dir)).withColumn("share", F.round("share", 6))


@q("size_categories", "f_sessions", "SELECT category, count(*) AS documents, round(avg(seconds), 6) AS mean_seconds FROM f_sessions WHERE success GROUP BY 1")
def size_categories(spark, sf_dir):
    return h.size_categories(f_sessions(spark, sf_dir)).withColumn("mean_seconds", F.round("mean_seconds", 6))


@q("recommended_settings", "f_sessions", "SELECT session_id, category, pages > 100 AS compression, pages > 200 AS fast_mode, CASE WHEN pages > 400 THEN 'Large document: enable fast mode' END AS hint FROM f_sessions")
def recommended_settings(spark, sf_dir):
    return h.recommended_settings(f_sessions(spark, sf_dir)).select("session_id", "category", "compression", "fast_mode", "hint")


@q("recent_sessions", "f_sessions", "SELECT user_id, session_id FROM f_sessions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, session_id DESC) <= 100")
def recent_sessions(spark, sf_dir):
    return h.recent_sessions(f_sessions(spark, sf_dir)).select("user_id", "session_id")


@q("running_time", "f_sessions", "SELECT session_id, category, row_number() OVER w AS nth, CAST(sum(CAST(seconds AS DECIMAL(18, 2))) OVER w AS DOUBLE) AS total_seconds FROM f_sessions WHERE success WINDOW w AS (PARTITION BY category ORDER BY ts, session_id ROWS UNBOUNDED PRECEDING)")
def running_time(spark, sf_dir):
    # mean * nth is the exact total, which compares without rounding ties
    return h.running_time(f_sessions(spark, sf_dir)).select(
        "session_id", "category", "nth", F.round(F.col("mean_seconds") * F.col("nth"), 2).alias("total_seconds"))


@q("time_estimate", "f_sessions", """
SELECT session_id, round(pages * (SELECT sum(seconds) FILTER (success) / sum(pages) FILTER (success) FROM f_sessions) * CASE WHEN k % 2 = 1 THEN 1.4 ELSE 1 END
   * CASE WHEN (k >> 2) % 2 = 1 THEN 1.1 ELSE 1 END * CASE WHEN (k >> 3) % 2 = 1 THEN 1.2 ELSE 1 END / 60, 6) AS minutes FROM f_sessions""")
def time_estimate(spark, sf_dir):
    sessions = f_sessions(spark, sf_dir)
    return h.time_estimate(sessions, sessions).select("session_id", F.round("minutes", 6).alias("minutes"))


@q("session_windows", "f_sessions", """
SELECT date_trunc('day', ts) AS window_start, count(*) AS sessions, count(*) FILTER (success) AS documents, CAST(sum(pages) FILTER (success) AS BIGINT) AS pages, round(sum(seconds) FILTER (success), 4) AS seconds FROM f_sessions GROUP BY 1""")
def session_windows(spark, sf_dir):
    return h.session_windows(f_sessions(spark, sf_dir)).drop("window_end").withColumn("seconds", F.round("seconds", 4))


@q("sliding_windows", "f_sessions", """
SELECT date_trunc('hour', ts) - to_hours(o) - to_hours(CAST(date_part('hour', ts) AS INTEGER) % 6) AS window_start, count(*) AS sessions, count(*) FILTER (success) AS documents FROM f_sessions, (SELECT unnest([0, 6, 12, 18]) AS o) GROUP BY 1""")
def sliding_windows(spark, sf_dir):
    return h.session_windows(f_sessions(spark, sf_dir), "24 hours", "6 hours").select("window_start", "sessions", "documents")


# ---- stored results

def f_keyed(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("content_key"), F.length("text").alias("size"))


def f_cache(spark, sf_dir):
    return f_keyed(spark, sf_dir).join(fx.table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").withColumn(
        "created", F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(days=(F.col("doc_id") % 60).cast("int")))


@q("incremental_new_pages", "f_lines", "SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))")
def incremental_new_pages(spark, sf_dir):
    return h.new_pages(f_keyed(spark, sf_dir), f_cache(spark, sf_dir)).select("doc_id")


@q("reuse_stats", "f_lines", """
SELECT hits, n - hits AS misses, round(100.0 * hits / n, 6) AS hit_rate, items, stored_size FROM (SELECT count(*) AS n, count(*) FILTER (md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))) AS hits FROM documents),
  (SELECT count(DISTINCT md5(text)) AS items, CAST(sum(length(text)) AS BIGINT) AS stored_size FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))""")
def reuse_stats(spark, sf_dir):
    return h.reuse_stats(f_keyed(spark, sf_dir).drop("size"), f_cache(spark, sf_dir)).withColumn("hit_rate", F.round("hit_rate", 6))


@q("expire_processed", "f_lines", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id % 60 >= 15")
def expire_processed(spark, sf_dir):
    return h.expire(f_cache(spark, sf_dir), F.to_timestamp(F.lit("2024-02-15"))).select("doc_id")


@q("duplicate_pages", "f_text", """
SELECT book_id, CAST(i AS INTEGER) AS scan_index, CAST(f AS INTEGER) AS first_page FROM (SELECT source AS book_id, i, first_value(i) OVER (PARTITION BY source, text ORDER BY i) AS f
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)) WHERE i > f""")
def duplicate_pages(spark, sf_dir):
    from checks.content import plain

    return h.duplicate_pages(plain(spark, sf_dir), fx.documents_wide(spark, sf_dir))


# ---- corrections and preferences

def f_corrections(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    name = (F.when(cust % 3 == 0, F.format_string("Page_%03d.jpg", cust)).when(cust % 3 == 1, F.format_string("scan%d.tif", cust))
            .otherwise(F.format_string("v%d.png", cust % 90)))
    original = (key % 300 + 1).cast("int")
    return h.record_corrections(fx.table(spark, sf_dir, "orders").select(
        key.alias("seq"), name.alias("page_name"), original.alias("original_position"),
        (original + key % 13 - 6).cast("int").alias("corrected_position"), F.col("o_orderdate").alias("corrected_at")))


add_view("f_corrections", """
  SELECT *, CASE WHEN position_change = 0 THEN 'no_change' WHEN abs(position_change) = 1 THEN 'minor_adjustment' WHEN abs(position_change) <= 5 THEN 'moderate_adjustment' ELSE 'major_adjustment' END AS correction_type
  FROM (SELECT o_orderkey AS seq, CASE o_custkey % 3 WHEN 0 THEN 'page_' || lpad(CAST(o_custkey AS VARCHAR), greatest(3, CAST(length(CAST(o_custkey AS VARCHAR)) AS INTEGER)), '0') WHEN 1 THEN 'scan' || o_custkey ELSE 'v' || (o_custkey % 90) END AS stem,
      o_orderkey % 300 + 1 AS original_position, CAST(o_orderkey % 13 - 6 AS INTEGER) AS position_change, o_orderdate AS corrected FROM orders)""")


@q("correction_stats", "f_corrections", "SELECT correction_type, count(*) AS corrections, min(corrected) AS first_at, max(corrected) AS last_at, CAST(date_diff('day', min(corrected), max(corrected)) AS INTEGER) AS age_days FROM f_corrections GROUP BY 1")
def correction_stats(spark, sf_dir):
    return h.correction_stats(f_corrections(spark, sf_dir))


@q("common_changes", "f_corrections", "SELECT position_change, count(*) AS corrections FROM f_corrections GROUP BY 1 ORDER BY 2 DESC, min(seq) LIMIT 5")
def common_changes(spark, sf_dir):
    return h.common_changes(f_corrections(spark, sf_dir))


@q("suggest_positions", "f_corrections", """
SELECT page_id, CAST(sum(n) AS BIGINT) AS similar, CAST(any_value(position) + arg_min(position_change, -n * 100000000 + seen) AS INTEGER) AS suggested FROM (
  SELECT p.page_id, p.position, c.position_change, count(*) AS n, min(c.seq) AS seen
  FROM (SELECT p_partkey AS page_id, p_size AS position, CASE p_partkey % 3 WHEN 0 THEN 'page_' || lpad(CAST(p_partkey AS VARCHAR), greatest(3, CAST(length(CAST(p_partkey AS VARCHAR)) AS INTEGER)), '0') WHEN 1 THEN 'scan' || p_partkey ELSE 'v' || (p_partkey % 90) END AS stem FROM part) p
  JOIN f_corrections c ON starts_with(p.stem, c.stem[1:5]) OR starts_with(c.stem, p.stem[1:5]) OR abs(CAST(regexp_extract(p.stem, '[0-9]+') AS INTEGER) - CAST(regexp_extract(c.stem, '[0-9]+') AS INTEGER)) <= 3 OR abs(c.original_position - p.position) <= 2
  GROUP BY ALL) GROUP BY page_id HAVING sum(n) >= 3""")
def suggest_positions(spark, sf_dir):
    key = F.col("p_partkey")
    name = (F.when(key % 3 == 0, F.format_string("Page_%03d.jpg", key)).when(key % 3 == 1, F.format_string("scan%d.tif", key))
            .otherwise(F.format_string("v%d.png", key % 90)))
    pages = fx.table(spark, sf_dir, "part").select(key.alias("page_id"), name.alias("page_name"), F.col("p_size").alias("position"))
    return h.suggest_positions(pages, f_corrections(spark, sf_dir)).select("page_id", "similar", "suggested")


@q("pattern_preferences", "f_lines", """
SELECT * FROM (SELECT o_orderpriority AS pattern_type, o_orderstatus AS scheme, count(*) AS uses, count(*) FILTER (o_totalprice / 500000 > 0.7) AS successes, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_used,
   round(count(*) FILTER (o_totalprice / 500000 > 0.7) / count(*), 6) AS success_rate FROM orders GROUP BY 1, 2 ORDER BY count(*) FILTER (o_totalprice / 500000 > 0.7) / count(*) DESC, uses DESC, 1, 2 LIMIT 5) WHERE uses >= 3""")
def pattern_preferences(spark, sf_dir):
    return h.pattern_preferences(fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("pattern_type"), F.col("o_orderstatus").alias("scheme"),
        (F.col("o_totalprice") / 500000).alias("rate"), F.col("o_orderdate").alias("seen_at"))).withColumn(
        "success_rate", F.round("success_rate", 6))


@q("preprocessing_effectiveness", "f_lines", """
SELECT options, round(m, 6) AS mean_improvement, n AS uses, m = max(m) OVER () AS best FROM (
  SELECT CASE o_orderstatus WHEN 'F' THEN 'denoise' WHEN 'O' THEN 'denoise_deskew' ELSE 'deskew' END || CASE WHEN o_orderpriority = '1-URGENT' THEN '_contrast' ELSE '' END AS options, avg(o_totalprice / 500000) AS m, count(*) AS n FROM orders GROUP BY 1)""")
def preprocessing_effectiveness(spark, sf_dir):
    status = F.col("o_orderstatus")
    options = F.create_map(F.lit("denoise"), status.isin("F", "O"), F.lit("deskew"), status.isin("O", "P"),
                           F.lit("contrast"), F.col("o_orderpriority") == "1-URGENT")
    return h.preprocessing_effectiveness(fx.table(spark, sf_dir, "orders").select(
        options.alias("options"), (F.col("o_totalprice") / 500000).alias("improvement"))).withColumn(
        "mean_improvement", F.round("mean_improvement", 6))


def f_preferences(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderdate").alias("updated"),
        F.col("o_orderkey").alias("seq"), "o_orderstatus")


@q("latest_preferences", "f_lines", "SELECT o_custkey AS key, o_orderpriority AS value, o_orderdate AS updated FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_preferences(spark, sf_dir):
    return h.latest_preferences(f_preferences(spark, sf_dir))


@q("memory_merge", "f_lines", "SELECT o_custkey AS key, o_orderpriority AS value FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus <> 'F') DESC, o_orderdate DESC, o_orderkey DESC) = 1")
def memory_merge(spark, sf_dir):
    both = f_preferences(spark, sf_dir)
    kept = both.drop("o_orderstatus")
    return h.memory_merge(both.where("o_orderstatus = 'F'").select(*kept.columns), both.where("o_orderstatus <> 'F'").select(*kept.columns))


# One import a year: 1996 replaces, 1998 clears preferences, 1999 is written a second time in part.
def f_memory_log(spark, sf_dir):
    status, year = F.col("o_orderstatus"), F.year("o_orderdate")
    rows = fx.table(spark, sf_dir, "orders").select(
        year.cast("long").alias("batch"), F.col("o_orderkey").alias("row"), F.when(year == 1996, "replace").otherwise("merge").alias("mode"),
        F.when(status == "F", "corrections").when(status == "O", "patterns").otherwise("preferences").alias("section"),
        F.when(status == "O", F.col("o_orderpriority")).alias("name"), (F.col("o_custkey") % 1000).cast("string").alias("key"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("value")).where("batch <> 1998")
    log = rows.unionByName(rows.where("batch = 1999 AND row % 3 = 0"))
    for mark in (memory.mark(spark, 1996, "replace"), memory.mark(spark, 1998, "clear", "preferences"), memory.mark(spark, 1999)):
        log = log.unionByName(mark)
    return log


add_view("f_memory_log", """
  SELECT year(o_orderdate) AS batch, o_orderkey AS row, CASE o_orderstatus WHEN 'F' THEN 'corrections' WHEN 'O' THEN 'patterns' ELSE 'preferences' END AS section,
         CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS name, CAST(o_custkey % 1000 AS VARCHAR) AS key, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS value
  FROM orders WHERE year(o_orderdate) >= 1996 AND year(o_orderdate) <> 1998 AND (o_orderstatus <> 'P' OR year(o_orderdate) > 1998)""")


@q("memory_state", "f_memory_log", "SELECT section, name, key, value FROM f_memory_log WHERE section <> 'corrections' QUALIFY row_number() OVER (PARTITION BY section, name, key ORDER BY batch DESC, row DESC) = 1")
def memory_state(spark, sf_dir):
    return memory.remembered(f_memory_log(spark, sf_dir))


@q("memory_corrections", "f_memory_log", "SELECT CAST(batch AS BIGINT) AS batch, row, name, key, value FROM f_memory_log WHERE section = 'corrections'")
def memory_corrections(spark, sf_dir):
    return memory.corrections(f_memory_log(spark, sf_dir))


@q("correction_examples", "f_corrections", """
SELECT a.correction_type, a.corrections, e.place, e.seq, e.position_change, e.corrected_at
FROM (SELECT correction_type, count(*) AS corrections FROM f_corrections GROUP BY 1) a
JOIN (SELECT correction_type, seq, position_change, corrected AS corrected_at, row_number() OVER (PARTITION BY correction_type ORDER BY corrected DESC, seq DESC) AS place FROM f_corrections) e
  ON e.correction_type = a.correction_type AND e.place <= 50""")
def correction_examples(spark, sf_dir):
    found = memory.correction_patterns(f_corrections(spark, sf_dir).withColumn("confidence", F.lit(None).cast("double")))
    return found.select("correction_type", "corrections", F.posexplode("examples").alias("_at", "_e")).select(
        "correction_type", "corrections", (F.col("_at") + 1).cast("long").alias("place"), "_e.seq", "_e.position_change", "_e.corrected_at")


# ---- learner

def f_hits(spark, sf_dir):
    names = F.array(*[F.lit(r) for r in REGIONS])
    key = F.col("event_id")
    # event ids grow with time, so they order a book's detections
    return fx.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("book_id"), key.alias("seq"),
        F.get(names, (key % 18).cast("int")).alias("location"), (F.col("event_type") != "error").alias("hit"),
        F.when(F.col("value") < 50, "roman").otherwise("arabic").alias("number_type"), (key % 500).cast("int").alias("page_num"))


_NAMES = "[" + ", ".join(f"'{r}'" for r in REGIONS) + "]"
add_view("f_hits", f"SELECT CAST(user_id AS VARCHAR) AS book_id, event_id AS seq, {_NAMES}[event_id % 18 + 1] AS location, CAST(event_id % 18 AS INTEGER) AS base, event_type <> 'error' AS hit, CASE WHEN value < 50 THEN 'roman' ELSE 'arabic' END AS number_type, CAST(event_id % 500 AS INTEGER) AS page_num FROM events")
add_view("f_rates", "SELECT book_id, location, base, count(*) AS attempts, count(*) FILTER (hit) AS successes, arg_max(page_num, seq) FILTER (hit) AS last_page, count(*) FILTER (hit) / count(*) AS rate FROM f_hits GROUP BY ALL", ["f_hits"])
add_view("f_dominant", """
  SELECT b.book_id, CASE WHEN rate > 0.6 THEN location END AS dominant_location, coalesce(r, 0) AS r, coalesce(a, 0) AS a, CASE WHEN coalesce(r, 0) >= coalesce(a, 0) AND r > 2 THEN 'roman' WHEN a > 2 THEN 'arabic' END AS dominant_type
  FROM (SELECT * FROM f_rates QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY rate DESC, successes DESC, base) = 1) b
  LEFT JOIN (SELECT book_id, count(*) FILTER (number_type = 'roman') AS r, count(*) FILTER (number_type = 'arabic') AS a FROM f_hits WHERE hit GROUP BY 1) k USING (book_id)""", ["f_rates"])


@q("location_rates", "f_rates", "SELECT book_id, location, attempts, successes, last_page, round(rate, 6) AS rate FROM f_rates")
def location_rates(spark, sf_dir):
    return l.location_rates(f_hits(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@q("dominant_location", "f_dominant", "SELECT book_id, dominant_location, dominant_type FROM f_dominant")
def dominant_location(spark, sf_dir):
    return l.dominant(f_hits(spark, sf_dir)).select("book_id", "dominant_location", "dominant_type")


@q("learner_stats", "f_dominant", """
SELECT book_id, count(DISTINCT page_num) AS pages, count(*) AS scans, count(*) FILTER (hit) AS hits, any_value(dominant_location) AS dominant_location, any_value(dominant_type) AS dominant_type,
       round((1 - count(*) / (count(DISTINCT page_num) * 4)) * 100, 6) AS efficiency FROM f_hits JOIN f_dominant USING (book_id) GROUP BY book_id""")
def learner_stats(spark, sf_dir):
    return l.learner_stats(f_hits(spark, sf_dir)).withColumn("efficiency", F.round("efficiency", 6))


@q("learning_progress", "f_hits", "SELECT book_id, number_type, seq AS learned_at FROM f_hits WHERE hit QUALIFY row_number() OVER (PARTITION BY book_id, number_type ORDER BY seq) = 10")
def learning_progress(spark, sf_dir):
    return l.learning_progress(f_hits(spark, sf_dir))


def _order_sql(order):
    return "CASE g.location " + " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(order)) + " END"


@q("scan_order", "f_dominant", f"""
SELECT book_id, expected, row_number() OVER (PARTITION BY book_id, expected ORDER BY pos, rate IS NULL, rate DESC, base) AS scan_rank, location FROM (
  SELECT g.*, r.rate, CASE WHEN expected = 'roman' AND g.r < 10 THEN {_order_sql(ROMAN_SCAN_ORDER)} WHEN expected = 'arabic' AND g.a < 10 THEN {_order_sql(ARABIC_SCAN_ORDER)} WHEN g.r < 10 AND g.a < 10 THEN g.base ELSE 0 END AS pos
  FROM (SELECT book_id, r, a, unnest(['roman', 'arabic', 'any']) AS expected, {_NAMES}[b + 1] AS location, b AS base FROM f_dominant, range(18) x(b)) g LEFT JOIN f_rates r ON r.book_id = g.book_id AND r.location = g.location) WHERE pos IS NOT NULL""")
def scan_order(spark, sf_dir):
    return l.scan_order(f_hits(spark, sf_dir))


@q("skippable_locations", "f_dominant", """
SELECT r.book_id, r.location, attempts, successes, pages >= 5 AND ((attempts >= 5 AND successes = 0) OR (attempts >= 3 AND rate < 0.05)) AS skip,
       pages >= 3 AND coalesce(r.location = d.dominant_location, false) AND rate > 0.75 AS stop_after, attempts - successes >= 5 AS rescan
FROM f_rates r JOIN f_dominant d USING (book_id) JOIN (SELECT book_id, count(DISTINCT page_num) AS pages FROM f_hits GROUP BY 1) p USING (book_id)""")
def skippable_locations(spark, sf_dir):
    return l.skippable_locations(f_hits(spark, sf_dir))


# One row of each book per step, in step with all other books.
@q("location_learner", "f_hits", """
, steps AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY seq) AS n, base + 1 AS own, hit, number_type FROM f_hits),
fold AS (
  SELECT book_id, CAST(0 AS BIGINT) AS n, [CAST(0 AS BIGINT) FOR x IN range(18)] AS done, [CAST(0 AS BIGINT) FOR x IN range(18)] AS tried,
         [false FOR x IN range(18)] AS boost, [CAST(0 AS BIGINT) FOR x IN range(18)] AS since, CAST(0 AS BIGINT) AS moves,
         CAST(0 AS BIGINT) AS pr, CAST(0 AS BIGINT) AS pa, false AS lr, false AS la, CAST(0 AS BIGINT) AS hr, CAST(0 AS BIGINT) AS ha, CAST(NULL AS BIGINT) AS place
  FROM steps GROUP BY book_id
  UNION ALL
  SELECT book_id, n, done, tried, boost, since, moves,
         CASE WHEN moved AND roman AND lr THEN greatest(5, pr - 5) ELSE pr END, CASE WHEN moved AND arabic AND la THEN greatest(5, pa - 5) ELSE pa END,
         lr AND NOT (moved AND roman), la AND NOT (moved AND arabic), hr, ha,
         CASE WHEN top.s > 0.6 THEN -top.i ELSE place END
  FROM (
    SELECT *, list_max([{'s': done[i] / greatest(tried[i], 1) * CASE WHEN boost[i] THEN CAST(1.2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END * pow(CAST(0.7 AS DOUBLE), moves - since[i]), 'd': done[i], 'i': -i} FOR i IN range(1, 19)]) AS top
    FROM (
      SELECT book_id, n, done, tried, moved, roman, arabic, place, moves + CAST(moved AS BIGINT) AS moves,
             [CASE WHEN i = own THEN moved ELSE boost[i] END FOR i IN range(1, 19)] AS boost,
             [CASE WHEN i = own THEN moves + CAST(moved AS BIGINT) ELSE since[i] END FOR i IN range(1, 19)] AS since,
             pr + CAST(roman AS BIGINT) AS pr, pa + CAST(arabic AS BIGINT) AS pa, hr + CAST(roman AS BIGINT) AS hr, ha + CAST(arabic AS BIGINT) AS ha,
             lr OR (roman AND pr = 9) AS lr, la OR (arabic AND pa = 9) AS la
      FROM (
        SELECT *, hit AND place IS NOT NULL AND place <> own AND done[own] >= 3 AS moved, hit AND number_type = 'roman' AS roman, hit AND number_type = 'arabic' AS arabic
        FROM (
          SELECT f.book_id, s.n, own, hit, number_type, boost, since, moves, pr, pa, lr, la, hr, ha, place,
                 [done[i] + CAST(i = own AND hit AS BIGINT) FOR i IN range(1, 19)] AS done, [tried[i] + CAST(i = own AS BIGINT) FOR i IN range(1, 19)] AS tried
          FROM fold f JOIN steps s ON s.book_id = f.book_id AND s.n = f.n + 1)))))
SELECT book_id, n AS events, pr AS roman_detections, pa AS arabic_detections, lr AS roman_learned, la AS arabic_learned, """ + _NAMES + """[place] AS dominant_location,
       CASE WHEN hr >= ha AND hr > 2 THEN 'roman' WHEN ha > 2 AND ha > hr THEN 'arabic' END AS dominant_type, moves AS shifts
FROM fold QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY n DESC) = 1""")
def location_learner(spark, sf_dir):
    return location_fold.location_learner(f_hits(spark, sf_dir))


# ---- training data

def f_labels(spark, sf_dir):
    from quire.functions.numerals import roman_text

    key = F.col("p_partkey")
    label = (F.when(key % 5 == 0, roman_text((key % 40 + 1).cast("int"))).when(key % 5 == 1, F.concat(F.lit("A-"), (key % 60).cast("string")))
             .when(key % 17 == 0, "blank").when(key % 19 == 0, "").otherwise((key % 25).cast("string")))
    return fx.table(spark, sf_dir, "part").select(key.alias("sample_id"), label.alias("label"))


add_view("f_labels", """
  SELECT p_partkey AS sample_id, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN n = 40 THEN 'xl' ELSE repeat('x', n // 10) || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] END
     WHEN p_partkey % 5 = 1 THEN 'A-' || (p_partkey % 60) WHEN p_partkey % 17 = 0 THEN 'blank' WHEN p_partkey % 19 = 0 THEN '' ELSE CAST(p_partkey % 25 AS VARCHAR) END AS label FROM (SELECT *, p_partkey % 40 + 1 AS n FROM part)""")
add_view("f_chars", """
  SELECT sample_id, label, CAST(k - 1 AS INTEGER) AS char_no, CASE WHEN c = 'blank' THEN 'blank' WHEN regexp_full_match(c, '[0-9]') THEN 'digit_' || c WHEN c = '-' THEN 'separator_dash' ELSE 'letter_' || lower(c) END AS char_class
  FROM (SELECT sample_id, label, unnest(cs) AS c, generate_subscripts(cs, 1) AS k FROM (SELECT *, CASE WHEN label = 'blank' THEN ['blank'] WHEN label = '' THEN [] ELSE string_split(label, '') END AS cs FROM f_labels))""", ["f_labels"])


@q("label_tokens", "f_chars", "SELECT * FROM f_chars")
def label_tokens(spark, sf_dir):
    return d.label_tokens(f_labels(spark, sf_dir))


@q("char_class_counts", "f_chars", "SELECT char_class AS class_label, count(*) AS samples FROM f_chars GROUP BY 1")
def char_class_counts(spark, sf_dir):
    return d.class_counts(d.label_tokens(f_labels(spark, sf_dir)), "char_class")


@q("class_distribution", "f_labels", "SELECT label AS class_label, count(*) AS samples FROM f_labels GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def class_distribution(spark, sf_dir):
    return d.class_distribution(f_labels(spark, sf_dir).withColumnRenamed("label", "class_label"))


@q("label_statistics", "f_labels", "SELECT count(*) AS processed, count(*) FILTER (label <> '') AS labelled, count(*) FILTER (label = '') AS skipped, count(DISTINCT nullif(label, '')) AS unique_labels FROM f_labels")
def label_statistics(spark, sf_dir):
    return d.label_statistics(f_labels(spark, sf_dir))


@q("dataset_issues", None, """
WITH k AS (SELECT p_brand || ' size ' || p_size AS label, count(*) AS n FROM part GROUP BY 1)
SELECT 'Class ''' || label || ''' has only ' || n || ' samples (need 10+)' AS issue FROM k WHERE n < 10
UNION ALL SELECT 'Class imbalance: max=' || max(n) || ', min=' || min(n) FROM k HAVING max(n) > 10 * min(n)
UNION ALL SELECT 'Only ' || sum(n) || ' images (recommend 1000+)' FROM k HAVING sum(n) < 500""")
def dataset_issues(spark, sf_dir):
    label = F.concat("p_brand", F.lit(" size "), F.col("p_size").cast("string"))
    return d.dataset_issues(fx.table(spark, sf_dir, "part").select(label.alias("class_label")))


@q("class_weights", "f_lines", "SELECT CAST(label AS VARCHAR) AS class_label, count(*) AS samples, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM embeddings GROUP BY label")
def class_weights(spark, sf_dir):
    return d.class_weights(fx.table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("class_label"))).withColumn(
        "weight", F.round("weight", 6))


@q("training_samples", "f_lines", """
SELECT page_id, corner, CASE WHEN best THEN label ELSE 'none' END AS class_label, CASE WHEN best THEN conf ELSE 0 END AS confidence FROM (
  SELECT *, label IS NOT NULL AND row_number() OVER (PARTITION BY page_id ORDER BY label IS NULL, conf DESC, corner) = 1 AS best FROM (
    SELECT o_orderkey AS page_id, ['top_left', 'top_right', 'bottom_left', 'bottom_right'][c + 1] AS corner, CASE WHEN (o_orderkey + c) % 3 = 0 THEN CAST(o_custkey AS VARCHAR) END AS label, (o_orderkey * (c + 3)) % 100 / 100.0::DOUBLE AS conf FROM orders, range(4) r(c)))""")
def training_samples(spark, sf_dir):
    key = F.col("o_orderkey")
    corners = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.lit(n).alias("corner")) for k, n in enumerate(d.CORNERS)])).alias("_c")
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", corners)
    return d.training_samples(rows.select(
        key.alias("page_id"), "_c.corner", F.when((key + F.col("_c.c")) % 3 == 0, F.col("o_custkey").cast("string")).alias("label"),
        ((key * (F.col("_c.c") + 3)) % 100 / 100.0).alias("confidence")))


@q("prediction_gate", "f_lines", """
SELECT vec_id AS page_id, CASE WHEN arg_max(lab, CASE WHEN lab IS NOT NULL THEN share ELSE -1 END) IS NOT NULL AND max(CASE WHEN lab IS NOT NULL THEN share END) > 0.5 THEN arg_max(lab, CASE WHEN lab IS NOT NULL THEN share ELSE -1 END) END AS label FROM (
  SELECT vec_id, c, share, CASE WHEN list_position(p, share) <> 4 AND share >= 0.5 THEN ['digit_1', 'digit_2', 'letter_i', 'none'][list_position(p, share)] END AS lab
  FROM (SELECT vec_id, c, p, list_max(p) AS share FROM (SELECT vec_id, c, list_transform(embedding[c * 4 + 1:c * 4 + 4], lambda x: abs(x::DOUBLE) / list_sum(list_transform(embedding[c * 4 + 1:c * 4 + 4], lambda y: abs(y::DOUBLE)))) AS p FROM embeddings, range(4) r(c)))) GROUP BY vec_id""")
def prediction_gate(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("corner"))
    four = F.transform(F.slice("embedding", F.col("corner") * 4 + 1, 4), lambda x: F.abs(x.cast("double")))
    rows = rows.withColumn("_f", four).withColumn("_t", F.aggregate("_f", F.lit(0.0), lambda a, x: a + x))
    rows = rows.withColumn("probabilities", F.transform("_f", lambda x: x / F.col("_t")))
    gated = cand.prediction_gate(rows, ["digit_1", "digit_2", "letter_i", "none"])
    return cand.best_corner(gated.withColumnRenamed("vec_id", "page_id"), ["page_id"]).select("page_id", "label")


@q("stratified_split")
def stratified_split(spark, sf_dir):
    return d.stratified_split(fx.table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label",
                              wide=fx.wide(spark, sf_dir, "embeddings", "label"))


@q("corner_classifier")
def corner_classifier(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("features"))
    rows = d.stratified_split(rows, "vec_id", "label", wide=fx.wide(spark, sf_dir, "embeddings", "label"))
    train, test = rows.where("part = 'train'").drop("part"), rows.where("part = 'test'").drop("part")
    model = d.train_classifier(train)
    scored = d.predict(model, test)
    return scored.select("vec_id", "label", d.predicted_label(list(model.stages[0].labels)).alias("predicted"))
