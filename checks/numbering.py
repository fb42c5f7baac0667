"""Numbering report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import add_view, oracle
from quire.operators import numbering as n

QUERIES, ORACLES = {}, {}


def q(name, view, sql):
    def add(function):
        QUERIES[name] = function
        ORACLES[name] = oracle(view, sql)
        return function
    return add


add_view("f_values", """
  SELECT book_id, number_type, list(numeric_value) AS vals, list_sort(list(DISTINCT numeric_value)) AS uniq,
         min(scan_index * 1000 + ord) AS first_at FROM f_detected GROUP BY ALL""", ["f_detected"])
add_view("f_profile", """
  SELECT book_id, number_type, first_at, len(vals) AS numbers, len(uniq) AS distinct_values, uniq[1] AS first_number, uniq[-1] AS last_number,
         uniq[-1] - uniq[1] + 1 - len(uniq) AS gap_count,
         coalesce(list_sum(list_transform(list_zip(uniq[:-2], uniq[2:]), lambda z: z[2] - z[1] - 1)), 0)::BIGINT AS missing_count,
         (SELECT count(*) FROM (SELECT unnest(vals) AS v GROUP BY 1 HAVING count(*) > 1)) AS duplicate_values,
         len(vals) - len(uniq) AS extra_copies,
         len(list_filter(list_zip(uniq[:-2], uniq[2:]), lambda z: z[2] - z[1] = 1)) AS consecutive_pairs,
         list_min(list_transform(list_zip(uniq[:-2], uniq[2:]), lambda z: z[2] - z[1])) AS min_step,
         list_max(list_transform(list_zip(uniq[:-2], uniq[2:]), lambda z: z[2] - z[1])) AS max_step
  FROM f_values""", ["f_values"])
add_view("f_sconf", """
  SELECT *, least(100.0, greatest(0.0, CASE number_type WHEN 'arabic' THEN 70 WHEN 'roman' THEN 80 ELSE 50 END
      + CASE WHEN distinct_values > 1 THEN distinct_values / (last_number - first_number + 1) * 20 + consecutive_pairs / (distinct_values - 1) * 15 ELSE 0 END
      - 5 * extra_copies + CASE WHEN first_number BETWEEN 1 AND 10 AND last_number <= 1000 THEN 10 ELSE 0 END)) AS sequence_confidence,
    CASE WHEN distinct_values = 1 THEN 'single_' || number_type WHEN min_step = 1 AND max_step = 1 THEN 'sequential_' || number_type
         WHEN min_step = max_step THEN 'arithmetic_' || number_type || '_step_' || min_step
         WHEN number_type = 'roman' AND last_number <= 20 THEN 'roman_preface' WHEN number_type = 'roman' THEN 'roman_main'
         ELSE 'irregular_' || number_type END AS pattern
  FROM f_profile""", ["f_profile"])
add_view("f_primary", """
  SELECT * FROM (SELECT s.*, t.total_pages, sequence_confidence + 20.0 * distinct_values / total_pages + CASE WHEN first_number = 1 THEN 10 ELSE 0 END
           + CASE number_type WHEN 'arabic' THEN 15 WHEN 'roman' THEN 10 ELSE 0 END AS score
    FROM f_sconf s JOIN (SELECT book_id, count(*) AS total_pages FROM f_numbers GROUP BY 1) t USING (book_id))
  QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY score DESC, first_at) = 1""", ["f_sconf"])
add_view("f_analysis", """
  SELECT *, sequence_confidence / 100.0 * CASE WHEN missing_count > 0 THEN 1 - missing_count / total_pages ELSE 1 END
         * CASE WHEN duplicate_values > 0 THEN 0.8 ELSE 1 END AS quality,
      CASE WHEN missing_count = 0 AND duplicate_values = 0 THEN 'Numbering sequence appears complete'
           ELSE concat_ws('; ', CASE WHEN missing_count > 0 THEN 'Missing page numbers: ' || missing_count END,
                                CASE WHEN duplicate_values > 0 THEN 'Duplicate page numbers found: ' || duplicate_values END) END AS hints
  FROM f_primary""", ["f_primary"])
add_view("f_trans", """
  SELECT book_id, scan_index, f AS from_types, t AS to_types, CASE WHEN f = 'roman' AND t = 'arabic' THEN 'roman_to_arabic' WHEN f = 'arabic' AND t = 'roman' THEN 'arabic_to_roman' ELSE 'mixed_scheme_change' END AS transition_type
  FROM (SELECT book_id, scan_index, t, lag(t) OVER (PARTITION BY book_id ORDER BY scan_index) AS f
        FROM (SELECT book_id, scan_index, string_agg(DISTINCT number_type, ',') AS t FROM f_detected GROUP BY ALL))
  WHERE f <> t""", ["f_detected"])


def detected(spark, sf_dir):
    return fx.f_detected(fx.f_numbers(spark, sf_dir))


def profile(spark, sf_dir):
    return n.sequence_profile(detected(spark, sf_dir), fx.lines_wide(spark, sf_dir))


def primary(spark, sf_dir):
    return n.primary_scheme(profile(spark, sf_dir), fx.f_pages(fx.f_numbers(spark, sf_dir)))


@q("sequence_profile", "f_profile", """
SELECT book_id, number_type, numbers, distinct_values, first_number, last_number, gap_count, missing_count, duplicate_values, extra_copies, consecutive_pairs, min_step, max_step FROM f_profile""")
def sequence_profile(spark, sf_dir):
    return profile(spark, sf_dir).select(
        "book_id", "number_type", "numbers", "distinct_values", "first_number", "last_number",
        "gap_count", "missing_count", "duplicate_values", "extra_copies", "consecutive_pairs", "min_step", "max_step")


@q("sequence_confidence", "f_sconf", "SELECT book_id, number_type, round(sequence_confidence, 6) AS sequence_confidence FROM f_sconf")
def sequence_confidence(spark, sf_dir):
    return n.sequence_confidence(profile(spark, sf_dir)).select(
        "book_id", "number_type", F.round("sequence_confidence", 6).alias("sequence_confidence"))


@q("sequence_pattern", "f_sconf", "SELECT book_id, number_type, pattern FROM f_sconf")
def sequence_pattern(spark, sf_dir):
    return n.sequence_pattern(profile(spark, sf_dir)).select("book_id", "number_type", "pattern")


@q("primary_scheme", "f_primary", "SELECT book_id, number_type, total_pages, round(score, 6) AS score FROM f_primary")
def primary_scheme(spark, sf_dir):
    return primary(spark, sf_dir).select("book_id", "number_type", "total_pages", F.round("score", 6).alias("score"))


@q("sequence_analysis", "f_analysis", """
SELECT book_id, number_type, missing_count, missing_count = 0 AS is_complete, 0 AS extra_count, round(quality, 6) AS sequence_quality,
       hints AS recommendations FROM f_analysis""")
def sequence_analysis(spark, sf_dir):
    return n.sequence_analysis(primary(spark, sf_dir)).select(
        "book_id", "number_type", "missing_count", "is_complete", "extra_count",
        F.round("sequence_quality", 6).alias("sequence_quality"), "recommendations")


@q("numbering_analysis", ["f_analysis", "f_trans"], """
SELECT b.book_id, a.number_type AS primary_type, a.pattern, round(a.sequence_confidence, 6) AS sequence_confidence,
       round(a.quality, 6) AS sequence_quality, a.hints AS recommendations,
       round(coalesce(least(100, 0.6 * a.sequence_confidence + 40 * a.quality), 0), 6) AS numbering_confidence,
       (SELECT count(*) - 1 FROM f_profile p WHERE p.book_id = b.book_id) AS alternative_schemes,
       (SELECT count(*) FROM f_trans t WHERE t.book_id = b.book_id) AS transitions,
       b.n AS total_pages, w.n AS pages_with_numbers, b.n - w.n AS pages_without_numbers
FROM (SELECT book_id, count(*) AS n FROM f_numbers GROUP BY 1) b JOIN f_analysis a USING (book_id)
JOIN (SELECT book_id, count(DISTINCT scan_index) AS n FROM f_detected GROUP BY 1) w USING (book_id)""")
def numbering_analysis(spark, sf_dir):
    numbers = fx.f_numbers(spark, sf_dir)
    frame = n.numbering_analysis(fx.f_pages(numbers), fx.f_detected(numbers), fx.lines_wide(spark, sf_dir))
    for name in ("sequence_confidence", "sequence_quality", "numbering_confidence"):
        frame = frame.withColumn(name, F.round(name, 6))
    return frame


@q("missing_numbers", "f_values", """
SELECT book_id, number_type, z[1] + 1 AS first_missing, z[2] - 1 AS last_missing, z[2] - z[1] - 1 AS missing_count FROM (
  SELECT book_id, number_type, unnest(list_zip(uniq[:-2], uniq[2:])) AS z FROM f_values)
WHERE z[2] - z[1] > 1""")
def missing_numbers(spark, sf_dir):
    return n.missing_numbers(detected(spark, sf_dir), fx.lines_wide(spark, sf_dir))


@q("duplicate_numbers", "f_detected", """
SELECT book_id, number_type, numeric_value, count(*) AS copies FROM f_detected GROUP BY ALL HAVING count(*) > 1""")
def duplicate_numbers(spark, sf_dir):
    return n.duplicate_numbers(detected(spark, sf_dir))


@q("scheme_transitions", "f_trans", "SELECT * FROM f_trans")
def scheme_transitions(spark, sf_dir):
    return n.scheme_transitions(detected(spark, sf_dir), fx.lines_wide(spark, sf_dir))
