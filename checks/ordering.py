"""Ordering: context, decisions, conflicts, insertion, validation, names."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import oracle
from quire.operators import ordering as o
from quire.plans.session import checkpoint_folder, fix

QUERIES, ORACLES = {}, {}


def numbered(spark, sf_dir):
    numbers = fx.f_numbers(spark, sf_dir)
    return o.page_numbers(fx.f_pages(numbers), fx.f_detected(numbers), fx.lines_wide(spark, sf_dir))


def decided(spark, sf_dir):
    return o.decide(numbered(spark, sf_dir), fx.lines_wide(spark, sf_dir))


def ordered(spark, sf_dir):
    return o.order_pages(decided(spark, sf_dir), fx.lines_wide(spark, sf_dir))


def ordered_whole(spark, sf_dir, *carry):
    """:func:`ordered` of pages that hold their numbers and text facts, of which ``carry`` go along: one shuffle in all."""
    wide = fx.lines_wide(spark, sf_dir)
    return o.order_pages(o.decide(o.listed_numbers(fx.f_whole_pages(spark, sf_dir), carry), wide, carry=carry), wide)


def q(name, view, sql):
    def add(function):
        QUERIES[name] = function
        ORACLES[name] = oracle(view, sql)
        return function
    return add


@q("book_context", "f_context", """
SELECT *, CASE WHEN max_roman_value > 0 THEN max_roman_value ELSE front_matter + roman_count END AS roman_section_end,
       front_matter + roman_count + 1 AS arabic_section_start FROM f_context""")
def book_context(spark, sf_dir):
    return o.book_context(numbered(spark, sf_dir), fx.lines_wide(spark, sf_dir))


@q("ordering_decisions", "f_decisions", """
SELECT book_id, scan_index, rule, assigned_position, round(confidence, 6) AS confidence, has_number FROM f_decisions""")
def ordering_decisions(spark, sf_dir):
    return decided(spark, sf_dir).select(
        "book_id", "scan_index", "rule", "assigned_position", F.round("confidence", 6).alias("confidence"), "has_number")


@q("resolve_conflicts", "f_resolved", """
SELECT book_id, scan_index, desired, assigned_position, moved, round(confidence, 6) AS confidence FROM f_resolved""")
def resolve_conflicts(spark, sf_dir):
    return o.resolve_conflicts(decided(spark, sf_dir), fx.lines_wide(spark, sf_dir)).select(
        "book_id", "scan_index", "desired", "assigned_position", "moved", F.round("confidence", 6).alias("confidence"))


@q("insert_unnumbered", "f_ordered", """
SELECT o.book_id, o.scan_index, o.desired, o.assigned_position, o.moved
FROM f_ordered o JOIN f_rest r ON r.book_id = o.book_id AND r.scan_index = o.scan_index""")
def insert_unnumbered(spark, sf_dir):
    return ordered(spark, sf_dir).where(~F.col("part")).select(
        "book_id", "scan_index", "desired", "assigned_position", "moved")


@q("order_pages", "f_ordered", """
SELECT book_id, scan_index, original_name, rule, assigned_position, round(confidence, 6) AS confidence FROM f_ordered""")
def order_pages(spark, sf_dir):
    return ordered(spark, sf_dir).select(
        "book_id", "scan_index", "original_name", "rule", "assigned_position", F.round("confidence", 6).alias("confidence"))


@q("validate_order", "f_ordered", """
SELECT book_id, count(*) AS pages,
       count(DISTINCT assigned_position) FILTER (n > 1) AS duplicate_positions,
       count(*) FILTER (step > 5) AS large_steps,
       min(assigned_position) AS first_position, max(assigned_position) AS last_position
FROM (SELECT book_id, assigned_position, count(*) OVER (PARTITION BY book_id, assigned_position) AS n,
             lead(assigned_position) OVER (PARTITION BY book_id ORDER BY assigned_position) - assigned_position AS step FROM f_ordered)
GROUP BY book_id""")
def validate_order(spark, sf_dir):
    return o.validate_order(ordered(spark, sf_dir), fx.lines_wide(spark, sf_dir))


@q("ordering_independent", "f_page", """
SELECT book_id, scan_index, CAST(coalesce(best.v, own) AS BIGINT) AS assigned_position,
       round(CASE WHEN best.c >= 95 THEN least(0.95, best.c / 100) WHEN best.c >= 50 THEN least(0.8, best.c / 100)
                  WHEN best.c IS NOT NULL THEN 0.6 WHEN own <= 5 THEN 0.9 WHEN own <= 50 THEN 0.6 ELSE 0.3 END, 6) AS confidence,
       best.c IS NOT NULL AS has_number
FROM f_page LEFT JOIN (
  SELECT book_id, scan_index, first({'v': numeric_value, 'c': confidence} ORDER BY confidence DESC, ord) AS best
  FROM f_detected GROUP BY ALL) USING (book_id, scan_index)""")
def ordering_independent(spark, sf_dir):
    numbers = fx.f_numbers(spark, sf_dir)
    return o.decide_alone(fx.f_pages(numbers), fx.f_detected(numbers)).select(
        "book_id", "scan_index", "assigned_position", F.round("confidence", 6).alias("confidence"), "has_number")


@q("nearest_free", "f_resolved", """
SELECT d.book_id, d.scan_index, d.assigned_position AS position, CAST(coalesce(
   (SELECT arg_min(c.p, c.rank) FROM (SELECT d.assigned_position + k AS p, 2 * k AS rank FROM range(1, 100) a(k)
                    UNION ALL SELECT d.assigned_position - k, 2 * k + 1 FROM range(1, 100) b(k) WHERE d.assigned_position - k > 0) c
    WHERE NOT EXISTS (SELECT 1 FROM f_resolved t WHERE t.book_id = d.book_id AND t.assigned_position = c.p)),
   (SELECT max(assigned_position) + 1 FROM f_resolved m WHERE m.book_id = d.book_id)) AS INTEGER) AS free_position
FROM f_resolved d WHERE d.moved""")
def nearest_free(spark, sf_dir):
    wide = fx.lines_wide(spark, sf_dir)
    # read by several branches of the search, so it is worked out once
    placed = fix(o.resolve_conflicts(decided(spark, sf_dir), wide).select("book_id", "scan_index", "assigned_position", "moved"))
    taken = placed.select("book_id", F.col("assigned_position").alias("position"))
    asks = placed.where("moved").select("book_id", "scan_index", F.col("assigned_position").alias("position"))
    return o.nearest_free(taken, asks, wide)


@q("output_names", "f_ordered", """
SELECT book_id, scan_index, original_name, assigned_position, book_id || '_' || lpad(CAST(r AS VARCHAR), 5, '0') || '.tif' AS output_name
FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY assigned_position, scan_index) AS r FROM f_ordered)""")
def output_names(spark, sf_dir):
    from quire.sources.sinks import output_names as names

    return names(ordered(spark, sf_dir), fx.lines_wide(spark, sf_dir)).select(
        "book_id", "scan_index", "original_name", "assigned_position", "output_name")


@q("ordered_output", "f_ordered", """
SELECT book_id, scan_index, assigned_position, row_number() OVER (ORDER BY book_id, assigned_position, scan_index) AS output_row FROM f_ordered""")
def ordered_output(spark, sf_dir):
    from quire.sources import sinks

    folder = f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    pages = ordered(spark, sf_dir).select("book_id", "scan_index", "assigned_position")
    sinks.write_ordered(pages, folder, rows_per_file=100_000)
    return sinks.read_ordered(spark, folder)
