"""One decimal, rounded as the SQL's printf rounds it."""

from pyspark.sql import functions as F

from quire.functions.numerals import one_decimal
from quire.operators import confidence
from quire.sources import sinks


def test_one_decimal_is_the_exact_value(spark):
    values = [n / pages * 100 for pages in (7, 32, 400, 600, 640, 2000) for n in range(0, pages + 1, 3)]
    values += [k / 8 for k in range(801)] + [0.05, 0.15, 30.35, 99.95, 1e-9]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", one_decimal(F.col("v")).alias("s")).collect()
    assert [(r.v, r.s) for r in rows if r.s != "%.1f" % r.v] == []


def test_exact_ties_in_the_summary(spark):
    metrics = spark.createDataFrame(
        [("b", 400, 71.25, 30.25, 90, 1, 2, 3, 4)],
        "book_id string, page_count long, overall_confidence double, numbering_confidence double, sequence_confidence int,"
        "high_pages long, medium_pages long, low_pages long, problem_pages long")
    report = confidence.confidence_report(metrics)
    assert "71.2 of 100" in report.head().summary
    pages = spark.createDataFrame([], "book_id string, scan_index int, original_name string, assigned_position int, confidence double, needs_review boolean")
    advice = spark.createDataFrame([], "book_id string, slot int, code string, text string")
    lines = [r.line for r in sinks.summary_lines(pages, report, advice, pages).collect()]
    assert "Overall confidence: 71.2%" in lines and "Numbering detection: 30.2%" in lines and "Sequence quality: 90.0%" in lines
