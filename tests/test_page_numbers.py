"""Distinct numbers of a page, counted from its values."""

from quire.operators import ordering as o


def test_distinct_numbers_without_a_second_grouping(spark):
    values = {0: [3, 3, 0, None, 5], 1: [None], 2: [0, 0], 4: [7]}
    rows = [("b", page, at, "arabic", v, 80.0) for page, vs in values.items() for at, v in enumerate(vs)]
    detected = spark.createDataFrame(
        rows, "book_id string, scan_index int, ord int, number_type string, numeric_value long, confidence double")
    pages = spark.createDataFrame([("b", i, f"p{i}") for i in range(5)], "book_id string, scan_index int, original_name string")
    found = o.page_numbers(pages, detected, False)
    assert dict(found.dtypes)["distinct_count"] == "bigint"
    assert {r.scan_index: (r.number_count, r.distinct_count) for r in found.collect()} == {
        0: (5, 2), 1: (1, 0), 2: (2, 0), 3: (0, 0), 4: (1, 1)}
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
