"""Decisions and conflict resolution on hand-written books and random ones."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import ordering as o


def book(spark, numbers, name="b", total=None):
    """numbers: scan_index -> (type, value, confidence)."""
    n = total or max(numbers) + 1
    pages = spark.createDataFrame([(name, i, f"Page_{i + 1:03d}.jpg") for i in range(n)],
                                  "book_id string, scan_index int, original_name string")
    detected = spark.createDataFrame(
        [(name, i, k, str(v[1]), v[0], v[1], float(v[2])) for i, vs in numbers.items()
         for k, v in enumerate(vs if isinstance(vs, list) else [vs])],
        "book_id string, scan_index int, ord int, text string, number_type string, numeric_value int, confidence double")
    return o.page_numbers(pages, detected)


def test_twenty_five_pages(spark):
    numbers = {i: ("roman", i + 1, 90) for i in range(5, 15)}
    numbers |= dict(zip(range(18, 25), [("arabic", v, 90) for v in (1, 4, 5, 6, 7, 8, 9)]))
    rows = o.order_pages(o.decide(book(spark, numbers), False), False).collect()
    got = {r.scan_index: (r.assigned_position, round(r.confidence, 4)) for r in rows}
    assert all(got[i][0] == i + 1 for i in range(18))
    assert got[18] == (25, 0.63)
    assert [got[i][0] for i in range(19, 25)] == [19, 20, 21, 22, 23, 24]


@pytest.mark.parametrize("index, number, rule, position, confidence", [
    (2, ("arabic", 40, 99), "protected", 3, 0.99),
    (9, ("arabic", 3, 49), "no_number", 10, 0.95),
    (9, ("arabic", 91, 90), "unrealistic", 10, 0.4),
    (9, ("arabic", 51, 90), "outlier", 10, 0.4),
    (9, ("roman", 77, 97), "roman", 77, 0.95),
    (9, ("arabic", 4, 80), "arabic", 9, 0.8),
    (9, [("arabic", v, 90) for v in (1, 2, 3, 4, 5)], "contents", 10, 0.99),
    (9, [("arabic", v, 90) for v in (0, 2, 2, 4, 5)], "arabic", 5, 0.9),
])
def test_each_rule(spark, index, number, rule, position, confidence):
    # 30 pages, five unnumbered ones in front: arabic numbers start at position 6 (or 7 beside a roman page)
    row = o.decide(book(spark, {index: number}, total=30), False).where(F.col("scan_index") == index).first()
    assert (row.rule, row.assigned_position, round(row.confidence, 6)) == (rule, position, confidence)


def greedy(wishes):
    """The slot search as a loop: book -> list of (position, confidence, scan)."""
    taken, out = {p for p, _, _ in wishes}, {}
    for position in sorted(taken):
        group = sorted((w for w in wishes if w[0] == position), key=lambda w: (-w[1], w[2]))
        out[group[0][2]] = position
        for _, _, scan in group[1:]:
            new = position + 1
            while new in taken:
                new += 1
            taken.add(new)
            out[scan] = new
    return out


@pytest.mark.parametrize("wide", [False, True])
def test_allocate_equals_the_loop(spark, tiny_chunks, wide):
    rng = random.Random(3)
    cases = {f"r{n}": [(rng.randint(0, 12), rng.choice([0.5, 0.9]), i) for i in range(rng.randint(1, 25))] for n in range(12)}
    cases["g2"] = [(p, 0.9, i) for i, p in enumerate([1, 2, 2, 2, 4, 6, 6])]
    rows = [(b, i, p, c) for b, wishes in cases.items() for p, c, i in wishes]
    df = spark.createDataFrame(rows, "book_id string, scan_index int, assigned_position int, confidence double")
    got = o.allocate(df, [F.desc("confidence"), F.asc("scan_index")], wide).collect()
    for name, wishes in cases.items():
        assert {r.scan_index: r.assigned_position for r in got if r.book_id == name} == greedy(wishes), name
    assert [r.assigned_position for r in sorted(got, key=lambda r: r.scan_index) if r.book_id == "g2"] == [1, 2, 3, 5, 4, 6, 7]


def test_wide_order_is_the_same_order(spark, tiny_chunks):
    rng = random.Random(9)
    numbers = {i: ("arabic" if rng.random() < 0.8 else "roman", rng.randint(1, 60), rng.choice([40, 55, 70, 96]))
               for i in range(60) if rng.random() < 0.8}
    pages = book(spark, numbers, total=60)
    narrow = o.order_pages(o.decide(pages, False), False).select("scan_index", "assigned_position", "confidence")
    wide = o.order_pages(o.decide(pages, True), True).select("scan_index", "assigned_position", "confidence")
    assert sorted(narrow.collect()) == sorted(wide.collect())
    assert narrow.select("assigned_position").distinct().count() == 60


def test_file_name_match(spark):
    names = ["Page_018.jpg", "9780632046584_Page_018.jpg", "x.jpg", "a_7.tif", "a_7.bmp"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r) for r in df.select(o.name_matches(F.col("n"), F.lit(18)), o.name_matches(F.col("n"), F.lit(7))).collect()]
    assert got == [(True, False), (False, False), (False, False), (False, True), (False, False)]
