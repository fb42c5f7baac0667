"""Both ways of every ordered helper give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from quire.plans import ranks


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(book, i, rng.choice([None, rng.randint(1, 9)]), rng.random())
            for book, n in (("hot", 400), ("b", 31), ("c", 1)) for i in rng.sample(range(n * 3), n)]
    return spark.createDataFrame(data, "book_id string, at int, value int, x double").repartition(3)


def same(left, right):
    assert sorted(left.columns) == sorted(right.columns)
    names = sorted(left.columns)
    assert sorted(map(str, left.select(names).collect())) == sorted(map(str, right.select(names).collect()))


def test_number_rows(rows, tiny_chunks):
    order = [F.desc("x"), "at"]
    same(ranks.number_rows(rows, ["book_id"], order, "n", False), ranks.number_rows(rows, ["book_id"], order, "n", True))


def test_running(rows, tiny_chunks):
    values = {"total": ("sum", F.col("value")), "peak": ("max", F.col("value"))}
    same(ranks.running(rows, ["book_id"], "at", values, False), ranks.running(rows, ["book_id"], "at", values, True))


def test_last_and_next_seen(rows, tiny_chunks):
    for helper in (ranks.last_seen, ranks.next_seen):
        same(helper(rows, ["book_id"], "at", "value", "near", False), helper(rows, ["book_id"], "at", "value", "near", True))


def test_totals_and_attach(rows, tiny_chunks):
    totals = {"n": F.count(F.lit(1)), "low": F.min("value")}
    same(ranks.with_totals(rows, ["book_id"], totals, "at", False), ranks.with_totals(rows, ["book_id"], totals, "at", True))
    facts = rows.groupBy("book_id").agg(F.max("at").alias("top"))
    same(ranks.attach(rows, facts, ["book_id"], "at", False), ranks.attach(rows, facts, ["book_id"], "at", True))


def test_measured_choice(rows):
    assert ranks.is_wide(rows, ["book_id"], 100)
    assert not ranks.is_wide(rows, ["book_id"], 400)
