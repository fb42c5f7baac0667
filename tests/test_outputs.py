"""Files in final order, and hot books that go another way than the rest."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import ordering as o
from quire.plans import ranks
from quire.sources import sinks


@pytest.fixture(scope="module")
def decisions(spark):
    rng = random.Random(11)
    rows = [(book, i, f"Page_{rng.randint(1, n):03d}.jpg", rng.randint(1, n + 9), rng.choice([0.3, 0.7, 0.95, 0.99]), rng.random() < 0.7)
            for book, n in (("hot", 500), ("b", 40), ("c", 1), (None, 30)) for i in range(n)]
    return spark.createDataFrame(
        rows, "book_id string, scan_index int, original_name string, assigned_position int, confidence double, has_number boolean").repartition(3)


def listed(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("work", [o.order_pages, o.resolve_conflicts])
def test_only_hot_books_go_the_wide_way(spark, decisions, tiny_chunks, monkeypatch, work):
    known = decisions.where("book_id IS NOT NULL")
    plain, columns = work(known, False), ["book_id", "scan_index", "assigned_position", "confidence", "moved"]
    seen, fixed = [], ranks.fix
    monkeypatch.setattr(ranks, "WIDE_ROWS", 100)
    monkeypatch.setattr(ranks, "fix", lambda df: seen.append(fixed(df)) or seen[-1])
    mixed = work(known)
    assert listed(mixed, *columns) == listed(plain, *columns)
    assert len(seen) > 1
    assert all({r["book_id"] for r in df.select("book_id").distinct().collect()} == {"hot"} for df in seen[1:])


def test_by_width_keeps_groups_without_a_name(decisions, monkeypatch):
    monkeypatch.setattr(ranks, "WIDE_ROWS", 20)
    ways = ranks.by_width(decisions, ["book_id"], None, lambda rows, wide: rows.select("book_id", F.lit(wide).alias("wide")))
    assert {(r["book_id"], r["wide"], r["count"]) for r in ways.groupBy("book_id", "wide").count().collect()} == {
        ("hot", True, 500), ("b", True, 40), ("c", False, 1), (None, True, 30)}


def test_files_are_the_final_order(spark, decisions, tmp_path):
    pages = decisions.withColumn("assigned_position", F.when(F.col("scan_index") % 50 != 7, F.col("assigned_position")))
    folder = str(tmp_path / "pages")
    sinks.write_ordered(pages, folder, parts=6, rows_per_file=30)
    rows = spark.read.parquet(folder).select("book_id", F.col("_metadata.file_name").alias("file")).collect()
    assert len({r["file"] for r in rows if r["book_id"] == "hot"}) > 6
    got = sinks.read_ordered(spark, folder).orderBy("output_row").collect()
    want = sorted(((r["book_id"] is None, r["book_id"] or ""), (r["assigned_position"] is None, r["assigned_position"] or 0), r["scan_index"])
                  for r in pages.collect())
    assert [r["output_row"] for r in got] == list(range(1, 572))
    assert [((r["book_id"] is None, r["book_id"] or ""), (r["assigned_position"] is None, r["assigned_position"] or 0), r["scan_index"])
            for r in got] == want


def test_outputs_stand_in_order_inside_their_book(spark, decisions, tmp_path):
    lines = decisions.where("book_id IS NOT NULL").select(
        "book_id", F.lit("2 order").alias("section"), F.col("scan_index").alias("line_no"),
        F.format_string("%05d", "scan_index").alias("line"))
    bad = lines.select("book_id", F.col("line").alias("book_id"))
    done = sinks.write_outputs({"summary": (lines, "text"), "bad": (bad, "json"), "pages": (decisions.dropna(), "json")},
                               str(tmp_path), rows_per_file=90)
    assert done["summary"] is None and done["pages"] is None and done["bad"]
    files = sorted((tmp_path / "summary" / "book_id=hot").glob("part-*"))
    text = [line for f in files for line in f.read_text().split()]
    assert len(files) > 4 and text == [f"{i:05d}" for i in range(500)]
    assert spark.read.json(str(tmp_path / "pages")).count() == decisions.dropna().count()


def test_long_numbers_stay_whole(spark):
    numbered = spark.createDataFrame([("b", 0, "x.jpg"), ("b", 1, "y.jpg")], "book_id string, scan_index int, original_name string")
    detected = spark.createDataFrame([("b", 0, 0, "arabic", 9780632046584, 97.0)],
                                     "book_id string, scan_index int, ord int, number_type string, numeric_value long, confidence double")
    rows = {r["scan_index"]: r["assigned_position"] for r in o.decide_alone(numbered, detected).collect()}
    assert rows == {0: 9780632046584, 1: 2}
