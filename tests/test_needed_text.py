"""Small texts that hold all headings or numbered citations of a text."""

import random

from pyspark.sql import functions as F

from checks import fixtures as fx
from quire.functions import text as t


def texts():
    draw = random.Random(8)
    parts = ["Chapter 4", "chapter\t12 of it", "II. Over the hill", "3. Of mice", "3.2 Of men", "SOME WORDS", "Note:", "a word or two", "",
             "see page 7", "see p.  9 and page\n 11", "Fig. 3, table 4", "see figure\n5 see table 6", "previous page", "as shown above", "page",
             "p", "12 and more", "see", "PAGE 8 P 9 p.10", "ÄRGER", " \t Part 9 \r"]
    return ["\n".join(draw.choice(parts) for _ in range(draw.randint(0, 9))) + draw.choice(["", " page", " see", " p."]) for _ in range(200)] + [None, ""]


def around(text):
    return F.concat(F.lit("Chapter "), F.col("scan_index").cast("string"), F.lit("\n"), text, F.lit("\nsee page "), (F.col("scan_index") * 3).cast("string"))


def test_headings_and_citations_are_those_of_the_whole_text(spark):
    rows = spark.createDataFrame([("b", i, x) for i, x in enumerate(texts())], "book_id string, scan_index int, text string")
    whole, lines, cited = (rows.select("book_id", "scan_index", around(x).alias("full_text"))
                           for x in (F.col("text"), t.heading_lines(F.col("text")), t.numbered_citations(F.col("text"))))

    def heads(df):
        return sorted((r.scan_index, r.rule, r.heading, r.heading_type, str(r.heading_number)) for r in t.headings(df).collect())

    def numbers(df):
        return {(r.scan_index, r.referenced_number) for r in t.references(df).where("reference RLIKE '[0-9]'").collect()}

    assert heads(lines) == heads(whole)
    assert len(heads(whole)) > 300
    assert numbers(cited) == numbers(whole)
    assert len(numbers(whole)) > 300


def test_pages_are_numbered_without_their_texts(spark, tmp_path):
    spark.createDataFrame([(k, f"s{k % 2}", "word, " * 50 + "\nPart 3\n" + "see page 2") for k in range(9)],
                          "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    small = fx.f_text(spark, str(tmp_path), t.heading_lines).collect()
    assert sorted(r.full_text for r in small)[0] == "Chapter 1\nPart 3\nsee page 1" and len(small) == 9
