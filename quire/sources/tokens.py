"""OCR text blocks to page text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_filter(blocks: DataFrame, minimum: float = 30.0) -> DataFrame:
    """Blocks with text after stripping and enough confidence."""
    return blocks.withColumn("text", F.btrim("text", F.lit(" \t\r\n"))).where(
        (F.col("text") != "") & (F.col("conf") > minimum))


def assemble_text(blocks: DataFrame, minimum: float = 50.0) -> DataFrame:
    """Page text: the kept blocks in box order, joined by a blank. One page is one row."""
    return (blocks.where(F.col("conf") > minimum).groupBy("book_id", "scan_index")
            .agg(F.array_join(F.transform(
                F.sort_array(F.collect_list(F.struct("block_index", "text"))), lambda b: b["text"]), " ").alias("full_text"),
                F.avg("conf").alias("language_confidence")))


def number_boxes(numbers: DataFrame, blocks: DataFrame) -> DataFrame:
    """The first block of the page whose text contains the number; a fixed box when there is none."""
    box = F.struct("left", "top", "width", "height")
    # blocks of a page become one sorted array, so a number looks its block up without a join per block
    listed = blocks.groupBy("book_id", "scan_index").agg(
        F.sort_array(F.collect_list(F.struct("block_index", F.col("text").alias("block_text"), box.alias("box")))).alias("_b"))
    rows = numbers.join(listed, ["book_id", "scan_index"], "left")
    hit = F.get(F.filter("_b", lambda b: b["block_text"].contains(F.col("text"))), F.lit(0))
    default = F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(50).alias("width"), F.lit(20).alias("height"))
    return rows.withColumn("position", F.coalesce(hit["box"], default)).drop("_b")
