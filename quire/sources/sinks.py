"""Result tables and the writers that put them to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.numerals import one_decimal
from quire.plans import ranks


def output_names(ordered: DataFrame, wide: bool | None = None, extension: str = "tif",
                 default_prefix: str = "page") -> DataFrame:
    """Sequential file names by final rank; positions are unique within a book.

    The prefix is the digits before the first ``_`` of the first page's name.
    """
    head = F.split_part(F.col("original_name"), F.lit("_"), F.lit(1))
    first = F.min_by(head, F.struct("assigned_position", "scan_index"))
    ranked = ranks.running(ordered, ["book_id"], "assigned_position", {"_rank": ("sum", F.lit(1))}, wide)
    rows = ranks.with_totals(ranked, ["book_id"], {"_head": first}, "scan_index", wide)
    prefix = F.when(F.col("_head").rlike("^[0-9]+$"), F.col("_head")).otherwise(default_prefix)
    name = F.format_string(f"%s_%05d.{extension}", prefix, F.col("_rank").cast("int"))
    return rows.withColumn("output_name", name).drop("_head", "_rank")


def confidence_class(confidence: Column) -> Column:
    return F.when(confidence > 0.8, "high").when(confidence > 0.5, "medium").otherwise("low")


def order_comparison(pages: DataFrame, ordered: DataFrame, wide: bool | None = None) -> DataFrame:
    """Original place beside final place for every page of either list."""
    before = pages.select("book_id", "scan_index", (F.col("scan_index") + 1).alias("original_place"))
    after = ordered.select("book_id", "scan_index", "assigned_position", "confidence")
    return ranks.dealt(before, ["book_id", "scan_index"], wide).join(after, ["book_id", "scan_index"], "full_outer").select(
        "book_id", "scan_index", "original_place", "assigned_position",
        (F.col("assigned_position") - F.col("original_place")).alias("shift"),
        confidence_class(F.col("confidence")).alias("confidence_class"))


def page_details(ordered: DataFrame, detected: DataFrame, page_text: DataFrame, wide: bool | None = None) -> DataFrame:
    """One JSON object per page: place, confidence, numbers, OCR facts.

    A long book never becomes one object; the file sink writes one line per page
    under its book's folder.
    """
    from quire.operators.confidence import word_count

    numbers = detected.groupBy("book_id", "scan_index").agg(
        F.sort_array(F.collect_list(F.struct("ord", "text", "number_type", "numeric_value", "confidence"))).alias("numbers"))
    facts = page_text.select("book_id", "scan_index", F.length("full_text").alias("text_length"),
                             word_count(F.col("full_text")).alias("word_count"), "language_confidence", "processing_time")
    return details(ranks.dealt(ordered, ["book_id", "scan_index"], wide).join(numbers, ["book_id", "scan_index"], "left")
                   .join(facts, ["book_id", "scan_index"], "left"))


def details(pages: DataFrame) -> DataFrame:
    """:func:`page_details` of ordered pages that hold their ``numbers`` (text, number_type, numeric_value, confidence, in
    list order), text_length, word_count, language_confidence and processing_time themselves."""
    kept = F.when(F.col("has_number"), F.col("numbers"))
    listed = F.transform(F.coalesce(kept, F.array()), lambda n: F.struct(
        n["text"].alias("text"), n["number_type"].alias("type"), n["numeric_value"].alias("numeric_value"),
        n["confidence"].alias("confidence")))
    return pages.select("book_id", "scan_index", F.struct(
        F.col("original_name").alias("original_filename"), "assigned_position", "confidence",
        F.col("rule").alias("reasoning"), listed.alias("detected_numbers"),
        F.struct("text_length", "word_count", "language_confidence", "processing_time").alias("ocr_info")).alias("detail"))


def shorten(text: Column, limit: int = 100) -> Column:
    """Context shown in logs: the first ``limit`` characters and dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def log_headers(report: DataFrame, page_text: DataFrame) -> DataFrame:
    """The summary part of the log, one row per book."""
    time = page_text.groupBy("book_id").agg(F.sum("processing_time").alias("processing_time"))
    return report.join(time, "book_id", "left").select(
        "book_id", F.col("page_count").alias("total_pages"), "overall_confidence",
        F.col("problem_pages").alias("pages_reviewed"), "processing_time")


def summary_lines(ordered: DataFrame, report: DataFrame, advice: DataFrame, assessed: DataFrame) -> DataFrame:
    """The text summary as (book_id, section, line_no, line); sort by section and line_no to print."""
    lines = F.array_compact(F.array(
        F.format_string("Total pages processed: %d", "page_count"),
        F.format_string("Overall confidence: %s%%", one_decimal(F.col("overall_confidence"))),
        F.format_string("Pages needing review: %d", "problem_pages"),
        F.when(F.col("needs_human_review"), "HUMAN REVIEW RECOMMENDED").otherwise("Automatic ordering appears reliable"),
        F.format_string("High confidence pages: %d", "high_pages"),
        F.format_string("Medium confidence pages: %d", "medium_pages"),
        F.format_string("Low confidence pages: %d", "low_pages"),
        F.format_string("Numbering detection: %s%%", one_decimal(F.col("numbering_confidence"))),
        F.format_string("Sequence quality: %s%%", one_decimal(F.col("sequence_confidence")))))
    head = report.select("book_id", F.lit("1 results").alias("section"),
                         F.posexplode(lines).alias("line_no", "line"))
    mark = F.when(F.col("confidence") > 0.8, "ok").when(F.col("confidence") > 0.5, "check").otherwise("unsure")
    order = ordered.select(
        "book_id", F.lit("2 order").alias("section"), F.col("assigned_position").alias("line_no"),
        F.format_string("%3d. %s [%s]", "assigned_position", "original_name", mark).alias("line"))
    first_ten = Window.partitionBy("book_id").orderBy("slot")
    tips = (advice.withColumn("line_no", F.row_number().over(first_ten)).where(F.col("line_no") <= 10)
            .select("book_id", F.lit("3 recommendations").alias("section"), "line_no",
                    F.format_string("%s: %s", "code", "text").alias("line")))
    from quire.operators.confidence import first_review_pages

    review = first_review_pages(assessed, 10).select(
        "book_id", F.lit("4 review").alias("section"), F.col("_rank").alias("line_no"),
        F.format_string("%s (Position %d)", "original_name", "assigned_position").alias("line"))
    return head.unionByName(order).unionByName(tips).unionByName(review)


#: Columns that say where a row stands inside its book, by what a frame has.
ROW_ORDERS = (("assigned_position", "scan_index"), ("section", "line_no"))


def ordered_output(ordered: DataFrame, parts: int | None = None) -> DataFrame:
    """All pages in final order, as ranges of (book, position): every partition is sorted and lies
    wholly before the next one, so a book of any size is dealt over as many as it needs.

    Pages without a position stand at the end of their book.
    """
    keys = [F.col("book_id").asc_nulls_last(), F.col("assigned_position").asc_nulls_last(), F.col("scan_index").asc_nulls_last()]
    spread = ordered.repartitionByRange(parts, *keys) if parts else ordered.repartitionByRange(*keys)
    return spread.sortWithinPartitions(*keys)


def write_ordered(ordered: DataFrame, folder: str, parts: int | None = None, rows_per_file: int = 1_000_000) -> None:
    """Write the pages of all books in final order; the files, read by name, are that order."""
    ordered_output(ordered, parts).write.option("maxRecordsPerFile", rows_per_file).parquet(folder)


def read_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of ``write_ordered`` with ``output_row``, each one's place from 1 among all rows of
    all files. Counts per file are added up, so no row is sorted again."""
    name = F.regexp_extract("_metadata.file_name", r"part-(\d+)-.*-c(\d+)", 1).cast("long")
    roll = F.regexp_extract("_metadata.file_name", r"part-(\d+)-.*-c(\d+)", 2).cast("long")
    rows = spark.read.parquet(folder).select("*", name.alias("_part"), roll.alias("_roll"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_part", "_roll").agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_part", "_roll").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    before = sizes.select("_part", "_roll", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    return (rows.join(before, ["_part", "_roll"])
            .withColumn("output_row", F.col("_before") + F.col("_row") + 1).drop("_part", "_roll", "_before", "_row"))


def write_outputs(outputs: dict[str, tuple[DataFrame, str]], folder: str, rows_per_file: int = 1_000_000) -> dict[str, str | None]:
    """Write the chosen outputs, each by book; ``outputs`` maps a name to (frame, 'json', 'text' or 'parquet').

    Rows stand in the files of their book by the first of ``ROW_ORDERS`` that the frame has; a
    hot book is a run of ranges, and files are rolled at ``rows_per_file``. Frames without an order are
    brought together by book, a hot one split again by size (rebalance). A failed output does not stop
    the others; each name maps to None when written, else to the error.
    """
    done: dict[str, str | None] = {}
    for name, (frame, kind) in outputs.items():
        try:
            keys = ["book_id"] if "book_id" in frame.columns else []
            order = next((o for o in ROW_ORDERS if set(o) <= set(frame.columns)), None)
            if keys and order:
                frame = frame.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
            elif keys:
                frame = frame.hint("rebalance", *keys)
            if kind == "text":
                frame = frame.select(*keys, "line")
            (frame.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*keys).format(kind)
             .save(f"{folder}/{name}"))
            done[name] = None
        except Exception as error:  # reported per output, as the caller asked for
            done[name] = f"{type(error).__name__}: {error}"
    return done


def write_samples(samples: DataFrame, folder: str) -> None:
    """Training samples, one folder per lower-cased label; a blank label is stored as ``none``."""
    label = F.lower(F.trim("label"))
    (samples.withColumn("class_label", F.when(label == "", "none").otherwise(F.coalesce(label, F.lit("none"))))
     .write.mode("append").partitionBy("class_label").parquet(folder))
