"""File collections as tables: scanning, support, natural order, book identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans import ranks
from quire.schemas import DOCUMENT_EXTENSIONS, IMAGE_EXTENSIONS


def scan_collection(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Files below ``folder``: book_id (parent folder), path, length, modificationTime. Contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
             .load(folder).select("path", "length", "modificationTime"))
    return files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("book_id"), "*")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images with their size; a file that does not decode is a row with an error and no data."""
    images = (spark.read.format("image").option("dropInvalid", "false")
              .option("recursiveFileLookup", "true").load(folder))
    broken = F.col("image.height") < 0
    return images.select(F.regexp_extract("image.origin", "([^/]+)/[^/]+$", 1).alias("book_id"), "image",
                         F.when(broken, "not an image").alias("error"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), r"(.)\.[^.]*$", "$1")


def file_kind(path: Column) -> Column:
    kind = extension(path)
    return F.when(kind.isin(IMAGE_EXTENSIONS), "image").when(kind.isin(DOCUMENT_EXTENSIONS), "document").otherwise("unknown")


def file_facts(files: DataFrame) -> DataFrame:
    """Kind and support of each file, and the pages it stands for (``page_count`` for documents, else 1)."""
    kind = file_kind(F.col("path"))
    pages = F.when(kind == "document", F.coalesce("page_count", F.lit(1))).when(kind == "image", 1).otherwise(0)
    return files.withColumns({"kind": kind, "supported": kind != "unknown", "estimated_pages": pages})


def collection_census(files: DataFrame) -> DataFrame:
    """Per book: files, supported files, pages, and whether it can be processed."""
    census = file_facts(files).groupBy("book_id").agg(
        F.count("*").alias("total_files"), F.count_if("supported").alias("supported_files"),
        F.count_if(~F.col("supported")).alias("unsupported_files"), F.sum("estimated_pages").alias("estimated_pages"))
    usable = F.col("supported_files") > 0
    return census.withColumns({
        "is_valid": usable, "error": F.when(~usable, "No supported files found in directory")})


def natural_key(path: Column) -> tuple[Column, Column]:
    """(number, text): the page number in the name, else 999999 and the name with padded digit runs."""
    name = F.lower(stem(path))
    found = F.coalesce(*[F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in (
        r"page_([0-9]+)", r"_([0-9]{3,5})(?:\.|$)", r"([0-9]{3,5})(?:\.|$)")])
    runs = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    padded = F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(r, 20, "0")).otherwise(r)), "")
    number = F.coalesce(found.try_cast("decimal(38,0)"), F.lit(999999).cast("decimal(38,0)"))
    return number, F.when(found.isNotNull(), name).otherwise(padded)


def natural_order(files: DataFrame, wide: bool | None = None) -> DataFrame:
    """Supported files with ``scan_index``, 0-based in natural page order."""
    number, text = natural_key(F.col("path"))
    rows = files.where(file_kind(F.col("path")) != "unknown").withColumns({"_number": number, "_text": text})
    rows = ranks.number_rows(rows, ["book_id"], ["_number", "_text", "path"], "_rn", wide)
    return rows.withColumn("scan_index", F.col("_rn") - 1).drop("_number", "_text", "_rn")


def expand_documents(documents: DataFrame) -> DataFrame:
    """Multi-page documents to page rows, numbered from 1. Input: document, page_count."""
    pages = documents.where(F.col("page_count") > 0).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_number"))
    return pages.withColumns({
        "original_name": F.format_string("%s_page_%03d", stem(F.col("document")), "page_number"),
        "total_pages": F.col("page_count"), "dpi": F.lit(300)}).drop("page_count")


def book_identifiers(first_files: DataFrame) -> DataFrame:
    """Identifiers from the first file's name and from the folder's name. Input: folder, first_file."""
    head = F.split_part("first_file", F.lit("_"), F.lit(1))
    digits = head.rlike("^[0-9]+$")
    in_folder = F.regexp_extract("folder", "([0-9]{13})", 1)
    return first_files.withColumns({
        "output_folder": F.when(digits & (F.length(head) >= 10), head).otherwise("Organized_Pages"),
        "file_prefix": F.when(digits, head).otherwise("page"),
        "folder_book": F.when(in_folder != "", in_folder).otherwise(F.col("folder"))})


def name_position(name: Column) -> Column:
    """Page position a file name states, or null."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in (
        r"Page_([0-9]+)", r"page_([0-9]+)", r"_0*([0-9]+)\.jpg$", r"([0-9]+)\.jpg$")])
    return found.try_cast("int")


def content_key(*columns: Column) -> Column:
    """Key of a file's state: path, size and time."""
    return F.md5(F.concat_ws("_", *[c.cast("string") for c in columns]))
