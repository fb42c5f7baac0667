"""Table schemas, thresholds and fixed values.

Scale of confidences: detections 0-100, decisions and assessments 0-1,
book reports 0-100.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

PAGES = T.StructType([
    T.StructField("book_id", T.StringType(), False),
    T.StructField("scan_index", T.IntegerType(), False),
    T.StructField("original_name", T.StringType()),
])

DETECTED_NUMBERS = T.StructType([
    T.StructField("book_id", T.StringType(), False),
    T.StructField("scan_index", T.IntegerType(), False),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("number_type", T.StringType()),
    T.StructField("numeric_value", T.LongType()),
    T.StructField("confidence", T.DoubleType()),
])

TEXT_BLOCKS = T.StructType([
    T.StructField("book_id", T.StringType(), False),
    T.StructField("scan_index", T.IntegerType(), False),
    T.StructField("block_index", T.IntegerType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("conf", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("top", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
])

# Same layout as Spark's own image source.
IMAGE = T.StructType([
    T.StructField("origin", T.StringType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("nChannels", T.IntegerType()),
    T.StructField("mode", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
])

HITS = T.StructType([
    T.StructField("book_id", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("location", T.StringType(), False),
    T.StructField("hit", T.BooleanType(), False),
    T.StructField("number_type", T.StringType()),
    T.StructField("page_num", T.IntegerType()),
])


@dataclass(frozen=True)
class Thresholds:
    """Numbers the rules use; all become literals in the plan."""

    number_confidence: float = 50.0
    realistic_factor: int = 3
    outlier_factor: int = 5
    contents_numbers: int = 5
    protected_pages: int = 5
    auto_order_minimum: float = 90.0
    refine_below: float = 0.7
    strong_relation: float = 0.7
    similarity_minimum: float = 0.3


THRESHOLDS = Thresholds()

# Fixed value: words that carry no meaning for continuity and similarity.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "can", "this", "that", "these", "those",
    "i", "you", "he", "she", "it", "we", "they",
]

# The 18 scan regions in edge-first order.
REGIONS = [
    "edge_top_left", "edge_top_right", "edge_bottom_left", "edge_bottom_right",
    "edge_top_center", "edge_bottom_center",
    "full_edge_top", "full_edge_bottom", "full_edge_left", "full_edge_right",
    "top_left", "top_right", "bottom_left", "bottom_right",
    "bottom_center", "top_center", "middle_left", "middle_right",
]

# Weight of a region; any other region weighs 0.5.
REGION_WEIGHTS = {
    "top_right": 1.0, "bottom_center": 0.95, "top_left": 0.9, "bottom_right": 0.85,
    "bottom_left": 0.85, "top_center": 0.6, "middle_right": 0.4, "middle_left": 0.3,
}
REGION_WEIGHT_DEFAULT = 0.5

# Scan order while a number type is still being learned.
ROMAN_SCAN_ORDER = [
    "edge_top_left", "edge_top_right", "edge_top_center", "full_edge_top",
    "edge_bottom_left", "edge_bottom_right", "full_edge_left", "full_edge_right",
    "top_left", "top_right", "bottom_center", "top_center",
    "middle_left", "middle_right", "bottom_left", "bottom_right",
]
ARABIC_SCAN_ORDER = [
    "edge_top_right", "edge_bottom_right", "edge_top_left", "edge_bottom_center",
    "edge_top_center", "full_edge_top", "full_edge_bottom", "full_edge_right",
    "bottom_center", "top_center", "top_left", "top_right",
    "bottom_left", "bottom_right", "middle_left", "middle_right",
]

# Image file extensions the collection scan accepts.
IMAGE_EXTENSIONS = [
    "png", "jpg", "jpeg", "jpe", "jfif", "tiff", "tif", "bmp", "dib", "webp", "gif", "ico",
    "ppm", "pgm", "pbm", "pnm", "pcx", "tga", "icb", "vda", "vst",
    "jp2", "j2k", "jpf", "jpx", "jpm", "heic", "heif",
]
DOCUMENT_EXTENSIONS = ["pdf"]
