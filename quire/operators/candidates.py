"""From text boxes to one page number per page.

Boxes are placed in scan regions, numbers in them scored, and the best one is
kept, checked against the page count and accepted. Confidence is 0-100;
``score_scale`` 1 is the intended score, 100 the one where every base score
reaches the cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.functions.numerals import number_type, roman_text, roman_value, written_roman
from quire.schemas import REGION_WEIGHT_DEFAULT, REGION_WEIGHTS

PAGE = ["book_id", "scan_index"]
CAP = 99.9

# Words that show a text is content, not a page number.
CONTENT_WORDS = "page|chapter|section|figure|table|the|and|of"


def region_assign(blocks: DataFrame) -> DataFrame:
    """One row per block and scan region that holds the centre of its box. Needs page_width, page_height."""
    x, y = F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2
    found = geometry.regions_of(x, y, F.col("page_width"), F.col("page_height"))
    return blocks.withColumn("_r", F.explode(found)).select("*", "_r.scan_rank", "_r.region").drop("_r")


def plausible_text(text: Column) -> Column:
    """Short text without content words."""
    return (F.regexp_count(text, F.lit(r"\S+")) <= 5) & ~F.lower(text).rlike(CONTENT_WORDS)


def _has(part: str) -> Column:
    return F.col("region").contains(part)


def _first(*rules: tuple[Column, float]) -> Column:
    """Value of the first rule that holds, else 0."""
    expr = F.lit(0.0)
    for condition, value in reversed(rules):
        expr = F.when(condition, float(value)).otherwise(expr)
    return expr


def _arabic_matches() -> Column:
    found = F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_])([0-9]{1,3})(?![\p{L}\p{N}_])"), F.lit(1))
    return F.transform(found, lambda m: F.struct(
        F.lit("arabic").alias("kind"), m.alias("candidate"), m.try_cast("int").alias("number")))


def _roman_matches() -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}_])([ivxlcdm]{1,10})(?![\p{L}\p{N}_])"), F.lit(1)))
    return F.transform(found, lambda m: F.struct(F.lit("roman").alias("kind"), m.alias("candidate"), roman_value(m).alias("number")))


def _arabic_score(score_scale: float) -> Column:
    region = F.col("region")
    base = F.col("conf") * score_scale * 0.9
    doubtful = (F.col("number") > 200) & ~region.isin("top_left", "top_right", "top_center", "bottom_center")
    place = _first(
        (region.isin("edge_top_left", "edge_top_right", "edge_bottom_right"), 55),
        (region.startswith("edge_"), 40), (region.startswith("full_edge_"), 30),
        (region.isin("top_left", "top_right"), 25), (region.isin("top_center", "bottom_center"), 15), (_has("top"), 10))
    return (F.when(doubtful, base * 0.4).otherwise(base) + place + _first((_has("right"), 5))
            + _first((F.col("text") == F.col("candidate"), 10)))


def _roman_score(score_scale: float) -> Column:
    region, one, size = F.col("region"), F.col("candidate"), F.length("candidate")
    edge = _first((region.startswith("edge_") & _has("top"), 55), (region.startswith("edge_"), 45),
                  (region.startswith("full_edge_"), 35), (region.isin("top_left", "top_right"), 30),
                  (region == "top_center", 20))
    return (F.col("conf") * score_scale * 0.95 + edge + _first((size >= 3, 15), (size == 2, 10))
            + _first((_has("top"), 10)) + _first((_has("left"), 5)) + _first((F.lower("text") == one, 15)))


def _roman_stands() -> Column:
    """A numeral 1..50 that is no stray letter and not part of a longer valid one of its text."""
    one, size = F.col("candidate"), F.length("candidate")
    alone = (size > 1) | (one == "x") | (one.isin("i", "v") & (F.length("text") <= 3))
    longer = (F.size("_all") > 1) & F.exists("_all", lambda o: (
        (o["kind"] == "roman") & (F.length(o["candidate"]) > size) & o["candidate"].contains(one)
        & o["number"].between(1, 50)))
    return F.col("number").between(1, 50) & alone & ~longer


def _scored(boxes: DataFrame, matches: Column, score_scale: float) -> DataFrame:
    """Candidates of the given matches: kind, candidate, number and capped score.

    ``boxes`` may still lack their regions; then each text is read once, not once per region
    that its box lies in, and only boxes with candidates are placed.
    """
    arabic = F.col("kind") == "arabic"
    rows = (boxes.withColumn("text", F.btrim("text", F.lit(" \t\r\n"))).where(plausible_text(F.col("text")))
            .withColumn("_all", matches)
            .select("*", F.posexplode("_all").alias("cand_ord", "_c"))
            .select("*", "_c.kind", "_c.candidate", "_c.number"))
    rows = rows.where(F.when(arabic, F.col("number").between(1, 999)).otherwise(_roman_stands())).drop("_all", "_c")
    if "region" not in boxes.columns:
        rows = region_assign(rows)
    score = F.when(arabic, _arabic_score(score_scale)).otherwise(_roman_score(score_scale))
    return rows.withColumn("confidence", F.least(score, F.lit(CAP)))


def score_arabic(boxes: DataFrame, score_scale: float = 1.0) -> DataFrame:
    """Candidates of 1 to 3 digits, scored by place."""
    return _scored(boxes, _arabic_matches(), score_scale)


def score_roman(boxes: DataFrame, score_scale: float = 1.0) -> DataFrame:
    """Roman candidates 1..50; a numeral inside a longer valid one of the same text is dropped."""
    return _scored(boxes, _roman_matches(), score_scale)


def edge_boost() -> Column:
    """Points for closeness to the page's edge, sides chosen by the region's name."""
    left, right = F.col("left"), F.col("page_width") - F.col("left") - F.col("width")
    top, bottom = F.col("top"), F.col("page_height") - F.col("top") - F.col("height")
    across = F.when(_has("left"), left).when(_has("right"), right).otherwise(F.least(left, right))
    down = F.when(_has("top"), top).when(_has("bottom"), bottom).otherwise(F.least(top, bottom))
    gap = F.least(across, down)
    return F.when(gap <= 10, 30).when(gap <= 25, 20).when(gap <= 50, 10).when(gap <= 100, 5).otherwise(0)


def region_weight(region: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in REGION_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(weights, region), F.lit(REGION_WEIGHT_DEFAULT))


def candidates(boxes: DataFrame, score_scale: float = 1.0) -> DataFrame:
    """All scored candidates in one pass; ``place`` orders them as the scan meets them."""
    both = _scored(boxes, F.concat(_arabic_matches(), _roman_matches()), score_scale)
    met = F.struct("scan_rank", "block_index", (F.col("kind") == "roman").alias("second"),
                   F.when(F.col("kind") == "roman", -F.length("candidate")).otherwise(0).alias("longest"), "cand_ord")
    return both.withColumn("confidence", F.col("confidence") + edge_boost()).withColumn("place", met)


def early_exit(found: DataFrame, sure: float = 95.0) -> DataFrame:
    """Drop the regions scanned after the first one whose first candidate is sure."""
    heads = found.groupBy(*PAGE, "scan_rank").agg(F.min_by("confidence", "place").alias("_first"))
    stop = heads.groupBy(*PAGE).agg(F.min(F.when(F.col("_first") >= sure, F.col("scan_rank"))).alias("_stop"))
    return (found.join(stop, PAGE)
            .where(F.col("_stop").isNull() | (F.col("scan_rank") <= F.col("_stop"))).drop("_stop"))


def best_candidate(found: DataFrame, sure: float = 95.0) -> DataFrame:
    """The candidate with the highest weighted confidence up to the early exit; the first met on ties.

    Each region is first reduced to its first and its best candidate, so at most
    18 rows per page reach the second step, and candidates are read once.
    """
    weighted = found.withColumn("weighted", F.col("confidence") * region_weight(F.col("region")))
    order = F.struct((-F.col("weighted")).alias("low"), "place")
    regions = weighted.groupBy(*PAGE, "scan_rank").agg(
        F.min_by("confidence", "place").alias("_first"), F.min(order).alias("_order"),
        F.min_by(F.struct("candidate", "number", "kind", "region", "weighted"), order).alias("_best"))
    listed = regions.groupBy(*PAGE).agg(
        F.min(F.when(F.col("_first") >= sure, F.col("scan_rank"))).alias("_stop"),
        F.collect_list(F.struct("_order", "scan_rank", "_best")).alias("_all"))
    kept = F.filter("_all", lambda r: F.col("_stop").isNull() | (r["scan_rank"] <= F.col("_stop")))
    return listed.withColumn("_pick", F.array_min(kept)["_best"]).select(
        *PAGE, F.col("_pick.candidate").alias("text"), "_pick.number", "_pick.kind", "_pick.region",
        F.col("_pick.weighted").alias("confidence"))


def repair_numbers(best: DataFrame, total_pages: Column | None = None) -> DataFrame:
    """Two-digit numbers far above the page count become their first or second digit."""
    total = F.lit(100) if total_pages is None else F.coalesce(total_pages, F.lit(100))
    roman = F.lower("text").isin([written_roman(k) for k in range(1, 21)])
    suspicious = ~roman & (F.col("number") > 1.5 * total) & F.col("number").between(10, 99)
    first, second = F.floor(F.col("number") / 10).cast("int"), F.col("number") % 10
    fixed = F.when(suspicious & first.between(1, total), first).when(suspicious & second.between(1, total), second)
    return best.withColumns({
        "number": F.coalesce(fixed, F.col("number")),
        "text": F.coalesce(fixed.cast("string"), F.col("text")),
        "confidence": F.when(fixed.isNotNull(), F.col("confidence") * 0.8).otherwise(F.col("confidence")),
        "repaired": fixed.isNotNull()})


def expected_type(position: Column, dominant: Column) -> Column:
    """Hint which kind to look for: what was learned, else by position."""
    return F.coalesce(dominant, F.when(position.between(6, 16), "roman").when(position > 16, "arabic"))


def name_fallback(pages: DataFrame) -> DataFrame:
    """Number guessed from ``Page_nnn`` in the file name, confidence 60."""
    n = F.regexp_extract("original_name", "Page_([0-9]{3,4})", 1).try_cast("int")
    number = F.when(n.between(6, 12), n).when(n > 50, n - 12)
    text = F.when(n.between(6, 12), roman_text(n)).otherwise((n - 12).cast("string"))
    return pages.withColumns({"number": number, "text": text, "confidence": F.lit(60.0)}).where(
        F.col("number").isNotNull())


def accept(best: DataFrame, minimum: float = 50.0, upper: int = 15) -> DataFrame:
    """Detected numbers: kept above the minimum, typed by the written numeral."""
    return best.where(F.col("confidence") > minimum).select(
        *PAGE, F.lit(0).alias("ord"), "text", number_type(F.col("text"), upper).alias("number_type"),
        F.col("number").alias("numeric_value"), "confidence")


def prediction_gate(predictions: DataFrame, classes: list[str], minimum: float = 0.5) -> DataFrame:
    """Best class of a probability array; ``none`` or a low share gives no label."""
    share = F.array_max("probabilities")
    label = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("probabilities", share).cast("int"))
    return predictions.withColumns({
        "share": share, "label": F.when((label != "none") & (share >= minimum), label)})


def best_corner(gated: DataFrame, keys: list[str], minimum: float = 0.5) -> DataFrame:
    """The corner with the highest share, when above the minimum; else no label."""
    best = gated.groupBy(*keys).agg(F.max_by(F.struct("label", "share"), F.struct(
        F.when(F.col("label").isNotNull(), F.col("share")).otherwise(-1.0), -F.col("corner"))).alias("_b"))
    ok = F.col("_b.label").isNotNull() & (F.col("_b.share") > minimum)
    return best.select(*keys, F.when(ok, F.col("_b.label")).alias("label"), F.col("_b.share").alias("share"))
