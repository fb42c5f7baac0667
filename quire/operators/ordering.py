"""From detected numbers to one unique position per page.

``decisions`` columns: book_id, scan_index, original_name, rule,
assigned_position, confidence, has_number, number_type, numeric_value,
number_mean, number_values, alternative_positions.

Every function keys on ``book_id``; ``wide`` says whether one book may be too
large for one task (see :mod:`quire.plans.ranks`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans import ranks
from quire.plans.session import fix
from quire.schemas import THRESHOLDS, Thresholds

BOOK = ["book_id"]


def page_numbers(pages: DataFrame, detected: DataFrame, wide: bool | None = None) -> DataFrame:
    """One row per page with its first number and a summary of all its numbers."""
    first = F.min_by(F.struct("number_type", "numeric_value", "confidence"), "ord")
    per_page = detected.groupBy("book_id", "scan_index").agg(
        first.alias("_first"),
        F.count("*").alias("number_count"),
        F.avg("confidence").alias("number_mean"),
        F.sort_array(F.collect_set("numeric_value")).alias("number_values"),
    )
    # from the values themselves: a distinct count beside other aggregates doubles the rows and groups them twice
    per_page = per_page.withColumn("distinct_count", F.size(F.filter("number_values", lambda v: v != 0)))
    return ranks.dealt(pages, ["book_id", "scan_index"], wide).join(per_page, ["book_id", "scan_index"], "left").select(
        "book_id", "scan_index", "original_name",
        F.coalesce("number_count", F.lit(0)).alias("number_count"),
        F.coalesce("distinct_count", F.lit(0)).cast("long").alias("distinct_count"),
        "number_mean", "number_values",
        F.col("_first.number_type").alias("number_type"),
        F.col("_first.numeric_value").alias("numeric_value"),
        F.col("_first.confidence").alias("number_confidence"),
    )


def listed_numbers(pages: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """:func:`page_numbers` of pages that hold their numbers in list order (``numbers``: number_type,
    numeric_value, confidence), so that nothing is joined; columns named in ``carry`` go along."""
    numbers = F.when(F.size("numbers") > 0, F.col("numbers"))
    values = F.filter(F.transform(numbers, lambda n: n["numeric_value"]), lambda v: v.isNotNull())
    sure = F.filter(F.transform(numbers, lambda n: n["confidence"]), lambda v: v.isNotNull())
    rows = pages.withColumns({
        "number_values": F.sort_array(F.array_distinct(values)), "_first": F.get(numbers, F.lit(0)),
        "number_mean": F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, b: a + b) / F.size(sure))})
    return rows.select(
        "book_id", "scan_index", "original_name",
        F.coalesce(F.size(numbers), F.lit(0)).cast("long").alias("number_count"),
        F.coalesce(F.size(F.filter("number_values", lambda v: v != 0)), F.lit(0)).cast("long").alias("distinct_count"),
        "number_mean", "number_values",
        F.col("_first.number_type").alias("number_type"),
        F.col("_first.numeric_value").alias("numeric_value"),
        F.col("_first.confidence").alias("number_confidence"), *carry)


def _reliable(t: Thresholds) -> Column:
    """A first number that is sure enough; a null value counts as no number."""
    return F.coalesce((F.col("number_confidence") >= t.number_confidence)
                      & F.col("numeric_value").isNotNull(), F.lit(False))


def _is_roman() -> Column:
    return F.coalesce(F.col("number_type") == "roman", F.lit(False))


def _context_facts(t: Thresholds) -> dict[str, Column]:
    """Aggregates over all pages of a book; expects ``total_pages`` on each page."""
    plausible = ((F.col("numeric_value") <= t.realistic_factor * F.col("total_pages"))
                 & (F.col("numeric_value") <= t.outlier_factor * (F.col("scan_index") + 1)))
    roman = _reliable(t) & _is_roman()
    arabic = _reliable(t) & ~_is_roman() & plausible
    neither = ~(roman | arabic)
    value = F.col("numeric_value")
    return {
        "roman_count": F.count_if(roman),
        "arabic_count": F.count_if(arabic),
        "unnumbered_count": F.count_if(neither),
        "max_roman_value": F.max(F.when(roman, value)),
        "min_roman_value": F.min(F.when(roman, value)),
        "max_arabic_value": F.max(F.when(arabic, value)),
        "min_arabic_value": F.min(F.when(arabic, value)),
        "front_matter": F.count_if(neither & (F.col("scan_index") < t.protected_pages)),
    }


def book_context(numbered: DataFrame, wide: bool | None = None,
                 t: Thresholds = THRESHOLDS) -> DataFrame:
    """What kind of numbering each book has, over all its pages."""
    wide = ranks.settle_width(numbered, BOOK, wide)
    pages = ranks.with_totals(numbered, BOOK, {"total_pages": F.count(F.lit(1))}, "scan_index", wide)
    context = pages.groupBy("book_id").agg(
        F.first("total_pages").alias("total_pages"),
        *[value.alias(name) for name, value in _context_facts(t).items()])
    for name in ("max_roman_value", "max_arabic_value"):
        context = context.withColumn(name, F.greatest(F.coalesce(name, F.lit(0)), F.lit(0)))
    for name in ("min_roman_value", "min_arabic_value"):
        context = context.withColumn(name, F.coalesce(name, F.lit(0)))
    front = F.col("front_matter") + F.col("roman_count")
    return context.select(
        "*",
        F.when(F.col("max_roman_value") > 0, F.col("max_roman_value")).otherwise(front).alias("roman_section_end"),
        (front + 1).alias("arabic_section_start"),
    )


def decide(numbered: DataFrame, wide: bool | None = None, t: Thresholds = THRESHOLDS,
           carry: Sequence[str] = ()) -> DataFrame:
    """Desired position and confidence of every page; the first rule that holds wins.

    Columns of ``numbered`` named in ``carry`` go along.
    """
    wide = ranks.settle_width(numbered, BOOK, wide)
    facts = _context_facts(t)
    needed = {name: facts[name] for name in ("roman_count", "front_matter")}
    pages = ranks.with_totals(numbered, BOOK, {"total_pages": F.count(F.lit(1))}, "scan_index", wide)
    pages = ranks.with_totals(pages, BOOK, needed, "scan_index", wide)
    start = F.col("front_matter") + F.col("roman_count") + 1
    own = F.col("scan_index") + 1
    value = F.col("numeric_value")
    rule = (
        F.when((F.col("number_count") >= t.contents_numbers)
               & (F.col("distinct_count") >= t.contents_numbers), "contents")
        .when(own <= t.protected_pages, "protected")
        .when(~_reliable(t), "no_number")
        .when(~_is_roman() & (value > t.realistic_factor * F.col("total_pages")), "unrealistic")
        .when(~_is_roman() & (value > t.outlier_factor * own), "outlier")
        .when(_is_roman(), "roman")
        .otherwise("arabic")
    )
    kept = F.col("rule").isin("roman", "arabic")
    position = (
        F.when(F.col("rule") == "roman", value)
        .when(F.col("rule") == "arabic", start + value - 1)
        .otherwise(own).cast("int")
    )
    confidence = (
        F.when(F.col("rule").isin("contents", "protected"), 0.99)
        .when(F.col("rule") == "no_number", 0.95)
        .when(F.col("rule").isin("unrealistic", "outlier"), 0.4)
        .otherwise(F.least(F.lit(0.95), F.col("number_confidence") / 100.0))
    )
    return pages.withColumn("rule", rule).select(
        "book_id", "scan_index", "original_name", "rule",
        position.alias("assigned_position"),
        confidence.alias("confidence"),
        kept.alias("has_number"),
        F.when(kept, F.col("number_type")).alias("number_type"),
        F.when(kept, value).alias("numeric_value"),
        F.when(kept, F.col("number_mean")).alias("number_mean"),
        F.when(kept, F.col("number_values")).alias("number_values"),
        F.array(position).alias("alternative_positions"), *carry,
    )


def name_matches(name: Column, position: Column) -> Column:
    """True when the first all-digit part of a file name equals the position.

    Parts are split at ``_`` and may end in a 4-character extension, so a
    leading book number is the first candidate and decides alone.
    """
    parts = F.filter(F.split(name, "_"), lambda p: p.rlike(r"^[0-9]+(.{4})?$"))
    number = F.regexp_extract(F.get(parts, F.lit(0)), r"^([0-9]+)(\.(jpg|tif|png))?$", 1).try_cast("decimal(38,0)")
    return F.coalesce(number == position, F.lit(False)) & name.contains("_")


def to_resolve() -> Column:
    """Pages whose wish takes part in conflict resolution; the rest fills gaps."""
    return (F.col("has_number") & (F.col("confidence") >= 0.6)) | (F.col("confidence") >= 0.9)


def _take_slots(rows: DataFrame, wide: bool | None) -> DataFrame:
    """Add ``slot``: the ``rank``-th free position for the rows that ask for one.

    ``_taken`` rows carry ``_below``, the number of free positions below them;
    ``_asks`` rows carry ``rank``. If d_m is the m-th taken position, d_m - m free
    ones lie below it, so the r-th free position is r + #{m : d_m - m < r}: one
    running count over both kinds of rows merged; no position is ever enumerated.
    """
    key = F.when(F.col("_asks"), 2 * F.col("rank")).otherwise(2 * F.col("_below") + 1).cast("long")
    order = ["_key", "scan_index"]
    rows = ranks.number_rows(rows.withColumn("_key", key), BOOK, order, "_turn", wide)
    rows = ranks.running(rows, BOOK, "_turn", {"_skip": ("sum", F.col("_taken").cast("int"))}, wide, order)
    return rows.withColumn("slot", (F.col("rank") + F.col("_skip")).cast("int"))


def allocate(wishes: DataFrame, order: list[Column], wide: bool | None = None,
             part: Column | None = None) -> DataFrame:
    """Give every page of ``wishes`` its own position.

    Per desired position the first page by ``order`` keeps it; the others, in
    (position, order), take the next free position above that nobody desired.
    Adds ``desired`` and ``moved``; ``assigned_position`` becomes unique per book
    among the pages where ``part`` holds; the other pages pass through.

    With losers numbered k and f(p) free positions up to p, loser k gets the free
    position of rank ``k + 1 + max over j <= k of (f(p_j) - j)``; f(p) is p minus
    the number of distinct desired positions up to p.
    """
    wide = ranks.settle_width(wishes, BOOK, wide)
    keep = [c for c in wishes.columns if c != "assigned_position"]
    group = ["book_id", "_part"]
    wish, positive = F.col("desired"), F.greatest("desired", F.lit(0))
    rows = (wishes.withColumnRenamed("assigned_position", "desired")
            .withColumn("_part", F.lit(True) if part is None else part))
    order = ["desired", *order]
    rows = ranks.number_rows(rows, group, order, "_row", wide)
    rows = ranks.last_seen(rows, group, "_row", "desired", "_before", wide, order)
    rows = rows.withColumn("_first", ~wish.eqNullSafe(F.col("_before")))
    rows = ranks.running(rows, group, "_row", {
        "_distinct": ("sum", F.col("_first").cast("int")),
        "_positive": ("sum", (F.col("_first") & (wish >= 1)).cast("int"))}, wide, order)
    rows = rows.withColumns({"_below": positive - F.col("_positive"), "_k": F.col("_row") - F.col("_distinct")})
    rows = ranks.running(rows, group, "_row", {
        "_peak": ("max", F.when(~F.col("_first"), F.col("_below") - F.col("_k")))}, wide, order)
    rows = rows.withColumns({
        "rank": F.col("_k") + 1 + F.col("_peak"),
        "_asks": F.col("_part") & ~F.col("_first"),
        "_taken": F.col("_part") & F.col("_first") & (wish >= 1)})
    rows = _take_slots(rows, wide)
    position = F.when(F.col("_asks"), F.col("slot")).otherwise(wish)
    return rows.select(*keep, "desired", position.alias("assigned_position"), F.col("_asks").alias("moved"))


def _settle(decisions: DataFrame, wide: bool | None) -> DataFrame:
    """All pages; those that take part have unique positions, movers lose confidence."""
    order = [F.desc("confidence"), F.desc("_match"), F.asc("scan_index")]
    wishes = decisions.withColumn("_match", name_matches(F.col("original_name"), F.col("assigned_position")))
    placed = allocate(wishes.withColumn("part", to_resolve()), order, wide, F.col("part")).drop("_match")
    return placed.withColumn(
        "confidence", F.when(F.col("moved"), F.col("confidence") * 0.7).otherwise(F.col("confidence")))


def resolve_conflicts(decisions: DataFrame, wide: bool | None = None) -> DataFrame:
    """Unique positions for the pages that take part."""
    return ranks.by_width(decisions.where(to_resolve()), BOOK, wide, lambda rows, own: _settle(rows, own).drop("part"))


def order_pages(decisions: DataFrame, wide: bool | None = None) -> DataFrame:
    """All pages of all books with unique positions.

    Pages that take no part in conflict resolution go, in scan order, to the
    lowest free positions. ``part`` tells the two kinds apart.
    """
    return ranks.by_width(decisions, BOOK, wide, _order_pages)


def _order_pages(decisions: DataFrame, wide: bool) -> DataFrame:
    rows = _settle(decisions, wide).withColumn("_place", F.col("assigned_position"))
    group, taken = ["book_id", "part"], F.col("part") & (F.col("_place") >= 1)
    rows = rows.withColumn("_order", F.when(F.col("part"), F.col("_place")).otherwise(F.col("scan_index")))
    order = ["_order", "scan_index"]
    rows = ranks.number_rows(rows, group, order, "rank", wide)
    rows = ranks.running(rows, group, "rank", {"_positive": ("sum", taken.cast("int"))}, wide, order)
    rows = rows.withColumns({
        "_below": F.greatest("_place", F.lit(0)) - F.col("_positive"),
        "_asks": ~F.col("part"), "_taken": taken})
    rows = _take_slots(rows, wide)
    position = F.when(F.col("_asks"), F.col("slot")).otherwise(F.col("_place"))
    return rows.withColumns({"assigned_position": position, "moved": position != F.col("desired")}).drop(
        "_place", "_order", "rank", "_positive", "_below", "_asks", "_taken", "_key", "_turn", "_skip", "slot")


def validate_order(ordered: DataFrame, wide: bool | None = None) -> DataFrame:
    """Duplicate positions, steps above 5, and the position range per book."""
    positions = ordered.groupBy("book_id", "assigned_position").agg(F.count("*").alias("_n"))
    steps = ranks.next_seen(positions, BOOK, "assigned_position", "assigned_position", "_next", wide)
    return steps.groupBy("book_id").agg(
        F.sum("_n").alias("pages"),
        F.count_if(F.col("_n") > 1).alias("duplicate_positions"),
        F.count_if(F.col("_next") - F.col("assigned_position") > 5).alias("large_steps"),
        F.min("assigned_position").alias("first_position"),
        F.max("assigned_position").alias("last_position"),
    )


def decide_alone(numbered: DataFrame, detected: DataFrame) -> DataFrame:
    """Older policy: each page on its best number, without book context."""
    best = detected.where(F.col("numeric_value").isNotNull()).groupBy("book_id", "scan_index").agg(
        F.min_by(F.struct("number_type", "numeric_value", "confidence"),
                 F.struct(-F.col("confidence"), "ord")).alias("_best"))
    own = F.col("scan_index") + 1
    sure = F.col("_best.confidence")
    position = F.coalesce("_best.numeric_value", own).cast("long")
    confidence = (
        F.when(sure >= 95, F.least(F.lit(0.95), sure / 100.0))
        .when(sure >= 50, F.least(F.lit(0.8), sure / 100.0))
        .when(sure.isNotNull(), 0.6)
        .when(own <= 5, 0.9).when(own <= 50, 0.6).otherwise(0.3)
    )
    return (numbered.select("book_id", "scan_index", "original_name")
            .join(best, ["book_id", "scan_index"], "left")
            .select("book_id", "scan_index", "original_name",
                    position.alias("assigned_position"), confidence.alias("confidence"),
                    sure.isNotNull().alias("has_number")))


def nearest_free(taken: DataFrame, preferred: DataFrame, wide: bool | None = None,
                 reach: int = 99) -> DataFrame:
    """Free position nearest to ``preferred``: +1, -1, +2, -2, ... within ``reach``; else the largest taken + 1.

    ``taken``: book_id, position. ``preferred``: book_id, position and payload.
    Runs of taken positions are folded to (start, end) islands, so each wish is
    answered from the island around its neighbours instead of by probing.
    """
    wide = ranks.settle_width(taken, BOOK, wide)
    taken = taken.select("book_id", "position").distinct()
    rowed = fix(ranks.running(taken, BOOK, "position", {"_m": ("sum", F.lit(1))}, wide))
    isle = (F.col("position") - F.col("_m")).alias("_isle")
    islands = (rowed.groupBy("book_id", isle)
               .agg(F.min("position").alias("_start"), F.max("position").alias("_end")))
    cells = rowed.select("book_id", "position", isle).join(islands, ["book_id", "_isle"]).drop("_isle")
    last = rowed.groupBy("book_id").agg(F.max("position").alias("_last"))
    above = cells.select("book_id", (F.col("position") - 1).alias("position"), F.col("_end").alias("_above_end"))
    below = cells.select("book_id", (F.col("position") + 1).alias("position"), F.col("_start").alias("_below_start"))
    asks = preferred.join(above, ["book_id", "position"], "left").join(below, ["book_id", "position"], "left")
    asks = ranks.attach(asks, last, BOOK, "position", wide, "left")
    up = F.coalesce(F.col("_above_end") + 1, F.col("position") + 1)
    down = F.coalesce(F.col("_below_start") - 1, F.col("position") - 1)
    up_steps, down_steps = up - F.col("position"), F.col("position") - down
    down_ok = (down > 0) & (down_steps <= reach)
    answer = (
        F.when((up_steps <= reach) & (~down_ok | (up_steps <= down_steps)), up)
        .when(down_ok, down)
        .otherwise(F.coalesce(F.col("_last") + 1, F.col("position")))
    )
    return asks.withColumn("free_position", answer.cast("int")).drop("_above_end", "_below_start", "_last")
