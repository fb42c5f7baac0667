"""Past runs, results kept by content key, and corrections people made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans import ranks
from quire.plans.session import fix

# Settings counted as features.
FEATURES = ["preprocessing", "auto_rotate", "auto_crop", "clean_circles", "blank_removal", "compression"]
DEFAULT_SECONDS_PER_PAGE = 5.0


def session_metrics(sessions: DataFrame) -> DataFrame:
    """Totals over successful sessions; a default pace until there are any."""
    ok = F.col("success")
    pages, seconds = F.sum(F.when(ok, F.col("pages"))), F.sum(F.when(ok, F.col("seconds")))
    return sessions.agg(
        F.count("*").alias("sessions"), F.count_if(ok).alias("documents"),
        F.coalesce(pages, F.lit(0)).alias("pages"), F.coalesce(seconds, F.lit(0.0)).alias("seconds"),
        F.coalesce(F.when(pages > 0, seconds / pages), F.lit(DEFAULT_SECONDS_PER_PAGE)).alias("seconds_per_page"))


def feature_usage(sessions: DataFrame) -> DataFrame:
    """How often each feature was used, its share of all uses, and what follows from it."""
    counts = sessions.agg(*[F.count_if(F.col(name)).alias(name) for name in FEATURES])
    total = sum((F.col(name) for name in FEATURES[1:]), F.col(FEATURES[0]))
    rows = counts.select(total.alias("_total"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("feature"), F.col(name).alias("uses")) for name in FEATURES])).alias("_f"))
    share = F.col("_f.uses") / F.greatest(F.col("_total"), F.lit(1))
    name = F.col("_f.feature")
    advice = (F.when((name == "preprocessing") & (share > 0.5), "recommend preprocessing")
              .when((name == "preprocessing") & (share < 0.2), "most users disable preprocessing")
              .when((name == "compression") & (share > 0.6), "recommend compression"))
    return rows.select("_f.feature", "_f.uses", share.alias("share"), advice.alias("advice"))


def size_category(pages: Column) -> Column:
    return (F.when(pages < 50, "small").when(pages < 200, "medium").when(pages < 500, "large")
            .otherwise("very_large"))


def size_categories(sessions: DataFrame) -> DataFrame:
    return (sessions.where("success").groupBy(size_category(F.col("pages")).alias("category"))
            .agg(F.count("*").alias("documents"), F.avg("seconds").alias("mean_seconds")))


def recommended_settings(documents: DataFrame) -> DataFrame:
    """Settings by document size."""
    pages = F.col("pages")
    return documents.withColumns({
        "category": size_category(pages), "compression": pages > 100, "fast_mode": pages > 200,
        "blank_removal": F.lit("start_end"),
        "hint": F.when(pages > 400, "Large document: enable fast mode")})


def recent_sessions(sessions: DataFrame, keep: int = 100) -> DataFrame:
    """The newest sessions of each user; the limit reaches the map side."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("session_id"))
    return sessions.withColumn("age_rank", F.row_number().over(newest)).where(F.col("age_rank") <= keep)


def running_time(sessions: DataFrame, wide: bool | None = None) -> DataFrame:
    """Mean seconds of the sessions of a size class up to each session."""
    rows = sessions.where("success").withColumn("category", size_category(F.col("pages")))
    wide = ranks.settle_width(rows, ["category"], wide)
    rows = ranks.number_rows(rows, ["category"], ["ts", "session_id"], "nth", wide)
    rows = ranks.running(rows, ["category"], "nth", {"_sum": ("sum", F.col("seconds").cast("decimal(18,4)"))}, wide)
    return rows.withColumn("mean_seconds", F.col("_sum").cast("double") / F.col("nth")).drop("_sum")


def time_estimate(jobs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Minutes a job will take at the learned pace."""
    pace = session_metrics(sessions).select("seconds_per_page").scalar()

    def times(feature: str, factor: float) -> Column:
        return F.when(F.col(feature), factor).otherwise(1.0)

    factor = times("preprocessing", 1.4) * times("auto_crop", 1.1) * times("clean_circles", 1.2)
    return jobs.withColumn("minutes", F.col("pages") * pace * factor / 60)


def session_windows(sessions: DataFrame, length: str = "1 day", slide: str | None = None) -> DataFrame:
    """Metrics per time window; works on a batch and, with a watermark, on a stream."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (sessions.groupBy(window).agg(
        F.count("*").alias("sessions"), F.count_if("success").alias("documents"),
        F.sum(F.when(F.col("success"), F.col("pages"))).alias("pages"),
        F.sum(F.when(F.col("success"), F.col("seconds"))).alias("seconds"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "sessions", "documents", "pages", "seconds"))


def new_pages(pages: DataFrame, processed: DataFrame) -> DataFrame:
    """Pages whose content key has no stored result."""
    return pages.join(processed.select("content_key"), ["content_key"], "left_anti")


def stored_results(pages: DataFrame, processed: DataFrame) -> DataFrame:
    return pages.join(processed, ["content_key"])


def reuse_stats(pages: DataFrame, processed: DataFrame) -> DataFrame:
    """Hits, misses, rate, and the number and size of stored results."""
    hit = pages.join(processed.select("content_key").distinct().withColumn("_hit", F.lit(True)), ["content_key"], "left")
    stored = processed.agg(F.count_distinct("content_key").alias("items"), F.sum("size").alias("stored_size"))
    counts = hit.agg(F.count_if(F.col("_hit")).alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"))
    return counts.select("hits", "misses", (F.col("hits") / (F.col("hits") + F.col("misses")) * 100).alias("hit_rate"),
                         stored.select("items").scalar().alias("items"),
                         stored.select("stored_size").scalar().alias("stored_size"))


def expire(processed: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Stored results younger than ``days``."""
    return processed.where(F.col("created") >= now - F.make_interval(days=F.lit(days)))


def duplicate_pages(pages: DataFrame, wide: bool | None = None) -> DataFrame:
    """Later page -> first page of the book with the same content."""
    keyed = pages.select("book_id", "scan_index", F.md5("full_text").alias("content_key"))
    first = keyed.groupBy("book_id", "content_key").agg(
        F.min("scan_index").alias("first_page"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = ranks.attach(keyed, first, ["book_id", "content_key"], "scan_index", wide)
    return rows.where(F.col("scan_index") > F.col("first_page")).select("book_id", "scan_index", "first_page")


def correction_class(change: Column) -> Column:
    size = F.abs(change)
    return (F.when(size == 0, "no_change").when(size == 1, "minor_adjustment")
            .when(size <= 5, "moderate_adjustment").otherwise("major_adjustment"))


def record_corrections(corrections: DataFrame) -> DataFrame:
    """Change and class of corrections, ready to append. Needs original_position, corrected_position."""
    change = F.col("corrected_position") - F.col("original_position")
    return corrections.withColumns({"position_change": change, "correction_type": correction_class(change)})


def correction_stats(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("correction_type").agg(
        F.count("*").alias("corrections"), F.min("corrected_at").alias("first_at"),
        F.max("corrected_at").alias("last_at"), F.date_diff(F.max("corrected_at"), F.min("corrected_at")).alias("age_days"))


def common_changes(corrections: DataFrame, keep: int = 5) -> DataFrame:
    """The most frequent position changes; the first seen wins ties."""
    return (corrections.groupBy("position_change").agg(F.count("*").alias("corrections"), F.min("seq").alias("_first"))
            .orderBy(F.desc("corrections"), "_first").limit(keep).drop("_first"))


def _stem(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(.)\.[^.]*$", "$1"))


def _alike(asking: DataFrame, stored: DataFrame) -> DataFrame:
    """Which stored prefixes (``_prefix``) fit each asking one: equal, or the shorter a whole name that opens the other."""
    def cut(column: Column) -> Column:
        return F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.lit(5)), lambda n: n <= F.length(column)),
                                     lambda n: F.substring(column, F.lit(1), n)))

    left = asking.select("prefix", cut(F.col("prefix")).alias("_cut"))
    right = stored.select(F.col("prefix").alias("_prefix"), cut(F.col("prefix")).alias("_cut"))
    size = F.length("_cut")
    return left.join(right, "_cut").where((size == F.length("prefix")) | (size == F.length("_prefix"))).select("prefix", "_prefix")


def suggest_positions(pages: DataFrame, corrections: DataFrame, minimum: int = 3) -> DataFrame:
    """Suggested position from similar corrections: the most common change, first seen on ties.

    Similar means equal first five characters of the name, first numbers within 3,
    or original position within 2. Corrections are counted per (prefix, number, position,
    change) first. Prefix and position are combined by inclusion and exclusion over the
    distinct (prefix, position) of the pages; what only the number meets is added from the
    counts at the numbers around, so no page is ever paired with single corrections and the
    big joins stay off the driver.

    ``pages``: page_id, page_name, position. ``corrections``: page_name,
    original_position, position_change, seq.
    """
    def keyed(name: Column) -> dict[str, Column]:
        return {"prefix": F.substring(_stem(name), 1, 5),
                "num": F.regexp_extract(_stem(name), "([0-9]+)", 1).try_cast("long")}

    history = corrections.select(
        *[c.alias(k) for k, c in keyed(F.col("page_name")).items()],
        F.col("original_position").cast("long").alias("pos"), "position_change", "seq")
    history = fix(history.groupBy("prefix", "num", "pos", "position_change").agg(
        F.count("*").alias("_n"), F.min("seq").alias("_seen")))
    # nothing in these keys is null, so that pages without number or position keep their prefix
    pair_key = F.concat_ws("\u0001", F.coalesce("prefix", F.lit("")), F.coalesce(F.col("pos").cast("string"), F.lit("-")))
    ask_key = F.concat_ws("\u0001", pair_key, F.coalesce(F.col("num").cast("string"), F.lit("-")))
    asks = fix(pages.select(
        *[c.alias(k) for k, c in keyed(F.col("page_name")).items()], F.col("position").cast("long").alias("pos")).distinct()
        .withColumns({"_ask": ask_key, "_pair": pair_key}))
    pairs = asks.select("_pair", "prefix", "pos").distinct()
    change, totals = "position_change", (F.sum("_n").alias("_n"), F.min("_seen").alias("_seen"))

    near = pairs.select("pos").distinct().select("pos", F.explode(F.sequence(F.col("pos") - 2, F.col("pos") + 2)).alias("_pos"))
    at = history.groupBy("prefix", "pos", change).agg(*totals)
    alike = _alike(pairs.select("prefix").distinct(), at.select("prefix").distinct())
    of_prefix = alike.join(at.withColumnRenamed("prefix", "_prefix"), "_prefix")
    by_prefix = of_prefix.groupBy("prefix", change).agg(*totals)
    by_pos = near.join(at.select(F.col("pos").alias("_pos"), change, "_n", "_seen"), "_pos").groupBy("pos", change).agg(*totals)
    by_both = (near.join(of_prefix.groupBy("prefix", F.col("pos").alias("_pos"), change).agg(*totals), "_pos")
               .groupBy("prefix", "pos", change).agg(*totals))
    parts = [pairs.join(by_prefix, ["prefix"]), pairs.join(by_pos, ["pos"]),
             pairs.join(by_both.withColumn("_n", -F.col("_n")), ["prefix", "pos"])]
    union = parts[0].select("_pair", change, "_n", "_seen")
    for part in parts[1:]:
        union = union.unionByName(part.select("_pair", change, "_n", "_seen"))
    per_pair = union.groupBy("_pair", change).agg(*totals)

    around = asks.where(F.col("num").isNotNull()).withColumn("_num", F.explode(F.sequence(F.col("num") - 3, F.col("num") + 3)))
    counted = history.where(F.col("num").isNotNull()).select(
        F.col("num").alias("_num"), F.col("prefix").alias("_prefix"), F.col("pos").alias("_pos"), change, "_n", "_seen")
    met = around.hint("merge").join(counted, "_num")
    one, other = F.col("prefix"), F.col("_prefix")
    same_prefix = (F.length(one) > 0) & (F.length(other) > 0) & (one.startswith(other) | other.startswith(one))
    same_place = F.abs(F.col("pos") - F.col("_pos")) <= 2
    by_num = met.where(~F.coalesce(same_prefix, F.lit(False)) & ~F.coalesce(same_place, F.lit(False)))
    per_change = (by_num.select("_ask", change, "_n", "_seen")
                  .unionByName(asks.join(per_pair, "_pair").select("_ask", change, "_n", "_seen"))
                  .groupBy("_ask", change).agg(*totals))
    best = per_change.groupBy("_ask").agg(
        F.sum("_n").alias("similar"),
        F.min_by("position_change", F.struct(-F.col("_n"), "_seen")).alias("change")).where(F.col("similar") >= minimum)
    rows = pages.withColumns({**keyed(F.col("page_name")), "pos": F.col("position").cast("long")}).withColumn("_ask", ask_key)
    return rows.hint("merge").join(best, ["_ask"]).select(
        "page_id", "page_name", "position", "similar", (F.col("position") + F.col("change")).alias("suggested"))


def pattern_preferences(patterns: DataFrame, keep: int = 5, minimum: int = 3) -> DataFrame:
    """Numbering patterns by success rate: the top five, of which those used often enough."""
    rated = patterns.groupBy("pattern_type", "scheme").agg(
        F.count("*").alias("uses"), F.count_if(F.col("rate") > 0.7).alias("successes"),
        F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_used"))
    rated = rated.withColumn("success_rate", F.col("successes") / F.col("uses"))
    return (rated.orderBy(F.desc("success_rate"), F.desc("uses"), "pattern_type", "scheme").limit(keep)
            .where(F.col("uses") >= minimum))


def preprocessing_effectiveness(uses: DataFrame, minimum: int = 3) -> DataFrame:
    """Mean improvement per set of enabled options; ``best`` marks the most effective with enough uses."""
    enabled = F.array_join(F.map_keys(F.map_filter("options", lambda _, on: on)), "_")
    rated = uses.groupBy(enabled.alias("options")).agg(
        F.avg("improvement").alias("mean_improvement"), F.count("*").alias("uses"))
    top = rated.where(F.col("uses") >= minimum).agg(
        F.max_by("options", "mean_improvement").alias("best")).select("best").scalar()
    return rated.withColumn("best", F.coalesce(F.col("options") == top, F.lit(False)))


def latest_preferences(preferences: DataFrame) -> DataFrame:
    return preferences.groupBy("key").agg(
        F.max_by("value", F.struct("updated", "seq")).alias("value"), F.max("updated").alias("updated"))


def memory_merge(stored: DataFrame, imported: DataFrame) -> DataFrame:
    """Keyed import: the imported value wins, keys of either side stay."""
    both = stored.withColumn("_from", F.lit(0)).unionByName(imported.withColumn("_from", F.lit(1)))
    return both.groupBy("key").agg(F.max_by("value", F.struct("_from", "updated", "seq")).alias("value"))
