"""What is remembered, read from a log of imports that is only ever appended to.

``log`` rows: batch (number of the import), row (place in it), mode, section, name, key, value.
Every import ends in one marker (row -1) that carries its mode, so an import without
any rows still replaces or clears:

* ``merge``: corrections are appended, patterns (name, key) and preferences (key) overwrite;
* ``replace``: nothing before the import counts any more;
* ``clear``: nothing before it in the section named counts any more, ``all`` for every section.

A batch written again under its number, wholly or in part, changes nothing. Imports count in the
order of their numbers, not in the order they were written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SECTIONS = ("corrections", "patterns", "preferences")
LOG = "batch long, row long, mode string, section string, name string, key string, value string"
MARKER = -1
EXAMPLES_KEPT = 50


def mark(spark: SparkSession, batch: int, mode: str = "merge", section: str = "all") -> DataFrame:
    """The marker of one import; ``section`` is what ``clear`` empties."""
    if mode not in ("merge", "replace", "clear") or section not in (*SECTIONS, "all"):
        raise ValueError(f"{mode} of {section}")
    nothing = F.lit(None).cast("string")
    return spark.range(1).select(
        F.lit(batch).cast("long").alias("batch"), F.lit(MARKER).cast("long").alias("row"), F.lit(mode).alias("mode"),
        F.lit(section).alias("section"), nothing.alias("name"), nothing.alias("key"), nothing.alias("value"))


def import_batch(rows: DataFrame, batch: int, mode: str = "merge") -> DataFrame:
    """Log rows of one import of ``rows`` (row, section, name, key, value), to be appended to the log."""
    return rows.select(
        F.lit(batch).cast("long").alias("batch"), F.col("row").cast("long").alias("row"), F.lit(mode).alias("mode"),
        "section", "name", "key", "value").unionByName(mark(rows.sparkSession, batch, mode))


def _live(log: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """Rows after the last import that emptied their section; one row of numbers says which that is."""
    marks = log.where(F.col("row") == MARKER)

    def since(section: str) -> Column:
        empties = (F.col("mode") == "replace") | ((F.col("mode") == "clear") & F.col("section").isin("all", section))
        # a cleared batch has no rows of its own, so "from it on" is right for both modes
        return F.coalesce(marks.where(empties).agg(F.max("batch")).scalar(), F.lit(-(2**63)).cast("long"))

    counts = F.lit(False)
    for section in sections:
        counts = counts | ((F.col("section") == section) & (F.col("batch") >= since(section)))
    return log.where((F.col("row") != MARKER) & counts)


def remembered(log: DataFrame) -> DataFrame:
    """Patterns and preferences as they stand: section, name, key, value.

    The last row in (batch, row) wins, the greatest value where that is repeated with another one. A null
    key is a key of its own. Values are reduced before the shuffle, so a hot key leaves one row per task.
    """
    return (_live(log, ("patterns", "preferences")).groupBy("section", "name", "key")
            .agg(F.max(F.struct("batch", "row", "value")).alias("_last"))
            .select("section", "name", "key", "_last.value"))


def corrections(log: DataFrame) -> DataFrame:
    """All corrections that count, each (batch, row) once: batch, row, name, key, value."""
    return (_live(log, ("corrections",)).groupBy("batch", "row")
            .agg(F.max(F.struct("name", "key", "value")).alias("_c")).select("batch", "row", "_c.*"))


def correction_patterns(corrections: DataFrame, keep: int = EXAMPLES_KEPT) -> DataFrame:
    """How often each type of correction was made, with its newest examples, newest first.

    ``corrections``: correction_type, position_change, confidence, corrected_at, seq. All are counted; the rank limit
    reaches the map side, so a task sends at most ``keep`` rows a type and an example list is bounded.
    """
    newest = Window.partitionBy("correction_type").orderBy(F.desc_nulls_last("corrected_at"), F.desc("seq"))
    examples = (corrections.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep)
                .groupBy("correction_type").agg(F.sort_array(F.collect_list(
                    F.struct("_n", "seq", "position_change", "confidence", "corrected_at"))).alias("_e")))
    counts = corrections.groupBy("correction_type").agg(F.count("*").alias("corrections"))
    drawn = F.transform("_e", lambda e: F.struct(
        e["seq"].alias("seq"), e["position_change"].alias("position_change"), e["confidence"].alias("confidence"),
        e["corrected_at"].alias("corrected_at")))
    # null-safe: corrections without a type are a type of their own
    both = counts.join(F.broadcast(examples.withColumnRenamed("correction_type", "_t")),
                       F.col("correction_type").eqNullSafe(F.col("_t")))
    return both.select("correction_type", "corrections", drawn.alias("examples"))
