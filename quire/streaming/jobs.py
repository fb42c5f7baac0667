"""Streaming forms: the location learner, session windows, and ingest of new files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators import history
from quire.operators.learner import LEARNER_COLUMNS, LEARNER_STATE, Learner, fold

_SAVED = "places array<bigint>, counts array<bigint>, flags array<boolean>, location string, kind string"
_ROW = ["seq", "location", "hit", "number_type"]
_WAITING = "seq array<bigint>, location array<string>, hit array<boolean>, number_type array<string>"
LEARNER_UPDATES = f"outcome string, {LEARNER_STATE}, seq long, location string, hit boolean, number_type string, at_ms long"
_UPDATE_COLUMNS = ["outcome", *LEARNER_COLUMNS, *_ROW, "at_ms"]


class LearnerProcessor(StatefulProcessor):
    """Keeps one learner per book; emits its state after each micro-batch.

    A row that comes after later ones of its book is folded when it comes: the stream equals the
    batch form for input in order, up to the rows of one Arrow batch. ``ReorderingLearner`` takes
    rows in any order.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("learner", _SAVED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        saved = self.state.get() if self.state.exists() else None
        learner = Learner(tuple(saved) if saved else None)
        # Rows come in Arrow batches, each put in sequence alone, so a step holds one batch of a book.
        for part in rows:
            fold(learner, part.sort_values("seq"))
        places, counts, flags, location, kind = learner.save()
        self.state.update(([int(p) for p in places], [int(c) for c in counts], [bool(f) for f in flags], location, kind))
        yield pd.DataFrame([learner.row(key[0])], columns=LEARNER_COLUMNS)

    def close(self) -> None:
        pass


def learner_stream(hits: DataFrame) -> DataFrame:
    """Learner state per book as a stream of updates; needs the RocksDB state store."""
    return hits.groupBy("book_id").transformWithStateInPandas(
        LearnerProcessor(), outputStructType=LEARNER_STATE, outputMode="Update", timeMode="None")


class ReorderingLearner(StatefulProcessor):
    """Keeps rows back until the watermark has passed them, then folds them in ``seq`` order.

    Time is cut into slots. Rows wait in pieces, one state entry per Arrow batch and slot, so adding
    rewrites nothing. When the watermark reaches the end of a slot its timer fires, and the pieces of
    that slot alone are read, put in order, folded and removed: a step holds one slot of one book.
    ``front`` is the end of the last slot folded; a row before it can no longer be put in its place
    and goes aside as ``late``, one without time or number as ``unplaced``.
    """

    def __init__(self, slot_ms: int) -> None:
        self.slot_ms = slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("learner", _SAVED)
        self.marks = handle.getValueState("marks", "front bigint, pieces bigint")
        self.waiting = handle.getMapState("waiting", "slot bigint, piece bigint", _WAITING)

    def _marks(self) -> tuple[int | None, int]:
        return tuple(self.marks.get()) if self.marks.exists() else (None, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        front, pieces = self._marks()
        for part in rows:
            placed = part["has_ts"].astype(bool) & part["has_seq"].astype(bool)
            late = placed & ((part["at_ms"] < front) if front is not None else False)
            for outcome, chosen in (("unplaced", ~placed), ("late", late)):
                if chosen.any():
                    yield _aside(key[0], part[chosen], outcome)
            kept = part[placed & ~late]
            slots = kept["at_ms"].astype("int64") // self.slot_ms
            for slot, group in kept.groupby(slots, sort=True):
                self.waiting.updateValue((int(slot), pieces), (
                    [int(n) for n in group["seq"]], [_text(x) for x in group["location"]],
                    [bool(x) if pd.notna(x) else None for x in group["hit"]], [_text(x) for x in group["number_type"]]))
                self.handle.registerTimer((int(slot) + 1) * self.slot_ms)
                pieces += 1
        self.marks.update((front, pieces))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # One call folds all that is due, so the order in which timers fire does not matter.
        past = timerValues.getCurrentWatermarkInMs() // self.slot_ms
        due: dict[int, list[int]] = {}
        for slot, piece in list(self.waiting.keys()):
            if slot < past:
                due.setdefault(slot, []).append(piece)
        if not due:
            return
        saved = self.state.get() if self.state.exists() else None
        learner = Learner(tuple(saved) if saved else None)
        for slot in sorted(due):
            read = [self.waiting.getValue((slot, piece)) for piece in sorted(due[slot])]
            rows = pd.concat([pd.DataFrame(dict(zip(_ROW, map(list, piece), strict=True)), dtype=object) for piece in read])
            fold(learner, rows.sort_values("seq", kind="stable"))
            for piece in due[slot]:
                self.waiting.removeKey((slot, piece))
        places, counts, flags, location, kind = learner.save()
        self.state.update(([int(p) for p in places], [int(c) for c in counts], [bool(f) for f in flags], location, kind))
        self.marks.update(((max(due) + 1) * self.slot_ms, self._marks()[1]))
        row = pd.DataFrame([("state", *learner.row(key[0]))], columns=["outcome", *LEARNER_COLUMNS], dtype=object)
        row = row.reindex(columns=_UPDATE_COLUMNS).astype(object)
        yield row.where(row.notna(), None)

    def close(self) -> None:
        pass


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _aside(book: str, rows: pd.DataFrame, outcome: str) -> pd.DataFrame:
    out = rows.assign(book_id=book, outcome=outcome).reindex(columns=_UPDATE_COLUMNS).astype(object)
    out["seq"], out["at_ms"] = out["seq"].where(rows["has_seq"], None), out["at_ms"].where(rows["has_ts"], None)
    return out.where(out.notna(), None)


def reordering_learner_stream(hits: DataFrame, late: str = "1 hour", slot: str = "10 minutes") -> DataFrame:
    """Learner updates per book from rows that come in any order within ``late``.

    ``hits`` needs ``ts``, which must not fall as ``seq`` rises. ``outcome`` says what a row is:

    * ``state``: the learner after all rows of a book up to a slot that the watermark has passed, the
      same as the batch form on those rows, in whatever order they came;
    * ``late``: a hit whose slot was folded before it came, ``unplaced``: one without ts or seq. Both
      carry the hit's own columns (its time in ``at_ms``) and change no state, so nothing is lost silently.

    A book keeps what came within ``late`` and one slot. Needs the RocksDB state store.
    """
    slot_ms = int(pd.Timedelta(slot).total_seconds() * 1000)
    # A computed time is no event-time column: Spark would drop late rows of such a column unseen.
    # Nulls travel as flags: pandas would turn a column of long numbers with a null into doubles.
    rows = hits.withWatermark("ts", late).select(
        "book_id", F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), *_ROW[1:],
        F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("at_ms"),
        F.col("seq").isNotNull().alias("has_seq"), F.col("ts").isNotNull().alias("has_ts"))
    return rows.groupBy("book_id").transformWithStateInPandas(
        ReorderingLearner(slot_ms), outputStructType=LEARNER_UPDATES, outputMode="Update", timeMode="EventTime")


def write_learner(updates: DataFrame, folder: str, checkpoint: str):
    """Start writing updates under ``folder``, by batch and outcome; a repeated batch replaces itself."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("outcome").parquet(f"{folder}/batch={number}")

    return updates.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint)


def latest_learners(updates: DataFrame) -> DataFrame:
    """The newest state of each book among written updates."""
    return (updates.where("outcome = 'state'").groupBy("book_id")
            .agg(F.max_by(F.struct(*LEARNER_COLUMNS[1:]), "events").alias("_s")).select("book_id", "_s.*"))


def set_aside(updates: DataFrame) -> DataFrame:
    """Hits that changed no state, with the reason."""
    return updates.where("outcome <> 'state'").select(
        "outcome", "book_id", F.timestamp_millis("at_ms").alias("ts"), *_ROW)


def session_stream(sessions: DataFrame, length: str = "1 day", slide: str | None = None,
                   late: str = "2 days") -> DataFrame:
    """Session metrics per window; rows later than the watermark are dropped."""
    return history.session_windows(sessions.withWatermark("ts", late), length, slide)


def user_sessions(sessions: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Runs of work per user, split where nothing happened for ``gap``."""
    return (sessions.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(
        F.count("*").alias("sessions"), F.sum("pages").alias("pages"))
        .select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"),
                "sessions", "pages"))


def new_files(files: DataFrame, late: str = "30 days") -> DataFrame:
    """Each content key once; keys older than the watermark are forgotten. Needs content_key, created."""
    return files.withWatermark("created", late).dropDuplicatesWithinWatermark(["content_key"])
