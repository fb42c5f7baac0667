"""The location learner over books of any length: a fold in pieces.

Rows are dealt out by ranges of (book, seq), so a book of a third of all rows lies in a third of the
tasks. A piece is what one task holds of one book. What a piece does to the state before it is a
short summary:

* attempts and successes per location are sums;
* the standing of a location that the piece attempts is set by the piece, that of any other one only
  ages by the piece's moves;
* the progress of a number type needs its 15 first values tabulated: beyond those a learned type is
  lost for good at its first move, and an unlearned one only counts on.

Only which rows move the numbering depends on the state before. So every piece is folded from an
empty start, the summaries are chained, and pieces whose start proves to be another one are folded
again until no start changes. By induction over the pieces of a book the result is that of the plain
fold; a start differs in few places, which the first attempts in a piece overwrite, so two or three
turns are usual and as many as there are tasks the bound.

Only the first book of a task can have begun before it. The driver therefore holds at most two
summaries per task, never one per book.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.learner import KINDS, LEARNED_AT, LEARNER_COLUMNS, LEARNER_STATE, PLACE, POWERS, REGIONS
from quire.plans.session import fix

PLACES = len(REGIONS)
#: After so many rows without a move, rows are judged in runs of growing length, until one moves again.
QUIET, SHORTEST, LONGEST = 32, 64, 4096
_POWERS = POWERS.tolist()
#: Progress values whose way through a piece is tabulated: not yet learned, then learned.
STARTS = LEARNED_AT + 5

SUMMARY = ("book_id string, part int, first boolean, last boolean, done array<bigint>, tried array<bigint>, "
           "touched array<boolean>, boost array<boolean>, age array<bigint>, location int, moves bigint, "
           "hits array<bigint>, moved array<boolean>, progress array<bigint>, learned array<boolean>")
SUMMARY_COLUMNS = [part.strip().split()[0] for part in SUMMARY.split(",")]


class Start:
    """State of a book before a piece; enough to say which rows of the piece move the numbering."""

    def __init__(self) -> None:
        self.done, self.tried, self.age = (np.zeros(PLACES, np.int64) for _ in range(3))
        self.boost, self.location = np.zeros(PLACES, bool), -1

    def after(self, piece: dict) -> Start:
        """The state behind ``piece``."""
        new, touched = Start(), np.array(piece["touched"], bool)
        new.done, new.tried = self.done + piece["done"], self.tried + piece["tried"]
        new.boost = np.where(touched, piece["boost"], self.boost)
        new.age = np.where(touched, piece["age"], self.age + piece["moves"])
        new.location = piece["location"] if piece["location"] >= 0 else self.location
        return new

    def key(self) -> tuple:
        """Equal for states that no later row can tell apart."""
        age = np.where(self.done > 0, np.minimum(self.age, len(POWERS) - 1), 0)
        return (*self.done.tolist(), *self.tried.tolist(), *self.boost.tolist(), *age.tolist(), self.location)


class Piece:
    """Folds rows of one book in order; ``summary`` says what they did."""

    def __init__(self, start: Start | None = None) -> None:
        start = start or Start()
        self.first_done, self.first_tried = start.done, start.tried
        self.done, self.tried, self.age, self.boost = (
            start.done.copy(), start.tried.copy(), start.age.copy(), start.boost.copy())
        self.location, self.found, self.moves = start.location, False, 0
        self.touched, self.size, self.quiet = np.zeros(PLACES, bool), SHORTEST, 0
        self.hits, self.moved = [0] * len(KINDS), [False] * len(KINDS)
        self.progress = np.tile(np.arange(STARTS, dtype=np.int64), (len(KINDS), 1))
        self.learned = self.progress >= LEARNED_AT

    def add(self, place: np.ndarray, hit: np.ndarray, kind: np.ndarray) -> None:
        """``place`` and ``kind`` as numbers; kind -1 is neither type."""
        moved, begin = np.zeros(len(place), bool), 0
        while begin < len(place):
            if self.quiet < QUIET:
                begin = self._walk(place, hit, moved, begin)
            else:
                rows = slice(begin, begin + self.size)
                ahead = self._run(place[rows], hit[rows])
                begin += ahead
                self.quiet, self.size = (0, SHORTEST) if ahead < len(place[rows]) else (self.quiet, min(LONGEST, self.size * 2))
        for k in range(len(KINDS)):
            self._learn(k, moved[hit & (kind == k)])

    def _walk(self, places: np.ndarray, hits: np.ndarray, moved: np.ndarray, begin: int) -> int:
        """Row by row, until ``QUIET`` rows did not move the numbering; return the row after the last."""
        done, tried, age, boost = self.done.tolist(), self.tried.tolist(), self.age.tolist(), self.boost.tolist()
        location, row = self.location, begin

        def standing_of(d: int, t: int, b: bool, k: int) -> float:
            return d / max(t, 1) * (1.2 if b else 1.0) * _POWERS[min(k, len(_POWERS) - 1)]

        standing = list(map(standing_of, done, tried, boost, age))
        for place, hit in zip(places[begin:].tolist(), hits[begin:].tolist()):
            if self.quiet >= QUIET:
                break
            tried[place] += 1
            done[place] += hit
            self.touched[place] = True
            if hit and location not in (-1, place) and done[place] >= 3:
                self.moves, self.quiet, moved[row] = self.moves + 1, 0, True
                age = [k + 1 for k in age]
                age[place], boost[place] = 0, True
                standing = list(map(standing_of, done, tried, boost, age))
            else:
                age[place], boost[place] = 0, False
                standing[place] = done[place] / tried[place]
                self.quiet += 1
            best = max(standing)
            if best > 0.6:
                location, self.found = standing.index(best), True
                if standing.count(best) > 1:
                    location = max((k for k in range(PLACES) if standing[k] == best), key=done.__getitem__)
            row += 1
        self.done, self.tried, self.age, self.boost = np.array(done), np.array(tried), np.array(age), np.array(boost)
        self.location = location
        return row

    def _run(self, place: np.ndarray, hit: np.ndarray) -> int:
        """Take in the rows up to the first that moves the numbering; return how many."""
        rows = np.arange(len(place))
        tried, done = np.zeros((len(place), PLACES), np.int64), np.zeros((len(place), PLACES), np.int64)
        tried[rows, place], done[rows, place] = 1, hit
        tried, done = tried.cumsum(0), done.cumsum(0)
        seen = tried > 0
        tried, done = tried + self.tried, done + self.done
        factor = np.where(self.boost, 1.2, 1.0), POWERS[np.minimum(self.age, len(POWERS) - 1)]
        standing = done / np.maximum(tried, 1) * np.where(seen, 1.0, factor[0]) * np.where(seen, 1.0, factor[1])
        best = standing.max(1)
        top = np.where(standing == best[:, None], done, -1).argmax(1)
        latest = np.maximum.accumulate(np.where(best > 0.6, rows, -1))
        location = np.where(latest >= 0, top[latest], self.location)
        before = np.concatenate(([self.location], location[:-1]))
        moving = hit & (before >= 0) & (before != place) & (done[rows, place] >= 3)
        count = int(moving.argmax()) if moving.any() else len(place)
        if count:
            row = count - 1
            self.tried, self.done, self.location = tried[row], done[row], int(location[row])
            self.found |= bool(latest[row] >= 0)
            self.touched |= seen[row]
            self.boost, self.age = self.boost & ~seen[row], np.where(seen[row], 0, self.age)
        return count

    def _learn(self, k: int, moved: np.ndarray) -> None:
        self.hits[k] += len(moved)
        at = np.flatnonzero(moved)
        for gap in np.diff(at, prepend=-1):
            self._count(k, gap)
            self.progress[k] = np.where(self.learned[k], np.maximum(5, self.progress[k] - 5), self.progress[k])
            self.learned[k] = False
        self._count(k, len(moved) - 1 - at[-1] if len(at) else len(moved))
        self.moved[k] |= len(at) > 0

    def _count(self, k: int, more: int) -> None:
        self.learned[k] |= (self.progress[k] < LEARNED_AT) & (self.progress[k] + more >= LEARNED_AT)
        self.progress[k] += more

    def summary(self, book: str, part: int, first: bool, last: bool) -> dict:
        return {
            "book_id": book, "part": part, "first": first, "last": last,
            "done": (self.done - self.first_done).tolist(), "tried": (self.tried - self.first_tried).tolist(),
            "touched": self.touched.tolist(), "boost": self.boost.tolist(), "age": self.age.tolist(),
            "location": self.location if self.found else -1, "moves": self.moves, "hits": list(self.hits),
            "moved": list(self.moved), "progress": self.progress.ravel().tolist(), "learned": self.learned.ravel().tolist()}


def after_piece(progress: int, learned: bool, piece: dict, k: int) -> tuple[int, bool]:
    """Progress of number type ``k`` behind a piece."""
    if learned == (progress >= LEARNED_AT) and progress < STARTS:
        return int(piece["progress"][k * STARTS + progress]), bool(piece["learned"][k * STARTS + progress])
    if learned and piece["moved"][k]:
        return progress + int(piece["hits"][k]) - 5, False
    return progress + int(piece["hits"][k]), learned


def _fold(starts: dict[int, Start]):
    """mapInPandas function: rows of a task in order to one summary per book."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, piece, part, first, ready = None, None, 0, True, []
        for batch in batches:
            if not len(batch):
                continue
            part = int(batch["part"].iat[0])
            books = batch["book_id"].to_numpy()
            place, hit, kind = (batch[name].to_numpy() for name in ("place", "hit", "kind"))
            cuts = [0, *(np.flatnonzero(books[1:] != books[:-1]) + 1), len(books)]
            for low, high in zip(cuts, cuts[1:]):
                if books[low] != book:
                    if piece is not None:
                        ready.append(piece.summary(book, part, first, False))
                        first = False
                    book, piece = books[low], Piece(starts.get(part) if piece is None else None)
                piece.add(place[low:high], hit[low:high], kind[low:high])
            if ready:
                yield pd.DataFrame(ready, columns=SUMMARY_COLUMNS)
                ready = []
        if piece is not None:
            yield pd.DataFrame([piece.summary(book, part, first, True)], columns=SUMMARY_COLUMNS)
    return run


def _starts(edges: dict[tuple[int, bool], dict]) -> dict[int, Start]:
    """State before the first piece of each task whose book began in an earlier task."""
    found, book, state = {}, None, Start()
    for part in sorted({part for part, _ in edges}):
        piece = edges[part, True]
        if piece["book_id"] == book:
            found[part] = state
            state = state.after(piece)
        else:
            state = Start().after(piece)
        book = piece["book_id"]
        if not piece["last"]:
            piece = edges[part, False]
            book, state = piece["book_id"], Start().after(piece)
    return found


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Summaries sorted by book and task to one row per book."""
    book, state, ready = None, Start(), []

    def row() -> tuple:
        most = max(range(len(KINDS)), key=hits.__getitem__)
        return (book, int(state.tried.sum()), *(p for p, _ in types), *(known for _, known in types),
                REGIONS[state.location] if state.location >= 0 else None, KINDS[most] if hits[most] > 2 else None, moves)

    for batch in batches:
        for piece in batch.to_dict("records"):
            if piece["book_id"] != book:
                if book is not None:
                    ready.append(row())
                book, state, moves = piece["book_id"], Start(), 0
                types, hits = [(0, False)] * len(KINDS), [0] * len(KINDS)
            state, moves = state.after(piece), moves + piece["moves"]
            types = [after_piece(*types[k], piece, k) for k in range(len(KINDS))]
            hits = [hits[k] + int(piece["hits"][k]) for k in range(len(KINDS))]
        if ready:
            yield pd.DataFrame(ready, columns=LEARNER_COLUMNS)
            ready = []
    if book is not None:
        yield pd.DataFrame([row()], columns=LEARNER_COLUMNS)


def pieces(hits: DataFrame, parts: int | None = None) -> tuple[DataFrame, int]:
    """Summary of each piece from its true start, and the turns that took.

    Rows at no known region take no part; a null ``hit`` is none. Rows of equal ``seq`` go by
    region, hit and type.
    """
    spark = hits.sparkSession
    place = F.try_element_at(F.create_map(*[F.lit(x) for item in PLACE.items() for x in item]), F.col("location"))
    kind = F.when(F.col("number_type") == KINDS[0], 0).when(F.col("number_type") == KINDS[1], 1).otherwise(-1)
    rows = hits.select("book_id", "seq", place.alias("place"), F.coalesce("hit", F.lit(False)).alias("hit"),
                       kind.alias("kind")).where("book_id IS NOT NULL AND place IS NOT NULL")
    # The borders of the ranges are drawn from a sample, so the rows are written before they are read twice.
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = fix(rows.repartitionByRange(parts, "book_id", "seq")
               .sortWithinPartitions("book_id", "seq", "place", "hit", "kind").withColumn("part", F.spark_partition_id()))
    found = fix(rows.mapInPandas(_fold({}), SUMMARY))
    edges = {(r["part"], r["first"]): r.asDict() for r in found.where("first OR last").toLocalIterator()}
    known: dict[int, tuple] = {}
    turns = 1
    while True:
        starts = {part: start for part, start in _starts(edges).items() if known.get(part) != start.key()}
        if not starts:
            break
        turns += 1
        known.update({part: start.key() for part, start in starts.items()})
        books = spark.createDataFrame([(part, edges[part, True]["book_id"]) for part in starts], "part int, book_id string")
        # at most one row per task
        again = rows.join(F.broadcast(books), ["part", "book_id"], "left_semi").select(*rows.columns)
        for row in again.mapInPandas(_fold(starts), SUMMARY).toLocalIterator():
            old = edges[row["part"], True]
            edges[row["part"], True] = {**row.asDict(), "last": old["last"]}
    if not known:
        return found, turns
    mended = spark.createDataFrame([edges[part, True] for part in known], SUMMARY)
    old = F.col("first") & F.col("part").isin(list(known))
    return found.where(~old).unionByName(mended), turns


def location_learner(hits: DataFrame, parts: int | None = None) -> DataFrame:
    """Final learner state of each book, equal to folding its rows one by one in ``seq`` order.

    ``parts`` is the number of tasks the rows are dealt out to (the session's shuffle partitions).
    """
    found, _ = pieces(hits, parts)
    return found.repartition("book_id").sortWithinPartitions("book_id", "part").mapInPandas(_finish, LEARNER_STATE)
