"""Packing of tokenised documents into sequences by the linear grouping scheme.

Documents become token ids plus one end id; only those longer than a sequence are cut, the
first piece taking the remainder. A full piece is a sequence of its own. The other lengths
are whole numbers below ``capacity``, so all that planning needs of the corpus is how many
pieces there are of each length - at most ``capacity`` counts, however large the corpus:

1. lengths above ``small`` are sorted and cut into ``groups`` groups of equal cardinality, and
   each group is rounded up to its longest piece;
2. which combinations of rounded lengths fill a sequence, and how often each is used, is a
   linear programme over few sizes, solved by column generation; its counts are rounded down;
3. actual pieces take the places of their group, longest first, so each place has room;
4. what is left - pieces without a place and all small ones - goes, longest first, to the
   sequence with the least room that suffices (best fit), or to a new one.

Steps 3 and 4 handle runs of equal sequences, not single ones: the plan is a table of (length,
range of ranks) -> (first sequence, pieces per sequence, offset) with a few thousand rows.
The pieces themselves are ranked within their length in Spark, by counts per task and length,
and look their place up in the plan. No piece is moved to the driver or into one task.

Defined results: a null or empty text is the end id alone; repeated rows are separate
documents; a null doc_id is carried along; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import bpe, store


@dataclass(frozen=True)
class Settings:
    capacity: int = 2048
    end_id: int = 0
    small: int = 850
    groups: int = 256
    cache_bytes: int = 48 << 20


def pieces(docs: DataFrame, tokenizer: str, setting: Settings) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the rank of the piece among those of its
    length in the same task (``part``, ``local``). Written once, so ranks never change."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        encode = bpe.encoder(tokenizer, setting.cache_bytes)
        part, seen, full = TaskContext.get().partitionId(), {}, setting.capacity
        end = np.array([setting.end_id], "<u4").tobytes()
        for batch in batches:
            owner, out = [], []
            for i, ids in bpe.encoded(batch["text"], encode):
                ids += end
                size = len(ids) // 4
                at, stop, number = 0, size % full or full, 0
                while at < size:
                    length = stop - at
                    local = seen.get(length, 0)
                    seen[length] = local + 1
                    owner.append(i)
                    out.append((number, at, length, zlib.crc32(ids[4 * at:4 * stop]), local))
                    at, stop, number = stop, stop + full, number + 1
            if out:
                number, at, length, crc, local = map(list, zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(at, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                     pa.array([part] * len(out), pa.int32()), pa.array(local, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"])

    return store.keep(docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, local long"))


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, uses): combinations of the few sizes and how often the linear programme of the
    fewest sequences uses each. Columns come from a knapsack on the current prices."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    uses = demand / np.diag(basis)
    room = np.arange(capacity + 1)
    before = room[None, :] - sizes[:, None]
    fits = before >= 0
    before = np.maximum(before, 0)
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        value, taken = np.zeros(capacity + 1), []
        for _ in range(int(capacity // sizes.min())):
            with_one = np.where(fits, price[:, None] + value[before], -np.inf)
            best = with_one.argmax(axis=0)
            gain = with_one[best, room]
            if not (gain > value + 1e-12).any():
                break
            taken.append(np.where(gain > value + 1e-12, best, -1))
            value = np.maximum(value, gain)
        if value[capacity] <= 1 + 1e-7:
            break
        column, left = np.zeros(k), capacity
        for choice in reversed(taken):
            if choice[left] >= 0:
                column[choice[left]] += 1
                left -= sizes[choice[left]]
        move = np.linalg.solve(basis, column)
        able = move > 1e-9
        if not able.any():
            break
        ratio = np.where(able, uses / np.where(able, move, 1), np.inf)
        out = int(ratio.argmin())
        uses = uses - ratio[out] * move
        uses[out] = ratio[out]
        basis[:, out] = column
    return np.rint(basis).astype(np.int64), np.maximum(uses, 0)


class Plan:
    """Runs of places: pieces of ``size`` with ranks [low, high) go ``per`` to a sequence, from
    sequence ``first`` on, at ``offset`` and the places after it."""

    def __init__(self, counts: np.ndarray, setting: Settings) -> None:
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.capacity, self.sequences = setting.capacity, 0
        self.room: dict[int, list[tuple[int, int]]] = {}
        counts = np.asarray(counts, np.int64)
        full = int(counts[self.capacity])
        self._add(self.capacity, 0, full, 0, 1, 0)
        self.sequences = full
        left = self._large(counts, setting)
        self._best_fit(left)

    def _add(self, size: int, low: int, high: int, first: int, per: int, offset: int) -> None:
        if high > low:
            self.rows.append((size, low, high, first, per, offset))

    def _large(self, counts: np.ndarray, setting: Settings) -> dict[int, tuple[int, int]]:
        """Steps 1-3. Returns what has no place yet: length -> (first rank, end) of its pieces."""
        lengths = [s for s in range(self.capacity - 1, 0, -1) if counts[s]]
        left = {s: [(0, int(counts[s]))] for s in lengths if s <= setting.small}
        large = [s for s in lengths if s > setting.small]
        total = int(sum(counts[s] for s in large))
        if not total:
            return left
        # Where each length begins in the order of all large pieces, longest first.
        begin = np.r_[0, np.cumsum([counts[s] for s in large])]
        k = min(setting.groups, len(large), total)
        border = [total * g // k for g in range(k + 1)]

        def size_at(i: int) -> int:
            return int(np.searchsorted(begin, i, side="right")) - 1

        longest = np.array([large[size_at(border[g])] for g in range(k)])
        # Groups rounded up to the same length are one size.
        sizes, group_of = np.unique(-longest, return_inverse=True)
        sizes = -sizes
        start = [min(border[g] for g in range(k) if group_of[g] == j) for j in range(len(sizes))] + [total]
        columns, uses = configurations(sizes, np.diff(start).astype(float), self.capacity)
        used = list(start[:-1])
        for c in range(len(sizes)):
            self._fill(columns[:, c], int(np.floor(uses[c] + 1e-6)), used, start, begin, large, size_at)
        for j in range(len(sizes)):
            i = used[j]
            while i < start[j + 1]:
                at = size_at(i)
                stop = min(int(begin[at + 1]), start[j + 1])
                left.setdefault(large[at], []).append((i - int(begin[at]), stop - int(begin[at])))
                i = stop
        return left

    def _fill(self, column, times, used, start, begin, large, size_at) -> None:
        """Put pieces into ``times`` sequences of one configuration, as runs of equal sequences."""
        parts = [(j, int(a)) for j, a in enumerate(column) if a]
        times = min([times, *(-(-(start[j + 1] - used[j]) // a) for j, a in parts)]) if parts else 0
        if times <= 0:
            return
        cuts = {0, times}
        for j, a in parts:
            end = min(start[j + 1], used[j] + a * times)
            for i in [*begin[np.searchsorted(begin, used[j], side="right"):np.searchsorted(begin, end, side="left")], end]:
                cuts.update(x for x in ((int(i) - used[j]) // a, -(-(int(i) - used[j]) // a)) if 0 <= x <= times)
        cuts = sorted(cuts)
        for b0, b1 in zip(cuts, cuts[1:]):
            offset, first = 0, self.sequences + b0
            for j, a in parts:
                i, stop = used[j] + a * b0, min(used[j] + a * b1, start[j + 1])
                while i < stop:
                    at = size_at(i)
                    upto = min(stop, int(begin[at + 1]))
                    same = a if b1 - b0 > 1 else upto - i
                    low = i - int(begin[at])
                    self._add(large[at], low, low + upto - i, first, same, offset)
                    offset += large[at] * min(same, upto - i)
                    i = upto
            self._open(self.capacity - offset, first, b1 - b0)
        self.sequences += times
        for j, a in parts:
            used[j] = min(start[j + 1], used[j] + a * times)

    def _open(self, room: int, first: int, many: int) -> None:
        if room > 0 and many > 0:
            self.room.setdefault(room, []).append((first, many))

    def _best_fit(self, left: dict[int, list[tuple[int, int]]]) -> None:
        """Step 4: longest first, each to the sequence with the least sufficient room. A sequence
        that takes a piece then has the least room of all, so it takes as many as it can."""
        levels = sorted(self.room)
        for size in sorted(left, reverse=True):
            for low, high in left[size]:
                while low < high:
                    at = bisect.bisect_left(levels, size)
                    if at == len(levels):
                        room, first = self.capacity, self.sequences
                        many = -(-(high - low) // (room // size))
                        self.sequences += many
                    else:
                        room = levels[at]
                        first, many = self.room[room].pop()
                        if not self.room[room]:
                            del self.room[room]
                            levels.pop(at)
                    per = room // size
                    whole = min(many, (high - low) // per)
                    rest = min(high - low - whole * per, per) if whole < many else 0
                    offset = self.capacity - room
                    self._add(size, low, low + whole * per, first, per, offset)
                    self._add(size, low + whole * per, low + whole * per + rest, first + whole, max(rest, 1), offset)
                    low += whole * per + rest
                    for new, begin, n in ((room - per * size, first, whole), (room - rest * size, first + whole, 1 if rest else 0),
                                          (room, first + whole + (1 if rest else 0), many - whole - (1 if rest else 0))):
                        if new > 0 and n > 0:
                            if new not in self.room:
                                bisect.insort(levels, new)
                            self._open(new, begin, n)


def place(pieces_: DataFrame, setting: Settings) -> DataFrame:
    """Add sequence_id and offset to the table of ``pieces``."""
    sizes = pieces_.groupBy("part", "length").agg(F.count("*").alias("n"))
    sizes = store.keep(sizes)
    counts = np.zeros(setting.capacity + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    rows = np.array(sorted(Plan(counts, setting).rows), np.int64).reshape(-1, 6)
    sent = pieces_.sparkSession.sparkContext.broadcast(rows)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))

    def look_up(batches):
        plan = sent.value
        keys = (plan[:, 0] << 48) | plan[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            size, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            row = plan[np.searchsorted(keys, (size << 48) | rank, side="right") - 1]
            into = rank - row[:, 1]
            columns = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(row[:, 3] + into // row[:, 4]), pa.array(row[:, 5] + into % row[:, 4] * size)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces_.schema["doc_id"].dataType.simpleString()
    ranked = pieces_.join(base, ["part", "length"]).withColumn("_rank", F.col("_base") + F.col("local"))
    return ranked.drop("part", "local", "_base").mapInArrow(
        look_up, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, setting: Settings = Settings()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return place(pieces(docs, tokenizer, setting), setting)
